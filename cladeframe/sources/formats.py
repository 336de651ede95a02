"""Alignment files: MAF in and out, FASTA out, distance matrices. A block of MAF is one record of Spark's text reader, so
files split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The cells of a MAF line of a sequence, after its name.
CELLS = {"begin": ("long", 2), "size": ("long", 3), "strand": ("string", 4), "src_size": ("long", 5)}


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(block, track, name, seq, phase, begin, size, strand, src_size).

    A block begins at an `a` line or after a blank line. Lines end in LF or CRLF, cells are parted by any white space.
    phase is that of phase= on the `a` line, else 0; a cell that is no number is null. Block numbers rise along the files;
    lines other than `a` and `s` are ignored, and so are blocks without a track.
    """
    text = spark.read.option("lineSep", "\na").text(path)  # only a block's first line begins with an a
    head = F.coalesce(F.regexp_extract("value", r"\A[^\n]*\bphase=(\d)", 1).try_cast("int"), F.lit(0))
    parts = text.select(F.posexplode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("part", "body"), head.alias("phase"))
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: x.rlike(r"^s\s"))
    parts = parts.withColumn("lines", lines).where(F.size("lines") > 0).withColumn("block", F.monotonically_increasing_id())
    df = parts.select("block", F.when(F.col("part") == 0, F.col("phase")).otherwise(0).alias("phase"), F.posexplode("lines").alias("track", "line"))
    cells = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    cell = lambda k: F.get(cells, F.lit(k))
    more = (cell(k).try_cast(kind).alias(n) for n, (kind, k) in CELLS.items())
    return df.select("block", F.col("track").cast("int").alias("track"), cell(1).alias("name"), F.upper(cell(6)).alias("seq"), "phase", *more)


def to_maf(tracks: DataFrame) -> DataFrame:
    """One text value per block, ready for write.text. begin, strand and src_size are those of the table's columns; without
    them, or where they are null, 0, + and the number of residues. The size is always the number of residues."""
    bare = F.length(F.regexp_replace("seq", "[-.]", "")).cast("string")
    cell = lambda n, other: F.coalesce(F.col(n).cast("string"), other) if n in tracks.columns else other
    line = F.concat_ws(" ", F.lit("s"), "name", cell("begin", F.lit("0")), bare, cell("strand", F.lit("+")), cell("src_size", bare), "seq")
    rows = tracks.groupBy("block").agg(F.first("phase").alias("phase"), F.array_sort(F.collect_list(F.struct("track", line.alias("line")))).alias("x"))
    return rows.select("block", F.concat(F.lit("a phase="), F.col("phase").cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("value"))


def write_maf(tracks: DataFrame, path: str, split: bool = False) -> None:
    """One folder of text files, or (split) one folder per block."""
    rows = to_maf(tracks)
    if split:
        rows.write.partitionBy("block").text(path)
    else:
        rows.orderBy("block").select("value").write.text(path)


def to_fasta(tracks: DataFrame, first_id: int = 0) -> DataFrame:
    """(block, value): the target of each block without gaps, upper-cased, numbered in block order."""
    from pyspark.sql import Window

    target = tracks.where("track = 0").select("block", F.upper(F.regexp_replace("seq", "[-.]", "")).alias("seq"))
    stretch = target.withColumn("stretch", F.floor(F.col("block") / 4096))
    before = stretch.groupBy("stretch").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("stretch").orderBy("block")) - 1
    numbered = stretch.withColumn("within", within).join(before, "stretch")
    return numbered.select("block", F.concat(F.lit(">"), (F.col("before") + F.col("within") + first_id).cast("string"), F.lit("\n"), "seq").alias("value"))


def matrix_lines(distances: DataFrame, names: list[str]) -> DataFrame:
    """(ix, value): a tab-separated square of the distances (t1, t2, d) of taxa, one line for each with its name first, a
    head line of all names at -1; pairs that are not there are nan, the diagonal is 0."""
    both = distances.select("t1", "t2", "d").union(distances.select(F.col("t2"), F.col("t1"), F.col("d")))
    rows = both.groupBy("t1").agg(F.map_from_entries(F.collect_list(F.struct("t2", "d"))).alias("far"))  # a cell for each taxon
    spark = distances.sparkSession
    taxa = spark.createDataFrame(list(enumerate(names)), "ix int, name string")
    rows = taxa.join(rows, F.col("name") == F.col("t1"), "left")
    cell = lambda n: F.when(F.col("name") == n, "0.0").otherwise(F.coalesce(F.col("far")[n].cast("string"), F.lit("nan")))
    lines = rows.select("ix", F.concat_ws("\t", "name", *map(cell, names)).alias("value"))
    return spark.createDataFrame([(-1, "\t".join(["", *names]))], "ix int, value string").union(lines)


def write_matrix(distances: DataFrame, names: list[str], path: str) -> None:
    matrix_lines(distances, names).repartition(1).sortWithinPartitions("ix").select("value").write.text(path)  # a line for each taxon
