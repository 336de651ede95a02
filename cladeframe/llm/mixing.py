"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule goes to the source whose interval of cumulative targets holds the golden-ratio point
t * 0.618... modulo 1, so every stretch of the mix is close to the targets. Slots are ranked per source, and the n-th
slot of a source takes the n-th block of its line: its documents in shuffled order (by digest of the id), end to end,
over and over, cut in blocks of equal word counts. The slots alone decide what is taken: a source gives as many blocks
as slots fell to it, which is within a few of target / block for any number of slots. Only the last slot is shorter,
where the words of the mix do not divide, and no line goes on after EPOCHS rounds.

One row per source comes to the driver (MAX_SOURCES at most, checked); documents never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladeframe.llm.common import WORD, materialise

#: Words of a slot.
BLOCK = 64
EPOCHS = 3
MAX_SOURCES = 1_000_000
GOLDEN = 0.6180339887498949
#: Slot numbers are split so that both products keep their fraction in double precision.
_LOW = 1 << 26


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Share the total by weight; none above EPOCHS times its size, the excess reshared among the rest by weight.

    Sources reach their limit in the order of size per weight, so one pass in that order finds which do."""
    out, left, weight = [0.0] * len(sizes), sum(sizes), sum(weights)
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k] / weights[k]):
        out[k] = min(float(EPOCHS * sizes[k]), left * weights[k] / weight)
        if out[k] == EPOCHS * sizes[k]:
            left -= EPOCHS * sizes[k]
            weight -= weights[k]
    return out


def golden(t: np.ndarray) -> np.ndarray:
    high, low = np.divmod(t, _LOW)
    return ((low * GOLDEN) % 1.0 + (high * ((_LOW * GOLDEN) % 1.0)) % 1.0) % 1.0


class Mix:
    """The sized documents, the sources with their targets, and the slots that take them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, block: int = BLOCK):
        self.block = block
        size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
        source = F.col(source_col).cast("string")
        key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
        shuffled = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
        sized = docs.select(F.col(id_col).alias("id"), key.alias("key"), size.alias("size"), shuffled.alias("place"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
        self.sized = sized = materialise(sized.withColumn("bucket", F.substring("place", 1, 3)), "sized")

        found = sized.groupBy("key").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r.key == "n", r.key))
        self.keys = [r.key for r in found]
        self.sizes = [int(r["size"]) for r in found]
        self.targets = targets(self.sizes, [1 + k % 3 for k in range(len(found))])
        self.total = sum(self.sizes)
        self.slots = -(-self.total // block)
        self.sources = docs.sparkSession.createDataFrame(list(enumerate(zip(self.keys, self.sizes, self.targets, strict=True))), "source int, s struct<key:string,source_size:long,target:double>").select("source", "s.*")

    def schedule(self) -> DataFrame:
        """(slot, source, nth): the source of each slot, and which of its slots it is."""
        ends = np.cumsum(self.targets) / max(1, self.total)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(np.searchsorted(ends, golden(t), side="right"), len(ends) - 1).astype(np.int32))], names=["slot", "source"])

        points = self.sized.sparkSession.range(self.slots).mapInArrow(assign, "slot long, source int")
        # ranks without one task per source: slots are cut in stretches, counted, and numbered within each
        points = points.withColumn("stretch", F.floor(F.col("slot") / 65536))
        before = points.groupBy("source", "stretch").agg(F.count("*").alias("n"))
        before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
        return points.withColumn("within", within).join(before, ["source", "stretch"]).select("slot", "source", (F.col("before") + F.col("within")).alias("nth"))

    def lines(self, schedule: DataFrame) -> DataFrame:
        """The sources with words: where their line ends, which is what their slots hold or EPOCHS rounds."""
        short = self.slots * self.block - self.total  # what the last slot lacks
        held = F.sum(F.when(F.col("slot") == self.slots - 1, self.block - short).otherwise(self.block))
        ends = schedule.groupBy("source").agg(held.cast("long").alias("held"))
        return self.sources.join(ends, "source").withColumn("words", F.least("held", EPOCHS * F.col("source_size"))).drop("held")

    def placed(self) -> DataFrame:
        """The documents with their first word's place in their source's line."""
        within = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("place", "id", "row")) - F.col("size")
        bucket = self.sized.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        offsets = bucket.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        return self.sized.withColumn("within", within).join(offsets, ["key", "bucket"]).select("row", "id", "key", "size", (F.col("before") + F.col("within")).alias("at"))

    def parts(self) -> DataFrame:
        """(slot, row, epoch, first, last, begin, size): the words [first, last) of a document that a slot takes.

        begin is the document's place in its source's line, size its words."""
        schedule = materialise(self.schedule(), "schedule")
        df = self.placed().where("size > 0").join(self.lines(schedule), "key")
        df = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
        begin = F.col("at") + F.col("epoch") * F.col("source_size")
        df = df.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), "words")).where("begin < end")
        df = df.withColumn("nth", F.explode(F.sequence(F.floor(F.col("begin") / self.block), F.floor((F.col("end") - 1) / self.block))))
        first = F.greatest(F.col("begin"), F.col("nth") * self.block) - F.col("begin")
        last = F.least(F.col("end"), (F.col("nth") + 1) * self.block) - F.col("begin")
        df = df.select("row", "source", "epoch", "nth", first.alias("first"), last.alias("last"), "begin", "size")
        return schedule.join(df, ["source", "nth"]).select("slot", "row", "epoch", "first", "last", "begin", "size")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """Per row: id, size, source_size, target, taken.

    A null text has size 0; a null source is a source, the last one; rows of size 0 are taken 0 words; repeated rows
    are laid out one after the other, each on its own; very long texts are spread over as many slots as they need; other
    columns are not read. An empty table gives an empty table.
    """
    held = Mix(docs, id_col, text_col, source_col, block=block)
    taken = held.parts().groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = held.sized.join(held.sources, "key").join(taken, "row", "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slot of a text, with the words that it takes; a text that is taken whole stays as it is."""
    for batch in batches:
        lists, pieces = batch.column(1), []
        taken, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
        field = {n: taken.field(n) for n in ("slot", "begin", "epoch", "first", "last", "size")}
        first, last, whole = (field[n].to_pylist() for n in ("first", "last", "size"))
        at = 0
        for text, n in zip(batch.column(0).to_pylist(), size, strict=True):
            words = text.encode().split()  # at the six white characters, as words are counted
            for k in range(at, at + n):
                pieces.append(text if not first[k] and last[k] == whole[k] else b" ".join(words[first[k] : last[k]]).decode())
            at += n
        rest = batch.column(2).take(pa.array(np.repeat(np.arange(batch.num_rows), size)))
        yield pa.RecordBatch.from_arrays([*(field[n] for n in ("slot", "begin", "epoch", "first", "last")), pa.array(pieces, pa.string()), rest], names=["slot", "begin", "epoch", "first", "last", "text", "rest"])


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int) -> DataFrame:
    """(slot, epoch, first, last, doc): doc is a struct of the columns of docs, so that no name of theirs can clash."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    numbered = materialise(docs.select(doc, F.monotonically_increasing_id().alias("row")), "numbered")
    given = numbered.select(*(F.col(f"doc.`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))), "row")
    parts = Mix(given, "id", "text", "source", "row", block).parts()
    # a document meets all of its slots at once: its text is cut into words once
    slots = parts.groupBy("row").agg(F.collect_list(F.struct("slot", "begin", "epoch", "first", "last", "size")).alias("slots"))  # as many as its words allow
    others = [F.col(f"doc.`{c}`").alias(str(k)) for k, c in enumerate(docs.columns) if c != text_col]
    df = numbered.join(slots, "row").select(F.col(f"doc.`{text_col}`").cast("string").alias("text"), "slots", F.struct(*others, F.lit(0).alias("none")).alias("rest"))
    fields = "slot long, begin long, epoch int, first long, last long, text string"
    df = df.mapInArrow(_cut, StructType([*StructType.fromDDL(fields), df.schema["rest"]]))
    doc = F.struct(*((F.col("text").cast(docs.schema[c].dataType) if c == text_col else F.col(f"rest.`{k}`")).alias(c) for k, c in enumerate(docs.columns))).alias("doc")
    df = df.select("slot", "begin", "epoch", "first", "last", doc)
    # a slot's parts lie in its source's line by epoch and place
    return df.repartitionByRange("slot").sortWithinPartitions("slot", "begin")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix in its order: slot, epoch, first, last and the columns of docs, range-partitioned and sorted by slot.

    A row is what one slot takes of one document: the words [first, last), as the text. A part that is the whole document
    keeps its text as it is. Documents that the mix does not take are left out, so are null and empty texts. Columns of
    docs may have any names, those of the four included. An empty table gives an empty table.
    """
    return _mixed(docs, id_col, text_col, source_col, block).select("slot", "epoch", "first", "last", "doc.*")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix itself in the order of its slots, with the columns of docs; a row is what a slot takes of a document."""
    return _mixed(docs, id_col, text_col, source_col, block).select("doc.*")
