"""A deterministic alignment over a table of texts, so that alignment queries have an input.

Four texts in a row of ids form a block; the letters of a text, mapped to A C G T, are a track, everything else a gap.
Texts are used whole, so tracks of a block are ragged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.alignment import BATCH_STRETCHES

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MAPPED = ("ACGT" * 7)[:26]
TRACKS = 4


def tracks(spark: SparkSession, sf_dir: str, n: int = TRACKS) -> DataFrame:
    """(block, track, seq, phase), n texts a block; track 0 is the target."""
    return tracks_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), n)


def track_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return tracks_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]"))


#: The symbol of each byte of a text in either case; the bytes of a longer character after its first are left out.
_SYMBOL = np.full(256, ord("-"), np.uint8)
_SYMBOL[list(LETTERS.encode())] = _SYMBOL[list(LETTERS.upper().encode())] = list(MAPPED.encode())
#: The only longer characters whose lower case has a letter of these: the Kelvin sign, and I with a dot, which becomes two.
_LOWERED = {"\u212a": "k", "\u0130": "i\u0307"}


def symbols(texts: pa.Array) -> pa.Array:
    """Texts as tracks: a symbol for each character of the lower-cased text."""
    texts = texts.cast(pa.large_string())
    data, bounds = _bytes_of(texts)
    if len(data) and data.max() > 127:
        raw = data.tobytes()
        for x in (x for x in _LOWERED if x.encode() in raw):
            texts = pc.replace_substring(texts, x, _LOWERED[x])
        data, bounds = _bytes_of(texts)
        rest = (data & 0xC0) == 0x80
        bounds = bounds - np.searchsorted(np.flatnonzero(rest), bounds)
        data = data[~rest]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(_SYMBOL[data])).cast(pa.string())


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and ends."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def tracks_of(docs: DataFrame, n: int = TRACKS) -> DataFrame:
    """The texts as tracks. Letters become symbols in numpy, a batch of texts at a time; the function counts as one whose calls
    differ, so that a filter on seq does not bring a second call for each text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_STRETCHES))
    docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    seq = F.arrow_udf(symbols, "string").asNondeterministic()(F.col("text"))
    block = F.floor(F.col("doc_id") / n).cast("long")
    return docs.select(block.alias("block"), (F.col("doc_id") % n).cast("int").alias("track"), seq.alias("seq"), (block % 3).cast("int").alias("phase"))


def tracks_sql(n: int = TRACKS) -> str:
    """The tables tracks, sites and wide of the view."""
    wide = ", ".join(f"coalesce(max(CASE WHEN track = {k} THEN sym END), '~') AS t{k}" for k in range(n))
    return f"""tracks AS (
  SELECT CAST(floor(doc_id / {n}) AS BIGINT) AS block, CAST(doc_id % {n} AS INTEGER) AS track,
         regexp_replace(translate(lower(text), '{LETTERS}', '{MAPPED}'), '[^ACGT]', '-', 'g') AS seq,
         CAST(CAST(floor(doc_id / {n}) AS BIGINT) % 3 AS INTEGER) AS phase
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sites AS (SELECT block, track, phase, unnest(string_split(seq, '')) AS sym, unnest(range(0, length(seq)))::INTEGER AS col FROM tracks WHERE seq <> ''),
wide AS (SELECT block, phase, col, {wide} FROM sites GROUP BY block, phase, col)"""


TRACKS_SQL = tracks_sql()


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two to ten leaves for each text, numbered like a heap from the root's 1: node n stands under n / 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("tree"), F.col("text")).where("text is not null and tree is not null")
    sized = docs.select("tree", (2 + F.octet_length("text") % 9).alias("leaves"))
    df = sized.withColumn("node", F.explode(F.expr("sequence(1, 2 * leaves - 1)")))
    leaf, root = F.col("node") >= F.col("leaves"), F.col("node") == 1
    name = F.concat(F.when(leaf, "x").otherwise("A"), F.format_string("%02d", "node"))
    far = ((F.col("tree") * 31 + F.col("node") * 17) % 97 + 1) / 100
    return df.select("tree", "node", name.alias("name"), F.when(leaf, "LEAF").otherwise("INTERNAL").alias("kind"), F.when(~root, F.floor(F.col("node") / 2).cast("int")).alias("parent"), (F.col("node") % 2).alias("child_ix"), F.when(~root, far).alias("branch_len"))


FOREST_SQL = """forest AS (
  SELECT tree, CAST(node AS INTEGER) AS node, (CASE WHEN node >= leaves THEN 'x' ELSE 'A' END) || lpad(CAST(node AS VARCHAR), 2, '0') AS name, CASE WHEN node >= leaves THEN 'LEAF' ELSE 'INTERNAL' END AS kind,
         CASE WHEN node > 1 THEN CAST(node // 2 AS INTEGER) END AS parent, CASE WHEN node > 1 THEN CAST((tree * 31 + node * 17) % 97 + 1 AS DOUBLE) / 100 END AS branch_len
  FROM (SELECT tree, leaves, unnest(range(1, 2 * leaves)) AS node FROM (SELECT doc_id AS tree, 2 + octet_length(encode(text)) % 9 AS leaves FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
up AS (SELECT tree, node, node AS ancestor, 0e0 AS dist FROM forest
       UNION ALL SELECT u.tree, u.node, f.parent, u.dist + f.branch_len FROM up u JOIN forest f ON f.tree = u.tree AND f.node = u.ancestor WHERE f.parent IS NOT NULL),
leaf AS (SELECT u.tree, u.ancestor, u.node, n.name, u.dist FROM up u JOIN forest n ON n.tree = u.tree AND n.node = u.node WHERE n.kind = 'LEAF'),
far AS (SELECT x.tree, x.name AS a, y.name AS b, x.node AS m, y.node AS n, round(min(x.dist + y.dist), 9) AS d FROM leaf x JOIN leaf y ON x.tree = y.tree AND x.ancestor = y.ancestor AND x.name < y.name GROUP BY ALL)"""
