"""Attention-based multiple-instance learning of document quality.

A document is a bag of passages of PASSAGE words. Every passage is encoded: shares of byte classes, repetition and shape
figures, and a hashed bag of byte trigrams pass through a learned tanh layer. Gated attention, softmax of
w . (tanh(V h) * sigmoid(U h)) over the passages, weighs them; the weighted mean passage gives the score through a
logistic output. All weights are learned together from document labels by Adam.

Training uses at most SAMPLE labelled rows, those of smallest hash, and of these, in the same order, as many as together
have at most PASSAGES passages: bounds of the fit alone. A sampled text counts with all of its passages. Scoring reads
every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import BATCH_ROWS, materialise, mix, text_bytes, word_hashes, words

PASSAGE = 64
#: Bounds of the fit: labelled rows, and their passages (a passage's features take 1 KB).
SAMPLE = 4_000
PASSAGES = 200_000
BUCKETS = 256
HIDDEN, GATE = 32, 16
EPOCHS, STEP = 30, 0.01
CUT = 0.3

_CLASS = np.full(256, 7, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"()-", b"!?", b"#*$%&|<>=@~^_{}[]\\/+`")):
    _CLASS[list(_chars)] = _k
CLASSES = 8
SHAPE = 6
WIDTH = CLASSES + SHAPE + BUCKETS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a text column, and each one's text number. A text without words has none."""
    data, bounds = text_bytes(column)
    starts, ends, owner = words(data, bounds)
    n = len(starts)
    if not n:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    first = np.searchsorted(owner, np.arange(len(bounds)))
    place = np.arange(n) - first[owner]
    opens = place % PASSAGE == 0
    bag = np.cumsum(opens) - 1
    head = np.flatnonzero(opens)
    total = np.diff(np.append(head, n)).astype(np.float64)
    begin = starts[head]
    # a byte belongs to the passage whose first word begins last before it; bytes before the first word count with it
    of_byte = np.maximum(np.searchsorted(begin, np.arange(len(data)), side="right") - 1, 0)
    size = np.maximum(1, np.bincount(of_byte, minlength=len(head)))
    shares = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=len(head) * CLASSES).reshape(-1, CLASSES) / size[:, None]
    value = word_hashes(data, starts, ends)
    same = np.zeros(n, bool)
    same[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    _, known = np.unique(mix(value + mix(bag.astype(np.uint64) + np.uint64(1))), return_index=True)
    fresh = np.zeros(n)
    fresh[known] = 1
    _, known = np.unique(mix(value + mix(owner.astype(np.uint64) + np.uint64(7))), return_index=True)
    new = np.zeros(n)
    new[known] = 1
    length = (ends - starts).astype(np.float64)
    add = lambda x: np.add.reduceat(x, head)
    mean = add(length) / total
    shape = np.stack([add(same.astype(float)) / total, add(fresh) / total, add(new) / total, mean / 10, np.sqrt(np.maximum(0, add(length**2) / total - mean**2)) / 10, total / PASSAGE], 1)
    grams = np.zeros((len(head), BUCKETS))
    if len(data) > 2:
        low = data.astype(np.uint32)
        code = (low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        bucket = (code >> np.uint32(24)).astype(np.int64)
        grams = np.bincount(of_byte[:-2] * BUCKETS + bucket, minlength=len(head) * BUCKETS).reshape(-1, BUCKETS) / size[:, None]
    return np.concatenate([shares, shape, np.sqrt(grams)], 1).astype(np.float32), owner[head]


class GatedAttention:
    """Encoder, gated attention and output, with their gradients."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        self.w = {"E": g(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "a": g(GATE, 1)[:, 0], "o": g(HIDDEN, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, head: np.ndarray):
        """Scores of the bags that begin at rows head (none empty)."""
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (v * u) @ w["a"]
        size = np.diff(np.append(head, len(x)))
        power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, head), size))
        weight = power / np.repeat(np.add.reduceat(power, head), size)
        z = np.add.reduceat(weight[:, None] * h, head)
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))
        return p, (x, h, v, u, weight, z, size)

    def gradient(self, p, y, held, head):
        w = self.w
        x, h, v, u, weight, z, size = held
        d = (p - y) / len(y)
        dz = np.repeat(d, size)[:, None] * w["o"]
        dh = weight[:, None] * dz
        dweight = (dz * h).sum(1)
        draw = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, head), size))
        gate = draw[:, None] * w["a"]
        dv, du = gate * u * (1 - v**2), gate * v * u * (1 - u)
        dh = (dh + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ draw, "o": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        n = sum(map(len, bags))
        self.mean = sum(x.sum(0, dtype=np.float64) for x in bags) / n
        self.scale = np.sqrt(sum(((x - self.mean) ** 2).sum(0) for x in bags) / n) + 1e-3
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        s = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 128):
                some = order[at : at + 128]
                x = np.concatenate([bags[i] for i in some]).astype(np.float64)
                head = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])[:-1]]).astype(int)
                p, held = self.forward(x, head)
                step += 1
                for k, g in self.gradient(p, labels[some], held, head).items():
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - STEP * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[GatedAttention | None, float]:
    """The fitted model (None if there is no labelled text with words) and the share of label 1 among the sample."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    chosen = named.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = chosen.collect()  # at most SAMPLE
    if not rows:
        return None, 0.5
    held = spark.createDataFrame([(r.id, r.y) for r in rows], f"id {dict(docs.dtypes)[id_col]}, y double")
    texts = given.join(F.broadcast(held), "id").select(F.xxhash64("id").alias("place"), F.xxhash64("text").alias("then"), "y", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, owner = passages(batch.column(3))
            head = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            out = [x[a:b].tobytes() for a, b in zip(head[:-1], head[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(head)), pa.array(out, pa.binary())], names=["place", "then", "y", "n", "x"])

    found = materialise(texts.mapInArrow(bags, "place long, then long, y double, n long, x binary"), "bags")
    order = ("place", "then", "y", "n")
    sizes = found.select(*order).orderBy(*order).limit(SAMPLE).collect()
    upto = np.cumsum([r.n for r in sizes])
    sampled = found.orderBy(*order).limit(max(1, int(np.searchsorted(upto, PASSAGES, side="right")))).select("x", "y").collect()
    pairs = [(np.frombuffer(r.x, np.float32).reshape(-1, WIDTH), r.y) for r in sampled if len(r.x)]
    if not pairs:
        return None, float(np.mean([r.y for r in rows]))
    model, y = GatedAttention(), np.array([y for _, y in pairs])
    model.fit([x for x, _ in pairs], y)
    return model, float(y.mean())


def score(docs: DataFrame, model: GatedAttention | None, prior: float, text_col: str = "text") -> DataFrame:
    """The rows without the text, with score (0 to 1, higher: label 1 is likelier); the prior for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, prior)
            x, owner = passages(batch.column(batch.schema.get_field_index("_text")))
            if len(x) and held.value is not None:
                some, head = np.unique(owner, return_index=True)
                out[some] = held.value.forward(x, head)[0]
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out)], names=[*kept, "score"])

    others = [f for f in docs.schema if f.name not in (text_col, "score")]
    given = docs.select(*(f.name for f in others), F.col(text_col).cast("string").alias("_text"))
    return given.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "score double"]))


def classify(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (1 if score >= CUT).

    training: a boolean column over the id; labels of other rows are never read. A null, empty or wordless text gets the
    share of label 1 among the training sample; a null label is no label; a label repeated for an id counts once, the
    larger one. Repeated rows are scored alike. Without labels every score is 0.5. An empty table gives an empty table.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    model, prior = learn(docs, labels.where(training), id_col, text_col)
    rows = docs.select(F.col(id_col), F.coalesce(~training, F.lit(True)).alias("held_out"), F.col(text_col))
    return score(rows, model, prior, text_col).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def screen(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, of the documents that the classifier does not reject (score >= CUT)."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    model, prior = learn(docs, labels.where(training), id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, prior)
            x, owner = passages(batch.column(at))
            if len(x) and held.value is not None:
                some, head = np.unique(owner, return_index=True)
                out[some] = held.value.forward(x, head)[0]
            yield batch.filter(pa.array(out >= CUT))

    return docs.mapInArrow(run, docs.schema)
