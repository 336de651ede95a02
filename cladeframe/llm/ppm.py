"""Language-model scores by prediction by partial matching over bytes, and smoothed unigram scores.

The trie holds byte contexts of orders 0 to ORDER with the counts of the symbol that follows, over all training texts; a
text ends with one end symbol, and what is missing before its beginning counts as end symbols. A symbol seen after the
context costs its count against the count plus the number of distinct symbols (escape method C); an unseen one costs the
escape and is looked for in the next shorter context with the symbols of the longer one excluded, down to the uniform
order -1. An escape is not paid where no symbol is new, nor is one reserved where none is left. The model is pretrained.

The trie grows with the corpus and never comes together in one place. It is cut in shards by the last two symbols of the
context: a shard holds all contexts of orders 2 to ORDER that end so (257^3 grams of order 4 at most), and of orders 1 and 0
there are 66,049 counts in all, which every task gets. Texts are cut in blocks, stretches of a scan task of about
BLOCK_BYTES. A block sends the grams that it holds, each once, to their shards, with their counts in training texts; the
shards price them and send the prices back to the block, where the texts meet them. Words take the same way to their
counts, by 64-bit hash. So what is shuffled, besides the texts themselves, grows with the distinct grams and words of a
block, not with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import _LOWER, BATCH_ROWS, Counts, materialise, text_bytes, word_hashes, words

ORDER = 4
END = 256
SYMBOLS = 257
#: Text of a block, about.
BLOCK_BYTES = 64 << 20
#: Symbols worked on at a time.
SLICE = 1 << 20
#: A gram is its shard and, in the low bits, the first two symbols of its context and the symbol.
LOCAL_BITS = 25
WORD_SHARDS = SYMBOLS * SYMBOLS
END_SHARD = WORD_SHARDS + 256


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with an END after each text, and where each text begins and the last one ends."""
    n = len(bounds) - 1
    out = np.full(len(data) + n, END, np.int16)
    body = np.ones(len(out), bool)
    body[bounds[1:] + np.arange(n)] = False
    out[body] = _LOWER[data]
    return out, bounds + np.arange(n + 1)


def grams(syms: np.ndarray, starts: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that end at symbols a to b - 1, and the text of each."""
    owner = np.searchsorted(starts, np.arange(a, b), side="right") - 1
    place = np.arange(a, b) - starts[owner]
    back = []
    for k in range(ORDER + 1):
        x = np.full(b - a, END, np.int64)
        x[max(0, k - a) :] = syms[max(0, a - k) : b - k]
        x[place < k] = END
        back.append(x)
    shard = back[2] * SYMBOLS + back[1]
    return shard << LOCAL_BITS | (back[4] * SYMBOLS + back[3]) * SYMBOLS + back[0], owner


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


_SENT = "shard int, turn int, block long, keys binary, counts binary"


class Block:
    """What a block sends: turn 0, counts of training texts; turn 1, the keys whose price it wants."""

    def __init__(self, block: int):
        self.block, self.grams, self.trained, self.words, self.texts = block, Counts(), Counts(np.uint64), Counts(np.uint64), 0

    def add(self, data: np.ndarray, bounds: np.ndarray, train: np.ndarray) -> None:
        syms, starts = symbols(data, bounds)
        for a in range(0, len(syms), SLICE):
            key, owner = grams(syms, starts, a, min(len(syms), a + SLICE))
            self.grams.add(*counted(key * 2 + train[owner]))
        at, ends, owner = words(data, bounds)
        hashes = word_hashes(data, at, ends)
        self.words.add(*counted(hashes))
        self.trained.add(*counted(hashes[train[owner]]))
        self.texts += int(train.sum())

    def rows(self) -> pa.RecordBatch:
        rows = []

        def cut(turn: int, shard: np.ndarray, keys: np.ndarray, times: np.ndarray | None) -> None:
            if not len(shard):
                return
            heads = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for a, b in zip(heads, [*heads[1:], len(shard)], strict=True):
                rows.append((int(shard[a]), turn, keys[a:b].tobytes(), b"" if times is None else times[a:b].tobytes()))

        twice, times = self.grams.merged()
        local = lambda key: (key & ((1 << LOCAL_BITS) - 1)).astype(np.uint32)
        seen, every = twice[twice % 2 == 1] >> 1, np.unique(twice >> 1)
        cut(0, seen >> LOCAL_BITS, local(seen), times[twice % 2 == 1])
        cut(1, every >> LOCAL_BITS, local(every), None)
        for turn, held in ((0, self.trained), (1, self.words)):
            keys, times = held.merged()
            cut(turn, (keys >> np.uint64(56)).astype(np.int64) + WORD_SHARDS, keys, None if turn else times)
        end = np.zeros(1, np.uint64)
        rows.append((END_SHARD, 1, end.tobytes(), b""))
        if self.texts:
            rows.append((END_SHARD, 0, end.tobytes(), np.array([self.texts], np.int64).tobytes()))
        shard, turn, keys, times = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(turn, pa.int32()), pa.array([self.block] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["shard", "turn", "block", "keys", "counts"])


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch (id, text, train, part), cut where a block of the part ends; rows alone decide that, not the batches."""
    upto = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(3)[0].as_py() << 32
        _, bounds = text_bytes(batch.column(1))
        block = (upto + bounds[:-1]) // BLOCK_BYTES
        upto += int(bounds[-1])
        heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(heads, [*heads[1:], len(block)], strict=True):
            yield first | int(block[a]), batch.slice(a, b - a)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Block | None = None
    for block, batch in in_blocks(batches):
        if held is None or held.block != block:
            if held is not None:
                yield held.rows()
            held = Block(block)
        held.add(*text_bytes(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
    if held is not None:
        yield held.rows()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of one context symbol and the symbol, over all texts: fixed in number."""
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        syms, starts = symbols(*text_bytes(batch.column(0)))
        before = np.full(len(syms), END, np.int32)
        before[1:] = syms[:-1]
        total += np.bincount(before * SYMBOLS + syms, minlength=len(total))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["gram", "n"])


class Shard:
    """The contexts of orders 2 to 4 that end with two symbols, and with pairs (order 1 by context, counts) those below."""

    def __init__(self, shard: int, keys: np.ndarray, times: np.ndarray, pairs: np.ndarray):
        self.keys, self.times = keys.astype(np.int64), times.astype(np.float64)
        context, symbol, two = self.keys // SYMBOLS, self.keys % SYMBOLS, self.keys % (SYMBOLS * SYMBOLS)
        self.context, at = np.unique(context, return_inverse=True)
        n = len(self.context)
        self.three = np.bincount(two, self.times, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
        self.lower = [np.bincount(symbol, self.times, SYMBOLS), pairs[shard % SYMBOLS].astype(np.float64), pairs.sum(0).astype(np.float64)]
        # per context: total, distinct symbols, and what those symbols count in the next shorter one
        self.four = np.bincount(at, self.times, n), np.bincount(at, minlength=n), np.bincount(at, self.three.ravel()[two], n)
        self.next = self.three.sum(1), np.count_nonzero(self.three, axis=1), (self.three > 0) @ self.lower[0]
        self.rest = [(c.sum(), np.count_nonzero(c), d[c > 0].sum()) for c, d in zip(self.lower, [*self.lower[1:], np.zeros(SYMBOLS)], strict=True)]

    def prices(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each local key's symbol after its context."""
        keys = keys.astype(np.int64)
        context, symbol, third = keys // SYMBOLS, keys % SYMBOLS, keys // SYMBOLS % SYMBOLS
        zero = np.zeros(len(keys))
        levels = []
        if len(self.context):
            at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
            there = self.context[at] == context
            own = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            count = np.where(self.keys[own] == keys, self.times[own], 0.0)
            levels.append((count, *(np.where(there, x[at], 0) for x in self.four)))
        levels.append((self.three[third, symbol], *(x[third] for x in self.next)))
        levels += [(c[symbol], *(zero + x for x in r)) for c, r in zip(self.lower, self.rest, strict=True)]
        out, done, gone, gone_n = zero.copy(), np.zeros(len(keys), bool), zero, zero
        for count, total, kinds, below in levels:
            fresh, mass = kinds - gone, total - gone_n
            live = ~done & (fresh > 0)
            under = np.where(live, mass + np.where(kinds < SYMBOLS, fresh, 0), 1.0)
            hit = live & (count > 0)
            out += np.log10(np.where(hit, count, np.where(live, fresh, 1.0)) / under)
            done |= hit
            gone, gone_n = kinds, below
        return out - np.where(done, 0.0, np.log10(np.maximum(1.0, SYMBOLS - gone)))


_PRICED = "block long, turn int, keys binary, prices binary, n long, v long"


def _price(pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, model, sums = None, Counts(), None, []

        def answered(rows):
            block, keys, prices, n, v = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array(keys, pa.binary()), pa.array(prices, pa.binary()), pa.array(n, pa.int64()), pa.array(v, pa.int64())],
                names=["block", "turn", "keys", "prices", "n", "v"],
            )

        for batch in batches:
            rows = []
            for shard, turn, block, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                word = shard >= WORD_SHARDS
                if shard != now:
                    now, held, model = shard, Counts(np.uint64 if word else np.uint32), None
                keys = np.frombuffer(keys, np.uint64 if word else np.uint32)
                if not turn:
                    held.add(keys, np.frombuffer(counts, np.int64))
                    continue
                if model is None:
                    model = held.merged() if word else Shard(shard, *held.merged(), pairs)
                    if word:
                        rows.append((-1, None, None, int(model[1].sum()), len(model[0])))
                if word:
                    at = np.minimum(np.searchsorted(model[0], keys), max(0, len(model[0]) - 1))
                    price = np.where(model[0][at] == keys, model[1][at], 0) if len(model[0]) else np.zeros(len(keys), np.int64)
                    rows.append((block, b"w" + keys.tobytes(), price.astype(np.int64).tobytes(), None, None))
                else:
                    full = np.int64(shard) << LOCAL_BITS | keys.astype(np.int64)
                    rows.append((block, b"g" + full.tobytes(), model.prices(keys).astype(np.float32).tobytes(), None, None))
            if rows:
                yield answered(rows)

    return run


class Lookup:
    """A hash table of fixed keys, filled and asked as whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.row, self.keys, self.values = np.full(size, -1, np.int32), keys.astype(np.uint64), values
        slot, left = self._slot(self.keys), np.arange(len(keys))
        while len(left):
            free = self.row[slot[left]] < 0
            self.row[slot[left[free]]] = left[free]
            left = left[self.row[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        slot, left = self._slot(keys), np.arange(len(keys))
        found = np.zeros(len(keys), np.int64)
        while len(left):
            row = self.row[slot[left]]
            if (row < 0).any():
                raise RuntimeError("a block holds what it did not send: the documents came in another order when they were read again")
            same = self.keys[row] == keys[left]
            found[left[same]] = row[same]
            left = left[~same]
            slot[left] = (slot[left] + 1) & (len(self.row) - 1)
        return self.values[found]


def _scored(kind: str):
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, base double, score double, n long, v long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, {}, None

        def table(tag: bytes, key_type, value_type) -> Lookup:
            got = parts.get(tag, [])
            return Lookup(np.concatenate([np.zeros(0, key_type), *(np.frombuffer(k, key_type, offset=1) for k, _ in got)]), np.concatenate([np.zeros(0, value_type), *(np.frombuffer(p, value_type) for _, p in got)]))

        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            block, turn = column["block"].to_numpy(), column["turn"].to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(turn) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, parts, tables = block[a], {}, None
                some = {k: x.slice(a, b - a) for k, x in column.items()}
                if now == -1:
                    none = [pa.nulls(b - a, some[c].type) for c in ("id", "train")] + [pa.nulls(b - a, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([*none, some["n"], some["v"]], names=["id", "train", "n_tokens", "n_known", "base", "score", "n", "v"])
                    continue
                if not turn[a]:
                    for keys, prices in zip(some["keys"].to_pylist(), some["prices"].to_pylist(), strict=True):
                        parts.setdefault(keys[:1], []).append((keys, prices))
                    continue
                if tables is None:
                    tables, parts = (table(b"g", np.int64, np.float32), table(b"w", np.uint64, np.int64)), {}
                data, bounds = text_bytes(some["text"])
                syms, starts = symbols(data, bounds)
                score = np.zeros(b - a)
                for at in range(0, len(syms), SLICE):
                    key, owner = grams(syms, starts, at, min(len(syms), at + SLICE))
                    score += np.bincount(owner, tables[0][key], b - a)
                first, last, owner = words(data, bounds)
                hashes = np.concatenate([word_hashes(data, first, last), np.zeros(b - a, np.uint64)])  # each text's end is key 0
                owner = np.concatenate([owner, np.arange(b - a)])
                count = tables[1][hashes]
                tokens, known, base = np.bincount(owner, minlength=b - a), np.bincount(owner[count > 0], minlength=b - a), np.bincount(owner, np.log10(count + 0.1), b - a)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([some["id"], some["train"], *map(pa.array, (tokens, known, base, score)), none, none], names=["id", "train", "n_tokens", "n_known", "base", "score", "n", "v"])

    return schema, run


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training: a boolean column; the other rows are held out. docs is read more than once and must give its rows in the
    same order each time, as tables do; if it does not, an error is raised. A null text counts as empty: one end token.
    Texts are read whole, very long ones in slices. Repeated rows are scored alike; other columns are not read. Without
    training texts every count is 0, base_score is 0 per token (one unseen token in a vocabulary of one) and score is
    uniform over 257 symbols. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"), F.spark_partition_id().alias("part"))
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in docs.where("train").select("text").mapInArrow(_pairs, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 66,049
        pairs[r.gram] = r.n
    sent = docs.mapInArrow(_send, _SENT).repartition("shard").sortWithinPartitions("shard", "turn")
    prices = sent.mapInArrow(_price(pairs.reshape(SYMBOLS, SYMBOLS)), _PRICED)
    kind = dict(docs.dtypes)["id"]
    texts = docs.mapInArrow(_numbered, f"id {kind}, text string, train boolean, block long")
    null = lambda t: F.lit(None).cast(t)
    both = prices.select("block", "turn", "keys", "prices", "n", "v", null(kind).alias("id"), null("string").alias("text"), null("boolean").alias("train"))
    both = both.union(texts.select("block", F.lit(1), null("binary"), null("binary"), null("long"), null("long"), "id", "text", "train"))
    schema, run = _scored(kind)
    parts = materialise(both.repartition("block").sortWithinPartitions("block", "turn").mapInArrow(run, schema), "scored")
    totals = parts.where("n is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    below = float(np.log10(totals.n + 0.1 * (totals.v + 1)))
    return parts.where("n is null").select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(totals.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score",
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, batch in in_blocks(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(batch.num_rows, block))], names=["id", "text", "train", "block"])
