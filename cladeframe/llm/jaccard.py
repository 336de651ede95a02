"""N-gram Jaccard join by prefix filters under several global token orders, and the components of its links.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets form a class (first
pass); only classes are joined. Two classes can reach the similarity only if the first p = n - ceil(t n) + 1 shingles
of each, under any one total order of all shingles, share a shingle. The first order is by how many texts hold a shingle,
seldom ones first, so very common passages stay out of the prefixes; its blocks propose the candidates. The other orders
are independent hash permutations. The prefixes of a candidate's two classes under each of them are joined to it next, and
only what shares a shingle under all orders goes on to the exact comparison, for which alone texts are moved.

Counts are exact: every task sends the 40-bit fingerprints of its shingles, sorted, by range, and ranges are merged. The
COMMON most frequent ones at most, by powers of two, are what the order needs to know; all others come before them.

A block of classes that share a prefix shingle never becomes all its pairs: the first round compares each member with
one pivot (the member that meets the shingle earliest), the links found are contracted (further rounds take other pivots
where a block still spans several components), and then only members of different components are compared.
What is broadcast has a fixed size (COMMON counts: 9 MB, bit maps: 16 MB and 2 MB) whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import BATCH_ROWS, Counts, as_signed, materialise, mix, shingle_sets

#: Fingerprints go by RANGES ranges of their first bits, with LOW bits more.
RANGES, LOW = 1 << 12, 28
#: Shingles that a task holds before it sends them.
HELD = 1_000_000
#: Most shingles whose frequency the first order knows.
COMMON = 1 << 20
#: Bits of the map of shingles that more than one text holds.
REPEATED_BITS = 27
CHUNKS = 64
MAP_BITS = 24
#: Rounds that compare each block with one pivot before the open blocks are compared in full.
STAR_ROUNDS = 1
#: Salts of the orders that confirm a candidate.
ORDERS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def needed(n_a, n_b, percent: int):
    """Least intersection of sets of these sizes for percent * union <= 100 * intersection."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _chunk_rows(whole: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(whole, CHUNKS)]


def merged(rows: DataFrame, dtype, combine) -> np.ndarray:
    """Combine fixed-size arrays that came as rows (chunk, counts); the result has the same fixed size."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), dtype)
                held[chunk] = combine(held[chunk], part) if chunk in held else part.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "counts"])

    got = rows.repartition(16, "chunk").mapInArrow(reduce, "chunk int, counts binary").collect()  # CHUNKS rows of fixed size
    return np.concatenate([np.frombuffer(r.counts, dtype) for r in sorted(got)]) if got else np.zeros(0, dtype)


def set_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_key(s) if len(s) else None) for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([k for _, k in sets], pa.int64())], names=["id", "n", "node"])

    return run


def _fingerprints(width: int):
    """(range, keys, counts): the task's shingles, sorted, with the number of its distinct sets that hold each."""

    def sent(keys, times):
        cuts = np.searchsorted(keys, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(LOW))
        low = (keys & np.uint64((1 << LOW) - 1)).astype(np.uint32)
        rows = [(k, low[a:b].tobytes(), times[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, set()
        for batch in batches:
            for s in shingle_sets(batch.column(1), width):
                if not len(s) or (key := set_key(s)) in done:
                    continue
                done.add(key)  # exact copies within the task
                held.append(s >> np.uint64(64 - LOW - 12))
                size += len(s)
            if size > HELD:
                yield sent(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if size:
            yield sent(*np.unique(np.concatenate(held), return_counts=True))

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, level, n, keys): the range's shingles of 2^level sets or more, from 8 up; level 1: bits of those of two or more."""
    width = REPEATED_BITS - 12

    def ranked(k, held):
        keys, times = held.merged()
        bits = np.zeros(1 << width, bool)
        bits[keys[times > 1] >> (LOW - width)] = True
        level = np.log2(times).astype(np.int64)
        rows = [(k, 1, 0, np.packbits(bits).tobytes())]
        rows += [(k, int(x), int((level == x).sum()), keys[level == x].astype(np.uint32).tobytes()) for x in np.unique(level[level > 2])]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["range", "level", "n", "keys"])

    now, held = None, Counts()
    for batch in batches:
        for k, keys, times in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if k != now and now is not None:
                yield ranked(now, held)
                held = Counts()
            now = k
            held.add(np.frombuffer(keys, np.uint32), np.frombuffer(times, np.uint32))
    if now is not None:
        yield ranked(now, held)


class Frequencies:
    """What the first order knows of shingles: the level of common ones, and which ones one set alone holds."""

    def __init__(self, docs: DataFrame, width: int):
        sent = docs.mapInArrow(_fingerprints(width), "range int, keys binary, counts binary").repartition("range").sortWithinPartitions("range")
        found = materialise(sent.mapInArrow(_levels, "range int, level int, n long, keys binary"), "frequencies")
        sizes = {r.level: r.n for r in found.where("level > 1").groupBy("level").agg(F.sum("n").alias("n")).collect()}
        least, left = 64, COMMON
        for level in sorted(sizes, reverse=True):
            left -= sizes[level]
            if left < 0:
                break
            least = level
        self.bits = np.zeros((RANGES, (1 << REPEATED_BITS - 3) // RANGES), np.uint8)
        for r in found.where("level = 1").select("range", "keys").collect():  # one stretch of the map for each range
            self.bits[r.range] = np.frombuffer(r.keys, np.uint8)
        self.bits = self.bits.ravel()
        rows = found.where(F.col("level") >= least).select("range", "level", "keys").collect()  # COMMON keys at most
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | np.uint64(r["range"] << LOW) for r in rows)])
        level = np.concatenate([np.zeros(0, np.uint8), *(np.full(len(r["keys"]) // 4, r["level"], np.uint8) for r in rows)])
        order = np.argsort(keys)
        self.keys, self.level = keys[order], level[order]

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        """The first order: by level, then by hash."""
        if not len(self.keys):
            return shingles >> np.uint64(6)
        print_ = shingles >> np.uint64(64 - LOW - 12)
        at = np.minimum(np.searchsorted(self.keys, print_), len(self.keys) - 1)
        level = np.where(self.keys[at] == print_, self.level[at], 0).astype(np.uint64)
        return level << np.uint64(58) | shingles >> np.uint64(6)

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """Whether a second set may hold them."""
        at = shingles >> np.uint64(64 - REPEATED_BITS)
        return ((self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def _prefixes(width: int, percent: int, frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = frequencies.value, set()
        for batch in batches:
            token, node, at = [], [], []
            for s in shingle_sets(batch.column(1), width):
                if not len(s) or (key := set_key(s)) in done:
                    continue
                done.add(key)  # exact copies within the task
                n = len(s)
                chosen = s[np.argsort(known.rank(s), kind="stable")[: prefix_length(n, percent)]]
                there = np.flatnonzero(known.shared(chosen))
                token.append(chosen[there])
                node.append(np.full(len(there), key, np.int64))
                at.append((np.int64(n) << 32) | there)
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(np.concatenate(token))), pa.array(np.concatenate(node)), pa.array(np.concatenate(at))], names=["token", "node", "at"])

    return run


def _reachable(a: str, b: str, percent: int):
    """Whether two prefix rows can be the first shared shingle of a linked pair: sizes and positions allow the overlap."""
    na, nb = (F.shiftright(F.col(x), 32) for x in (a, b))
    pa_, pb = (F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b))
    least = F.ceil(percent * (na + nb) / (100 + percent)).cast("long")
    return (F.least(na - pa_, nb - pb) >= least) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _bit_map(nodes: DataFrame) -> np.ndarray:
    def run(batches):
        bits = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            bits[mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - MAP_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(_chunk_rows(np.packbits(bits)), pa.binary())], names=["chunk", "counts"])

    found = merged(nodes.mapInArrow(run, "chunk int, counts binary"), np.uint8, np.bitwise_or)
    return found if len(found) else np.zeros(1 << MAP_BITS - 3, np.uint8)  # no pair at all


def in_bit_map(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = mix(nodes.view(np.uint64)) >> np.uint64(64 - MAP_BITS)
    return ((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def _wanted(docs: DataFrame, width: int, wanted, make, kind: str) -> DataFrame:
    """(node, id, x) of the texts whose class may be wanted; x is made of the set and the text."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            keep = np.flatnonzero(in_bit_map(wanted.value, keys.fill_null(0).to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False))
            made = [make(sets[k], batch.column(1)[k].as_py()) for k in keep]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), batch.column(0).take(at), pa.array(made, pa.binary() if kind == "binary" else pa.string())], names=["node", "id", "x"])

    return docs.mapInArrow(run, f"node long, id long, x {kind}")


def other_prefixes(shingles: np.ndarray, percent: int) -> list[np.ndarray]:
    """Under each further order, the first 32 bits of the ranks of the set's prefix, sorted."""
    p = prefix_length(len(shingles), percent)
    return [(np.sort(mix(shingles ^ salt))[:p] >> np.uint64(32)).astype(np.uint32) for salt in ORDERS]


def meet(x: bytes, y: bytes) -> bool:
    """Whether two classes share a prefix shingle under every further order (or two of equal first 32 bits)."""
    a, b = (np.frombuffer(v, np.uint32).reshape(len(ORDERS), -1) for v in (x, y))
    for one, two in zip(a, b, strict=True):
        at = np.minimum(np.searchsorted(two, one), two.size - 1)
        if not (two[at] == one).any():
            return False
    return True


def _joined(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, make, kind: str) -> DataFrame:
    """The pairs (a, b) with x_a and x_b, made of the texts of the two classes' first members."""
    spark = docs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = spark.sparkContext.broadcast(_bit_map(nodes))
    held = _wanted(docs, width, wanted, make, kind).join(nodes.join(classes, "node"), "node").where("id = rep").select("node", "x").dropDuplicates(["node"])
    side = lambda n: held.select(F.col("node").alias(n), F.col("x").alias(f"x_{n}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "x_a", "x_b")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked: those that meet under all orders, compared exactly."""

    def filtered(batches):
        for batch in batches:
            keep = [meet(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compared(batches):
        for batch in batches:
            both = zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True)
            keep = [len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    prefixes = _joined(pairs, docs, classes, width, lambda s, _: np.concatenate(other_prefixes(s, percent)).tobytes(), "binary")
    pairs = materialise(prefixes.mapInArrow(filtered, "a long, b long"), "met")
    return _joined(pairs, docs, classes, width, lambda _, text: text, "string").mapInArrow(compared, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach. Large-star and small-star rounds until nothing changes.

    Nodes without a link are absent; null ends are ignored; an empty table gives an empty table.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = materialise(small.where("u <> v").distinct(), "stars")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links reach).

    Null or wordless texts have the empty set and link with nothing; a text of fewer words than the width is one
    shingle; rows with a null id are returned with a null component and link with nothing; repeated rows are copies of
    each other; other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(docs.mapInArrow(_profile(width), "id long, n long, node long"), "sets")
    classes = materialise(rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep")), "classes")
    some = docs.where("id is not null")

    known = spark.sparkContext.broadcast(Frequencies(some, width))
    prefixes = some.mapInArrow(_prefixes(width, percent, known), "token long, node long, at long")
    blocks = materialise(prefixes.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1").drop("size"), "blocks")
    known.destroy()  # the driver holds its blocks; those of the table are in files now

    links, tried, label = None, None, None
    for turn in range(STAR_ROUNDS):
        placed = _open_blocks(blocks, label)
        first = F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), F.xxhash64("node", F.lit(turn)), "node", "at", "label")
        pivots = placed.groupBy("token").agg(F.min(first).alias("p")).select("token", *(F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "at", "label")))
        pairs = placed.join(pivots, "token").where("label <> label_b").where(_reachable("at", "at_b", percent)).select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        found = materialise(_verified(pairs, some, classes, width, percent), "links")
        links, tried = (links.union(found), tried.union(pairs)) if turn else (found, pairs)
        label = components(links)

    placed = materialise(_open_blocks(blocks, label), "open")
    other = placed.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "at", "label")))
    rest = placed.join(other, "token").where("node > node_b and label <> label_b").where(_reachable("at", "at_b", percent)).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, some, classes, width, percent)

    # by the classes' first members the least member of a component is its label
    named = lambda n: classes.select(F.col("node").alias(n), F.col("rep").alias(f"rep_{n}"))
    linked = links.union(more).join(named("a"), "a").join(named("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    label = components(linked).withColumnRenamed("node", "rep")
    found = classes.join(label, "rep", "left").select("node", F.coalesce("label", "rep").alias("component_id"))
    return rows.join(found, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _open_blocks(blocks: DataFrame, label: DataFrame | None) -> DataFrame:
    """Rows (token, node, at, label) of the shingles whose block still spans several components."""
    if label is None:
        return blocks.withColumn("label", F.col("node"))
    placed = blocks.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = placed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    return placed.join(several, "token").select("token", "node", "at", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows that links do not reach, and of each group that links reach the row of the smallest id; all columns.

    Every row is a document of its own: rows of one id with texts that do not link all stay, and of rows with one id and
    linking texts one stays, the first that was read. Null ids come after all others. Null and empty texts link with
    nothing and stay. Very long texts are compared whole. Columns of docs may have any names. An empty table gives an
    empty table.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = materialise(docs.select(doc, F.monotonically_increasing_id().alias("row")), "rows")
    ids = rows.select("row", F.col(f"doc.`{id_col}`").alias("id"))
    found = jaccard_components(rows.select("row", F.col(f"doc.`{text_col}`").alias("text")), "row", "text", width, percent)
    first = found.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")
