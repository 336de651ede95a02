"""Filters, projections, statistics and windows over alignments.

Tracks are rows (block, track, seq, phase) of ASCII symbols. Where an operator looks across tracks, a block is cut into
stretches of STRETCH columns, one row each, with the symbols left of it as a halo; so a row and a task's memory are
bounded whatever the length of a block, and what runs over a block's end of stretch (sums, runs) is carried by a table with
a row for each stretch. `~` stands for a position past a track's end or a track that the block lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSENT = "~"
_EMPTY = np.frombuffer(b"-.~ ", np.uint8)
#: Columns of a stretch.
STRETCH = 8192


#: Stretches of one Arrow batch of four tracks; of more tracks there are less, so a batch stays at 8 MB.
BATCH_STRETCHES = 256
#: Keys of a table of counts that a task holds as an array (32 MB), and columns that it codes at a time.
DENSE_KEYS, CODED = 1 << 22, 1 << 20


def in_batches(df: DataFrame, run, fields: str, n: int = 4) -> DataFrame:
    """mapInArrow over stretches of n tracks, in batches of bounded size. The session's setting stays, as Spark reads it late."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, BATCH_STRETCHES * 4 // max(n, 4))))
    return df.mapInArrow(run, fields)


def raw_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each string of an Arrow column without nulls, without a copy."""
    if not len(column):
        return
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = np.frombuffer(data, np.uint8) if bounds[-1] else np.zeros(0, np.uint8)
    for begin, end in zip(bounds, bounds[1:]):  # noqa: B905
        yield raw[begin:end]


def coded(alphabet: dict[str, int], other: int) -> np.ndarray:
    """A look-up table from bytes to codes."""
    out = np.full(256, other, np.int64)
    for x, k in alphabet.items():
        out[ord(x)] = k
    return out


#: A C G T are 0 to 3, anything else counts as missing.
BASE_CODES = coded({b: k for k, b in enumerate("ACGT")}, 4)


def stretch_of(col: Column) -> Column:
    return F.floor(col / STRETCH).cast("int")


def pieces(tracks: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """The tracks as rows (..., stretch, seq, halo): seq holds the stretch's symbols and up to `right` after it, halo up to
    `left` symbols before it. Bytes are cut, so a long track is not scanned anew for each piece. An empty track gives none."""
    raw, k = F.col("seq").cast("binary"), F.col("stretch")
    cut = lambda begin, n: F.substring(raw, begin + 1, n).cast("string")
    begin = k * STRETCH
    before = F.least(begin, F.lit(left))
    last = stretch_of(F.octet_length("seq") - 1 + left)  # a track's last symbols are in the halo of the stretch after it, too
    df = tracks.where("seq <> ''").withColumn("stretch", F.explode(F.sequence(F.lit(0), last)))
    return df.withColumn("halo", cut(begin - before, before)).withColumn("seq", cut(begin, F.lit(STRETCH + right)))


def ragged(tracks: DataFrame, n: int, left: int = 0, *more: Column) -> DataFrame:
    """(block, phase, stretch, s0.., h0.., more..): symbols of the n tracks in a stretch and of the `left` columns before it, as
    long as each track is there, '' where it is not; more: further sums over the pieces."""
    seq = lambda k, c: F.coalesce(F.max(F.when(F.col("track") == k, F.col(c))), F.lit("")).alias(f"{c[0]}{k}")
    return pieces(tracks, left).groupBy("block", "phase", "stretch").agg(*(seq(k, "seq") for k in range(n)), *(seq(k, "halo") for k in range(n if left else 0)), *more)


def stretches(tracks: DataFrame, n: int, left: int = 0) -> DataFrame:
    """(block, phase, stretch, len, s0.., h0..): symbols of the n tracks in a stretch, padded with `~`, and of the `left`
    columns before it, as strings of one length; a halo is shorter in a block's first stretch alone."""
    df = ragged(tracks, n, left, F.max(F.length("seq")).cast("int").alias("len")).where("len > 0")
    filled = [F.rpad(f"s{k}", F.col("len"), F.lit(ABSENT)).alias(f"s{k}") for k in range(n)]
    before = F.least(F.col("stretch") * STRETCH, F.lit(left)).cast("int")
    return df.select("block", "phase", "stretch", "len", *filled, *(F.rpad(f"h{k}", before, F.lit(ABSENT)).alias(f"h{k}") for k in range(n if left else 0)))


def blocks(tracks: DataFrame, n: int) -> DataFrame:
    """(block, phase, stretch, len, cols): cols is an array of structs t0..t{n-1} of one symbol for each column of a stretch."""
    df = stretches(tracks, n)
    letters = [F.split(f"s{k}", "").alias(f"t{k}") for k in range(n)]
    return df.select("block", "phase", "stretch", "len", *letters).select("block", "phase", "stretch", "len", F.arrays_zip(*(f"t{k}" for k in range(n))).alias("cols"))


def _placed(df: DataFrame, *names: str) -> DataFrame:
    """A row for each column of a stretch, from arrays of its symbols."""
    col = (F.col("stretch") * STRETCH + F.col("pos")).cast("int").alias("col")
    return df.select("block", "phase", "stretch", F.posexplode(F.arrays_zip(*names)).alias("pos", "c")).select("block", "phase", col, "c.*")


def wide_sites(tracks: DataFrame, n: int) -> DataFrame:
    """(block, phase, col, t0..): one row per alignment column."""
    df = stretches(tracks, n).select("block", "phase", "stretch", *(F.split(f"s{k}", "").alias(f"t{k}") for k in range(n)))
    return _placed(df, *(f"t{k}" for k in range(n)))


def left_sites(tracks: DataFrame, n: int, order: int, of: list[int]) -> DataFrame:
    """wide_sites with, for each track of `of`, the `order` symbols left of the column: t<k>_l1 is the nearest, '' before
    the block's start. The neighbours are shifted copies of a stretch and its halo, so no window and no sort is needed."""
    df = stretches(tracks, n, order).select("*", *(F.split(f"s{k}", "").alias(f"t{k}") for k in range(n)))
    if not order:
        return _placed(df, *(f"t{k}" for k in range(n)))
    whole = lambda t: F.concat(F.array_repeat(F.lit(""), order - F.length(f"h{t}")), F.filter(F.split(f"h{t}", ""), lambda x: x != ""), F.col(f"t{t}"))
    df = df.select("*", *(whole(t).alias(f"_w{t}") for t in of))
    shifted = [F.slice(f"_w{t}", order - k + 1, F.col("len")).alias(f"t{t}_l{k}") for t in of for k in range(1, order + 1)]
    return _placed(df.select("block", "phase", "stretch", *(f"t{k}" for k in range(n)), *shifted), *(f"t{k}" for k in range(n)), *(f"t{t}_l{k}" for t in of for k in range(1, order + 1)))


def carried(totals: DataFrame, value: str, out: str) -> DataFrame:
    """(block, stretch, <out>): of totals (block, stretch, <value>), what the stretches before hold together in their block.
    The window has a row for each stretch, not for each column."""
    w = Window.partitionBy("block").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("block", "stretch", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def is_residue(sym: Column) -> Column:
    return ~sym.isin("-", ".", ABSENT, " ")


def keep_columns(blocked: DataFrame, keep) -> DataFrame:
    """Stretches with the columns for which keep(struct, index) holds, in order."""
    return blocked.withColumn("cols", F.filter("cols", keep))


def by_count(n_tracks: int, least: int):
    """Columns where at least `least` tracks have a residue."""
    return lambda c, i: reduce(add, (is_residue(c[f"t{k}"]).cast("int") for k in range(n_tracks))) >= least


def by_species(required: list[int]):
    """Columns where every required track has a residue."""
    return lambda c, i: reduce(lambda a, b: a & b, (is_residue(c[f"t{k}"]) for k in required))


def without_target_gaps(blocked: DataFrame, target: int = 0) -> DataFrame:
    return keep_columns(blocked, lambda c, i: is_residue(c[f"t{target}"]) & (c[f"t{target}"] != "N"))


def to_tracks(blocked: DataFrame, n: int) -> DataFrame:
    """Rows (block, track, seq) again, the stretches end to end; absent positions are gaps."""
    seqs = F.array(*(F.struct(F.lit(k).alias("track"), F.array_join(F.transform("cols", _symbol(k)), "").alias("seq")) for k in range(n)))
    parts = blocked.select("block", "stretch", F.explode(seqs).alias("t")).groupBy("block", F.col("t.track").cast("int").alias("track")).agg(F.array_sort(F.collect_list(F.struct("stretch", "t.seq"))).alias("parts"))
    return parts.select("block", "track", F.translate(F.array_join("parts.seq", ""), ABSENT, "-").alias("seq"))


def kept_tracks(tracks: DataFrame, n: int, rule) -> DataFrame:
    """(block, track, seq) of the columns for which rule(symbols of the n tracks, as bytes) holds, in order; absent positions
    are gaps. What keep_columns and to_tracks give, with whole stretches in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = np.arange(256, dtype=np.uint8)
        gap[ord(ABSENT)] = ord("-")
        for batch in batches:
            seqs = []
            for symbols in zip(*(raw_bytes(batch.column(2 + k)) for k in range(n)), strict=True):
                keep = rule(symbols)
                seqs.append([gap[x[keep]].tobytes().decode("ascii") for x in symbols])
            columns = [pa.array([s[k] for s in seqs], pa.string()) for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["block", "stretch", *(f"s{k}" for k in range(n))])

    df = stretches(tracks, n).select("block", "stretch", *(f"s{k}" for k in range(n)))
    df = in_batches(df, run, "block long, stretch int, " + ", ".join(f"s{k} string" for k in range(n)), n)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("track"), F.col(f"s{k}").alias("seq")) for k in range(n)))).alias("t")
    parts = df.groupBy("block").agg(*(F.array_sort(F.collect_list(F.struct("stretch", f"s{k}")))[f"s{k}"].alias(f"s{k}") for k in range(n)))
    return parts.select("block", *(F.array_join(f"s{k}", "").alias(f"s{k}") for k in range(n))).select("block", each).select("block", F.col("t.track").alias("track"), "t.seq")


def has_residue(symbols: np.ndarray) -> np.ndarray:
    return ~np.isin(symbols, _EMPTY)


def rule_by_count(least: int):
    """by_count for kept_tracks."""
    return lambda symbols: sum(has_residue(x).astype(np.int64) for x in symbols) >= least


def rule_by_species(required: list[int]):
    """by_species for kept_tracks."""
    return lambda symbols: np.all([has_residue(symbols[k]) for k in required], axis=0)


def rule_target(target: int = 0):
    """without_target_gaps for kept_tracks."""
    return lambda symbols: has_residue(symbols[target]) & (symbols[target] != ord("N"))


def _symbol(k: int):
    return lambda c: c[f"t{k}"]


def codon_trim(tracks: DataFrame) -> DataFrame:
    """Each track from its first whole codon to its last: [ (3 - phase) % 3, len - (phase + len) % 3 )."""
    begin, size = (3 - F.col("phase")) % 3, F.length("seq")
    end = size - (F.col("phase") + size) % 3
    return tracks.withColumn("seq", F.when(end > begin, F.substring("seq", begin + 1, end - begin)).otherwise(""))


def column_range(tracks: DataFrame, begin: int, end: int) -> DataFrame:
    """Columns [begin, end) of each track; with begin 0 this is also the prefix and length cap."""
    return tracks.withColumn("seq", F.substring("seq", begin + 1, end - begin))


def pad(tracks: DataFrame) -> DataFrame:
    """Every track as long as its block's longest, filled with gaps."""
    size = F.max(F.length("seq")).over(Window.partitionBy("block"))
    return tracks.withColumn("len", size.cast("int")).withColumn("seq", F.rpad("seq", F.col("len"), F.lit("-"))).drop("len")


def rename_target(named: DataFrame, name: str, track_col: str = "track", name_col: str = "name") -> DataFrame:
    return named.withColumn(name_col, F.when(F.col(track_col) == 0, F.lit(name)).otherwise(F.col(name_col)))


def first_blocks(tracks: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n first blocks by number, and the rest."""
    chosen = tracks.select("block").distinct().orderBy("block").limit(n)
    return tracks.join(chosen, "block", "left_semi"), tracks.join(chosen, "block", "left_anti")


def sample_blocks(tracks: DataFrame, n: int, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """n blocks of smallest digest of number and seed, and the rest."""
    digest = F.md5(F.concat(F.col("block").cast("string"), F.lit(f":{seed}")).cast("binary"))
    chosen = tracks.select("block").distinct().orderBy(digest, "block").limit(n).select("block")
    return tracks.join(chosen, "block", "left_semi"), tracks.join(chosen, "block", "left_anti")


def concatenated(tracks: DataFrame, n: int) -> DataFrame:
    """(block, start, len): where each block begins when all are laid end to end, without one task for all blocks' columns."""
    size = tracks.groupBy("block").agg(F.max(F.length("seq")).cast("long").alias("len"))
    stretch = size.withColumn("stretch", F.floor(F.col("block") / 4096))
    before = stretch.groupBy("stretch").agg(F.sum("len").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("len").over(Window.partitionBy("stretch").orderBy("block")) - F.col("len")
    return stretch.withColumn("within", within).join(before, "stretch").select("block", (F.col("before") + F.col("within")).cast("long").alias("start"), "len")


# -- statistics -----------------------------------------------------------------------------------------------------


def summary(tracks: DataFrame) -> DataFrame:
    """n_blocks, total length, total area (length x tracks) and the most tracks of a block."""
    per = tracks.groupBy("block").agg(F.max(F.length("seq")).cast("long").alias("len"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_blocks"), F.sum("len").cast("long").alias("total_length"), F.sum(F.col("len") * F.col("n")).cast("long").alias("total_area"), F.max("n").alias("max_tracks"))


def track_stats(tracks: DataFrame, n: int) -> DataFrame:
    """Per track: gaps, GC, matches with the target, and the percentages over the total length of all blocks (null on 0)."""
    total = tracks.groupBy("block").agg(F.max(F.length("seq")).alias("len")).agg(F.sum("len").cast("long").alias("total"))
    sites = site_patterns(tracks, n)
    one = sites.select("t0", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("track"), F.col(f"t{k}").alias("sym")) for k in range(n)))).alias("x")).select("t0", "n", "x.*").where(F.col("sym") != ABSENT)
    base = lambda c: c.isin("A", "C", "G", "T", "N")
    both = base(F.col("t0")) & base(F.col("sym"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    sums = one.groupBy("track").agg(count(F.col("sym").isin("-", ".")).alias("gaps"), count(F.col("sym").isin("G", "C")).alias("gc"), count(both & (F.col("t0") == F.col("sym"))).alias("matches"), count(both).alias("compared"))
    percent = lambda a, b: F.when(b != 0, F.floor(a / b * 100 + 5 / 9).cast("long"))
    solid = F.col("total") - F.col("gaps")
    return sums.crossJoin(F.broadcast(total)).select(F.col("track").cast("int").alias("track"), "gaps", "gc", "matches", "compared", percent(F.col("gc"), solid).alias("gc_pct"), percent(solid, F.col("total")).alias("coverage_pct"), percent(F.col("matches"), F.col("compared")).alias("match_pct"))  # one row


def composition(tracks: DataFrame) -> DataFrame:
    """Counts and frequencies of A C G T over all tracks."""
    sums = [F.sum(F.length("seq") - F.length(F.regexp_replace("seq", b, ""))).alias(b) for b in "ACGT"]
    one = tracks.agg(*sums)
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(b).alias("sym"), F.col(b).cast("long").alias("n")) for b in "ACGT"))).alias("x"), (F.col("A") + F.col("C") + F.col("G") + F.col("T")).alias("total"))
    return rows.select("x.sym", "x.n", F.round(F.col("x.n") / F.col("total"), 9).alias("freq"))


def patterns(sites: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Distinct site patterns with their number n: what makes likelihood and distances cheap."""
    return sites.groupBy(*(by or []), *columns).agg(F.count("*").alias("n"))


def site_patterns(tracks: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """([by,] t0.., n): the distinct site patterns of n tracks with their number, by nothing, by `block`, or by `frame`
    (col % 3). Columns are counted in numpy, a stretch at a time, before any row of theirs is made."""
    fields = ({"block": "block long, ", "frame": "frame int, "}[by] if by else "") + ", ".join(f"t{k} string" for k in range(n)) + ", n long"

    def emitted(rows: np.ndarray, count: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
        letters = rows[:, 1:] if by == "frame" else rows
        first = [pa.array(key)] if by == "block" else [pa.array(rows[:, 0].astype(np.int32))] if by == "frame" else []
        columns = [pa.array(np.ascontiguousarray(letters[:, k]).view("S1").astype(str)) for k in range(n)]
        return pa.RecordBatch.from_arrays([*first, *columns, pa.array(count)], names=[*([by] if by else []), *(f"t{k}" for k in range(n)), "n"])

    def counted(rows: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        each, at = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
        return each.view(np.uint8).reshape(len(each), -1), np.bincount(at, weight, len(each)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # patterns of the task so far; those of blocks go on at once
        for batch in batches:
            for block, stretch, *seqs in zip(*(batch.column(k).to_pylist() for k in range(2)), *(raw_bytes(batch.column(2 + k)) for k in range(n)), strict=True):
                symbols = np.stack(seqs, 1)
                if by == "frame":
                    frame = (np.arange(len(symbols)) + stretch * STRETCH) % 3
                    symbols = np.hstack([frame[:, None].astype(np.uint8), symbols])
                rows, count = counted(symbols)
                if by == "block":
                    yield emitted(rows, count, np.full(len(rows), block))
                    continue
                held = (rows, count) if held is None else counted(np.concatenate([held[0], rows]), np.concatenate([held[1], count]))
                if held[0].size > DENSE_KEYS:
                    yield emitted(*held, None)
                    held = None
        if held is not None:
            yield emitted(*held, None)

    counts = stretches(tracks, n).select("block", "stretch", *(f"s{k}" for k in range(n)))
    counts = in_batches(counts, run, fields, n)
    return counts.groupBy(*counts.columns[:-1]).agg(F.sum("n").alias("n"))


def summed_codes(batches: Iterator[np.ndarray], space: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes below `space` counted over a whole task: in an array where they fit one, else in sorted parts of bounded size."""

    def gathered():
        held, size = [], 0
        for x in batches:
            held.append(x)
            size += len(x)
            if size >= CODED:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    if space <= DENSE_KEYS:
        total = np.zeros(space, np.int64)
        for x in gathered():
            total += np.bincount(x, minlength=space)
        found = np.flatnonzero(total)
        yield found, total[found]
        return
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in gathered():
        each, n = np.unique(x, return_counts=True)
        merged, at = np.unique(np.concatenate([keys, each]), return_inverse=True)
        keys, counts = merged, np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        if len(keys) > DENSE_KEYS // 2:
            yield keys, counts
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield keys, counts


def code_counts(pieces: DataFrame, codes_of, space: int, n: int) -> DataFrame:
    """(code, n): codes_of(batch) gives arrays of codes below `space`, which are counted before any row of theirs is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in summed_codes((x for batch in batches for x in codes_of(batch)), space):
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], names=["code", "n"])

    return in_batches(pieces, run, "code long, n long", n).groupBy("code").agg(F.sum("n").alias("n"))


def decoded(counts: DataFrame, digits: list[tuple[str, list]]) -> DataFrame:
    """The table (code, ..) with the codes' digits as columns, the first one lowest; digits: a column's name and what its digits
    stand for."""
    fields = [*(f"{c} {'string' if isinstance(v[0], str) else 'int'}" for c, v in digits), *(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)]
    place = counts.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, columns = batch.column(place).to_numpy(), []
            for _, values in digits:
                columns.append(pa.array(values, pa.string() if isinstance(values[0], str) else pa.int32()).take(pa.array(code % len(values))))
                code = code // len(values)
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=[*(c for c, _ in digits), *batch.schema.names])

    return counts.mapInArrow(run, ", ".join(fields))


def code_space(digits: list[tuple[str, list]]) -> int:
    """How many codes the digits make."""
    return int(np.prod([len(v) for _, v in digits], dtype=object))


#: What stands for the columns before a block's start, a byte that no string holds.
START = 255


def laid_out(batch: pa.RecordBatch, n: int, order: int, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(bytes of each track, frame, phase) of the rows (phase, stretch, s0.., h0..) of a batch, laid end to end: of a stretch, of
    `width` columns, those that track 0 has, after `order` cells for the columns before it (START before the block's). A track that ends
    earlier is filled with `~`; frame: the column % 3, and 3 in the cells before a stretch."""
    columns = [list(raw_bytes(batch.column(2 + k))) for k in range(n * (2 if order else 1))]
    size = np.array([order + len(x) for x in columns[0]], np.int64)
    ends = np.cumsum(size).tolist()
    cells = [np.full(ends[-1] if ends else 0, ord(ABSENT), np.uint8) for _ in range(n)]
    frame, thirds = np.full(ends[-1] if ends else 0, 3, np.uint8), np.resize(np.arange(3, dtype=np.uint8), width + 3)
    for i, (stretch, end) in enumerate(zip(batch.column(1).to_pylist(), ends, strict=True)):
        long, turn = len(columns[0][i]), stretch * width % 3
        begin = end - long
        frame[begin:end] = thirds[turn : turn + long]
        before = min(stretch * width, order)  # columns of the block before the stretch
        for k, out in enumerate(cells):
            seq = columns[k][i][:long]
            out[begin : begin + len(seq)] = seq
            if order:
                halo = columns[n + k][i]
                out[begin - order : begin - before] = START
                out[begin - before : begin - before + len(halo)] = halo
    return cells, frame, np.repeat(batch.column(0).to_numpy() % 3, size).astype(np.uint8)


class Coding:
    """Numbers of the patterns of columns whose track 0 has a base, as left_patterns has them: digits for col % 3, the block's
    phase if asked for, the tracks, and the `order` columns left of those of `of`."""

    def __init__(self, n: int, order: int, of: list[int], gaps: bool = False, phase: bool = False):
        symbols, left = (["N", "-", "."], ["N", "-", ".", ""]) if gaps else ([*"ACGT-"], [*"ACGT-"])
        self.n, self.order, self.of, self.gaps, self.phase = n, order, of, gaps, phase
        self.table = (coded({b: 0 for b in "ACGTN"} | {"-": 1}, 2) if gaps else BASE_CODES).astype(np.uint8)
        self.table[START] = 3 if gaps else 4
        self.digits = [("frame", [0, 1, 2]), *([("phase", [0, 1, 2])] if phase else []), *((f"t{k}", symbols) for k in range(n)), *((f"t{k}_l{j}", left) for k in of for j in range(1, order + 1))]
        self.space = code_space(self.digits)
        if self.space >= 1 << 62:
            raise ValueError("too many tracks and columns before each for one number")

    def codes(self, cells: list[np.ndarray], frame: np.ndarray, phase: np.ndarray, halo: int) -> np.ndarray:
        """The codes of the kept columns of what laid_out gives with `halo` cells before each stretch."""
        keep, end = (BASE_CODES[cells[0][halo:]] < 4) & (frame[halo:] < 3), len(frame)
        each = [self.table[x] for x in cells]
        places = [frame[halo:], *([phase[halo:]] if self.phase else []), *(x[halo:] for x in each), *(each[k][halo - j : end - j] for k in self.of for j in range(1, self.order + 1))]
        code = np.zeros(max(0, end - halo), np.int32 if 2 * self.space < 1 << 31 else np.int64)
        for x, (_, values) in zip(reversed(places), reversed(self.digits), strict=True):
            code *= len(values)
            code += x
        return code[keep]


def coded_columns(tracks: DataFrame, codings: list[Coding]) -> DataFrame:
    """(code, n): the columns whose track 0 has a base, counted by their codes in each of the codings in one pass; those of a
    coding come after all codes of the ones before it. Counted in numpy: neither rows nor memory grow with the columns."""
    n, order = codings[0].n, max(c.order for c in codings)
    firsts, width = np.cumsum([0, *(c.space for c in codings)], dtype=object).tolist(), STRETCH

    def codes_of(batch):
        laid = laid_out(batch, n, order, width)
        for first, coding in zip(firsts, codings):  # noqa: B905
            yield coding.codes(*laid, order) + first

    df = ragged(tracks, n, order).where("s0 <> ''").select("phase", "stretch", *(f"s{k}" for k in range(n)), *(f"h{k}" for k in range(n if order else 0)))
    return code_counts(df, codes_of, firsts[-1], n)


def left_patterns(tracks: DataFrame, n: int, order: int, of: list[int], gaps: bool = False, phase: bool = False) -> DataFrame:
    """(frame, [phase,] t0.., t<k>_l1.., n): the distinct patterns of the columns whose track 0 has a base, of left_sites, with
    their number, by col % 3. Symbols are A C G T and - (and - before a block's start); with `gaps`, the states N - . of gap
    patterns, and '' before it."""
    coding = Coding(n, order, of, gaps, phase)
    return decoded(coded_columns(tracks, [coding]), coding.digits).drop("code")


def identity_windows(sites: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Matches and compared columns of two tracks by windows of `width` columns of each block."""
    ok = is_residue(F.col(a)) & is_residue(F.col(b))
    return sites.groupBy("block", F.floor(F.col("col") / width).cast("long").alias("win")).agg(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("compared"), F.sum(F.when(ok & (F.col(a) == F.col(b)), 1).otherwise(0)).cast("long").alias("matches"))


def ranked(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a 0/1 row in words of 64, and how many are set before each word."""
    padded = np.zeros(-(-len(hits) // 64) * 64, bool)
    padded[: len(hits)] = hits
    sums = padded.reshape(-1, 64).sum(1)
    return np.packbits(padded, bitorder="little").view("<i8"), (np.cumsum(sums) - sums).astype(np.int16)


def rank_at(bits: str, before: str, place: Column) -> Column:
    """How many bits are set up to a place, itself included."""
    word = F.floor(place / 64).cast("int")
    mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (63 - place % 64).cast("int"))
    return F.get(F.col(before), word).cast("long") + F.bit_count(F.get(F.col(bits), word).bitwiseAND(mask)).cast("long")


def identity_index(tracks: DataFrame, a: int, b: int) -> DataFrame:
    """(block, stretch, len, before_m, before_n, m, m_at, n, n_at): of two tracks, the columns where both have a residue (n) and
    an equal one (m), as words of 64 bits and the counts before each word, and what the stretches before hold. A row for each
    stretch, of two and a half bits for a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for x, y in zip(raw_bytes(batch.column(2)), raw_bytes(batch.column(3)), strict=True):
                both = ~np.isin(x, _EMPTY) & ~np.isin(y, _EMPTY)
                same = both & (x == y)
                found.append((*ranked(same), *ranked(both)))
                sizes.append((len(x), int(same.sum()), int(both.sum())))
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int16() if k % 2 else pa.int64())) for k in range(4)]
            counts = [pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, *lists], names=["block", "stretch", "len", "_m", "_n", "m", "m_at", "n", "n_at"])

    df = stretches(tracks, max(a, b) + 1).select("block", "stretch", f"s{a}", f"s{b}")
    df = in_batches(df, run, "block long, stretch int, len long, _m long, _n long, m array<long>, m_at array<short>, n array<long>, n_at array<short>")
    totals = df.select("block", "stretch", "_m", "_n")
    before = carried(totals, "_m", "before_m").join(carried(totals, "_n", "before_n"), ["block", "stretch"])
    return df.drop("_m", "_n").join(before, ["block", "stretch"])


def interval_identity(tracks: DataFrame, a: int, b: int, intervals: DataFrame) -> DataFrame:
    """The intervals (block, begin, end, ...) with matches, compared and identity (null where nothing is compared) of the
    columns (begin, end] of two tracks: two look-ups in the index, wherever stretches end. Ends past a block's last column
    stand for it, those before its first for nothing. Intervals of blocks that are not there are left out."""
    index = identity_index(tracks, a, b)
    last = index.groupBy("block").agg(F.max(F.col("stretch") * STRETCH + F.col("len") - 1).alias("_last"))
    rows = intervals.join(last, "block").withColumn("_id", F.struct(*intervals.columns))
    at = lambda c: F.least(F.col(c), F.col("_last"))
    ends = rows.select("block", "_id", F.explode(F.array(F.struct(at("begin").alias("p"), F.lit(-1).alias("sign")), F.struct(at("end").alias("p"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("block", "_id", "e.*").withColumn("stretch", stretch_of(F.greatest(F.col("p"), F.lit(0))))
    value = lambda c: F.when(F.col("p") >= 0, F.col(f"before_{c}") + rank_at(c, f"{c}_at", F.col("p") - F.col("stretch") * STRETCH)).otherwise(0)
    found = ends.join(index, ["block", "stretch"]).select("_id", (F.col("sign") * value("m")).alias("m"), (F.col("sign") * value("n")).alias("n"))
    sums = found.groupBy("_id").agg((F.sum("m") / F.count("*") * 2).cast("long").alias("matches"), (F.sum("n") / F.count("*") * 2).cast("long").alias("compared"))
    return sums.select("_id.*", "matches", "compared", F.when(F.col("compared") > 0, F.col("matches") / F.col("compared")).alias("identity"))


def track_accuracy(one: DataFrame, two: DataFrame) -> DataFrame:
    """Share of equal symbols of the tracks of two alignments, (block, track) by (block, track): per mille, rounded."""
    cut = lambda df: pieces(df.select("block", "track", "seq")).drop("halo")
    pairs = cut(one).join(cut(two).withColumnRenamed("seq", "other"), ["block", "track", "stretch"], "left")
    known = two.select("block", "track").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            track, m, n = batch.column(0).to_pylist(), [], []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                x, y = (np.frombuffer(z.as_buffer() if z.is_valid else b"", np.uint8) for z in (x, y))
                least = min(len(x), len(y))
                m.append(int((x[:least] == y[:least]).sum()))
                n.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(track, pa.int32()), pa.array(m, pa.int64()), pa.array(n, pa.int64())], names=["track", "m", "n"])

    kept = pairs.join(known, ["block", "track"], "left_semi").select("track", "seq", "other")
    sums = in_batches(kept, run, "track int, m long, n long").groupBy("track").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    return sums.select("track", F.when(F.col("n") > 0, F.floor(F.col("m") / F.col("n") * 1000 + 5 / 9) / 10).alias("accuracy"))


# -- contexts and n-mers ----------------------------------------------------------------------------------------------


def nmers(tracks: DataFrame, n: int) -> DataFrame:
    """(track, nmer, n): every n-mer of every track; short tails are skipped. Windows are slices of a stretch and the
    symbols after it, zipped, not self-joins."""
    letters = pieces(tracks, right=n - 1).select("track", F.split("seq", "").alias("s")).where(F.size("s") >= n)
    shifted = [F.slice("s", k + 1, F.size("s") - n + 1).alias(f"x{k}") for k in range(n)]
    df = letters.select("track", F.explode(F.arrays_zip(*shifted)).alias("z")).select("track", F.concat(*(F.col(f"z.x{k}") for k in range(n))).alias("nmer"))
    return df.groupBy("track", "nmer").agg(F.count("*").alias("n"))


def with_context(sites: DataFrame, column: str, order: int, out: str = "ctx") -> DataFrame:
    """The `order` symbols left of each column of a block, clipped at its start and trimmed after the right-most gap, from
    the neighbours that left_sites put beside it."""
    parts = [F.col(f"{column}_l{k}") for k in range(order, 0, -1)]
    return sites.withColumn(out, F.regexp_extract(F.concat(F.lit(""), *parts), "([ACGT]*)$", 1))


def attach(nodes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tree nodes (name, kind, ...) and tracks (block, name, seq) by name, find-or-create: every node has a track in every
    block. A leaf's missing track is all gaps, an inner node's a null sequence; tracks that the tree lacks come with kind
    null. Where a name stands for two nodes, both get the track."""
    size = tracks.groupBy("block").agg(F.max(F.length("seq")).cast("int").alias("len"))
    wanted = size.crossJoin(F.broadcast(nodes.select("name", "kind")))  # the nodes of one tree
    found = wanted.join(tracks.select("block", "name", "seq"), ["block", "name"], "full")
    seq = F.when(F.col("seq").isNull() & (F.col("kind") != "INTERNAL"), F.rpad(F.lit("-"), F.col("len"), F.lit("-"))).otherwise(F.col("seq"))
    return found.select("block", "name", "kind", seq.alias("seq"))


def track_numbers(named: DataFrame) -> DataFrame:
    """(name, track): names numbered in the order in which blocks first show them, by (block, position) of named rows
    (block, ix, name). One row per name is sorted, not the table."""
    first = named.groupBy("name").agg(F.min(F.struct("block", "ix")).alias("first"))
    rank = F.row_number().over(Window.orderBy("first", "name")) - 1  # taxa: few
    return first.select("name", rank.cast("int").alias("track"))


def combined(tracks: DataFrame, n: int) -> DataFrame:
    """(track, col, sym) of all blocks laid end to end in one alignment, columns renumbered over all of it; a track that a
    block lacks, and what a shorter one lacks, is gaps."""
    sites = wide_sites(tracks, n).join(concatenated(tracks, n), "block")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("track"), F.translate(F.col(f"t{k}"), ABSENT, "-").alias("sym")) for k in range(n)))).alias("x")
    return sites.select((F.col("start") + F.col("col")).alias("col"), each).select(F.col("x.track").cast("int").alias("track"), "col", "x.sym")


def combined_counts(tracks: DataFrame, n: int, width: int) -> DataFrame:
    """(track, part, sym, n, cols): of the one alignment that combined gives, the symbols by track and by `width` of its columns:
    how many, and the sum of their columns. Counted a stretch at a time."""
    starts = concatenated(tracks, n).select("block", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = np.arange(256)
        gap[ord(ABSENT)] = ord("-")
        for batch in batches:
            out = [[] for _ in range(5)]
            for stretch, start, *seqs in zip(*(batch.column(k).to_pylist() for k in range(2)), *(raw_bytes(batch.column(2 + k)) for k in range(n)), strict=True):
                col = np.arange(len(seqs[0])) + (start + stretch * STRETCH)
                first = int(col[0]) // width
                part, far = (col // width - first) * 256, (col - col[0]).astype(np.float64)
                for k, x in enumerate(seqs):
                    key = part + gap[x]
                    counts, sums = np.bincount(key), np.bincount(key, far).astype(np.int64)
                    found = np.flatnonzero(counts)
                    each = (np.full(len(found), k), first + found // 256, found % 256, counts[found], sums[found] + counts[found] * col[0])
                    for held, v in zip(out, each, strict=True):
                        held.append(v)
            track, part, sym, count, cols = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
            arrays = [pa.array(track.astype(np.int32)), pa.array(part), pa.array(list(map(chr, range(256)))).take(pa.array(sym)), pa.array(count), pa.array(cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=["track", "part", "sym", "n", "cols"])

    df = stretches(tracks, n).join(starts, "block").select("stretch", "start", *(f"s{k}" for k in range(n)))
    return in_batches(df, run, "track int, part long, sym string, n long, cols long", n).groupBy("track", "part", "sym").agg(F.sum("n").alias("n"), F.sum("cols").alias("cols"))
