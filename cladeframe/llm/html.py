"""Main text of web pages: markup drops what names itself as no content, and a suffix array over each host decides the rest.

Markup: scripts, menus, forms and the like, and elements whose class, id or role names them so, never count, unless such a
named element holds most of the page's text and its articles, as a frame around the page does. All other
blocks, inside an article or main element or not, are the page's body. The token streams of a host's pages (bodies, and
blocks that markup set aside) are one text, and words of a body go where they lie in a substring of RUN tokens or more
that occurs in another body of the host too; unique runs stay. Pages of one host with equal bodies are one body, and
edited copies are one group: runs go if they recur across groups, and stay if they recur within one group only.

Bodies are linked as copies where they share half of the smaller one's suffixes, or more, apart from the host's frame:
suffixes that more than half of its bodies, three at least, hold. Each body is compared with the least and the greatest
body of its repeated suffixes, so the work is linear, and groups are what links reach.

The suffix array is distributed and sparse. First each page names the least 4-token string of every window of RUN tokens:
equal windows have equal ones, about a third of all places are named, and 40 to 48 bits of each are compared by ranges in
sorted order; the number of ranges and the size of their bit map follow the number of names. Only suffixes whose window
holds one that a body and another page name can be repeated. These suffixes are sorted by the hash of their host and their
first RUN tokens, not by the letter, and neighbours are compared: an interval of one key with two distinct bodies is a
repeat, and the maximal runs of a body are the unions of its repeated windows. An interval shared by many pages is
streamed, so a menu on a third of all pages needs no memory.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import _STEP, discard, materialise, mix, text_bytes, word_hashes, words
from cladeframe.llm.jaccard import _bit_map, components, in_bit_map

RUN = 8
#: Tokens of the strings that stand for a window when repeats are looked for the first time.
NAME = 4
#: Share of the smaller body's suffixes outside the host's frame that, shared, makes two bodies copies.
COPY = 0.5
#: Names are sent by ranges of their first bits, 8 to 16 of them so that a range holds about PER_RANGE, with LOW bits more.
PER_RANGE, LOW = 1 << 22, 32
#: Names that a task holds before it sends them on.
HELD = 4_000_000
#: Bits of the map of names that may be repeated, about four for each name: 128 KB to 64 MB.
MAP_BITS = (20, 29)

SKIP = frozenset("head title script style noscript template nav header footer aside form button select textarea iframe svg canvas object dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_ITSELF = frozenset("p li dt dd td th tr option".split())
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_UNWANTED = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|side-?bar|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|replies|reply|disqus|social|share|sharing|related|recommend\w*|newsletter|subscribe|sign-?up|popup|modal|widget|pagination|complementary|contentinfo|search)(?:$|[_-])",
    re.I,
)
#: Of these, names that no container of a page's own text has.
_NEVER = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|comments?|replies|reply|disqus|share|sharing|newsletter|subscribe|sign-?up|popup|modal)(?:$|[_-])", re.I)
#: A name that begins so tells of a state or of the page's layout, not of what the element is: has-sidebar, no-header.
_STATE = re.compile(r"(?:has|no|not|with|without|hide|hidden|show|is|body|page|single)[_-]", re.I)
#: Elements that no name drops.
KEPT = frozenset("html body main article".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


@lru_cache(4096)
def _named(attributes: str) -> int:
    """0: no name tells against the element; 1: one does; 2: one that never stands on a container of the text does."""
    tokens = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)).split()
    bad = [t for t in tokens if _UNWANTED.search(t) and not _STATE.match(t)]
    return 0 if not bad else 2 if any(map(_NEVER.search, bad)) else 1


class _Container:
    """An element with an unwanted name: the words in it, and the article and main elements."""

    def __init__(self, parent: _Container | None, never: bool):
        self.parent, self.never, self.words, self.mains, self.dropped = parent, never, 0, 0, True


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of the page's blocks in order; role: open or aside. White space is one space, none around.

    An element that its name tells against is set aside with all that is in it, unless it is the page's own frame: it holds
    every article and main element of the page, and more words than stand outside of named elements, or, on a page
    without such elements, more than half of all words that no tag sets aside. Names on html, body, main and article do
    not count. Time is linear in the page, whatever its tags.
    """
    out: list[tuple[bool, _Container | None, str]] = []
    stack: list[tuple[str, bool, _Container | None]] = []
    opened: Counter[str] = Counter()
    named: list[_Container] = []
    parts: list[str] = []
    skip, mains, inside = 0, 0, None

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append((skip > 0, inside, text))

    def pop() -> str:
        nonlocal skip, inside
        name, hard, before = stack.pop()
        opened[name] -= 1
        skip -= hard
        inside = before
        return name

    at = 0
    while m := _TAG.search(page, at):
        parts.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            end_block()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if opened[name]:
                end_block()
                while pop() != name:
                    pass
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BLOCK and stack and stack[-1][0] in CLOSES_ITSELF and (stack[-1][0] == name or stack[-1][0] == "p"):
            pop()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        hard = name in SKIP
        against = _named(m[3]) if m[3] and not hard and name not in KEPT else 0
        if name in BLOCK or hard or against:
            if hard or against:
                end_block()
            stack.append((name, hard, inside))
            opened[name] += 1
            skip += hard
            if against:
                inside = _Container(inside, against == 2)
                named.append(inside)
            if name in ("article", "main"):
                mains += 1
                if inside:
                    inside.mains += 1
    parts.append(page[at:])
    end_block()

    total = plain = 0
    for hard, container, text in out:
        n = 0 if hard else text.count(" ") + 1
        total += n
        if container:
            container.words += n
        else:
            plain += n
    for c in reversed(named):  # those inside come after those around them
        if c.parent:
            c.parent.words += c.words
            c.parent.mains += c.mains
    for c in named:
        frame = not c.never and c.mains == mains and (c.words > plain if mains else 2 * c.words > total)
        c.dropped = not frame or (c.parent is not None and c.parent.dropped)
    return [("aside" if hard or (c and c.dropped) else "open", text) for hard, c, text in out]


def _strings(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sums that tell the strings of `width` tokens apart, by first token."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * _STEP[k % 5] * np.uint64(2 * (k // 5) + 1)
    return total


def suffixes(texts: pa.Array, hosts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of the host and the first RUN tokens of every suffix that has as many, its text, its token's place there, and
    the key of the host and the least string of NAME tokens among those RUN.

    Tokens are compared without the case of A-Z."""
    data, bounds = text_bytes(texts)
    starts, ends, owner = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    total, names = _strings(hashes, RUN), mix(_strings(hashes, NAME))
    n = len(total)
    least = np.minimum.reduce([names[k : k + n] for k in range(RUN - NAME + 1)])
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(bounds)))[owner]
    whole = np.flatnonzero(owner[:n] == owner[RUN - 1 :])
    seed = mix(hosts.to_numpy(zero_copy_only=False).view(np.uint64))[owner[whole]]
    return mix(total[whole] + seed), owner[whole], place[whole], mix(least[whole] + seed)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(page or "") for page in batch.column(3).to_pylist()]
        text, aside = (pa.array([" ".join(t for role, t in x if role == wanted) for x in found], pa.string()) for wanted in ("open", "aside"))
        keys, owner, *_ = suffixes(text, batch.column(2))
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        size = [len(np.unique(keys[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], text, aside, pa.array(size, pa.int64())], names=["page_id", "url", "host", "text", "aside", "size"])


class Names:
    """How names are cut: the first bits choose a range, LOW more are sent, and the first ones of both are a bit of the map."""

    def __init__(self, expected: int):
        self.ranges = min(16, max(8, (expected // PER_RANGE).bit_length()))
        self.map = min(MAP_BITS[1], max(MAP_BITS[0], expected.bit_length() + 2))
        self.bits = self.ranges + LOW

    def key(self, names: np.ndarray) -> np.ndarray:
        return names >> np.uint64(64 - self.bits)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(self.bits - self.map)


def packed(keys: np.ndarray) -> bytes:
    """Sorted numbers of at most 40 bits: differences, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(5, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :5] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _sorted_ranges(cut: Names):
    """(range, keys): keys of the names of the suffixes' windows, sorted, each with a last bit that says whether a body holds
    it; one that several bodies hold comes twice."""

    def sent(parts):
        keys, times = np.unique(np.concatenate(parts), return_counts=True)
        keys = np.repeat(keys, np.where(keys & np.uint64(1), np.minimum(times, 2), 1))
        cuts = np.searchsorted(keys, np.arange((1 << cut.ranges) + 1, dtype=np.uint64) << np.uint64(LOW + 1))
        low = keys & np.uint64((1 << LOW + 1) - 1)
        rows = [(k, packed(low[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["range", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            pages = [suffixes(batch.column(k), batch.column(0)) for k in (1, 2)]
            owner, names = (np.concatenate([x[k] for x in pages]) for k in (1, 3))
            mine = np.repeat(np.array([1, 0], np.uint64), [len(x[1]) for x in pages])
            owner = batch.column(3).to_numpy()[owner]  # pages of one body count once
            keys = cut.key(names)
            order = np.lexsort((-mine.astype(np.int8), owner, keys))
            keys, owner, mine = keys[order], owner[order], mine[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            held.append((keys << np.uint64(1) | mine)[fresh])
            size += len(held[-1])
            if size > HELD:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    return run


def _neighbours(cut: Names):
    """(range, bits): the range's stretch of the map, with the bits of keys that neighbour an equal one, one of them a body's."""

    def marked(k, parts):
        both = np.sort(np.concatenate([unpacked(x) for x in parts]))
        keys = both >> np.uint64(1)
        again = (keys[1:] == keys[:-1]) & (both[1:] & np.uint64(1)).astype(bool)  # of equal keys those of bodies come last
        width = cut.map - cut.ranges
        bits = np.zeros(1 << width, bool)
        bits[keys[1:][again] >> np.uint64(LOW - width)] = True
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["range", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for k, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at and parts:
                    yield marked(at, parts)
                    parts = []
                at = k
                parts.append(keys)
        if parts:
            yield marked(at, parts)

    return run


def _occurrences(maybe, cut: Names):
    """Suffixes that may be repeated: one row of each for a page, mine if it lies in the page's body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = maybe.value
        for batch in batches:
            out = []
            for k in (1, 2):
                keys, owner, _, name = suffixes(batch.column(k), batch.column(0))
                slot = cut.slot(cut.key(name))
                seen = ((bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
                out.append((keys[seen], owner[seen], np.full(seen.sum(), k == 1)))
            keys, owner, mine = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((~mine, owner, keys))
            keys, owner, mine = keys[order], owner[order], mine[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            key = batch.column(3).to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([pa.array(x[fresh]) for x in (keys.view(np.int64), key, mine)], names=["suffix", "key", "mine"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by suffix and body, the first of each body if a neighbour has the same suffix; one row waits."""
    wait = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if wait is None else [wait, batch])
        if not table.num_rows:
            continue
        suffix, key = table.column(0).to_numpy(), table.column(1).to_numpy()
        fresh = np.r_[True, (suffix[1:] != suffix[:-1]) | (key[1:] != key[:-1])]
        table, suffix = table.filter(pa.array(fresh)).combine_chunks(), suffix[fresh]
        same = suffix[1:] == suffix[:-1]
        good = np.r_[wait is not None and known, same] | np.r_[same, False]
        known = bool(good[-1])
        yield from table.slice(0, len(suffix) - 1).filter(pa.array(good[:-1])).to_batches()
        wait = table.slice(len(suffix) - 1).to_batches()[0]
    if wait is not None and known:
        yield wait


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([zlib.decompress(x).decode() for x in batch.column(2).to_pylist()], pa.string())
        keys, owner, place, _ = suffixes(texts, batch.column(3))
        bad = [np.array(x or (), np.int64).view(np.uint64) for x in batch.column(4).to_pylist()]
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        text = []
        for k, page in enumerate(texts.to_pylist()):
            if not len(bad[k]):
                text.append(page)
                continue
            a, b = cuts[k], cuts[k + 1]
            tokens = page.split()
            gone = {i + j for i in place[a:b][np.isin(keys[a:b], bad[k])].tolist() for j in range(RUN)}
            text.append(" ".join(w for i, w in enumerate(tokens) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def _marked(bits, hit: bool):
    """The pages whose key may be in the bit map, their texts compressed for the way; or all others, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(in_bit_map(bits.value, batch.column(4).to_numpy()) == hit))
            if hit:
                text = pa.array([zlib.compress(x.encode(), 3) for x in some.column(2).to_pylist()], pa.binary())
                some = pa.RecordBatch.from_arrays([*some.columns[:2], text, *some.columns[3:]], names=some.schema.names)
            yield some

    return run


def _groups(repeated: DataFrame, parsed: DataFrame) -> DataFrame:
    """(node, label): the copy group of every body that is linked with another."""
    bodies = parsed.select("key", "host", "size").distinct()
    bodies = materialise(bodies.join(bodies.groupBy("host").agg(F.count("*").alias("bodies")), "host"), "bodies")
    # one exchange by suffix serves the counts, the frames and the rows; all of a suffix's rows came from one task, too
    each = Window.partitionBy("suffix")
    mine = repeated.where("mine").select("suffix", "key")
    held = mine.select("suffix", "key", F.count("*").over(each).alias("held"), F.min("key").over(each).alias("low"), F.max("key").over(each).alias("high")).where("held > 1")
    # whether a suffix is of the frame is told once for it, by the host of one of its bodies
    frames = held.where("held > 2 and key = low").join(bodies.select("key", "bodies"), "key").where("2 * held > bodies").select("suffix", F.lit(True).alias("frame"))
    placed = materialise(held.join(frames, "suffix", "left").select("suffix", "key", "low", "high", F.coalesce("frame", F.lit(False)).alias("frame")), "placed")
    frame = placed.where("frame").groupBy("key").agg(F.count("*").alias("n"))
    own = bodies.join(frame, "key", "left").select("key", (F.col("size") - F.coalesce("n", F.lit(0))).alias("own"))
    # a suffix of two bodies gives its pair once, others one with the least and one with the greatest body
    pairs = placed.where("not frame and key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    pairs = pairs.union(placed.where("not frame and key <> high and key <> low").select(F.col("key").alias("a"), F.col("high").alias("b")))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = pairs.join(own.select(F.col("key").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("key").alias("b"), F.col("own").alias("own_b")), "b")
    found = components(sized.where(F.col("shared") >= COPY * F.least("own_a", "own_b")).select("a", "b"))  # on tables of its own
    discard(placed)
    discard(bodies)
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (main text, empty if none), n_chars.

    A null page has the empty text; a null url belongs to the host without a name; pages of a host with equal bodies count
    as one when repeats are looked for, and each is returned; unclosed tags, comments and scripts reach to the end of the
    page; other columns are not read. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1))
    page = F.col(html_col).cast("string")
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.xxhash64(host).alias("host"), page.alias("html"))
    parsed = rows.mapInArrow(_parse, f"page_id {kind}, url string, host long, text string, aside string, size long")
    parsed = materialise(parsed.withColumn("key", F.xxhash64("host", "text")), "parsed")

    cut = Names(int(parsed.agg(F.sum("size")).first()[0] or 0) // 3)
    ranges = parsed.select("host", "text", "aside", "key").mapInArrow(_sorted_ranges(cut), "range int, keys binary")
    found = np.zeros((1 << cut.ranges, max(1, 1 << cut.map - cut.ranges - 3)), np.uint8)
    for r in ranges.repartition("range").sortWithinPartitions("range").mapInArrow(_neighbours(cut), "range int, bits binary").collect():  # the map
        found[r.range] = np.frombuffer(r.bits, np.uint8)
    maybe = spark.sparkContext.broadcast(found.ravel())
    every = parsed.select("host", "text", "aside", "key").mapInArrow(_occurrences(maybe, cut), "suffix long, key long, mine boolean")
    # pages of one body give equal rows, which stay neighbours
    repeated = every.repartition("suffix").sortWithinPartitions("suffix", "key", F.desc("mine")).mapInArrow(_repeated, "suffix long, key long, mine boolean")
    repeated = materialise(repeated, "repeated")
    label = _groups(repeated, parsed)
    grouped = repeated.join(label, repeated.key == label.node, "left").withColumn("label", F.coalesce("label", "key"))
    across = grouped.groupBy("suffix").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("suffix")
    gone = repeated.where("mine").join(across, "suffix").groupBy("key").agg(F.collect_list("suffix").alias("gone"))  # at most a page's words
    # only the pages that lose something are moved; a bit map of fixed size tells most of the others
    gone = materialise(gone, "gone")
    discard(repeated)
    bits = spark.sparkContext.broadcast(_bit_map(gone.select("key")))
    pages_ = parsed.select("page_id", "url", "text", "host", "key")
    fields = f"page_id {kind}, url string, text %s, host long, key long"
    hit = pages_.mapInArrow(_marked(bits, True), fields % "binary").join(gone, "key", "left")
    left = hit.select("page_id", "url", "text", "host", "gone").mapInArrow(_unique_runs, f"page_id {kind}, url string, text string")
    left = left.union(pages_.mapInArrow(_marked(bits, False), fields % "string").select("page_id", "url", "text"))
    return left.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
