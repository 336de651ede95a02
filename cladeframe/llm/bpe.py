"""Byte-level BPE encoding and decoding with a segment tree over the adjacent pair ranks of each piece.

A leaf of the tree holds rank * leaves + position of one adjacent pair (or a value above all, where nothing merges),
an inner node the smaller of its children; so the root names the leftmost pair of lowest rank. A merge rewrites at most
three leaves and their paths to the root. Short pieces are merged many at a time, one tree per row of a numpy matrix;
long ones one at a time. Each worker keeps the encodings of the pieces it met, up to a fixed number.

The vocabulary file stays where it is; every executor reads it at the same path (a parameter).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import BATCH_ROWS

#: The pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_PIECE = 64
CACHE_PIECES = 400_000
_NONE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class BytePairs:
    """A byte-level vocabulary with its merges, and the pieces encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        letters = byte_letters()
        raw = {letter: bytes([b]) for b, letter in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.bytes_of = {i: b"".join(raw[c] for c in token) for token, i in vocab.items()}
        self.bytes_of.update({i: text.encode() for text, i in self.special.items()})
        self.first = np.array([vocab[x] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(self.bytes_of) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.by_key = {int(k): (rank, vocab[a + b]) for rank, (k, (a, b)) in enumerate(zip(keys, pairs, strict=True))}
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.name = [str(i) for i in range(self.width)]
        self.raw = [self.bytes_of.get(i, b"") for i in range(self.width)]
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.ids: dict[str, list[int]] = {name: [i] for name, i in self.special.items()}

    # -- many short pieces at once -------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_rows(self, rows: list[bytes]) -> list[list[int]]:
        """Token ids of pieces of at most LONG_PIECE bytes, one segment tree per piece."""
        n = len(rows)
        size = np.fromiter(map(len, rows), np.int64, n)
        leaves = 1 << max(1, int(size.max() - 1).bit_length())
        symbol = np.full((n, leaves + 1), -1, np.int64)
        inside = np.arange(leaves + 1) < size[:, None]
        symbol[inside] = self.first[np.frombuffer(b"".join(rows), np.uint8)]
        nxt = np.tile(np.arange(1, leaves + 2), (n, 1))
        prv = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        r, c = np.nonzero(inside[:, 1:])
        rank = self._rank(symbol[r, c], symbol[r, c + 1])
        ok = rank >= 0
        tree[r[ok], leaves + c[ok]] = rank[ok] * leaves + c[ok]
        step = leaves
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            i, rank = root % leaves, root // leaves
            j = nxt[live, i]
            k = nxt[live, j]
            symbol[live, i] = self.merged[rank]
            symbol[live, j] = -1
            nxt[live, i] = k
            prv[live, np.minimum(k, leaves)] = i  # the last column is nobody's left neighbour in a tree
            h = prv[live, i]
            self._set(tree, leaves, live, j, np.full(len(live), _NONE))
            self._set(tree, leaves, live, i, self._leaf(symbol, leaves, live, i, k, size))
            some = h >= 0
            self._set(tree, leaves, live[some], h[some], self._leaf(symbol, leaves, live[some], h[some], i[some], size))
            live = live[tree[live, 1] < _NONE]
        kept = symbol >= 0
        flat, ends = symbol[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _leaf(self, symbol, leaves, row, left, right, size):
        there = right < size[row]
        right = np.where(there, right, 0)
        rank = self._rank(symbol[row, left], symbol[row, right])
        return np.where(there & (rank >= 0), rank * leaves + left, _NONE)

    @staticmethod
    def _set(tree, leaves, row, leaf, value):
        at = leaf + leaves
        tree[row, at] = value
        at = at >> 1
        while leaves > 1:
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            at, leaves = at >> 1, leaves >> 1

    # -- one long piece ------------------------------------------------------------------------------------------

    def merge_long(self, piece: bytes) -> list[int]:
        symbol = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n, width, by_key = len(symbol), self.width, self.by_key
        leaves = 1 << max(1, (n - 1).bit_length())
        none = int(_NONE)
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            if found := by_key.get(symbol[i] * width + symbol[i + 1]):
                tree[leaves + i] = found[0] * leaves + i
        for at in range(leaves - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            at = leaves + i
            tree[at] = value
            at >>= 1
            while at:
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    return
                tree[at] = low
                at >>= 1

        def pair(i: int, j: int) -> int:
            found = by_key.get(symbol[i] * width + symbol[j]) if j < n else None
            return found[0] * leaves + i if found else none

        while (root := tree[1]) < none:
            i = root % leaves
            j = nxt[i]
            k = nxt[j]
            symbol[i] = int(self.merged[root // leaves])
            symbol[j] = -1
            nxt[i] = k
            if k < n:
                prv[k] = i
            put(j, none)
            put(i, pair(i, k))
            if (h := prv[i]) >= 0:
                put(h, pair(h, i))
        return [s for s in symbol if s >= 0]

    # -- texts ---------------------------------------------------------------------------------------------------

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not held yet, and hold them."""
        new = pieces - self.ids.keys()
        if len(self.ids) + len(new) > CACHE_PIECES:
            self.ids = {name: [i] for name, i in self.special.items()}
            new = pieces - self.ids.keys()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode("utf-8")
            by_size.setdefault((len(raw) - 1).bit_length() if len(raw) <= LONG_PIECE else -1, []).append((piece, raw))
        for k, rows in by_size.items():
            raws = [raw for _, raw in rows]
            found = map(self.merge_long, raws) if k < 0 else (x for at in range(0, len(raws), 20_000) for x in self.merge_rows(raws[at : at + 20_000]))
            self.ids.update(zip((piece for piece, _ in rows), found, strict=True))

    def pieces(self, text: str) -> list[str]:
        if self.at_special is None or not self.at_special.search(text):
            return self.split.findall(text)
        return [p for part in self.at_special.split(text) for p in ([part] if part in self.special else self.split.findall(part))]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The token ids of each text."""
        split = [self.pieces(text) for text in texts]
        self.learn(set().union(*split))
        for pieces in split:
            yield list(chain.from_iterable(map(self.ids.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join([self.raw[i] for i in ids if 0 <= i < self.width]).decode("utf-8", "replace")


_held: dict[str, BytePairs] = {}


def vocabulary(path: str) -> BytePairs:
    """The vocabulary of this worker process, read once."""
    if path not in _held:
        _held[path] = BytePairs(path)
    return _held[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens, digests of the empty string. Texts are encoded whole, however long; a null
    or repeated id is carried through; other columns are not read. Special tokens' strings in a text become their ids.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = f"{id_col} long, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            n, ids, coded, decoded = [], [], [], []
            for found in bpe.encode_batch(texts):
                n.append(len(found))
                coded.append(hashlib.sha256(",".join([bpe.name[i] for i in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(found).encode()).hexdigest())
                if with_ids:
                    ids.append(np.array(found, np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))))
            columns += [pa.array(coded), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) of rows (id, ids); a null list decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return tokens.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"{id_col} long, text string")
