"""Language identification by rank-order profiles of character n-grams.

A profile is the PROFILE most frequent 1- to 3-grams of a language, in order of falling count (ties: by code point), over
all its training texts. A text's own profile is compared with each language's by the out-of-place distance: the sum over
the text's n-grams of how far their ranks differ, PROFILE for one that the language lacks. The nearest language wins;
ties go to the smallest name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import BATCH_ROWS

PROFILE = 300
#: Distinct n-grams that a counting task holds, of all languages together, before it sends them on.
HELD = 1_000_000
#: Most languages that can be told apart; more distinct values are an error, not a loss.
MAX_LANGUAGES = 2_000
BLANK = 0x20
_BITS = 21
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or BLANK where it is no letter."""
    out = np.full(0x110000, BLANK, np.int64)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: letters lower-cased, every run of other characters one blank, blanks around."""
    code = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate([[BLANK], code, [BLANK]])
    blank = code == BLANK
    code = code[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(code) < 3:
        return np.zeros(0, np.int64)
    two = (code[:-1] << _BITS) | code[1:]
    three = (two[:-1] << _BITS) | code[2:]
    return np.concatenate([code[code != BLANK], two, three])


def profile(text: str) -> np.ndarray:
    """The text's n-grams by falling count, at most PROFILE."""
    names, times = np.unique(grams(text), return_counts=True)
    return names[np.argsort(-times, kind="stable")[:PROFILE]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[int]]]:
    """Each language's profile, from all rows with a text and a language: (lang, n-grams by rank), by name.

    At most PROFILE n-grams per language come to the driver, of MAX_LANGUAGES languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def sent(lang):
            names, times = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names), pa.array(times)], names=["lang", "gram", "n"])

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(grams(text))
            for lang, found in texts.items():
                names, times = np.unique(np.concatenate(found), return_counts=True)
                if lang in held:
                    old, before = held[lang]
                    names, at = np.unique(np.concatenate([old, names]), return_inverse=True)
                    times = np.bincount(at, np.concatenate([before, times])).astype(np.int64)
                size += len(names) - (len(held[lang][0]) if lang in held else 0)
                held[lang] = names, times.astype(np.int64)
                if size > HELD:
                    for other in list(held):
                        yield sent(other)
                    size = 0
        for lang in list(held):
            yield sent(lang)

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
    rows = top.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return sorted((r.lang, [g.gram for g in r.grams]) for r in rows)


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows' id, every other column asked for, lang_pred and score (share of the mean distance that the nearest saves)."""
    names = [lang for lang, _ in profiles]
    known = np.unique(np.array([g for _, p in profiles for g in p], np.int64))
    ranks = np.full((len(names), len(known)), -1, np.int64)
    for k, (_, p) in enumerate(profiles):
        ranks[k, np.searchsorted(known, p)] = np.arange(len(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column("_text").to_pylist():
                mine = profile(text) if text else ()
                if not len(mine) or not names:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                theirs = np.where(known[at] == mine, ranks[:, at], -1)
                apart = np.where(theirs >= 0, np.abs(theirs - np.arange(len(mine))), PROFILE).sum(1)
                best = int(np.argmin(apart))
                lang.append(names[best])
                score.append(1.0 - float(apart[best]) / (PROFILE * len(mine)))
            rest = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "_text"]
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    given = docs.select(*(c for c in docs.columns if c != text_col), F.col(text_col).cast("string").alias("_text"))
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score.

    `und` with score 0 for a null text, a text without a letter, and every text if no training row has a language.
    Texts are read whole; repeated rows are judged alike; other columns are not read. An empty table gives an empty one.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    profiles = learn(docs.where(training), text_col, lang_col)
    rows = docs.select(F.col(id_col), F.coalesce(~training, F.lit(True)).alias("held_out"), F.col(text_col))
    return predict(rows, profiles, id_col, text_col)
