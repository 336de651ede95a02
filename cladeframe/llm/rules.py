"""Quality rules with distribution divergence, in DataFrame functions alone.

Per text: word and repetition counts, a histogram of character classes and one of the common words of its language.
Common words are learned: the most frequent words of each language's texts, short ones of lower-case letters, and words of
any length in scripts that have no case. The references are the pooled histograms of those texts of a language that are
long enough and pass the counting rules, so junk has no part in them. The verdict compares a text with its reference by
Jensen-Shannon distance; texts shorter than MIN_WORDS words are too short for a histogram and are judged by the counting
rules alone.

Every value of lang has a list and a reference, however many there are: both are tables, joined by language. A text
without a language, or of one without a list, is held to the language whose common words it uses most, if these make up
LEAST_USE of its words or more; its words meet the lists in a join, and what comes back is joined to its counts by the
text's hash, so no text is moved. If there is none, there is nothing to hold its words to, and the column word_reference,
null then, says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import WORD, materialise

MIN_WORDS = 50
#: Greatest distances (0 to 1) from the language's character classes and common words.
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.29
WINDOW = 8

#: Common words of a language, and the letters that such a word has at most where letters have case.
COMMON_WORDS, SHORT = 12, 4
LEAST_USE = 0.1
#: Rows up to which a table of lists or references is sent to all tasks; larger ones are joined by shuffles.
SENT = 200_000
CLASSES = ("upper", "digit", "white", "point", "sign", "letter")
BINS = COMMON_WORDS + 1
_COMMON = rf"(?<![^\x20\x09-\x0D])(?:\p{{Ll}}{{1,{SHORT}}}|[\p{{Lo}}\p{{M}}]+)(?![^\x20\x09-\x0D])"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _sent(table: DataFrame) -> DataFrame:
    """A table of languages, broadcast if a count of its rows says that it may be."""
    return F.broadcast(table) if table.limit(SENT + 1).count() <= SENT else table


def word_lists(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, listed): the most frequent of the words that can be common ones, by language; ties by code point."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(_COMMON), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("words"))
    return lists.select("lang", F.transform("words", lambda x: x["word"]).alias("listed"))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The lists on the driver, for a look at them; judge() leaves them in a table."""
    return {r.lang: r.listed for r in word_lists(docs, text_col, lang_col).collect()}


def _dropped(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeated(at: str) -> Column:
    """First words, in order, of the windows that occur more than once: equal neighbours in the sorted windows."""
    s = F.col(at)
    k = F.sequence(F.lit(0), F.size(s) - 1)
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(k, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))


def guesses(docs: DataFrame, lists: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(hash, size, guess, used): for each distinct text without a listed language the one whose common words it uses most
    (ties to the greater name), if LEAST_USE of its words or more, and how often it uses each of them."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(_sent(lists.select("lang")), "lang", "left_anti")
    rows = rows.select(*_print("text"), _words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    listed = _sent(lists.select(F.col("lang").alias("guess"), F.posexplode("listed").alias("at", "word")))
    met = rows.select("row", "hash", "size", F.size("w").alias("total"), F.explode("w").alias("word")).join(listed, "word")
    uses = met.groupBy("row", "hash", "size", "total", "guess", "at").agg(F.count("*").alias("n"))
    uses = uses.groupBy("row", "hash", "size", "total", "guess").agg(F.sum("n").alias("uses"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("used"))
    best = uses.groupBy("row", "hash", "size", "total").agg(F.max_by(F.struct("uses", "guess", "used"), F.struct("uses", "guess")).alias("best"))
    best = best.where(F.col("best.uses") >= LEAST_USE * F.col("total"))
    used = F.array(*(F.coalesce(F.col("best.used")[i], F.lit(0)).cast("long") for i in range(COMMON_WORDS)))
    return best.groupBy("hash", "size").agg(F.first(F.struct(F.col("best.guess").alias("guess"), used.alias("used"))).alias("x")).select("hash", "size", "x.*")


def _print(text: str) -> tuple[Column, Column]:
    """What stands for a text: its hash and its size in bytes."""
    return F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size")


def features(docs: DataFrame, lists: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Per row: id, lang (null if it has no list), hash, size, the counts, array chars (by CLASSES) and array common (the
    listed words of the language and the rest).

    A null text has no words. Lines are what \\n separates; a line counts as repeated if it has a word and equals an
    earlier line. n_repeat_words counts the words inside 8-word windows that occur twice or more in the text.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    t, w = F.col("_text"), F.col("_words")
    df = docs.select(F.col(id_col).alias("_id"), lang.alias("_lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_words", _words(t))
    if lists is not None:
        df = df.join(_sent(lists.select(F.col("lang"), F.col("listed").alias("_listed"))), F.col("_lang") == F.col("lang"), "left")
    else:
        df = df.withColumn("lang", F.lit(None).cast("string")).withColumn("_listed", F.lit(None).cast("array<string>"))
    df = df.withColumn("n_words", F.size(w).cast("long")).withColumn("_hash", F.transform(w, lambda x: F.xxhash64(x)))
    # hashes of 2, 4 and 8 words in a row, each from two of half the length
    width = 1
    while width < WINDOW:
        h, width = F.col("_hash" if width == 1 else f"_hash{width}"), width * 2
        n = F.size(h) - width // 2
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, width // 2 + 1, n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"_hash{width}", F.when(F.size("_hash") >= WINDOW, pairs))
    df = df.withColumnRenamed(f"_hash{WINDOW}", "_win")
    win = F.col("_win")
    double = F.coalesce(F.size(F.array_distinct(win)) < F.size(win), F.lit(False))
    df = df.withColumn("_sorted", F.when(double, F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), _repeated("_sorted")))
    s = F.col("_starts")
    steps = F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", lines)
    word_chars = F.length(F.array_join(w, ""))
    df = df.withColumn("_rest", F.regexp_replace(t, r"[a-z\u00DF-\u00F6\u00F8-\u00FF\x20]++", ""))
    rest = F.col("_rest")
    upper, digit, point, sign = _dropped(rest, r"\p{Lu}+"), _dropped(rest, "[0-9]+"), _dropped(rest, r"[.,;:!?'\"()-]+"), _dropped(rest, "[#*$%&|<>]+")
    white = F.length(t) - word_chars
    chars = F.array(*(x.cast("long") for x in (upper, digit, white, point, sign, F.length(t) - upper - digit - white - point - sign)))
    # each listed word in turn: how many of the words that are listed at all it makes up
    df = df.withColumn("_used", F.coalesce(F.filter(w, lambda x: F.array_contains("_listed", x)), F.expr("cast(array() as array<string>)")))
    u = F.col("_used")
    counts = [F.coalesce(F.size(u) - F.size(F.array_remove(u, F.get("_listed", F.lit(i)))), F.lit(0)) for i in range(COMMON_WORDS)]
    return df.select(
        F.col("_id").alias(id_col),
        "lang",
        *_print("_text"),
        "n_words",
        word_chars.cast("long").alias("word_chars"),
        sign.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        chars.alias("chars"),
        F.array(*(F.greatest(x, F.lit(0)).cast("long") for x in counts), F.col("n_words") - F.size(u)).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pooled histograms as shares: (lang, chars_of, common_of) by language, and one row (pooled) of all rows' character
    classes; of the rows that are long enough and pass the counting rules."""
    good = found.where((F.col("n_words") >= MIN_WORDS) & ~base_failed())
    sums = lambda c, n: F.array(*(F.coalesce(F.sum(F.get(F.col(c), F.lit(i))), F.lit(0)) for i in range(n)))

    def shares(c: str, n: int) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) + n
        return F.transform(c, lambda x: (x + 1) / total)

    by = good.where("lang is not null").groupBy("lang").agg(sums("chars", len(CLASSES)).alias("c"), sums("common", BINS).alias("w"))
    every = good.agg(sums("chars", len(CLASSES)).alias("c"))
    return by.select("lang", shares("c", len(CLASSES)).alias("chars_of"), shares("w", BINS).alias("common_of")), every.select(shares("c", len(CLASSES)).alias("pooled"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2 of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _distance(counts: str, reference: Column) -> Column:
    """Distance of a histogram from a reference: 0 without a reference, 1 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    far = F.when(reference.isNull(), F.lit(0.0)).otherwise(js_distance(F.transform(counts, lambda x: x / total), reference))
    return F.when(total > 0, far).otherwise(F.lit(1.0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Per row: id, n_words, the four base counts, base_failed, kept, both distances, and word_reference.

    Nulls and empty texts have counts of 0 and fail; very long texts are read whole; repeated rows are judged alike; a null
    language, or one without a list, is that of the common words found, if any; without a reference (word_reference null)
    the words' distance is 0 and the character classes are held to all texts. Other columns are not read. An empty table
    gives an empty table.
    """
    lists = materialise(word_lists(docs, text_col, lang_col), "lists") if lang_col else None
    given = docs.select(F.col(id_col).alias("_id_"), F.col(text_col).alias("_t_"), *([F.col(lang_col).alias("_l_")] if lang_col else []))
    found = materialise(features(given, lists, "_id_", "_t_", "_l_" if lang_col else None), "rules")
    if lists is not None:
        guess = materialise(guesses(docs, lists, text_col, lang_col), "guesses")
        rest = lambda used: F.col("n_words") - F.aggregate(used, F.lit(0).cast("long"), lambda a, x: a + x)
        mine = F.col("lang").isNull() & F.col("guess").isNotNull()
        common = F.when(mine, F.concat("used", F.array(rest("used")))).otherwise(F.col("common"))
        found = found.join(guess, ["hash", "size"], "left").withColumn("common", common).withColumn("lang", F.coalesce("lang", "guess"))
    by, every = references(found)
    by, every = materialise(by, "references"), materialise(every, "pooled")
    df = found.join(_sent(by), "lang", "left").crossJoin(F.broadcast(every))  # one row
    df = df.withColumn("char_distance", _distance("chars", F.coalesce("chars_of", "pooled"))).withColumn("word_distance", _distance("common", F.col("common_of")))
    far = (F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    return df.select(
        F.col("_id_").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ((F.col("n_words") < MIN_WORDS) | ~far)).alias("kept"), "char_distance", "word_distance", F.when(F.col("common_of").isNotNull(), F.col("lang")).alias("word_reference"),
    )
