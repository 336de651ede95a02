"""Personal data by expressions, checksums and context, in DataFrame functions alone.

A regular expression proposes spans; a checksum or shape test confirms or drops them (Luhn for cards, mod 97 for IBANs,
parts up to 255 for addresses, digit counts for phones); words just before a span raise its score; spans of score
ACCEPT or more are kept. The four base kinds start at or above that mark, so context never takes them away; the added
kinds other than IBANs need a context word.

Positions come from the text itself: every match is wrapped in two marker characters, the text is split at them, and
the lengths of the parts are summed up. Positions are code points, ends exclusive. Sums run within stretches of parts and
then over the stretches, and context is looked for in the parts next to a match, so a text of very many matches costs
in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marker characters are Unicode noncharacters; where a text holds them they count as U+FFFD.
OPEN, CLOSE, FIRST_MARK, MARKS = "\ufdd0", "\ufdd1", 0xFDD2, 7
NONCHARACTERS = "".join(chr(0xFDD0 + k) for k in range(2 + MARKS))
#: Parts whose lengths are summed up in one go.
STRETCH = 256
ACCEPT = 0.5
CONTEXT_CHARS = 32
BASE_KINDS = ("email", "ip", "card", "phone")

#: kind -> pattern. Runs are possessive and begin where a run begins, so that a failing run is tried once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,128}+(?![A-Za-z0-9_/+-])",
}
#: kind -> what a match must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
#: kind -> score of a confirmed span without context, words that count as context, and what they add.
SCORES = {
    "email": (0.9, "mail|contact|e-mail", 0.1),
    "ip": (0.6, r"\bip\b|host|server|address", 0.3),
    "card": (0.8, "card|visa|karte|carte|tarjeta|credit", 0.2),
    "phone": (0.7, r"\btel|phone|call|fax|mobil", 0.2),
    "iban": (0.9, "iban|konto|account|compte|cuenta|bank", 0.1),
    "local_phone": (0.2, r"\btel|phone|call|fax|mobil", 0.5),
    "secret": (0.2, r"token|secret|passw|api.?key|access.?key|credential", 0.5),
}


def _clean(text: Column) -> Column:
    return F.when(text.rlike(f"[{NONCHARACTERS}]"), F.translate(text, NONCHARACTERS, "\ufffd" * len(NONCHARACTERS))).otherwise(text)


def _parts(text: Column, kind: str) -> Column:
    """What precedes the first match, then each match, CLOSE and what follows it up to the next one."""
    there = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(PATTERNS[kind])
    return F.when(there, F.split(F.regexp_replace(text, PATTERNS[kind], f"{OPEN}$0{CLOSE}"), OPEN, -1)).otherwise(F.array(F.lit("")))


def _starts(parts: Column) -> Column:
    """Where each part begins in the text."""
    sizes = F.transform(parts, lambda p, i: F.length(p).cast("long") - (i > 0).cast("long"))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STRETCH).cast("int")), lambda k: F.slice(sizes, k * STRETCH + 1, F.lit(STRETCH)))
    none = lambda kind: F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
    within = F.transform(stretches, lambda s: F.aggregate(s, none("bigint"), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))))
    shifted = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda v: v + a["at"]))).alias("out"))
    return F.flatten(F.aggregate(within, none("array<bigint>"), shifted, lambda a: a["out"]))


def _value(part: Column) -> Column:
    return F.substring_index(part, CLOSE, 1)


def _score(parts: Column, i: Column, kind: str) -> Column:
    """Score of the match in part i: context words in the characters before it, of the two parts before at most."""
    score, context, more = SCORES[kind]
    near = F.concat(F.coalesce(F.get(parts, i - 2), F.lit("")), F.get(parts, i - 1))
    before = F.lower(F.right(F.translate(near, CLOSE, ""), F.lit(CONTEXT_CHARS)))
    return F.lit(score) + F.when(before.rlike(context), F.lit(more)).otherwise(F.lit(0.0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn check."""
    back = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(parts: Column, starts: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of the accepted matches, in order."""

    def span(part: Column, i: Column) -> Column:
        value, start = _value(part), F.get(starts, i + 1)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), _score(parts, i + 1, kind).alias("score"), _confirmed(kind, value).alias("ok"))

    found = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), span), lambda s: s["ok"] & (s["score"] >= ACCEPT))
    return F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "score"))))


def _unused(docs: DataFrame, stem: str) -> str:
    """A prefix that no column of docs begins with."""
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    return stem


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with one array column more per kind: spans_<kind> of (kind, start, end, score).

    A null text has no spans, nor has an empty one; texts are read whole, and time grows with their length however many
    matches they hold; repeated rows are judged alike. A column of the input named like an added one is replaced, all
    others are carried through. An empty table gives an empty table.
    """
    added = {f"spans_{k}": k for k in SCORES}
    kept = [c for c in docs.columns if c.lower() not in added]
    p = _unused(docs, "_pii")
    df = docs.withColumn(p, _clean(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).select(*(f"`{c}`" for c in kept), p)
    df = df.withColumns({f"{p}parts_{k}": _parts(F.col(p), k) for k in SCORES})
    df = df.withColumns({f"{p}starts_{k}": _starts(F.col(f"{p}parts_{k}")) for k in SCORES})
    return df.select(*(f"`{c}`" for c in kept), *(_spans(F.col(f"{p}parts_{k}"), F.col(f"{p}starts_{k}"), k).alias(name) for name, k in added.items()))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, all spans, number of spans the method added.

    Null and empty texts as in find_pii: counts 0, the digest of the empty string, spans empty.
    """
    found = find_pii(docs.select(id_col, text_col), text_col)
    every = [F.col(f"spans_{k}") for k in SCORES]
    base = [F.col(f"spans_{k}") for k in BASE_KINDS]
    return found.select(
        id_col,
        *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.concat(*base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(*every)).alias("spans"),
        sum((F.size(f"spans_{k}") for k in SCORES if k not in BASE_KINDS), F.lit(0)).cast("long").alias("n_added"),
    )


#: Kinds in the order of their redaction. The last ones again: a number can come free once the one next to it is gone.
REDACTED = ("email", "iban", "card", "phone", "ip", "secret", "local_phone", "ip", "card", "phone")


def _cut(parts: Column, kind: str, mark: str):
    def cut(part: Column, i: Column) -> Column:
        value = _value(part)
        good = _confirmed(kind, value) & (_score(parts, i, kind) >= ACCEPT)
        return F.when(i == 0, part).otherwise(F.concat(F.when(good, F.lit(mark)).otherwise(value), F.substring(part, F.length(value) + 2, F.length(part))))

    return cut


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every personal span of the text replaced by its kind in brackets.

    Kinds are replaced one after the other, each in what the ones before left, so that no base span remains. Null texts
    stay null; a text without spans is unchanged, but for noncharacters of the marker range, which become U+FFFD; very long
    texts take time in proportion; repeated rows are redacted alike; all other columns, whatever their names, are carried
    through. An empty table gives an empty table.
    """
    p = _unused(docs, "_pii")
    mark = {k: chr(FIRST_MARK + n) for n, k in enumerate(SCORES)}
    df = docs.withColumn(p, _clean(F.col(f"`{text_col}`").cast("string")))
    for n, kind in enumerate(REDACTED):
        parts, text = F.col(f"{p}parts{n}"), F.col(p)
        again = text.rlike(f"[{''.join(mark.values())}]") if kind in REDACTED[:n] else F.lit(True)
        df = df.withColumn(f"{p}parts{n}", F.when(again, _parts(text, kind)).otherwise(F.array(F.lit(""))))

        df = df.withColumn(p, F.when(F.size(parts) > 1, F.array_join(F.transform(parts, _cut(parts, kind, mark[kind])), "")).otherwise(text)).drop(f"{p}parts{n}")
    named = F.col(p)
    for kind in SCORES:
        named = F.replace(named, F.lit(mark[kind]), F.lit(f"[{kind.upper()}]"))
    return df.withColumn(p, F.when(F.col(p).rlike(f"[{''.join(mark.values())}]"), named).otherwise(F.col(p))).select(*(F.col(p).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
