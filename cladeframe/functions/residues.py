"""Column functions on residues and n-mers. Alphabet A C G T with the missing symbols N - . ; codes are big-endian."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
GAPS = "-.N"
#: Transitions are A-G and C-T.
TRANSITIONS = frozenset({("A", "G"), ("G", "A"), ("C", "T"), ("T", "C")})


def is_gap(sym: Column) -> Column:
    return sym.isin(*GAPS)


def contains_gap(nmer: Column) -> Column:
    return nmer.rlike("[-.N]")


def complement(nmer: Column) -> Column:
    return F.translate(nmer, "ACGTacgt", "TGCAtgca")


def encode_nmer(nmer: Column) -> Column:
    """Base-4 number of an n-mer of A C G T, first base most significant; null if it holds anything else."""
    return F.when(nmer.rlike("^[ACGT]+$"), F.conv(F.translate(nmer, BASES, "0123"), 4, 10).cast("long"))


def decode_nmer(code: Column, n: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), n, "0"), "0123", BASES)


def hamming(a: Column, b: Column) -> Column:
    """Number of unequal positions; positions past the shorter one count."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def degenerate_match(a: Column, b: Column, length: int | None = None) -> Column:
    """Equal at each position, or either is missing there; the first `length` positions, or all of equally long ones."""
    if length is not None:
        a, b = F.substring(a, 1, length), F.substring(b, 1, length)
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) | is_gap(x) | is_gap(y), F.lit(False)))
    return F.forall(same, lambda x: x)


def trim_context(context: Column) -> Column:
    """What follows the right-most missing symbol."""
    return F.regexp_extract(context, "([ACGT]*)$", 1)


def safe_add(a: Column, b: Column) -> Column:
    """Sum of logs; minus infinity if either is infinite."""
    low = F.lit(float("-inf"))
    return F.when((F.abs(a) == float("inf")) | (F.abs(b) == float("inf")), low).otherwise(a + b)


def log_sum_exp(logs: Column) -> Column:
    """ln of the sum of exponentials of an array, shifted by its maximum; minus infinity for an array of those."""
    top = F.array_max(logs)
    total = F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(top == float("-inf"), top).otherwise(top + F.ln(total))


def to_probability(x: Column) -> Column:
    import math

    return F.atan(x) / math.pi + 0.5


def from_probability(p: Column) -> Column:
    import math

    return F.tan((p - 0.5) * math.pi)


def context_prior(context: Column, eq: dict[str, float]) -> Column:
    """Product of the equilibrium frequencies of the context's symbols; 1 for the empty context."""
    weight = F.create_map(*(F.lit(x) for kv in eq.items() for x in kv))
    return F.aggregate(F.filter(F.split(context, ""), lambda c: c != ""), F.lit(1.0), lambda p, c: p * F.coalesce(weight[c], F.lit(1.0)))


def gamma_density(spark: SparkSession, shape: float, scale: float, step: float = 0.01, stop: float = 1e-4, most: int = 100_000) -> DataFrame:
    """(x, p): the density of the gamma distribution on a grid of `most` steps at most, up to where it falls below `stop`
    past its mode. ln of the gamma function of the shape is the one constant."""
    x = F.col("id") * F.lit(float(step))
    log_p = (shape - 1) * F.ln(x) - x / scale - F.lit(math.lgamma(shape)) - F.lit(shape * math.log(scale))
    grid = spark.range(1, most + 1).select("id", x.alias("x"), F.exp(log_p).alias("p"))
    last = grid.where((F.col("p") < stop) & (F.col("x") > (shape - 1) * scale)).agg(F.coalesce(F.min("id"), F.lit(most + 1)).alias("last"))
    return grid.join(F.broadcast(last), F.col("id") < F.col("last")).select(F.round("x", 9).alias("x"), "p")  # one row
