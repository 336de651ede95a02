"""Context hierarchies as tables: a row for each context, with what is known of it, counted from the columns themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.models import BASES, GAPS, Model


def context_counts(sites: DataFrame, column: str, other: str, order: int) -> DataFrame:
    """(ctx, n, changed) of all contexts of up to `order` bases left of a column where two tracks have a base: those of every
    length come from one pass, by a ROLLUP over the symbols from the nearest on. sites: as left_sites gives them."""
    left = [f"{column}_l{k}" for k in range(1, order + 1)]
    base = lambda c: F.col(c).isin(*BASES)
    used = sites.where(base(column) & base(other))
    known = used.select((F.col(column) != F.col(other)).cast("long").alias("changed"), *(F.col(c).alias(f"x{k}") for k, c in enumerate(left)))
    if not order:
        return known.agg(F.lit("").alias("ctx"), F.count("*").alias("n"), F.sum("changed").alias("changed"))
    names = [f"x{k}" for k in range(order)]
    counts = known.rollup(*names).agg(F.count("*").alias("n"), F.sum("changed").alias("changed"), F.grouping_id(*names).alias("g"))
    full = F.concat(F.lit(""), *(F.coalesce(F.col(x), F.lit("")) for x in reversed(names)))
    size = order - F.length(F.replace(F.bin("g"), F.lit("0"), F.lit("")))
    return counts.select(full.alias("ctx"), size.alias("size"), "n", "changed").where(F.col("ctx").rlike(f"^[{BASES}]*$") & (F.length("ctx") == F.col("size"))).select("ctx", "n", "changed")


def lower(rows: DataFrame, order: int) -> DataFrame:
    """The contexts shorter than `order`."""
    return rows.where(F.length("ctx") < order)


def raised(rows: DataFrame, order: int) -> DataFrame:
    """One order more: every context of `order` symbols, with each base before it, has the values of its suffix."""
    before = F.explode(F.array(*map(F.lit, BASES))).alias("_x")
    rest = [c for c in rows.columns if c != "ctx"]
    longer = rows.where(F.length("ctx") == order).select("*", before).select(F.concat("_x", "ctx").alias("ctx"), *rest)
    return rows.select("ctx", *rest).union(longer)


def averaged(rows: DataFrame, order: int, value: str) -> DataFrame:
    """(ctx, value): contexts of `order` symbols as they are, shorter ones the mean of those with one symbol more before them."""
    level = rows.where(F.length("ctx") == order).select("ctx", value)
    out = level
    for _ in range(order):
        level = level.groupBy(F.expr("substring(ctx, 2)").alias("ctx")).agg(F.avg(value).alias(value))
        out = out.union(level)
    return out


def transitions(times: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(model, t, a, b, p): P(t) of every model at every time of the table (t); a task computes those of its rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                for name, model in models.items():
                    p, states = model.at(t), GAPS if model.kind == "GAP" else BASES
                    rows += [(name, t, a, b, float(p[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)]
            kinds = (pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["model", "t", "a", "b", "p"])

    return times.select(F.col("t").cast("double")).mapInArrow(run, "model string, t double, a string, b string, p double")


def gamma_at(x, shape: float, scale: float):
    """The density of the gamma distribution at a column's values; 0 at and below zero."""
    from math import lgamma

    log_p = (shape - 1) * F.ln(x) - x / scale - F.lit(lgamma(shape)) - F.lit(shape * float(np.log(scale)))
    return F.when(x > 0, F.exp(log_p)).otherwise(F.lit(0.0))
