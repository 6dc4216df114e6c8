"""Two-by-two statistics as column expressions.

``a`` of ``c`` words of the target and ``b`` of ``d`` words of the reference are the
item.  A table without words on a side has no statistics (nulls)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ("ll", "chi2", "log_ratio", "pct_diff", "odds")


def _xlogx_ratio(o: Column, e: Column) -> Column:
    return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)


def compare(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Signed log-likelihood over the item's two cells, chi-square without correction, log
    ratio (an absent item counts a half), %DIFF, and the odds ratio with its 95 % interval."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    fine = (c > 0) & (d > 0)
    ea, eb = c * (a + b) / (c + d), d * (a + b) / (c + d)
    sign = F.when(a / c >= b / d, 1.0).otherwise(-1.0)
    n, with_, without = c + d, a + b, c + d - a - b
    chi = F.when((with_ > 0) & (without > 0), n * (a * (d - b) - b * (c - a)) * (a * (d - b) - b * (c - a)) / (with_ * without * c * d)).otherwise(0.0)
    ra, rb = F.when(a > 0, a).otherwise(0.5) / c, F.when(b > 0, b).otherwise(0.5) / d
    none = (a <= 0) | (b <= 0) | (c - a <= 0) | (d - b <= 0)
    h = F.when(none, 0.5).otherwise(0.0)
    odds = (a + h) * (d - b + h) / ((b + h) * (c - a + h))
    se = F.sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c - a + h) + 1 / (d - b + h))
    out = {
        "ll": sign * F.greatest(F.lit(0.0), 2 * (_xlogx_ratio(a, ea) + _xlogx_ratio(b, eb))),
        "chi2": sign * chi,
        "log_ratio": F.log2(ra / rb),
        "pct_diff": (ra - rb) * 100 / rb,
        "odds": odds,
        "odds_low": F.exp(F.log(odds) - 1.96 * se),
        "odds_high": F.exp(F.log(odds) + 1.96 * se),
    }
    return {k: F.when(fine, v) for k, v in out.items()}


def four_cell_ll(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood over all four cells of a table of counts, negative if a is below expectation."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    ea = (a + b) * (a + c) / n
    total = sum(
        (_xlogx_ratio(o, e) for o, e in ((a, ea), (b, (a + b) * (b + d) / n), (c, (c + d) * (a + c) / n), (d, (c + d) * (b + d) / n))),
        F.lit(0.0),
    )
    return F.when(a >= ea, 1.0).otherwise(-1.0) * F.greatest(F.lit(0.0), 2 * total)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """p of a chi-square value with one degree of freedom."""
    return x.abs().map(lambda v: math.erfc(math.sqrt(v / 2)), na_action="ignore")


def chi2_tail(x: float, df: int) -> float:
    """p of a chi-square value with ``df`` degrees of freedom, by the finite sums for whole numbers of them."""
    if x <= 0 or df <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:  # Poisson probabilities of fewer than df / 2 events
        return min(1.0, sum(math.exp(k * math.log(half) - half - math.lgamma(k + 1)) for k in range(df // 2)))
    more = sum(math.exp((k - 0.5) * math.log(half) - half - math.lgamma(k + 0.5)) for k in range(1, (df - 1) // 2 + 1))
    return min(1.0, math.erfc(math.sqrt(half)) + more)


@F.pandas_udf(T.DoubleType())
def chi2_p_of(x: pd.Series, df: pd.Series) -> pd.Series:
    """p of chi-square values with their degrees of freedom."""
    return pd.Series([chi2_tail(v, int(k)) if v == v and k == k else None for v, k in zip(x, df, strict=True)], dtype=float)


def critical(alpha: float) -> float:
    """The chi-square value with one degree of freedom whose p is alpha."""
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > alpha else (lo, mid)
    return (lo + hi) / 2


def keyness(target: DataFrame, reference: DataFrame, item: str = "item", **options) -> DataFrame:
    """``keyness_of`` two count tables (item, n)."""
    both = target.select(item, F.col("n").alias("a")).join(reference.select(item, F.col("n").alias("b")), item, "full_outer").na.fill(0, ["a", "b"])
    return keyness_of(both, item, **options)


def keyness_of(both: DataFrame, item: str = "item", measure: str = "ll", test: str = "ll", min_freq: int = 3, alpha: float = 0.05, bonferroni: bool = False, direction: str = "target", show_all: bool = False) -> DataFrame:
    """Items of a table (item, a, b) of counts in target and reference, with all measures, p-values and
    whether each is significant, by a threshold that is divided by the number of items tested if
    ``bonferroni`` is asked for.  Candidates occur ``min_freq`` times in the target, or on either
    side if both directions are asked for."""
    if measure not in MEASURES or test not in ("ll", "chi2") or direction not in ("target", "both"):
        raise ValueError("unknown measure, test or direction")
    enough = F.col("a") if direction == "target" else F.greatest("a", "b")
    totals = both.agg(F.sum("a").alias("c"), F.sum("b").alias("d"), F.sum((enough >= min_freq).cast("long")).alias("tested"))  # one row
    rows = both.crossJoin(F.broadcast(totals)).where(enough >= min_freq)
    rows = rows.withColumns(compare(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    rows = rows.withColumns({"p_ll": chi2_p(F.col("ll")), "p_chi2": chi2_p(F.col("chi2"))})
    if bonferroni:
        rows = rows.withColumn("sig", F.col(f"p_{test}") < alpha / F.col("tested"))
    else:
        rows = rows.withColumn("sig", F.abs(F.col(test)) > F.lit(critical(alpha)))
    if direction == "target":
        rows = rows.where("log_ratio > 0")
    if not show_all:
        rows = rows.where("sig")
    return rows.drop("tested")


def across(counts: DataFrame, totals: DataFrame, item: str = "item", part: str = "part") -> DataFrame:
    """Whether an item is spread over parts as the words are: chi-square of item against
    rest with its p, Cramér's V, and for each part the adjusted standardised residual."""
    parts = totals.select(part, F.col("n").cast("double").alias("t"))
    grid = counts.select(item).distinct().crossJoin(F.broadcast(parts))  # parts are few
    cells = grid.join(counts.select(item, part, "n"), [item, part], "left").na.fill(0, ["n"])
    sums = cells.groupBy(item).agg(F.sum("n").cast("double").alias("of_item"), F.sum("t").alias("all"), F.sum(F.when(F.col("t") > 0, 1).otherwise(0)).alias("k"))
    rows = cells.join(sums, item)
    e = F.col("t") * F.col("of_item") / F.col("all")
    rest, erest = F.col("t") - F.col("n"), F.col("t") - e
    chi = F.when(F.col("t") > 0, F.when(e > 0, (F.col("n") - e) * (F.col("n") - e) / e).otherwise(0.0) + F.when(erest > 0, (rest - erest) * (rest - erest) / erest).otherwise(0.0)).otherwise(0.0)
    share, size = F.col("of_item") / F.col("all"), F.col("t") / F.col("all")
    spread = F.sqrt(e * (1 - share) * (1 - size))
    residual = F.when((F.col("t") > 0) & (spread > 0), (F.col("n") - e) / spread)
    rows = rows.withColumn("chi", chi).withColumn("residual", residual)
    whole = rows.groupBy(item).agg(F.sum("chi").alias("chi2"), F.max("k").alias("k"), F.max("all").alias("all"))
    whole = whole.select(item, "chi2", (F.col("k") - 1).alias("df"), F.sqrt(F.col("chi2") / F.col("all")).alias("cramer_v"))
    whole = whole.withColumn("p", chi2_p_of("chi2", "df"))
    return rows.select(item, part, "n", "residual").join(whole, item)
