"""Cross-sectional statistics per date: z-scores, rank correlations, blends.

Per-date means and deviations are hash aggregates joined back as calendar
tables, never windows over a whole cross-section.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import div
from barloom.operators.ranking import attach, place, position, quantile_bucket, ranked
from barloom.sources.sinks import publish


def zscore(
    df: DataFrame, cols: Sequence[str], by: str | None = "date", *, ddof: int = 1, prefix: str = "z_", fill: bool = True
) -> DataFrame:
    """z per date (or over all rows if ``by`` is None); no spread and (with ``fill``) missing values give 0."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), std(c).alias(f"_s_{c}")]
    keys = [by] if by else []
    joined = attach(df, df.groupBy(*keys).agg(*aggs), keys)
    outs = {}
    for c in cols:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        z = F.when(F.coalesce(s, F.lit(0.0)) == 0, F.when(F.col(c).isNotNull() | F.lit(fill), 0.0)).otherwise(
            div(F.col(c) - m, s)
        )
        outs[prefix + c] = F.coalesce(z, F.lit(0.0)) if fill else z
    return joined.withColumns(outs).drop(*[f"_{k}_{c}" for c in cols for k in ("m", "s")])


def rank_ic(
    df: DataFrame, x: str, y: str, by: Sequence[str] = ("date",), *, min_obs: int = 5, min_distinct: int = 0,
) -> DataFrame:
    """Spearman correlation per group: by, ic, n_obs.

    Null below ``min_obs`` pairs, with no variance, or with fewer than
    ``min_distinct`` different x values.  Rows without a group are left out.
    """
    key = [c for c in ("code",) if c in df.columns] or df.columns
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.xxhash64(*key).alias("_h"))
    # written once and read once: every step below shares one exchange of it
    pairs = publish(pairs, "rank-pairs")
    for c in by:
        pairs = pairs.where(F.col(c).isNotNull())
    placed = place(pairs, by, ["_x", "_y"])
    # one pass counts both rankings: at most (ranges x ranges) cells per group
    cells = placed.groupBy(*by, "_range__x", "_range__y").agg(F.count("_h").alias("_cnt"))
    both = ranked(placed, by, "_x", "_rx", cells)
    both = ranked(both, by, "_y", "_ry", cells)
    ok = (F.count(F.lit(1)) >= min_obs) & (F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry"))
    res = both.groupBy(*by).agg(F.when(ok, F.corr("_rx", "_ry")).alias("ic"), F.count(F.lit(1)).alias("n_obs"))
    if min_distinct:
        few = pairs.groupBy(*by).agg(F.countDistinct("_x").alias("_dx"))
        res = res.join(few, list(by)).withColumn("ic", F.when(F.col("_dx") >= min_distinct, F.col("ic"))).drop("_dx")
    return res


def ic_stats(ics: DataFrame, by: Sequence[str] = (), *, periods: int = 12) -> DataFrame:
    """Mean, std, annualised ICIR, share positive, observations per period."""
    ic = F.col("ic")
    res = ics.where(ic.isNotNull()).groupBy(*by).agg(
        F.count("ic").alias("n_periods"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg(F.when(ic > 0, 1.0).otherwise(0.0)).alias("ic_positive"), F.avg("n_obs").alias("obs_per_period"),
    )
    return res.withColumn("icir", div("ic_mean", "ic_std") * F.sqrt(F.lit(float(periods))))


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "factor", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(cols), name, value)


def orthogonality(df: DataFrame, target: str, refs: Sequence[str], by: str = "date", min_obs: int = 5) -> DataFrame:
    """Per-period Spearman of the target against each reference factor, summarised."""
    long = unpivot(df, ["code", by, target], refs)
    ics = rank_ic(long, target, "value", [by, "factor"], min_obs=min_obs)
    return ics.where(F.col("ic").isNotNull()).groupBy("factor").agg(
        F.avg("ic").alias("rho_mean"), F.avg(F.abs("ic")).alias("rho_mean_abs"),
        F.max(F.abs("ic")).alias("rho_max_abs"), F.count(F.lit(1)).alias("n_periods"),
    )


def redundancy(df: DataFrame, target: str, refs: Sequence[str], *, threshold: float = 0.7, by: str = "date", min_obs: int = 5) -> DataFrame:
    """One row: largest mean |rho| and whether the factor is new; no comparison fails."""
    o = orthogonality(df, target, refs, by, min_obs)
    return o.agg(F.max("rho_mean_abs").alias("worst"), F.count(F.lit(1)).alias("n_compared")).withColumn(
        "passes", F.coalesce(F.col("worst") < threshold, F.lit(False)))


def quantile_returns(df: DataFrame, factor: str, ret: str, by: str = "date", k: int = 5) -> DataFrame:
    """Mean forward return per quantile bucket of the factor and period."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    placed = position(pairs, [by], factor, "code", "_pos", "_total")
    placed = placed.withColumn("bucket", quantile_bucket("_pos", "_total", k))
    return placed.groupBy(by, "bucket").agg(F.avg(ret).alias("mean_ret"), F.count(F.lit(1)).alias("n"))


def spread_bps(buckets: DataFrame, by: str = "date", k: int = 5) -> DataFrame:
    """Top minus bottom bucket per period in basis points."""
    hi = F.max(F.when(F.col("bucket") == k, F.col("mean_ret")))
    lo = F.max(F.when(F.col("bucket") == 1, F.col("mean_ret")))
    return buckets.groupBy(by).agg(((hi - lo) * 1e4).alias("spread_bps"))


def long_short(df: DataFrame, factor: str, ret: str, *, by: str = "date", frac: float = 0.2, min_names: int = 20) -> DataFrame:
    """Mean return of the top fraction minus the bottom fraction by count."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    placed = position(pairs, [by], factor, "code", "_pos", "_total")
    q = F.greatest(F.lit(1), F.floor(F.col("_total") * frac)).cast("bigint")
    top = F.avg(F.when(F.col("_pos") > F.col("_total") - q, F.col(ret)))
    bottom = F.avg(F.when(F.col("_pos") <= q, F.col(ret)))
    return (
        placed.where(F.col("_total") >= min_names).groupBy(by)
        .agg((top - bottom).alias("ls_ret"), F.count(F.lit(1)).alias("n_names"))
    )


def rank_z_combine(df: DataFrame, signs: dict[str, int], by: str = "date", out: str = "composite") -> DataFrame:
    """Average of signed z-scores (population std) of per-period average ranks."""
    ranks = place(df, [by], list(signs))
    for c in signs:
        ranks = ranked(ranks, [by], c, f"_r_{c}")
    z = zscore(ranks, [f"_r_{c}" for c in signs], by, ddof=0, prefix="_z", fill=False)
    parts = [F.col(f"_z_r_{c}") * float(s) for c, s in signs.items()]
    return z.withColumn(out, sum(parts[1:], parts[0]) / float(len(parts))).drop(
        *[f"_r_{c}" for c in signs], *[f"_z_r_{c}" for c in signs])


def blend(df: DataFrame, score: str, overlays: dict[str, float], *, by: str = "date", out: str = "blended", ddof: int = 1) -> DataFrame:
    """z(score) + sum of weight * z(overlay); a missing overlay counts as 0."""
    cols = [score, *overlays]
    z = zscore(df, cols, by, ddof=ddof, prefix="_z_")
    total: Column = F.col(f"_z_{score}")
    for c, lam in overlays.items():
        total = total + float(lam) * F.col(f"_z_{c}")
    return z.withColumn(out, total).drop(*[f"_z_{c}" for c in cols])


def contributions(df: DataFrame, score: str, overlays: dict[str, float], *, by: str = "date") -> DataFrame:
    """Share of each overlay in a blended score, one row per (row, component)."""
    z = zscore(df, [score, *overlays], by)
    parts = [F.struct(F.lit(score).alias("component"), F.col(f"z_{score}").alias("contribution"))]
    parts += [
        F.struct(F.lit(c).alias("component"), (float(lam) * F.col(f"z_{c}")).alias("contribution"))
        for c, lam in overlays.items()
    ]
    return z.select(by, "code", F.explode(F.array(*parts)).alias("_p")).select(by, "code", "_p.component", "_p.contribution")


def monthly_breakdown(ics: DataFrame, date: str = "date", periods: int = 21) -> DataFrame:
    """Daily IC rows summarised per month."""
    ic = F.col("ic")
    return ics.where(ic.isNotNull()).groupBy(F.trunc(date, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg(F.when(ic > 0, 1.0).otherwise(0.0)).alias("ic_positive"),
    ).withColumn("icir", div("ic_mean", "ic_std") * F.sqrt(F.lit(float(periods))))


def walk_forward_split(months: DataFrame, train: int, month: str = "month") -> DataFrame:
    """For every test month T: train = the N months before T-1, valid = T-1, test = T.

    Rows: test_month, month, split.  ``months`` is a calendar table.
    """
    cal = months.select(F.col(month)).distinct()
    w = Window.orderBy(month)  # calendar rows only
    idx = cal.withColumn("i", F.row_number().over(w))
    offsets = F.explode(F.sequence(F.col("i") - F.lit(train + 1), F.col("i")))
    wanted = idx.select(F.col(month).alias("test_month"), F.col("i").alias("t"), offsets.alias("i"))
    split = F.when(F.col("i") == F.col("t"), "test").when(F.col("i") == F.col("t") - 1, "valid").otherwise("train")
    return wanted.where(F.col("t") > train + 1).join(idx, "i").select("test_month", month, split.alias("split"))
