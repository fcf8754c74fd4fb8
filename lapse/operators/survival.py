"""Survival analysis.

A survival table collapses to one row per distinct duration (durations are
whole days, so the table is bounded by the calendar span, a few thousand
rows).  Risk sets are reverse cumulative sums and S(t) is a running product
over that small table, so the windows below are over provably tiny inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054   # Fixed value: two-sided 95% normal quantile.


def event_table(df: DataFrame, duration: str, event: str, by=()) -> DataFrame:
    """(by..., t, events, removed) per distinct duration."""
    e = F.col(event).cast("bigint")
    return df.groupBy(*by, F.col(duration).cast("bigint").alias("t")).agg(
        F.sum(e).alias("events"), F.count(F.lit(1)).alias("removed"))


def kaplan_meier(df: DataFrame, duration: str, event: str, by=(), ci: bool = False) -> DataFrame:
    """Kaplan-Meier curve: t, at_risk, events, censored, survival (L1, L2, L4).

    A t = 0 row with S = 1 is added when no subject has duration 0.
    With ``ci``: Greenwood variance and the exponential (log-log) 95% band.
    """
    et = event_table(df, duration, event, by)
    w_desc = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w_asc = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    c = et.withColumn("at_risk", F.sum("removed").over(w_desc))
    c = c.withColumn("survival", F.product(F.lit(1.0) - F.col("events") / F.col("at_risk")).over(w_asc))
    c = c.withColumn("censored", F.col("removed") - F.col("events"))
    zero = (et.groupBy(*by).agg(F.sum("removed").alias("at_risk"), F.min("t").alias("_tmin"))
            .filter(F.col("_tmin") > 0)
            .select(*by, F.lit(0).cast("bigint").alias("t"), "at_risk", F.lit(0).cast("bigint").alias("events"),
                    F.lit(0).cast("bigint").alias("censored"), F.lit(1.0).alias("survival"),
                    F.lit(0).cast("bigint").alias("removed")))
    out = c.unionByName(zero)
    if ci:
        g = F.when(F.col("at_risk") > F.col("events"),
                   F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events"))))
        out = out.withColumn("greenwood", F.sum(g).over(w_asc.orderBy("t")))
        lv = F.log(F.col("survival"))
        ok = (F.col("survival") > 0) & (F.col("survival") < 1) & F.col("greenwood").isNotNull()
        se = F.sqrt(F.col("greenwood")) / lv
        out = (out.withColumn("ci_lower", F.when(F.col("survival") == 1, F.lit(1.0))
                              .when(ok, F.exp(-F.exp(F.log(-lv) - Z95 * se))))
                  .withColumn("ci_upper", F.when(F.col("survival") == 1, F.lit(1.0))
                              .when(ok, F.exp(-F.exp(F.log(-lv) + Z95 * se)))))
    return out.drop("removed")


def survival_at(curve: DataFrame, horizons=(30, 90, 180, 365, 730), by=()) -> DataFrame:
    """Median survival (NULL when S never reaches .5) and S at each horizon:
    the curve value of the last t <= horizon (L3)."""
    aggs = [F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_survival")]
    for h in horizons:
        aggs.append(F.max_by(F.col("survival"), F.when(F.col("t") <= h, F.col("t"))).alias(f"s_{h}"))
    return curve.groupBy(*by).agg(*aggs)


def logrank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Two-sample log-rank statistic (L5): observed minus expected events of
    group 1 and the hypergeometric variance, summed over distinct times."""
    g1 = (F.col(group) == 1).cast("bigint")
    e = F.col(event).cast("bigint")
    t = df.groupBy(F.col(duration).cast("bigint").alias("t")).agg(
        F.sum(e).alias("d"), F.count(F.lit(1)).alias("r"),
        F.sum(e * g1).alias("d1"), F.sum(g1).alias("r1"))
    w = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("n", F.sum("r").over(w)).withColumn("n1", F.sum("r1").over(w))
    exp1 = F.col("d") * F.col("n1") / F.col("n")
    var = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n"))
                 * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    s = t.agg(F.sum(F.col("d1") - exp1).alias("o_minus_e"), F.sum(var).alias("variance"),
              F.sum("d1").alias("observed_1"), F.sum(exp1).alias("expected_1"))
    return s.withColumn("chi2", F.col("o_minus_e") * F.col("o_minus_e") / F.col("variance"))


def logrank_pvalue(stat: DataFrame) -> DataFrame:
    """p-value of the 1-dof chi-square on the single statistic row (Spark has
    no erfc; a vectorised pandas UDF evaluates it)."""
    from lapse.functions.udfs import chi2_sf_1dof
    return stat.withColumn("p_value", chi2_sf_1dof(F.col("chi2")))
