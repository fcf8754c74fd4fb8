"""Point-in-time per-user features.

Two fused passes replace the reference's eight CTEs: one join of the
transaction table to the per-user refs with every transaction-side aggregate
in a single ``groupBy``, and one join of the log table with every log-side
aggregate (trailing window, recent/prior split, unbounded last login) in a
single ``groupBy``.  Both outputs are hash-partitioned on ``msno``, as are the
refs, so the final left joins add no exchange; only the member table is
shuffled (or broadcast by AQE when it turns out small).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.functions.dates import try_ymd
from lapse.functions.exprs import (clip_secs, discount_ratio, ratio_plus_one, song_completion,
                                   trend)
from lapse.operators.population import paid
from lapse.params import Params
from lapse.session import materialize

# Snapshot columns of the latest transaction.
LATEST_COLS = ("payment_method_id", "payment_plan_days", "actual_amount_paid",
               "is_auto_renew", "is_cancel")


def latest_per(df: DataFrame, key, order_cols, value_cols, where=None) -> DataFrame:
    """Latest row per key (F1): the maximum of (order, values) structs, no window,
    partial aggregation before the shuffle.  ``order_cols`` must end with a
    unique tie-break column (any orderable type) so the choice is deterministic."""
    key = [key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                   F.struct(*[F.col(c) for c in value_cols]).alias("_row"))
    latest = F.max(row if where is None else F.when(where, row)).alias("_latest")
    return (df.groupBy(*key).agg(latest).filter(F.col("_latest").isNotNull())
            .select(*key, "_latest._row.*"))


def as_of(events: DataFrame, refs: DataFrame, date_col: str, key: str = "msno") -> DataFrame:
    """Point-in-time join (C2): rows dated on/before the key's own ref_date."""
    return events.join(refs.select(key, "ref_date"), key).filter(F.col(date_col) <= F.col("ref_date"))


def txn_features(txn: DataFrame, refs: DataFrame, p: Params, features_paid_only: bool = False) -> DataFrame:
    """Every transaction-side aggregate in one pass."""
    t = txn.select("msno", "txn_id", "txn_dt", *LATEST_COLS, "plan_list_price")
    method = F.col("payment_method_id").cast("int")
    t = t.withColumn("_method", F.when(method.isNull() | method.between(-128, 127), method).otherwise(
        F.raise_error(F.lit("payment_method_id is no one-byte id")).cast("int")))
    j = t.join(refs.select("msno", "ref_date"), "msno")
    ref = F.col("ref_date")
    pre = F.col("txn_dt") <= ref
    if features_paid_only:
        pre = pre & (F.col("actual_amount_paid") > 0)
    renew = (F.col("txn_dt") > ref) & (F.col("txn_dt") <= F.date_add(ref, p.grace_days))
    if p.renewal_requires_paid:
        renew = renew & (F.col("actual_amount_paid") > 0)
    fwd = (F.col("txn_dt") > ref) & (F.col("txn_dt") <= F.date_add(ref, p.fwd_window_days))

    def pre_avg(c):
        return F.avg(F.when(pre, F.col(c).cast("double")))

    latest = F.struct("txn_dt", "txn_id", *LATEST_COLS)
    return (j.groupBy("msno").agg(
        F.count(F.when(pre, F.lit(1))).cast("bigint").alias("num_transactions"),
        pre_avg("payment_plan_days").alias("avg_payment_plan_days"),
        pre_avg("actual_amount_paid").alias("avg_actual_amount_paid"),
        pre_avg("is_auto_renew").alias("is_auto_renew_rate"),
        pre_avg("is_cancel").alias("is_cancel_rate"),
        F.avg(F.when(pre, discount_ratio("plan_list_price", "actual_amount_paid"))).alias("avg_discount_rate"),
        # methods are one-byte ids: four words of bits count the distinct ones without a set
        *[F.bit_or(F.when(pre & (F.expr("(_method + 128) div 64") == w), F.expr("shiftleft(1L, (_method + 128) % 64)"))).alias(f"_m{w}")
          for w in range(4)],
        F.max(F.when(pre, latest)).alias("_l"),
        F.max(F.when(pre & (F.col("is_cancel") == 1), F.col("txn_dt"))).alias("last_cancel_dt"),
        F.max(F.when(renew, F.lit(1))).alias("_renewed"),
        F.sum(F.when(fwd, F.col("actual_amount_paid"))).alias("fwd_rev"),
    ).select(
        "msno", "num_transactions", "avg_payment_plan_days", "avg_actual_amount_paid",
        "is_auto_renew_rate", "is_cancel_rate", "avg_discount_rate",
        sum(F.coalesce(F.bit_count(f"_m{w}"), F.lit(0)) for w in range(4)).cast("bigint").alias("num_distinct_payment_methods"),
        F.col("_l.payment_method_id").alias("payment_method_id"),
        F.col("_l.payment_plan_days").alias("most_recent_payment_plan_days"),
        F.col("_l.actual_amount_paid").alias("most_recent_actual_amount_paid"),
        F.col("_l.is_auto_renew").alias("most_recent_is_auto_renew"),
        F.col("_l.is_cancel").alias("most_recent_is_cancel"),
        "last_cancel_dt",
        (F.lit(1) - F.coalesce(F.col("_renewed"), F.lit(0))).cast("int").alias("is_churn"),
        "fwd_rev",
    ))


LOG_SUMS = ("num_25", "num_50", "num_75", "num_985", "num_100")


def ref_window_bounds(refs: DataFrame, lookback_days: int | None):
    """Literal [min(ref) - (lookback - 1), max(ref)] from one small aggregate over
    the refs (two dates reach the driver).  ``lookback_days=None``: no lower bound."""
    r = refs.agg(F.min("ref_date").alias("lo"), F.max("ref_date").alias("hi")).first()
    if r is None or r["hi"] is None:
        return None, None
    lo = None if lookback_days is None else r["lo"] - dt.timedelta(days=lookback_days - 1)
    return lo, r["hi"]


def prune_to_refs(logs: DataFrame, refs: DataFrame, lookback_days: int | None, date_col: str = "log_dt",
                  int_col: str = "date", month_col: str = "month"):
    """Drop log rows no user's window can reach, before the join: the join's
    range condition is per user and cannot reach the scan, a literal range on
    the date column can (Parquet statistics, partition folders).

    A parsed date does not reach the scan, so where the log still has its raw YYYYMMDD column ``int_col`` or its
    folder column ``month_col`` (YYYYMM), the same range is asked of those too."""
    lo, hi = ref_window_bounds(refs, lookback_days)
    if hi is None:
        return logs
    cond = F.col(date_col) <= F.lit(hi)
    if lo is not None:
        cond = cond & (F.col(date_col) >= F.lit(lo))
    for c, digits in ((int_col, "%Y%m%d"), (month_col, "%Y%m")):
        if c in logs.columns and isinstance(logs.schema[c].dataType, (T.IntegerType, T.LongType)):
            cond = cond & (F.col(c) <= int(hi.strftime(digits)))
            if lo is not None:
                cond = cond & (F.col(c) >= int(lo.strftime(digits)))
    return logs.filter(cond)


def log_features(logs: DataFrame, refs: DataFrame, p: Params, with_candidates: bool = False,
                 unique_days: bool = False, prune: bool = True, unbounded_lookback: bool = True) -> DataFrame:
    """Every log-side aggregate in one pass over the log table.

    Rows are joined on the key with ``log_dt <= ref_date``; the trailing
    window [ref - (win-1), ref], its recent part [ref - (recent-1), ref] and the
    prior rest are conditional aggregates of the same scan, and last login uses
    the unbounded look-back of the same rows.

    Active days are distinct days.  Rows of one (user, day) are first summed to one
    row per day (clipped seconds and all), so that the same pass counts days;
    ``unique_days`` skips that step for a log that is known to have one row per (user, day).
    ``std_dev_daily_secs`` is over log rows, so the step keeps sums of squares.
    """
    if prune:
        # with last login (unbounded look-back) only the upper bound is safe;
        # window-only callers also get the lower bound (last_login_dt is then
        # limited to the window and should not be used)
        logs = prune_to_refs(logs, refs, None if unbounded_lookback else p.engagement_days)
    lg = logs.select("msno", "log_dt", *LOG_SUMS, "num_unq", "total_secs")
    j = lg.join(refs.select("msno", "ref_date"), "msno").filter(F.col("log_dt") <= F.col("ref_date"))
    ref = F.col("ref_date")
    in_win = F.col("log_dt") >= F.date_sub(ref, p.engagement_days - 1)
    recent = F.col("log_dt") >= F.date_sub(ref, p.recent_days - 1)
    secs = clip_secs("total_secs")
    j = j.select("msno", "log_dt", "ref_date", *LOG_SUMS, "num_unq", secs.alias("_s"), (secs * secs).alias("_s2"),
                 secs.isNotNull().cast("bigint").alias("_sn"))
    if not unique_days:
        j = j.groupBy("msno", "log_dt", "ref_date").agg(
            *[F.sum(c).alias(c) for c in (*LOG_SUMS, "num_unq", "_s", "_s2", "_sn")])
    aggs = [
        F.max("log_dt").alias("last_login_dt"),
        F.count(F.when(in_win, F.lit(1))).cast("bigint").alias("daily_active_days"),
        F.count(F.when(in_win & recent, F.lit(1))).cast("bigint").alias("recent_daily_active_days"),
        F.sum(F.when(in_win, F.col("_s"))).alias("total_secs_sum"),
        *[F.sum(F.when(in_win, F.col(c))).cast("bigint").alias(c.replace("num_", "sum")) for c in LOG_SUMS],
        F.sum(F.when(in_win, F.col("num_unq"))).cast("bigint").alias("sum_unq"),
        F.sum(F.when(in_win & recent, F.col("_s"))).alias("recent_secs"),
        F.sum(F.when(in_win & ~recent, F.col("_s"))).alias("prior_secs"),
        F.sum(F.when(in_win & recent, F.col("num_unq"))).cast("bigint").alias("recent_numunq"),
        F.sum(F.when(in_win & ~recent, F.col("num_unq"))).cast("bigint").alias("prior_numunq"),
    ]
    if with_candidates:
        if unique_days:
            aggs.append(F.stddev_samp(F.when(in_win, F.col("_s"))).alias("std_dev_daily_secs"))
        else:
            n, s, s2 = (F.sum(F.when(in_win, F.col(c))) for c in ("_sn", "_s", "_s2"))
            aggs.append(F.when(n > 1, F.sqrt(F.greatest((s2 - s * s / n) / (n - 1), F.lit(0.0)))).alias("std_dev_daily_secs"))
    return j.groupBy("msno").agg(*aggs)


# Columns that are 0 where a user has no rows, and the column order of the feature table.
ZERO_FILLED = ("num_transactions", "is_auto_renew_rate", "is_cancel_rate", "avg_discount_rate",
               "num_distinct_payment_methods", "most_recent_is_auto_renew", "most_recent_is_cancel",
               "daily_active_days", "recent_daily_active_days", "total_secs_sum", "sum25", "sum50",
               "sum75", "sum985", "sum100", "sum_unq", "recent_secs", "prior_secs",
               "recent_numunq", "prior_numunq", "fwd_rev")

FEATURE_COLUMNS = (
    "msno", "ref_date", "is_churn", "city", "bd", "gender", "registered_via",
    "registration_init_time", "fwd_rev", "num_transactions", "avg_payment_plan_days",
    "avg_actual_amount_paid", "is_auto_renew_rate", "is_cancel_rate", "avg_discount_rate",
    "num_distinct_payment_methods", "payment_method_id", "most_recent_payment_plan_days",
    "most_recent_actual_amount_paid", "most_recent_is_auto_renew", "most_recent_is_cancel",
    "days_since_last_login", "days_since_last_cancel", "daily_active_days",
    "recent_daily_active_days", "total_secs_sum", "sum25", "sum50", "sum75", "sum985", "sum100",
    "sum_unq", "recent_secs", "prior_secs", "recent_numunq", "prior_numunq",
)


def feature_table(txn: DataFrame, logs: DataFrame, members: DataFrame, refs: DataFrame,
                  p: Params, features_paid_only: bool = False, with_candidates: bool = False) -> DataFrame:
    """Per-user feature assembly (C1): refs left-joined to the fused pieces."""
    tf = txn_features(txn, refs, p, features_paid_only)
    lf = log_features(logs, refs, p, with_candidates)
    m = members.select("msno", "city", "bd", "gender", "registered_via", "registration_init_time")
    out = (refs.select("msno", "ref_date")
           .join(tf, "msno", "left")
           .join(lf, "msno", "left")
           .join(m, "msno", "left"))
    out = out.withColumn("days_since_last_login", F.datediff("ref_date", "last_login_dt")) \
             .withColumn("days_since_last_cancel", F.datediff("ref_date", "last_cancel_dt"))
    for c in ZERO_FILLED:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    out = out.withColumn("is_churn", F.coalesce(F.col("is_churn"), F.lit(1)))
    extra = ["std_dev_daily_secs", "last_login_dt", "last_cancel_dt"] if with_candidates else []
    return out.select(*FEATURE_COLUMNS, *extra)


def derive_features(df: DataFrame, p: Params) -> DataFrame:
    """Per-row derived features."""
    reg = try_ymd("registration_init_time")
    return (df
            .withColumn("registration_tenure_days", F.datediff("ref_date", reg))
            .withColumn("avg_song_completion", song_completion("sum25", "sum50", "sum75", "sum985", "sum100"))
            .withColumn("total_secs_log", F.log1p(F.col("total_secs_sum").cast("double")))
            .withColumn("log1p_fwd_rev", F.log1p(F.col("fwd_rev").cast("double")))
            .withColumn("avg_num_unq_songs", ratio_plus_one("sum_unq", "daily_active_days"))
            .withColumn("recent_engagement_ratio", ratio_plus_one("recent_daily_active_days", "daily_active_days"))
            .withColumn("secs_trend_recent_vs_prior", trend("recent_secs", "prior_secs", p.recent_days, p.prior_days))
            .withColumn("numunq_trend_recent_vs_prior",
                        trend("recent_numunq", "prior_numunq", p.recent_days, p.prior_days)))


def model_population(txn: DataFrame, logs: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """The churn model's table: capped refs, all-row features, derived columns."""
    from lapse.operators.population import population_refs
    refs = population_refs(txn, p, capped=True)
    return derive_features(feature_table(txn, logs, members, refs, p), p)


def survival_population(txn: DataFrame, logs: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """The survival model's table (J13): paid-only transactions everywhere,
    uncapped guarded refs, duration / event columns attached."""
    from lapse.operators.population import ref_dates
    pt = paid(txn)
    refs = materialize(ref_dates(pt, None, guard=True, require_paid=True))      # three consumers
    feats = derive_features(feature_table(pt, logs, members, refs, p, features_paid_only=True), p)
    surv = refs.select("msno",
                       F.datediff("ref_date", "start_dt").alias("duration_days"),
                       (F.date_add("ref_date", p.grace_days) <= F.lit(p.last_date)).cast("int")
                       .alias("event_churned"))
    return feats.join(surv, "msno")


def engagement(log: DataFrame, refs: DataFrame, window_days: int, recent_days: int,
               value_col: str = "value") -> DataFrame:
    """Trailing-window engagement of a multi-row-per-day event log (E5 shape):
    distinct active days, recent distinct days, event count and value sums.
    Rows after the latest ref can never count, so they are pruned first
    (last-event date looks back without limit, so no lower bound)."""
    log = prune_to_refs(log, refs, None)
    j = log.join(refs.select("msno", "ref_date"), "msno").filter(F.col("log_dt") <= F.col("ref_date"))
    ref = F.col("ref_date")
    in_win = F.col("log_dt") >= F.date_sub(ref, window_days - 1)
    recent = F.col("log_dt") >= F.date_sub(ref, recent_days - 1)
    v = F.col(value_col).cast("double")
    return (j.groupBy("msno", "ref_date").agg(
        F.count_distinct(F.when(in_win, F.col("log_dt"))).cast("bigint").alias("active_days"),
        F.count_distinct(F.when(recent, F.col("log_dt"))).cast("bigint").alias("recent_active_days"),
        F.count(F.when(in_win, F.lit(1))).cast("bigint").alias("n_events"),
        F.sum(F.when(in_win, v)).alias("value_sum"),
        F.sum(F.when(recent, v)).alias("recent_value"),
        F.sum(F.when(in_win & ~recent, v)).alias("prior_value"),
        F.max("log_dt").alias("last_event_dt"),
    ))


def no_activity_share(population: DataFrame, logs: DataFrame) -> DataFrame:
    """Share of users with no log row at all (C5): a left-anti count."""
    n = population.select("msno")
    silent = n.join(logs.select("msno").distinct(), "msno", "left_anti")
    return (n.agg(F.count(F.lit(1)).cast("bigint").alias("n_users"))
            .select("n_users",
                    silent.select(F.count(F.lit(1))).scalar().cast("bigint").alias("n_no_activity"))
            .withColumn("pct_no_activity", F.col("n_no_activity") * 100.0 / F.col("n_users")))
