"""Population, labels and targets (D1-D8): the semantic core.

Every user gets their own reference date (last valid paid expiry), a churn
label relative to it and a forward-revenue target.  The plans are single
``groupBy`` passes: the reference's fan-out self join (n x m rows per user) is
replaced by conditional aggregates, which Spark pre-aggregates map-side, so a
user holding a third of all transactions still costs one partial row per
task before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.dates import ymd
from lapse.functions.exprs import age_bucket, missing_label, clean_age
from lapse.params import Params


def with_txn_dates(raw: DataFrame) -> DataFrame:
    """Raw transactions with int YYYYMMDD dates -> txn_dt / expire_dt DATE (B1)."""
    return raw.withColumn("txn_dt", ymd("transaction_date")).withColumn(
        "expire_dt", ymd("membership_expire_date"))


def with_txn_id(raw: DataFrame, name: str = "txn_id") -> DataFrame:
    """A deterministic tie-break id for raw transactions that have none: a
    64-bit hash of every raw column (stable under recomputation, unlike
    monotonically_increasing_id)."""
    return raw.withColumn(name, F.xxhash64(*[F.col(c) for c in raw.columns]))


def paid(txn: DataFrame, require_paid: bool = True) -> DataFrame:
    """Paid-only filter (B3); pushed into the Parquet scan when txn is a scan."""
    return txn.filter(F.col("actual_amount_paid") > 0) if require_paid else txn


def cutoff(last_date: dt.date, window_days: int) -> dt.date:
    """Latest ref_date that still leaves a full forward window."""
    return last_date - dt.timedelta(days=window_days)


def ref_dates(txn: DataFrame, cutoff_date: dt.date | None = None, guard: bool = True,
              require_paid: bool = True) -> DataFrame:
    """Per-user reference date.

    ref_date = latest expiry of a paid transaction (expiry >= transaction date
    when ``guard``; <= cutoff when given); start_dt = first paid transaction.
    Users without a qualifying expiry have no row.  One groupBy.
    """
    # the explicit key filter makes every use of the refs plan identical, so
    # Spark reuses one exchange instead of aggregating the transactions twice
    src = paid(txn, require_paid).filter(F.col("msno").isNotNull())
    ok = F.lit(True)
    if guard:
        ok = ok & (F.col("expire_dt") >= F.col("txn_dt"))
    if cutoff_date is not None:
        ok = ok & (F.col("expire_dt") <= F.lit(cutoff_date))
    return (src.groupBy("msno")
            .agg(F.min("txn_dt").alias("start_dt"),
                 F.max(F.when(ok, F.col("expire_dt"))).alias("ref_date"))
            .filter(F.col("ref_date").isNotNull()))


def population_refs(txn: DataFrame, p: Params, capped: bool = True) -> DataFrame:
    return ref_dates(txn, p.cutoff if capped else None, p.guard_corrupted_expiry, p.require_paid_ref)


def _window(col_dt, ref, days):
    return (col_dt > ref) & (col_dt <= F.date_add(ref, days))


def labels(txn: DataFrame, refs: DataFrame, grace_days: int, fwd_days: int,
           renewal_requires_paid: bool = False) -> DataFrame:
    """Churn label (D5) and forward revenue (D6) in one join + one groupBy.

    is_churn = 1 unless a (paid, when required) transaction falls in
    (ref, ref + grace]; fwd_rev = sum paid in (ref, ref + fwd], NULL when the
    user has no transaction in that window (the reference emits no row).
    """
    r = refs.select("msno", "ref_date")
    t = txn.select("msno", "txn_dt", "actual_amount_paid")
    renew = _window(F.col("txn_dt"), F.col("ref_date"), grace_days)
    if renewal_requires_paid:
        renew = renew & (F.col("actual_amount_paid") > 0)
    fwd = _window(F.col("txn_dt"), F.col("ref_date"), fwd_days)
    agg = (t.join(r, "msno")
           .groupBy("msno")
           .agg(F.max(F.when(renew, F.lit(1))).alias("_renewed"),
                F.sum(F.when(fwd, F.col("actual_amount_paid"))).alias("fwd_rev")))
    # refs and agg are both hash-partitioned on msno: this join adds no exchange.
    return (r.join(agg, "msno", "left")
            .select("msno", "ref_date",
                    (F.lit(1) - F.coalesce(F.col("_renewed"), F.lit(0))).cast("int").alias("is_churn"),
                    "fwd_rev"))


def churn_labels(txn: DataFrame, refs: DataFrame, grace_days: int,
                 renewal_requires_paid: bool = False) -> DataFrame:
    return labels(txn, refs, grace_days, grace_days, renewal_requires_paid).select("msno", "is_churn")


def forward_revenue(txn: DataFrame, refs: DataFrame, fwd_days: int) -> DataFrame:
    """Only users with a transaction in the forward window."""
    return (labels(txn, refs, 0, fwd_days).filter(F.col("fwd_rev").isNotNull())
            .select("msno", "fwd_rev"))


def survival_table(txn: DataFrame, last_date: dt.date, grace_days: int, guard: bool = True,
                   require_paid: bool = True) -> DataFrame:
    """Duration / event per paying user (D7): first paid -> last valid expiry,
    event when that expiry + grace <= last_date, else right-censored."""
    r = ref_dates(txn, None, guard, require_paid)
    return r.select(
        "msno", "start_dt", F.col("ref_date").alias("last_expire_dt"),
        F.datediff("ref_date", "start_dt").alias("duration_days"),
        (F.date_add("ref_date", grace_days) <= F.lit(last_date)).cast("int").alias("event_churned"))


def corrected_population(txn: DataFrame, p: Params) -> DataFrame:
    """The EDA's corrected population: guarded, capped, paid refs; paid renewals."""
    pt = paid(txn)
    refs = ref_dates(pt, p.cutoff, guard=True, require_paid=True)
    return labels(pt, refs, p.grace_days, p.fwd_window_days)


def rate_by(df: DataFrame, by, label: str = "is_churn", top: int | None = None,
            order_by_n: bool = True) -> DataFrame:
    """Group size and label rate in percent (E6/E7/E13); optional top-k by size."""
    by = [by] if isinstance(by, str) else list(by)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                            (F.avg(F.col(label).cast("double")) * 100).alias("churn_pct"))
    if top is not None:
        g = g.orderBy(F.col("n").desc(), *[F.col(b).asc_nulls_first() for b in by]).limit(top)
    return g


def with_segments(pop: DataFrame, members: DataFrame) -> DataFrame:
    """Population joined to member attributes with missing labels filled."""
    m = members.select("msno", "gender", "registered_via", "bd")
    return (pop.join(m, "msno", "left")
            .withColumn("gender", missing_label("gender", "unknown"))
            .withColumn("age_bucket", age_bucket(clean_age("bd"))))


def compare_populations(people: DataFrame, seen, by: dict) -> DataFrame:
    """Churn rates of all people and of those a snapshot would have seen, side by side.

    ``seen``: condition of the snapshot; ``by``: dimension name -> column.  One aggregate over
    (dimension, value), with an ``all`` row for the whole population: n and rate of either
    population, and the share of people that the snapshot misses."""
    groups = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[
        F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in by.items()])
    d = people.select(F.col("is_churn").cast("double").alias("y"), seen.alias("seen"), F.explode(groups).alias("g"))
    n, n_seen = F.count(F.lit(1)), F.count_if("seen")
    return d.groupBy("g.dimension", "g.value").agg(
        n.cast("bigint").alias("n_corrected"), (F.avg("y") * 100).alias("churn_pct_corrected"),
        F.when(n_seen > 0, n_seen).cast("bigint").alias("n_snapshot"),
        (F.avg(F.when(F.col("seen"), F.col("y"))) * 100).alias("churn_pct_snapshot"),
        ((F.lit(1.0) - n_seen / n) * 100).alias("pct_missed"))


def in_snapshot(p: Params, band_days: int = 30):
    """Whether a user's own ref_date falls in one fixed band ending at the cut-off: the
    single-snapshot sample that survivorship-biases the rate."""
    return F.col("ref_date").between(F.lit(p.cutoff - dt.timedelta(days=band_days - 1)), F.lit(p.cutoff))
