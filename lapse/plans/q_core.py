"""Population, labels, joins and per-user feature queries (B, C, D, E, F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.exprs import (clean_age, cox_target, has_positive,
                                   registration_year, segment_label, txn_frequency)
from lapse.operators import features as fe
from lapse.operators import population as pop
from lapse.plans.context import rnd
from lapse.plans.registry import query
from lapse.session import materialize


@query("churn_revenue_by_segment")
def churn_revenue_by_segment(ctx):
    """Flagship: refs -> churn + forward revenue -> members -> rate by segment."""
    seg = pop.with_segments(ctx.labels, ctx.members)
    out = seg.groupBy("gender", "age_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.col("is_churn").cast("double")) * 100).alias("churn_pct"),
        F.avg(F.coalesce(F.col("fwd_rev"), F.lit(0.0))).alias("avg_fwd_rev"),
        F.sum(F.coalesce(F.col("fwd_rev"), F.lit(0.0))).alias("total_fwd_rev"))
    return rnd(out, 4)


@query("ref_dates")
def ref_dates(ctx):
    # the refs are the result here: no shared checkpoint needed
    return rnd(pop.ref_dates(ctx.txn, ctx.p.cutoff, guard=True, require_paid=True))


@query("ref_dates_unguarded")
def ref_dates_unguarded(ctx):
    r = pop.ref_dates(ctx.txn, ctx.p.cutoff, guard=False, require_paid=True)
    return rnd(r.select("msno", "ref_date"))


@query("churn_labels")
def churn_labels(ctx):
    return rnd(ctx.labels.select("msno", "ref_date", "is_churn"))


@query("churn_labels_paid_renewal")
def churn_labels_paid_renewal(ctx):
    return rnd(ctx.corrected.select("msno", "ref_date", "is_churn"))


@query("forward_revenue")
def forward_revenue(ctx):
    return rnd(pop.forward_revenue(ctx.txn, ctx.refs, ctx.p.fwd_window_days))


@query("survival_table")
def survival_table(ctx):
    return rnd(ctx.survival)


@query("signed_duration")
def signed_duration(ctx):
    s = ctx.survival
    return rnd(s.select("msno", cox_target("duration_days", "event_churned").alias("cox_target")))


@query("population_bias")
def population_bias(ctx):
    seg = pop.with_segments(ctx.corrected, ctx.members)
    both = pop.compare_populations(seg, pop.in_snapshot(ctx.p), {"gender": F.col("gender")})
    return rnd(both.where("dimension = 'gender'").select(
        F.col("value").alias("gender"), "n_corrected", "churn_pct_corrected", "n_snapshot", "churn_pct_snapshot"))


@query("population_comparison")
def population_comparison(ctx):
    seg = pop.with_segments(ctx.corrected, ctx.members)
    pre = fe.as_of(ctx.paid.select("msno", "txn_dt", "txn_id", "is_auto_renew", "is_cancel"), seg, "txn_dt")
    latest = fe.latest_per(pre, "msno", ["txn_dt", "txn_id"], ["is_auto_renew", "is_cancel"])
    flags = F.concat(F.lit("renew="), F.col("is_auto_renew").cast("string"), F.lit(", cancel="), F.col("is_cancel").cast("string"))
    return rnd(pop.compare_populations(seg.join(latest, "msno", "left"), pop.in_snapshot(ctx.p), {
        "gender": F.col("gender"), "channel": F.col("registered_via"), "age": F.col("age_bucket"), "flags": flags}))


@query("corrupted_expiry_profile")
def corrupted_expiry_profile(ctx):
    t = ctx.txn
    bad = F.col("expire_dt") < F.col("txn_dt")
    out = t.agg(F.count(F.lit(1)).alias("n_txn"),
                F.count_if(bad).alias("n_corrupt"),
                F.count_if(bad & (F.col("is_cancel") == 1)).alias("n_corrupt_cancel"),
                F.count_if(F.col("actual_amount_paid") <= 0).alias("n_free"),
                (F.avg(bad.cast("double")) * 100).alias("pct_corrupt"))
    return rnd(out)


@query("pre_ref_transactions")
def pre_ref_transactions(ctx):
    j = fe.as_of(ctx.txn.select("msno", "txn_id", "txn_dt", "actual_amount_paid"), ctx.refs, "txn_dt")
    return rnd(j.select("msno", "txn_id", "txn_dt", "ref_date", "actual_amount_paid"))


@query("txn_aggregates")
def txn_aggregates(ctx):
    tf = fe.txn_features(ctx.txn, ctx.refs, ctx.p)
    return rnd(tf.select("msno", "num_transactions", "avg_payment_plan_days", "avg_actual_amount_paid",
                         "is_auto_renew_rate", "is_cancel_rate", "avg_discount_rate",
                         "num_distinct_payment_methods").filter(F.col("num_transactions") > 0))


@query("latest_transaction")
def latest_transaction(ctx):
    tf = fe.txn_features(ctx.txn, ctx.refs, ctx.p)
    return rnd(tf.filter(F.col("num_transactions") > 0).select(
        "msno", "payment_method_id", "most_recent_payment_plan_days",
        "most_recent_actual_amount_paid", "most_recent_is_auto_renew", "most_recent_is_cancel"))


@query("recency")
def recency(ctx):
    f = ctx.features
    return rnd(f.select("msno", "days_since_last_login", "days_since_last_cancel"))


@query("engagement_window")
def engagement_window(ctx):
    lf = fe.log_features(ctx.logs, ctx.refs, ctx.p, unbounded_lookback=False)
    return rnd(lf.filter(F.col("daily_active_days") > 0).drop("last_login_dt"))


@query("user_feature_table")
def user_feature_table(ctx):
    return rnd(ctx.model_table)


@query("registration_tenure")
def registration_tenure(ctx):
    return rnd(ctx.model_table.select("msno", "registration_init_time", "registration_tenure_days"))


@query("engagement_ratios")
def engagement_ratios(ctx):
    return rnd(ctx.model_table.select("msno", "avg_song_completion", "total_secs_log", "log1p_fwd_rev",
                                      "avg_num_unq_songs", "recent_engagement_ratio"))


@query("listening_trend")
def listening_trend(ctx):
    return rnd(ctx.model_table.select("msno", "secs_trend_recent_vs_prior", "numunq_trend_recent_vs_prior"))


@query("txn_frequency")
def txn_frequency_q(ctx):
    m = ctx.model_table
    return rnd(m.select("msno", txn_frequency("num_transactions", "registration_tenure_days")
                        .alias("txn_frequency")))


@query("age_quality")
def age_quality(ctx):
    m = ctx.members
    valid = F.col("bd").between(1, 100)
    return rnd(m.agg(F.count(F.lit(1)).alias("n_members"), F.count_if(valid).alias("n_valid"),
                     (F.avg(F.when(valid, 1.0).otherwise(0.0)) * 100).alias("valid_pct"),
                     F.min("bd").alias("min_bd"), F.max("bd").alias("max_bd"),
                     F.avg(clean_age("bd")).alias("avg_valid_bd")))


@query("registrations_by_year")
def registrations_by_year(ctx):
    y = registration_year("registration_init_time")
    m = ctx.members.select(y.alias("reg_year")).filter(F.col("reg_year").between(1990, 2017))
    return rnd(m.groupBy("reg_year").agg(F.count(F.lit(1)).alias("n")))


@query("pay_vs_churn_disagreement")
def pay_vs_churn_disagreement(ctx):
    lab = ctx.labels.select("is_churn", has_positive(F.coalesce(F.col("fwd_rev"), F.lit(0.0))).alias("has_fwd_rev"))
    g = lab.groupBy("is_churn", "has_fwd_rev").agg(F.count(F.lit(1)).alias("n"))
    total = lab.select(F.count(F.lit(1))).scalar()
    disagree = (((F.col("is_churn") == 1) & (F.col("has_fwd_rev") == 1))
                | ((F.col("is_churn") == 0) & (F.col("has_fwd_rev") == 0)))
    return rnd(g.withColumn("pct", F.col("n") * 100.0 / total)
               .withColumn("disagrees", disagree.cast("bigint")))


@query("no_activity_share")
def no_activity_share(ctx):
    return rnd(fe.no_activity_share(ctx.refs, ctx.logs))


def _seg(ctx):
    return pop.with_segments(ctx.corrected, ctx.members)


@query("churn_by_gender")
def churn_by_gender(ctx):
    return rnd(pop.rate_by(_seg(ctx), "gender"))


@query("churn_by_channel")
def churn_by_channel(ctx):
    return rnd(pop.rate_by(_seg(ctx), "registered_via", top=8))


@query("churn_by_age")
def churn_by_age(ctx):
    return rnd(pop.rate_by(_seg(ctx), "age_bucket"))


def _latest_paid_pre_ref(ctx):
    j = fe.as_of(ctx.paid.select("msno", "txn_id", "txn_dt", "is_auto_renew", "is_cancel",
                                 "payment_plan_days"), ctx.refs, "txn_dt")
    return fe.latest_per(j, "msno", ["txn_dt", "txn_id"], ["is_auto_renew", "is_cancel", "payment_plan_days"])


@query("churn_by_renew_cancel")
def churn_by_renew_cancel(ctx):
    j = ctx.corrected.join(_latest_paid_pre_ref(ctx), "msno")
    out = pop.rate_by(j, ["is_auto_renew", "is_cancel"])
    return rnd(out.withColumn("segment", segment_label("is_auto_renew", "is_cancel")))


@query("churn_by_plan_length")
def churn_by_plan_length(ctx):
    j = ctx.corrected.join(_latest_paid_pre_ref(ctx), "msno")
    d = F.col("payment_plan_days")
    b = (F.when(d.between(1, 31), "1-31").when(d.between(32, 90), "32-90")
         .when(d > 90, "91+").otherwise("other"))
    return rnd(pop.rate_by(j.withColumn("plan_bucket", b), "plan_bucket"))


@query("label_balance")
def label_balance(ctx):
    lab = ctx.labels
    total = lab.select(F.count(F.lit(1))).scalar()
    g = lab.groupBy("is_churn").agg(F.count(F.lit(1)).alias("n"))
    return rnd(g.withColumn("pct", F.col("n") * 100.0 / total))


@query("behaviour_by_label")
def behaviour_by_label(ctx):
    per_user = ctx.logs.groupBy("msno").agg(
        F.count_distinct("log_dt").alias("active_days"),
        (F.sum("total_secs") / 3600).alias("total_hours"),
        F.sum("num_unq").alias("total_unq"))
    j = ctx.labels.select("msno", "is_churn").join(per_user, "msno", "left")
    return rnd(j.groupBy("is_churn").agg(
        F.count(F.lit(1)).alias("n"), F.avg("active_days").alias("avg_active_days"),
        F.avg("total_hours").alias("avg_total_hours"), F.avg("total_unq").alias("avg_unq_songs")))


@query("scale_overview")
def scale_overview(ctx):
    lg = ctx.logs
    return rnd(lg.agg(F.min("log_dt").alias("min_date"), F.max("log_dt").alias("max_date"),
                      F.count_distinct("msno").alias("n_users"), F.count(F.lit(1)).alias("n_rows")))


@query("range_quality")
def range_quality(ctx):
    s = F.col("total_secs")
    return rnd(ctx.logs.agg(F.min(s).alias("min_secs"), F.max(s).alias("max_secs"),
                            F.count_if(s < 0).alias("n_negative"),
                            F.count_if(s > 86400).alias("n_over_a_day"),
                            F.count(F.lit(1)).alias("n_total")))


@query("candidate_features")
def candidate_features(ctx):
    f = fe.feature_table(ctx.txn, ctx.logs, ctx.members, ctx.refs, ctx.p, with_candidates=True)
    return rnd(f.select("msno", "std_dev_daily_secs",
                        F.col("last_login_dt").isNull().cast("bigint").alias("never_logged_in"),
                        F.col("last_cancel_dt").isNull().cast("bigint").alias("never_canceled")))


@query("events_engagement")
def events_engagement(ctx):
    ev = ctx.events
    refs = (ev.filter(F.col("event_type") == "purchase").groupBy("msno")
            .agg(F.max("log_dt").alias("ref_date")))
    e = fe.engagement(ev, refs, 30, 7)
    e = e.withColumn("value_trend", (F.coalesce(F.col("recent_value"), F.lit(0.0)) / 7.0)
                     / (F.coalesce(F.col("prior_value"), F.lit(0.0)) / 23.0 + 1.0))
    return rnd(e)


@query("table_row_counts")
def table_row_counts(ctx):
    from lapse.sources.io import DRIVER_TABLES, table_stats
    return rnd(table_stats({n: ctx.t(n) for n in DRIVER_TABLES}))


@query("logs_csv_ingest")
def logs_csv_ingest(ctx):
    """A2/A3: the usage log written as CSV in two deliveries (odd days, then even days) and ingested in two runs, each of which takes
    the new files only, into month folders of one file per run; read back and summed per month."""
    import uuid

    from lapse.session import scratch_path
    from lapse.streaming.ingest import ingest_incremental
    base = scratch_path(ctx.spark, f"{ctx.spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex[:12]}")
    d = F.col("log_dt")
    logs = materialize(ctx.logs.withColumn("date", (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")).drop("log_dt"))
    batches = []
    for odd in (1, 0):
        logs.filter(F.col("date") % 2 == odd).write.mode("append").option("header", True).csv(f"{base}/in")
        batches.append(ingest_incremental(ctx.spark, f"{base}/in", f"{base}/out", logs.schema, checkpoint=f"{base}/state", date_col="date"))
    out = ctx.spark.read.parquet(f"{base}/out").withColumn("_file", F.col("_metadata.file_path"))
    return rnd(out.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_unq").alias("num_unq"), F.sum(F.round(F.col("total_secs") * 100).cast("bigint")).alias("secs_100"),
        F.count_distinct("_file").alias("n_files")).withColumn("n_runs", F.lit(sum(b > 0 for b in batches))))


@query("events_incremental_ingest")
def events_incremental_ingest(ctx):
    """A3 on the driver tables: the whole events table streamed once through an
    availableNow run into day-partitioned Parquet, then read back."""
    import uuid

    from lapse.session import scratch_path
    from lapse.streaming.ingest import ingest_incremental
    # a file source watches a folder; the glob names exactly the events file(s)
    src = f"{ctx.sf_dir}/events.parque[t]"
    schema = ctx.spark.read.parquet(f"{ctx.sf_dir}/events.parquet").schema
    run = uuid.uuid4().hex[:12]
    dst = scratch_path(ctx.spark, f"events-ingest-{run}")
    ingest_incremental(ctx.spark, src, dst, schema, checkpoint=scratch_path(ctx.spark, f"events-ingest-ckpt-{run}"),
                       fmt="parquet", day_from_ts="ts")
    out = ctx.spark.read.parquet(dst)
    return rnd(out.select("event_id", "user_id", "event_type", "value", "props", "day"))
