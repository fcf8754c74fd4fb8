"""Profiling (H1-H7) and leak-free dataset preparation (I1-I8, A7) queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.operators import prep, profile
from lapse.operators.pipeline import prepared_dataset, with_split
from lapse.operators.ranking import quantiles
from lapse.plans.context import rnd
from lapse.plans.registry import query
from lapse.session import materialize, scratch_path
from lapse.sources.io import load_splits, write_splits

#: Numeric columns of the model table that are keys or nominal codes: no distribution or correlation of theirs is asked for.
NOT_MEASURED = ("msno", "city", "registered_via", "payment_method_id", "registration_init_time")


def _measured(df) -> list[str]:
    """Every numeric column of the model table but keys and codes."""
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
            and f.name not in NOT_MEASURED]


SPIKE_COLS = ("city", "gender", "registered_via", "payment_method_id")


def _mt(ctx):
    if not hasattr(ctx, "_mt"):
        ctx._mt = materialize(ctx.model_table)
    return ctx._mt


def _split(ctx):
    if not hasattr(ctx, "_split"):
        ctx._split = materialize(with_split(_mt(ctx), ctx.p))
    return ctx._split


def _prepared(ctx):
    if not hasattr(ctx, "_prep"):
        ctx._prep = prepared_dataset(_split(ctx), ctx.p)
    return ctx._prep


@query("feature_describe")
def feature_describe(ctx):
    return rnd(profile.describe(_mt(ctx), _measured(_mt(ctx))))


@query("null_profile")
def null_profile(ctx):
    return rnd(profile.null_counts(_mt(ctx)))


@query("value_counts")
def value_counts(ctx):
    return rnd(profile.value_counts(ctx.members, "gender"))


@query("histograms")
def histograms(ctx):
    return rnd(profile.histogram(_mt(ctx), _measured(_mt(ctx)), 50))


@query("kde_grid")
def kde_grid(ctx):
    return rnd(profile.kde(_mt(ctx), "total_secs_log", 64))


@query("dominant_bins")
def dominant_bins(ctx):
    return rnd(profile.dominant_bins(_mt(ctx), _measured(_mt(ctx)), 50))


@query("correlation_matrix")
def correlation_matrix(ctx):
    return rnd(profile.corr_matrix(_mt(ctx), _measured(_mt(ctx))))


@query("spike_share")
def spike_share(ctx):
    m = _mt(ctx).withColumn("gender", F.coalesce(F.col("gender"), F.lit("unknown")))
    return rnd(profile.spike_share(m, SPIKE_COLS))


@query("stratified_split")
def stratified_split(ctx):
    return rnd(_split(ctx).select("msno", "is_churn", "split"))


@query("stratified_sample")
def stratified_sample(ctx):
    return rnd(prep.stratified_sample(ctx.labels.select("msno", "is_churn"), "msno", "is_churn",
                                      {1: 0.2, 0: 0.5}, ctx.p.seed))


@query("kfold_assignment")
def kfold_assignment(ctx):
    return rnd(prep.kfold(ctx.labels.select("msno"), "msno", 2, ctx.p.seed))


@query("median_impute")
def median_impute(ctx):
    from lapse.operators.pipeline import MEDIAN_COLS, SENTINEL_COLS
    d = _prepared(ctx)["imputed"]
    return rnd(d.select("msno", "split", *MEDIAN_COLS, *SENTINEL_COLS, "txn_frequency"))


@query("label_encode")
def label_encode(ctx):
    from lapse.operators.pipeline import CATEGORICAL_COLS
    d = _prepared(ctx)["dataset"]
    return rnd(d.select("msno", "split", *[f"{c}_enc" for c in CATEGORICAL_COLS]))


@query("standard_scale")
def standard_scale(ctx):
    from lapse.operators.pipeline import SCALE_COLS
    d = _prepared(ctx)["scaled"]      # the encoders are not part of this
    return rnd(d.select("msno", "split", *[f"{c}_scaled" for c in SCALE_COLS]))


@query("split_verification")
def split_verification(ctx):
    """The splits written in one go, loaded again one by one and verified."""
    from lapse.operators.pipeline import OUTPUT_COLS
    path = scratch_path(ctx.spark, f"{ctx.spark.sparkContext.applicationId}/splits-{uuid.uuid4().hex[:12]}")
    write_splits(_prepared(ctx)["dataset"], path)
    d = reduce(DataFrame.unionByName, [x.withColumn("split", F.lit(n)) for n, x in load_splits(ctx.spark, path).items()])
    nulls = sum(F.col(c).isNull().cast("bigint") for c in OUTPUT_COLS if c != "msno")
    g = d.withColumn("_nulls", nulls).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_churn").cast("double")).alias("churn_rate"),
        F.sum("_nulls").alias("total_nulls"))
    med = quantiles(d, "fwd_rev", [0.5], by=["split"]).select("split", F.col("q").alias("fwd_rev_median"))
    return rnd(g.join(med, "split", "left"))


@query("feature_manifest")
def feature_manifest(ctx):
    return _prepared(ctx)["manifest"]
