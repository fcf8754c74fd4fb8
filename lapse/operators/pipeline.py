"""The feature notebook's preparation chain as one DataFrame pipeline:
fill / clean -> stratified split -> fit (train only) -> apply to every split.

Fitted state stays in small DataFrames (medians, sentinels, encoder
mappings, scaler moments); the model dataset is one frame with a ``split``
column, written per split by ``sources.write_splits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.exprs import clean_age, txn_frequency
from lapse.operators import prep
from lapse.params import Params
from lapse.session import materialize

# Column roles of the model dataset.
CATEGORICAL_COLS = ("city", "gender", "registered_via", "payment_method_id")
MEDIAN_COLS = ("bd_clean", "registration_tenure_days", "avg_payment_plan_days", "avg_actual_amount_paid",
               "most_recent_payment_plan_days", "most_recent_actual_amount_paid")
SENTINEL_COLS = ("days_since_last_login", "days_since_last_cancel")
SCALE_COLS = ("bd_clean", "registration_tenure_days", "avg_payment_plan_days", "avg_actual_amount_paid",
              "num_transactions", "total_secs_log", "daily_active_days", "num_distinct_payment_methods",
              "avg_num_unq_songs", "recent_engagement_ratio", "txn_frequency", "days_since_last_login",
              "days_since_last_cancel", "secs_trend_recent_vs_prior", "numunq_trend_recent_vs_prior",
              "most_recent_payment_plan_days", "most_recent_actual_amount_paid")
UNSCALED_COLS = ("is_auto_renew_rate", "avg_song_completion", "is_cancel_rate", "avg_discount_rate",
                 "most_recent_is_auto_renew", "most_recent_is_cancel")
TARGET_COLS = ("is_churn", "log1p_fwd_rev", "fwd_rev")
OUTPUT_COLS = (("msno",) + TARGET_COLS + tuple(f"{c}_enc" for c in CATEGORICAL_COLS)
               + tuple(f"{c}_scaled" for c in SCALE_COLS) + UNSCALED_COLS)


def with_split(model_table: DataFrame, p: Params) -> DataFrame:
    """Fill gender, clean age, then the seeded stratified 70/15/15 split."""
    m = (model_table.withColumn("gender", F.coalesce(F.col("gender"), F.lit("unknown")))
         .withColumn("bd_clean", clean_age("bd")))
    return prep.stratified_split(m, "msno", "is_churn", p.split_fracs, p.seed)


def fit_prepared(train: DataFrame) -> dict:
    """Medians, sentinels, encoders and scaler moments of the training rows."""
    fitted = {"medians": materialize(prep.fit_medians(train, MEDIAN_COLS)),
              "sentinels": materialize(prep.fit_sentinels(train, SENTINEL_COLS, 30))}
    filled = _filled(train, fitted)
    return {**fitted, "encoders": prep.fit_encoders(filled, CATEGORICAL_COLS),
            "scaler": materialize(prep.fit_scaler(filled, SCALE_COLS))}


def _filled(rows: DataFrame, fitted: dict) -> DataFrame:
    d = prep.apply_fill(rows, fitted["medians"], "median", MEDIAN_COLS)
    d = prep.apply_fill(d, fitted["sentinels"], "sentinel", SENTINEL_COLS)
    return d.withColumn("txn_frequency", txn_frequency("num_transactions", "registration_tenure_days"))


def apply_prepared(rows: DataFrame, fitted: dict) -> dict:
    """``rows`` imputed, scaled and encoded with ``fitted`` statistics: {"imputed", "scaled", "dataset"}."""
    imputed = materialize(_filled(rows, fitted))
    scaled = prep.apply_scaler(imputed, fitted["scaler"], SCALE_COLS)
    dataset = prep.apply_encoders(scaled, fitted["encoders"], CATEGORICAL_COLS).select(*OUTPUT_COLS, "split")
    return {"imputed": imputed, "scaled": scaled, "dataset": dataset}


def prepared_dataset(split_df: DataFrame, p: Params | None = None) -> dict:
    """Impute, encode and scale with statistics fitted on the train split only."""
    fitted = fit_prepared(split_df.filter(F.col("split") == "train"))
    return {**fitted, **apply_prepared(split_df, fitted),
            "manifest": _manifest(fitted["encoders"], fitted["medians"], fitted["sentinels"], fitted["scaler"], p)}


# The wording of the methodology record.
METHODOLOGY = ("per-user reference date: last plausible paid expiry before the cut-off; churn: no renewal within the grace days; "
               "statistics fitted on the train split only")


def _manifest(mappings, medians, sentinels, scaler, p: Params | None = None) -> DataFrame:
    """One-row fitted-parameter record (I7): cardinalities / unknown index per
    categorical, medians, sentinels, scaler moments, column lists, targets, methodology, cut-off and windows."""
    cats = None
    for c, m in mappings.items():
        k = m.agg(F.count(F.lit(1)).alias("k"))
        row = k.select(F.lit(c).alias("name"), F.lit(f"{c}_enc").alias("column"),
                       (F.col("k") + 1).alias("cardinality"), F.col("k").alias("unknown_index"))
        cats = row if cats is None else cats.unionByName(row)
    cat_json = cats.agg(F.to_json(F.collect_list(F.struct("*"))).alias("categorical"))
    med_json = medians.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("column", "median"))))
                           .alias("medians"))
    sen_json = sentinels.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("column", "sentinel"))))
                             .alias("sentinels"))
    sc_json = scaler.agg(F.to_json(F.collect_list(F.struct("column", "mean", "std"))).alias("scaler"))
    return (cat_json.select("categorical", med_json.select("medians").scalar().alias("medians"),
                            sen_json.select("sentinels").scalar().alias("sentinels"),
                            sc_json.select("scaler").scalar().alias("scaler"))
            .withColumn("numerical_scaled", F.lit(",".join(f"{c}_scaled" for c in SCALE_COLS)))
            .withColumn("numerical_unscaled", F.lit(",".join(UNSCALED_COLS)))
            .withColumn("targets", F.lit(",".join(TARGET_COLS)))
            .withColumn("methodology", F.lit(METHODOLOGY))
            .withColumns({k: F.lit(getattr(p, k, None)).cast(t) for k, t in (
                ("cutoff", "date"), ("grace_days", "bigint"), ("fwd_window_days", "bigint"), ("engagement_days", "bigint"),
                ("recent_days", "bigint"), ("seed", "bigint"))}))


def columns_from_manifest(manifest_row) -> list[str]:
    """Model input columns read back from a manifest record."""
    import json
    cats = [c["column"] for c in json.loads(manifest_row["categorical"])]
    return cats + manifest_row["numerical_scaled"].split(",") + manifest_row["numerical_unscaled"].split(",")
