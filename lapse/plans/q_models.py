"""Model queries (J1-J14, M3, M4, N1, N3, N8).  Training data: the prepared, leak-free
model dataset (q_prep); the survival profile for Cox."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.functions.exprs import clean_age
from lapse.operators import calibration as cal
from lapse.operators import concordance as con
from lapse.operators import decision as dec
from lapse.operators import features as fe
from lapse.operators import metrics as met
from lapse.operators import model_store as store
from lapse.operators import models as ml
from lapse.operators import prep
from lapse.operators.pipeline import CATEGORICAL_COLS, MEDIAN_COLS, SCALE_COLS, SENTINEL_COLS, UNSCALED_COLS
from lapse.operators.ranking import running_best
from lapse.plans.context import rnd
from lapse.plans.q_eval import BUDGET, SUCCESS_RATE, VOUCHER_COST
from lapse.plans.q_prep import _prepared
from lapse.plans.q_prep import _split as _split_rows
from lapse.plans.registry import query
from lapse.session import materialize, scratch_path, together

FEATURES = [f"{c}_enc" for c in CATEGORICAL_COLS] + [f"{c}_scaled" for c in SCALE_COLS] + list(UNSCALED_COLS)
# The eight features added last in the reference's feature history (recency,
# latest-transaction snapshot, listening trend), which the ablation drops; and the gate thresholds.
LATE_FEATURES = ["days_since_last_login_scaled", "days_since_last_cancel_scaled",
                 "most_recent_payment_plan_days_scaled", "most_recent_actual_amount_paid_scaled",
                 "most_recent_is_auto_renew", "most_recent_is_cancel",
                 "secs_trend_recent_vs_prior_scaled", "numunq_trend_recent_vs_prior_scaled"]
GATE_THRESHOLDS = [round(0.05 * i, 2) for i in range(13)]
# The 17 numeric inputs of the survival model (its 4 categories are those of the churn model).
COX_NUMBERS = ["bd_clean", "registration_tenure_days", "avg_payment_plan_days", "avg_actual_amount_paid", "num_transactions",
               "total_secs_log", "daily_active_days", "is_auto_renew_rate", "avg_song_completion", "days_since_last_login",
               "days_since_last_cancel", "secs_trend_recent_vs_prior", "numunq_trend_recent_vs_prior",
               "most_recent_payment_plan_days", "most_recent_actual_amount_paid", "most_recent_is_auto_renew", "most_recent_is_cancel"]
COX_INPUTS = [f"{c}_enc" for c in CATEGORICAL_COLS] + COX_NUMBERS


def memo(fn):
    """Once per context."""
    name = f"_m{fn.__name__}"

    def once(ctx):
        if not hasattr(ctx, name):
            setattr(ctx, name, fn(ctx))
        return getattr(ctx, name)
    return once


@memo
def _data(ctx) -> DataFrame:
    return materialize(_prepared(ctx)["dataset"])


@memo
def _cards(ctx) -> dict[str, int]:
    return {f"{c}_enc": m.count() + 1 for c, m in _prepared(ctx)["encoders"].items()}


def _split(ctx, name):
    return _data(ctx).filter(F.col("split") == name)


def _parts(df):
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "val")


# ---- churn, P(pay), revenue ----

@memo
def _churn_model(ctx):
    return ml.fit_churn(_split(ctx, "train"), _split(ctx, "val"), FEATURES, _cards(ctx))


@memo
def _churn_scores(ctx):
    return materialize(_churn_model(ctx).score(_data(ctx), "p_churn_raw").select("msno", "split", "is_churn", "fwd_rev", "p_churn_raw"))


@query("churn_scores")
def churn_scores(ctx):
    return rnd(_churn_scores(ctx).select("msno", "split", "is_churn", "p_churn_raw"))


@memo
def _pay(ctx):
    d = _data(ctx).withColumn("has_pay", (F.col("fwd_rev") > 0).cast("int"))
    scored, model = ml.cross_fit(d, FEATURES, "has_pay", _cards(ctx), 2, ctx.p.seed)
    return materialize(scored), model


@query("cross_fit_pay")
def cross_fit_pay(ctx):
    return rnd(_pay(ctx)[0].select("msno", "split", "has_pay", "p_pay"))


@memo
def _revenue_model(ctx):
    return ml.fit_revenue(*_parts(_pay(ctx)[0]), FEATURES + ["p_pay"], _cards(ctx))


@memo
def _rev_scores(ctx):
    return materialize(_revenue_model(ctx).score(_pay(ctx)[0], "e_fwd_rev"))


@query("fwd_rev_scores")
def fwd_rev_scores(ctx):
    return rnd(_rev_scores(ctx).select("msno", "split", "fwd_rev", "e_fwd_rev"))


@memo
def _log_model(ctx):
    return ml.fit_log_rmse(_split(ctx, "train"), _split(ctx, "val"), FEATURES, _cards(ctx))


@query("log_rmse_baseline")
def log_rmse_baseline(ctx):
    s = ml.score_log_rmse(_log_model(ctx), _data(ctx).filter("split <> 'train'"), "pred")
    return rnd(met.regression_metrics(s, "pred", "fwd_rev", by=["split"]))


@query("gate_sweep")
def gate_sweep(ctx):
    s = ctx.scored.withColumn("p_pay", F.lit(1.0) - F.col("p_churn_raw"))
    return rnd(ml.gate_sweep(s, "p_pay", "e_amount", "fwd_rev", GATE_THRESHOLDS))


@memo
def _amount_model(ctx):
    return ml.fit_amount(_split(ctx, "train"), _split(ctx, "val"), FEATURES, _cards(ctx))


@query("hurdle_sweep")
def hurdle_sweep(ctx):
    """The fitted hurdle on validation rows: E[amount | pay] behind every gate, and the ungated product P(pay) * E[amount | pay]."""
    s = materialize(_amount_model(ctx).score(_pay(ctx)[0].filter("split = 'val'"), "e_amount"))
    gates = ml.gate_sweep(s, "p_pay", "e_amount", "fwd_rev", GATE_THRESHOLDS).select(F.lit("gate").alias("rule"), "*")
    product = met.regression_metrics(s.withColumn("e", F.col("p_pay") * F.col("e_amount")), "e", "fwd_rev").select(
        F.lit("product").alias("rule"), F.lit(None).cast("double").alias("threshold"), "rmse", "r2", F.col("n").alias("n_gated"))
    return rnd(gates.unionByName(product))


# ---- zero-inflated lognormal challenger ----

def _heads(s):
    p = F.least(F.greatest(F.lit(1.0) - F.col("p_churn_raw"), F.lit(0.001)), F.lit(0.999))
    return (F.log(p / (F.lit(1.0) - p)), F.log1p(F.col("e_amount")) - 1.0, F.col("p_churn_raw") - 0.5)


@query("ziln_point_estimate")
def ziln_point_estimate(ctx):
    s = ctx.scored
    logit, mu, ls = _heads(s)
    return rnd(s.select("msno", ml.ziln_predict(logit, mu, ls).alias("e_ziln"),
                        ml.ziln_loss(F.col("fwd_rev"), logit, mu, ls).alias("loss")))


@memo
def _ziln_model(ctx):
    return ml.fit_ziln(_split(ctx, "train"), FEATURES)


@query("ziln_scores")
def ziln_scores(ctx):
    s = _ziln_model(ctx).score(_data(ctx).filter("split <> 'train'"), "e_ziln")
    return rnd(s.select("msno", "split", "fwd_rev", "e_ziln"))


@query("model_choice")
def model_choice(ctx):
    from lapse.operators.prep import stratified_split
    val = stratified_split(ctx.scored, "msno", "is_churn", ctx.p.split_fracs, ctx.p.seed) \
        .filter(F.col("split") == "val")
    rows = [met.regression_metrics(val, col, "fwd_rev").select(F.lit(name).alias("model"),
                                                               F.lit(pr).alias("priority"), "rmse")
            for name, col, pr in (("hurdle", "e_fwd_rev", 0), ("last_amount", "e_amount", 1))]
    t = reduce(DataFrame.unionByName, rows)
    chosen = ml.choose_model(t)
    wide = t.groupBy().pivot("model", ["hurdle", "last_amount"]).agg(F.first("rmse"))
    return rnd(chosen.select("chosen", wide.select("hurdle").scalar().alias("rmse_incumbent"),
                             wide.select("last_amount").scalar().alias("rmse_challenger")))


@memo
def _choice(ctx) -> tuple[str, dict[str, float]]:
    """Champion and challenger on the validation rows: two numbers reach the driver."""
    _fitted(ctx, _revenue_model, _ziln_model)
    rev = met.regression_metrics(_rev_scores(ctx).filter("split = 'val'"), "e_fwd_rev", "fwd_rev")
    ziln = met.regression_metrics(_ziln_model(ctx).score(_split(ctx, "val"), "e"), "e", "fwd_rev")
    t = materialize(rev.select(F.lit("boosted").alias("model"), F.lit(0).alias("priority"), "rmse").unionByName(
        ziln.select(F.lit("ziln").alias("model"), F.lit(1).alias("priority"), "rmse")))
    return ml.choose_model(t).first()["chosen"], {r["model"]: r["rmse"] for r in t.collect()}


@query("fwd_rev_model_choice")
def fwd_rev_model_choice(ctx):
    winner, rmse = _choice(ctx)
    return rnd(ctx.spark.createDataFrame([(winner, rmse["boosted"], rmse["ziln"])],
                                         "chosen string, rmse_incumbent double, rmse_challenger double"))


# ---- survival model ----

@memo
def _cox_data(ctx):
    """The survival population with its own split, medians, sentinels and encoders (fitted on its train rows)."""
    sp = fe.survival_population(ctx.txn, ctx.logs, ctx.members, ctx.p)
    sp = sp.withColumns({"gender": F.coalesce("gender", F.lit("unknown")), "bd_clean": clean_age("bd"),
                         "city": F.coalesce("city", F.lit(-1)), "registered_via": F.coalesce("registered_via", F.lit(-1))})
    d = materialize(prep.stratified_split(sp, "msno", "event_churned", ctx.p.split_fracs, ctx.p.seed))
    train = d.filter("split = 'train'")
    d = prep.apply_fill(d, materialize(prep.fit_medians(train, MEDIAN_COLS)), "median", MEDIAN_COLS)
    d = prep.apply_fill(d, prep.fit_sentinels(train, SENTINEL_COLS, 30), "sentinel", SENTINEL_COLS)
    encoders = prep.fit_encoders(train, CATEGORICAL_COLS)
    d = prep.apply_encoders(d, encoders, CATEGORICAL_COLS)
    return (materialize(d.select("msno", "split", "duration_days", "event_churned", *COX_INPUTS)),
            {f"{c}_enc": m.count() + 1 for c, m in encoders.items()})


@memo
def _cox_model(ctx):
    d, cards = _cox_data(ctx)
    return ml.fit_cox(*_parts(d), COX_INPUTS, cards)


@memo
def _cox_scores(ctx):
    return materialize(_cox_model(ctx).score(_cox_data(ctx)[0], "risk").select("msno", "split", "duration_days", "event_churned", "risk"))


@query("cox_risk")
def cox_risk(ctx):
    return rnd(_cox_scores(ctx))


def _concordance(ctx, split):
    s = _cox_scores(ctx).filter(F.col("split") == split).withColumn("lasting", -F.col("risk"))
    return con.concordance_counts(s, "duration_days", "event_churned", "lasting")


@query("cox_concordance")
def cox_concordance(ctx):
    return rnd(reduce(DataFrame.unionByName, [_concordance(ctx, x).select(F.lit(x).alias("split"), "*") for x in ("val", "test")]))


# ---- what holds of every boosted model ----

def _fitted(ctx, *models) -> None:
    """Fit models that need nothing of each other side by side; what they share is made first."""
    _data(ctx), _cards(ctx)
    if _cox_model in models:
        _cox_data(ctx)
    together(*[partial(m, ctx) for m in models])


def _boosted(ctx) -> dict:
    _fitted(ctx, _churn_model, _revenue_model, _amount_model, _log_model, _cox_model)
    return {"churn": _churn_model(ctx), "pay": _pay(ctx)[1], "fwd_rev": _revenue_model(ctx), "amount": _amount_model(ctx),
            "log_fwd_rev": _log_model(ctx), "cox": _cox_model(ctx)}


@query("boosting_rounds")
def boosting_rounds(ctx):
    """Training and validation loss of every round of every boosted model, and whether the round was kept."""
    return rnd(reduce(DataFrame.unionByName, [m.rounds(k, ctx.spark) for k, m in _boosted(ctx).items()]))


@query("boosting_checks")
def boosting_checks(ctx):
    """Per boosted model: the training loss falls in every round, the validation rows stopped it, and
    it beats the constant model on them (not asked of the payers' amounts, which the inputs of the test tables
    do not tell); predictions of all rows are finite and in range."""
    rounds = reduce(DataFrame.unionByName, [m.rounds(k, ctx.spark) for k, m in _boosted(ctx).items()])
    prev = F.lag("train_loss").over(Window.partitionBy("model").orderBy("round"))
    per = rounds.withColumn("_up", F.col("train_loss") > prev + 1e-9).groupBy("model").agg(
        (F.count_if("_up") == 0).alias("train_loss_falls"),
        (F.max("round") > F.max(F.when(F.col("kept"), F.col("round")))).alias("stopped_by_validation"),
        (F.min("val_loss") < F.max(F.when(F.col("round") == 0, F.col("val_loss")))).alias("beats_constant")) \
        .withColumn("beats_constant", F.when(F.col("model") != "amount", F.col("beats_constant")))
    scores = _rev_scores(ctx).select("p_pay", "e_fwd_rev")
    ok = {"pay": scores.agg(F.bool_and((F.col("p_pay") > 0) & (F.col("p_pay") < 1)).alias("in_range")),
          "churn": _churn_scores(ctx).agg(F.bool_and((F.col("p_churn_raw") > 0) & (F.col("p_churn_raw") < 1)).alias("in_range")),
          "fwd_rev": scores.agg(F.bool_and((F.col("e_fwd_rev") >= 0) & (F.col("e_fwd_rev") < float("inf"))).alias("in_range")),
          "cox": _cox_scores(ctx).agg(F.bool_and(F.abs("risk") <= 30).alias("in_range"))}
    ranged = reduce(DataFrame.unionByName, [v.select(F.lit(k).alias("model"), "in_range") for k, v in ok.items()])
    return per.join(F.broadcast(ranged), "model", "left")


@query("feature_importance")
def feature_importance(ctx):
    models = _boosted(ctx)
    return rnd(ml.feature_importance({k: models[k] for k in ("churn", "fwd_rev", "cox")}, ctx.spark))


@query("feature_ablation")
def feature_ablation(ctx):
    rows = []
    for name, cols in (("all_features", FEATURES),
                       ("without_late_features", [c for c in FEATURES if c not in LATE_FEATURES])):
        m = ml.fit_churn(_split(ctx, "train"), _split(ctx, "val"), cols, {c: k for c, k in _cards(ctx).items() if c in cols})
        s = m.score(_split(ctx, "val"), "_p")
        rows.append(met.auc_roc(s, "_p", "is_churn").select(F.lit(name).alias("feature_set"),
                                                           F.lit(len(cols)).alias("n_features"), "auc_roc"))
    return rnd(reduce(DataFrame.unionByName, rows))


# ---- parameter search ----

def _ziln_study(ctx):
    train, val = _split(ctx, "train"), _split(ctx, "val")

    def fit(params, rounds, begin):
        m = ml.fit_ziln(train, FEATURES, seeds=(1,), max_iter=rounds or 50, **params)
        loss = met.regression_metrics(m.score(val, "e"), "e", "fwd_rev").first()["rmse"]
        m.history, m.best_round = [{"val": loss}], rounds or 50
        return m
    return fit


@memo
def _trials(ctx):
    train, val = _split(ctx, "train"), _split(ctx, "val")
    cox, cox_cards = _cox_data(ctx)
    _cards(ctx)
    tree = {"depth": [3, 4, 5], "rate": (0.1, 0.4), "l2": (0.5, 5.0)}
    seed = ctx.p.seed
    studies = {
        "churn": (ml.random_params(4, seed, **tree), ml.boosted_study(train, val, FEATURES, "is_churn", "logistic", _cards(ctx))),
        "fwd_rev": (ml.random_params(4, seed + 1, **tree, power=(1.2, 1.8)),
                    ml.boosted_study(*_parts(_pay(ctx)[0]), FEATURES + ["p_pay"], "fwd_rev", "tweedie", _cards(ctx))),
        "cox": (ml.random_params(4, seed + 2, **tree),
                ml.boosted_study(*_parts(cox), COX_INPUTS, "event_churned", "cox", cox_cards, duration="duration_days")),
        "ziln": (ml.random_params(4, seed + 3, ridge=(0.0005, 0.1)), _ziln_study(ctx)),
    }
    return ml.successive_halving(studies, ctx.spark)[0]


@query("tuning_trials")
def tuning_trials(ctx):
    return rnd(_trials(ctx))


@query("tuning_running_best")
def tuning_running_best(ctx):
    return rnd(running_best(_trials(ctx), "trial", "metric", "min", by=["study"]))


# ---- calibration and the decision chain on the fitted models ----

@query("isotonic_apply")
def isotonic_apply(ctx):
    """The map fitted on the validation rows of the stand-in score, applied to all rows."""
    d = prep.stratified_split(ctx.scored, "msno", "is_churn", ctx.p.split_fracs, ctx.p.seed)
    iso = cal.fit_isotonic(d.filter("split = 'val'"), "p_churn_raw", "is_churn")
    return rnd(cal.calibrate(iso, d, "p_churn_raw").select("msno", "split", "is_churn", "p_churn_raw", "p_calibrated"))


@memo
def _calibration(ctx):
    return cal.fit_isotonic(_churn_scores(ctx).filter("split = 'val'"), "p_churn_raw", "is_churn")


@memo
def _calibrated(ctx):
    return materialize(cal.calibrate(_calibration(ctx), _churn_scores(ctx).filter("split = 'test'"), "p_churn_raw"))


@query("calibration_before_after")
def calibration_before_after(ctx):
    return rnd(cal.before_after(_calibrated(ctx), "p_churn_raw", "p_calibrated", "is_churn"))


@memo
def _store(ctx) -> str:
    """The fitted chain, saved: preparation, models, calibration and the choice of the revenue model."""
    _fitted(ctx, _churn_model, _revenue_model, _ziln_model, _cox_model)
    path = scratch_path(ctx.spark, f"{ctx.spark.sparkContext.applicationId}/models-{uuid.uuid4().hex[:12]}")
    store.save_prep(path, _prepared(ctx))
    store.save_models(ctx.spark, path, {"churn": _churn_model(ctx), "pay": _pay(ctx)[1], "revenue": _revenue_model(ctx),
                                        "ziln": _ziln_model(ctx), "cox": _cox_model(ctx), "calibration": _calibration(ctx)})
    store.save_choice(ctx.spark, path, *_choice(ctx))
    return path


@query("model_reload")
def model_reload(ctx):
    """The chain saved, loaded into fresh objects and applied to the unprepared rows, against the models in memory: per split, whether
    every score is the same and finite."""
    path = _store(ctx)
    got = store.score_raw(ctx.spark, path, _split_rows(ctx)).select("msno", "split", "p_churn_raw", "p_churn_calibrated", "e_fwd_rev")
    cox = store.load_models(ctx.spark, path)["cox"].score(_cox_data(ctx)[0], "again").select("msno", F.col("again").alias("risk_again"))
    pay, revenue, winner = _pay(ctx)[1], _revenue_model(ctx), _choice(ctx)[0]
    d = _data(ctx)
    here = _ziln_model(ctx).score(d, "r") if winner == "ziln" else revenue.score(pay.score(d, "p_pay"), "r")
    here = cal.calibrate(_calibration(ctx), _churn_model(ctx).score(here, "p"), "p", "c").select("msno", "p", "c", "r")
    j = got.join(here, "msno").join(cox, "msno", "left").join(_cox_scores(ctx).select("msno", "risk"), "msno", "left")
    same = (F.col("p") == F.col("p_churn_raw")) & (F.col("c") == F.col("p_churn_calibrated")) & (F.col("r") == F.col("e_fwd_rev"))
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
                                         for c in ("p_churn_raw", "p_churn_calibrated", "e_fwd_rev")])
    return j.groupBy("split").agg(F.count("*").alias("n"), F.bool_and(same).alias("identical"), F.bool_and(finite).alias("finite"),
                                  F.bool_and(F.col("risk").eqNullSafe(F.col("risk_again"))).alias("cox_identical"))


@memo
def _priority(ctx):
    """Test users ranked by the stored chain: calibrated churn probability and the revenue model in production."""
    test = _split_rows(ctx).filter("split = 'test'")
    s = store.score_raw(ctx.spark, _store(ctx), test).select(
        "msno", "is_churn", F.col("p_churn_calibrated").alias("p_churn_raw"), "e_fwd_rev")
    return materialize(dec.priority_scores(materialize(s)))


@query("retention_scores")
def retention_scores(ctx):
    return rnd(_priority(ctx))


@query("retention_budget")
def retention_budget(ctx):
    return rnd(dec.budget_allocation(_priority(ctx), BUDGET, VOUCHER_COST, SUCCESS_RATE, ctx.p.seed))


@query("headline_metrics")
def headline_metrics(ctx):
    _fitted(ctx, _churn_model, _revenue_model, _ziln_model, _cox_model)
    c = _calibrated(ctx)
    winner = _choice(ctx)[0]
    test = _split(ctx, "test")
    rev = _ziln_model(ctx).score(test, "e") if winner == "ziln" else _rev_scores(ctx).filter("split = 'test'").withColumn("e", F.col("e_fwd_rev"))

    def one(name, df, col):
        return df.select(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"))

    rows = [one("auc_test_raw", met.auc_roc(c, "p_churn_raw", "is_churn"), "auc_roc"),
            one("ap_test_raw", met.average_precision(c, "p_churn_raw", "is_churn"), "average_precision"),
            one("auc_test_calibrated", met.auc_roc(c, "p_calibrated", "is_churn"), "auc_roc"),
            one("ap_test_calibrated", met.average_precision(c, "p_calibrated", "is_churn"), "average_precision"),
            one("ece_test_raw", cal.ece(c, "p_churn_raw", "is_churn"), "ece"),
            one("ece_test_calibrated", cal.ece(c, "p_calibrated", "is_churn"), "ece"),
            one("cox_concordance_test", _concordance(ctx, "test"), "c_index")]
    rm = met.regression_metrics(rev, "e", "fwd_rev")
    rows += [one(f"fwd_rev_{k}_test", rm, k) for k in ("rmse", "mae", "r2")]
    return rnd(reduce(DataFrame.unionByName, rows)).withColumn("fwd_rev_model", F.lit(winner))


@query("survival_feature_table")
def survival_feature_table(ctx):
    sp = fe.survival_population(ctx.txn, ctx.logs, ctx.members, ctx.p)
    return rnd(sp.select(*SURVIVAL_COLS))


SURVIVAL_COLS = ("msno", "duration_days", "event_churned", "num_transactions", "avg_actual_amount_paid",
                 "payment_method_id", "most_recent_is_auto_renew", "days_since_last_login",
                 "daily_active_days", "total_secs_sum", "registration_tenure_days", "avg_song_completion",
                 "city", "gender", "registered_via")
