"""Model training and batch scoring.

- churn, P(pay), forward revenue, its log baseline, the hurdle's amount model and the boosted Cox all come from one
  boosting loop (``boosting.fit``) that stops on validation rows
- P(pay) is cross-fitted over seeded folds (train rows scored out of fold)
- forward revenue: Tweedie loss on the raw zero-inflated target, P(pay) as an extra input
- zero-inflated lognormal challenger re-aimed as two linear heads (logistic P(pay), log-amount on payers) and a residual
  sigma, ensembled over seeded weightings of all rows
- successive halving over studies of candidate parameters

Every fitted model is plain data with ``score(df, out)`` and ``to_json`` / ``from_json`` (see ``model_store``).
"""

from __future__ import annotations

import json
import math
import random
import threading
from dataclasses import asdict, dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import boosting
from lapse.operators.boosting import BoostedTrees
from lapse.operators.metrics import hash_uniform
from lapse.operators.prep import kfold
from lapse.session import materialize, together

# The zero-inflated lognormal output constraints.
ZILN_MU_RANGE = (-1.0, 9.0)
ZILN_LOGSIGMA_RANGE = (-3.0, 0.7)
ZILN_CAP = 1e6

#: How the boosted models are fitted unless a caller says otherwise; the number of rounds is found on validation rows.
FIT = {"rounds": 1000, "patience": 10, "rate": 0.2, "depth": 4}


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def fit_churn(train: DataFrame, val: DataFrame, cols, categories: dict | None = None, label: str = "is_churn", **options) -> BoostedTrees:
    """Boosted churn classifier (J1); stopped on the validation rows."""
    return boosting.fit(train, val, cols, label, "logistic", categories=categories, **{**FIT, **options})


def cross_fit(df: DataFrame, cols, label: str, categories: dict | None = None, k: int = 2, seed: int = 42, out: str = "p_pay",
              **options) -> tuple[DataFrame, BoostedTrees]:
    """Cross-fitted P(label) (J2): (``df`` with ``out``, the model of all training rows).

    A training fold is scored by a model fitted on the other folds, in as many rounds as the full model took (they grow side by side),
    so its own labels play no part; validation and test rows are scored by the full model, which the validation rows stopped.
    """
    d = kfold(df, "msno", k, seed)
    tr, rest = d.filter(F.col("split") == "train"), d.filter(F.col("split") != "train")
    pace = boosting.Pace()
    full, *others = together(
        partial(fit_churn, tr, d.filter(F.col("split") == "val"), cols, categories, label, tells=pace, **options),
        *[partial(boosting.fit, tr.filter(F.col("fold") != i), None, cols, label, "logistic", categories=categories, follows=pace,
                  **{**FIT, **options}) for i in range(k)])
    parts = [full.score(rest, out)]
    parts += [m.score(tr.filter(F.col("fold") == i), out) for i, m in enumerate(others)]
    return reduce(DataFrame.unionByName, parts).drop("fold"), full


def fit_revenue(train: DataFrame, val: DataFrame, cols, categories: dict | None = None, label: str = "fwd_rev", power: float = 1.5,
                **options) -> BoostedTrees:
    """Boosted Tweedie regressor on the raw, zero-inflated target (J3); stopped by the deviance of the validation rows."""
    return boosting.fit(train, val, cols, label, "tweedie", categories=categories, power=power, **{**FIT, **options})


def fit_amount(train: DataFrame, val: DataFrame, cols, categories: dict | None = None, label: str = "fwd_rev", power: float = 1.9,
               **options) -> BoostedTrees:
    """E[amount | pay], the hurdle's second stage (J5): fitted and stopped on payers only."""
    return boosting.fit(train.filter(F.col(label) > 0), val.filter(F.col(label) > 0), cols, label, "tweedie", categories=categories,
                        power=power, **{**FIT, **options})


def fit_log_rmse(train: DataFrame, val: DataFrame, cols, categories: dict | None = None, label: str = "fwd_rev", **options) -> BoostedTrees:
    """Squared error on log1p(target) (J4); ``score_log_rmse`` goes back with expm1."""
    def logged(df):
        return df.withColumn("_ly", F.log1p(F.col(label).cast("double")))
    return boosting.fit(logged(train), logged(val), cols, "_ly", "squared", categories=categories, **{**FIT, **options})


def score_log_rmse(model: BoostedTrees, df: DataFrame, out: str) -> DataFrame:
    return model.score(df, "_lp").withColumn(out, F.expm1("_lp")).drop("_lp")


def fit_cox(train: DataFrame, val: DataFrame, cols, categories: dict | None = None, duration: str = "duration_days",
            event: str = "event_churned", **options) -> BoostedTrees:
    """Boosted Cox partial likelihood (J7); stopped by that of the validation rows.  The score is the log relative risk."""
    return boosting.fit(train, val, cols, event, "cox", categories=categories, duration=duration, **{**FIT, **options})


def gate_sweep(df: DataFrame, p_pay: str, amount: str, true: str, thresholds) -> DataFrame:
    """Hard-threshold hurdle sweep (J5): prediction = amount when p_pay >= tau
    else 0, RMSE / R2 per threshold.  The fixed threshold list is exploded per
    row (no join), then one grouped aggregate."""
    th = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    d = df.select(F.col(p_pay).alias("_p"), F.col(amount).cast("double").alias("_a"),
                  F.col(true).cast("double").alias("_y"), th)
    e = F.when(F.col("_p") >= F.col("threshold"), F.col("_a")).otherwise(F.lit(0.0)) - F.col("_y")
    return d.groupBy("threshold").agg(F.sqrt(F.avg(e * e)).alias("rmse"),
                                      (F.lit(1.0) - F.avg(e * e) / F.var_pop("_y")).alias("r2"),
                                      F.count_if(F.col("_p") >= F.col("threshold")).alias("n_gated"))


def ziln_predict(logit, mu, log_sigma):
    """E[y] = sigmoid(logit) * exp(mu + sigma^2 / 2), heads clipped, capped."""
    m = F.least(F.greatest(mu, F.lit(ZILN_MU_RANGE[0])), F.lit(ZILN_MU_RANGE[1]))
    ls = F.least(F.greatest(log_sigma, F.lit(ZILN_LOGSIGMA_RANGE[0])), F.lit(ZILN_LOGSIGMA_RANGE[1]))
    sigma = F.exp(ls)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return F.least(p * F.exp(m + sigma * sigma / 2), F.lit(ZILN_CAP))


def ziln_loss(y, logit, mu, log_sigma):
    """BCE(logit, y > 0) + 1[y > 0] * lognormal negative log-likelihood."""
    m = F.least(F.greatest(mu, F.lit(ZILN_MU_RANGE[0])), F.lit(ZILN_MU_RANGE[1]))
    ls = F.least(F.greatest(log_sigma, F.lit(ZILN_LOGSIGMA_RANGE[0])), F.lit(ZILN_LOGSIGMA_RANGE[1]))
    pos = (y > 0).cast("double")
    # numerically stable BCE with logits
    bce = F.greatest(logit, F.lit(0.0)) - logit * pos + F.log1p(F.exp(-F.abs(logit)))
    ly = F.log(F.when(y > 0, y))
    nll = ly + ls + 0.5 * math.log(2 * math.pi) + (ly - m) * (ly - m) / (2 * F.exp(2 * ls))
    return bce + F.coalesce(pos * nll, F.lit(0.0))


@dataclass
class ZilnEnsemble:
    """Heads of the zero-inflated lognormal: per seed the coefficients and intercepts of both, and log sigma."""
    cols: list[str]
    heads: list[dict]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "ZilnEnsemble":
        return cls(**json.loads(text))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Mean over the heads of the expected value."""
        pay, amount = (np.array([[*h[k], h[f"{k}_0"]] for h in self.heads]).T for k in ("pay", "amount"))
        var = np.exp(np.clip([h["log_sigma"] for h in self.heads], *ZILN_LOGSIGMA_RANGE)) ** 2

        def predict(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([*[c.to_numpy(float, na_value=0.0) for c in cols], np.ones(len(cols[0]))])
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ pay, -500, 500)))
            e = np.minimum(p * np.exp(np.clip(x @ amount, *ZILN_MU_RANGE) + var / 2), ZILN_CAP)
            return pd.Series(e.mean(axis=1))

        return df.withColumn(out, F.pandas_udf(predict, "double")(*[F.col(c).cast("double") for c in self.cols]))


def fit_ziln(train: DataFrame, cols, label: str = "fwd_rev", seeds=(1, 2, 3, 4, 5), ridge: float = 1e-3, max_iter: int = 50) -> ZilnEnsemble:
    """Two-head zero-inflated lognormal, one fit per seed on all training rows (J6, J8):
    logistic head on y > 0, linear head on log(y) over payers, sigma from the
    payers' residuals.  A seed weighs the rows by exponential weights from a hash of (seed, key)
    (a Bayesian bootstrap), so the ensemble varies and every row counts in each fit."""
    d = assemble(train, cols).withColumn("_pos", (F.col(label) > 0).cast("double"))

    def head(s):
        sub = d.withColumn("_w", -F.log((hash_uniform("msno", f"ziln:{s}") + 1e-9) / (1 + 1e-9)) + 1e-6)
        pay = LogisticRegression(featuresCol="features", labelCol="_pos", weightCol="_w", maxIter=max_iter, regParam=ridge).fit(sub)
        payers = sub.filter(F.col(label) > 0).withColumn("_ly", F.log(F.col(label).cast("double")))
        amt = LinearRegression(featuresCol="features", labelCol="_ly", weightCol="_w", maxIter=max_iter, regParam=ridge).fit(payers)
        resid = amt.transform(payers).agg(F.stddev_pop(F.col("_ly") - F.col("prediction"))).first()[0] or 1.0
        return {"pay": pay.coefficients.toArray().tolist(), "pay_0": float(pay.intercept), "amount": amt.coefficients.toArray().tolist(),
                "amount_0": float(amt.intercept), "log_sigma": math.log(max(resid, 1e-6))}

    return ZilnEnsemble(list(cols), together(*[partial(head, s) for s in seeds]))


def choose_model(metrics: DataFrame, name: str = "model", metric: str = "rmse", priority: str = "priority"):
    """Champion / challenger (J9): lowest metric wins, ties go to the incumbent
    (lowest priority number)."""
    return metrics.agg(F.min_by(F.col(name), F.struct(F.col(metric), F.col(priority))).alias("chosen"))


def feature_importance(models: dict[str, BoostedTrees], spark: SparkSession) -> DataFrame:
    """Share of the gain per model and input, largest first (J12): one row per input, built as a DataFrame."""
    rows = [(m, c, float(g)) for m, model in models.items() for c, g in model.importance().items()]
    return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy("model", F.desc("importance"), "feature")


# ---- parameter search (J11) ----

def random_params(n: int, seed: int, **ranges) -> list[dict]:
    """``n`` seeded random parameter sets; a range is a list of choices or a (low, high) pair."""
    r = random.Random(seed)
    return [{k: r.choice(v) if isinstance(v, list) else round(r.uniform(*v), 4) for k, v in ranges.items()} for _ in range(n)]


def successive_halving(studies: dict, spark: SparkSession, first: int = 4, grow: int = 2) -> tuple[DataFrame, dict]:
    """Search every study by successive halving: all candidates get ``first`` rounds, the better half (by validation loss) is
    continued for ``grow`` times as many, and so on; the last one runs until its validation loss stops falling.

    ``studies`` maps a name to (candidates, fit): ``fit(params, rounds, begin)`` returns a model whose history holds the losses;
    ``begin`` is the model to go on from and ``rounds`` None means until it stops.  Studies, and the candidates of a rung,
    run side by side; a ``fit`` with a ``release`` is told when its study is over.  Returns the trial table
    (study, trial, candidate, rung, params, rounds, metric, kept) and the best model per study.
    """
    def search(name, candidates, fit):
        rows, best = [], None
        alive, rung, rounds, trial = {i: None for i in range(len(candidates))}, 0, first, 0
        while alive:
            last = len(alive) == 1
            models = dict(zip(alive, together(*[partial(fit, candidates[i], None if last else rounds, m) for i, m in alive.items()])))
            loss = {i: min(h["val"] for h in m.history) for i, m in models.items()}
            keep = sorted(loss, key=lambda i: (loss[i], i))[:max(1, len(alive) // 2)]
            for i, m in models.items():
                rows.append((name, trial, i, rung, json.dumps(candidates[i], sort_keys=True), m.best_round, float(loss[i]), i in keep))
                trial += 1
            best = models[keep[0]]
            alive = {} if last else {i: models[i] for i in keep}
            rung, rounds = rung + 1, rounds * grow
        getattr(fit, "release", lambda: None)()
        return rows, best

    found = dict(zip(studies, together(*[partial(search, name, *s) for name, s in studies.items()])))
    rows, best = [r for got, _ in found.values() for r in got], {name: b for name, (_, b) in found.items()}
    schema = "study string, trial int, candidate int, rung int, params string, rounds int, metric double, kept boolean"
    return materialize(spark.createDataFrame(rows, schema)), best


def boosted_study(train: DataFrame, val: DataFrame, cols, label: str, loss: str, categories: dict, **fixed):
    """``fit`` of a study (see ``successive_halving``) on the boosting loop; its rows are binned once for all candidates."""
    lock, ready = threading.Lock(), []
    bins = {k: fixed[k] for k in ("duration", "max_bins") if k in fixed}

    def fit(params: dict, rounds: int | None, begin: BoostedTrees | None) -> BoostedTrees:
        stop = {"rounds": FIT["rounds"], "patience": FIT["patience"]} if rounds is None else {"rounds": rounds, "patience": rounds + 1}
        with lock:
            if not ready:
                ready.append(boosting.prepare(train, val, cols, label, loss, categories=categories, **bins))
        return boosting.fit(train, val, cols, label, loss, categories=categories, begin=begin, prepared=ready[0],
                            **{**FIT, **fixed, **params, **stop})

    def release():
        while ready:
            ready.pop().release()

    fit.release = release
    return fit
