"""Shared, lazily built inputs of the named queries.

A ``Ctx`` only memoises DataFrame *objects* (plans), never data: every query
still reads the whole tables it depends on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import features as fe
from lapse.operators import population as pop
from lapse.params import TEST_PARAMS, Params
from lapse.sources import adapters
from lapse.session import materialize
from lapse.sources.io import table


def round_half_away(c, digits: int = 6):
    """round(x * 10^d) / 10^d (+ 0.0 turns -0.0 into 0.0).  The same formula is
    used by the SQL oracle, so equal doubles always round to equal doubles."""
    scale = float(10 ** digits)
    return F.round(c.cast("double") * scale) / scale + F.lit(0.0)


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Normalise an output: integers -> bigint, floats -> double rounded to
    ``digits`` (float sums differ in the last bits with summation order)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float"):
            out.append(round_half_away(F.col(f.name), digits).alias(f.name))
        elif t in ("byte", "short", "integer"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif t == "decimal":
            out.append(round_half_away(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, p: Params = TEST_PARAMS):
        self.spark, self.sf_dir, self.p = spark, sf_dir, p

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def txn(self) -> DataFrame:
        return adapters.transactions(self.t("orders"))

    @cached_property
    def paid(self) -> DataFrame:
        return pop.paid(self.txn)

    @cached_property
    def members(self) -> DataFrame:
        return adapters.members(self.t("customer"))

    @cached_property
    def logs(self) -> DataFrame:
        return adapters.user_logs(self.t("lineitem"), self.t("orders"))

    @cached_property
    def events(self) -> DataFrame:
        return adapters.event_log(self.t("events"))

    @cached_property
    def refs(self) -> DataFrame:
        """Guarded, capped, paid reference dates (the library default).  Written
        once: the transaction side, the log side and the label side all join it."""
        return materialize(pop.ref_dates(self.txn, self.p.cutoff, guard=True, require_paid=True))

    @cached_property
    def labels(self) -> DataFrame:
        """Feature-pipeline labels: any transaction (also $0) renews."""
        return pop.labels(self.txn, self.refs, self.p.grace_days, self.p.fwd_window_days,
                          renewal_requires_paid=False)

    @cached_property
    def corrected(self) -> DataFrame:
        """EDA corrected population: paid-only transactions throughout."""
        return pop.corrected_population(self.txn, self.p)

    @cached_property
    def features(self) -> DataFrame:
        return fe.feature_table(self.txn, self.logs, self.members, self.refs, self.p)

    @cached_property
    def model_table(self) -> DataFrame:
        return fe.derive_features(self.features, self.p)

    @cached_property
    def survival(self) -> DataFrame:
        return materialize(pop.survival_table(self.txn, self.p.last_date, self.p.grace_days))

    @cached_property
    def last_paid(self) -> DataFrame:
        """Last pre-ref paid amount per labelled user (input of the stand-in revenue score)."""
        j = fe.as_of(self.paid.select("msno", "txn_dt", "txn_id", "actual_amount_paid"),
                     self.refs, "txn_dt")
        return fe.latest_per(j, "msno", ["txn_dt", "txn_id"], ["actual_amount_paid"]) \
            .withColumnRenamed("actual_amount_paid", "last_paid")

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled users with deterministic stand-in scores (see adapters.score_columns)."""
        lab = self.labels.select("msno", "is_churn",
                                 F.coalesce(F.col("fwd_rev"), F.lit(0.0)).alias("fwd_rev"))
        return materialize(adapters.score_columns(lab, self.t("customer"), self.last_paid))
