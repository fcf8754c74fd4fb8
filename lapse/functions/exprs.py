"""Scalar column expressions used by the feature, profiling and model layers.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# Song-completion weights for the num_25/50/75/985/100 buckets.
COMPLETION_WEIGHTS = (0.25, 0.50, 0.75, 0.985, 1.0)

# Age buckets (inclusive bounds) and the label for the rest.
AGE_BUCKETS = (("1-17", 1, 17), ("18-24", 18, 24), ("25-34", 25, 34),
               ("35-44", 35, 44), ("45-100", 45, 100))
AGE_UNKNOWN = "unknown/invalid"

SECONDS_PER_DAY = 86400


def clean_age(col) -> Column:
    """Self-reported age: keep 1..100, everything else NULL."""
    c = _c(col)
    return F.when(c.between(1, 100), c)


def age_bucket(col) -> Column:
    c = _c(col)
    e = None
    for label, lo, hi in AGE_BUCKETS:
        e = (F.when(c.between(lo, hi), F.lit(label)) if e is None
             else e.when(c.between(lo, hi), F.lit(label)))
    return e.otherwise(F.lit(AGE_UNKNOWN))


def clip_secs(col, hi: int = SECONDS_PER_DAY) -> Column:
    """Clip seconds to [0, hi].  NULL stays NULL (least(NULL, hi) would be hi)."""
    c = _c(col).cast("double")
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(0.0)))


def song_completion(s25, s50, s75, s985, s100) -> Column:
    cols = [_c(x).cast("double") for x in (s25, s50, s75, s985, s100)]
    weighted = sum(w * c for w, c in zip(COMPLETION_WEIGHTS, cols))
    total = sum(cols)
    return weighted / (total + F.lit(1.0))


def ratio_plus_one(num, den) -> Column:
    """num / (den + 1): the reference's zero-safe per-day ratios."""
    return _c(num).cast("double") / (_c(den).cast("double") + F.lit(1.0))


def trend(recent, prior, recent_days: int, prior_days: int) -> Column:
    """(recent / recent_days) / ((prior / prior_days) + 1)."""
    return (_c(recent).cast("double") / float(recent_days)) / (
        _c(prior).cast("double") / float(prior_days) + F.lit(1.0))


def cox_target(duration, event) -> Column:
    """Signed survival target: +(d + .5) for events, -(d + .5) when censored."""
    d = _c(duration).cast("double") + F.lit(0.5)
    return F.when(_c(event) == 1, d).otherwise(-d)


def has_positive(col) -> Column:
    return (_c(col) > 0).cast("int")


def registration_year(col) -> Column:
    """Year of an int YYYYMMDD date."""
    return F.floor(_c(col) / 10000).cast("int")


def segment_label(renew, cancel) -> Column:
    return F.format_string("renew=%d, cancel=%d", _c(renew).cast("int"), _c(cancel).cast("int"))


def discount_ratio(list_price, paid) -> Column:
    """(list - paid) / list, NULL when list <= 0 (so avg() skips the row)."""
    lp = _c(list_price).cast("double")
    return F.when(lp > 0, (lp - _c(paid).cast("double")) / lp)


def txn_frequency(n_txn, tenure_days) -> Column:
    return _c(n_txn).cast("double") / (F.greatest(_c(tenure_days).cast("double"), F.lit(0.0)) + 1.0)


def missing_label(col, label):
    return F.coalesce(_c(col), F.lit(label))


def safe_div(num, den) -> Column:
    """Division that yields NULL instead of raising (ANSI) or inf."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
