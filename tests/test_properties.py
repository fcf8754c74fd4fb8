"""Property-based checks of the distributed order statistics against brute force."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lapse.operators import metrics as met
from lapse.operators import ranking as rk

values = st.lists(st.integers(min_value=0, max_value=12), min_size=2, max_size=60)
labelled = st.lists(st.tuples(st.integers(min_value=0, max_value=8), st.integers(min_value=0, max_value=1)),
                    min_size=2, max_size=60).filter(lambda xs: 0 < sum(y for _, y in xs) < len(xs))
SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(values)
def test_pct_rank_and_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(xs)], "id long, v double")
    got = {r.id: r.p for r in rk.pct_rank(df, "v", "p").collect()}
    a = np.array(xs, dtype=float)
    for i, v in enumerate(xs):
        avg_rank = (a < v).sum() + ((a == v).sum() + 1) / 2
        assert got[i] == pytest.approx(avg_rank / len(xs))
    q = {r.p: r.q for r in rk.quantiles(df, "v", [0.1, 0.33, 0.5, 0.9]).collect()}
    for p in (0.1, 0.33, 0.5, 0.9):
        assert q[p] == pytest.approx(float(np.quantile(a, p)))


@settings(**SETTINGS)
@given(labelled)
def test_auc_and_ap_match_brute_force(spark, rows):
    df = spark.createDataFrame([(float(s), y) for s, y in rows], "s double, y int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert met.auc_roc(df, "s", "y").first().auc_roc == pytest.approx(auc)
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    assert met.average_precision(df, "s", "y").first().average_precision == pytest.approx(ap)
