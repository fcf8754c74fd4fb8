import random

import pytest
from pyspark.sql import functions as F

from lapse.operators import calibration as cal
from lapse.operators import metrics as met
from lapse.operators import ranking as rk
from lapse.operators import survival as sv
from lapse.operators.concordance import concordance_counts


def test_pct_rank_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int")
    assert [r.p for r in rk.pct_rank(df, "v", "p").orderBy("v").collect()] == [0.25, 0.625, 0.625, 1.0]


def test_quantiles_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    q = {r.p: r.q for r in rk.quantiles(df, "x", [0.33, 0.5]).collect()}
    assert q[0.33] == pytest.approx(1.99) and q[0.5] == pytest.approx(2.5)


def test_cumulative_grouped_matches_python(spark):
    random.seed(7)
    rows = [(random.choice("abc"), random.randint(0, 30), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    out = rk.cumulative(df, ["v desc", "id"], ["v"], ["g"]).collect()
    for g in "abc":
        mine = sorted((r._row, r.cum_v) for r in out if r.g == g)
        ref = sorted([(v, i) for gg, v, i in rows if gg == g], key=lambda t: (-t[0], t[1]))
        run, exp = 0, []
        for k, (v, _) in enumerate(ref, 1):
            run += v
            exp.append((k, run))
        assert mine == exp


def test_auc_and_ap_with_ties(spark):
    df = spark.createDataFrame([(.9, 1), (.9, 0), (.5, 1), (.4, 0), (.3, 1)], "s double, y int")
    assert met.auc_roc(df, "s", "y").first().auc_roc == pytest.approx(0.416667, abs=1e-6)
    assert met.average_precision(df, "s", "y").first().average_precision == pytest.approx(0.588889, abs=1e-6)


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    random.seed(1)
    rows = [(round(random.random(), 2), int(random.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="yd", numBins=0)
    ml = ev.evaluate(df.withColumn("yd", F.col("y").cast("double")))
    assert met.auc_roc(df, "s", "y").first().auc_roc == pytest.approx(ml, abs=1e-9)


def test_isotonic_interpolates_and_clamps(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 1), (0.5, 0), (1.0, 1), (1.0, 1)], "p double, y int")
    m = cal.fit_isotonic(df, "p", "y")
    q = spark.createDataFrame([(0.0,), (0.5,), (0.75,), (1.0,), (-1.0,), (2.0,)], "p double")
    got = [r.p_calibrated for r in cal.calibrate(m, q, "p").collect()]
    assert got == pytest.approx([1 / 3, 1 / 3, 2 / 3, 1, 1 / 3, 1])


def test_kaplan_meier_fixture(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "d int, e int")
    km = sv.kaplan_meier(df, "d", "e")
    s = {r.t: r.survival for r in km.collect()}
    assert s[0] == 1.0 and s[1] == pytest.approx(.75) and s[2] == pytest.approx(.5) and s[3] == pytest.approx(.5)
    h = sv.survival_at(km, (1, 2, 3)).first()
    assert h.median_survival == 2 and h.s_3 == pytest.approx(.5)


def test_calibration_bin_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.3, 1), (1.0, 1)], "p double, y int")
    b = {r.bin: r.n for r in cal.calibration_bins(df, "p", "y").collect()}
    assert b[0] == 1 and b[2] == 1 and b[9] == 1 and sum(b.values()) == 3
    perfect = spark.createDataFrame([(0.25, 0), (0.25, 0), (0.25, 0), (0.25, 1)], "p double, y int")
    assert cal.ece(perfect, "p", "y").first().ece == pytest.approx(0.0)


def test_concordance_matches_pairs(spark):
    random.seed(3)
    rows = [(random.randint(0, 25), random.randint(0, 1), random.choice([0.1, 0.2, round(random.random(), 2)]))
            for _ in range(300)]
    r = concordance_counts(spark.createDataFrame(rows, "d int, e int, s double"), "d", "e", "s").first()
    c = t = d = 0
    for di, ei, si in rows:
        if ei != 1:
            continue
        for dj, ej, sj in rows:
            if dj > di or (dj == di and ej == 0):
                c, t, d = c + (sj > si), t + (sj == si), d + (sj < si)
    assert (r.concordant, r.tied, r.discordant) == (c, t, d)


def test_survival_curve_is_monotone_on_data(spark):
    import os
    from lapse.operators.population import survival_table
    from lapse.params import TEST_PARAMS as P
    from lapse.sources import adapters
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    txn = adapters.transactions(spark.read.parquet(f"{sf}/orders.parquet"))
    st = survival_table(txn, P.last_date, P.grace_days)
    km = sorted(sv.kaplan_meier(st, "duration_days", "event_churned").collect(), key=lambda r: r.t)
    s = [r.survival for r in km]
    assert all(a >= b for a, b in zip(s, s[1:])) and 0 <= s[-1] <= 1
    assert km[0].at_risk == st.count()
    assert all(r.at_risk >= r.events + r.censored for r in km)


def test_approx_quantiles_close_to_exact(spark):
    df = spark.range(20000).select((F.col("id") % 997).cast("double").alias("x"))
    ex = {r.p: r.q for r in rk.quantiles(df, "x", [0.25, 0.5, 0.9]).collect()}
    ap = {r.p: r.q for r in rk.quantiles(df, "x", [0.25, 0.5, 0.9], approx=True).collect()}
    assert all(abs(ex[p] - ap[p]) <= 2 for p in ex)


def test_kde_is_exact(spark):
    """Every row counts where it lies, not at the ends of a cell."""
    import numpy as np
    from lapse.operators.profile import kde
    r = random.Random(4)
    xs = [r.gauss(0, 1) for _ in range(300)] + [0.5] * 20 + [5e3]
    got = [x for x in kde(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double"), "x", 16).orderBy("i").collect()]
    v = np.array(xs)
    h = v.std(ddof=1) * len(v) ** -0.2
    for i, g in enumerate(got):
        at = v.min() + i * (v.max() - v.min()) / 15
        assert g.x == pytest.approx(at)
        want = np.exp(-0.5 * ((at - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert g.density == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_task_size_is_bounded(spark):
    """Queries ask for small tasks and many partitions; settings that ask for even smaller ones stay."""
    from lapse import session
    old = {k: spark.conf.get(k, None) for k in (session.ADVISORY, session.INITIAL)}
    try:
        spark.conf.set(session.ADVISORY, "64MB")
        spark.conf.unset(session.INITIAL)
        session.bound_tasks(spark)
        assert session._bytes(spark.conf.get(session.ADVISORY)) == 16 << 20 and spark.conf.get(session.INITIAL) == "1000"
        spark.conf.set(session.ADVISORY, "8m")
        spark.conf.set(session.INITIAL, "2000")
        session.bound_tasks(spark)
        assert spark.conf.get(session.ADVISORY) == "8m" and spark.conf.get(session.INITIAL) == "2000"
        spark.conf.unset(session.INITIAL)
        spark.conf.set(session.ADVISORY, "1m")
        d = spark.range(0, 400_000, 1, 8).groupBy("id").agg(F.count("*").alias("n"))
        assert d.rdd.getNumPartitions() >= 2 and d.count() == 400_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
