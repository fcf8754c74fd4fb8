"""Boosting loop, model store, isotonic map and search against brute force, on small fixtures."""
import json
import math
import random
import tempfile
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import boosting as bo
from lapse.operators import calibration as cal
from lapse.operators import model_store as store
from lapse.operators import models as ml
from lapse.operators import prep


def data(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.random(), r.randint(0, 3), r.gauss(0, 1)
        p = 1 / (1 + math.exp(-(3 * a - 1.5 + (b == 2))))
        pay = r.random() < p
        rows.append((i, a, b, c if i % 9 else None, int(pay), float(r.expovariate(1 / (20 + 100 * a))) if pay else 0.0,
                     r.randint(1, 40) + int(40 * a), int(r.random() < .7)))
    return spark.createDataFrame(rows, "msno long, a double, b int, c double, y int, amount double, days int, event int")


COLS, CATS = ["a", "b", "c"], {"b": 4}


@pytest.mark.parametrize("name", ["logistic", "squared", "tweedie"])
def test_gradients_are_those_of_the_loss(name):
    loss, f, y, e = bo.make_loss(name), np.linspace(-2, 2, 9), np.array([0., 1, 0, 1, 1, 0, 0, 1, 1]), 1e-5
    g, h = loss.grad(y, f)
    scale = {"logistic": 1.0, "squared": 2.0, "tweedie": 2.0}[name]        # constant factors of the reported value
    assert g * scale == pytest.approx((loss.value(y, f + e) - loss.value(y, f - e)) / (2 * e), abs=1e-4)
    up, down = loss.grad(y, f + e)[0], loss.grad(y, f - e)[0]
    assert h == pytest.approx((up - down) / (2 * e), abs=1e-4)


def test_first_split_is_the_best_of_all(spark):
    """A stump on squared error against every threshold and every pair of category groups in mean order."""
    d = data(spark)
    m = bo.fit(d, None, COLS, "amount", "squared", categories=CATS, rounds=1, depth=1, rate=1.0, l2=0.0, min_rows=1, max_step=1e9)
    pdf = d.toPandas()
    y = pdf.amount.to_numpy()

    def gain(left):
        return 0 if left.all() or not left.any() else len(y) * y.var() - left.sum() * y[left].var() - (~left).sum() * y[~left].var()

    tried = [gain((pdf.a <= t).to_numpy()) for t in m.edges[0]] + [gain((pdf.c.isna() | (pdf.c <= t)).to_numpy()) for t in m.edges[2]]
    tried += [gain(pdf.b.isin([k for k in range(4) if s >> k & 1]).to_numpy()) for s in range(16)]
    feature, split = m.trees[0]["splits"]["0"]
    assert m.trees[0]["gains"]["0"] == pytest.approx(max(tried))
    s = m.score(d, "p").toPandas()
    assert (s.p.to_numpy() - y).var() * len(y) == pytest.approx(len(y) * y.var() - max(tried))
    assert feature == 0 and isinstance(split, int)


@pytest.mark.parametrize("loss, label", [("logistic", "y"), ("tweedie", "amount"), ("squared", "amount"), ("cox", "event")])
def test_training_loss_falls_and_validation_stops(spark, loss, label):
    d = data(spark)
    tr, va = d.filter("msno % 4 <> 0"), d.filter("msno % 4 = 0")
    m = bo.fit(tr, va, COLS, label, loss, categories=CATS, duration="days" if loss == "cox" else None, patience=4, rate=0.3, depth=3)
    train = [h["train"] for h in m.history]
    assert all(b < a + 1e-9 for a, b in zip(train, train[1:]))
    val = [h["val"] for h in m.history]
    assert m.best_round == val.index(min(val)) == len(m.trees) and m.stopped and len(val) == m.best_round + 5
    again = bo.BoostedTrees.from_json(m.to_json())
    j = again.score(m.score(d, "p1"), "p2").agg(F.count_if(F.col("p1") == F.col("p2")).alias("same"), F.count("*").alias("n")).first()
    assert j["same"] == j["n"] == 400


def test_cox_loss_is_the_partial_likelihood(spark):
    d = data(spark, 60)
    m = bo.fit(d, d, COLS, "event", "cox", categories=CATS, duration="days", rounds=3, rate=0.3, depth=2)
    pdf = m.score(d, "f").toPandas()
    nll = sum(math.log(np.exp(pdf.f[pdf.days >= r.days]).sum()) - r.f for r in pdf.itertuples() if r.event) / pdf.event.sum()
    assert m.history[m.best_round]["train"] == pytest.approx(nll)


def test_going_on_equals_going_through(spark):
    """Layout and interruption do not change the model."""
    d = data(spark)
    opts = dict(categories=CATS, rate=0.3, depth=2)
    a = bo.fit(d, None, COLS, "y", "logistic", rounds=6, **opts)
    b = bo.fit(d.repartition(7), None, COLS, "y", "logistic", rounds=6, **opts)
    c = bo.fit(d, None, COLS, "y", "logistic", rounds=4, begin=bo.fit(d, None, COLS, "y", "logistic", rounds=2, **opts), **opts)
    pa, pb, pc = (m.score(d, "p").orderBy("msno").toPandas().p.to_numpy() for m in (a, b, c))
    assert pa == pytest.approx(pb) and pa == pytest.approx(pc)


def test_odd_inputs(spark):
    d = data(spark, 50)
    m = bo.fit(d.withColumn("y", F.when(F.col("msno") > 5, F.col("y"))), None, COLS, "y", categories=CATS, rounds=2)
    assert m.n_rows == 44
    odd = spark.createDataFrame([(None, None, None), (float("nan"), 9, float("inf")), (1.0, -1, 0.0)], "a double, b int, c double")
    assert m.score(odd, "p").filter("p > 0 and p < 1").count() == 3
    with pytest.raises(ValueError):
        bo.fit(d.limit(0), None, COLS, "y", categories=CATS)


def test_cross_fit_does_not_see_its_own_labels(spark):
    """A label that the inputs cannot tell is not told by the score of the row itself."""
    r = random.Random(5)
    rows = [(i, r.random(), int(r.random() < .5), "train" if i < 300 else "val") for i in range(400)]
    d = spark.createDataFrame(rows, "msno long, a double, y int, split string")
    s, _ = ml.cross_fit(d, ["a"], "y", rounds=20, patience=30, depth=4, min_rows=1)
    t = s.filter("split = 'train'").toPandas()
    assert len(t) == 300 and abs(np.corrcoef(t.p_pay, t.y)[0, 1]) < 0.25


def pava(xs):
    out = []
    for x, s, w in xs:
        out.append([x, x, s, w])
        while len(out) > 1 and out[-2][2] / out[-2][3] > out[-1][2] / out[-1][3]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return out


@pytest.mark.parametrize("kind", ["random", "falling", "rising"])
def test_isotonic_in_runs_equals_pooling_all(spark, kind):
    r = random.Random(2)
    rows = [(i / 64, {"random": r.randint(0, 1), "falling": int(i < 32), "rising": int(i >= 32)}[kind]) for i in range(64) for _ in range(1 + i % 3)]
    d = spark.createDataFrame(rows, "p double, y int")
    agg = {}
    for p, y in rows:
        s, w = agg.get(p, (0, 0))
        agg[p] = (s + y, w + 1)
    blocks = pava([(p, s, w) for p, (s, w) in sorted(agg.items())])
    knots = sorted({(e, s / w) for lo, hi, s, w in blocks for e in (lo, hi)})
    want = np.interp([p for p, _ in rows], *zip(*knots))
    for block in (1 << 16, 4):
        m = cal.fit_isotonic(d, "p", "y", block=block)
        got = m.apply(d.withColumn("i", F.monotonically_increasing_id()), "p").orderBy("i").toPandas().p_calibrated
        assert got.to_numpy() == pytest.approx(want)
    edge = m.apply(spark.createDataFrame([(None,), (-1.0,), (9.0,)], "p double"), "p").toPandas().p_calibrated
    assert math.isnan(edge[0]) and edge[1] == pytest.approx(want[0]) and edge[2] == pytest.approx(want[-1])


def test_store_and_dispatch(spark):
    d = data(spark)
    path = tempfile.mkdtemp(prefix="lapse-store-")
    pay = bo.fit(d, None, COLS, "y", categories=CATS, rounds=2)
    rev = bo.fit(pay.score(d, "p_pay"), None, [*COLS, "p_pay"], "amount", "tweedie", categories=CATS, rounds=2)
    filled = d.fillna(0.0)
    ziln = ml.fit_ziln(filled, ["a", "b"], "amount", seeds=(1, 2))
    iso = cal.fit_isotonic(pay.score(d, "p"), "p", "y")
    store.save_models(spark, path, {"pay": pay, "revenue": rev, "ziln": ziln, "calibration": iso})
    for winner, want in (("boosted", rev.score(pay.score(d, "p_pay"), "e")), ("ziln", ziln.score(d, "e"))):
        store.save_choice(spark, path, winner, {"boosted": 1, "ziln": 2.5})
        score, name = store.revenue_scorer(spark, path)
        assert name == winner and store.load_choice(spark, path)[1] == {"boosted": 1.0, "ziln": 2.5}
        assert [r.e for r in score(d, "e").orderBy("msno").collect()] == [r.e for r in want.orderBy("msno").collect()]
    back = store.load_models(spark, path)["calibration"]
    same = back.apply(iso.apply(pay.score(d, "p"), "p", "c1"), "p", "c2")
    assert same.filter("c1 = c2").count() == 400
    store.save_choice(spark, path, "other", {})
    with pytest.raises(ValueError):
        store.revenue_scorer(spark, path)


def test_successive_halving_keeps_the_better_half(spark):
    d = data(spark)
    tr, va = d.filter("msno % 4 <> 0"), d.filter("msno % 4 = 0")
    cands = ml.random_params(4, 3, depth=[2, 3], rate=(0.1, 0.5))
    t, best = ml.successive_halving({"s": (cands, ml.boosted_study(tr, va, COLS, "y", "logistic", CATS))}, spark, first=2)
    t = t.toPandas().sort_values("trial")
    assert t.groupby("rung").size().tolist() == [4, 2, 1] and all(
        json.loads(p) == cands[c] for p, c in zip(t.params, t.candidate))
    for rung, g in t.groupby("rung"):
        assert set(g[g.kept].candidate) == set(g.nsmallest(max(1, len(g) // 2), "metric").candidate)
    assert best["s"].stopped and t.metric.iloc[-1] == pytest.approx(min(h["val"] for h in best["s"].history))


def test_driver_gets_candidates_not_histograms(spark, monkeypatch):
    """What a pass brings to the driver does not depend on the number of bins, and blocks do not change the model."""
    import pickle
    d, sizes, merged = data(spark, 3000), [], bo._Fit._merged

    def told(self, *a):
        out = merged(self, *a)
        sizes.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(bo._Fit, "_merged", told)
    opts = dict(categories=CATS, rounds=2, depth=3, max_bins=1024)
    one = bo.fit(d, d, COLS, "y", **opts)
    assert len(one.edges[0]) > 500 and max(sizes) < 4 * 3 * 400
    monkeypatch.setattr(bo, "FEW_ROWS", 500)
    monkeypatch.setattr(bo, "CHECKPOINT", 1)
    many = bo.fit(d.repartition(9), d.repartition(5), COLS, "y", **opts)
    p, q = (m.score(d, "p").orderBy("msno").toPandas().p.to_numpy() for m in (one, many))
    assert p == pytest.approx(q) and one.history[2]["val"] == pytest.approx(many.history[2]["val"])


def test_candidates_run_side_by_side_on_rows_binned_once(spark, monkeypatch):
    import threading
    d, met, made, prepare = data(spark), threading.Barrier(4, timeout=60), [], bo.prepare
    monkeypatch.setattr(bo, "prepare", lambda *a, **k: made.append(1) or prepare(*a, **k))
    study = ml.boosted_study(d, d, COLS, "y", "logistic", CATS)

    def fit(params, rounds, begin):
        if begin is None:
            met.wait()
        return study(params, rounds if rounds else 3, begin)

    t, best = ml.successive_halving({"s": ([{"rate": r, "depth": 2} for r in (.1, .2, .3, .4)], fit)}, spark, first=1)
    assert t.count() == 7 and len(made) == 1
    alone = bo.fit(d, d, COLS, "y", "logistic", categories=CATS, patience=20, depth=2, rate=best["s"].params["rate"], rounds=1 + 2 + 3)
    assert best["s"].history[3]["val"] == pytest.approx(alone.history[3]["val"])
    study.release()


def test_driver_gets_one_candidate_of_each_node_and_range(spark, monkeypatch):
    """What a pass brings to the driver does not grow with the inputs; a few blocks share one task that finds the splits."""
    d, told, merged = data(spark, 2000), [], bo._Fit._merged
    wide = d.select("*", *[F.expr(f"a * {i} + pmod(msno * {i + 3}, 17)").alias(f"x{i}") for i in range(20)])

    def counted(self, *a):
        out = merged(self, *a)
        told.append((self.tasks, self.data.getNumPartitions(), len(out)))
        return out

    monkeypatch.setattr(bo._Fit, "_merged", counted)
    cols = COLS + [f"x{i}" for i in range(20)]
    opts = dict(categories=CATS, rounds=2, depth=3)
    one = bo.fit(wide, wide, cols, "y", **opts)
    assert all(tasks == 1 and n <= 4 + 1 for tasks, _, n in told)
    monkeypatch.setattr(bo, "FEW_ROWS", 500)
    monkeypatch.setattr(bo, "PART_ROWS", 500)
    monkeypatch.setattr(bo, "MERGE_BLOCKS", 2)
    told.clear()
    many = bo.fit(wide, wide, cols, "y", **opts)
    assert all(blocks >= 8 and tasks == 1 + blocks // 2 and n <= 4 * tasks + 1 for tasks, blocks, n in told)
    assert [t["splits"] for t in one.trees] == [t["splits"] for t in many.trees]


def test_folds_grow_along_with_the_full_model(spark, monkeypatch):
    """The folds' models start before the full one has ended, take as many rounds, and score as fits of that many rounds do."""
    d = data(spark, 600).withColumn("split", F.when(F.col("msno") % 4 == 0, "val").otherwise("train"))
    begun, fit = threading.Barrier(3, timeout=60), bo.fit
    made = {}

    def met(*a, **k):
        begun.wait()
        m = fit(*a, **k)
        made.setdefault(k.get("follows") is not None, []).append(m)
        return m

    monkeypatch.setattr(bo, "fit", met)
    scored, full = ml.cross_fit(d, COLS, "y", CATS, 2, 7, patience=3)
    assert full.stopped and 0 < full.best_round == len(full.trees)
    assert [len(m.trees) for m in made[True]] == [full.best_round] * 2 and all(len(m.history) == full.best_round + 1 for m in made[True])
    monkeypatch.setattr(bo, "fit", fit)
    folds = prep.kfold(d, "msno", 2, 7).filter("split = 'train'")
    got = {r.msno: r.p_pay for r in scored.collect()}
    for i in range(2):
        alone = bo.fit(folds.filter(F.col("fold") != i), None, COLS, "y", categories=CATS, **{**ml.FIT, "patience": 3, "rounds": full.best_round})
        want = alone.score(folds.filter(F.col("fold") == i), "p").collect()
        assert want and all(got[r.msno] == pytest.approx(r.p) for r in want)


def test_folds_end_when_the_full_model_fails(spark):
    pace = bo.Pace()
    with pytest.raises(ValueError):
        bo.fit(data(spark).filter("false"), None, COLS, "y", tells=pace)
    assert not pace.reaches(1)


def test_joint_bins_give_the_sums_of_each_feature(spark, monkeypatch):
    """Features counted by their joint bin or each alone: the same trees."""
    groups = bo._groups([64, 2, 64, 26, 7, 5000], 4096)
    assert sorted(j for g in groups for j in g) == list(range(6)) and len(groups) == 3
    assert all(len(g) == 1 or math.prod([64, 2, 64, 26, 7, 5000][j] for j in g) <= 4096 for g in groups)
    d, trees = data(spark, 2000), []
    for cells in (1, 1 << 15):
        monkeypatch.setattr(bo, "CELLS", cells)
        trees.append(bo.fit(d, None, COLS, "y", categories=CATS, rounds=3, rate=0.3, depth=3).trees)
    for one, other in zip(*trees):
        assert one["splits"] == other["splits"] and one["values"] == pytest.approx(other["values"])


def test_a_fit_keeps_scores_and_no_second_copy_of_the_rows(spark):
    d = data(spark)
    ready = bo.prepare(d, None, COLS, "y", categories=CATS)
    run = bo._Fit(ready, ready.model, bo.make_loss("logistic"), [])
    run.add({"depth": 1, "splits": {"0": [1, [2]]}, "values": {"1": 0.5, "2": -0.25}})
    kept = [f for part in run.data.collect() for f in part]
    assert sum(len(f) for f in kept) == 400 and all(f.dtype == float and f.ndim == 1 for f in kept)
    assert sorted({round(v - ready.model.start, 6) for f in kept for v in f}) == [-0.25, 0.5]
    run.release()
    ready.release()
