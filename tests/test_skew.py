"""One key holding a third of all rows: results stay exact (brute force) and
every aggregate is partial before its shuffle."""
import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from lapse.operators import features as fe
from lapse.operators import population as pop
from lapse.params import Params

P = Params(last_date=dt.date(2017, 2, 28), fwd_window_days=59, grace_days=30, engagement_days=30, recent_days=7)
BASE = dt.date(2015, 1, 1)


def _rows():
    random.seed(11)
    rows, tid = [], 0
    users = [("hot", 3000)] + [(f"u{i}", 10) for i in range(600)]
    for u, n in users:
        for _ in range(n):
            t = BASE + dt.timedelta(days=random.randint(0, 780))
            paid = 0.0 if random.random() < 0.1 else float(random.choice([99, 149, 180]))
            exp = t - dt.timedelta(days=3) if random.random() < 0.02 else t + dt.timedelta(days=30)
            rows.append((u, tid, 1, 30, 180.0, paid, 1, int(random.random() < 0.1), t, exp))
            tid += 1
    return rows


def _brute(df: pd.DataFrame):
    out = {}
    cut = P.cutoff
    for u, g in df.groupby("msno"):
        p = g[g.actual_amount_paid > 0]
        ok = p[(p.expire_dt >= p.txn_dt) & (p.expire_dt <= cut)]
        if ok.empty:
            continue
        ref = ok.expire_dt.max()
        ren = g[(g.txn_dt > ref) & (g.txn_dt <= ref + dt.timedelta(days=P.grace_days))]
        fw = g[(g.txn_dt > ref) & (g.txn_dt <= ref + dt.timedelta(days=P.fwd_window_days))]
        pre = g[g.txn_dt <= ref]
        out[u] = (ref, int(ren.empty), float(fw.actual_amount_paid.sum()) if not fw.empty else None, len(pre))
    return out


def test_hot_key_labels_and_features_match_brute_force(spark):
    rows = _rows()
    cols = ["msno", "txn_id", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid",
            "is_auto_renew", "is_cancel", "txn_dt", "expire_dt"]
    txn = spark.createDataFrame(rows, cols).repartition(8)
    refs = pop.ref_dates(txn, P.cutoff)
    lab = {r.msno: (r.ref_date, r.is_churn, r.fwd_rev) for r in pop.labels(txn, refs, 30, 59).collect()}
    tf = {r.msno: r.num_transactions for r in fe.txn_features(txn, refs, P).collect()}
    exp = _brute(pd.DataFrame(rows, columns=cols))
    assert set(lab) == set(exp) and "hot" in lab
    for u, (ref, churn, fwd, npre) in exp.items():
        assert lab[u][0] == ref and lab[u][1] == churn and tf[u] == npre
        assert (lab[u][2] is None and fwd is None) or abs(lab[u][2] - fwd) < 1e-6
    # map-side partial aggregation precedes every exchange of the label pass
    plan = pop.labels(txn, refs, 30, 59)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "partial_sum" in plan
