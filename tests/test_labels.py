import datetime as dt

from pyspark.sql import functions as F

from lapse.operators import population as pop

CUT = dt.date(2016, 12, 31)


def _refs(txn, **kw):
    return {r.msno: r.ref_date for r in pop.ref_dates(txn, **kw).collect()}


def _labels(txn, refs, paid_renewal=True):
    return {r.msno: (r.is_churn, r.fwd_rev) for r in
            pop.labels(pop.paid(txn) if paid_renewal else txn, refs, 30, 59).collect()}


def test_free_trial_is_not_a_reference_cycle(label_txn):
    assert "trial" not in _refs(label_txn, cutoff_date=CUT)


def test_clean_churner(label_txn):
    refs = pop.ref_dates(label_txn, CUT)
    lab = _labels(label_txn, refs)
    assert _refs(label_txn, cutoff_date=CUT)["churner"] == dt.date(2016, 12, 1)
    assert lab["churner"] == (1, None)   # no forward-revenue row


def test_clean_renewal(label_txn):
    refs = pop.ref_dates(label_txn, CUT)
    assert _refs(label_txn, cutoff_date=CUT)["renewer"] == dt.date(2016, 12, 1)
    assert _labels(label_txn, refs)["renewer"] == (0, 150)


def test_grace_boundary(label_txn):
    lab = _labels(label_txn, pop.ref_dates(label_txn, CUT))
    assert lab["grace30"][0] == 0     # renewal on ref + 30: inside
    assert lab["grace31"][0] == 1     # renewal on ref + 31: outside


def test_forward_window_boundary(label_txn):
    lab = _labels(label_txn, pop.ref_dates(label_txn, CUT))
    assert lab["revenue"] == (1, 200)  # ref + 59 counts, ref + 60 does not


def test_corrupted_expiry_guard(label_txn):
    assert _refs(label_txn, cutoff_date=CUT, guard=True)["corrupt"] == dt.date(2016, 11, 1)
    assert _refs(label_txn, cutoff_date=CUT, guard=False)["corrupt"] == dt.date(2016, 12, 10)


def test_cutoff(label_txn):
    assert "beyond" not in _refs(label_txn, cutoff_date=CUT)
    assert _refs(label_txn, cutoff_date=None)["beyond"] == dt.date(2017, 1, 15)


def test_zero_amount_renewal_depends_on_rule(label_txn):
    refs = pop.ref_dates(label_txn, CUT)
    assert _labels(label_txn, refs, paid_renewal=True)["freerenew"][0] == 1
    assert _labels(label_txn, refs, paid_renewal=False)["freerenew"][0] == 0


def test_fused_groupby_equals_reference_join_form(label_txn):
    """D1 as one groupBy equals the reference's fan-out join form."""
    p = pop.paid(label_txn)
    v = p.filter(F.col("expire_dt") >= F.col("txn_dt")).select("msno", F.col("expire_dt").alias("v_exp"))
    join_form = (p.join(v, "msno").filter(F.col("v_exp") <= F.lit(CUT)).groupBy("msno")
                 .agg(F.min("txn_dt").alias("start_dt"), F.max("v_exp").alias("ref_date")))
    ours = pop.ref_dates(label_txn, CUT)
    assert sorted(map(tuple, join_form.collect())) == sorted(map(tuple, ours.collect()))


def test_latest_row_tie_break_is_deterministic(label_txn):
    from lapse.operators.features import latest_per
    r = latest_per(label_txn.filter(F.col("msno") == "sameday"), "msno", ["txn_dt", "txn_id"],
                   ["payment_method_id"]).collect()
    assert len(r) == 1 and r[0].payment_method_id == 4   # later txn_id wins the same-day tie


def test_survival_table(label_txn):
    s = {r.msno: r for r in pop.survival_table(label_txn, dt.date(2017, 2, 28), 30).collect()}
    assert s["churner"].duration_days == 30 and s["churner"].event_churned == 1
    assert s["beyond"].event_churned == 1       # 2017-01-15 + 30 <= 2017-02-28
    assert s["revenue"].event_churned == 0      # last expiry 2017-03-01: censored


def test_txn_id_is_deterministic(spark):
    from lapse.sources.schemas import TRANSACTIONS
    rows = [("u", 1, 30, 149, 149, 1, 20161101, 20161201, 0), ("u", 1, 30, 149, 149, 1, 20161101, 20161201, 1)]
    raw = spark.createDataFrame(rows, TRANSACTIONS)
    a = [r.txn_id for r in pop.with_txn_id(raw).orderBy("is_cancel").collect()]
    b = [r.txn_id for r in pop.with_txn_id(raw.repartition(3)).orderBy("is_cancel").collect()]
    assert a == b and len(set(a)) == 2
