"""Oracle SQL for lapse.plans.q_core."""

from lapse.plans.oracle_base import AGE_CASE, CUTOFF, R, with_base
from lapse.params import TEST_PARAMS as P
import datetime as _dt

SNAP_LO = f"DATE '{(P.cutoff - _dt.timedelta(days=29)).isoformat()}'"
REC = P.recent_days
PRIOR = P.prior_days

DERIVED_DOUBLES = ("fwd_rev", "avg_payment_plan_days", "avg_actual_amount_paid", "is_auto_renew_rate",
                   "is_cancel_rate", "avg_discount_rate", "most_recent_actual_amount_paid",
                   "total_secs_sum", "recent_secs", "prior_secs", "avg_song_completion",
                   "total_secs_log", "log1p_fwd_rev", "avg_num_unq_songs", "recent_engagement_ratio",
                   "secs_trend_recent_vs_prior", "numunq_trend_recent_vs_prior")
FEATURE_INTS = ("msno", "ref_date", "is_churn", "city", "bd", "gender", "registered_via",
                "registration_init_time", "num_transactions", "num_distinct_payment_methods",
                "payment_method_id", "most_recent_payment_plan_days", "most_recent_is_auto_renew",
                "most_recent_is_cancel", "days_since_last_login", "days_since_last_cancel",
                "daily_active_days", "recent_daily_active_days", "sum25", "sum50", "sum75", "sum985",
                "sum100", "sum_unq", "recent_numunq", "prior_numunq", "registration_tenure_days")

# the corrected population with its groups, and each user's newest paid row before the reference date
_people = """people AS (
  SELECT c.*, coalesce(m.gender, 'unknown') AS gender, m.registered_via, """ + AGE_CASE.format(c="m.bd") + """ AS age_bucket
  FROM churn_corrected c LEFT JOIN members m USING (msno))"""

_newest = """newest_paid AS (
  SELECT c.msno, c.is_churn, (list({'r': p.is_auto_renew, 'c': p.is_cancel, 'd': p.payment_plan_days}
                              ORDER BY p.txn_dt DESC, p.txn_id DESC))[1] AS n
  FROM churn_corrected c JOIN paid p ON p.msno = c.msno AND p.txn_dt <= c.ref_date GROUP BY c.msno, c.is_churn)"""


def _rate(group: str, source: str) -> str:
    return f"SELECT {group}, count(*) AS n, {R('avg(is_churn) * 100', 6, 'churn_pct')} FROM {source} GROUP BY 1"


ORACLE = {
    "churn_revenue_by_segment": with_base(f"""
SELECT coalesce(m.gender, 'unknown') AS gender, {AGE_CASE.format(c='m.bd')} AS age_bucket,
       count(*) AS n, {R('avg(l.is_churn) * 100', 4, 'churn_pct')},
       {R('avg(coalesce(l.fwd_rev, 0.0))', 4, 'avg_fwd_rev')},
       {R('sum(coalesce(l.fwd_rev, 0.0))', 4, 'total_fwd_rev')}
FROM lab l LEFT JOIN members m USING (msno) GROUP BY 1, 2"""),
    "ref_dates": with_base("SELECT msno, start_dt, ref_date FROM refs"),
    "ref_dates_unguarded": with_base(f"""
SELECT msno, max(expire_dt) AS ref_date FROM paid WHERE expire_dt <= {CUTOFF} GROUP BY msno"""),
    "churn_labels": with_base("SELECT msno, ref_date, is_churn FROM lab"),
    "churn_labels_paid_renewal": with_base("SELECT msno, ref_date, is_churn FROM churn_corrected"),
    "forward_revenue": with_base(f"SELECT msno, {R('fwd_rev')} FROM lab WHERE fwd_rev IS NOT NULL"),
    "survival_table": with_base(
        "SELECT msno, start_dt, last_expire_dt, duration_days, event_churned FROM survival"),
    "signed_duration": with_base(f"""
SELECT msno, {R('CASE WHEN event_churned = 1 THEN CAST(duration_days AS DOUBLE) + 0.5 '
               'ELSE -(CAST(duration_days AS DOUBLE) + 0.5) END', 6, 'cox_target')} FROM survival"""),
    "population_bias": with_base(f"""
WITH {_people},
t AS (SELECT gender, is_churn, ref_date BETWEEN {SNAP_LO} AND {CUTOFF} AS seen FROM people)
SELECT gender, count(*) AS n_corrected, {R('avg(is_churn) * 100', 6, 'churn_pct_corrected')},
       nullif(count(*) FILTER (WHERE seen), 0) AS n_snapshot,
       {R('avg(is_churn) FILTER (WHERE seen) * 100', 6, 'churn_pct_snapshot')} FROM t GROUP BY gender"""),
    "population_comparison": with_base(f"""
WITH {_people}, {_newest},
t AS (SELECT p.is_churn, p.ref_date BETWEEN {SNAP_LO} AND {CUTOFF} AS seen, gender, CAST(registered_via AS VARCHAR) AS channel,
             age_bucket, 'renew=' || n.r || ', cancel=' || n.c AS flags FROM people p LEFT JOIN newest_paid USING (msno)),
u AS (SELECT 'all' AS dimension, 'all' AS value, is_churn, seen FROM t
      UNION ALL SELECT 'gender', gender, is_churn, seen FROM t UNION ALL SELECT 'channel', channel, is_churn, seen FROM t
      UNION ALL SELECT 'age', age_bucket, is_churn, seen FROM t UNION ALL SELECT 'flags', flags, is_churn, seen FROM t)
SELECT dimension, value, count(*) AS n_corrected, {R('avg(is_churn) * 100', 6, 'churn_pct_corrected')},
       nullif(count(*) FILTER (WHERE seen), 0) AS n_snapshot,
       {R('avg(is_churn) FILTER (WHERE seen) * 100', 6, 'churn_pct_snapshot')},
       {R('(1.0 - CAST(count(*) FILTER (WHERE seen) AS DOUBLE) / count(*)) * 100', 6, 'pct_missed')} FROM u GROUP BY 1, 2"""),
    "corrupted_expiry_profile": with_base(f"""
SELECT count(*) AS n_txn, CAST(count_if(expire_dt < txn_dt) AS BIGINT) AS n_corrupt,
       CAST(count_if(expire_dt < txn_dt AND is_cancel = 1) AS BIGINT) AS n_corrupt_cancel,
       CAST(count_if(actual_amount_paid <= 0) AS BIGINT) AS n_free,
       {R('avg(CASE WHEN expire_dt < txn_dt THEN 1.0 ELSE 0.0 END) * 100', 6, 'pct_corrupt')}
FROM txn"""),
    "pre_ref_transactions": with_base(f"""
SELECT t.msno, t.txn_id, t.txn_dt, r.ref_date, {R('t.actual_amount_paid')}
FROM txn t JOIN refs r USING (msno) WHERE t.txn_dt <= r.ref_date"""),
    "txn_aggregates": with_base(f"""
SELECT msno, num_transactions, {R('avg_payment_plan_days')}, {R('avg_actual_amount_paid')}, {R('is_auto_renew_rate')},
       {R('is_cancel_rate')}, {R('avg_discount_rate')}, num_distinct_payment_methods
FROM profile WHERE num_transactions > 0"""),
    "latest_transaction": with_base(f"""
SELECT msno, newest.m AS payment_method_id, newest.d AS most_recent_payment_plan_days,
       {R('newest.a', 6, 'most_recent_actual_amount_paid')}, newest.r AS most_recent_is_auto_renew,
       newest.c AS most_recent_is_cancel FROM profile WHERE newest IS NOT NULL"""),
    "recency": with_base("SELECT msno, days_since_last_login, days_since_last_cancel FROM features"),
    "engagement_window": with_base("SELECT msno, daily_active_days, recent_daily_active_days, " + ", ".join(
        [R(c) for c in ("total_secs_sum", "recent_secs", "prior_secs")]
        + [f"CAST({c} AS BIGINT) AS {c}" for c in ("sum25", "sum50", "sum75", "sum985", "sum100", "sum_unq", "recent_numunq",
                                                   "prior_numunq")]) + " FROM profile WHERE daily_active_days > 0"),
    "user_feature_table": with_base(
        "SELECT " + ", ".join(list(FEATURE_INTS) + [R(c) for c in DERIVED_DOUBLES]) + " FROM derived"),
    "registration_tenure": with_base(
        "SELECT msno, registration_init_time, registration_tenure_days FROM derived"),
    "engagement_ratios": with_base(
        "SELECT msno, " + ", ".join(R(c) for c in ("avg_song_completion", "total_secs_log", "log1p_fwd_rev",
                                                   "avg_num_unq_songs", "recent_engagement_ratio"))
        + " FROM derived"),
    "listening_trend": with_base(
        f"SELECT msno, {R('secs_trend_recent_vs_prior')}, {R('numunq_trend_recent_vs_prior')} FROM derived"),
    "txn_frequency": with_base(f"""
SELECT msno, {R('num_transactions / (greatest(CAST(registration_tenure_days AS DOUBLE), 0.0) + 1.0)', 6,
              'txn_frequency')} FROM derived"""),
    "age_quality": with_base(f"""
SELECT count(*) AS n_members, CAST(count_if(bd BETWEEN 1 AND 100) AS BIGINT) AS n_valid,
       {R('avg(CASE WHEN bd BETWEEN 1 AND 100 THEN 1.0 ELSE 0.0 END) * 100', 6, 'valid_pct')},
       min(bd) AS min_bd, max(bd) AS max_bd,
       {R('avg(CASE WHEN bd BETWEEN 1 AND 100 THEN bd END)', 6, 'avg_valid_bd')}
FROM members"""),
    "registrations_by_year": with_base("""
SELECT CAST(floor(registration_init_time / 10000) AS BIGINT) AS reg_year, count(*) AS n
FROM members WHERE floor(registration_init_time / 10000) BETWEEN 1990 AND 2017 GROUP BY 1"""),
    "pay_vs_churn_disagreement": with_base(f"""
SELECT is_churn, CAST(CASE WHEN coalesce(fwd_rev, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_fwd_rev,
       count(*) AS n, {R('count(*) * 100.0 / (SELECT count(*) FROM lab)', 6, 'pct')},
       CAST(CASE WHEN (is_churn = 1 AND coalesce(fwd_rev, 0) > 0) OR (is_churn = 0 AND NOT coalesce(fwd_rev, 0) > 0)
            THEN 1 ELSE 0 END AS BIGINT) AS disagrees
FROM lab GROUP BY 1, 2, 5"""),
    "no_activity_share": with_base(f"""
SELECT count(*) AS n_users, CAST(count_if(a.msno IS NULL) AS BIGINT) AS n_no_activity,
       {R('avg(CASE WHEN a.msno IS NULL THEN 1.0 ELSE 0.0 END) * 100', 6, 'pct_no_activity')}
FROM refs r LEFT JOIN (SELECT DISTINCT msno FROM user_logs) a ON r.msno = a.msno"""),
    "churn_by_gender": with_base(f"WITH {_people} {_rate('gender', 'people')}"),
    "churn_by_channel": with_base(
        f"WITH {_people} {_rate('registered_via', 'people')} ORDER BY n DESC, registered_via NULLS FIRST LIMIT 8"),
    "churn_by_age": with_base(f"WITH {_people} {_rate('age_bucket', 'people')}"),
    "churn_by_renew_cancel": with_base(f"""
WITH {_newest}, k AS (SELECT is_churn, n.r AS is_auto_renew, n.c AS is_cancel FROM newest_paid)
SELECT is_auto_renew, is_cancel, 'renew=' || is_auto_renew || ', cancel=' || is_cancel AS segment,
       count(*) AS n, {R('avg(is_churn) * 100', 6, 'churn_pct')} FROM k GROUP BY ALL"""),
    "churn_by_plan_length": with_base(f"""
WITH {_newest}, k AS (SELECT is_churn, CASE WHEN n.d > 90 THEN '91+' WHEN n.d > 31 THEN '32-90' WHEN n.d > 0 THEN '1-31'
                                            ELSE 'other' END AS plan_bucket FROM newest_paid)
{_rate('plan_bucket', 'k')}"""),
    "label_balance": with_base(f"""
SELECT is_churn, count(*) AS n, {R('count(*) * 100.0 / (SELECT count(*) FROM lab)', 6, 'pct')}
FROM lab GROUP BY 1"""),
    "behaviour_by_label": with_base(f"""
WITH use AS (SELECT lab.msno, lab.is_churn, u.log_dt, u.total_secs, u.num_unq FROM lab LEFT JOIN user_logs u USING (msno)),
per AS (SELECT msno, is_churn, nullif(count(DISTINCT log_dt), 0) AS days, sum(total_secs) / 3600 AS hours, sum(num_unq) AS songs
        FROM use GROUP BY ALL)
SELECT is_churn, count(*) AS n, {R('avg(days)', 6, 'avg_active_days')}, {R('avg(hours)', 6, 'avg_total_hours')},
       {R('avg(songs)', 6, 'avg_unq_songs')} FROM per GROUP BY is_churn"""),
    "scale_overview": with_base("""
SELECT min(log_dt) AS min_date, max(log_dt) AS max_date, count(DISTINCT msno) AS n_users, count(*) AS n_rows
FROM user_logs"""),
    "range_quality": with_base(f"""
SELECT {R('min(total_secs)', 6, 'min_secs')}, {R('max(total_secs)', 6, 'max_secs')},
       CAST(count_if(total_secs < 0) AS BIGINT) AS n_negative, CAST(count_if(total_secs > 86400) AS BIGINT) AS n_over_a_day,
       count(*) AS n_total FROM user_logs"""),
    "candidate_features": with_base(f"""
SELECT msno, {R('std_dev_daily_secs')},
       CAST(days_since_last_login IS NULL AS BIGINT) AS never_logged_in,
       CAST(days_since_last_cancel IS NULL AS BIGINT) AS never_canceled
FROM features"""),
    "events_engagement": """
WITH ev AS (SELECT user_id AS msno, CAST(ts AS DATE) AS log_dt, event_type, value FROM events),
er AS (SELECT msno, max(log_dt) AS ref_date FROM ev WHERE event_type = 'purchase' GROUP BY msno)
SELECT e.msno, r.ref_date,
       count(DISTINCT e.log_dt) FILTER (WHERE e.log_dt >= r.ref_date - 29) AS active_days,
       count(DISTINCT e.log_dt) FILTER (WHERE e.log_dt >= r.ref_date - 6) AS recent_active_days,
       count(*) FILTER (WHERE e.log_dt >= r.ref_date - 29) AS n_events,
       round(sum(e.value) FILTER (WHERE e.log_dt >= r.ref_date - 29), 6) AS value_sum,
       round(sum(e.value) FILTER (WHERE e.log_dt >= r.ref_date - 6), 6) AS recent_value,
       round(sum(e.value) FILTER (WHERE e.log_dt >= r.ref_date - 29 AND e.log_dt < r.ref_date - 6), 6) AS prior_value,
       max(e.log_dt) AS last_event_dt,
       round((coalesce(sum(e.value) FILTER (WHERE e.log_dt >= r.ref_date - 6), 0) / 7.0)
             / (coalesce(sum(e.value) FILTER (WHERE e.log_dt >= r.ref_date - 29 AND e.log_dt < r.ref_date - 6), 0)
                / 23.0 + 1), 6) AS value_trend
FROM ev e JOIN er r USING (msno) WHERE e.log_dt <= r.ref_date GROUP BY e.msno, r.ref_date""",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t})) AS n_columns FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                  "documents", "embeddings", "pages", "benchmark", "labels", "conversations")),
    "logs_csv_ingest": with_base("""
SELECT CAST(strftime(log_dt, '%Y%m') AS BIGINT) AS month, count(*) AS n, CAST(sum(num_unq) AS BIGINT) AS num_unq,
       CAST(sum(CAST(round(total_secs * 100) AS BIGINT)) AS BIGINT) AS secs_100, count(DISTINCT day(log_dt) % 2) AS n_files, CAST(2 AS BIGINT) AS n_runs
FROM user_logs GROUP BY 1"""),
    "events_incremental_ingest": """
SELECT event_id, user_id, event_type, round(value, 6) AS value, props,
       CAST(strftime(CAST(ts AS DATE), '%Y%m%d') AS BIGINT) AS day FROM events""",
}
