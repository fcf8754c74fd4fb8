"""Adapters: the driver's TPC-H-like tables re-read as a subscription domain.

The driver tables carry no subscription semantics, so these projections
define one.  The same rules are written as SQL in ``lapse.plans.oracle`` so the
DuckDB oracle sees identical inputs.  The modulo expressions below derive
attributes of a row (price list, expiry corruption, free months); none of
them removes rows: every adapter reads its whole source table.

- transactions <- orders     (one subscription payment per order)
- members      <- customer   (one member per customer)
- user_logs    <- lineitem joined to orders, one row per (customer, ship day)
- event log    <- events     (the natural log shape, used as is)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.dates import to_ymd_int

# Derivation rules of the adapters.
LIST_PRICE_ZERO_EVERY = 13      # o_orderkey % 13 = 0 -> plan_list_price 0
FREE_TXN_EVERY = 17             # o_orderkey % 17 = 0 -> actual_amount_paid 0
CANCEL_EVERY = 3                # status F and o_orderkey % 3 = 0 -> cancel
CORRUPT_EXPIRY_EVERY = 97       # o_orderkey % 97 = 0 -> expiry 5 days before txn
REGISTRATION_BASE = dt.date(1994, 1, 1)
REGISTRATION_SPREAD_DAYS = 900
GENDER_BY_SEGMENT = (("BUILDING", "male"), ("AUTOMOBILE", "female"))


def transactions(orders: DataFrame) -> DataFrame:
    o = orders
    d = F.substring("o_orderpriority", 1, 1).cast("bigint")
    key = F.col("o_orderkey")
    txn_dt = F.to_date("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("msno"),
        key.alias("txn_id"),
        d.alias("payment_method_id"),
        (d * 30).alias("payment_plan_days"),
        F.when(key % LIST_PRICE_ZERO_EVERY == 0, F.lit(0.0))
         .otherwise(F.col("o_totalprice") * (F.lit(1.0) + (key % 4).cast("double") * F.lit(0.05)))
         .alias("plan_list_price"),
        F.when(key % FREE_TXN_EVERY == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
         .alias("actual_amount_paid"),
        (F.col("o_orderstatus") != "F").cast("bigint").alias("is_auto_renew"),
        ((F.col("o_orderstatus") == "F") & (key % CANCEL_EVERY == 0)).cast("bigint").alias("is_cancel"),
        txn_dt.alias("txn_dt"),
        F.when(key % CORRUPT_EXPIRY_EVERY == 0, F.date_sub(txn_dt, 5))
         .otherwise(F.date_add(txn_dt, (d * 30).cast("int"))).alias("expire_dt"),
    )


def members(customer: DataFrame) -> DataFrame:
    c = customer
    g = None
    for seg, label in GENDER_BY_SEGMENT:
        cond = F.col("c_mktsegment") == seg
        g = F.when(cond, F.lit(label)) if g is None else g.when(cond, F.lit(label))
    reg = F.date_add(F.lit(REGISTRATION_BASE), (F.col("c_custkey") % REGISTRATION_SPREAD_DAYS).cast("int"))
    return c.select(
        F.col("c_custkey").alias("msno"),
        F.col("c_nationkey").cast("bigint").alias("city"),
        F.floor(F.col("c_acctbal") / 50).cast("bigint").alias("bd"),
        g.alias("gender"),
        (F.col("c_custkey") % 6 + 3).cast("bigint").alias("registered_via"),
        to_ymd_int(reg).cast("bigint").alias("registration_init_time"),
    )


def user_logs(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Daily listening rows: one per (customer, ship day); (msno, log_dt) is unique."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_shipdate")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"))
    j = li.join(o, "l_orderkey")
    ln = F.col("l_linenumber")
    q = F.col("l_quantity")

    def qsum(cond):
        return F.sum(F.when(cond, q).otherwise(F.lit(0.0))).cast("bigint")

    return (j.groupBy(F.col("o_custkey").alias("msno"), F.to_date("l_shipdate").alias("log_dt"))
            .agg(qsum(ln == 1).alias("num_25"), qsum(ln == 2).alias("num_50"),
                 qsum(ln == 3).alias("num_75"), qsum(ln == 4).alias("num_985"),
                 qsum(ln.between(5, 7)).alias("num_100"),
                 F.count_distinct("l_partkey").cast("bigint").alias("num_unq"),
                 F.sum("l_extendedprice").alias("total_secs")))


def event_log(events: DataFrame) -> DataFrame:
    """The driver's events table as an activity log: (msno, log_dt, event_type, value)."""
    return events.select(F.col("user_id").alias("msno"), F.to_date("ts").alias("log_dt"),
                         "event_type", "value", "event_id")


def customer_score(customer: DataFrame) -> DataFrame:
    """Deterministic stand-in probability per customer (msno, p_churn_raw):
    (c_acctbal - min) / (max - min) floored to a multiple of 1/1024 (ties on
    purpose; binary-exact, so sums of scores do not depend on summation order).
    min / max come from one aggregate over the whole customer table."""
    r = customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).first()
    lo, hi = F.lit(r["lo"]), F.lit(r["hi"])
    p = F.floor((F.col("c_acctbal") - lo) / (hi - lo) * 1024) / 1024
    return customer.select(F.col("c_custkey").alias("msno"), p.cast("double").alias("p_churn_raw"))


def score_columns(labels: DataFrame, customer: DataFrame, last_paid: DataFrame) -> DataFrame:
    """Labelled users with stand-in model outputs for keys that need scores:
    p_churn_raw (customer_score), e_amount = last pre-ref paid amount (E[amount | pay]),
    e_fwd_rev = e_amount * (1 - p_churn_raw) (a hurdle-style expected revenue)."""
    out = (labels.join(customer_score(customer), "msno", "left")
           .withColumn("p_churn_raw", F.coalesce(F.col("p_churn_raw"), F.lit(0.0)))
           .join(last_paid, "msno", "left")
           .withColumn("e_amount", F.coalesce(F.col("last_paid"), F.lit(0.0))))
    return out.withColumn("e_fwd_rev", F.col("e_amount") * (F.lit(1.0) - F.col("p_churn_raw"))).drop("last_paid")
