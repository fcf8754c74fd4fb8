"""Declared schemas of the raw subscription tables (never inferred)."""

from pyspark.sql.types import (ByteType, FloatType, IntegerType, ShortType, StringType,
                               StructField, StructType)

MEMBERS = StructType([
    StructField("msno", StringType()),
    StructField("city", ByteType()),
    StructField("bd", ShortType()),
    StructField("gender", StringType()),
    StructField("registered_via", ByteType()),
    StructField("registration_init_time", IntegerType()),
])

TRANSACTIONS = StructType([
    StructField("msno", StringType()),
    StructField("payment_method_id", ByteType()),
    StructField("payment_plan_days", ShortType()),
    StructField("plan_list_price", ShortType()),
    StructField("actual_amount_paid", IntegerType()),
    StructField("is_auto_renew", ByteType()),
    StructField("transaction_date", IntegerType()),
    StructField("membership_expire_date", IntegerType()),
    StructField("is_cancel", ByteType()),
])

USER_LOGS = StructType([
    StructField("msno", StringType()),
    StructField("date", IntegerType()),
    StructField("num_25", IntegerType()),
    StructField("num_50", IntegerType()),
    StructField("num_75", IntegerType()),
    StructField("num_985", IntegerType()),
    StructField("num_100", IntegerType()),
    StructField("num_unq", IntegerType()),
    StructField("total_secs", FloatType()),
])

LABELS = StructType([
    StructField("msno", StringType()),
    StructField("is_churn", ByteType()),
])
