"""Sharding by k-d tree partitioning.

A node splits along its widest metadata dimension (extent relative to the
whole table's) at the weighted median, the weight being bytes, until every leaf
is one shard of about the target bytes.  Leaf counts that are no power of
two split in proportion.

The weighted median is found exactly and without gathering values: every
row has a 62-bit key in the split dimension (28 bits of the scaled value, then
bits of a hash of doc_id that cut a run of equal values), and the key is
fixed 16 bits at a time by sums of bytes per (node, next 16 bits).  Each pass
moves at most 65,536 sums a node; the driver sees one row per node, which the
number of shards bounds.

Defined cases: null text weighs 1 byte, like empty text; null metadata
sorts first; equal rows may part; an empty table gives an empty result;
columns that are neither doc_id, text nor a dimension are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.common import bounded_join, bucket_count, discarding, numbered, running, shuffle_key, stage
from lapse.operators.ranking import row_rank

VALUE_BITS, HASH_BITS, ROW_BITS = 28, 24, 10
KEY_BITS = VALUE_BITS + HASH_BITS + ROW_BITS
DIGIT = 16
#: Metadata that the tree may split on; strings count by their rank among the distinct values.
DIMENSIONS = ("n_chars", "doc_id", "source", "lang")


def _row_key(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the strings of ``column`` replaced by their rank among the distinct ones (null stays null)."""
    distinct = rows.where(F.col(column).isNotNull()).select(column).distinct()
    rank = stage(row_rank(distinct, [column], "_rank").select(column, F.col("_rank").cast("double").alias("_rank")), "shard-ranks")
    return bounded_join(rows, rank, [column], rank.count(), "left").drop(column).withColumnRenamed("_rank", column)


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
              dimensions: tuple = DIMENSIONS, names: list[str] = ()) -> DataFrame:
    """One row per document: doc_id, row_key (hash of the whole row), size (UTF-8 bytes + 1), text_crc32
    (unsigned, of the empty text where null), shard (0 .. shards - 1), slot (gapless from 0 within the shard) and
    the columns ``names``, which go along.

    Give ``n_shards`` or ``target_bytes`` (shards = total bytes / target, rounded up).
    """
    fields = {f.name: f for f in docs.schema}
    dims = [d for d in dimensions if d in fields]
    strings = [d for d in dims if isinstance(fields[d].dataType, T.StringType)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", _row_key(docs).alias("row_key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shuffle_key("doc_id").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("m"), *names,
        *[F.col(f"`{d}`").cast("string" if d in strings else "double").alias(f"v{i}") for i, d in enumerate(dims)])
    for i, d in enumerate(dims):
        rows = _ranked(stage(rows, "shard-strings"), f"v{i}") if d in strings else rows
    rows = stage(rows, "shard-rows")
    ext = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n"),
                   *[F.struct(F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi")).alias(f"e{i}")
                     for i in range(len(dims))]).first()
    if n_shards is None:
        n_shards = max(1, -(-ext["bytes"] // target_bytes))
    # coordinates 1 .. 2^28 - 1 by the table's extents, null 0
    top = (1 << VALUE_BITS) - 2

    def scaled(i: int):
        lo, hi = ext[f"e{i}"]["lo"], ext[f"e{i}"]["hi"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(f"v{i}") - F.lit(lo)) / F.lit(hi - lo) * top).cast("long") + 1, F.lit(0))

    low = F.shiftleft(F.col("h").bitwiseAND((1 << HASH_BITS) - 1), ROW_BITS) + F.col("m").bitwiseAND((1 << ROW_BITS) - 1)
    cur = rows.select("doc_id", "row_key", "size", "text_crc32", "h", *names, low.alias("low"), F.lit(0).cast("long").alias("node"),
                      *[scaled(i).alias(f"c{i}") for i in range(len(dims))])
    leaves = {0: (0, n_shards)}          # node -> (first shard, number of shards)
    while any(n > 1 for _, n in leaves.values()):
        cur, leaves = _split(cur, leaves, len(dims))
    shard = _lookup(cur, {k: (first,) for k, (first, _) in leaves.items()}, ["shard"])
    shard = shard.select("doc_id", "row_key", "size", "text_crc32", "h", *names, F.coalesce("shard", F.lit(0)).cast("int").alias("shard"))
    out = running(stage(shard, "shard-leaves"), ["shard"], "h", ["doc_id", "row_key"], {"slot": F.lit(1)},
                  bucket_count(ext["n"]))
    return out.select("doc_id", "row_key", "size", "text_crc32", "shard", "slot", *names)


def _lookup(df: DataFrame, by_node: dict, names: list[str]) -> DataFrame:
    """Join per-node constants; the table has one row per node, at most the number of shards."""
    schema = "node long, " + ", ".join(f"{n} long" for n in names)
    t = df.sparkSession.createDataFrame([(k, *map(int, v)) for k, v in by_node.items()], schema)
    return df.join(F.broadcast(t), "node", "left")


def _split(cur: DataFrame, leaves: dict, n_dims: int) -> tuple[DataFrame, dict]:
    """Split every node that holds more than one shard."""
    todo = {k: n for k, (_, n) in leaves.items() if n > 1}
    active = cur.where(F.col("node").isin(*todo)) if len(todo) < len(leaves) else cur
    per = active.groupBy("node").agg(F.sum("size").alias("bytes"), *[
        (F.max(f"c{i}") - F.min(f"c{i}")).alias(f"w{i}") for i in range(n_dims)]).collect()
    state = {}                            # node -> [dim, prefix, bytes wanted on the left]
    for r in per:
        widths = [r[f"w{i}"] for i in range(n_dims)]
        n = todo[r["node"]]
        state[r["node"]] = [widths.index(max(widths)) if widths else 0, 0, r["bytes"] * (n // 2) / n]
    if not state:                         # no rows in any of them
        return cur, {k: (first, 1) for k, (first, _) in leaves.items()}
    dim = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"c{i}")) for i in range(n_dims)], F.lit(0))
    keyed = _lookup(active, {k: (v[0],) for k, v in state.items()}, ["dim"]).select(
        "node", "size", (F.shiftleft(dim, HASH_BITS + ROW_BITS) + F.col("low")).alias("key"))
    at = KEY_BITS
    while at > 0:
        step = min(DIGIT, at)
        at -= step
        k = _lookup(keyed, {n: (v[1],) for n, v in state.items()}, ["prefix"])
        k = k.where(F.shiftright("key", at + step) == F.col("prefix"))
        digit = F.shiftright("key", at).bitwiseAND((1 << step) - 1)
        hist = k.groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"))
        run = hist.select("node", "digit", "bytes", F.sum("bytes").over(
            W.partitionBy("node").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
        goals = _goals(run, state)
        # the digit whose bytes pass the goal; where a half digit is nearer, the last pass decides
        hit = goals.where("coalesce(before, 0) <= goal").groupBy("node").agg(
            F.max(F.struct("digit", F.coalesce("before", F.lit(0)).alias("before"), "bytes")).alias("x"))
        for r in hit.collect():
            s, x = state[r["node"]], r["x"]
            s[1] = (s[1] << step) + x["digit"]
            s[2] -= x["before"]
            if at == 0 and s[2] < x["bytes"] / 2:
                s[1] -= 1                 # the row at the border weighs more than half: it goes right
    cut = {n: (v[0], v[1]) for n, v in state.items()}
    moved = _lookup(cur, cut, ["dim", "border"])
    key = F.shiftleft(dim, HASH_BITS + ROW_BITS) + F.col("low")
    moved = moved.withColumn("node", F.when(F.col("border").isNull(), F.col("node") * 2)
                             .otherwise(F.col("node") * 2 + (key > F.col("border")).cast("long"))).drop("dim", "border")
    after = {}
    for k, (first, n) in leaves.items():
        if k in cut:
            after[2 * k], after[2 * k + 1] = (first, n // 2), (first + n // 2, n - n // 2)
        else:
            after[2 * k] = (first, 1 if k in todo else n)
    return stage(moved, "shard-level"), after


def _goals(run: DataFrame, state: dict) -> DataFrame:
    t = run.sparkSession.createDataFrame([(k, float(v[2])) for k, v in state.items()], "node long, goal double")
    return run.join(F.broadcast(t), "node")


def sharded_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with shard and slot (columns of these names are replaced).  Equal rows get one place each: rows
    are named, the names are sharded, and the texts move once, to meet the places."""
    d, names = numbered(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]))
    with discarding(docs.sparkSession) as keep:
        needed = [c for c in docs.columns if c in ("doc_id", "text", *options.get("dimensions", DIMENSIONS))]
        d0 = d.select(*[F.col(f"_row.`{c}`").alias(c) for c in needed], *names)
        places = keep(kd_shards(d0, names=names, **options).select(*names, "shard", "slot"), "shard-places")
    return d.join(places, names).select("_row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, slots_per_file: int = 100_000, **options) -> None:
    """Write the documents to ``path``/shard=N/, in files of ``slots_per_file`` documents in the order of their slots."""
    d = sharded_documents(docs, **options).withColumn("_file", F.expr(f"slot div {slots_per_file}"))
    d.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
