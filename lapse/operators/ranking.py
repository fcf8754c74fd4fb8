"""Global order statistics without a single-partition window.

``cumulative`` is the one primitive.  It range-partitions the rows on a total order
(a value shared by a third of the rows is split by the tie-break columns), notes
each row's partition number and writes the result once.  Running sums are then taken
within each noted partition and shifted by the totals of the earlier ones, a
table with one row per partition, which is broadcast.  Ranks, percentiles,
exact quantiles, ROC / PR prefix sums and stratified positions are all built
from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.session import materialize

#: A side of a join that has been counted is broadcast up to so many rows.
SMALL_ROWS = 100_000


def _n_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _spec(c) -> tuple[str, bool]:
    """'col' -> ascending (nulls first); 'col desc' -> descending (nulls last)."""
    parts = c.split()
    return parts[0], (len(parts) > 1 and parts[1].lower() == "desc")


def _sort_col(name: str, desc: bool) -> Column:
    return F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_first()


def join_small(df: DataFrame, small: DataFrame, keys, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a small table on ``keys``, where NULL equals NULL.

    ``small`` is written and counted (unless ``rows`` gives a bound that holds by
    construction) and broadcast up to SMALL_ROWS, so the big side stays where it is;
    a larger table is joined by shuffle, with AQE splitting skewed keys.
    """
    if rows is None:
        small = materialize(small)
        rows = small.count()
    s = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(F.broadcast(s) if rows <= SMALL_ROWS else s, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def cumulative(df: DataFrame, order_cols, sum_cols=(), partition_cols=(), prefix: str = "cum_",
               row_col: str = "_row", n_parts: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` (``cum_<c>``) and a 1-based row
    position ``row_col`` in the order ``order_cols`` ('col' or 'col desc'),
    restarting for every combination of ``partition_cols`` (NULL is a group).
    ``partition_cols + order_cols`` must be a total order (end with a unique
    tie-break) for positions to be defined.

    The range-partitioned rows are written before anything is derived from their
    partition numbers, so a recomputation after a lost executor reads the
    same numbers.  A group that goes on over several partitions is the first one
    in each but its first, so at most one offset per partition is not zero.
    """
    specs = [(c, False) for c in partition_cols] + [_spec(c) for c in order_cols]
    order = [_sort_col(n, d) for n, d in specs]
    r = df.repartitionByRange(n_parts or _n_parts(df), *order).withColumn("_pid", F.spark_partition_id())
    r = materialize(r)
    group = ["_pid", *partition_cols]
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = r.select("*", F.count(F.lit(1)).over(w).alias("_lrow"), *[F.sum(c).over(w).alias(f"_l_{c}") for c in sum_cols])
    tot = r.groupBy(*group).agg(F.count(F.lit(1)).alias("_trow"), *[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wo = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group, F.sum("_trow").over(wo).alias("_orow"), *[F.sum(f"_t_{c}").over(wo).alias(f"_o_{c}") for c in sum_cols])
    j = join_small(local, off.filter(F.col("_orow") > 0), group, "left", rows=1)      # one row per partition at most
    out = j.withColumn(row_col, (F.col("_lrow") + F.coalesce(F.col("_orow"), F.lit(0))).cast("bigint"))
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_l_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0)))
    return out.drop("_pid", "_lrow", "_orow", *[f"_{k}_{c}" for c in sum_cols for k in ("l", "o")])


def row_rank(df: DataFrame, order_cols, name: str = "rank", partition_cols=()) -> DataFrame:
    """Sequential 1-indexed rank of a total order."""
    return cumulative(df, order_cols, (), partition_cols, row_col=name)


def value_table(df: DataFrame, value: str, sums: dict | None = None, by=()) -> DataFrame:
    """Distinct values with their multiplicity (ties collapsed) and optional sums."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [e.alias(k) for k, e in (sums or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


def avg_rank(df: DataFrame, value: str, name: str = "rank_avg", descending: bool = False,
             by=()) -> DataFrame:
    """Average rank under ties (pandas ``rank()``), NULL for NULL values."""
    vt = value_table(df, value, by=by)
    c = cumulative(vt, [f"{value} desc" if descending else value], ["_n"], by)
    ranks = c.select(*[F.col(x).alias(f"_by{i}") for i, x in enumerate(by)], F.col(value).alias("_value"),
                     (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias(name))
    on = F.col(value) == F.col("_value")
    for i, x in enumerate(by):
        on = on & F.col(x).eqNullSafe(F.col(f"_by{i}"))
    return df.join(ranks, on, "left").drop("_value", *[f"_by{i}" for i in range(len(by))])


def pct_rank(df: DataFrame, value: str, name: str = "pct_rank", descending: bool = False) -> DataFrame:
    """Percentile rank with averaged ties (pandas ``rank(pct=True)``) (F2):
    average rank / number of non-null values.  Not ``percent_rank``/``cume_dist``."""
    n = df.select(F.count(value)).scalar()
    return avg_rank(df, value, "_avg", descending).withColumn(name, F.col("_avg") / n).drop("_avg")


def quantiles(df: DataFrame, value: str, probs, by=(), approx: bool = False,
              accuracy: int = 10000) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``) (H8).

    Distributed: distinct values get their [first, last] 0-based positions from
    ``cumulative``; each target position p * (n - 1) is then picked out by a
    conditional aggregate, so no group is ever gathered into one task.
    Returns (by..., p, q).

    ``approx=True`` (opt-in, for very large inputs where exactness is not
    needed): one ``percentile_approx`` aggregate per group instead.
    """
    if approx:
        arr = F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs], accuracy)
        g = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(arr.alias("_qs"))
        return g.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"),
                                                    F.col("_qs").alias("q"))).alias("_pq")) \
            .select(*by, F.col("_pq.p").alias("p"), F.col("_pq.q").alias("q"))
    vt = value_table(df, value, by=by)
    c = cumulative(vt, [value], ["_n"], by).select(
        *by, value, (F.col("cum__n") - F.col("_n")).alias("_first"), (F.col("cum__n") - 1).alias("_last"))
    if by:
        c = join_small(c, vt.groupBy(*by).agg(F.sum("_n").alias("_total")), list(by))
    else:
        c = c.withColumn("_total", vt.select(F.sum("_n")).scalar())
    v = F.col(value).cast("double")
    aggs, outs = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda r: (r >= F.col("_first")) & (r <= F.col("_last"))
        aggs += [F.max(F.when(inside(lo), v)).alias(f"_lo{i}"), F.max(F.when(inside(hi), v)).alias(f"_hi{i}"),
                 F.max(pos - lo).alias(f"_fr{i}")]
        q = F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        outs.append(F.struct(F.lit(float(p)).alias("p"), q.alias("q")))
    g = c.groupBy(*by).agg(*aggs)
    return g.select(*by, F.explode(F.array(*outs)).alias("_pq")).select(*by, "_pq.p", "_pq.q")


def wide_quantiles(df: DataFrame, cols, probs, accuracy: int = 10_000) -> DataFrame:
    """(column, p, q): exact quantiles, with linear interpolation, of several numeric columns; no row is sorted or moved.

    One aggregate of bounded summaries gives, for every target, two values that lie at most 5 n / accuracy places below and above it.
    A second pass counts what is below each bracket and the distinct values inside, a few
    thousandths of the rows or, with ties, a few values.  The places are read off those counts.  A column of up to ``accuracy`` rows is its own bracket.
    """
    cols, probs, d = list(cols), [float(p) for p in probs], 4.0 / accuracy
    at = [x for p in probs for x in (max(0.0, p - d), min(1.0, p + d))]
    vals = {c: F.col(c).cast("double") for c in cols}
    stat = df.agg(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, at, accuracy).alias("q")).alias(f"s{i}")
                    for i, v in enumerate(vals.values())]).first()
    want = []                                 # column, prob, bracket, n: a few numbers per target
    for i, c in enumerate(cols):
        n, q = stat[f"s{i}"]["n"], stat[f"s{i}"]["q"] or []
        for j, p in enumerate(probs):
            whole = n <= accuracy
            want.append((c, p, None if whole or p <= d else q[2 * j], None if whole or p >= 1 - d else q[2 * j + 1], n))
    inside = F.array_compact(F.array(*[
        F.when(vals[c].isNotNull() & (F.lit(True) if lo is None else vals[c] >= lo) & (F.lit(True) if hi is None else vals[c] <= hi),
               F.struct(F.lit(k).alias("k"), vals[c].alias("v"))) for k, (c, _, lo, hi, _) in enumerate(want)]))
    counts = df.select(F.explode(inside).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("m"))
    below = df.agg(*[(F.lit(0).cast("bigint") if lo is None else F.count_if(vals[c] < lo)).alias(f"b{k}")
                     for k, (c, _, lo, _, _) in enumerate(want)]).first()
    targets = df.sparkSession.createDataFrame(
        [(k, c, p, n, below[f"b{k}"], p * (n - 1)) for k, (c, p, _, _, n) in enumerate(want)],
        "k int, column string, p double, n long, below long, pos double")
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.select("k", "v", "m", F.sum("m").over(w).alias("upto")).join(F.broadcast(targets), "k")
    first, last = F.col("below") + F.col("upto") - F.col("m"), F.col("below") + F.col("upto") - 1

    def holds(r):
        return F.max(F.when((r >= first) & (r <= last), F.col("v")))

    g = run.groupBy("k").agg(holds(F.floor("pos")).alias("lo"), holds(F.ceil("pos")).alias("hi"))
    frac = F.col("pos") - F.floor("pos")
    return targets.join(F.broadcast(g), "k", "left").select(
        "column", "p", (F.col("lo") + frac * (F.col("hi") - F.col("lo"))).alias("q"))


def running_best(df: DataFrame, order_col: str, value_col: str, mode: str = "max",
                 by=(), name: str = "best_so_far") -> DataFrame:
    """Running best of a sequence per study (F5).  Trials per study are few
    (a search budget), so a window partitioned by the study is the right tool."""
    w = Window.partitionBy(*by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = F.max if mode == "max" else F.min
    return df.withColumn(name, f(value_col).over(w))
