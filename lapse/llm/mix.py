"""Mixing sources to target weights with a low-discrepancy source schedule.

1. Every source's documents form a stream of words in a seeded shuffled order.
2. ``targets`` divides the words of the mix among the sources by weight, capped
   at a number of epochs, with the excess shared again by weight.
3. ``schedule`` maps golden-ratio points through the cumulative targets: slot i
   goes to the source whose interval holds frac((i + 1) * phi).  A slot stands
   for one block of ``block`` words; the k-th slot of a source takes the k-th
   block of its (repeated) stream.  What the points leave short at the end
   (their discrepancy, a few blocks per source) is appended.
4. ``mix`` joins the blocks of the streams to the slots.

Only DataFrame functions are used.  Prefix sums and ranks are two-level
(``common.running``), so a source with a third of all rows stays spread.

Defined cases: null text has no words; a document without words is returned
with 0 words taken; null sources are one source, the last in order; repeated
rows are separate documents; an empty table gives an empty result; columns
other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapse.llm.common import WORD, bounded_join, bucket_count, running, shuffle_key, stage

# fractional part of the golden ratio and of 2^20 times it: frac(i * phi) is
# taken as frac((i div 2^20) * PHI_HI + (i mod 2^20) * PHI), exact enough for any i
PHI = (math.sqrt(5) - 1) / 2
PHI_HI = (PHI * (1 << 20)) % 1.0
GRID = 1024


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``sizes``: source, source_size (one row per source).  Adds weight (cycled over the sources in
    code-point order, null last), target (double) and goal (target in whole words).

    Water filling: in the order of cap / weight, a source is capped if its cap
    is at most its share of what the sources before it have left.
    The table has one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("weight"),
                     (F.col("source_size") * epochs).cast("double").alias("cap"),
                     (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).alias("all"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("left", F.col("all") - F.coalesce(
        F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weights", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", F.col("left") / F.col("weights")).withColumn("n", F.row_number().over(by))
    t = t.withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    t = t.withColumn("first_open", F.min(F.when(F.col("open"), F.col("n"))).over(W.partitionBy()))
    t = t.withColumn("fill", F.max(F.when(F.col("n") == F.col("first_open"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("n") >= F.col("first_open"), F.least(F.col("cap"), F.col("weight") * F.col("fill"))) \
              .otherwise(F.col("cap"))
    return t.select("source", "source_size", "weight", target.alias("target"),
                    F.floor(target + 0.5).cast("long").alias("goal"))


def schedule(tgt: DataFrame, block: int = 4096) -> DataFrame:
    """Slots of the mix: slot (position), src, snull, rank (from 0), from_word, to_word (of the source's
    repeated stream).  ``tgt`` as of ``targets``."""
    spark = tgt.sparkSession
    s = tgt.where("goal > 0").select(
        F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("snull"), "goal",
        F.ceil(F.col("goal") / block).cast("long").alias("need"))
    by = W.orderBy("snull", "src")
    cum = F.sum("goal").over(by.rowsBetween(W.unboundedPreceding, 0))
    s = stage(s.select("*", cum.alias("hi"), F.sum("goal").over(W.partitionBy()).alias("all"),
                       F.row_number().over(by).alias("nth")), "mix-sources")
    n_sources, n_slots = s.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    hi, lo = F.col("hi") / F.col("all"), (F.col("hi") - F.col("goal")) / F.col("all")
    cells = s.select("src", "snull", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(
        F.floor(lo * GRID), F.least(F.floor(hi * GRID), F.lit(GRID - 1)))).alias("cell"))
    i = F.col("id") + 1
    u = F.expr(f"((id + 1) div 1048576L) * {PHI_HI!r}D") + F.pmod(i, F.lit(1 << 20)) * F.lit(PHI)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (u - F.floor(u)).alias("u"))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("u") * GRID), F.lit(GRID - 1)))
    slots = bounded_join(slots, cells, ["cell"], GRID + 2 * n_sources) \
        .where("u >= lo and (u < hi or hi >= 1.0D)").select("slot", "src", "snull")
    # rank of a slot in its source: rows of a chunk are ranked, chunks get offsets
    chunk = max(256, math.isqrt(n_slots) + 1)
    slots = slots.withColumn("chunk", F.expr(f"slot div {chunk}L"))
    per = slots.groupBy("src", "snull", "chunk").count()
    offs = per.select("src", "snull", "chunk", F.coalesce(F.sum("count").over(
        W.partitionBy("src", "snull").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    local = slots.select("*", (F.row_number().over(
        W.partitionBy("src", "snull", "chunk").orderBy("slot")) - 1).alias("r"))
    drawn = local.join(offs, ["src", "snull", "chunk"]).select("slot", "src", "snull", (F.col("r") + F.col("off")).alias("rank"))
    have = per.groupBy("src", "snull").agg(F.sum("count").alias("have"))
    short = s.join(have, ["src", "snull"], "left").where("coalesce(have, 0) < need").select(
        "src", "snull", "nth", F.explode(F.expr("sequence(coalesce(have, 0L), need - 1L)")).alias("rank"))
    tail = short.select((F.lit(n_slots) + F.col("rank") * F.lit(n_sources) + F.col("nth")).alias("slot"),
                        "src", "snull", "rank")
    every = bounded_join(drawn.unionByName(tail), s.select("src", "snull", "goal", "need"), ["src", "snull"], n_sources)
    return every.where("rank < need").select(
        "slot", "src", "snull", "rank", (F.col("rank") * block).alias("from_word"),
        F.least((F.col("rank") + 1) * block, F.col("goal")).alias("to_word"))


def streams(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, its place in its source's shuffled stream
    (nth, start) and source_size."""
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                    shuffle_key("doc_id", seed=seed).alias("h"))
    d = stage(d, "mix-docs")
    keyed = d.select("*", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("snull"))
    return running(keyed, ["src", "snull"], "h", ["doc_id", "size"], {"nth": F.lit(1), "start": F.col("size")},
                   bucket_count(d.count()), {"source_size": "start"})


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, epochs: int = 2, block: int = 4096,
        seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, pieces).

    documents: one row per input row with doc_id, source, size, source_size,
    target, taken (words the mix takes, repeats counted), first_epochs (how
    often its first word is taken), src, snull and nth (its key).
    pieces: the mix itself: slot, src, snull, nth, doc_id, from_word and
    to_word (words of the document), in the order of (slot, from position).
    """
    pos = stage(streams(docs, seed), "mix-streams")
    tgt = stage(targets(pos.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs),
                "mix-targets")
    n_sources = tgt.count()
    slots = schedule(tgt, block)
    t = tgt.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("snull"), "target", "goal")
    pos = bounded_join(pos, t, ["src", "snull"], n_sources)
    # each pass over the stream a document is in, cut at the borders of blocks
    runs = pos.where("size > 0").select(
        "src", "snull", "nth", "doc_id", "size", "goal",
        F.explode(F.expr(f"transform(sequence(0L, {epochs - 1}L), e -> e * source_size + start)")).alias("at"))
    cut = runs.where("at < goal").select(
        "src", "snull", "nth", "doc_id", "size", "at",
        F.explode(F.expr(f"sequence(at div {block}L, (least(at + size, goal) - 1L) div {block}L)")).alias("rank"))
    got = cut.join(slots, ["src", "snull", "rank"])
    pieces = got.select("slot", "src", "snull", "nth", "doc_id",
                        (F.greatest("at", "from_word") - F.col("at")).alias("from_word"),
                        (F.least(F.col("at") + F.col("size"), F.col("to_word")) - F.col("at")).alias("to_word"))
    per = pieces.groupBy("src", "snull", "nth").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
        F.sum((F.col("from_word") == 0).cast("long")).alias("first_epochs"))
    out = pos.join(per, ["src", "snull", "nth"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("first_epochs", F.lit(0)).cast("long").alias("first_epochs"), "src", "snull", "nth")
    return out, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in whole documents, with the columns of ``docs``: a row for each time the mix takes a
    document's first word (none, one or ``epochs`` times; documents without words go along once).

    Rows that share doc_id, source and size are taken equally often: their mean, rounded half up.
    """
    per, _ = mix(docs, **options)
    keep = per.groupBy("doc_id", "source", "size").agg(
        F.floor(F.avg(F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("first_epochs"))) + 0.5).alias("_times"))
    k = keep.where("_times > 0").select(F.col("doc_id").alias("_k"), F.col("source").alias("_ks"),
                                        F.col("size").alias("_kn"), "_times")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"),
                    F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    j = d.join(k, F.col("_id").eqNullSafe(F.col("_k")) & F.col("_source").eqNullSafe(F.col("_ks"))
               & (F.col("_size") == F.col("_kn")))
    j = j.select("_row", F.explode(F.expr("sequence(1L, _times)")).alias("_copy"))
    return j.select("_row.*")
