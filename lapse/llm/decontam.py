"""Benchmark decontamination by spaced-seed hashing.

Tokens are maximal runs of letters and digits of the lower-cased text.  A
spaced seed hashes the tokens of a window of SPAN that a fixed mask keeps; the
tokens it ignores may differ.  Test and training windows meet in a join on
the hash, and every hit is verified on its own diagonal: some window of
``verify`` tokens (the whole item if shorter) that holds the seed must agree in at
least ``share`` of its tokens.

Every item with a token is looked up.  Items of fewer than ``verify`` tokens have masks over their whole
length instead, so that every pattern of substitutions that ``share`` allows is found; so do the
MASKS for windows of 13 tokens and more.

Only DataFrame functions are used.  The documents stream past the seeds; the
seed table is broadcast after its rows have been counted and, beyond the
bound, joined by shuffled hashes instead.

Defined cases: null text and null items have no tokens; equal items are
reported under each item_id; repeated rows give the pair once; an empty table on
either side gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import BROADCAST_ROWS, stage

#: Span of a seed and the offsets that each mask keeps.
SPAN = 8
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 6, 7), (0, 2, 3, 4, 5, 7), (0, 1, 3, 5, 6, 7))
#: These masks find any two substitutions in so many tokens (a test enumerates them).
WHOLE = 13

TOKEN = r"[\p{L}\p{N}]+"
#: Seeds are broadcast up to so many rows (a row holds at most SPAN + 2 * verify longs).
SEED_ROWS = 50_000


def tokens(text):
    """64-bit hashes of the tokens of a text, an array (empty if there are none)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def whole_masks(n: int, allowed: int) -> tuple:
    """Masks over all ``n`` tokens that find any ``allowed`` substitutions: the places are cut into allowed + 2 runs, and
    each mask leaves out that many of them."""
    parts = [tuple(range(n * k // (allowed + 2), n * (k + 1) // (allowed + 2))) for k in range(allowed + 2)] if allowed else [tuple(range(n))]
    return tuple(sorted({tuple(sorted(x for p in kept for x in p)) for kept in combinations(parts, len(parts) - allowed)}))


def _allowed(n: int, share: float) -> int:
    """Substitutions that a passage of n tokens may have."""
    return next(e for e in range(n, -1, -1) if n - e >= share * n)


def _windows(df: DataFrame, keep: list[str], kinds: list[tuple]) -> DataFrame:
    """Rows (keep, w, at, len, seed) for each seed of each window.  A kind is (number, window length, masks, condition on size(w))."""
    out = None
    for kind, n, masks, fits in kinds:
        wide = df.where(fits).select(*keep, "w", F.explode(F.expr(f"sequence(0, size(w) - {n})")).alias("at"))
        seeds = F.array(*[F.expr(f"xxhash64({kind}, {m}, " + ", ".join(f"w[at + {k}]" for k in mask) + ")") for m, mask in enumerate(masks)])
        rows = wide.select(*keep, "w", "at", F.lit(n).alias("len"), F.explode(seeds).alias("seed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, verify: int = 13, share: float = 0.8,
                 least: int = 1) -> DataFrame:
    """Pairs (doc_id, text_hash, item_id, n_equal, n_compared, doc_at, item_at) of documents that hold
    a passage of an item; the pair's best window (most equal tokens, then earliest).

    Items of fewer than ``verify`` tokens are looked up whole, with masks of their own length that find
    every pattern of substitutions that ``share`` allows; ``least`` may leave out items with fewer tokens than that.
    """
    items = stage(benchmark.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") >= least), "decontam-items")
    long = MASKS if verify >= WHOLE and _allowed(verify, share) <= 2 else whole_masks(verify, _allowed(verify, share))
    span = SPAN if long is MASKS else verify
    short = sorted(r[0] for r in items.select(F.size("w").alias("n")).where(f"n > 0 and n < {verify}").distinct().collect())
    side = verify - 1
    windows = _windows(items, ["item_id"], [(0, span, long, f"size(w) >= {verify}")] + [
        (n, n, whole_masks(n, _allowed(n, share)), f"size(w) = {n}") for n in short])
    seeds = stage(windows.distinct().select(
        "seed", "item_id", F.col("at").alias("item_at"), F.col("len").alias("item_len"),
        F.least("at", F.lit(side)).alias("item_left"), F.least(F.size("w"), F.lit(verify)).alias("n_compared"),
        F.expr(f"slice(w, at - least(at, {side}) + 1, least(at, {side}) + least(size(w) - at, len + {side}))").alias("item_near")),
        "decontam-seeds")
    n = seeds.count()
    # the generator has the tokens made once, not in the filter and again below it
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(tokens(F.col("text")))).alias("w"))
    windows = _windows(d, ["doc_id", "text_hash"], [(0, span, long, f"size(w) >= {span}")] + [
        (n, n, whole_masks(n, _allowed(n, share)), f"size(w) >= {n}") for n in short])
    if n <= SEED_ROWS:
        hits = windows.join(F.broadcast(seeds), "seed")
    else:
        # hashes alone are shuffled; the tokens of documents with hits come back afterwards
        found = stage(windows.drop("w").join(seeds.hint("merge"), "seed"), "decontam-hits")
        own = d.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t"), "w")
        hits = own.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_t")))
    hits = hits.where("len = item_len")
    # both sides of the diagonal around the seed; the generator cuts the document's part out where the join
    # is, so that no hit carries the whole document along
    hits = hits.withColumn("left", F.least("at", "item_left"))
    right = F.least(F.size("w") - F.col("at"), F.size("item_near") - F.col("item_left"))
    near = F.slice("w", F.col("at") - F.col("left") + 1, F.col("left") + right)
    hits = hits.select("doc_id", "text_hash", "item_id", "len", "left", "at", "item_at", "item_left", "item_near", "n_compared",
                       F.explode(F.array(near)).alias("near"))
    same = F.zip_with("near", F.slice("item_near", F.col("item_left") - F.col("left") + 1, F.size("near")),
                      lambda a, b: (a == b).cast("int"))
    # windows of n_compared tokens that hold the seed
    hits = hits.select("doc_id", "text_hash", "item_id", "len", "left", "at", "item_at", "n_compared",
                       same.alias("same")).where("size(same) >= n_compared")
    best = F.expr("""array_max(transform(
        sequence(greatest(0, left + len - n_compared), least(left, size(same) - n_compared)),
        s -> struct(aggregate(slice(same, s + 1, n_compared), 0, (a, x) -> a + x) AS n, -s AS s)))""")
    hits = hits.withColumn("best", best).where(F.col("best.n") >= F.lit(share) * F.col("n_compared"))
    top = F.max(F.struct(F.col("best.n").alias("n"), F.col("n_compared"),
                         (-(F.col("at") - F.col("left") - F.col("best.s"))).alias("d"),
                         (-(F.col("item_at") - F.col("left") - F.col("best.s"))).alias("i")))
    return hits.groupBy("doc_id", "text_hash", "item_id").agg(top.alias("x")).select(
        "doc_id", "text_hash", "item_id", F.col("x.n").cast("long").alias("n_equal"),
        F.col("x.n_compared").cast("long").alias("n_compared"), (-F.col("x.d")).cast("long").alias("doc_at"),
        (-F.col("x.i")).cast("long").alias("item_at"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = stage(contaminated(docs, benchmark, **options).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t")).distinct(), "decontam-bad")
    n = bad.count()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id0"),
                    F.xxhash64("text").alias("_t0"))
    b = F.broadcast(bad) if n <= BROADCAST_ROWS else bad
    return d.join(b, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_t0") == F.col("_t")), "left_anti").select("_row.*")
