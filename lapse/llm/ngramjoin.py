"""N-gram Jaccard self-join over a token-group matrix.

A document's set holds the hashes of its distinct k-word shingles (64 bits); documents
with equal sets are one class and are compared once.  Two classes link when
100 * |A n B| >= percent * |A u B|.

Candidates.  In one global order of the tokens (rare first, by hashed counts
over the whole corpus), two classes that link share a token among the first
n - ceil(percent * n / 100) + 1 of each, their openers.  At the first token they
share, what follows in either set bounds their overlap; that bound is part of the joins.

1. Groups of similar documents.  Each opener has a centre (the first of its classes in
   an order of its own, so that the openers of one large group have different centres); the classes that link with a centre form groups with it
   (connected components), so a group of any number of copies costs a comparison per member and opener.
2. Token-group matrix.  What is left are classes of different groups that
   share an opener.  Those with the same most shared opener form blocks of similar documents, of bounded size; the matrix
   holds (opener, block), a query is a class of the smaller group.  For each block
   that a query meets in the matrix, the block's token union bounds the overlap: a member can
   only link if the union holds at least percent % of the query's tokens.  Only blocks that pass are
   opened and their members compared.  Blocks of a few members are bounded member by member, by histograms.

Links found in 1 and 2 give the components.  Pairs are first held against
64-bucket histograms of their sets, whose distance is at most the size of the symmetric
difference; then the sets themselves are intersected.  All steps are exact.

Defined cases: A-Z are lower-cased, other letters stay; null and blank texts have an
empty set and link with nothing, not even with each other; texts with fewer
than k words have one shingle, the whole sequence; repeated rows are one class; null
doc_ids stay null and take part; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm import wordhash as wh
from lapse.llm.common import BROADCAST_ROWS, arrow_rows, bounded_join, components, discarding, stage

COUNT_BITS = 20          # hashed counters of the token order
COUNTERS = 1 << 13       # counters that travel in one row
WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}    # bytes of a counter: as few as a row's largest one needs
BLOCK_SHINGLES = 1 << 14  # shingles of a block of the matrix, about
PARTS = 64               # buckets of a set's histogram
FEW = 8                  # members up to which a block of the matrix is compared one by one
SLICE = 1 << 18          # bytes of text hashed at a time: some forty times that are held meanwhile
BATCH_ROWS = 1000        # rows of an Arrow batch, held by the executor and by its Python worker


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, off = wh.utf8(texts)
    for i, j in wh.slices(off, SLICE):
        d, o = wh.LOWER[data[off[i]:off[j]]], off[i:j + 1] - off[i]
        start, end, first = wh.words(d, o)
        h = wh.word_hashes(d, start, end)
        full = wh.window_hashes(h, k)
        for a, b in zip(first[:-1], first[1:]):
            n = b - a
            yield np.unique(full[a:b - k + 1]) if n >= k else wh.window_hashes(h[a:b], n) if n else np.zeros(0, np.uint64)


def _key(s: np.ndarray) -> int:
    return int(wh.mix(np.add.reduce(wh.mix(s + wh.U(1)), dtype=np.uint64).reshape(1) + wh.U(len(s))).view(np.int64)[0])


def _packed(count: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Counters in rows of COUNTERS each, without the rows that hold zeros only."""
    rows = count.reshape(-1, COUNTERS)
    top = rows.max(1)
    for i in np.flatnonzero(top).tolist():
        yield i, rows[i].astype(next(t for t in WIDTHS.values() if top[i] <= np.iinfo(t).max)).tobytes()


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, cls) of documents and (bucket, counts) of the hashed counters of shingles."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << COUNT_BITS, np.int64)
        names = ["doc_id", "n", "cls", "bucket", "counts"]
        for b in batches:
            n, cls = [], []
            for s in _sets(b.column("text"), k):
                n.append(len(s))
                cls.append(_key(s) if len(s) else None)
                np.add.at(count, (s >> wh.U(64 - COUNT_BITS)).astype(np.int64), 1)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(rows, pa.int32()),
                 pa.nulls(rows, pa.binary())], names)
        for i, raw in _packed(count):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()),
                 pa.array([raw], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n long, cls long, bucket int, counts binary")


def _levels(scan: DataFrame) -> np.ndarray:
    """Order of the tokens by their hashed counts: half powers of two (2^20 bytes)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for i, raw in zip(b.column("bucket").to_pylist(), b.column("counts")):
                raw = raw.as_buffer()
                total[i] = total.get(i, 0) + np.frombuffer(raw, WIDTHS[len(raw) // COUNTERS]).astype(np.int64)
        for i, n in total.items():
            level = np.minimum(2 * np.log2(np.maximum(n, 1).astype(float)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()])], ["bucket", "levels"])

    out = np.zeros((1 << COUNT_BITS) // COUNTERS * COUNTERS, np.uint8).reshape(-1, COUNTERS)
    rows = scan.where("bucket is not null").select("bucket", "counts").repartition("bucket").mapInArrow(add, "bucket int, levels binary")
    for r in stage(rows, "join-levels").collect():
        out[r["bucket"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def _details(docs: DataFrame, k: int, percent: int, levels: np.ndarray, what: str) -> DataFrame:
    """Per document with a set: cls, n and openers (what = "openers") or the whole set ("set")."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, arr, part = [], [], [], []

            def out():
                return pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(arr, pa.list_(pa.int64())),
                     pa.array(part, pa.list_(pa.int32()))], ["cls", "n", "tokens", "parts"])

            held = 0
            for s in _sets(b.column("text"), k):
                if not len(s):
                    continue
                n.append(len(s))
                cls.append(_key(s))
                part.append(np.bincount((s & wh.U(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
                if what == "openers":
                    m = len(s) - -(-percent * len(s) // 100) + 1
                    level = shared.value[(s >> wh.U(64 - COUNT_BITS)).astype(np.int64)]
                    s = s[np.argsort(level, kind="stable")[:m]]
                arr.append(s.view(np.int64))
                held += len(s)
                if held > 1 << 19:
                    yield out()
                    n, cls, arr, part, held = [], [], [], [], 0
            yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        details, "cls long, n long, tokens array<long>, parts array<int>")


def _compatible(percent: int):
    """Sizes and histograms allow a link of x and y."""
    sizes = (F.col("n_x") * 100 >= F.col("n_y") * percent) & (F.col("n_y") * 100 >= F.col("n_x") * percent)
    apart = F.aggregate(F.zip_with("parts_x", "parts_y", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, x: a + x)
    # 100 * inter >= p * union, with |A xor B| >= apart: apart * (100 + p) <= (100 - p) * (|A| + |B|)
    return sizes & (apart.cast("long") * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent))


def _reach(n_x: str, rest_x: str, n_y: str, rest_y: str, percent: int):
    """Sets of n tokens, of which ``rest`` are left from the first shared one on, may still link."""
    return F.expr(f"cast(least({rest_x}, {rest_y}) as bigint) * {100 + percent} >= ({n_x} + {n_y}) * {percent}")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that sizes and histograms allow."""
    c = classes.select("cls", "n", "parts")
    p = pairs.join(c.toDF("x", "n_x", "parts_x"), "x").join(c.toDF("y", "n_y", "parts_y"), "y")
    return p.where(_compatible(percent)).select("x", "y")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """The pairs (x, y) that link by their whole sets.  Only documents of the pairs' classes are read again."""
    with discarding(docs.sparkSession) as keep:          # the sets go as soon as they are compared
        pairs = stage(pairs, "join-pairs")
        s = _whole_sets(pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))),
                        docs, classes, k, percent, levels)
        return keep(_linked(pairs, s, percent), "join-links")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.toDF("x", "n_x", "s_x"), "x").join(sets.toDF("y", "n_y", "s_y"), "y")
    inter = F.size(F.array_intersect("s_x", "s_y")).cast("long")
    return both.where(inter * 100 >= (F.col("n_x") + F.col("n_y") - inter) * percent).select("x", "y")


def _whole_sets(cls: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """cls, n, tokens (the whole set), staged, of the given classes (repeats allowed)."""
    want = stage(classes.join(cls.distinct(), "cls", "left_semi").select("cls", "doc_id"), "join-want")
    rows = want.count()
    ids = want.select(F.col("doc_id").alias("_id")).distinct()
    # one long as the key (null as 0, told apart by the condition): the driver builds the broadcast in a fraction of the memory
    zero = F.lit(0).cast("long")
    on = (F.coalesce(F.col("doc_id").cast("long"), zero) == F.coalesce("_id", zero)) & (F.isnull("doc_id") == F.isnull("_id"))
    some = docs.select("doc_id", "text").join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, on, "left_semi")
    got = _details(some, k, percent, levels, "set").select("cls", "n", "tokens")
    got = stage(bounded_join(got, want.select("cls"), ["cls"], rows, "left_semi"), "join-sets")
    # rows that repeat doc_id and text give their class twice
    return got if got.select("cls").distinct().count() == got.select("cls").count() else stage(got.dropDuplicates(["cls"]), "join-sets")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    named = _named(docs, k, percent)
    low = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(low, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _named(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document, staged: doc_id, n_shingles, cls (key of its set, null if empty), component (of classes)."""
    with discarding(docs.sparkSession) as keep, arrow_rows(docs.sparkSession, BATCH_ROWS):
        return keep(_components(docs, k, percent), "join-named")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    scan = stage(_scan(docs, k), "join-scan")
    levels = _levels(scan)
    each = scan.where("bucket is null").select("doc_id", F.col("n").alias("n_shingles"), "cls")
    openers = _details(docs, k, percent, levels, "openers")
    first = each.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    classes = stage(openers.dropDuplicates(["cls"]).join(first, "cls"), "join-classes")

    entry = classes.select("cls", "n", F.posexplode("tokens").alias("pos", "token")).select(
        "cls", "token", (F.col("n") - F.col("pos")).cast("int").alias("rest"))
    order = F.xxhash64("cls", "token").alias("order")
    # every opener moves twice: no column moves that the others give (two orders are two classes)
    shared = entry.select("token", order).groupBy("token").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first <> last")
    shared = stage(entry.join(shared.select("token", "first"), "token").select("token", "cls", "rest", order, "first"), "join-shared")

    # 1. groups: every class against the centres of its openers
    size = classes.select("cls", "n")
    centre = shared.where("order = first").join(size, "cls").select(
        "token", F.col("cls").alias("y"), F.col("n").alias("n_low"), F.col("rest").alias("rest_low"))
    centred = shared.where("order <> first").join(size, "cls").join(centre, "token")
    centred = centred.where(_reach("n", "rest", "n_low", "rest_low", percent)).select(
        F.greatest("cls", "y").alias("x"), F.least("cls", "y").alias("y")).distinct()
    links = _verified(_near(centred, classes, percent), docs, classes, k, percent, levels)
    comp = stage(components(links.toDF("a", "b"), "join-groups"), "join-group")

    # 2. openers that different groups share
    grouped = shared.select("token", "cls", "rest").join(comp.select(F.col("id").alias("cls"), "component"), "cls", "left").select(
        "token", "cls", "rest", F.coalesce("component", "cls").alias("grp"))
    mixed = grouped.groupBy("token").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1")
    grouped = stage(grouped.join(mixed.select("token"), "token", "left_semi"), "join-mixed")
    more = _matrix_links(grouped, comp, docs, classes, k, percent, levels)
    every = links.unionByName(more)
    final = components(every.toDF("a", "b"), "join-final")

    return each.join(final.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))


def _matrix_links(grouped: DataFrame, comp: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int,
                  levels) -> DataFrame:
    """Links between classes of different groups that share an opener, by the token-group matrix.

    Classes whose most shared opener is the same are alike and form blocks of bounded size, linked or not.  Of two classes
    the one of the smaller group asks.  An opener costs its classes times its blocks, not its classes squared.
    """
    member = classes.select("cls", "n").join(comp.select(F.col("id").alias("cls"), "component"), "cls", "left").select(
        "cls", "n", F.coalesce("component", "cls").alias("grp"))
    size = member.groupBy("grp").agg(F.sum("n").alias("shingles"))
    member = member.join(size, "grp")
    heat = grouped.groupBy("token").agg(F.count("*").alias("heat"))
    home = grouped.join(heat, "token").groupBy("cls").agg(F.max(F.struct("heat", "token")).getField("token").alias("home"))
    member = stage(member.join(home, "cls"), "join-homes")
    load = member.groupBy("home").agg(F.sum("n").alias("load"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("cls"), F.ceil(F.col("load") / BLOCK_SHINGLES)))
    member = stage(member.join(load, "home").select("cls", "n", F.struct("shingles", "grp").alias("rank"), block.alias("block")), "join-members")
    e = stage(grouped.select("token", "cls", "rest").join(member, "cls"), "join-entries")
    matrix = e.groupBy("token", "block").agg(F.max("rank").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"),
                                             F.max("rest").alias("most_rest"))
    # classes of an opener's largest group never ask by it
    top = matrix.groupBy("token").agg(F.max("top").alias("top"))
    query = e.join(top, "token").where("rank < top").select(
        "token", F.col("cls").alias("x"), F.col("n").alias("n_x"), F.col("rest").alias("rest_x"), F.col("rank").alias("rank_x"))
    met = query.join(matrix, "token").where(
        F.expr(f"rank_x < top and n_x * 100 >= least * {percent} and most * 100 >= n_x * {percent}")
        & F.expr(f"cast(least(rest_x, most_rest) as bigint) * {100 + percent} >= (n_x + least) * {percent}"))
    met = met.groupBy("x", "block").agg(F.first("n_x").alias("n_x"), F.first("rank_x").alias("rank_x"))
    blocks = member.groupBy("block").agg(F.count("*").alias("members"))
    met = stage(met.join(blocks, "block"), "join-met-blocks")
    # the members of a small block are held against the query by their histograms, which for so few bound the
    # overlap closer than their union does
    few = met.where(F.col("members") <= FEW).select("x", "rank_x", "block").join(member.select("block", F.col("cls").alias("y"), "rank"), "block")
    few = few.where("rank_x < rank").select("x", "y")
    # bound: the union of a block's tokens against the query's
    many = met.where(F.col("members") > FEW).select("x", "rank_x", "block")
    inside = stage(member.join(many.select("block").distinct(), "block", "left_semi").select("block", F.col("cls").alias("y"), F.col("rank").alias("rank_y")),
                   "join-inside")
    with discarding(docs.sparkSession) as keep:
        sets = _whole_sets(many.select(F.col("x").alias("cls")).unionByName(inside.select(F.col("y").alias("cls"))),
                           docs, classes, k, percent, levels)
        union = stage(sets.join(inside.select(F.col("y").alias("cls"), "block"), "cls").groupBy("block").agg(
            F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union")), "join-unions")
        asked = many.join(sets.toDF("x", "n_x", "s_x"), "x").join(union, "block")
        opened = keep(asked.where(F.size(F.array_intersect("s_x", "union")).cast("long") * 100 >= F.col("n_x") * percent).select(
            "x", "rank_x", "block"), "join-opened")
    pairs = few.unionByName(opened.join(inside, "block").where("rank_x < rank_y").select("x", "y")).distinct()
    return _verified(_near(pairs, classes, percent), docs, classes, k, percent, levels)


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of near-duplicates: the one with the smallest doc_id (null last),
    of several texts with that doc_id the one whose set has the smallest key, of several rows with both, one.
    Documents with an empty set all stay."""
    named = _named(docs, k, percent).where("cls is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("best")
    kept = named.groupBy("component").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.cls").alias("_key"))
    repeated = named.groupBy("doc_id", "cls").count().where("count > 1").limit(1).count()

    @F.arrow_udf(T.LongType())
    def key(text: pa.Array) -> pa.Array:
        return pa.array([_key(s) if len(s) else None for s in _sets(text, k)], pa.int64())

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id0"),
                    F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_inked"))
    blank = d.where(~F.col("_inked"))
    full = d.where("_inked").withColumn("_key0", key(F.col("_row.text").cast("string")))
    full = full.join(kept, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_key0") == F.col("_key")), "left_semi")
    if repeated:
        full = full.dropDuplicates(["_id0", "_key0"])
    return full.select("_row.*").unionByName(blank.select("_row.*"))
