"""Merkle manifest of a dataset: a nested-struct rollup per source, then over the sources.

1. ``leaves`` hashes every document; its place among its source's documents (by doc_id) is a
   distributed rank, written in digits of base 16.
2. ``_rolled`` groups three digits away, one after the other, within blocks of 4,096 places: each
   group of up to 16 structs becomes one struct that holds them and their digest.  The rows
   of a block meet in one exchange; the three groupings follow in the same stage.
3. ``_up`` repeats that on the digests of the blocks until one is left, first in each source (its
   subroot), then over the sources (the root).
4. ``_down`` comes back: the path of a block joins the group of its own rows as one more row, and transform
   and explode unnest the structs into one row per leaf with its siblings on every level.  There is
   no join on the way; a row holds one block at most.

Digests are lowercase hex SHA-256 of concatenated strings, digests as hex text.  A node of one
child is hashed too as long as its level has several nodes; a source of one document has its leaf as subroot.

Defined cases: a null in any field counts as ``-``; null doc_ids come first, and rows that share a
doc_id are ordered by their leaf; repeated rows are separate leaves; null sources are one source, the
first; an empty table gives an empty result; other columns are ignored, whatever their names.  A text is
hashed in one piece and never moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import stage
from lapse.operators.ranking import cumulative, join_small

FAN = 16
DIGITS = 3                       # digits grouped away within one block
BLOCK = FAN ** DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Digest of a record: each value as UTF-8 byte count, ':' and value, or '-' where null."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, leaf, i (its place in the source, from 0), n (documents of the source),
    and changed, the leaf after tampering (null where the row is not tampered with)."""
    d = {f: F.col(f"`{f}`") for f in FIELDS}
    lowered = {**d, "text": F.translate(d["text"], UPPER, LOWER)}
    hit = F.crc32(d["doc_id"].cast("string")) % 5 == 0
    rows = docs.select(d["doc_id"], d["source"], leaf_hash(*d.values()).alias("leaf"),
                       F.when(hit, leaf_hash(*lowered.values())).alias("changed"),
                       F.monotonically_increasing_id().alias("m"))      # parts equal rows, in any order
    rows = stage(rows, "merkle-leaves")
    ranked = cumulative(rows, ["doc_id", "leaf", "m"], (), ["source"], row_col="place")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    return join_small(ranked, sizes, ["source"]).select(
        "doc_id", "source", "leaf", "changed", (F.col("place") - 1).alias("i"), "n")


def _rolled(rows: DataFrame, keys: list[str], level: int, carry: list[str]) -> DataFrame:
    """Blocks of ``rows`` (``keys``, b, n, i, digest, ``carry``): keys, b, n, digest, kids (structs nested
    ``DIGITS`` deep) and above.  ``level`` is the level of the digests.  Rows without i bring ``above``, the
    path of their block, and are no members."""
    digits = [f"p{s}" for s in range(1, DIGITS)]
    cur = rows.repartition(*keys, "b") if keys else rows.repartition("b")
    cur = cur.select(*keys, "b", "n", *[F.expr(f"i div {FAN ** s}L").alias(f"p{s}") for s in range(1, DIGITS)],
                     F.col("i").alias("p0"), "digest", *carry, "above")
    inside = ["digest", *carry]
    for s in range(DIGITS):
        group = [*keys, "b", "n", *reversed(digits[s:])]
        member = F.when(F.col(f"p{s}").isNotNull(), F.struct(F.col(f"p{s}").alias("at"), *inside))
        cur = cur.groupBy(*group).agg(F.sort_array(F.collect_list(member)).alias("kids"), F.max("above").alias("above"))
        joined = F.sha2(F.array_join(F.col("kids").getField("digest"), ""), 256)
        cur = cur.withColumn("digest", F.when(F.col("n") > FAN ** (level + s), joined)
                             .otherwise(F.get(F.col("kids"), F.lit(0)).getField("digest")))
        inside = ["digest", "kids"]
    return cur


def _up(rows: DataFrame, keys: list[str], name: str) -> list[DataFrame]:
    """Digest tables (keys, n, i, digest), each with a row per block of the one before, down to one row per key."""
    tables, level = [rows.select(*keys, "n", "i", "digest")], 0
    while True:
        t = tables[-1].select("*", F.expr(f"i div {BLOCK}L").alias("b"), F.lit(None).cast("int").alias("above"))
        blocks = _rolled(t, keys, level, []).select(*keys, "n", F.col("b").alias("i"), "digest")
        tables.append(stage(blocks, f"merkle-{name}"))
        level += DIGITS
        if not tables[-1].where("i > 0").limit(1).count():
            return tables


def _down(rows: DataFrame, paths: DataFrame, keys: list[str], level: int, carry: list[str]) -> DataFrame:
    """``rows`` (keys, n, i, digest, carry) with above: the block's path preceded by the row's siblings in the block.
    ``paths`` has keys, n, b and above, a struct of path (array of left, right) and what goes with it."""
    t = rows.select("*", F.expr(f"i div {BLOCK}L").alias("b"))
    cur = _rolled(t.unionByName(paths, allowMissingColumns=True), keys, level, carry).select(*keys, "n", "above", "kids")
    steps = []
    for s in reversed(range(DIGITS)):
        each = F.transform("kids", lambda kid, x: F.struct(
            kid.alias("kid"),
            F.array_join(F.slice(F.col("kids").getField("digest"), F.lit(1), x), "").alias("left"),
            F.array_join(F.slice(F.col("kids").getField("digest"), x + 2, F.lit(FAN)), "").alias("right")))
        cur = cur.select(*keys, "n", "above", *steps, F.explode(each).alias("one"))
        step = F.when(F.col("n") > FAN ** (level + s), F.struct("one.left", "one.right")).alias(f"step{s}")
        kept = ["kid.kids"] if s else ["kid.at", "kid.digest", *[f"kid.{c}" for c in carry]]
        cur = cur.select(*keys, "n", "above", *steps, step, *[F.col(f"one.{k}") for k in kept])
        steps.append(f"step{s}")
    path = F.concat(F.array_compact(F.array(*reversed(steps))), F.col("above.path"))
    return cur.select(*keys, "n", F.col("at").alias("i"), "digest", *carry, F.col("above").withField("path", path).alias("above"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, leaf, changed, subroot, root and path, an array of
    (left, right): the joined digests of the siblings before and after, from the leaf's level to the root's."""
    rows = stage(leaves(docs).withColumnRenamed("leaf", "digest"), "merkle-ranked")
    tables = _up(rows, ["source"], "blocks")
    # the subroots are the leaves of a second tree of the same make
    subroots = cumulative(tables[-1].select("source", "digest", F.col("n").alias("size")), ["source"], row_col="place")
    subroots = stage(subroots.select("source", "digest", "size", (F.col("place") - 1).alias("i")), "merkle-subroots")
    subroots = subroots.withColumn("n", F.lit(subroots.count()).cast("long"))
    tops = _up(subroots, [], "tops")
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    paths = tops[-1].select("n", F.col("i").alias("b"), F.struct(
        empty.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")).alias("above"))
    for k in reversed(range(1, len(tops) - 1)):
        paths = _down(tops[k], paths, [], k * DIGITS, []).select("n", F.col("i").alias("b"), "above")
    # a subroot is the one block of its source's last table
    paths = _down(subroots, paths, [], 0, ["source", "size"]).select(
        "source", F.col("size").alias("n"), F.lit(0).cast("long").alias("b"),
        F.col("above").withField("subroot", F.col("digest")).alias("above"))
    for k in reversed(range(1, len(tables) - 1)):
        paths = _down(tables[k], paths, ["source"], k * DIGITS, []).select("source", "n", F.col("i").alias("b"), "above")
    out = _down(rows, stage(paths, "merkle-paths"), ["source"], 0, ["doc_id", "changed"])
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), "changed", "above.subroot", "above.root", "above.path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proofs(docs: DataFrame) -> DataFrame:
    """The digest columns of ``manifest``: proof_sha256 of all siblings, the root folded from the (tampered) leaf, and
    whether it is the root."""
    start = F.coalesce("changed", "leaf")
    told = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(told, 256).alias("proof_sha256"),
                                folded(start, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def write_manifest(docs: DataFrame, path: str) -> None:
    """Write the manifest as Parquet: a document can be verified with its own row alone."""
    manifest(docs).drop("changed").write.parquet(path)
