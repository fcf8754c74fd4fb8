"""Prefix trie of conversations, with subtree totals by the Euler-tour technique.

1. ``rebuilt`` forms the conversations: the first turns of a donor, then the own turns after them.
2. ``prefixes`` names every prefix by 128 bits: a turn's MD5, which covers its depth, is four numbers of
   32 bits, and a prefix is the sums of its turns' numbers.  Sums can be taken in blocks of
   a conversation, so one conversation may hold any share of all rows.
3. ``nodes``: the distinct prefixes, numbered in the order of (smallest member, depth).
4. ``arcs``: an enter and an exit arc per node, each with its successor on the tour.  Children come in the order of
   their numbers; a node's next sibling is found in blocks, so a node may have any number of children.
5. ``list_prefix`` ranks the tour: blocks of neighbouring arcs are contracted to the pieces of the list that run inside
   them, then pieces are contracted in pairs by random mates until a bounded number is left,
   and the places are passed back.  Leaves and savings are carried as weights of the enter arcs.
6. ``trie``: a subtree's leaves and savings are the difference of the sums at its two arcs.

Defined cases: turns that share a number come in the order of role, then of the text's MD5; repeated rows are
turns of their own; rows without conv_id form one conversation without donor, which counts as a
member, has no number to be smallest by and is not listed in ends_sha256; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapse.llm.common import WORD, bounded_join, stage
from lapse.operators.ranking import cumulative

#: Turns of a conversation that are summed in one piece; siblings looked up in one piece; ids listed in one piece.
BLOCK = 4096
#: Children from which on a node's children are joined to it apart.
MANY = 4096
#: Pieces of the tour that one task may rank at the end.
LAST = 1 << 14
MASK = 0xFFFFFFFF
KEY = ["depth", "id1", "id2"]


def turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: c, none (conv_id or 0, and whether it is null), k (place from 1), role, digest, words."""
    t = conversations.select(
        F.coalesce(F.col("`conv_id`").cast("long"), F.lit(0)).alias("c"), F.col("`conv_id`").isNull().alias("none"),
        F.col("`turn`").alias("turn"), F.coalesce(F.col("`role`"), F.lit("")).alias("role"),
        F.md5(F.coalesce(F.col("`text`"), F.lit(""))).alias("digest"),
        F.coalesce(F.regexp_count(F.col("`text`"), F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("m"))
    ranked = cumulative(stage(t, "trie-turns"), ["turn", "role", "digest", "m"], (), ["c", "none"], row_col="k")
    return ranked.select("c", "none", "k", "role", "digest", "words")


def rebuilt(t: DataFrame, span: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """``t`` as of ``turns``.  Returns (rebuilt turns: c, none, depth, role, digest, words; conversations: c, none).

    Conversation c takes the first h turns of c - c % span, h = crc32 of its number % (most + 1), then its own after its first h.
    """
    t = stage(t, "trie-ranked")
    h = F.when(F.col("none"), F.lit(0)).otherwise(F.crc32(F.col("c").cast("string")) % (most + 1))
    convs = stage(t.groupBy("c", "none").agg(F.max("k").alias("len")).withColumn("h", h), "trie-conversations")
    edge = (1 << 63) - span
    low = F.when(F.col("c") > 0, F.col("c")).otherwise(F.when(F.col("c") < -edge, F.col("c")).otherwise(F.col("c") - (span - 1)))
    high = F.when(F.col("c") < 0, F.col("c")).otherwise(F.when(F.col("c") > edge, F.col("c")).otherwise(F.col("c") + (span - 1)))
    first = t.where(~F.col("none") & (F.col("c") % span == 0) & (F.col("k") <= most)).select(
        F.explode(F.sequence(low, high)).alias("c"), "k", "role", "digest", "words")
    given = first.join(convs.where("not none").select("c", "h"), "c").where("k <= h").select(
        "c", F.lit(False).alias("none"), F.col("k").alias("depth"), "role", "digest", "words")
    given = stage(given, "trie-given")
    got = given.groupBy("c", "none").agg(F.count("*").alias("got"))
    shift = convs.join(got, ["c", "none"], "left").select(
        "c", "none", "h", (F.coalesce("got", F.lit(0)) - F.col("h")).alias("shift"),
        F.explode(F.expr(f"sequence(0L, len div {BLOCK}L)")).alias("piece"))
    own = t.withColumn("piece", F.expr(f"k div {BLOCK}L")).join(shift, ["c", "none", "piece"]).where("k > h").select(
        "c", "none", (F.col("k") + F.col("shift")).alias("depth"), "role", "digest", "words")
    return given.unionByName(own), convs.select("c", "none")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per member and prefix, the empty one included: c, none, depth, id1, id2, up1, up2 (the
    parent's), words (of the last turn)."""
    told = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "digest"))
    parts = [f"x{j}" for j in range(4)]
    d = rows.select("c", "none", "depth", "words", F.expr(f"depth div {BLOCK}L").alias("piece"), told.alias("told"))
    d = d.select("c", "none", "depth", "words", "piece",
                 *[F.conv(F.substring("told", 8 * j + 1, 8), 16, 10).cast("long").alias(x) for j, x in enumerate(parts)])
    d = stage(d, "trie-hashes")
    sums = d.groupBy("c", "none", "piece").agg(*[F.sum(x).alias(f"s_{x}") for x in parts])
    before = W.partitionBy("c", "none").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offs = sums.select("c", "none", "piece", *[F.sum(f"s_{x}").over(before).alias(f"o_{x}") for x in parts]).where("piece > 0")
    offs = stage(offs, "trie-offsets")
    inner = W.partitionBy("c", "none", "piece").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(x).over(inner).alias(f"l_{x}") for x in parts])
    j = bounded_join(local, offs, ["c", "none", "piece"], offs.count(), "left")
    now = [F.col(f"l_{x}") + F.coalesce(f"o_{x}", F.lit(0)) for x in parts]
    was = [n - F.col(x) for n, x in zip(now, parts)]

    def packed(a, b):
        return F.shiftleft(a.bitwiseAND(MASK), 32).bitwiseOR(b.bitwiseAND(MASK))

    deep = j.select("c", "none", "depth", packed(now[0], now[1]).alias("id1"), packed(now[2], now[3]).alias("id2"),
                    packed(was[0], was[1]).alias("up1"), packed(was[2], was[3]).alias("up2"), "words")
    zero, no = F.lit(0).cast("long"), F.lit(None).cast("long")
    return deep.unionByName(convs.select("c", "none", zero.alias("depth"), zero.alias("id1"), zero.alias("id2"),
                                         no.alias("up1"), no.alias("up2"), zero.alias("words")))


def nodes(members: DataFrame) -> DataFrame:
    """The distinct prefixes of ``members``: r (number), depth, id1, id2, up1, up2, conv_id, n_convs, saved."""
    n = members.groupBy(*KEY).agg(F.min(F.when(~F.col("none"), F.col("c"))).alias("conv_id"), F.count("*").alias("n_convs"),
                                  F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.max("words").alias("words"))
    n = n.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    order = [F.col("conv_id").asc_nulls_first(), *KEY]
    n = n.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r", F.monotonically_increasing_id())
    return stage(n, "trie-nodes")


def arcs(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``n`` as of ``nodes``.  Returns (family: r, n_children, first, next, pr, parent_conv_id;
    arcs: a, succ, n, leaves, saved), where node r enters by arc 2r and exits by arc 2r + 1."""
    child = n.where("depth > 0").select("r", (F.col("depth") - 1).alias("depth"), F.col("up1").alias("id1"), F.col("up2").alias("id2"))
    kids = child.groupBy(*KEY).agg(F.count("*").alias("n_children"), F.min("r").alias("first"))
    with_kids = stage(n.join(kids, KEY, "left").select(
        *KEY, "r", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first", "saved"), "trie-kids")
    parent = with_kids.where("n_children > 0").select(*KEY, F.col("r").alias("pr"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = parent.where(F.col("n_children") > MANY).drop("n_children")
    split = bounded_join(child, many, KEY, many.count(), "left")
    few = split.where("pr is null").drop("pr", "parent_conv_id").join(parent.where(F.col("n_children") <= MANY).drop("n_children"), KEY)
    split = stage(split.where("pr is not null").unionByName(few).select(
        "r", "pr", "parent_conv_id", F.expr(f"r div {BLOCK}L").alias("piece")), "trie-children")
    firsts = split.groupBy("pr", "piece").agg(F.min("r").alias("from"))
    after = firsts.select("pr", "piece", F.lead("from").over(W.partitionBy("pr").orderBy("piece")).alias("after"))
    within = split.withColumn("next", F.lead("r").over(W.partitionBy("pr", "piece").orderBy("r")))
    next_ = within.join(after, ["pr", "piece"]).select("r", "pr", "parent_conv_id", F.coalesce("next", "after").alias("next"))
    family = stage(with_kids.join(next_, "r", "left").select(
        "r", "n_children", "first", "next", "pr", "parent_conv_id", "saved"), "trie-family")
    leaf = (F.col("n_children") == 0).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    pair = F.array(
        F.struct((F.col("r") * 2).alias("a"), F.coalesce(F.col("first") * 2, F.col("r") * 2 + 1).alias("succ"),
                 one.alias("n"), leaf.alias("leaves"), F.col("saved").alias("saved")),
        F.struct((F.col("r") * 2 + 1).alias("a"), F.coalesce(F.col("next") * 2, F.col("pr") * 2 + 1).alias("succ"),
                 one.alias("n"), zero.alias("leaves"), zero.alias("saved")))
    return family, family.select(F.inline(pair))


# ---- list ranking ----

WEIGHTS = ("n", "leaves", "saved")
PIECES = "a long, head long, " + ", ".join(f"o_{w} long" for w in WEIGHTS) + ", succ long, " + ", ".join(f"{w} long" for w in WEIGHTS)


def _contract(t: pa.Table) -> pa.Table:
    """Contract the links whose both ends are in ``t`` (a, succ, weights): every a with the head of its piece and the
    weights before it in the piece; heads also with the piece's successor and weights."""
    order = np.argsort(t["a"].to_numpy(), kind="stable")
    a = t["a"].to_numpy()[order]
    last = np.asarray(t["succ"].is_null().to_numpy())[order]
    succ = t["succ"].fill_null(0).to_numpy()[order]
    w = [t[x].to_numpy()[order] for x in WEIGHTS]
    at = np.minimum(np.searchsorted(a, succ), len(a) - 1)
    inside = (a[at] == succ) & ~last
    pred = np.full(len(a), -1)
    pred[at[inside]] = np.flatnonzero(inside)
    off = [np.where(pred >= 0, x[pred], 0) for x in w]
    ptr, top = pred.copy(), np.where(pred >= 0, pred, np.arange(len(a)))
    while True:
        live = np.flatnonzero(ptr >= 0)
        if not len(live):
            break
        to = ptr[live]
        add = [x[to] for x in off]
        for x, y in zip(off, add):
            x[live] += y
        top[live] = top[top[live]]
        ptr[live] = ptr[to]
    heads = pred < 0
    tails = np.flatnonzero(~inside)
    to_head = top[tails]
    out_succ, ends = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    out_succ[to_head], ends[to_head] = succ[tails], last[tails]
    cols = {"a": a, "head": a[top], **{f"o_{k}": x for k, x in zip(WEIGHTS, off)},
            "succ": pa.array(out_succ, mask=ends | ~heads)}
    for k, x, y in zip(WEIGHTS, off, w):
        total = np.zeros(len(a), np.int64)
        total[to_head] = x[tails] + y[tails]
        cols[k] = pa.array(total, mask=~heads)
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()}).cast(
        pa.schema([(k, pa.int64()) for k in cols]))


def _in_blocks(pieces: DataFrame, block: int | None) -> DataFrame:
    """Contract within blocks of neighbouring numbers; in one block where ``block`` is None."""
    key = F.expr(f"a div {block}L") if block else F.lit(0)
    return pieces.select(key.alias("piece"), "a", "succ", *WEIGHTS).groupBy("piece").applyInArrow(_contract, PIECES)


def _by_mates(pieces: DataFrame, seed: int) -> DataFrame:
    """Contract every piece into its predecessor where a coin shows heads for that and tails for it: a quarter of all, on
    average."""
    p = pieces.withColumn("coin", F.xxhash64("a", F.lit(seed)).bitwiseAND(1))
    x, y = p.where("coin = 1").drop("coin"), p.where("coin = 0").drop("coin")
    y2 = y.select(F.col("a").alias("succ"), F.lit(True).alias("met"), F.col("succ").alias("y_succ"), *[F.col(k).alias(f"y_{k}") for k in WEIGHTS])
    zero = F.lit(0).cast("long")
    kept = x.join(y2, "succ", "left").select(
        "a", F.col("a").alias("head"), *[zero.alias(f"o_{k}") for k in WEIGHTS],
        F.when(F.col("met"), F.col("y_succ")).otherwise(F.col("succ")).alias("succ"),
        *[(F.col(k) + F.coalesce(f"y_{k}", zero)).alias(k) for k in WEIGHTS])
    x2 = x.where("succ is not null").select(F.col("succ").alias("a"), F.col("a").alias("x"), *[F.col(k).alias(f"x_{k}") for k in WEIGHTS])
    alone = F.col("x").isNull()
    met = y.join(x2, "a", "left").select(
        "a", F.coalesce("x", "a").alias("head"), *[F.coalesce(f"x_{k}", zero).alias(f"o_{k}") for k in WEIGHTS],
        F.when(alone, F.col("succ")).alias("succ"), *[F.when(alone, F.col(k)).alias(k) for k in WEIGHTS])
    return kept.unionByName(met)


def list_prefix(links: DataFrame, block: int = 2 * BLOCK, last: int = LAST) -> DataFrame:
    """``links`` (a, succ, n, leaves, saved) form one list, whose last succ is null.  Returns a and the sums of the weights before it;
    that of n is its place."""
    pieces, levels = links, []
    while True:
        step = _by_mates(pieces, len(levels)) if levels else _in_blocks(pieces, block)
        levels.append(stage(step, "trie-pieces"))
        pieces = levels[-1].where("head = a").select("a", "succ", *WEIGHTS)
        if pieces.count() <= last:
            break
    at = _in_blocks(pieces, None).select("a", *[F.col(f"o_{k}").alias(k) for k in WEIGHTS])
    for level in reversed(levels):
        place = at.select(F.col("a").alias("head"), *WEIGHTS)
        at = level.select("a", "head", *[f"o_{k}" for k in WEIGHTS]).join(place, "head").select(
            "a", *[(F.col(k) + F.col(f"o_{k}")).alias(k) for k in WEIGHTS])
    return at


# ---- members that end ----

def _streamed(batches):
    """SHA-256 of each node's lists of ids, joined by commas, in the order given."""
    now, told = None, None

    def row():
        return pa.record_batch([pa.array([v]) for v in now] + [pa.array([told.hexdigest()])], names=[*KEY, "ends_sha256"])

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(4)]
        for *key, ids in zip(*cols):
            if key != now:
                if now is not None:
                    yield row()
                now, told = key, hashlib.sha256()
            else:
                told.update(b",")
            told.update(ids.encode())
    if now is not None:
        yield row()


def endings(members: DataFrame) -> DataFrame:
    """depth, id1, id2, ends_sha256 of the nodes at which a member ends.  Ids are listed in pieces of neighbouring numbers; a node with
    several pieces is hashed by streaming them, so no list is held."""
    e = members.groupBy("c", "none").agg(F.max(F.struct(*KEY)).alias("at")).where("not none").select("c", "at.*")
    lists = e.groupBy(*KEY, F.shiftright("c", 12).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    lists = stage(lists, "trie-ends")
    per = lists.groupBy(*KEY).agg(F.count("*").alias("pieces"), F.min("ids").alias("ids"))
    one = per.where("pieces = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    more = lists.join(per.where("pieces > 1").select(*KEY), KEY, "left_semi").select(*KEY, "piece", "ids")
    more = more.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return one.unionByName(more.mapInArrow(_streamed, "depth long, id1 long, id2 long, ends_sha256 string"))


def trie(conversations: DataFrame, block: int = 2 * BLOCK, last: int = LAST) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and node and
    parent, its number and its parent's."""
    members = stage(prefixes(*rebuilt(turns(conversations))), "trie-members")
    n = nodes(members)
    family, links = arcs(n)
    at = list_prefix(links, block, last).groupBy(F.expr("a div 2L").alias("r")).agg(
        (F.max("leaves") - F.min("leaves")).alias("n_leaves"), (F.max("saved") - F.min("saved")).alias("saved_tokens"))
    out = n.select("r", *KEY, "conv_id", "n_convs").join(family.select("r", "n_children", "parent_conv_id", "pr"), "r").join(at, "r")
    out = out.join(endings(members), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("r").alias("node"), F.col("pr").alias("parent"))
