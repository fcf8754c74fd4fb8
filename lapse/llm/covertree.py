"""Near-duplicate embeddings by a cover tree and a dual traversal: all pairs with cosine >= threshold.

Unit vectors; cosine >= t is a chord of at most delta = sqrt(2 - 2 t).  Equal vectors
are one class that is compared once.

Tree.  A node has a centre (one of its vectors) and a covering radius (the largest distance
of its vectors to the centre, measured).  A level halves the radius: a bounded sample of a
node's vectors gives centres further apart than the radius, every vector goes to its
nearest centre, those within the radius into the centre's inner child, the others into
its outer child.  Nodes of at most LEAF vectors are leaves; a node that the last
level leaves larger is cut into leaves of its radius by hash.

Dual traversal.  Starting from the pairs (root, root), a pair of nodes goes on to the
pairs of their children unless the centres are further apart than both radii and delta together; then no
pair of vectors below can qualify.  Leaves are dealt to groups of bounded size, and the pairs of leaves
of two groups are compared in one task, each again by child nodes with their own centres and radii, and what is left by exact cosines.
So a vector moves once per group that it meets, not once per leaf; where that is more than a few copies of
the table, the pairs of groups are settled in rounds, whose shuffle files go before the next one.  Vectors are staged as they
came (four bytes a component where the table has floats) and made unit vectors where they are compared; every staged
table is deleted as soon as the next one stands.

The sample only shapes the tree; the bounds hold for every vector, so the result is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different dimension do not link; repeated rows link (unless
they are such vectors); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.common import bounded_join, components, discard, discarding, stage

LEAF = 4096          # vectors of a leaf
FAN = 32             # vectors sampled for the centres of a node
LEVELS = 5           # radii 1, 1/2, .. 1/16
SLACK = 1e-9
CENTRE_ROWS = 2000   # nodes whose centres are broadcast at once
GROUPS = 16          # groups of leaves, at least
GROUP_BYTES = 16 << 20       # bytes of a group's unit vectors, about
SENT = 2             # copies of the vectors that a round moves, more while they take less than
ROUND_BYTES = 256 << 20


def _matrix(col: pa.Array, kind) -> np.ndarray:
    """Unit vectors, one row each, of vectors packed as they came."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw = b"".join(x.as_py() for x in col)
    x = np.frombuffer(raw, kind).reshape(len(col), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)             # so that squares neither over- nor underflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def _classes(vectors: DataFrame, keep: Callable) -> tuple[DataFrame, DataFrame, type]:
    """(vec_id, cls) of every row, kept, cls null where it links with nothing; (cls, copies, dim, vec) of the classes, staged; the
    type of the packed components."""
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), e).alias("e"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, raw = [], []
            for v in b.column("e"):
                x = v.values.to_numpy() if v.is_valid else None
                raw.append(None if x is None else x.astype(kind).tobytes())
                if x is not None:
                    x = x / np.abs(x).max()
                    x = (x / math.sqrt(float(x @ x)) + 0.0).tobytes()
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "unit", "vec"])

    unit_rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "e").mapInArrow(unit, "vec_id long, unit binary, vec binary")
    r = stage(unit_rows.select("vec_id", "vec", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")).alias("cls")), "cover-rows")
    ids = keep(r.select("vec_id", "cls"), "cover-ids")
    c = r.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.first("vec").alias("vec"))
    width = np.dtype(kind).itemsize
    c = stage(c.select("cls", "copies", (F.length("vec") / width).cast("long").alias("dim"), "vec"), "cover-classes")
    discard(r)
    return ids, c, kind


def _fit(radius: float, kind):
    """Centres of a node from its sample: greedily, further apart than the radius; at least two
    if there are two (then the farthest from the first)."""
    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        x = _matrix(t.column("vec"), kind)
        take = [0]
        d = _distances(x, x)
        for i in range(1, len(x)):
            if len(take) < FAN and d[i, take].min() > radius:
                take.append(i)
        if len(take) == 1 and len(x) > 1:
            take.append(int(d[0].argmax()))
        return pa.table({"node": pa.array([t.column("node")[0].as_py()], pa.int64()),
                         "centres": pa.array([[c.tobytes() for c in x[take]]], pa.list_(pa.binary()))})

    return fit


def _assign(radius: float, kind):
    """Child number (2 * centre, plus 1 outside the radius) and the distance to its centre, of every vector."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            vec = b.column("vec")
            child, far = np.zeros(n, np.int64), np.zeros(n)
            nodes = b.column("node").to_numpy()
            for node in np.unique(nodes):
                at = np.flatnonzero(nodes == node)
                x = _matrix(vec.take(pa.array(at)), kind)
                c = np.frombuffer(b"".join(b.column("centres")[int(at[0])].as_py()), np.float64).reshape(-1, x.shape[1])
                d = _distances(x, c)
                far[at] = d.min(1)
                child[at] = 2 * d.argmin(1) + (far[at] > radius)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("cls"), b.column("copies"), vec, pa.array(child), pa.array(far)],
                                             ["node", "cls", "copies", "vec", "child", "far"])

    return assign


def _tree(classes: DataFrame, kind) -> tuple[DataFrame, list[DataFrame]]:
    """Vectors with their leaf (node, cls, copies, vec), and of each level the nodes
    (node, parent, centre, radius, size).  ``classes`` is a staged table and goes as soon as it is dealt out."""
    def centres_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, size, vec in zip(b.column("node"), b.column("size"), b.column("vec")):
                x = _matrix(pa.array([vec.as_py()], pa.binary()), kind)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()]), pa.array([size.as_py()]), pa.array([x.tobytes()], pa.binary())],
                                                 ["node", "size", "centre"])

    held, cur = classes, classes.select(F.col("dim").alias("node"), "cls", "copies", "vec")
    roots = cur.groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("size")).mapInArrow(
        centres_of, "node long, size long, centre binary")
    levels = [stage(roots.select("node", F.lit(None).cast("long").alias("parent"), "centre", F.lit(2.0).alias("radius"),
                                 "size"), "cover-roots")]
    done = []
    for level in range(LEVELS):
        radius = 0.5 ** level
        big = levels[-1].where(f"size > {LEAF}").select("node", "size")
        n_big = big.count()
        if not n_big:
            break
        mine = bounded_join(cur, big, ["node"], n_big)
        u = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) / float(1 << 30)
        want = F.least(F.lit(FAN), F.greatest(F.lit(4), F.ceil(2 * F.col("size") / LEAF)))
        sample = mine.where(u < 2 * want / F.col("size")).select("node", "cls", "vec")
        centres = stage(sample.groupBy("node").applyInArrow(_fit(radius, kind), "node long, centres array<binary>"), "cover-centres")
        with_c = bounded_join(cur, centres, ["node"], 0 if n_big <= CENTRE_ROWS else 1 << 40)
        a = with_c.select("node", "cls", "copies", "vec", "centres").mapInArrow(
            _assign(radius, kind), "node long, cls long, copies long, vec binary, child long, far double")
        a = stage(a.withColumn("parent", F.col("node")).withColumn("node", F.xxhash64("parent", "child", F.lit(level))),
                  "cover-level")
        nodes = a.groupBy("node").agg(F.first("parent").alias("parent"), F.first("child").alias("child"), F.max("far").alias("radius"),
                                      F.count("*").alias("size"))
        nodes = nodes.join(centres.withColumnRenamed("node", "parent"), "parent").select(
            "node", "parent", F.expr("centres[cast(child div 2 as int)]").alias("centre"), "radius", "size")
        levels.append(stage(nodes, "cover-nodes"))
        # nodes that are small, and those whose sample came out empty, stay as they are
        done.append(stage(bounded_join(cur, centres.select("node"), ["node"], n_big, "left_anti"), "cover-done"))
        discard(held)
        held, cur = a, a.select("node", "cls", "copies", "vec")
    done.append(cur)
    points = done[0]
    for d in done[1:]:
        points = points.unionByName(d)
    return points, levels


def _near(radius_a: str, radius_b: str, a: str, b: str, delta: float):
    """Whether two nodes may hold a pair: centres within both radii and delta."""
    square = f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0.0D, (s, x) -> s + x)"
    return F.expr(f"sqrt({square}) <= {radius_a} + {radius_b} + {delta + SLACK}D")


def _pairs(points: DataFrame, levels: list[DataFrame], delta: float) -> tuple[DataFrame, DataFrame]:
    """Points with their leaf, and the pairs of leaves (a <= b) that the dual traversal leaves."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(5)],
                 pa.array([np.frombuffer(x.as_buffer(), np.float64) for x in b.column("centre")], pa.list_(pa.float64()))],
                ["node", "parent", "radius", "size", "level", "centre"])

    nodes = None
    for i, x in enumerate(levels):
        x = x.select("node", "parent", "radius", "size", F.lit(i).alias("level"), "centre")
        nodes = x if nodes is None else nodes.unionByName(x)
    nodes = stage(nodes.mapInArrow(unpack, "node long, parent long, radius double, size long, level int, centre array<double>"),
                  "cover-tree")
    inner = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    tops = nodes.join(inner.withColumn("has", F.lit(True)), "node", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    tops = stage(tops, "cover-nodes")
    roots = tops.where("parent is null")
    side = [("node", "node"), ("radius", "r"), ("centre", "c"), ("has", "has")]

    def as_side(df, s):
        return df.select(*[F.col(x).alias(f"{n}_{s}") for x, n in side])

    live = as_side(roots, "a").join(as_side(roots, "b"), F.col("node_a") == F.col("node_b"))
    ended = None
    for _ in levels[1:]:
        over = live.where("not has_a and not has_b").select("node_a", "node_b")
        ended = over if ended is None else ended.unionByName(over)
        kids = tops.where("parent is not null")
        stay = tops.where("not has")

        def below(s):
            # a leaf stands for itself
            k = kids.select(F.col("parent").alias(f"node_{s}"), *[F.col(x).alias(f"k{n}_{s}") for x, n in side])
            same = stay.select(F.col("node").alias(f"node_{s}"), *[F.col(x).alias(f"k{n}_{s}") for x, n in side])
            return k.unionByName(same)

        nxt = live.where("has_a or has_b").select("node_a", "node_b").join(below("a"), "node_a").join(below("b"), "node_b")
        # below a node and itself each pair counts once
        nxt = nxt.where("node_a <> node_b or knode_a <= knode_b").select(
            *[F.col(f"k{n}_{s}").alias(f"{n}_{s}") for s in "ab" for _, n in side])
        live = stage(nxt.where(_near("r_a", "r_b", "c_a", "c_b", delta)), "cover-pairs")
    over = live.where("not has_a and not has_b").select("node_a", "node_b")
    ended = over if ended is None else ended.unionByName(over)
    pairs = ended.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    # leaves that are still large: blocks by hash
    size = tops.where("not has").select("node", F.ceil(F.col("size") / LEAF).cast("long").alias("blocks"))
    n = size.count()
    p = bounded_join(points, size, ["node"], n).withColumn("leaf", F.xxhash64(
        "node", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks"))))
    blocks = size.select("node", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("k")).select(
        "node", F.xxhash64("node", "k").alias("leaf"))
    pairs = pairs.join(blocks.toDF("a", "leaf_a"), "a").join(blocks.toDF("b", "leaf_b"), "b").select(
        F.least("leaf_a", "leaf_b").alias("a"), F.greatest("leaf_a", "leaf_b").alias("b")).distinct()
    return p.select("leaf", "cls", "copies", "vec"), pairs


def _children(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Nodes of a leaf: (rows, centre, radius), around at most sqrt(n) greedily chosen centres."""
    if len(x) <= 64:
        d = _distances(x, x[:1])[:, 0]
        return [(np.arange(len(x)), x[0], float(d.max()))]
    centres = [0]
    far = _distances(x, x[:1])[:, 0]
    near = np.zeros(len(x), np.int64)
    while len(centres) < math.isqrt(len(x)):
        i = int(far.argmax())
        if far[i] <= 0.05:
            break
        d = _distances(x, x[i:i + 1])[:, 0]
        near[d < far] = len(centres)
        far = np.minimum(far, d)
        centres.append(i)
    return [(rows, x[centres[k]], float(far[rows].max())) for k in range(len(centres))
            if len(rows := np.flatnonzero(near == k))]


def _local_components(links: np.ndarray, row_id: np.ndarray, col_id: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (id, smallest id of its component) that connect what the link matrix connects."""
    r, c = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(r):
        return
    m = links[np.ix_(r, c)]
    lr, lc = row_id[r].copy(), col_id[c].copy()
    top = np.iinfo(np.int64).max
    while True:
        nr = np.minimum(lr, np.where(m, lc[None, :], top).min(1))
        nc = np.minimum(lc, np.where(m, nr[:, None], top).min(0))
        if (nr == lr).all() and (nc == lc).all():
            break
        lr, lc = nr, nc
    yield row_id[r], lr
    yield col_id[c], lc


def _compare(threshold: float, delta: float, kind):
    """Links of pairs of leaves (rows with ``other``) among the leaves of a task (rows with ``vec``): per vector the number of linked
    rows, and edges that keep the components."""
    def leaf_of(rows: pa.Table) -> tuple:
        x = _matrix(rows.column("vec"), kind)
        return rows.column("cls").to_numpy(), rows.column("copies").to_numpy(), x, _children(x), np.zeros(len(x))

    def link_leaves(a: tuple, b: tuple, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts into both leaves; edges."""
        (cls_a, copies_a, x_a, kids_a, count_a), (cls_b, copies_b, x_b, kids_b, count_b) = a, b
        cb, rb = np.array([c for _, c, _ in kids_b]), np.array([r for _, _, r in kids_b])
        for rows, centre, radius in kids_a:
            ok = np.flatnonzero(_distances(centre[None, :], cb)[0] <= radius + rb + delta + SLACK)
            if not len(ok):
                continue
            c = np.concatenate([kids_b[k][0] for k in ok])
            for i in range(0, len(rows), 512):
                r = rows[i:i + 512]
                link = x_a[r] @ x_b[c].T >= threshold
                link &= cls_a[r][:, None] != cls_b[c][None, :]
                if not link.any():
                    continue
                count_a[r] += link @ copies_b[c]
                if not own:
                    count_b[c] += copies_a[r] @ link
                yield from _local_components(link, cls_a[r], cls_b[c])

    def compare(t: pa.Table) -> pa.Table:
        pairs, t = t.filter(pc.is_valid(t.column("other"))), t.filter(pc.is_null(t.column("other")))
        t = t.sort_by("leaf")
        names, first = np.unique(t.column("leaf").to_numpy(), return_index=True)
        ends = [*first[1:], t.num_rows]
        leaves = {name: leaf_of(t.slice(i, j - i)) for name, i, j in zip(names.tolist(), first.tolist(), map(int, ends))}
        out_id, out_to = [], []
        for a, b in zip(pairs.column("leaf").to_pylist(), pairs.column("other").to_pylist()):
            if a in leaves and b in leaves:          # a block that no vector fell into has none
                for i, to in link_leaves(leaves[a], leaves[b], a == b):
                    out_id.append(i)
                    out_to.append(to)
        hits = [(cls[hit], count[hit].astype(np.int64)) for cls, _, _, _, count in leaves.values() if len(hit := np.flatnonzero(count))]
        none = np.zeros(0, np.int64)
        n = np.concatenate([none, *[h[1] for h in hits], *[np.zeros(len(i), np.int64) for i in out_id]])
        ids = np.concatenate([none, *[h[0] for h in hits], *out_id])
        to = np.concatenate([none, *[np.zeros(len(h[0]), np.int64) for h in hits], *out_to])
        return pa.table({"cls": pa.array(ids), "other": pa.array(to, mask=n > 0), "links": pa.array(n)})

    return compare


def _links(points: DataFrame, pairs: DataFrame, threshold: float, delta: float, kind) -> DataFrame:
    """(cls, other, links) of all pairs of leaves: the leaves in groups, a task for the pairs of two groups, in as many rounds as
    it takes for a round to move few copies of the vectors."""
    rows, width = points.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    dim = width // np.dtype(kind).itemsize
    groups = max(GROUPS, -(-rows * dim * 8 // GROUP_BYTES))
    sent = max(SENT, ROUND_BYTES // max(1, rows * (width + 40)))

    def group(leaf):
        return F.pmod(F.xxhash64(leaf, F.lit(2)), F.lit(groups))

    # a group is in one pair of groups for each sum of their numbers
    total = F.pmod(F.col("i") + F.col("j"), F.lit(groups))
    dealt = stage(pairs.select("a", "b", F.least(group("a"), group("b")).alias("i"), F.greatest(group("a"), group("b")).alias("j")).withColumn(
        "round", F.floor(total / sent)), "cover-dealt")
    found = None
    for r in range(-(-groups // sent)):
        mine = dealt.where(F.col("round") == r)
        to = stage(mine.select(F.col("a").alias("leaf"), "i", "j").unionByName(mine.select(F.col("b").alias("leaf"), "i", "j")).distinct(),
                   "cover-sent")
        sends = bounded_join(points, to, ["leaf"], to.count()).select(
            "i", "j", "leaf", F.lit(None).cast("long").alias("other"), "cls", "copies", "vec")
        asks = mine.select("i", "j", F.col("a").alias("leaf"), F.col("b").alias("other"), F.lit(None).cast("long").alias("cls"),
                           F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("vec"))
        got = stage(sends.unionByName(asks).groupBy("i", "j").applyInArrow(_compare(threshold, delta, kind), "cls long, other long, links long"),
                    "cover-links")
        found = got if found is None else found.unionByName(got)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vectors``: vec_id, embedding.  One row per vector: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable by links, itself included), kept (vec_id = component_id)."""
    delta = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    with discarding(vectors.sparkSession) as keep:
        r = keep(_linked(vectors, threshold, delta), "cover-result")
    low = r.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return r.join(low, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))


def _linked(vectors: DataFrame, threshold: float, delta: float) -> DataFrame:
    """vec_id, cls, n_links and component (of classes) of every row."""
    with discarding(vectors.sparkSession) as keep:           # the tree goes before the leaves are compared
        rows, classes, kind = _classes(vectors, keep)
        points, pairs = _pairs(*_tree(classes, kind), delta)
        points, pairs = keep(points, "cover-leafed"), keep(pairs, "cover-leaves")
    found = _links(points, pairs, threshold, delta, kind)
    links = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), "cover-components")
    info = points.select("cls", "copies").join(links, "cls", "left").join(
        comp.select(F.col("id").alias("cls"), "component"), "cls", "left").select(
        "cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    return rows.join(info, "cls", "left")
