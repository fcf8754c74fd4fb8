import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, Union, jaccard_components
from pyspark.sql import functions as F

from lapse.llm import common, covertree, ngramjoin, queries
from lapse.session import scratch_path

DOCS = "doc_id long, text string"


def triples(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join_planted(spark, k, percent, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 300)
    r = random.Random(k)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("ABCDEFG")
    line = [word() for _ in range(12)]
    base = [[word() for _ in range(r.randint(20, 60))] for _ in range(6)]
    docs = []
    for d in range(150):
        w = list(r.choice(base)) if r.random() < 0.7 else [word() for _ in range(r.randint(1, 50))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.4:
            w += line
        docs.append((d + 100, " ".join(w)))
    docs += [(5, None), (6, ""), (7, " \t"), (8, "one two"), (9, "ONE  two"), (10, "one"), (11, "ÄB c"), (12, "äB c"),
             (13, docs[0][1]), (13, docs[0][1]), (14, docs[1][1].upper())]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert triples(ngramjoin.jaccard_components(df, k, percent)) == sorted(jaccard_components(docs, k, percent), key=str)


def test_jaccard_hot_group_and_matrix_links(spark, monkeypatch):
    """Chains whose neighbours share no centre: only the matrix finds them."""
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 200)
    r = random.Random(9)
    chain, docs = [f"c{i}" for i in range(60)], []
    for d in range(80):
        docs.append((d, " ".join(chain)))
        if r.random() < 0.8:
            i = r.randrange(len(chain))
            chain[i:i + 1] = [f"n{d}"]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    assert triples(ngramjoin.jaccard_components(df, 3, 90)) == sorted(jaccard_components(docs, 3, 90), key=str)


def test_jaccard_query_on_tables(spark):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = triples(queries.op6_ngram_join(spark, SF))
    assert got == sorted(jaccard_components(docs, 3, 90), key=str)
    assert any(g[0] != g[2] for g in got)


def test_one_of_each_group_keeps_columns_and_blank_texts(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t, 7), (2, t + " x", 8), (2, t + " x", 8), (3, None, 9), (4, "", 1), (4, "", 1), (5, "other", 2)],
                               "doc_id long, text string, cls int")
    got = sorted((r["doc_id"], r["cls"]) for r in ngramjoin.one_of_each_group(df).collect())
    assert got == [(1, 7), (3, 9), (4, 1), (4, 1), (5, 2)]
    empty = spark.createDataFrame([], "doc_id long, text string, cls int")
    assert ngramjoin.one_of_each_group(empty).count() == 0


def test_one_of_each_group_by_id_and_text(spark):
    text = lambda x, n=30: " ".join(f"{x}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (3, text("d")), (3, text("e")),
            (3, text("e")), (4, text("f")), (9, text("f") + " x"), (9, text("g")), (None, text("g") + " y"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in ngramjoin.one_of_each_group(df).collect()), key=str)
    assert got == sorted([(None, text("a")), (None, text("b")), (None, text("c")), (3, text("d")), (3, text("e")), (4, text("f")),
                          (9, text("g")), (None, None), (None, None)], key=str)


def test_components_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 150] + [(7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(e).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(n + 1)}


def brute_vectors(vectors, t):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    u, n = Union(range(len(vectors))), [0] * len(vectors)
    for i, (_, a) in enumerate(vectors):
        for j in range(i + 1, len(vectors)):
            b = vectors[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                a_, b_ = np.array(a, float), np.array(b, float)
                if a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_) >= t:
                    n[i] += 1
                    n[j] += 1
                    u.join(i, j)
    low = {}
    for i, (d, _) in enumerate(vectors):
        low[u.find(i)] = min(low.get(u.find(i), d), d)
    return sorted((d, n[i], low[u.find(i)], d == low[u.find(i)]) for i, (d, _) in enumerate(vectors))


def test_cover_tree_planted(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 20)
    r = np.random.default_rng(2)
    v = [list(map(float, r.normal(size=8).astype(np.float32))) for _ in range(120)]
    hot = r.normal(size=8)
    v += [list(map(float, (hot + 0.1 * r.normal(size=8)).astype(np.float32))) for _ in range(150)]
    v += [v[0], v[0], [x * 3 for x in v[1]], None, [], [0.0] * 8, [float("nan")] + v[2][1:], [None] + v[2][1:], v[3][:7],
          [float("inf")] * 8, v[130], v[130]]
    rows = [(i * 3 + 1, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(x) for x in covertree.near_duplicates(df, 0.95).collect())
    assert got == brute_vectors(rows, 0.95)


def test_cover_tree_query_on_tables(spark):
    rows = [(x["vec_id"], list(x["embedding"])) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(x) for x in queries.op4_embedding_near_dup(spark, SF).collect())
    assert got == brute_vectors(rows, 0.95)


def test_cover_tree_empty_table(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ngram_join_holds_few_texts_at_a_time(spark, monkeypatch):
    """Batches of Arrow and slices of texts are small while texts are hashed; neither changes the result."""
    rows = [(i, " ".join(f"w{(i // 3 * 7 + j) % 97}" for j in range(30 + i % 3))) for i in range(60)] + [(60, None), (61, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, seen, staged = spark.conf.get(common.BATCH), [], ngramjoin.stage
    monkeypatch.setattr(ngramjoin, "stage", lambda df, name: seen.append(int(spark.conf.get(common.BATCH))) or staged(df, name))
    one = sorted(map(tuple, ngramjoin.jaccard_components(docs).collect()))
    assert seen and max(seen) <= 1000 and ngramjoin.SLICE <= 1 << 18 and spark.conf.get(common.BATCH) == before
    with common.arrow_rows(spark, 7):
        assert sorted(map(tuple, ngramjoin.jaccard_components(docs).collect())) == one and spark.conf.get(common.BATCH) == "7"
    assert spark.conf.get(common.BATCH) == before
    texts = pa.array([t for _, t in rows])
    whole = [s.tolist() for s in ngramjoin._sets(texts, 3)]
    monkeypatch.setattr(ngramjoin, "SLICE", 100)
    assert [s.tolist() for s in ngramjoin._sets(texts, 3)] == whole


def test_ngram_join_counters_travel_packed_and_sets_go_when_compared(spark, monkeypatch):
    """The token order is that of the summed counters; whole sets and unions of blocks are deleted once they are compared."""
    count = np.zeros(1 << ngramjoin.COUNT_BITS, np.int64)
    count[[0, 5, 9000, 20000, 30000]] = 1, 255, 256, 70_000, 1 << 33
    rows = dict(ngramjoin._packed(count))
    assert {i: len(x) // ngramjoin.COUNTERS for i, x in rows.items()} == {0: 1, 1: 2, 2: 4, 3: 8}
    docs = [(i, " ".join(f"w{(i // 3 * 7 + j) % 97}" for j in range(30 + i % 3))) for i in range(60)] + [(60, None), (61, "a b")]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    scan = ngramjoin._scan(df, 3)
    assert scan.where("bucket is not null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= count.size // ngramjoin.COUNTERS
    whole = np.zeros(count.size, np.int64)
    for s in ngramjoin._sets(pa.array([t for _, t in docs]), 3):
        np.add.at(whole, (s >> np.uint64(64 - ngramjoin.COUNT_BITS)).astype(np.int64), 1)
    assert np.array_equal(ngramjoin._levels(scan), np.where(whole > 0, 2 * np.log2(np.maximum(whole, 1)), 0).astype(np.uint8))

    gone, delete = [], common._delete
    left: list = []
    monkeypatch.setattr(common, "_delete", lambda s, path: gone.append(path.rsplit("/", 1)[1]) or delete(s, path))
    named = ngramjoin.components
    monkeypatch.setattr(ngramjoin, "components", lambda e, name: left.append([p for f in common._inside for p in f]) or named(e, name))
    ngramjoin.jaccard_components(df).collect()
    assert len(left) == 2 and all("join-links" in " ".join(p) and "join-sets" not in " ".join(p) and "join-unions" not in " ".join(p) for p in left)
    assert {"join-sets", "join-unions", "join-links"} <= {x.rsplit("-", 1)[0] for x in gone} and common._inside == []


def test_cover_tree_in_groups_and_rounds(spark, monkeypatch):
    """Leaves in more groups than a round settles; nothing that was staged on the way stays."""
    for name, value in (("LEAF", 20), ("GROUPS", 5), ("ROUND_BYTES", 0)):
        monkeypatch.setattr(covertree, name, value)
    r = np.random.default_rng(3)
    hot = r.normal(size=8)
    v = [list(map(float, r.normal(size=8))) for _ in range(60)] + [list(map(float, hot + 0.1 * r.normal(size=8))) for _ in range(60)]
    v += [[x * 3 for x in v[1]], [x * 1e200 for x in v[2]], [x * 1e-200 for x in v[3]], v[70], None, v[3][:7], v[5][:7]]
    rows = [(i * 3 + 1, x) for i, x in enumerate(v)]
    want = [(i, x and [y / max(map(abs, x)) for y in x]) for i, x in rows]
    top = Path(scratch_path(spark, f"llm-{spark.sparkContext.applicationId}").removeprefix("file:"))
    before = set(top.glob("cover-*"))
    out = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 0.95)
    assert {p.name.rsplit("-", 1)[0] for p in set(top.glob("cover-*")) - before} == {"cover-result"}
    assert sorted(tuple(x) for x in out.collect()) == brute_vectors(want, 0.95)


def test_near_duplicates_of_null_and_zero_ids(spark):
    """A null doc_id is not the id 0, whose document's set must not be read for it."""
    text = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(0, text("a")), (None, text("b")), (None, text("b") + " x"), (7, text("a") + " x"), (0, text("c"))]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngramjoin.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == [(0, 0), (0, 0), (7, 0), (None, None), (None, None)]
