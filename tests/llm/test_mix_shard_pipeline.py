import collections
import zlib

import pytest
from helpers import SF, WORD, jaccard_components, rows, shingles
from pyspark.sql import functions as F

from lapse.llm import mix, queries, shard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fill(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * per >= 2 * sizes[s]}
        if not over:
            target.update({s: w[s] * per for s in open_})
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


DATA = [(i, "w " * (i * 37 % 91), "en", f"s{i % 5}" if i % 7 else None, 0) for i in range(200)] + [
    (500, None, "en", "s1", 0), (501, "", None, "zz", 0), (502, "a b", "en", "s1", 0), (502, "a b", "en", "s1", 0),
    (None, "c d e", "en", "s2", 0)]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mix_takes_its_targets(spark, block):
    df = spark.createDataFrame(DATA, DOCS).repartition(4)
    docs, pieces = mix.mix(df, block=block)
    got = docs.collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in DATA:
        sizes[s] += len(WORD.findall(t or ""))
    want = fill(sizes)
    assert len(got) == len(DATA)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    p = pieces.collect()
    assert sum(x["to_word"] - x["from_word"] for x in p) == sum(taken.values())
    assert all(0 <= x["from_word"] < x["to_word"] for x in p)
    # a slot stands for one block of one source
    per = collections.Counter()
    for x in p:
        per[x["slot"], x["src"], x["snull"]] += x["to_word"] - x["from_word"]
    assert len({k[0] for k in per}) == len(per) and max(per.values()) <= block
    again, _ = mix.mix(df.repartition(2), block=block)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_schedule_is_of_low_discrepancy(spark):
    sizes = spark.createDataFrame([("a", 60_000), ("b", 60_000), ("c", 60_000)], "source string, source_size long")
    s = sorted((r["slot"], r["src"]) for r in mix.schedule(mix.targets(sizes), 100).collect())
    share = collections.Counter(x for _, x in s)
    seen = collections.Counter()
    for n, (_, src) in enumerate(s, 1):
        seen[src] += 1
        assert all(abs(seen[k] - n * share[k] / len(s)) < 6 for k in share)


def test_mix_empty_table_and_extra_columns(spark):
    docs, pieces = mix.mix(spark.createDataFrame([], DOCS))
    assert docs.count() == 0 and pieces.count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 3, 4)], "doc_id long, text string, source string, size int, start int")
    out = mix.mixed_documents(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {(1, "a b", "x", 3, 4)}


def test_shards_are_even_and_whole(spark):
    df = spark.createDataFrame(DATA, DOCS).repartition(4)
    got = shard.kd_shards(df, n_shards=8).collect()
    assert len(got) == len(DATA)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    mean = sum(size.values()) / 8
    assert set(by) == set(range(8)) and max(abs(v - mean) for v in size.values()) <= 3 * 183
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    crc = collections.Counter((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, *_ in DATA)
    assert crc == collections.Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got)


def test_shards_by_bytes_equal_points_and_empty_table(spark, tmp_path):
    same = spark.createDataFrame([(1, "abc", "en", "s", 3)] * 64, DOCS)
    n = collections.Counter(r["shard"] for r in shard.kd_shards(same, target_bytes=64).collect())
    assert sum(n.values()) == 64 and len(n) == 4 and max(n.values()) <= 32
    assert shard.kd_shards(spark.createDataFrame([], DOCS), n_shards=8).count() == 0
    assert shard.kd_shards(spark.createDataFrame([(1, None, None, None, None)], DOCS), n_shards=8).count() == 1
    out = shard.sharded_documents(same.withColumnRenamed("lang", "shard"), n_shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted(set((r["shard"], r["slot"]) for r in out)) and len(out) == 64
    shard.write_shards(same, str(tmp_path / "out"), n_shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 64


def test_shard_query(spark):
    got = queries.op2_shard(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    size = collections.Counter()
    for r in got.collect():
        size[r["shard"]] += r["size"]
    biggest = max(r["size"] for r in got.select("size").collect())
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 3 * biggest


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    step = dict(cp.STAGES)
    lang = step["language"](spark, docs, SF)
    assert lang.columns == docs.columns and lang.count() >= 0.99 * docs.count()
    near = step["near_duplicates"](spark, docs, SF)
    comp = jaccard_components([(d, r["text"]) for d, r in whole.items()], 5, 80)
    assert near.columns == docs.columns
    assert {tuple(r) for r in near.collect()} == {tuple(whole[d]) for d, n, c in comp if d == c or not n}
    clean = step["decontaminate"](spark, docs, SF)
    items = [shingles(r["text"], 13) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, r in whole.items() if any(shingles(r["text"], 13) & i for i in items)}
    kept = {r["doc_id"] for r in clean.collect()}
    assert not kept & leaked and len(kept) >= 0.9 * len(whole)
    some = step["mix"](spark, docs, SF)
    n = collections.Counter(r["doc_id"] for r in some.collect())
    assert some.columns == docs.columns and max(n.values()) == 2
    placed = step["shard"](spark, some, SF)
    assert placed.columns[:5] == docs.columns and placed.count() == sum(n.values())


def test_pipeline_runs(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, SF)
    assert out.count() > 0 and set(rows(out.select("shard").distinct())) == {(i,) for i in range(8)}


def test_equal_rows_get_their_places_without_a_list(spark):
    from lapse.llm import shard
    docs = [(1, "same text", "en", "s", 9)] * 300 + [(i, f"text {i}", "en", "s", 7) for i in range(2, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = shard.sharded_documents(df, n_shards=4)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((d[0], d[1]) for d in docs)
    places = {(r["shard"], r["slot"]) for r in rows}
    n = [sum(s == k for s, _ in places) for k in range(4)]
    assert len(places) == len(docs) and places == {(k, i) for k in range(4) for i in range(n[k])}


def test_strings_split_by_rank_and_names_may_clash(spark):
    """Sources that share a long prefix still part into shards; columns may have the names used inside."""
    rows = [(i, "x" * 50, f"https://host.example/{i % 4:03d}", "en", 7) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    wide = d.select("*", *[F.lit(9).alias(c) for c in ("_file", "_nth", "_row", "v0", "node", "_rank", "row_key")])
    got = shard.sharded_documents(wide, n_shards=4, dimensions=("source",))
    assert got.columns == [*wide.columns, "shard", "slot"]
    per = {(r["source"], r["shard"]) for r in got.collect()}
    assert len(per) == 4 and got.count() == 80


def test_shards_of_a_plain_scan_equal_those_of_a_copy(spark, tmp_path):
    rows = [(i % 30, "word " * (i % 7), f"s{i % 3}", "en", i) for i in range(60)] + [(1, "same", "s", "en", 1)] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    d.repartition(3).write.parquet(str(tmp_path / "docs"))
    got = shard.sharded_documents(spark.read.parquet(str(tmp_path / "docs")), n_shards=4)
    assert sorted(map(tuple, got.select(*d.columns).collect())) == sorted(map(tuple, d.collect()))
    slots = [(r["shard"], r["slot"]) for r in got.collect()]
    assert len(set(slots)) == 65 and all((s, k - 1) in set(slots) for s, k in slots if k)


def test_stages_take_odd_tables(spark):
    """Nulls in any column, empty texts, repeated rows, clashing columns and an empty table through every stage."""
    import corpus_pipeline as cp
    text = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old barn roof tonight"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " again", None, None, None), (2, None, None, "a", None),
            (3, "", "en", "b", 0), (4, "!!! ???", "en", "b", 7), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = d.select("*", *[F.lit("x").alias(c) for c in ("_id", "_t", "_key", "_row", "_file", "shard", "size", "cls")])
    for docs in (wide, wide.limit(0)):
        for name, step in cp.STAGES:
            docs = step(spark, docs, SF)
            assert set(wide.columns) <= set(docs.columns), name
            assert docs.count() <= 14
