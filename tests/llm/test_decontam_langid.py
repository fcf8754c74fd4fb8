import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from helpers import SF
from pyspark.sql import functions as F

from lapse.llm import decontam, langid, queries

TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def brute(docs, items, verify=13, share=0.8):
    """Every window of every document against every window of every item, without masks."""
    out = {}
    for d, t in docs:
        w = TOKEN.findall((t or "").lower())
        for i, u in items:
            v = TOKEN.findall((u or "").lower())
            size = min(verify, len(v))
            for p in range(len(w) - size + 1 if size else 0):
                for q in range(len(v) - size + 1):
                    same = sum(a == b for a, b in zip(w[p:p + size], v[q:q + size]))
                    if same >= share * size:
                        best = (same, size, -p, -q)
                        out[d, i] = max(out.get((d, i), best), best)
    return [(d, i, n, c, -p, -q) for (d, i), (n, c, p, q) in out.items()]


def test_masks_find_every_allowed_pattern():
    """All patterns of substitutions of items of 1 to 20 tokens; beyond 13 in any window of 13."""
    for n in range(1, 21):
        size = min(n, 13)
        allowed = size - -(-8 * size // 10)
        assert decontam._allowed(size, 0.8) == allowed
        masks, span = (decontam.MASKS, decontam.SPAN) if n >= 13 else (decontam.whole_masks(n, allowed), n)
        for bad in itertools.combinations(range(size), allowed):
            assert any(all(at + k not in bad for k in m) for m in masks for at in range(size - span + 1))


def test_decontamination_planted(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 18, 13, 12, 9, 8, 7, 6, 5, 4, 1))]
    items += [(20, items[0][1]), (21, None), (22, ""), (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9")]
    docs = [(100 + d, " ".join(word() for _ in range(r.randint(0, 40)))) for d in range(30)]
    for d, (i, t) in enumerate(items):
        w = (t or "").split()
        docs.append((200 + d, "x y " + (t or "").upper() + "!!! z"))
        docs.append((300 + d, "%%% ".join(w) + " and more words follow here"))
        for n in (1, 2, 4):
            v = list(w)
            for _ in range(n):
                if v:
                    v[r.randrange(len(v))] = "CHANGED"
            docs.append((400 + 10 * d + n, "a b c " + "  ".join(v) + " d e"))
        docs.append((700 + d, " ".join(w[len(w) // 2:])))
        docs.append((800 + d, " ".join(w[:len(w) // 2] + ["new"] + w[len(w) // 2:])))
    docs.append((900, " ".join(items[0][1].split() * 20 + [f"u{k}" for k in range(3000)])))                   # a long text
    docs += [(1, None), (2, ""), (3, "..."), (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9 r")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bm = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in decontam.contaminated(df, bm).drop("text_hash").collect()), key=str)
    assert got == sorted(brute(docs, items), key=str) and len(got) > 40


def test_decontamination_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs, bm = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontam.contaminated(docs, bm).collect()))
    monkeypatch.setattr(decontam, "SEED_ROWS", 10)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert want == sorted(map(tuple, decontam.contaminated(docs, bm).collect())) and want
    bad = {r[0] for r in want}
    clean = decontam.clean_documents(docs, bm)
    assert clean.columns == docs.columns and clean.count() == docs.where(~docs.doc_id.isin(*bad)).count()


def test_decontamination_empty_tables_and_extra_columns(spark):
    d = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, w int, seed int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, none).count() == 0
    assert [tuple(r) for r in decontam.clean_documents(d, none).collect()] == [(1, "a", 2, 3)]
    assert decontam.contaminated(d.limit(0), spark.createDataFrame([(1, "b " * 20)], none.schema)).count() == 0


def test_decontamination_query_finds_the_planted_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(TOKEN.findall((t or "").lower())) + " "
    whole = {(d["doc_id"], i["item_id"]) for d in docs for i in items if norm(i["text"]) in norm(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()}
    assert whole <= got and {d for d, _ in got} == {d for d, _ in whole}


def test_language_query_accuracy_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op10_language_id(spark, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert [r for r in got if r["held_out"]] == held
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_language_edge_cases(spark):
    rows = [(i, t, l, l, i) for i, (t, l) in enumerate([("der die das und nicht", "de"), ("the of and to in", "en")] * 60)]
    rows += [(900, None, "en", None, 1), (901, "", None, None, 1), (902, "123 -- !", "de", None, 1), (903, "é" * 50, None, "x", 2),
             (904, "the and of " * 20000, None, "x", 2), (905, "Die und nicht", None, "x", 2), (905, "Die und nicht", None, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    model = langid.fit(df, df.doc_id < 900)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(df, model).collect()}
    assert [got[k][:2] for k in (900, 901, 902)] == [("und", 0.0)] * 3 and all(got[k][2] for k in (900, 901, 902))
    assert got[903][0] in ("de", "en") and got[904][0] == "en" and got[905][0] == "de"
    assert langid.predict(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, langid.train([])).collect()} == {"und"}
    out = langid.identified_documents(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} >= set(range(100))


def test_language_prediction_does_not_depend_on_the_slice():
    samples = []
    for t, label in [("der die das und", "de"), ("the of and to", "en")] * 20:
        ids, counts = next(langid._counts(pa.array([t])))
        samples.append((label, __import__("numpy").array(ids), __import__("numpy").array(counts, float)))
    m = langid.train(samples)
    texts = ["the of", "die und der " * 50, "", "ñ the\tand\nof"] * 5
    one = [m.predict(pa.array([t])) for t in texts]
    all_ = m.predict(pa.array(texts))
    assert [x[0][0] for x in one] == all_[0]
    assert [x[1][0] for x in one] == pytest.approx(list(all_[1]), rel=1e-12)


def test_language_prediction_holds_few_texts_at_a_time(monkeypatch):
    """Texts of one Arrow batch are classified in slices of at most 128 KB, one text at least."""
    m, seen = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)), np.zeros(2)), []
    logits = langid.Model.logits
    monkeypatch.setattr(langid.Model, "logits", lambda self, d, o: seen.append((len(d), len(o) - 1)) or logits(self, d, o))
    texts = pa.array(["die der das " * 400] * 200 + ["und " * 60_000, None, ""])
    m.predict(texts)
    assert sum(n for _, n in seen) == len(texts) and all(size <= 1 << 17 or n == 1 for size, n in seen)


def test_documents_without_passages_keep_all_columns(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    d = spark.createDataFrame([(1, "x " + t, 1), (2, "clean", 2), (2, "clean", 2), (None, None, 3), (None, t, 4)], "doc_id long, text string, n long")
    wide = d.select("*", *[F.lit(7).alias(c) for c in ("_id", "_t", "_id0", "_t0", "_row", "seed", "w", "at")])
    bm = spark.createDataFrame([(5, t)], "item_id long, text string")
    got = decontam.clean_documents(wide, bm)
    assert got.columns == wide.columns and sorted(r["n"] for r in got.collect()) == [2, 2, 3]
    assert decontam.clean_documents(d.limit(0), bm).count() == 0 and decontam.clean_documents(d, bm.limit(0)).count() == 5


def test_language_sample_is_held_in_eight_bytes_an_ngram(spark, monkeypatch):
    """What the driver learns from: ids and counts of four bytes each, in the fixed order."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples, **_: seen.extend(samples))
    rows = [(None if i == 5 else i, "one two three " * (i + 1), "en" if i % 2 else "de") for i in range(20)] + [(3, "three", "en"), (3, "four", "en")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), F.lit(True))
    assert len(seen) == 22 and all(i.dtype == c.dtype == np.int32 and len(i) == len(c) for _, i, c in seen)
    key = lambda r: (math.floor((r[0] or 0) * 0.6180339887498949 % 1 * 1e9), r[0] or 0, r[2])
    assert [s[0] for s in seen] == [r[2] for r in sorted(rows, key=key)]
