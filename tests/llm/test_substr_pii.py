import hashlib
import random

import pytest
from helpers import SF, dedup_substrings, pii_row, rows

from lapse.llm import pii, queries, substr

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check_substr(spark, docs, parts=3):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], SCHEMA).repartition(parts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substr.dedup_substrings(df).collect()}
    assert got == {d: x for d, *x in ((d, n, g, k) for d, n, g, k in dedup_substrings(docs)) for x in [tuple(x)]}


def test_substring_planted(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 33, 60)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            i = r.randint(0, len(w))
            w[i:i] = p[r.randint(0, 2):]
        docs.append((d * 7 - 50, " ".join(w)))
    docs += [(1000, docs[5][1]), (1001, docs[5][1] + " tail"), (1002, None), (1003, ""), (1004, " \t\n "),
             (1005, "a " * 100), (1006, "\tx  y\n" + docs[7][1] + "\r\n"), (1007, "á é " * 30), (None, "b " * 30)]
    check_substr(spark, docs)
    check_substr(spark, docs, 1)


def test_substring_long_text_and_empty_table(spark):
    r = random.Random(4)
    w = [str(r.randint(0, 10**6)) for _ in range(30000)]
    check_substr(spark, [(1, " ".join(w)), (2, " ".join(w[100:20000] + ["x"] + w[25000:]))])
    assert substr.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 45), ("b", 30), ("c", 70)))
    docs = [(1, a), (1, a), (1, a), (2, "new " + a), (None, c), (None, b), (None, c), (None, None), (5, "x " + b), (5, "short"),
            (-2**63, "y " + b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for parts in (1, 4):
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substr.dedup_substrings(df.repartition(parts)).collect()),
                     key=str)
        assert got == sorted([(1, 45, 0, a)] * 3 + [(2, 46, 45, "new"), (None, 70, 0, c), (None, 70, 0, c), (None, 30, 0, b), (None, 0, 0, ""),
                                                    (5, 31, 30, "x"), (5, 1, 0, "short"), (-2**63, 31, 30, "y")], key=str)


def test_substring_query_on_tables(spark):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in dedup_substrings(docs))
    got = sorted(tuple(x) for x in queries.op8_substring_dedup(spark, SF).collect())
    assert got == want and any(x[2] for x in got)


TRICKY = [
    None, "", "no data", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (269) 555-3296 +12 34 +1234567890123456", "a.b+c%d@x-y.z.co, m@n", "" + "q" * 5 + " u@v.w ñ@ñ.ñ é9.9.9.9",
    "u@v.w", "1" * 40 + " 4" + "0" * 12, "@a.b c@d", "+1+2+3 +1-2-3-4-5-6-7-8-9", "x" * 3000 + "@" + "y" * 3000,
    "9" * 3000 + ".1.2.3", "a@b" + ".c" * 3000, "1 " * 600 + "8.8.8.8 " * 300 + "é m@n.o",
]


def test_pii_matches_the_plain_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    got = sorted(tuple(r) for r in pii.summary(df).collect())
    assert [g[:6] for g in got] == [pii_row(i, t)[:6] for i, t in enumerate(TRICKY)]


def test_pii_query_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(pii_row(d, t) for d, t in docs)
    got = sorted(tuple(r) for r in queries.op9_pii(spark, SF).collect())
    assert got == want and sum(g[3] for g in got)


@pytest.mark.parametrize("text,spans", [
    ("IBAN GB82 WEST 1234 5698 7654 32 ok", "iban:5:32"), ("GB82WEST12345698765432", "iban:0:22"),
    ("GB82WEST12345698765433", ""), ("ssn: 078-05-1120", "ssn:5:16"), ("part 078-05-1120", ""),
])
def test_added_kinds_need_checksum_or_context(spark, text, spans):
    got = pii.summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert ",".join(s for s in got["spans"].split(",") if s[:4] in ("iban", "ssn:")) == spans


def test_pii_keeps_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a@b.c", 5, "z")], "doc_id long, text string, `_t` int, spans string")
    assert [r["_t"] for r in pii.detect(df).collect()] == [5]
    assert rows(pii.summary(spark.createDataFrame([], "doc_id long, text string"))) == []
