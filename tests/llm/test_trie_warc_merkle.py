"""Conversation trie, WARC archives and Merkle manifest against brute force, round trips and damage."""
import collections
import hashlib
import os
import random
import struct
import tempfile
import zlib

import pytest
import zstandard
from helpers import SF, WORD, lower, rows
from pyspark.sql import functions as F

from lapse.llm import merkle, queries, trie, warc

CONV = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- trie ----

def brute_trie(turns):
    convs = collections.defaultdict(list)
    for c, turn, role, text in turns:
        role, text = role or "", text or ""
        convs[c].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c, v in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        donor = [] if c is None else own.get(c - int(__import__("math").fmod(c, 20)), [])
        r = tuple(donor[:h] + v[h:])
        for d in range(len(r) + 1):
            members[r[:d]].append(c)
        ends[r].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)

    def low(p):
        return min((c for c in members[p] if c is not None), default=None)

    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        out.append((low(p), len(p), low(p[:-1]) if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved,
                    sha(",".join(str(c) for c in sorted(c for c in ends[p] if c is not None)))))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def check_trie(spark, turns, **options):
    got = rows(trie.trie(spark.createDataFrame(turns, CONV), **options).drop("node", "parent"))
    assert got == brute_trie(turns)


def test_trie_on_the_given_table(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows(queries.op11_conversation_trie(spark, SF)) == brute_trie([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])


def test_trie_cases(spark):
    turns = [(c, t, "u" if t % 2 == 0 else "a", f"text {t if t < 2 else c * 7 % 3 + t} more") for c in range(45) for t in range(c % 6)]
    turns += [(100, 0, None, None), (100, None, "u", ""), (100, 1, "u", "b"), (100, 1, "u", "a"), (100, 1, "u", "a"),
              (None, 0, "u", "x y"), (None, 1, "u", "z"), (-7, 0, "u", "neg"), (-20, 0, "u", "neg donor"), (-20, 1, "u", "two"),
              ((1 << 63) - 1, 0, "u", "large"), (-(1 << 63), 0, "u", "small"), (7000000, 0, "u", "w " * 30000)]
    turns += [(c, 0, "u", "the same") for c in range(20000, 20040)]      # ends of many ids
    check_trie(spark, turns)


def test_trie_of_nothing_and_clashing_columns(spark):
    assert trie.trie(spark.createDataFrame([], CONV)).count() == 0
    t = spark.createDataFrame([(1, 0, "u", "a b"), (2, 0, "u", "a b")], CONV)
    wide = t.select("*", *[F.lit("x").alias(c) for c in ("c", "none", "k", "m", "r", "depth", "id1", "words", "piece")])
    assert rows(trie.trie(wide)) == rows(trie.trie(t))


def test_trie_in_many_small_blocks(spark, monkeypatch):
    """One long conversation, a node with many children, many ends: all in pieces, the tour by random mates."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "MANY", 3)
    turns = [(0, t, "u", f"{t} t") for t in range(40)] + [(c, 0, "u", f"child {c} {c % 3}") for c in range(1, 30)]
    turns += [(c, 0, "u", "0 t") for c in range(10000, 10400, 7)] + [(c * 5000, 0, "x", "far") for c in range(10, 20)]
    check_trie(spark, turns, block=8, last=5)


def test_list_prefix_against_a_walk(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 300)
    w = {a: (rng.randint(0, 1), rng.randint(0, 9)) for a in ids}
    links = [(a, b, 1, *w[a]) for a, b in zip(ids, ids[1:] + [None])]
    df = spark.createDataFrame(links, "a long, succ long, n long, leaves long, saved long")
    want, n, x, y = [], 0, 0, 0
    for a in ids:
        want.append((a, n, x, y))
        n, x, y = n + 1, x + w[a][0], y + w[a][1]
    for block, last in ((64, 20), (2000, 1)):
        assert rows(trie.list_prefix(df, block, last)) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


# ---- WARC ----

def pages_row(page, html, group):
    body = (html or "").encode()
    top = max((p for p in group if p is not None), default=None)
    revisit = len(body) >= 1000 and page != top
    return (page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None)


def check_pages(spark, data, **options):
    groups = collections.defaultdict(list)
    for p, _, html in data:
        groups[html or ""].append(p)
    got = warc.round_trip(spark.createDataFrame(data, PAGES), **options)
    assert got.where("problem is not null").count() == 0
    got = rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert got == sorted((pages_row(p, h, groups[h or ""]) for p, _, h in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600 + "</p>"
    data = [(i, f"http://h{i % 3}/p{i}", f"<html>{i}" + "word " * (i * 20) + "</html>") for i in range(60)]
    data += [(100 + i, f"http://x/{i}", big) for i in range(40)]
    data += [(200, None, None), (201, "http://x/\r\nWARC-Type: metadata y", ""), (202, "http://é/", "a\r\n\r\nb\r\n\r\n"), (203, "u", "small"),
             (204, "u", "small"), (None, "u", "null id"), (205, "u", "x" * 3_000_000), (139, "http://x/39", big), (None, "v", big)]
    check_pages(spark, data)
    check_pages(spark, data, archive_bytes=2000)


def test_warc_of_the_given_pages_and_none(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    check_pages(spark, [tuple(r) for r in p.collect()])
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    wide = p.select("*", *[F.lit("x").alias(c) for c in ("digest", "payload", "first", "value", "record_id")])
    assert warc.round_trip(wide).count() == p.count()


def test_archives_are_plain_zstandard_files(spark):
    """A reader that knows nothing of this module decodes them: skippable dictionary first, then a frame per record."""
    path = tempfile.mkdtemp(prefix="lapse-warc-") + "/a"
    html = [f"<html><body>page {i} {'some words of it ' * 40}</body></html>" for i in range(200)]
    warc.write_archives(spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], PAGES).coalesce(1), path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    data = open(f"{path}/{files[0]}", "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert len(files) == 1 and magic == 0x184D2A5D
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data[8:8 + size]))
    with zstandard.ZstdDecompressor(dict_data=d).stream_reader(data[8 + size:], read_across_frames=True) as r:
        text = r.read()
    assert text.count(b"WARC/1.1\r\n") == 200 and all(h.encode() in text for h in html)
    assert len(data) < sum(map(len, html)) / 5
    # a payload comes back as it was
    back = warc.read_archives(spark, path)
    assert sorted(bytes(r["payload"]).decode() for r in back.select("payload").collect()) == sorted(html)


def record(payload=b"hello", **change):
    r = warc.build_record(1, "u", payload, hashlib.sha1(payload).hexdigest(), "<urn:uuid:1>", None)
    for a, b in change.values():
        assert a in r
        r = r.replace(a, b)
    return r


@pytest.mark.parametrize("change, problem", [
    ((b"WARC/1.1", b"WARC/9.9"), "version"), ((b"WARC-Date: 2000-01-01T00:00:00Z\r\n", b""), "WARC-Date"),
    ((b"hello\r\n\r\n", b"hell\r\n\r\n"), "block of"), ((b"hello", b"hallo"), "digest"), ((b"Content-Length: 5", b"Content-Length: 6"), "digest"),
    ((b"Page-ID: 1", b"no colon"), "header line"), ((b"WARC-Type: response", b"WARC-Type: revisit"), "Refers-To"),
    ((b"HTTP/1.1", b"FTPS/1.1"), "digest")])
def test_bad_records_are_told(change, problem):
    good = warc.parse_record(record())
    assert good["problem"] is None and good["payload"] == b"hello"
    assert problem in warc.parse_record(record(x=change))["problem"]


def test_damaged_archives(spark):
    """Records before and after a damaged frame are read; the damage is told."""
    comp = zstandard.ZstdCompressor(write_checksum=True)
    parts = [comp.compress(record(f"payload {i} {'z' * i}".encode())) for i in range(5)]
    bad = bytearray(parts[2])
    bad[-1] ^= 1                                             # the checksum
    path = tempfile.mkdtemp(prefix="lapse-warc-")
    files = {"a": b"".join([*parts[:2], bytes(bad), *parts[3:]]), "b": b"".join(parts) + parts[0][:-7],
             "c": parts[0] + b"garbage and more", "d": b"", "e": struct.pack("<II", 0x184D2A53, 3) + b"abc" + parts[4]}
    for name, data in files.items():
        with open(f"{path}/{name}.warc.zst", "wb") as f:
            f.write(data)
    got = warc.read_archives(spark, path).groupBy(F.substring_index("file", "/", -1).alias("f")).agg(
        F.count_if(F.col("problem").isNull()).alias("good"), F.count_if(F.col("problem").isNotNull()).alias("bad"))
    assert rows(got) == [("a.warc.zst", 4, 1), ("b.warc.zst", 5, 1), ("c.warc.zst", 1, 1), ("e.warc.zst", 1, 0)]


def test_a_revisit_without_its_response_is_told(spark):
    r = warc.build_record(1, "u", b"x" * 2000, hashlib.sha1(b"x" * 2000).hexdigest(), "<urn:uuid:1>", "<urn:uuid:gone>")
    path = tempfile.mkdtemp(prefix="lapse-warc-")
    with open(f"{path}/a.warc.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(r))
    got = warc.resolve(warc.read_archives(spark, path)).first()
    assert "not there" in got["problem"] and got["payload_bytes"] == 2000 and got["refers_to"] is None


# ---- Merkle ----

def brute_merkle(docs):
    def leaf(*v):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            x = out[-1]
            out.append([sha("".join(x[i:i + 16])) for i in range(0, len(x), 16)])
        return out

    def path(levs, i):
        out = []
        for x in levs[:-1]:
            lo = i // 16 * 16
            out.append(("".join(x[lo:i]), "".join(x[i + 1:lo + 16])))
            i //= 16
        return out

    per = collections.defaultdict(list)
    for d, text, lang, source, n in docs:
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        a = leaf(d, source, lang, n, text)
        per[source].append(((d is not None, d or 0, a), d, a, leaf(d, source, lang, n, None if text is None else lower(text)) if hit else a))
    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(per[s], key=lambda x: x[0])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, d, a, b) in enumerate(sorted(per[s], key=lambda x: x[0])):
            p = path(trees[s], i) + path(top, k)
            f = b
            for lo, hi in p:
                f = sha(lo + f + hi)
            out.append((d, a, trees[s][-1][0], top[-1][0], sha("".join(lo + hi for lo, hi in p)), f, f == top[-1][0]))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def check_merkle(spark, docs):
    assert rows(merkle.proofs(spark.createDataFrame(docs, DOCS))) == brute_merkle(docs)


def test_merkle_on_the_given_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert rows(queries.op13_merkle(spark, SF)) == brute_merkle([tuple(r) for r in d.collect()])


def test_merkle_cases(spark):
    docs = [(i, f"Text {i}", "en", "hot", i) for i in range(300)] + [(i, "Same", None, f"s{i % 18}é", None) for i in range(1000, 1040)]
    docs += [(None, None, None, None, None), (None, "x", "de", None, 3), (-5, "", "", "", 0), (7, "twice", "en", "hot", 1), (7, "twice", "en", "hot", 1),
             (8, "Long " * 40000, "en", "one", 1), (9, "-", "-", "Z", 1)]
    check_merkle(spark, docs)
    check_merkle(spark, docs[:1])
    check_merkle(spark, docs[:17])


def test_merkle_over_several_blocks(spark, monkeypatch):
    """Blocks of two digits of base 16: the rollup goes up and the paths come down more than once."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    check_merkle(spark, [(i, f"T {i}", "en", "a" if i < 290 else f"s{i}", i) for i in range(310)])


def test_merkle_of_nothing_and_clashing_columns(spark):
    assert merkle.proofs(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(1, "A", "en", "s", 1), (2, "B", "en", "s", 1)], DOCS)
    wide = d.select("*", *[F.lit("x").alias(c) for c in ("leaf", "i", "n", "b", "digest", "path", "above", "place", "m")])
    assert rows(merkle.proofs(wide)) == rows(merkle.proofs(d))
