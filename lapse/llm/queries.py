"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.llm import covertree, decontam, html, langid, lm, merkle, ngramjoin, pii, substr, trie, warc
from lapse.llm import mix as mix_
from lapse.llm import shard as shard_
from lapse.llm.common import table


def op1_mix(spark, sf_dir):
    """All documents mixed to 150 % of their words, sources weighted 3, 1, 2, repeating."""
    docs, _ = mix_.mix(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken", "source")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY source)::BIGINT AS source_size,
         (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size
                          ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS n, (2 * sum(size))::DOUBLE AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
lev AS (
  SELECT a.source, a.cap, a.w, a.cap / a.w AS r,
         ((SELECT sum(n) FROM s) * 1.5::DOUBLE - coalesce((SELECT sum(cap) FROM s b WHERE b.cap / b.w < a.cap / a.w), 0))
           / (SELECT sum(w) FROM s b WHERE b.cap / b.w >= a.cap / a.w) AS level
  FROM s a),
fill AS (SELECT min_by(level, r) AS level FROM lev WHERE cap > w * level),
t AS (SELECT source, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, w * f.level) END AS target FROM lev, fill f),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t)
SELECT p.doc_id, p.size, p.source_size, g.target, p.source,
       (greatest(0, least(p.start + p.size, g.goal) - p.start)
        + greatest(0, least(p.source_size + p.start + p.size, g.goal) - p.source_size - p.start))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""


def op2_shard(spark, sf_dir):
    """All documents in 8 shards of near equal bytes (k-d tree over the metadata)."""
    return shard_.kd_shards(table(spark, sf_dir, "documents"), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark, sf_dir):
    """Pairs of a document and a benchmark item whose passage it holds; clean documents have none."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_equal", "n_compared", "doc_at", "item_at")


def op8_substring_dedup(spark, sf_dir):
    """All documents without the words of 20-word windows that also start earlier."""
    return substr.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_pii(spark, sf_dir):
    """Personal data in all documents."""
    return pii.summary(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op4_embedding_near_dup(spark, sf_dir):
    """All embeddings linked at a cosine of 0.95 or more."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_lm_scores(spark, sf_dir):
    """Language-model and unigram scores of all documents."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_language_id(spark, sf_dir):
    """Language of all documents, learned from the rows that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS told,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
  FROM conversations),
cv AS (SELECT c, CRC32 % 4 AS h FROM (SELECT DISTINCT c FROM t)),
reb AS (
  SELECT cv.c, 0 AS part, t.k, t.told, t.words FROM cv JOIN t ON t.c = cv.c - cv.c % 20 AND t.k <= cv.h
  UNION ALL
  SELECT t.c, 1, t.k, t.told, t.words FROM t JOIN cv ON t.c = cv.c AND t.k > cv.h),
pre AS (
  SELECT c, row_number() OVER w AS d, string_agg(told, '') OVER w AS path, words FROM reb WINDOW w AS (PARTITION BY c ORDER BY part, k)
  UNION ALL SELECT c, 0, '', 0 FROM cv),
node AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM pre GROUP BY d, path),
fam AS (SELECT d - 1 AS d, left(path, len(path) - 64) AS path, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
sub AS (
  SELECT x.a AS d, left(n.path, (64 * x.a)::BIGINT) AS path, sum(n.saved) AS saved, sum((fam.kids IS NULL)::INT) AS leaves
  FROM node n LEFT JOIN fam ON fam.path = n.path, LATERAL (SELECT unnest(range(n.d + 1)) AS a) x
  GROUP BY ALL),
fin AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(path, d) AS path FROM pre GROUP BY c) GROUP BY path)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(fam.kids, 0)::BIGINT AS n_children,
       sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, coalesce(fin.ends, sha256('')) AS ends_sha256
FROM node n JOIN sub ON sub.path = n.path LEFT JOIN fam ON fam.path = n.path LEFT JOIN fin ON fin.path = n.path
     LEFT JOIN node p ON n.d > 0 AND p.path = left(n.path, len(n.path) - 64)
"""


def op12_warc(spark, sf_dir):
    """All pages written as WARC records into Zstandard archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP12_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
q AS (
  SELECT *, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, url, NULL::VARCHAR AS problem,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""


def op13_merkle(spark, sf_dir):
    """Leaf, subroot, root and proof of all documents, some of them tampered with."""
    return merkle.proofs(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _fields(text: str) -> str:
    named = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in named) + ")"


# Levels from below: a level's nodes hash runs of 16 as long as it has several; tree 0 holds the
# documents of a source, tree 1 the subroots.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_fields('text')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0
              THEN {_fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
t AS (
  SELECT s, 0 AS lvl, i, leaf AS digest, count(*) OVER (PARTITION BY s) AS n FROM p
  UNION ALL
  SELECT s, lvl, i, digest, count(*) OVER (PARTITION BY s) FROM (
    SELECT s, lvl + 1 AS lvl, i // 16 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest
    FROM t WHERE n > 1 GROUP BY s, lvl, i // 16)),
u AS (
  SELECT 0 AS lvl, s AS i, digest, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT lvl, i, digest, count(*) OVER () FROM (
    SELECT lvl + 1 AS lvl, i // 16 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest
    FROM u WHERE n > 1 GROUP BY lvl, i // 16)),
height AS (SELECT s, max(lvl) AS h FROM t GROUP BY s),
around AS (
  SELECT p.s, p.i, a.lvl, string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i < p.i // a.w) AS lo,
         string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i > p.i // a.w) AS hi
  FROM p JOIN (SELECT x AS lvl, (16 ** x)::BIGINT AS w FROM range(12) r(x)) a ON TRUE
         JOIN t ON t.s = p.s AND t.lvl = a.lvl AND t.n > 1 AND t.i // 16 = p.i // a.w // 16
  GROUP BY p.s, p.i, a.lvl
  UNION ALL
  SELECT p.s, p.i, height.h + a.lvl, string_agg(u.digest, '' ORDER BY u.i) FILTER (u.i < p.s // a.w),
         string_agg(u.digest, '' ORDER BY u.i) FILTER (u.i > p.s // a.w)
  FROM p JOIN height USING (s) JOIN (SELECT x AS lvl, (16 ** x)::BIGINT AS w FROM range(12) r(x)) a ON TRUE
         JOIN u ON u.lvl = a.lvl AND u.n > 1 AND u.i // 16 = p.s // a.w // 16
  GROUP BY p.s, p.i, height.h, a.lvl),
proof AS (SELECT s, i, string_agg(coalesce(lo, '') || coalesce(hi, ''), '' ORDER BY lvl) AS told FROM around GROUP BY s, i),
fold AS (
  SELECT s, i, 0 AS lvl, coalesce(changed, leaf) AS digest FROM p
  UNION ALL
  SELECT fold.s, fold.i, fold.lvl + 1, sha256(coalesce(lo, '') || digest || coalesce(hi, ''))
  FROM fold JOIN around ON around.s = fold.s AND around.i = fold.i AND around.lvl = fold.lvl)
SELECT p.doc_id, p.leaf, t.digest AS subroot, u.digest AS root, sha256(coalesce(proof.told, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = u.digest AS verified
FROM p JOIN t ON t.s = p.s AND t.n = 1 JOIN u ON u.n = 1
     LEFT JOIN proof ON proof.s = p.s AND proof.i = p.i
     JOIN (SELECT s, i, max_by(digest, lvl) AS digest FROM fold GROUP BY s, i) f ON f.s = p.s AND f.i = p.i
"""


QUERIES = {
    "op1_mix": op1_mix,
    "op2_shard": op2_shard,
    "op3_html_text": op3_html_text,
    "op4_embedding_near_dup": op4_embedding_near_dup,
    "op5_lm_scores": op5_lm_scores,
    "op6_ngram_join": op6_ngram_join,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}

ORACLE = {
    "op1_mix": OP1_SQL,
    "op11_conversation_trie": OP11_SQL.replace("CRC32", _crc32("c::VARCHAR")),
    "op12_warc": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
