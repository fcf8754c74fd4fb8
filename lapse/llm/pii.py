"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Every kind has a pattern that proposes spans, a check that confirms or drops
them (Luhn for cards, mod 97 for IBANs, ranges and lengths for the rest) and a
score: the kind's base, plus a bonus if a context word stands within
``NEAR`` code points of the span.  A span is kept from a score of THRESHOLD.
The base kinds (email, ip, card, phone) pass it by their check alone; SSN-like
numbers need a context word.

Only DataFrame functions, and no shuffle: a pattern's matches are enclosed in a
mark (a private-use character, which the text itself trades for another one),
the text is split there, and the lengths of the parts give the positions.  The
patterns are possessive and start only where a run starts, so the time is linear
in the text, also for long runs without a match.

Defined cases: null and empty text have no spans; positions are code points, ends
exclusive; kinds are independent of each other, so that spans of different kinds may
overlap; other columns are kept by ``detect`` unless they are named ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "", ""
NEAR = 40
THRESHOLD = 0.5
CHUNK = 256
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

#: Base kinds in the order of the contract, then the added ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# a run may also start where the last match has ended (\G)
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for its pattern to be tried at all (regular expressions, cheap to look for).
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-"}
#: Score without context, bonus for context, context words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BONUS = 0.3
CONTEXT = {
    "email": "e-?mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|master|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|transfer",
    "ssn": "ssn|social|security",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, F.lit("[^0-9]"), F.lit(""))


def _mod97(s: Column) -> Column:
    """IBAN check: the first four characters go last, letters count from 10, the rest mod 97 is 1."""
    c = F.regexp_replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))

    def step(a, i):
        n = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(n >= 65, (a * 100 + n - 55) % 97).otherwise((a * 10 + n - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(_IP)
    if kind == "card":
        return (F.length(s) >= 13) & F.length(_digits(s)).between(13, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return _mod97(s)
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.concat_ws(" ", F.substring(before, -NEAR, NEAR), F.substring(after, 1, NEAR))
    return F.lit(SCORES[kind]) + F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{CONTEXT[kind]})"), F.lit(BONUS)).otherwise(0.0)


def _parts(kind: str, text: Column) -> Column:
    """The text split at the borders of the pattern's matches: other, match, other, match, .. other."""
    marked = F.regexp_replace(text, F.lit(PATTERNS[kind]), F.lit(f"{MARK}$0{MARK}"))
    return F.when(text.rlike(NEEDS[kind]), F.split(marked, MARK)).otherwise(F.array(text))


def _spans(kind: str, parts: Column) -> Column:
    """Confirmed spans.  Matches are taken CHUNK at a time, so that adding to a long list stays cheap."""
    n = F.expr("0") + ((F.size(parts) - 1) / 2).cast("int")
    none = F.array().cast(SPAN_TYPE)

    def part(i):
        return F.element_at(parts, i + 1)

    def one(a, i):
        start = a["pos"] + F.length(part(2 * i))
        score = _score(kind, part(2 * i), part(2 * i + 2))
        good = _confirmed(kind, part(2 * i + 1)) & (score >= THRESHOLD)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(part(2 * i + 1))).alias("end"),
                        score.alias("score"))
        return F.struct((start + F.length(part(2 * i + 1))).alias("pos"),
                        F.when(good, F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    def chunk(a, k):
        ids = F.sequence(k * CHUNK, F.least(n, (k + 1) * CHUNK) - 1)
        got = F.aggregate(ids, F.struct(a["pos"].alias("pos"), none.alias("found")), one)
        return F.element_at(F.transform(F.array(got), lambda g: F.struct(
            g["pos"].alias("pos"), F.concat(a["found"], g["found"]).alias("found"))), 1)

    ks = F.sequence(F.lit(0), ((n - 1) / CHUNK).cast("int"))
    every = F.aggregate(ks, F.struct(F.lit(0).alias("pos"), none.alias("found")), chunk, lambda a: a["found"])
    return F.when(n > 0, every).otherwise(none)


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, score), by kind as in KINDS, then by start."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "spans"]).alias("_row")
    # the generators are there to have each array made once, not in every step of the folds
    d = docs.select(row, F.explode(F.array(text)).alias("_t"))
    d = d.select("_row", F.explode(F.array(F.struct(*[_parts(k, F.col("_t")).alias(k) for k in KINDS]))).alias("_p"))
    found = F.concat(*[_spans(k, F.col(f"_p.{k}")) for k in KINDS])
    return d.select("_row.*", F.explode(F.array(found)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans and all spans as text."""
    d = detect(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *[n(k) for k in BASE],
                    F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
