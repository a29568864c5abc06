"""Personal data: patterns propose, checksums confirm, context words score (operator 5).

Everything is a column expression.  The places of all matches of a pattern come
from splitting the text at the pattern: the pieces between the matches and the
matches themselves alternate, so their lengths add up to the places.  Patterns
use possessive repetition, which Java runs in a loop, so a text of any length
is searched whole and in linear time.  Places are running sums, and what lies
between two places is cut from pieces of the text, so a text with very many
matches takes time in proportion, too.

Base kinds: email, ip, card (Luhn), phone.  Added kinds: iban (mod 97), and secret,
a value of letters and digits in many different characters that is assigned to a
name such as token or password.  The score of a span is its kind's prior, moved by
words within CONTEXT code points of it; it decides about added kinds only, base
ones stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import between, cut, let, running, sha256_text, table

#: The base patterns.  Possessive forms of the agreed ones; a match
#: may begin only where the run of characters that can begin it begins.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SECRET = r"(?i)(?<=(?:token|secret|password|passwd|key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?)[A-Za-z0-9+/_-]{16,}+"
#: A number up to 255.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
#: A cheap test that a text can hold a match at all; the pattern; prior score.
PROPOSE = {
    "email": (r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", EMAIL, 0.9),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", IP, 0.7),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", CARD, 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]++", PHONE, 0.7),
    "iban": (r"\b[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", IBAN, 0.6),
    "secret": (r"(?i)(?:token|secret|password|passwd|key)[\"']?\x20{0,3}[=:]", SECRET, 0.6),
}
#: Words near a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
    "secret": r"(?i)(?:auth|login|access|api|secret|credential)",
}
AGAINST = r"(?i)\b(?:example|sample|version|isbn|order|test)\b"
CONTEXT, GAIN, LEAST = 40, 0.2, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    figures = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 when divided by 97."""
    packed = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(packed, 5, 99), F.substring(packed, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) < 10, a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97
    return F.length(packed).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":  # letters and digits, and not a few characters over and over
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) > 8)
    return F.lit(True)


#: The type of a list of spans while they are gathered.
_TYPE = "array<struct<start:int,end:int,rank:int,kind:string,score:double>>"


def _spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind, as structs (start, end, rank, kind, score)."""
    guard, pattern, prior = PROPOSE[kind]
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(both: Column) -> Column:
        # the lengths of pieces and matches add up to the places
        ends = running(F.transform(both, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, x: a + x, F.lit(0))
        every = F.zip_with(both, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("m")))
        return F.filter(every, lambda s: _confirmed(kind, s["m"]))

    def scored(s: Column, cuts: Column) -> Column:
        near = between(cuts, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["end"] + CONTEXT)
        score = F.lit(prior) + F.when(near.rlike(FOR[kind]), GAIN).otherwise(0.0) - F.when(near.rlike(AGAINST), GAIN).otherwise(0.0)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("score"))

    paired = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    none = F.array().cast(_TYPE)
    # texts are cut into pieces only if a match is confirmed
    marked = lambda some: F.when(F.size(some) == 0, none).otherwise(let(cut(text), lambda cuts: F.transform(some, lambda s: scored(s, cuts))))
    spans = let(let(paired, placed), marked)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST)
    return F.when(text.rlike(guard), spans).otherwise(none)


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with the column spans: array<struct<start,end,rank,kind,score>> in order of start, then kind.

    Places are code points, the end exclusive.  A null text has no spans.  A
    column of docs named like spans is replaced, all others are kept.
    """
    found = F.concat(*[_spans_of(F.col(text), k) for k in KINDS])
    return docs.withColumn(spans, F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    kept = spans if kinds == KINDS else F.filter(spans, lambda s: s["rank"] < len(kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets, such as [EMAIL].

    Where spans overlap, the first one's kind stands for all that they cover.
    """
    t = F.col(text)

    def covered(own: Column) -> Column:
        """From the spans, and the furthest end up to each: heads of what they cover, with the end before them."""
        reach = running(F.transform(own, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
        return let(reach, lambda r: F.filter(F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(r, i - 1), F.lit(0)).alias("before"), s["kind"].alias("kind"))), lambda h: h["start"] >= h["before"]))

    def written(cuts: Column) -> Column:
        one = lambda h: F.concat(between(cuts, h["before"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(covered(F.col(spans)), one), ""), between(cuts, last, F.length(t)))

    return docs.withColumn(text, F.when(F.size(spans) > 0, let(cut(t), written)).otherwise(t))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    added = [count(k) for k in KINDS if k not in BASE]
    return found.select("doc_id", *[count(k) for k in BASE], sha256_text(listed(F.col("spans"), BASE)).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores, *added)
