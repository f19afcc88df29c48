"""Personal data in text, in DataFrame functions only.

Patterns propose spans, checksum and range validators confirm them, and context words near a span (before or after it) adjust
its score. Weak kinds (social security numbers, bare account numbers) start below the threshold, so only context admits them.
Offsets are code points, end exclusive. Every pattern is written so that the JVM matches it in linear time: runs are
possessive and start only where a run can start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, STAND_IN = "\ue000", "\ue001", "\ue002"
CONTEXT_CHARS = 48

# kind: (guard, pattern, score, context words); the order is the order of kinds in the results.
BASE = {
    # leftmost match: a run of local-part characters can only begin after another character or where a match ended
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, ("mail", "contact", "write")),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ("ip", "address", "host", "server")),
    # maximal chains of digits with single separators that have 13 to 19 digits
    "card": (None, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", 0.8, ("card", "visa", "credit", "payment")),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]", 0.5, ("phone", "call", "tel", "mobile")),
}
ADDED = {
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.8, ("iban", "bank", "account")),
    "ssn": (None, r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, ("ssn", "social", "security")),
    "account": (None, r"(?<![0-9A-Za-z.+-])[0-9]{8,12}(?![0-9A-Za-z-]|\.[0-9])", 0.1, ("account", "acct", "iban", "routing", "passport")),
}
KINDS = {**BASE, **ADDED}
BOOST, LEAST_SCORE = 0.35, 0.4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 mod-97 check of an account number: first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirm(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.split(m, r"\.")
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
RUN = 256  # a fold gathers runs of so many spans, so that a long text costs no copy of all its spans for each


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind. Matches are bracketed by two private-use characters, the text is split at the first of them, and the
    lengths of the parts add up to code-point offsets."""
    guard, pattern, score, words = KINDS[kind]
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    start = F.struct(F.lit(-1).alias("pos"), F.lit("").alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("full"), F.array().cast(_SPAN).alias("out"))
    near = rf"(?i)(?<![a-z])(?:{'|'.join(words)})"

    def step(acc: Column, part: Column) -> Column:
        m, pos = F.substring_index(part, CLOSE, 1), acc["pos"]
        after = F.substring(part, F.length(m) + 2, F.lit(CONTEXT_CHARS))
        value = F.when(acc["tail"].rlike(near) | after.rlike(near), F.lit(min(1.0, score + BOOST))).otherwise(F.lit(score))
        found = F.array(F.struct(F.lit(kind).alias("kind"), pos.alias("start"), (pos + F.length(m)).cast("int").alias("end"), value.alias("score"))).cast(_SPAN)
        first, whole = pos < 0, F.size(acc["out"]) >= RUN
        # what a validator refuses is no span; an added kind also needs the score
        good = ~first & _confirm(kind, m) & (value >= LEAST_SCORE if kind in ADDED else F.lit(True))
        return F.struct(
            F.when(first, F.length(part)).otherwise(pos + F.length(part) - 1).cast("int").alias("pos"),
            F.right(part, F.lit(CONTEXT_CHARS)).alias("tail"),
            F.when(whole, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]).alias("full"),
            F.when(good, F.concat(F.when(whole, F.array().cast(_SPAN)).otherwise(acc["out"]), found)).when(whole, F.array().cast(_SPAN)).otherwise(acc["out"]).alias("out"),
        )

    got = F.aggregate(parts, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["out"]))))
    return F.when(text.contains(guard) if guard and guard != "." else text.rlike(_HOLDS[kind]), got).otherwise(F.array().cast(_SPAN))


# what a text holds that has a span of the kind; the weak kinds need a context word too
_HOLDS = {
    "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]{3}-[0-9]{2}-",
    "account": rf"(?i)(?<![a-z])(?:{'|'.join(ADDED['account'][3])})",
}


def detect(df: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``df`` with ``out``: array of (kind, start, end, score), by kind as listed and then start.

    Null and empty texts give an empty array. Spans of one kind never overlap; spans of different kinds may. Base kinds
    stay whatever their score; added kinds need a score of 0.4 or more, which ``ssn`` and ``account`` reach only with a context word within 48
    characters on either side (and no other match of the kind between). A text that holds the private-use characters
    used as brackets is searched with a stand-in of the same length. Repeated rows have equal spans; a column named like ``out`` is
    replaced, other columns stay; an empty table gives no rows. Texts of any length are searched whole, in one row.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, STAND_IN * 2)
    return df.withColumn(out, F.concat(*[_spans(plain, k) for k in kinds]))


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``text`` with each span replaced by ``<KIND>``. Of overlapping spans the one that starts first counts, then the longer."""
    ordered = F.array_sort(F.transform(F.col(spans), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int,kind:string>>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        cut = F.array(F.struct(acc["at"].alias("from"), x["start"].alias("to"), x["kind"].alias("kind"))).cast("array<struct<from:int,to:int,kind:string>>")
        fits = x["start"] >= acc["at"]
        return F.struct(F.when(fits, -x["back"]).otherwise(acc["at"]).cast("int").alias("at"), F.when(fits, F.concat(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"))

    col = F.col(text)

    def finish(acc: Column) -> Column:
        kept = F.transform(acc["cuts"], lambda c: F.concat(F.substring(col, c["from"] + 1, c["to"] - c["from"]), F.lit("<"), F.upper(c["kind"]), F.lit(">")))
        return F.concat(F.array_join(kept, ""), F.substring(col, acc["at"] + 1, F.length(col)))

    return df.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, finish)).otherwise(col))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.filter("pii", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in ADDED],
        F.round(F.array_max(F.transform("pii", lambda x: x["score"])), 6).alias("max_score"),
    )
