"""Anonymization: conflicts between findings, and operators that rewrite text. All of it stays in one row's projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let

ENTITY = "array<struct<entity_type:string,start:int,end:int,score:double>>"
ITEM = "array<struct<start:int,end:int,entity_type:string,text:string,operator:string>>"
Operator = Callable[[Column, Column], Column]  # (span text, entity type) -> replacement


def named(name: str, run: Operator) -> Operator:
    """The operator with the name that items show."""

    def operator(t: Column, e: Column) -> Column:
        return run(t, e)

    operator.label = name
    return operator


def replace(new_value: str | None = None) -> Operator:
    return named("replace", lambda t, e: F.lit(new_value) if new_value else F.concat(F.lit("<"), e, F.lit(">")))


def redact() -> Operator:
    return named("redact", lambda t, e: F.lit(""))


def keep() -> Operator:
    return named("keep", lambda t, e: t)


def mask(char: str = "*", chars: int | None = None, from_end: bool = False) -> Operator:
    """``chars`` characters of a span (none where it is below 1, all of them where it is not given) as ``char``."""
    if len(char) != 1:
        raise ValueError("masking character must be one character")

    def run(t: Column, e: Column) -> Column:
        n = F.length(t) if chars is None else F.least(F.lit(max(chars, 0)), F.length(t))
        stars = F.repeat(F.lit(char), n)
        return F.concat(F.substring(t, F.lit(1), F.length(t) - n), stars) if from_end else F.concat(stars, F.substring(t, n + 1, F.length(t)))

    return named("mask", run)


def mask_keeping_last(visible: int, char: str = "*") -> Operator:
    return named("mask", lambda t, e: F.concat(F.repeat(F.lit(char), F.greatest(F.lit(0), F.length(t) - visible)), F.substring(t, F.greatest(F.lit(0), F.length(t) - visible) + 1, F.length(t))))


def hashed(salt: str, bits: int = 256) -> Operator:
    if bits not in (256, 512):
        raise ValueError("hash is sha256 or sha512")
    if len(salt.encode()) < 16:
        raise ValueError("salt needs 16 bytes or more")
    return named("hash", lambda t, e: F.sha2(F.concat(t, F.lit(salt)), bits))


def _key(key: str) -> Column:
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("key needs 16, 24 or 32 bytes")
    return F.lit(key.encode())


def encrypt(key: str, iv: bytes | None = None) -> Operator:
    """AES-CBC with padding, initial vector and ciphertext in URL-safe base64. Without ``iv`` each value gets a random one."""
    k = _key(key)

    def run(t: Column, e: Column) -> Column:
        done = F.aes_encrypt(t, k, F.lit("CBC"), F.lit("PKCS"), F.lit(iv)) if iv else F.aes_encrypt(t, k, F.lit("CBC"), F.lit("PKCS"))
        return F.translate(F.base64(done), "+/\r\n", "-_")

    return named("encrypt", run)


def decrypt(key: str) -> Operator:
    """The text that ``encrypt`` hid. Characters that base64 does not have are dropped and lost padding is put back."""
    k = _key(key)

    def run(t: Column, e: Column) -> Column:
        plain = F.regexp_replace(F.translate(t, "-_", "+/"), "[^A-Za-z0-9+/]", "")
        plain = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("="))
        return F.aes_decrypt(F.unbase64(plain), k, F.lit("CBC"), F.lit("PKCS")).cast("string")

    return named("decrypt", run)


def custom(function: Callable[[Column], Column]) -> Operator:
    return named("custom", lambda t, e: function(t))


OPERATORS = {"replace": replace, "redact": redact, "keep": keep, "mask": mask, "hash": hashed, "encrypt": encrypt, "decrypt": decrypt, "custom": custom}


def resolve(findings: Column) -> Column:
    """Findings without conflicts, by start: overlaps of one type become one finding with the larger score; then a finding inside
    another, or at its place with no higher score, goes."""
    flat = F.transform(findings, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"), x["score"].alias("score")))
    by_type = F.array_sort(F.transform(flat, lambda x: F.struct(x["entity_type"].alias("t"), x["start"].alias("s"), x["end"].alias("e"), x["score"].alias("p"))))
    empty = F.array().cast("array<struct<t:string,s:int,e:int,p:double>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((last["t"] == x["t"]) & (x["s"] < last["e"]) & (x["s"] < x["e"]), F.lit(False))
        wide = F.struct(last["t"].alias("t"), last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), F.greatest(last["p"], x["p"]).alias("p"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(wide).cast(empty_type))).otherwise(F.concat(acc, F.array(x).cast(empty_type)))

    empty_type = "array<struct<t:string,s:int,e:int,p:double>>"
    merged = F.aggregate(by_type, empty, merge)
    placed = F.array_sort(F.transform(merged, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["t"].alias("entity_type"), x["p"].alias("score"))))

    def beaten(x: Column, i: Column, numbered: Column) -> Column:
        def by(n: Column) -> Column:
            y, j = n["y"], n["j"]
            equal = (x["start"] == y["start"]) & (x["end"] == y["end"])
            return (j != i) & F.when(equal, (x["score"] < y["score"]) | ((x["score"] == y["score"]) & (j > i))).otherwise((x["start"] >= y["start"]) & (x["end"] <= y["end"]))

        return F.exists(numbered, by)

    numbered = F.transform(placed, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
    return let(numbered, lambda ns: F.transform(F.filter(ns, lambda n: ~beaten(n["y"], n["j"], ns)), lambda n: n["y"]))


_SPANS = "array<struct<start:int,end:int,entity_type:string,score:double>>"


def without_intersections(spans: Column) -> Column:
    """Spans (by start) that overlap no more: of two that do, the one with the lower score gives way, of equal ones the later. What is left of
    none goes."""

    def step(acc: Column, x: Column) -> Column:
        over = lambda a: (a["end"] > x["start"]) & (a["start"] < x["end"])
        stop = F.array_max(F.transform(F.filter(acc, lambda a: over(a) & (a["score"] >= x["score"])), lambda a: a["end"]))
        start = F.greatest(x["start"], F.coalesce(stop, x["start"]))
        cut = F.transform(acc, lambda a: F.struct(a["start"].alias("start"), F.when((a["end"] > start) & (a["start"] < x["end"]) & (a["score"] < x["score"]), F.greatest(a["start"], start)).otherwise(a["end"]).alias("end"), a["entity_type"].alias("entity_type"), a["score"].alias("score")))
        one = F.array(F.struct(start.alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"), x["score"].alias("score")))
        return F.concat(cut, one).cast(_SPANS)

    return F.array_sort(F.filter(F.aggregate(spans, F.array().cast(_SPANS), step), lambda x: x["start"] < x["end"]))


def merged_over_spaces(spans: Column, text: Column) -> Column:
    """Neighbours (by start) of one type with nothing but spaces, at least one, between them as one span with the larger score."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((last["entity_type"] == x["entity_type"]) & F.substring(text, last["end"] + 1, x["start"] - last["end"]).rlike("^ +$"), F.lit(False))
        wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["entity_type"].alias("entity_type"), F.greatest(last["score"], x["score"]).alias("score"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(wide))).otherwise(F.concat(acc, F.array(x))).cast(_SPANS)

    return F.aggregate(spans, F.array().cast(_SPANS), step)


def _flat(findings: Column) -> Column:
    return F.coalesce(F.transform(findings, lambda x: F.struct(x["entity_type"].alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))), F.array().cast(ENTITY))


def checked(findings: Column, text: Column) -> Column:
    """The findings, or an error that names the first fault: a negative or inverted place, no type, or a place beyond the text."""
    fault = lambda x: (
        F.when((x["start"] < 0) | (x["end"] < 0), "negative place").when(x["start"] > x["end"], "start after end")
        .when(F.coalesce(F.length(x["entity_type"]), F.lit(0)) == 0, "no entity type").when(x["end"] > F.length(text), "place beyond the text")
    )
    first = F.try_element_at(F.filter(F.transform(findings, fault), lambda f: f.isNotNull()), F.lit(1))
    return F.when(first.isNull(), findings).otherwise(F.raise_error(F.concat(F.lit("invalid finding: "), first)).cast(ENTITY))


def anonymize(df: DataFrame, text: str = "text", findings: str = "findings", operators: dict[str, Operator] | None = None, out: str = "anonymized", items: str | None = "items", merge_spaces: bool = True, conflicts: str = "merge_similar_or_contained", strict: bool = False) -> DataFrame:
    """``df`` with the rewritten text in ``out`` and the replaced spans (places in the new text, last one first) in ``items``.

    The operator of an entity is looked up by type, then under DEFAULT, else it is ``replace``. Neighbours of one type with only spaces between
    them become one span unless ``merge_spaces`` is off. ``conflicts`` may also be ``remove_intersections``, which cuts overlaps of different
    types off the lower score; without it the earlier span ends where the next begins. ``strict`` raises an error for places that the text does
    not have. Null text stays null.
    """
    if conflicts not in ("merge_similar_or_contained", "remove_intersections"):
        raise ValueError(f"unknown conflict resolution: {conflicts}")
    col = F.col(text)
    found = checked(_flat(F.col(findings)), col) if strict else _flat(F.col(findings))
    resolved = resolve(found)
    if conflicts == "remove_intersections":
        resolved = without_intersections(resolved)
    if merge_spaces:
        resolved = merged_over_spaces(resolved, col)
    return _rewrite(df, text, resolved, operators or {}, replace(), out, items)


def _rewrite(df: DataFrame, text: str, spans: Column, ops: dict[str, Operator], default: Operator, out: str, items: str | None) -> DataFrame:
    """Text with each span (by start) changed by its operator."""
    fallback, col = ops.get("DEFAULT", default), F.col(text)

    def change(t: Column, e: Column) -> Column:
        done = fallback(t, e)
        for k, op in ops.items():
            if k != "DEFAULT":
                done = F.when(e == k, op(t, e)).otherwise(done)
        return done

    label = lambda op: getattr(op, "label", "custom")

    def name(e: Column) -> Column:
        done = F.lit(label(fallback))
        for k, op in ops.items():
            if k != "DEFAULT":
                done = F.when(e == k, label(op)).otherwise(done)
        return done

    def cut(x: Column, i: Column, spans: Column) -> Column:
        following = F.try_element_at(spans, i + 2)["start"]
        stop = F.least(x["end"], F.coalesce(following, x["end"]))
        gap_end = F.coalesce(following, F.length(col))
        return F.struct(x["entity_type"].alias("entity_type"), change(F.substring(col, x["start"] + 1, x["end"] - x["start"]), x["entity_type"]).alias("new"), F.substring(col, stop + 1, gap_end - stop).alias("gap"))

    first = lambda r: F.coalesce(F.try_element_at(r, F.lit(1))["start"], F.length(col))
    df = df.withColumn("__r", let(spans, lambda r: F.struct(first(r).alias("first"), F.transform(r, lambda x, i: cut(x, i, r)).alias("cuts"))))
    head, cuts = F.substring(col, F.lit(1), F.col("__r.first")), F.col("__r.cuts")
    df = df.withColumn(out, F.when(col.isNotNull(), F.concat(head, F.array_join(F.transform(cuts, lambda x: F.concat(x["new"], x["gap"])), ""))))
    if items:
        start = F.struct(F.length(head).cast("int").alias("at"), F.array().cast(ITEM).alias("out"))

        def place(acc: Column, x: Column) -> Column:
            end = (acc["at"] + F.length(x["new"])).cast("int")
            one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x["entity_type"].alias("entity_type"), x["new"].alias("text"), name(x["entity_type"]).alias("operator"))).cast(ITEM)
            return F.struct((end + F.length(x["gap"])).cast("int").alias("at"), F.concat(acc["out"], one).alias("out"))

        df = df.withColumn(items, F.reverse(F.aggregate(cuts, start, place, lambda acc: acc["out"])))
    return df.drop("__r")


def deanonymize(df: DataFrame, text: str, items: str, operators: dict[str, Operator], out: str = "restored", back: str | None = None) -> DataFrame:
    """The mirror of ``anonymize``: the items' spans in ``text`` changed by the operators (``decrypt``, ``keep``, ``custom``), all of them, as items
    have no conflicts. A type without an operator is an error unless there is one under DEFAULT. ``back`` names a column for the new items."""
    spans = F.array_sort(F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"), F.lit(1.0).alias("score"))))
    missing = named("none", lambda t, e: F.raise_error(F.concat(F.lit("no operator for "), e)).cast("string"))
    return _rewrite(df, text, spans, operators, missing, out, back)


def apply(df: DataFrame, how: str | Operator = "replace", text: str = "text", out: str = "anonymized", **options) -> DataFrame:
    """Analysis and one operator for all it finds, by name (replace, redact, mask, keep, ...) or as an operator; ``options`` go to ``analyze``."""
    from .analyze import analyze

    operator = OPERATORS[how]() if isinstance(how, str) else how
    return anonymize(analyze(df, text, "__found", **options), text, "__found", {"DEFAULT": operator}, out, None).drop("__found")
