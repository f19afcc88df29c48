"""Spans of pattern matches as array columns, and predicates between spans. Offsets are code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, STAND_IN = "", "", ""
FOUND = "array<struct<start:int,end:int,text:string>>"
RUN = 256  # matches are gathered in runs, so that a text of many matches costs no copy of all of them for each


def guard(text: Column) -> Column:
    """The text with the two bracket characters replaced by one of the same length; null stays null. Few texts hold them, and to look for them
    costs less than to translate."""
    return let(text, lambda t: F.when(t.contains(OPEN) | t.contains(CLOSE), F.translate(t, OPEN + CLOSE, STAND_IN * 2)).otherwise(t))


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern, in one projection: matches are bracketed, the text is split at the
    opening bracket, and the lengths of the parts add up to offsets. Null texts give null."""
    parts = F.split(F.regexp_replace(guard(text), F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(f"array<{FOUND}>").alias("full"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        m, first, whole = F.substring_index(part, CLOSE, 1), acc["at"] < 0, F.size(acc["out"]) >= RUN
        one = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(m)).cast("int").alias("end"), m.alias("text"))).cast(FOUND)
        return F.struct(
            F.when(first, F.length(part)).otherwise(acc["at"] + F.length(part) - 1).cast("int").alias("at"),
            F.when(whole, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]).alias("full"),
            F.when(first, acc["out"]).when(whole, one).otherwise(F.concat(acc["out"], one)).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["out"]))))


def find_in(name: str, pattern: str) -> Column:
    """``find`` over a column given by name, as one SQL expression: a plan of many patterns is built much faster so."""
    quote = next((q for q in "'\"" if q not in pattern), None)
    if quote is None or "`" in name:
        return find(F.col(name), pattern)
    one = f"cast(array(named_struct('start', acc.at, 'end', cast(acc.at + length(substring_index(part, '{CLOSE}', 1)) as int), 'text', substring_index(part, '{CLOSE}', 1))) as {FOUND})"
    whole = f"size(acc.out) >= {RUN}"
    step = (
        f"named_struct('at', cast(if(acc.at < 0, length(part), acc.at + length(part) - 1) as int), 'full', if({whole}, concat(acc.full, array(acc.out)), acc.full), "
        f"'out', case when acc.at < 0 then acc.out when {whole} then {one} else concat(acc.out, {one}) end)"
    )
    guarded = f"if(contains(`{name}`, '{OPEN}') or contains(`{name}`, '{CLOSE}'), translate(`{name}`, '{OPEN}{CLOSE}', '{STAND_IN * 2}'), `{name}`)"
    parts = f"split(regexp_replace({guarded}, r{quote}{pattern}{quote}, '{OPEN}$0{CLOSE}'), '{OPEN}', -1)"
    start = f"named_struct('at', -1, 'full', cast(array() as array<{FOUND}>), 'out', cast(array() as {FOUND}))"
    return F.expr(f"aggregate({parts}, {start}, (acc, part) -> {step}, acc -> flatten(concat(acc.full, array(acc.out))))")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two spans share; 0 where they touch or lie apart."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def contained(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first span lies within the second."""
    return (s1 >= s2) & (e1 <= e2)


def conflict(a: Column, b: Column) -> Column:
    """Whether span ``a`` must yield to ``b``: equal places and no higher score, or contained."""
    equal = (a["start"] == b["start"]) & (a["end"] == b["end"])
    return F.when(equal, a["score"] <= b["score"]).otherwise(contained(a["start"], a["end"], b["start"], b["end"]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
