"""Analysis: scan, validate, context, threshold, duplicates, allow list, order; one narrow projection per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import STAND_IN, find_in, let
from ..plans.catalog import Recognizer, select

FINDING = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string,score_enhanced:boolean,supportive_context_word:string>"
WITH_SPAN = FINDING[:-1] + ",span:string>"
BOOST, FLOOR, WORDS_BEFORE = 0.35, 0.4, 5


def _scan(name: str, r: Recognizer, context: Column | None, whole_words: bool, spans: bool = False) -> Column:
    """Findings of one recognizer: pattern score, 1 where valid, gone where invalid, raised by a context word before the match or among
    the caller's words. With ``spans``, each with the text of its match."""
    words, text = tuple(w.lower() for w in r.context), F.col(name)

    def scored(score: float):
        def finding(m: Column) -> Column:
            base = F.coalesce(r.validate(m["text"]).cast("double"), F.lit(float(score))) if r.validate else F.lit(float(score))
            return let(base, lambda base: let(F.when(base > 0, supported(m)), lambda hit: made(m, base, hit)))

        return finding

    def supported(m: Column) -> Column:
        """First context word that stands in one of the words before the match, or null."""
        if not words:
            return F.lit(None).cast("string")
        # read backwards from the match, so that the split stops after the words that count
        back = F.split(F.reverse(F.substring(text, F.lit(1), m["start"])), r"[^\p{L}\p{N}#]+", WORDS_BEFORE + 2)
        before = F.transform(F.slice(back, 1, WORDS_BEFORE + 1), lambda w: F.lower(F.reverse(w)))
        if context is not None:
            before = F.concat(before, F.transform(context, F.lower))
        # one expression for all words
        declared = F.split(F.lit(" ".join(words)), " ") if not any(" " in w for w in words) else F.array(*map(F.lit, words))
        held = (lambda b, w: b == w) if whole_words else (lambda b, w: b.contains(w))
        return let(before, lambda before: F.try_element_at(F.filter(declared, lambda w: F.exists(before, lambda b: held(b, w))), F.lit(1)))

    def made(m: Column, base: Column, hit: Column) -> Column:
        score = F.when(hit.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), base + BOOST))).otherwise(base)
        fields = [F.lit(r.entity).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"), F.lit(r.name).alias("recognizer"), hit.isNotNull().alias("score_enhanced"), hit.alias("supportive_context_word")]
        if spans:  # a match with the stand-in may have had another character in its place
            fields.append(F.when(m["text"].contains(STAND_IN), F.substring(text, m["start"] + 1, m["end"] - m["start"])).otherwise(m["text"]).alias("span"))
        return F.struct(*fields).cast(WITH_SPAN if spans else FINDING)

    if r.find:
        return F.transform(r.find(text), scored(r.patterns[0][1]))
    parts = [F.transform(find_in(name, pattern), scored(score)) for pattern, score in r.patterns]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _scan_all(name: str, chosen: list[Recognizer], context: Column | None, whole_words: bool, spans: bool = False) -> Column:
    """Findings of all recognizers. Those with one necessary condition share its test, so that most texts are scanned by few of them."""
    text = F.col(name)
    none, by_guard = F.array().cast(f"array<{WITH_SPAN if spans else FINDING}>"), {}
    for r in chosen:
        by_guard.setdefault(r.holds, []).append(_scan(name, r, context, whole_words, spans))
    parts = [F.concat(*scans) if holds is None else F.when(text.rlike(holds), F.concat(*scans)).when(text.isNotNull(), none) for holds, scans in by_guard.items()]
    return F.concat(*parts) if parts else F.when(text.isNotNull(), none)


def ordered(findings: Column) -> Column:
    """Score descending, start ascending, length descending, type ascending."""
    keyed = F.transform(findings, lambda x: F.struct((-x["score"]).alias("a"), x["start"].alias("b"), (x["start"] - x["end"]).alias("c"), x["entity_type"].alias("d"), x["recognizer"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def without_duplicates(findings: Column) -> Column:
    """Drop score 0, repeats, and findings inside a better finding of the same type; ``findings`` is in total order.

    Findings of which none touches the next of its type, as the matches of one pattern are, hold none inside another: only others are compared,
    each with all that are kept.
    """
    scored = F.filter(findings, lambda x: F.coalesce(x["score"] > 0, F.lit(True)))
    placed = F.array_sort(F.transform(scored, lambda x: F.struct(x["entity_type"].alias("t"), x["start"].alias("s"), x["end"].alias("e"))))

    def apart(ps: Column) -> Column:
        def clear(p: Column, i: Column) -> Column:
            after = F.get(ps, i + 1)
            return (p["e"] > p["s"]) & (after.isNull() | (after["t"] != p["t"]) | (after["s"] >= p["e"]))

        return F.forall(F.transform(ps, clear), lambda c: c)

    def step(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda y: (y["entity_type"] == x["entity_type"]) & (x["start"] >= y["start"]) & (x["end"] <= y["end"]))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    return F.when(let(placed, apart), scored).otherwise(F.aggregate(scored, F.slice(scored, 1, 0), step))


def analyze(df: DataFrame, text: str = "text", out: str = "findings", language: str = "en", entities: list[str] | None = None, threshold: float = 0.0, context: list[str] | Column | None = None, allow: list[str] | None = None, allow_regex: bool = False, recognizers: list[Recognizer] | None = None, thresholds: dict[str, float] | None = None, whole_words: bool = False, allow_flags: str = "ism", spans: bool = False) -> DataFrame:
    """``df`` with ``out``, an array of findings in total order; null for null text, empty for empty text.

    Words of ``context`` (a list, or an array column) count as if they stood before every match. ``thresholds`` go by entity and stand above
    ``threshold``. An empty list of recognizers finds nothing. ``allow_flags`` are the pattern flags of a regular allow list; none: as written.
    With ``spans`` each finding has its text as a last field, ``span``, which ``explode`` then takes from it.
    """
    if not 0 <= threshold <= 1 or any(not 0 <= v <= 1 for v in (thresholds or {}).values()):
        raise ValueError("thresholds lie between 0 and 1")
    if bad := [k for k in thresholds or {} if k != k.strip() or not k]:
        raise ValueError(f"padded or empty threshold keys: {bad}")
    chosen = select(language, entities) if recognizers is None else recognizers
    col = F.col(text)
    words = F.array(*map(F.lit, context)) if isinstance(context, (list, tuple)) and context else context if isinstance(context, Column) else None
    found = _scan_all(text, chosen, words, whole_words, spans)
    least = lambda x: F.coalesce(*[F.when(x["entity_type"] == k, F.lit(v)) for k, v in (thresholds or {}).items()], F.lit(float(threshold)))
    step = df.withColumn(out, found).withColumn(out, ordered(F.filter(out, lambda x: x["score"] >= least(x)))).withColumn(out, without_duplicates(F.col(out)))
    if allow:
        span = lambda x: x["span"] if spans else F.substring(col, x["start"] + 1, x["end"] - x["start"])
        terms = [a for a in allow if a]
        if allow_regex and terms:
            step = step.withColumn(out, F.filter(out, lambda x: ~span(x).rlike((f"(?{allow_flags})" if allow_flags else "") + "|".join(terms))))
        elif not allow_regex:
            step = step.withColumn(out, F.filter(out, lambda x: ~span(x).isin(*allow)))
    return step


def explode(df: DataFrame, findings: str = "findings", text: str = "text") -> DataFrame:
    """One row per finding with its text: that of the finding where it has it, else cut out of the whole text, which costs its length each time."""
    rest = [c for c in df.columns if c != findings]
    # Spark filters by the size of a bare column before it explodes it, and so would scan every text twice
    each = F.explode(F.coalesce(F.col(findings), F.array().cast(df.schema[findings].dataType)))
    rows = df.select(*rest, each.alias("f")).select(*rest, "f.*")
    return rows if "span" in df.schema[findings].dataType.elementType.names else rows.withColumn("span", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))


def contains_pii(findings: Column) -> Column:
    return F.size(findings) > 0


_LEAF = "array<struct<path:string,keys:array<string>,value:string>>"


def leaves(col: Column, kind: T.DataType, path: Column, keys: Column) -> Column:
    """Every primitive value below a column as (path, keys on the way, value as text); empty and false values are left out. Structs and maps add
    a key, arrays add none."""
    if isinstance(kind, T.StructType):
        parts = [leaves(col[f.name], f.dataType, F.concat_ws(".", path, F.lit(f.name)), F.concat(keys, F.array(F.lit(f.name)))) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast(_LEAF)
    if isinstance(kind, T.MapType):
        step = lambda e: leaves(e["value"], kind.valueType, F.concat_ws(".", path, e["key"].cast("string")), F.concat(keys, F.array(e["key"].cast("string"))))
        return F.coalesce(F.flatten(F.transform(F.map_entries(col), step)), F.array().cast(_LEAF))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(col, lambda x: leaves(x, kind.elementType, path, keys))), F.array().cast(_LEAF))
    value = F.initcap(col.cast("string")) if isinstance(kind, T.BooleanType) else col.cast("string")
    false = (col == F.lit(False)) if isinstance(kind, T.BooleanType) else (col == 0) if isinstance(kind, T.NumericType) else (value == "")
    one = F.array(F.struct(path.alias("path"), keys.alias("keys"), value.alias("value"))).cast(_LEAF)
    return F.when(col.isNotNull() & ~F.coalesce(false, F.lit(False)), one).otherwise(F.array().cast(_LEAF))


def analyze_record(df: DataFrame, columns: list[str] | None = None, skip: list[str] | None = None, key: list[str] | None = None, **options) -> DataFrame:
    """Findings of nested records: one row per value with ``path``, ``value`` and ``findings``, beside the ``key`` columns.

    Structs, maps and arrays are walked down to their values, whatever their depth; the keys on the way are context words of a value. Null, empty,
    zero and false values have no row. Paths in ``skip``, and all below them, are left out.
    """
    chosen = [f for f in df.schema.fields if f.name in (columns if columns is not None else df.columns) and f.name not in (key or [])]
    parts = [leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), F.array(F.lit(f.name))) for f in chosen]
    rows = df.select(*(key or []), F.explode(F.concat(*parts)).alias("leaf")).select(*(key or []), "leaf.*")
    for path in skip or []:
        rows = rows.filter((F.col("path") != path) & ~F.col("path").startswith(path + "."))
    return analyze(rows, "value", "findings", context=F.col("keys"), **options).drop("keys")


def analyze_texts(spark: SparkSession, texts: list, **options) -> DataFrame:
    """Findings of a list of primitive values: ``position, text, findings``. A list or dictionary among them is an error."""
    if any(isinstance(t, (list, tuple, dict, set)) for t in texts):
        raise ValueError("a list of texts holds primitive values only")
    rows = [(i, None if t is None else str(t)) for i, t in enumerate(texts)]
    return analyze(spark.createDataFrame(rows, "position int, text string"), **options)


__all__ = ["FINDING", "analyze", "analyze_record", "analyze_texts", "contains_pii", "explode", "leaves", "ordered", "without_duplicates"]
