"""Tokens of text as arrays of structs: places, lookup lemmas, stop words, punctuation. No model is needed; findings of a model come in as an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans

# apostrophe endings and punctuation are tokens of their own
TOKEN = r"(?U)(?:https?://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\p{N}+(?:[.,:/-]\p{N}+)*|[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*|'(?:s|re|ve|ll|d|m)\b|\p{N}*[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"
# a short list for tests and defaults; callers give their own for other languages
STOP_WORDS = "a an and are as at be been but by for from had has have he her his i in is it its my no not of on or our she so that the their them they this to was we were which will with you your"


def lemma(word: Column) -> Column:
    """Lower case; plurals in -ies end in y."""
    low = F.lower(word)
    return F.when(low.rlike("^[a-z]{2,}ies$"), F.regexp_replace(low, "ies$", "y")).otherwise(low)


def tokens(text: Column, stop_words: str = STOP_WORDS) -> Column:
    """array of (text, start, end, norm, lemma, is_stop, is_punct); null for null text."""
    stop = F.array(*map(F.lit, stop_words.split()))
    made = lambda m: F.struct(
        m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lower(m["text"]).alias("norm"), lemma(m["text"]).alias("lemma"),
        F.array_contains(stop, F.lower(m["text"])).alias("is_stop"), m["text"].rlike(r"^\p{P}+$").alias("is_punct"),
    )
    return F.transform(spans.find(text, TOKEN), made)


def no_tokens() -> Column:
    """What an analysis without a tokenizer has: no tokens."""
    return F.filter(tokens(F.lit("")), lambda t: t["start"] < 0)


def keywords(found: Column) -> Column:
    """Lemmas that are neither stop words nor punctuation nor ``be``, split at colons."""
    kept = F.filter(found, lambda t: ~t["is_stop"] & ~t["is_punct"] & (t["lemma"] != "be"))
    return F.filter(F.flatten(F.transform(kept, lambda t: F.split(t["lemma"], ":"))), lambda w: w != "")


def entities_to_findings(entities: Column, labels: dict[str, str], wanted: list[str] | None = None, ignored: tuple[str, ...] = (), low: tuple[str, ...] = (), score: float = 0.85, factor: float = 0.4) -> Column:
    """Findings of a model's entities (label, start, end): labels mapped to entity types, ignored ones and those not wanted left out, scores of
    low-score types multiplied by ``factor``."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    typed = F.transform(F.filter(entities, lambda e: ~e["label"].isin(*ignored) if ignored else F.lit(True)), lambda e: F.struct(F.try_element_at(names, e["label"]).alias("entity_type"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end")))
    kept = F.filter(typed, lambda e: e["entity_type"].isNotNull() & (e["entity_type"].isin(*wanted) if wanted else F.lit(True)))
    return F.transform(kept, lambda e: F.struct(e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), F.when(e["entity_type"].isin(*low) if low else F.lit(False), score * factor).otherwise(score).alias("score")))
