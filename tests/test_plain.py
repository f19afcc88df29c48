from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.functions import phones, spans
from veilspark.functions import tokens as tk
from veilspark.operators import anonymize as an
from veilspark.operators.analyze import FINDING, analyze, analyze_texts, explode, ordered, without_duplicates
from veilspark.plans.catalog import deny_list, from_config, select
from veilspark.plans.registry import Registry, check_languages
from veilspark.sources.text import report


def test_selection():
    assert {"CREDIT_CARD", "US_SSN"} <= {r.entity for r in select("en")}
    assert "US_SSN" not in {r.entity for r in select("de")}
    with pytest.raises(ValueError):
        select("en", ["NOTHING"])
    (r,) = from_config({"recognizers": [{"name": "t", "supported_entity": "TITLE", "deny_list": ["Mr.", "Dr."]}]})
    assert r.patterns[0][1] == 1.0


def test_analyze_and_anonymize(spark):
    df = spark.createDataFrame([("mail a@b.org, card 4111 1111 1111 1111",), ("",), (None,)], "text string")
    out = an.anonymize(analyze(df, entities=["EMAIL_ADDRESS", "CREDIT_CARD"])).collect()
    assert out[0].anonymized == "mail <EMAIL_ADDRESS>, card <CREDIT_CARD>"
    assert [(i.start, i.end, i.operator) for i in out[0]["items"]] == [(27, 40, "replace"), (5, 20, "replace")]
    assert out[1].findings == [] and out[1].anonymized == "" and out[2].anonymized is None


def _texts(spark, text, entity):
    out = analyze(spark.createDataFrame([(text,)], "text string"), entities=[entity]).collect()[0]
    return [text[f.start : f.end] for f in out.findings]


def test_iban_by_country(spark):
    text = "DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432, FR1420041010050500013M02606; DE88370400440532013000 ZZ89370400440532013000"
    assert sorted(_texts(spark, text, "IBAN_CODE")) == ["DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "GB82WEST12345698765432"]


def test_wallets(spark):
    good = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]
    text = " ".join([*good, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5"])
    assert sorted(_texts(spark, text, "CRYPTO")) == sorted(good)


def test_context_beyond_long_words(spark):
    texts = ["SSN " + "x" * 120 + " 219-09-9999", "ssn one two three four five 219-09-9999"]
    got = {r.text: r.findings for r in analyze(spark.createDataFrame([(x,) for x in texts], "text string"), entities=["US_SSN"]).collect()}
    assert [any(f.score_enhanced for f in got[x]) for x in texts] == [True, False] and all(got.values())


def test_rewrites_refuse_wrong_places(spark):
    schema = "text string, findings array<struct<entity_type:string,start:int,end:int,score:double>>"
    for bad in [("A", -1, 2, 0.5), ("A", 3, 2, 0.5), ("", 0, 1, 0.5), ("A", 0, 9, 0.5)]:
        with pytest.raises(Exception, match="invalid finding"):
            an.anonymize(spark.createDataFrame([("abc", [bad])], schema), strict=True).collect()
    with pytest.raises(Exception, match="no operator"):
        an.deanonymize(spark.createDataFrame([("abc", [("A", 0, 1, 0.5)])], schema), "text", "findings", {}).collect()


def test_decrypt_is_lenient(spark):
    key, df = "WmZq4t7w!z%C&F)J", spark.createDataFrame([("some text",)], "t string")
    sent = df.select(an.encrypt(key)(df.t, df.t).alias("t")).first().t
    got = spark.createDataFrame([(sent.rstrip("="),), (sent[:5] + " \n" + sent[5:],)], "t string")
    assert [r[0] for r in got.select(an.decrypt(key)(got.t, got.t)).collect()] == ["some text"] * 2


def test_deny_list_next_to_letters(spark):
    out = analyze(spark.createDataFrame([("\u00e9and and, \u00fcber",)], "text string"), recognizers=[deny_list("T", ["and"])]).first()
    assert [(f.start, f.end) for f in out.findings] == [(5, 8)]
    assert analyze(spark.createDataFrame([("a@b.org",), (None,)], "text string"), recognizers=[]).select("findings").collect() == [([],), (None,)]


def test_phones(spark):
    text = "call (212) 555-0143, +49 30 12345678, 2024-01-02 10:00, a212-555-0143, $212-555-0143, 212-555-0143%, 1.2.3.4.5.6.7, 020 7946 0958 ext 12"
    got = spark.createDataFrame([(text,)], "t string")
    assert [m.text for m in got.select(phones.find(got.t).alias("m")).first().m] == ["(212) 555-0143", "+49 30 12345678", "020 7946 0958 ext 12"]
    one = lambda t, r: spark.createDataFrame([(t,)], "t string").select(phones.parse(F.col("t"), r).alias("p"), phones.kind(F.col("t"), r).alias("k"), phones.possible(F.col("t"), r).alias("q")).first()
    assert one("+44 7911 123456 x9", "GB").p.asDict() == {"country_code": "44", "national": "7911123456", "extension": "9", "international": True}
    assert [one(t, r).k for t, r in (("082 123 4567", "ZA"), ("011 123 4567", "ZA"), ("212-555-0143", "US"), ("+33 6 12 34 56 78", "FR"), ("+33 6 12", "FR"), ("+33 1 23 45 67 89", "GB"))] == ["mobile", "fixed", "either", "mobile", None, None]
    assert one("999 999 9999", "US").q and one("999 999 9999", "US").k is None
    with pytest.raises(ValueError):
        phones.valid(F.lit("1"), ("XX",))


def test_registry():
    reg = Registry.predefined(("en", "it"), context={"US_SSN": ("social",)})
    assert len(reg.recognizers("en", all_fields=True)) == 17 and len(reg.recognizers("it", all_fields=True)) == 16
    (ssn,) = reg.recognizers("en", ["US_SSN"])
    assert ssn.context == ("social",) and "IT_PASSPORT" in reg.supported_entities(("it",)) and "IT_PASSPORT" not in reg.supported_entities(("en",))
    assert not [r for r in reg.remove(ssn.name).recognizers("en", all_fields=True) if r.entity == "US_SSN"]
    assert reg.add(deny_list("T", ["x"])).recognizers("it", ["T"])
    for call in (lambda: reg.recognizers("en"), lambda: reg.recognizers("en", ["NONE"]), lambda: Registry(("xx",)).recognizers("xx", all_fields=True), lambda: check_languages(reg, ("en",)), lambda: check_languages(reg, ("en", "it"), "de")):
        with pytest.raises(ValueError):
            call()


def test_texts_of_other_kinds(spark):
    with pytest.raises(ValueError):
        analyze_texts(spark, ["a", ["b"]])


def test_tokens(spark):
    df = spark.createDataFrame([("The stories: don't stop, it is 3.5%",)], "t string").select(tk.tokens(F.col("t")).alias("t"))
    got = df.first().t
    assert [x.text for x in got][:6] == ["The", "stories", ":", "don", "'", "t"] and got[1].lemma == "story" and got[0].is_stop and got[2].is_punct
    assert df.select(tk.keywords(F.col("t")).alias("k")).first().k[0] == "story"
    ents = spark.createDataFrame([([("PER", 0, 3), ("ORG", 4, 6), ("CARDINAL", 7, 8), ("X", 9, 10)],)], "e array<struct<label:string,start:int,end:int>>")
    out = ents.select(tk.entities_to_findings(F.col("e"), {"PER": "PERSON", "ORG": "ORGANIZATION", "CARDINAL": "N"}, ignored=("CARDINAL",), low=("ORGANIZATION",)).alias("f")).first().f
    assert [(x.entity_type, round(x.score, 2)) for x in out] == [("PERSON", 0.85), ("ORGANIZATION", 0.34)]


def test_find_many(spark):
    df = spark.createDataFrame([("ab " * 1000,)], "t string")
    assert [(m.start, m.end) for m in df.select(spans.find(df.t, "a").alias("m")).first().m] == [(3 * i, 3 * i + 1) for i in range(1000)]


def test_report(spark):
    df = spark.createDataFrame([("a.txt", 3, "EMAIL_ADDRESS", 4, 9, 0.5, "R"), (None, 1, "URL", 0, 2, 1.0, None)], "file string, line int, entity_type string, start int, end int, score double, recognizer string")
    lines = lambda style: [r.value for r in report(df, style).orderBy("start").collect()][::-1]
    assert lines("standard") == ["  3:5       0.5      EMAIL_ADDRESS", "  1:1       1.0      URL"]
    assert lines("github") == ["::0.5 file=a.txt,line=3,col=5::3:5 [EMAIL_ADDRESS]", None]
    assert lines("parsable")[0] == '{"file":"a.txt","line":3,"column":5,"entity_type":"EMAIL_ADDRESS","start":4,"end":9,"score":0.5,"recognizer":"R"}'
    assert lines("colored")[1].endswith("URL")
    with pytest.raises(ValueError):
        report(df, "xml")


def test_findings_with_their_text(spark):
    """Findings that bring their text have the same rows as those whose text is cut out, with brackets, stand-ins and nested matches too."""
    odd = ["\ue000a\ue001b aab", "\ue002ab a\ue002b", "\U0001f608 ab aab abab", "none", "", None]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    rules = from_config({"recognizers": [{"name": "n", "supported_entity": "N", "patterns": [{"regex": "a.?b", "score": 0.5}, {"regex": "[^ ]*b", "score": 0.4}, {"regex": "b", "score": 0.9}, {"regex": "x*", "score": 0.1}]}]})
    plain = [r.asDict() for r in explode(analyze(df, recognizers=rules)).collect()]
    assert plain and [r.asDict() for r in explode(analyze(df, recognizers=rules, spans=True)).collect()] == plain


def test_duplicates(spark):
    """Inside a better one of the type: gone; beside, touching, empty or of another type: as the comparison of all pairs says."""
    import random

    rng, cases = random.Random(7), []
    for n in range(300):
        rows = [(rng.choice("AB"), s, s + rng.randint(0, 4), rng.choice([0.0, 0.3, 0.9]), "r", False, None) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 9)))]
        cases.append((n, rows))
    made = spark.createDataFrame(cases, f"n int, f array<{FINDING}>").select("n", ordered(F.col("f")).alias("f"))
    for r in made.select("f", without_duplicates(F.col("f")).alias("kept")).collect():
        kept = []
        for x in r.f:
            if x.score > 0 and not any(y.entity_type == x.entity_type and x.start >= y.start and x.end <= y.end for y in kept):
                kept.append(x)
        assert r.kept == kept
