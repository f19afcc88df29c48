"""Phone numbers: candidates in text, parsing, validity and type by region, as Column functions over a small table of numbering plans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans


class Plan(NamedTuple):
    """Numbering plan of a region: country code, prefix of national calls, patterns of fixed lines and mobiles without it."""

    code: str
    prefix: str
    fixed: str
    mobile: str


# Numbering plans as the regulators publish them, reduced to leading digits and lengths.
_NANP = "[2-9][0-8][0-9][2-9][0-9]{6}"
PLANS = {
    "US": Plan("1", "1", _NANP, _NANP),
    "CA": Plan("1", "1", "(?:204|226|236|249|250|263|289|306|343|354|365|367|368|382|387|403|416|418|428|431|437|438|450|468|474|506|514|519|548|579|581|584|587|604|613|639|647|672|683|705|709|742|753|778|780|782|807|819|825|867|873|879|902|905)[2-9][0-9]{6}", "(?!)"),
    "GB": Plan("44", "0", "(?:1[0-9]{8,9}|2[03489][0-9]{8}|3[0347][0-9]{8}|[589][0-9]{9})", "7[1-57-9][0-9]{8}"),
    "DE": Plan("49", "0", "(?:[2-9][0-9]{5,10}|3[0-9]{6,10})", "1(?:5[0-25-9][0-9]{7,8}|6[023][0-9]{7,8}|7[0-9]{8})"),
    "FR": Plan("33", "0", "[1-589][0-9]{8}", "[67][0-9]{8}"),
    "IL": Plan("972", "0", "(?:[23489][0-9]{7}|7[1-9][0-9]{7})", "5[0-9]{8}"),
    "IN": Plan("91", "0", "(?:1[0-9]{9}|[2-5][0-9]{9})", "[6-9][0-9]{9}"),
    "BR": Plan("55", "0", "[1-9][1-9][2-5][0-9]{7}", "[1-9][1-9]9[0-9]{8}"),
    "ZA": Plan("27", "0", "(?:[1-5][0-9]{8}|8[05-9][0-9]{7}|9[0-9]{8})", "(?:[67][0-9]{8}|8[1-4][0-9]{7})"),
}
DEFAULT_REGIONS = ("US", "GB", "DE", "FR", "IL", "IN", "CA", "BR")
# at least 7 and at most 17 digits, with punctuation between; no letter, currency or percent sign beside
CANDIDATE = r"(?=[0-9+(])(?<![0-9A-Za-z$€£¥%/.,:+-])(?:\+ ?|\((?=[0-9 ]{1,6}\)))?[0-9](?:[ ().\-/]{0,3}[0-9]){6,16}(?:(?: ?(?:ext\.?|x) ?)[0-9]{1,7})?(?![0-9A-Za-z€£¥%]|[-/.:,][0-9])"
HOLDS = r"[0-9](?:[ ().\-/]{0,3}[0-9]){6}"
_DATE = r"^(?:[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}|[0-9]{8} ?[0-9]{2}:?[0-9]{2}.*)$"


def parse(text: Column, region: str) -> Column:
    """country_code, national (digits without country code and national prefix), extension and whether it was written internationally;
    null where the text has no 2 to 17 digits or names another country's code."""
    plan = PLANS[region]
    extension = F.regexp_extract(text, r"(?:ext\.?|x) ?([0-9]{1,7})$", 1)
    main = F.regexp_replace(F.regexp_replace(text, r" ?(?:ext\.?|x) ?[0-9]{1,7}$", ""), r"(?<=[0-9 ])\(0\)", "")
    d = F.regexp_replace(main, "[^0-9]", "")
    abroad = F.ltrim(main).startswith("+") | d.startswith("00")
    d = F.when(F.ltrim(main).startswith("+"), d).otherwise(F.regexp_replace(d, "^00", "")) if plan.prefix == "0" else d
    national = F.when(abroad, F.substring(d, F.lit(len(plan.code) + 1), F.length(d))).otherwise(F.regexp_replace(d, f"^{plan.prefix}", ""))
    ok = F.length(d).between(2, 17) & (~abroad | d.startswith(plan.code))
    return F.when(ok, F.struct(F.lit(plan.code).alias("country_code"), national.alias("national"), F.nullif(extension, F.lit("")).alias("extension"), abroad.alias("international")))


def kind(text: Column, region: str) -> Column:
    """``fixed``, ``mobile``, ``either`` (where a plan does not tell) or null for a number that is none of the region."""
    plan, number = PLANS[region], parse(text, region)["national"]
    fixed, mobile = number.rlike(f"^{plan.fixed}$"), number.rlike(f"^{plan.mobile}$")
    return F.when(fixed & mobile, "either").when(mobile, "mobile").when(fixed, "fixed")


def possible(text: Column, region: str) -> Column:
    """Whether the number has a length that some number of the region has."""
    return F.coalesce(F.length(parse(text, region)["national"]).between(7, 11), F.lit(False))


def balanced(text: Column) -> Column:
    """Brackets open and close in turn, in one pair at most each time."""
    return F.regexp_replace(text, r"\([^()]*\)", "").rlike("[()]") == F.lit(False)


def valid(text: Column, regions: tuple[str, ...] = DEFAULT_REGIONS, wanted: str | None = None, leniency: str = "valid") -> Column:
    """Whether a candidate is a number of one of the regions: no date, brackets balanced, and possible or valid there."""
    if leniency not in ("possible", "valid"):
        raise ValueError("leniency is possible or valid")
    if unknown := set(regions) - set(PLANS):
        raise ValueError(f"no numbering plan for {sorted(unknown)}")
    test = F.lit(False)
    for r in regions:
        of_kind = F.coalesce(kind(text, r).isin(wanted, "either") if wanted else kind(text, r).isNotNull(), F.lit(False))
        test = test | (possible(text, r) if leniency == "possible" else of_kind)
    return ~text.rlike(_DATE) & balanced(text) & test


def find(text: Column, regions: tuple[str, ...] = DEFAULT_REGIONS, wanted: str | None = None, leniency: str = "valid") -> Column:
    """Spans (start, end, text) of the phone numbers of a text, as of any of the regions."""
    return F.filter(spans.find(text, CANDIDATE), lambda m: valid(m["text"], regions, wanted, leniency))
