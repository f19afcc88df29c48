"""Validators of national identifiers as Column functions: true, false, or null where the check cannot tell (the pattern's score stands)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import at, both, compact, digits, luhn, mod11_10, weighted

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def form(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def or_unknown(ok: Column) -> Column:
    """True where the check holds, null where it does not."""
    return F.when(ok, True)


def unless(bad: Column) -> Column:
    """False where something is wrong, null otherwise."""
    return F.when(bad, False)


def place(letter: Column) -> Column:
    """A is 1, Z is 26."""
    return F.instr(F.lit(LETTERS), letter)


def digit_sums(d: Column, weights: list[int]) -> Column:
    """Sum of the digits of each weighted digit."""
    out = F.lit(0)
    for i, w in enumerate(weights):
        p = at(d, i) * w
        out = out + F.floor(p / 10).cast("int") + p % 10
    return out


def real_date(yy: Column, mm: Column, dd: Column) -> Column:
    """Whether two-digit year, month and day are a date of this century or the last: 00 is 2000, so every fourth year has a 29 February."""
    y, m, d = (x.try_cast("int") for x in (yy, mm, dd))
    longest = F.when(m == 2, F.when(y % 4 == 0, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(m.between(1, 12) & (d >= 1) & (d <= longest), F.lit(False))


def icao(s: Column) -> Column:
    """Weights 7, 3, 1 over eight letters (A is 10) and digits, last digit of the sum ninth."""
    total = F.lit(0)
    for i in range(8):
        c = F.substring(s, i + 1, 1)
        total = total + F.coalesce(c.try_cast("int"), place(c) + 9) * (7, 3, 1)[i % 3]
    return total % 10 == at(s, 8)


# Germany
def id_card_de(text: Column) -> Column:
    s = F.upper(text)
    return F.when(form(s, "T[0-9]{8}"), None).otherwise(both(form(s, "[A-Z0-9]{8}[0-9]"), icao(s)))


def passport_de(text: Column) -> Column:
    s = F.upper(text)
    return both(form(s, "[CFGHJ-NPRTV-Z0-9]{8}[0-9]"), icao(s))


def health_de(text: Column) -> Column:
    s = F.upper(text)
    d = F.concat(F.lpad(place(F.substring(s, 1, 1)).cast("string"), 2, "0"), F.substring(s, 2, 9))
    return both(form(s, "[A-Z][0-9]{9}"), digit_sums(d, [1, 2] * 5) % 10 == at(d, 10))


def social_de(text: Column) -> Column:
    s = F.upper(text)
    day = F.substring(s, 3, 2)
    d = F.concat(F.substring(s, 1, 8), F.lpad(place(F.substring(s, 9, 1)).cast("string"), 2, "0"), F.substring(s, 10, 3))
    check = digit_sums(d, [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1]) % 10 == at(d, 12)
    return both(form(s, "[0-9]{8}[A-Z][0-9]{3}"), day.between("01", "31") | day.between("51", "81"), F.substring(s, 5, 2).between("01", "12"), check)


def bsnr_de(text: Column) -> Column:
    return unless(~form(text, "[0-9]{9}") | (text == "000000000"))


def vat_de(text: Column, strict: bool = False) -> Column:
    s = F.upper(F.regexp_replace(text, r"[\s.\-]", ""))
    right = mod11_10(F.substring(s, 3, 9), 8)
    return F.when(~form(s, "DE[0-9]{9}"), False).when(right, True).otherwise(F.lit(False) if strict else F.lit(None).cast("boolean"))


# South Africa
def id_za(text: Column) -> Column:
    born = real_date(F.substring(text, 1, 2), F.substring(text, 3, 2), F.substring(text, 5, 2))
    return both(form(text, "[0-9]{13}"), born, at(text, 10) <= 2, at(text, 11).isin(8, 9), luhn(text))


def company_za(text: Column, year: int | None = None) -> Column:
    y = F.regexp_extract(text, "([0-9]{4})/", 1).try_cast("int")
    return both(form(text, "[0-9]{4}/[0-9]{6}/[0-9]{2}|(?:CK|K|B|M)[0-9]{4}/[0-9]{6}"), y.between(F.lit(1800), F.lit(year) if year else F.year(F.current_date())))


def licence_za(text: Column) -> Column:
    return form(text, r"(?=.*[A-Z])(?=.{10,14}$)[0-9]{6,10}[0-9A-Z]{2,5}")


# Registration suffixes of the nine provinces.
PROVINCES_ZA = "GP ZN WP EC FS NW NC MP L"


def plate_za(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    return form(s, rf"(?=.*[0-9])(?:[0-9]{{0,6}}[A-Z][0-9A-Z]{{0,6}})(?:{'|'.join(PROVINCES_ZA.split())})")


def passport_za(text: Column) -> Column:
    return form(text, "[ADMT][0-9]{8}")


def tax_za(text: Column) -> Column:
    return form(text, "[01239][0-9]{9}")


def vat_za(text: Column) -> Column:
    return form(text, "4[0-9]{9}")


def traffic_za(text: Column) -> Column:
    return both(form(text, "[0-9]{13}"), ~id_za(text))


# Korea
def brn_kr(text: Column) -> Column:
    d = digits(text)
    carry = F.floor(at(d, 8) * 5 / 10).cast("int")
    return both(F.length(d) == 10, (10 - (weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + carry) % 10) % 10 == at(d, 9))


def _resident_kr(text: Column, base: int) -> Column:
    d = digits(text)
    known = both(F.length(d) == 13, F.substring(d, 8, 2).between("00", "95"))
    return F.when(F.length(d) != 13, False).otherwise(or_unknown(both(known, (base - weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == at(d, 12))))


def rrn_kr(text: Column) -> Column:
    return _resident_kr(text, 11)


def frn_kr(text: Column) -> Column:
    return _resident_kr(text, 13)


def licence_kr(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 12, F.substring(d, 1, 2).between("11", "26") | (F.substring(d, 1, 2) == "28"))


# others
def person_se(text: Column) -> Column:
    d = F.right(digits(text), F.lit(10))
    day = F.substring(d, 5, 2).try_cast("int")
    day = F.lpad(F.when(day > 60, day - 60).otherwise(day).cast("string"), 2, "0")
    return both(F.length(digits(text)).isin(10, 12), real_date(F.substring(d, 1, 2), F.substring(d, 3, 2), day), luhn(d))


def licence_uk(text: Column) -> Column:
    return unless(~form(F.upper(text), "(?:[A-Z]{5}|[A-Z]{1,4}9+)(?<=^.{5})[0-9](?:[05][1-9]|[16][0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9][A-Z9]{2}[0-9A-Z][A-Z]{2}"))


def plate_uk(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, " ", ""))
    age = F.substring(s, 3, 2)
    return F.when(form(s, "[A-Z]{2}[0-9]{2}[A-Z]{3}") & ~(age.between("02", "29") | age.between("51", "79")), False)


def plate_tr(text: Column) -> Column:
    code = F.regexp_extract(text, "^([0-9]{2})", 1).try_cast("int")
    return F.when(code.isNotNull(), code.between(1, 81))


# Registration codes of the states and union territories.
STATES_IN = "AN AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UA UK UP WB"


def plate_in(text: Column) -> Column:
    s = F.upper(compact(text))
    serial = F.regexp_extract(s, "([0-9]{1,4})$", 1).try_cast("int")
    state = form(s, rf"(?:{'|'.join(STATES_IN.split())})(?!00)[0-9]{{2}}[A-Z]{{0,3}}[0-9]{{1,4}}") & (serial >= 1)
    return or_unknown(state | form(s, "[0-9]{1,3}(?:CC|CD|UN)[0-9]{1,4}"))


def tin_ph(text: Column) -> Column:
    d = digits(text)
    return unless(~F.length(d).isin(9, 12) | F.coalesce(weighted(d, [9, 8, 7, 6, 5, 4, 3, 2]) % 11 != at(d, 8), F.lit(True)))


# Fixed values of the code's definition: worth of a character at an odd place, for 0-9 and A-Z.
ODD_IT = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def fiscal_it(text: Column) -> Column:
    s, odd = F.upper(text), F.array(*map(F.lit, ODD_IT))
    total = F.lit(0)
    for i in range(15):
        c = F.substring(s, i + 1, 1)
        v = F.coalesce(c.try_cast("int"), place(c) - 1)
        total = total + (F.try_element_at(odd, v + 1) if i % 2 == 0 else v)
    return F.when(form(s, "[A-Z0-9]{15}[A-Z]"), or_unknown(total % 26 == place(F.substring(s, 16, 1)) - 1))


# Fixed values of the number's definition: weights and check letters of its forms; the entity kinds of the third.
UEN_BUSINESS, UEN_COMPANY, UEN_OTHER = ([10, 4, 9, 3, 8, 2, 7, 1], "XMKECAWLJDB"), ([10, 8, 6, 4, 9, 7, 5, 3, 1], "ZKCMDNERGWH"), ([4, 3, 5, 3, 10, 2, 2, 5, 7], "ABCDEFGHJKLMNPQRSTUVWX0123456789")


def uen_sg(text: Column, year: int | None = None) -> Column:
    s = F.upper(text)
    letter = lambda total, letters: F.substring(F.lit(letters), (total % 11 + 1).cast("int"), F.lit(1)) == F.right(s, F.lit(1))
    weights, alphabet = UEN_OTHER
    worth = F.lit(0)
    for i, w in enumerate(weights):
        worth = worth + (F.instr(F.lit(alphabet), F.substring(s, i + 1, 1)) - 1) * w
    other = F.substring(F.lit(alphabet), (F.pmod(worth - 5, F.lit(11)) + 1).cast("int"), F.lit(1)) == F.right(s, F.lit(1))
    now = F.lit(year) if year else F.year(F.current_date())
    return (
        F.when(form(s, "[0-9]{8}[A-Z]"), letter(weighted(s, UEN_BUSINESS[0]), UEN_BUSINESS[1]))
        .when(form(s, "[0-9]{9}[A-Z]"), both(F.substring(s, 1, 4).try_cast("int") <= now, letter(weighted(s, UEN_COMPANY[0]), UEN_COMPANY[1])))
        .when(form(s, "[TSR][0-9]{2}[A-Z]{2}[0-9]{4}[0-9A-Z]"), both((F.substring(s, 1, 1) != "T") | (F.substring(s, 2, 2).try_cast("int") + 2000 <= now), other))
        .otherwise(False)
    )
