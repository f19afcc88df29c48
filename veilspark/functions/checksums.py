"""Checksum and format validators as Column functions: true, false, or null where the check cannot tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verhoeff multiplication and permutation tables.
VERHOEFF_D = [
    "0123456789", "1234067895", "2340178956", "3401289567", "4012395678",
    "5987604321", "6598710432", "7659821043", "8765932104", "9876543210",
]
VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s.\-_/]", "")


def at(text: Column, i: int | Column) -> Column:
    """Digit at a zero-based place; null where there is none."""
    return F.substring(text, F.lit(i) + 1 if isinstance(i, int) else i + 1, F.lit(1)).try_cast("int")


def weighted(d: Column, weights: list[int]) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + at(d, i) * w
    return out


def luhn(text: Column) -> Column:
    d = digits(text)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = v * 2
        return total + F.when(i % 2 == 0, v).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(F.length(d) == 0, False).otherwise(F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0)


def verhoeff(text: Column) -> Column:
    d = digits(text)
    table_d, table_p = F.lit("".join(VERHOEFF_D)), F.lit("".join(VERHOEFF_P))

    def step(c: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        p = F.substring(table_p, (i % 8) * 10 + v + 1, F.lit(1)).cast("int")
        return F.substring(table_d, c * 10 + p + 1, F.lit(1)).cast("int")

    return F.when(F.length(d) == 0, False).otherwise(F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) == 0)


def mod97(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.when(F.length(s) < 5, False).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1)


def mod11_10(d: Column, n: int) -> Column:
    """ISO 7064 mod 11,10 over ``n`` digits and the check digit after them."""
    def step(p: Column, i: Column) -> Column:
        s = (F.substring(d, i, F.lit(1)).try_cast("int") + p) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    last = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(10), step)
    return (11 - last) % 10 == at(d, n)


def length_is(text: Column, *n: int) -> Column:
    return F.length(text).isin(*n)


def both(*conditions: Column) -> Column:
    """All hold; later ones are not looked at where an earlier one fails."""
    out = conditions[-1]
    for c in reversed(conditions[:-1]):
        out = F.when(c, out).otherwise(False)
    return out


def ip(text: Column) -> Column:
    v4 = text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:/(?:3[0-2]|[12]?[0-9]))?$")
    plain = F.regexp_replace(text, "(?:%[0-9A-Za-z._-]+)?(?:/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9]))?$", "")  # zone and prefix length
    groups = F.filter(F.split(plain, ":"), lambda g: g != "")
    v6 = plain.rlike(r"^[0-9A-Fa-f:]+$") & F.forall(groups, lambda g: F.length(g) <= 4) & F.when(plain.contains("::"), F.size(groups) <= 7).otherwise((F.size(groups) == 8) & ~plain.rlike("^:|:$")) & ~plain.rlike(":::|::.*::")
    return v4 | (text.contains(":") & v6)


def mac(text: Column) -> Column:
    h = F.upper(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return both(F.length(h) == 12, ~h.isin("FFFFFFFFFFFF", "000000000000"))


def uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def ssn(text: Column) -> Column:
    """False for numbers that cannot be issued, null otherwise (the pattern's score stands)."""
    d = digits(text)
    mixed = F.length(F.regexp_replace(text, "[^ .-]", "")).isin(2) & text.rlike(r"[ .-]") & ~text.rlike(r"^[0-9]+([ .-])[0-9]+\1[0-9]+$")
    bad = mixed | d.rlike(r"^([0-9])\1{8}$") | d.rlike("^(?:000|666)") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000") | d.isin("123456789", "987654320", "078051120")
    return F.when(bad, False)  # the three numbers are fixed values: samples that were never issued


def nhs(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 10, weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)


def aba(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 9, weighted(d, [3, 7, 1] * 3) % 10 == 0)


def npi(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 10, ~d.rlike(r"^([0-9])\1{9}$"), luhn(F.concat(F.lit("80840"), d)))


def pesel(text: Column) -> Column:
    return both(text.rlike("^[0-9]{11}$"), weighted(text, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1]) % 10 == 0)


def aadhaar(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 12, at(d, 0) >= 2, d != F.reverse(d), verhoeff(d))


def nin_ng(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 11, verhoeff(d))


def dea(text: Column) -> Column:
    d = F.substring(text, 3, 7)
    return both(d.rlike("^[0-9]{7}$"), ((at(d, 0) + at(d, 2) + at(d, 4)) + 2 * (at(d, 1) + at(d, 3) + at(d, 5))) % 10 == at(d, 6))


def abn(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 11, (weighted(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0)


def acn(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 9, (10 - weighted(d, [8, 7, 6, 5, 4, 3, 2, 1]) % 10) % 10 == at(d, 8))


def tfn(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 9, weighted(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)


def medicare(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) >= 10, weighted(d, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == at(d, 8))


def nif(text: Column) -> Column:
    s = F.upper(compact(text))
    n = F.regexp_extract(s, "^([0-9]{1,9})", 1).try_cast("int")
    return F.coalesce(F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), n % 23 + 1, F.lit(1)) == F.right(s, F.lit(1)), F.lit(False))


def nie(text: Column) -> Column:
    s = F.upper(compact(text))
    return both(s.rlike("^[XYZ][0-9]{7}[A-Z]$"), nif(F.concat(F.translate(F.substring(s, 1, 1), "XYZ", "012"), F.substring(s, F.lit(2), F.length(s)))))


def vat_it(text: Column) -> Column:
    d = compact(text)
    return both(d.rlike("^[0-9]{11}$"), d != "00000000000", luhn(d))


def tax_de(text: Column) -> Column:
    d = compact(text)
    often = F.exists(F.sequence(F.lit(0), F.lit(9)), lambda v: F.length(F.substring(d, 1, 10)) - F.length(F.replace(F.substring(d, 1, 10), v.cast("string"), F.lit(""))) > 3)
    return both(d.rlike("^[1-9][0-9]{10}$"), ~often, mod11_10(d, 10))


def tnin_th(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 13, (11 - weighted(d, list(range(13, 1, -1))) % 11) % 10 == at(d, 12))


def id_tr(text: Column) -> Column:
    d = digits(text)
    odd, even = weighted(d, [1, 0, 1, 0, 1, 0, 1, 0, 1]), weighted(d, [0, 1, 0, 1, 0, 1, 0, 1])
    return both(F.length(d) == 11, at(d, 0) != 0, F.pmod(odd * 7 - even, F.lit(10)) == at(d, 9), (odd + even + at(d, 9)) % 10 == at(d, 10))


def orgnr_se(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 10, at(d, 2) >= 2, luhn(d))


# State codes of the tax number, 01 to 37.
GST_STATES = [f"{i:02d}" for i in range(1, 38)]


def gstin(text: Column) -> Column:
    return F.upper(text).rlike(f"^(?:{'|'.join(GST_STATES)})[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]$")


def sin_ca(text: Column) -> Column:
    return F.when(~luhn(text), False)


def lanr_de(text: Column) -> Column:
    d = digits(text)
    return both(F.length(d) == 9, (10 - weighted(d, [4, 9, 4, 9, 4, 9]) % 10) % 10 == at(d, 6))


def hetu_fi(text: Column) -> Column:
    s = F.upper(text)
    n = F.concat(F.substring(s, 1, 6), F.substring(s, 8, 3)).try_cast("long")
    return F.coalesce(both(s.rlike("^[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Y]$"), F.substring(s, 1, 2).between("01", "31"), F.substring(s, 3, 2).between("01", "12"), F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (n % 31 + 1).cast("int"), F.lit(1)) == F.right(s, F.lit(1))), F.lit(False))


def card(text: Column) -> Column:
    return both(F.replace(F.replace(text, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")).rlike("^[0-9]+$"), luhn(text))


# A few suffixes of two labels; every other suffix is taken to have one.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.za co.in co.jp com.br com.mx com.tr com.cn com.sg"


def email(text: Column) -> Column:
    """Whether the host has a label that can be registered before its suffix, which has letters only."""
    host = F.lower(F.substring_index(text, "@", -1))
    two = "|".join(x.replace(".", r"\.") for x in SUFFIXES.split())
    return host.rlike(rf"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{{2,}}$") & ~host.rlike(f"^(?:{two})$")
