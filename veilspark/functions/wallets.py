"""Checksums of Bitcoin addresses: base58 with a double SHA-256, and bech32 / bech32m. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and constants of the address formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_END, BECH32M_END = 1, 0x2BC830A3
LIMBS, BITS = 9, 24


def _places(text: Column, alphabet: str) -> Column:
    """Place of each character in the alphabet, -1 where it is not there."""
    return F.transform(F.split(text, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("long"))


def base58check(text: Column) -> Column:
    """Whether 25 bytes come out of base 58 and end with the first four bytes of the double SHA-256 of the others."""
    places = _places(text, BASE58)
    limb_type = "struct<carry:bigint,out:array<bigint>>"

    def times(limbs: Column, place: Column) -> Column:
        start = F.struct(place.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, limb: Column) -> Column:
            v = limb * 58 + acc["carry"]
            return F.struct(F.shiftright(v, BITS).alias("carry"), F.concat(acc["out"], F.array(v.bitwiseAND(F.lit((1 << BITS) - 1)))).alias("out"))

        return F.aggregate(limbs, start.cast(limb_type), one, lambda acc: acc["out"])

    limbs = F.aggregate(places, F.array_repeat(F.lit(0).cast("bigint"), LIMBS), times)
    whole = F.substring(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), ""), 5, 50)
    check = F.substring(F.sha2(F.unhex(F.sha2(F.unhex(F.substring(whole, 1, 42)), 256)), 256), 1, 8)
    ok = F.length(text).between(26, 35) & ~F.exists(places, lambda p: p < 0)
    return F.when(ok, check == F.substring(whole, 43, 8)).otherwise(False)


def bech32(text: Column, prefix: str = "bc") -> Column:
    """Whether an address ``<prefix>1...`` in one case has a right bech32 or bech32m checksum."""
    low = F.lower(text)
    places = _places(F.substring(low, F.lit(len(prefix) + 2), F.length(low)), BECH32)
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]

    def step(chk: Column, v: Column) -> Column:
        out = F.shiftleft(chk.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(v)
        for i, g in enumerate(GENERATOR):
            out = out.bitwiseXOR(F.shiftright(chk, 25 + i).bitwiseAND(F.lit(1)) * F.lit(g))
        return out

    values = F.concat(F.array(*[F.lit(x).cast("long") for x in head]), places)
    end = F.aggregate(values, F.lit(1).cast("long"), step)
    ok = ((text == low) | (text == F.upper(text))) & F.startswith(low, F.lit(prefix + "1")) & ~F.exists(places, lambda p: p < 0)
    return F.when(ok, end.isin(BECH32_END, BECH32M_END)).otherwise(False)


def bitcoin(text: Column) -> Column:
    """Whether a Bitcoin address of either kind has a right checksum."""
    return F.when(F.lower(F.substring(text, 1, 3)) == "bc1", bech32(text)).otherwise(base58check(text))
