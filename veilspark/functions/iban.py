"""IBAN formats by country: a pattern that matches exactly the length a country uses, so that no text after the number joins it."""

from __future__ import annotations

import re

# Structure of the account part by country, from the public IBAN registry. n: digits, a: letters, c: letters or digits.
FORMATS = """
AD 4n4n12c, AE 3n16n, AL 8n16c, AT 5n11n, AZ 4a20c, BA 16n, BE 12n, BG 4a6n8c, BH 4a14c, BR 23n1a1c, BY 4c4n16c, CH 5n12c,
CR 18n, CY 8n16c, CZ 20n, DE 18n, DK 14n, DO 4c20n, EE 16n, EG 25n, ES 20n, FI 14n, FO 14n, FR 10n11c2n, GB 4a14n, GE 2a16n,
GI 4a15c, GL 14n, GR 7n16c, GT 4c20c, HR 17n, HU 24n, IE 4a14n, IL 19n, IQ 4a15n, IS 22n, IT 1a10n12c, JO 4a4n18c, KW 4a22c,
KZ 3n13c, LB 4n20c, LC 4a24c, LI 5n12c, LT 16n, LU 3n13c, LV 4a13c, MC 10n11c2n, MD 20c, ME 18n, MK 3n10c2n, MR 23n, MT 4a5n18c,
MU 4a19n3a, NL 4a10n, NO 11n, PK 4a16c, PL 24n, PS 4a21c, PT 21n, QA 4a21c, RO 4a16c, RS 18n, SA 2n18c, SC 4a20n3a, SE 20n,
SI 15n, SK 20n, SM 1a10n12c, ST 21n, SV 4a20n, TL 19n, TN 20n, TR 6n16c, UA 6n19c, VA 18n, VG 4a16n, XK 16n
"""
_KINDS = {"n": "[0-9]", "a": "[A-Z]", "c": "[0-9A-Z]"}


def formats() -> dict[str, str]:
    """Structure by country code."""
    return dict(x.split() for x in FORMATS.replace("\n", " ").split(",") if x.strip())


def pattern() -> str:
    """Java pattern of IBANs of every country; a space or dash may stand before any character after the check digits."""
    one = lambda s: "".join(f"(?:[ -]?{_KINDS[k]}){{{n}}}" for n, k in re.findall(r"([0-9]+)([nac])", s))
    return "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"{c}[0-9]{{2}}{one(s)}" for c, s in formats().items()) + ")"
