"""Recognizer catalogue: entity, patterns with scores, context words, validator, language and country.

The patterns are written for this library from the public formats of the identifiers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..functions import checksums as c
from ..functions import iban, phones, wallets
from ..functions import national as n


@dataclass(frozen=True)
class Recognizer:
    entity: str
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()
    validate: Callable[[Column], Column] | None = None
    languages: tuple[str, ...] = ()  # none: every language
    country: str | None = None
    default: bool = True
    name: str = field(default="")
    holds: str | None = None  # a pattern that every text with a match also holds, cheaper than the patterns
    find: Callable[[Column], Column] | None = None  # spans (start, end, text) by other means than patterns; takes the first pattern's score

    def __post_init__(self) -> None:
        if not self.name:
            object.__setattr__(self, "name", "".join(p.title() for p in self.entity.split("_")) + "Recognizer")
        if not self.patterns or any(not 0 <= s <= 1 for _, s in self.patterns):
            raise ValueError(f"{self.entity}: needs patterns with scores from 0 to 1")


B, E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
DIGIT = "[0-9]"
FIVE = "[0-9](?:[^0-9]?[0-9]){4}"  # five digits, one other character between them at most
_MANY = set("CREDIT_CARD DATE_TIME MEDICAL_LICENSE US_BANK_NUMBER US_DRIVER_LICENSE US_ITIN US_PASSPORT UK_NHS US_NPI ABA_ROUTING_NUMBER PL_PESEL ZA_ID_NUMBER".split())


def _r(entity: str, pattern: str, score: float, context: str = "", validate=None, lang: str = "", country: str | None = None, default: bool = True) -> Recognizer:
    return Recognizer(entity, ((B + pattern + E, score),), tuple(context.split()), validate, tuple(lang.split()), country, default, holds=FIVE if entity in _MANY else DIGIT)


CATALOG: tuple[Recognizer, ...] = (
    _r("CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){12,18}+", 0.3, "credit card visa mastercard amex debit", c.card, "en es it pl"),
    Recognizer("EMAIL_ADDRESS", ((r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 1.0),), ("email", "mail"), c.email, holds="@"),
    Recognizer("IP_ADDRESS", ((r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", 0.6), (r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?:%[0-9A-Za-z]+)?(?:/[0-9]{1,3})?(?![0-9A-Fa-f:])", 0.6)), ("ip", "ipv4", "ipv6", "address"), lambda t: c.F.when(~c.ip(t), False), holds=r"[0-9]\.[0-9]|:[0-9A-Fa-f]{0,4}:"),
    Recognizer("URL", ((r"(?i)(?<![a-z0-9])https?://[^\s<>\"')]+", 0.6), (r"(?i)(?<![a-z0-9@.])www\.[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/[^\s<>\"')]*)?", 0.5)), ("url", "website", "link"), holds=r"://|[wW]{3}\."),
    Recognizer("PHONE_NUMBER", ((phones.CANDIDATE, 0.4),), ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call"), None, holds=phones.HOLDS, find=phones.find),
    _r("IBAN_CODE", iban.pattern(), 0.5, "iban bank transaction", c.mod97),
    _r("DATE_TIME", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 0.6, "date birthday"),
    _r("MAC_ADDRESS", r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}", 0.6, "mac hardware ethernet", lambda t: c.F.when(~c.mac(t), False)),
    _r("UUID", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", 0.5, "uuid guid", lambda t: c.F.when(~c.uuid(t), False)),
    _r("CRYPTO", r"(?:bc1[02-9ac-hj-np-z]{25,62}|[13][1-9A-HJ-NP-Za-km-z]{25,34})", 0.5, "wallet btc bitcoin crypto", wallets.bitcoin),
    _r("MEDICAL_LICENSE", r"[ABCDEFGHJKLMPRSTUX][A-Z9][0-9]{7}", 0.4, "medical certificate dea", c.dea, country="us"),
    # en
    # fixed values: forms, scores and context words of this one are agreed upon, so that findings compare
    Recognizer("US_SSN", ((r"\b(([0-9]{5})-([0-9]{4})|([0-9]{3})-([0-9]{6}))\b", 0.05), (r"\b[0-9]{9}\b", 0.3), (r"\b([0-9]{3})-([0-9]{2})-([0-9]{4})\b", 0.5)), ("social", "security", "ssn", "ssns", "ssn#", "ss#", "ssid"), c.ssn, ("en",), "us", holds="[0-9]{3}-|[0-9]{9}"),
    _r("US_BANK_NUMBER", r"[0-9]{8,17}", 0.05, "check account acct bank save debit", lang="en", country="us"),
    _r("US_DRIVER_LICENSE", r"[A-Z][0-9]{6,8}", 0.3, "driver license permit dl", lang="en", country="us"),
    _r("US_ITIN", r"9[0-9]{2}[ -]?(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])[ -]?[0-9]{4}", 0.5, "itin taxpayer tax", lang="en", country="us"),
    _r("US_PASSPORT", r"[0-9A-Z][0-9]{8}", 0.05, "passport us united states travel", lang="en", country="us"),
    _r("UK_NHS", r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}", 0.5, "nhs health", c.nhs, "en", "uk"),
    _r("US_NPI", r"[12][0-9]{9}", 0.1, "npi provider", c.npi, "en", "us", False),
    _r("US_MBI", r"[1-9][AC-HJ-NP-RT-Y][0-9AC-HJ-NP-RT-Y][0-9]-?[AC-HJ-NP-RT-Y][0-9AC-HJ-NP-RT-Y][0-9]-?[AC-HJ-NP-RT-Y]{2}[0-9]{2}", 0.5, "medicare mbi beneficiary", None, "en", "us", False),
    _r("ABA_ROUTING_NUMBER", r"[0123678][0-9]{8}", 0.05, "aba routing bank", c.aba, "en", "us", False),
    _r("UK_NINO", r"(?!BG|GB|NK|KN|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]", 0.5, "national insurance nino", None, "en", "uk", False),
    _r("UK_POSTCODE", r"[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}", 0.1, "postcode address", None, "en", "uk", False),
    _r("SG_NRIC_FIN", r"[STFGM][0-9]{7}[A-Z]", 0.5, "fin nric", None, "en", "sg", False),
    _r("AU_ABN", r"[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}", 0.1, "abn business", c.abn, "en", "au", False),
    _r("AU_ACN", r"[0-9]{3} ?[0-9]{3} ?[0-9]{3}", 0.1, "acn company", c.acn, "en", "au", False),
    _r("AU_TFN", r"[0-9]{3} ?[0-9]{3} ?[0-9]{3}", 0.1, "tfn tax file", c.tfn, "en", "au", False),
    _r("AU_MEDICARE", r"[2-6][0-9]{3} ?[0-9]{5} ?[0-9]", 0.1, "medicare", c.medicare, "en", "au", False),
    _r("NG_NIN", r"[0-9]{11}", 0.1, "nin identity", c.nin_ng, "en", "ng", False),
    _r("IN_AADHAAR", r"[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0.1, "aadhaar uidai", c.aadhaar, "en", "in", False),
    _r("IN_PAN", r"[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", 0.5, "pan permanent account", None, "en", "in", False),
    _r("IN_GSTIN", rf"(?:{'|'.join(c.GST_STATES)})[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]", 0.5, "gstin gst", c.gstin, "en", "in", False),
    _r("IN_VOTER", r"[A-Z]{3}[0-9]{7}", 0.3, "voter epic", None, "", "in", False),
    _r("IN_PASSPORT", r"[A-PR-WY][1-9][0-9] ?[0-9]{4}[1-9]", 0.1, "passport", None, "en", "in", False),
    _r("ZA_ID_NUMBER", r"[0-9]{13}", 0.1, "identity id", n.id_za, "en", "za", False),
    _r("ZA_PASSPORT", r"[ADMT][0-9]{8}", 0.3, "passport", n.passport_za, "en", "za", False),
    _r("PH_UMID", r"[0-9]{4}-[0-9]{7}-[0-9]", 0.3, "umid crn", None, "en", "ph", False),
    _r("CA_SIN", r"[1-79][0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{3}", 0.1, "sin social insurance", c.sin_ca, "en fr", "ca", False),
    _r("CA_POSTAL_CODE", r"[ABCEGHJ-NPRSTVXY][0-9][ABCEGHJ-NPRSTV-Z][ -]?[0-9][ABCEGHJ-NPRSTV-Z][0-9]", 0.3, "postal", None, "en fr", "ca", False),
    # other languages
    _r("ES_NIF", r"[0-9]{7,8}-?[A-Z]", 0.5, "nif dni documento", c.nif, "es", "es"),
    _r("ES_NIE", r"[XYZ]-?[0-9]{7}-?[A-Z]", 0.5, "nie extranjero", c.nie, "es", "es"),
    _r("ES_PASSPORT", r"[A-Z]{3}[0-9]{6}", 0.1, "pasaporte", None, "es", "es", False),
    _r("IT_FISCAL_CODE", r"[A-Z]{6}[0-9LMNP-V]{2}[ABCDEHLMPRST][0-9LMNP-V]{2}[A-Z][0-9LMNP-V]{3}[A-Z]", 0.3, "codice fiscale cf", n.fiscal_it, "it", "it"),
    _r("IT_VAT_CODE", r"(?:IT)?[0-9]{11}", 0.1, "piva partita iva", lambda t: c.vat_it(c.F.regexp_replace(t, "^IT", "")), "it", "it"),
    _r("IT_DRIVER_LICENSE", r"(?:[A-Z]{2}[0-9]{7}[A-Z]|U1[A-Z0-9]{8})", 0.2, "patente guida", None, "it", "it"),
    _r("IT_IDENTITY_CARD", r"(?:[A-Z]{2} ?[0-9]{7}|[0-9]{7}[A-Z]{2}|[A-Z]{2}[0-9]{5}[A-Z]{2})", 0.1, "carta identita cie", None, "it", "it"),
    _r("IT_PASSPORT", r"[A-Z]{2}[0-9]{7}", 0.1, "passaporto", None, "it", "it"),
    _r("PL_PESEL", r"[0-9]{11}", 0.4, "pesel", c.pesel, "pl", "pl"),
    _r("SE_ORGANISATIONSNUMMER", r"[0-9]{6}-?[0-9]{4}", 0.1, "organisationsnummer", c.orgnr_se, "sv", "se", False),
    _r("TH_TNIN", r"[1-9][0-9]{12}", 0.3, "thai id", c.tnin_th, "th", "th", False),
    _r("TR_NATIONAL_ID", r"[1-9][0-9]{10}", 0.3, "tckn kimlik", c.id_tr, "tr", "tr", False),
    _r("FI_PERSONAL_IDENTITY_CODE", r"[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Y]", 0.5, "hetu", c.hetu_fi, "fi", "fi", False),
    _r("DE_TAX_ID", r"[1-9][0-9]{10}", 0.3, "steuer idnr", c.tax_de, "de", "de", False),
    _r("DE_LANR", r"[0-9]{9}", 0.1, "lanr arztnummer", c.lanr_de, "de", "de", False),
    _r("DE_PLZ", r"[0-9]{5}", 0.05, "plz postleitzahl", None, "de", "de", False),
    _r("DE_VAT_ID", r"DE[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}", 0.5, "ust umsatzsteuer", n.vat_de, "de", "de", False),
    _r("DE_PASSPORT", r"[CFGHJ-NPRTV-Z0-9]{8}[0-9]", 0.1, "reisepass pass", n.passport_de, "de", "de", False),
    _r("DE_ID_CARD", r"(?:[LMNPRTVWXYC-K][0-9A-Z]{7}[0-9]|T[0-9]{8})", 0.1, "personalausweis ausweis", n.id_card_de, "de", "de", False),
    _r("DE_SOCIAL_SECURITY", r"[0-9]{8}[A-Z][0-9]{3}", 0.3, "rentenversicherung sozialversicherung", n.social_de, "de", "de", False),
    _r("DE_HEALTH_INSURANCE", r"[A-Z][0-9]{9}", 0.3, "krankenkasse versicherung kvnr", n.health_de, "de", "de", False),
    _r("DE_BSNR", r"[0-9]{9}", 0.1, "bsnr praxis betriebsnummer", n.bsnr_de, "de", "de", False),
    _r("DE_TAX_NUMBER", r"[0-9]{2,3}/[0-9]{3}/[0-9]{4,5}", 0.3, "steuernummer finanzamt", None, "de", "de", False),
    _r("DE_KFZ", r"[A-ZÄÖÜ]{1,3}-[A-Z]{1,2} ?[0-9]{1,4}[EH]?", 0.3, "kennzeichen", None, "de", "de", False),
    _r("DE_HANDELSREGISTER", r"HR[AB] ?[0-9]{1,6}(?: ?[A-Z])?", 0.5, "handelsregister amtsgericht", None, "de", "de", False),
    _r("DE_FUEHRERSCHEIN", r"[A-Z0-9][0-9]{2}[A-Z0-9]{6}[0-9][A-Z0-9]", 0.1, "führerschein fahrerlaubnis", None, "de", "de", False),
    _r("ZA_COMPANY_REGISTRATION", r"(?:[0-9]{4}/[0-9]{6}/[0-9]{2}|(?:CK|K|B|M)[0-9]{4}/[0-9]{6})", 0.4, "company registration", n.company_za, "en", "za", False),
    _r("ZA_DRIVER_LICENSE", r"[0-9]{6,10}[0-9A-Z]{2,5}", 0.1, "driver licence license", n.licence_za, "en", "za", False),
    _r("ZA_INCOME_TAX_NUMBER", r"[01239][0-9]{9}", 0.1, "tax income sars", lambda t: c.F.when(~n.tax_za(t), False), "en", "za", False),
    _r("ZA_VAT_NUMBER", r"4[0-9]{9}", 0.1, "vat", lambda t: c.F.when(~n.vat_za(t), False), "en", "za", False),
    _r("ZA_LICENSE_PLATE", rf"[0-9A-Z]{{2,7}} ?(?:{'|'.join(n.PROVINCES_ZA.split())})", 0.2, "plate vehicle registration", lambda t: c.F.when(~n.plate_za(t), False), "en", "za", False),
    _r("ZA_TRAFFIC_REGISTER_NUMBER", r"[0-9]{13}", 0.1, "traffic register", lambda t: c.F.when(~n.traffic_za(t), False), "en", "za", False),
    Recognizer("ZA_MOBILE_NUMBER", ((phones.CANDIDATE, 0.4),), ("mobile", "cell"), None, ("en",), "za", False, holds=phones.HOLDS, find=lambda t: phones.find(t, ("ZA",), "mobile")),
    Recognizer("ZA_TELEPHONE_NUMBER", ((phones.CANDIDATE, 0.4),), ("telephone", "phone"), None, ("en",), "za", False, holds=phones.HOLDS, find=lambda t: phones.find(t, ("ZA",), "fixed")),
    _r("KR_BRN", r"[0-9]{3}-?[0-9]{2}-?[0-9]{5}", 0.1, "사업자등록번호 business", n.brn_kr, "ko kr", "kr", False),
    _r("KR_RRN", r"[0-9]{6}-?[1-4][0-9]{6}", 0.3, "주민등록번호 resident", n.rrn_kr, "ko kr", "kr", False),
    _r("KR_FRN", r"[0-9]{6}-?[5-8][0-9]{6}", 0.3, "외국인등록번호 foreigner", n.frn_kr, "ko kr", "kr", False),
    _r("KR_DRIVER_LICENSE", r"[0-9]{2}-?[0-9]{2}-?[0-9]{6}-?[0-9]{2}", 0.1, "운전면허 licence", n.licence_kr, "ko kr", "kr", False),
    _r("KR_PASSPORT", r"[MSROD][0-9]{3}[0-9A-Z][0-9]{4}", 0.1, "여권 passport", None, "ko kr", "kr", False),
    _r("SE_PERSONNUMMER", r"(?:[0-9]{2})?[0-9]{6}[-+]?[0-9]{4}", 0.2, "personnummer", n.person_se, "sv", "se", False),
    _r("SG_UEN", r"(?:[0-9]{8,9}[A-Z]|[TSR][0-9]{2}[A-Z]{2}[0-9]{4}[0-9A-Z])", 0.3, "uen entity", n.uen_sg, "en", "sg", False),
    _r("UK_DRIVING_LICENCE", r"[A-Z9]{5}[0-9]{6}[A-Z9]{2}[0-9A-Z][A-Z]{2}", 0.5, "driving licence dvla", n.licence_uk, "en", "uk", False),
    _r("UK_PASSPORT", r"[0-9]{9}", 0.05, "passport", None, "en", "uk", False),
    _r("UK_VEHICLE_REGISTRATION", r"(?:[A-Z]{2}[0-9]{2} ?[A-Z]{3}|[A-Z][0-9]{1,3} ?[A-Z]{3})", 0.2, "registration vehicle plate", n.plate_uk, "en", "uk", False),
    _r("NG_VEHICLE_REGISTRATION", r"[A-Z]{3}-?[0-9]{3}-?[A-Z]{2}", 0.3, "plate vehicle", None, "en", "ng", False),
    _r("IN_VEHICLE_REGISTRATION", r"[A-Z]{2}[ -]?[0-9]{2}[ -]?[A-Z]{0,3}[ -]?[0-9]{1,4}", 0.2, "vehicle rto registration", n.plate_in, "en", "in", False),
    _r("TR_LICENSE_PLATE", r"[0-9]{2} ?[A-Z]{1,3} ?[0-9]{2,4}", 0.3, "plaka", n.plate_tr, "tr", "tr", False),
    _r("PH_TIN", r"[0-9]{3}-?[0-9]{3}-?[0-9]{3}(?:-?[0-9]{3})?", 0.1, "tin tax", n.tin_ph, "en", "ph", False),
    _r("PH_PASSPORT", r"[A-Z][0-9]{7}[A-Z]", 0.1, "passport", None, "en", "ph", False),
)


def deny_list(entity: str, terms: list[str], score: float = 1.0) -> Recognizer:
    """Recognizer of fixed terms between characters that are not word characters: letters, marks, digits and other numbers, underscore."""
    import re

    word = r"[\p{L}\p{M}\p{N}_]"
    pattern = rf"(?<!{word})(?:{'|'.join(map(re.escape, terms))})(?!{word})"
    return Recognizer(entity, ((pattern, score),), holds=pattern)


def select(language: str = "en", entities: list[str] | None = None, extra: tuple[Recognizer, ...] = (), countries: list[str] | None = None, only_default: bool = True) -> list[Recognizer]:
    """Recognizers of a language, before anything is scanned. Entities that are asked for are taken whether or not they are on by default."""
    pool = [r for r in (*CATALOG, *extra) if not r.languages or language in r.languages]
    pool = [r for r in pool if countries is None or r.country in (None, *countries)]
    found = [r for r in pool if (r.entity in entities if entities else r.default or not only_default)]
    if not found:
        raise ValueError(f"no recognizer for language {language!r} and entities {entities}")
    return found


def from_config(config: dict) -> tuple[Recognizer, ...]:
    """Recognizers of a parsed JSON or YAML configuration: ``recognizers`` with name, supported_entity, patterns or deny_list, context, supported_language."""
    out = []
    for r in config.get("recognizers", []):
        if not isinstance(r, dict) or not (r.get("patterns") or r.get("deny_list")) or r.get("enabled") is False:
            continue
        entity = r.get("supported_entity") or (r.get("supported_entities") or [None])[0]
        if not entity:
            raise ValueError(f"recognizer {r.get('name')!r} has no entity")
        made = deny_list(entity, r["deny_list"], r.get("deny_list_score", 1.0)).patterns if r.get("deny_list") else ()
        made += tuple((p["regex"], float(p["score"])) for p in r.get("patterns") or [])
        lang = r.get("supported_language") or ""
        out.append(Recognizer(entity, made, tuple(r.get("context") or ()), None, (lang,) if lang else (), name=r.get("name") or ""))
    return tuple(out)
