"""Texts with known answers, one row each, for queries whose SQL states the answer."""

from __future__ import annotations

from ..functions import checksums as c
from ..functions import national as n

# (validator, texts that are valid, texts that are invalid, texts it cannot tell). Specimens and published examples.
VALIDATORS = {
    "DE_BSNR": (n.bsnr_de, "", "000000000 02123456 02123456A", "021234568 521234567"),
    "DE_HEALTH_INSURANCE": (n.health_de, "A000500015 M123456785 a123456780", "A123456787 1123456780 A12345678", ""),
    "DE_ID_CARD": (n.id_card_de, "L01X00T44 G00000002 l01x00t44", "L01X00T47 L01X00T4 L01X00T4A", "T22000129"),
    "DE_PASSPORT": (n.passport_de, "C01X00T41 F12345671 c01234565", "C01234567 A01234567 C0123456A", ""),
    "DE_SOCIAL_SECURITY": (n.social_de, "15070649C103 65070803A019", "15070649C100 150706491103 15071349C103 15420649C103", ""),
    "DE_TAX_ID": (c.tax_de, "12345678903 98765432106", "12345678901 02345678903 11112345678 abcdefghijk", ""),
    "DE_VAT_ID": (n.vat_de, "DE136695976 DE-136-695-976 de136695976", "DE12345678 AT123456789 DEabcdefghi", "DE123456789"),
    "DE_LANR": (c.lanr_de, "123456601 555555501", "123456901 12345660a 12345660", ""),
    "PL_PESEL": (c.pesel, "44051401458 02070803628", "44051401459 44-051401458 4405140145A", ""),
    "IN_GSTIN": (c.gstin, "27ABCDE1234F1Z5 37ABCDE1234F1Z5", "00ABCDE1234F1Z5 38ABCDE1234F1Z5 27ABCDE1234F1Y5", ""),
    "IN_AADHAAR": (c.aadhaar, "312345678909 400123456787", "123456789012 31234567890", ""),
    "IN_VEHICLE_REGISTRATION": (n.plate_in, "MH12AB1234 22CD12", "", "ZZ12AB1234 MH00AB1234"),
    "ZA_COMPANY_REGISTRATION": (n.company_za, "2009/199240/23 CK2001/123456", "99/199240/23 AB2001/123456 1700/199240/23", ""),
    "ZA_DRIVER_LICENSE": (n.licence_za, "60390002CGBV 4024048D4P60", "8001015009087 60390002", ""),
    "ZA_ID_NUMBER": (n.id_za, "8001015009087 0002294321191", "8001015009086 9902294321191 80010150090A7", ""),
    "ZA_INCOME_TAX_NUMBER": (n.tax_za, "0123456789 9123456789", "4020269678 012345678", ""),
    "ZA_VAT_NUMBER": (n.vat_za, "4020269678", "3020269678 402026967", ""),
    "ZA_LICENSE_PLATE": (n.plate_za, "KD93GKGP GET103WP 015SBZEC", "YES 1234GP", ""),
    "ZA_PASSPORT": (n.passport_za, "A34855903 T11223344", "B12345678 A1234567", ""),
    "ZA_TRAFFIC_REGISTER_NUMBER": (n.traffic_za, "1234567890123", "8001015009087 123456789012", ""),
    "KR_BRN": (n.brn_kr, "123-45-67891 120-81-47521", "1234567890 123", ""),
    "KR_RRN": (n.rrn_kr, "900101-1234568", "900101", "900101-1234567 900101-1994567"),
    "KR_DRIVER_LICENSE": (n.licence_kr, "11-17-123456-62", "99-17-123456-62 11-17", ""),
    "SE_PERSONNUMMER": (n.person_se, "811228-9874 19811228-9874", "811328-9874 811228-9873", ""),
    "SE_ORGANISATIONSNUMMER": (c.orgnr_se, "556036-0793", "556036-0794 551036-0793", ""),
    "SG_UEN": (n.uen_sg, "53125226D 201434292D", "53125226A 201434292A T08", ""),
    "UK_DRIVING_LICENCE": (n.licence_uk, "", "MORG1657054SM9IJ MORGA913054SM9IJ", "MORGA657054SM9IJ"),
    "UK_VEHICLE_REGISTRATION": (n.plate_uk, "", "AB30CDE AB01CDE", "AB12CDE A123BCD"),
    "TR_LICENSE_PLATE": (n.plate_tr, "34ABC123 81AB123", "82ABC123 00ABC12", "ABC"),
    "TR_NATIONAL_ID": (c.id_tr, "10000000146", "10000000147 0000000146", ""),
    "TH_TNIN": (c.tnin_th, "1101700230708", "1101700230709 110170023070", ""),
    "FI_PERSONAL_IDENTITY_CODE": (c.hetu_fi, "131052-308T", "131052-308U 321052-308T", ""),
    "IT_FISCAL_CODE": (n.fiscal_it, "RSSMRA85T10A562S", "", "RSSMRA85T10A562T RSSMRA85"),
    "IT_VAT_CODE": (c.vat_it, "00743110157", "00743110158 00000000000", ""),
    "ES_NIF": (c.nif, "12345678Z 12345678-Z", "12345678A X", ""),
    "ES_NIE": (c.nie, "X1234567L", "X1234567A A1234567L", ""),
    "UK_NHS": (c.nhs, "9434765919 943-476-5919", "9434765918 943476591", ""),
    "US_NPI": (c.npi, "1234567893", "1234567890 1111111111", ""),
    "ABA_ROUTING": (c.aba, "021000021", "021000022 02100002", ""),
    "AU_ABN": (c.abn, "51824753556", "51824753557 5182475355", ""),
    "AU_ACN": (c.acn, "004085616", "004085617", ""),
    "AU_TFN": (c.tfn, "876543210", "876543211", ""),
    "AU_MEDICARE": (c.medicare, "2123456701", "2123456711 212345", ""),
    "MEDICAL_LICENSE": (c.dea, "AB1234563", "AB1234564 AB12345", ""),
    "CREDIT_CARD": (c.card, "4111111111111111 378282246310005", "4111111111111112 411111111111111a", ""),
    "IBAN_CODE": (c.mod97, "GB82WEST12345698765432 DE89370400440532013000", "GB82WEST12345698765431 GB82", ""),
    "IP_ADDRESS": (c.ip, "192.168.0.1 ::1 fe80::1%eth0 2001:db8::/32", "256.1.1.1 1:2:3 1::2::3 12345::1", ""),
    "MAC_ADDRESS": (c.mac, "00:1A:2B:3C:4D:5E", "FF:FF:FF:FF:FF:FF 00:1A:2B:3C:4D", ""),
    "UUID": (c.uuid, "f47ac10b-58cc-4372-a567-0e02b2c3d479", "00000000-0000-0000-0000-000000000000 f47ac10b-58cc-9372-a567-0e02b2c3d479", ""),
    "EMAIL_ADDRESS": (c.email, "a@b.co a@mail.example.co.uk", "a@localhost a@co.uk a@b.c1", ""),
    "CA_SIN": (c.sin_ca, "", "046454287", "046454286"),
}


def verdicts() -> list[tuple[str, str, str]]:
    """(entity, text, verdict) of every specimen."""
    return [(k, t, v) for k, (_, *lists) in VALIDATORS.items() for v, texts in zip(("valid", "invalid", "unknown"), lists, strict=True) for t in texts.split()]


# (entity, language, text with the finding in brackets). Texts of entities that need more than a pattern hold specimens from above.
FINDINGS = [
    ("CREDIT_CARD", "en", "pay by [4111 1111 1111 1111] now"), ("EMAIL_ADDRESS", "en", "to [a.b@mail.example.org]."), ("IP_ADDRESS", "en", "host [10.0.0.255] up"), ("IP_ADDRESS", "de", "at [2001:db8::1] up"),
    ("URL", "en", "see [https://example.org/a?b=c] ok"), ("PHONE_NUMBER", "en", "call [(212) 555-0143] or not"), ("PHONE_NUMBER", "en", "call [+44 20 7946 0958] or not"), ("PHONE_NUMBER", "de", "Tel. [030 12345678] heute"),
    ("IBAN_CODE", "en", "iban [GB82 WEST 1234 5698 7654 32] x"), ("DATE_TIME", "en", "on [2024-02-29] it"), ("MAC_ADDRESS", "en", "at [00:1A:2B:3C:4D:5E] x"), ("UUID", "en", "id [f47ac10b-58cc-4372-a567-0e02b2c3d479] x"),
    ("CRYPTO", "en", "to [1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa] x"), ("MEDICAL_LICENSE", "en", "dea [AB1234563] x"), ("US_SSN", "en", "ssn [219-09-9999] x"), ("US_BANK_NUMBER", "en", "account [945456787654] x"),
    ("US_DRIVER_LICENSE", "en", "license [H1234567] x"), ("US_ITIN", "en", "itin [911-70-1234] x"), ("US_PASSPORT", "en", "passport [912803456] x"), ("US_MBI", "en", "mbi [1EG4-TE5-MK73] x"), ("US_NPI", "en", "npi [1234567893] x"),
    ("UK_NHS", "en", "nhs [943 476 5919] x"), ("UK_DRIVING_LICENCE", "en", "licence [MORGA657054SM9IJ] x"), ("UK_NINO", "en", "nino [AB 12 34 56 C] x"), ("UK_PASSPORT", "en", "passport [123456789] x"), ("UK_POSTCODE", "en", "at [SW1A 1AA] x"),
    ("UK_VEHICLE_REGISTRATION", "en", "plate [AB12 CDE] x"), ("SG_NRIC_FIN", "en", "fin [S1234567D] x"), ("SG_UEN", "en", "uen [53125226D] x"), ("AU_ABN", "en", "abn [51 824 753 556] x"), ("AU_ACN", "en", "acn [004 085 616] x"),
    ("AU_TFN", "en", "tfn [876 543 210] x"), ("AU_MEDICARE", "en", "medicare [2123 45670 1] x"), ("NG_VEHICLE_REGISTRATION", "en", "plate [ABC-123DE] x"), ("IN_PAN", "en", "pan [ABCPE1234F] x"), ("IN_AADHAAR", "en", "no [3123 4567 8909] x"),
    ("IN_GSTIN", "en", "gst [27ABCDE1234F1Z5] x"), ("IN_VOTER", "en", "epic [ABC1234567] x"), ("IN_PASSPORT", "en", "passport [A1234567] x"), ("IN_VEHICLE_REGISTRATION", "en", "rto [MH12AB1234] x"),
    ("ZA_ID_NUMBER", "en", "id [8001015009087] x"), ("ZA_PASSPORT", "en", "passport [A34855903] x"), ("ZA_COMPANY_REGISTRATION", "en", "company [2009/199240/23] x"), ("ZA_DRIVER_LICENSE", "en", "licence [60390002CGBV] x"),
    ("ZA_INCOME_TAX_NUMBER", "en", "tax [0123456789] x"), ("ZA_VAT_NUMBER", "en", "vat [4020269678] x"), ("ZA_LICENSE_PLATE", "en", "plate [KD93GKGP] x"), ("ZA_TRAFFIC_REGISTER_NUMBER", "en", "traffic [1234567890123] x"),
    ("ZA_MOBILE_NUMBER", "en", "cell [082 123 4567] x"), ("ZA_TELEPHONE_NUMBER", "en", "phone [011 123 4567] x"), ("PH_UMID", "en", "crn [1234-1234567-1] x"), ("PH_TIN", "en", "tin [123-456-782] x"), ("PH_PASSPORT", "en", "passport [P1234567A] x"),
    ("CA_SIN", "en", "sin [130 692 544] x"), ("CA_POSTAL_CODE", "en", "at [K1A 0B1] x"), ("ABA_ROUTING_NUMBER", "en", "aba [021000021] x"), ("ES_NIF", "es", "dni [12345678Z] x"), ("ES_NIE", "es", "nie [X1234567L] x"), ("ES_PASSPORT", "es", "pasaporte [ABC123456] x"),
    ("IT_FISCAL_CODE", "it", "cf [RSSMRA85T10A562S] x"), ("IT_VAT_CODE", "it", "iva [00743110157] x"), ("IT_DRIVER_LICENSE", "it", "patente [AB1234567C] x"), ("IT_IDENTITY_CARD", "it", "carta [AB1234567] x"), ("IT_PASSPORT", "it", "passaporto [AB1234567] x"),
    ("PL_PESEL", "pl", "pesel [44051401458] x"), ("SE_ORGANISATIONSNUMMER", "sv", "nr [556036-0793] x"), ("SE_PERSONNUMMER", "sv", "nr [811228-9874] x"), ("TH_TNIN", "th", "id [1101700230708] x"), ("TR_NATIONAL_ID", "tr", "kimlik [10000000146] x"),
    ("TR_LICENSE_PLATE", "tr", "plaka [34 ABC 123] x"), ("FI_PERSONAL_IDENTITY_CODE", "fi", "hetu [131052-308T] x"), ("KR_BRN", "ko", "no [123-45-67891] x"), ("KR_RRN", "ko", "no [900101-1234568] x"), ("KR_FRN", "ko", "no [900101-5234567] x"),
    ("KR_DRIVER_LICENSE", "ko", "no [11-17-123456-62] x"), ("KR_PASSPORT", "ko", "no [M123A4567] x"), ("DE_TAX_ID", "de", "idnr [12345678903] x"), ("DE_TAX_NUMBER", "de", "nr [181/815/08155] x"), ("DE_PASSPORT", "de", "pass [C01X00T41] x"),
    ("DE_ID_CARD", "de", "ausweis [L01X00T44] x"), ("DE_SOCIAL_SECURITY", "de", "nr [15070649C103] x"), ("DE_HEALTH_INSURANCE", "de", "kvnr [A000500015] x"), ("DE_KFZ", "de", "kennzeichen [B-MW 1234] x"), ("DE_HANDELSREGISTER", "de", "siehe [HRB 12345] x"),
    ("DE_PLZ", "de", "plz [10115] x"), ("DE_LANR", "de", "lanr [123456601] x"), ("DE_BSNR", "de", "bsnr [021234568] x"), ("DE_VAT_ID", "de", "ust [DE136695976] x"), ("DE_FUEHRERSCHEIN", "de", "nr [B072RRE2I55] x"),
    ("NG_NIN", "en", "nin [12345678902] x"),
]

# (name, text, findings (type, start, end, score), operator by type, merge over spaces, conflicts, result)
REWRITES = [
    ("replace", "My name is Bond, James Bond", [("PERSON", 11, 15, 0.8), ("PERSON", 17, 27, 0.8)], {}, True, "merge_similar_or_contained", "My name is <PERSON>, <PERSON>"),
    ("redact", "My name is Bond, James Bond", [("PERSON", 11, 15, 0.8), ("PERSON", 17, 27, 0.8)], {"PERSON": ("redact", {})}, True, "merge_similar_or_contained", "My name is , "),
    ("mask from start", "My name is Bond, James Bond", [("PERSON", 11, 15, 0.8), ("PERSON", 17, 27, 0.8)], {"PERSON": ("mask", {"chars": 4})}, True, "merge_similar_or_contained", "My name is ****, ****s Bond"),
    ("mask from end", "My name is Bond, James Bond", [("PERSON", 11, 15, 0.8), ("PERSON", 17, 27, 0.8)], {"PERSON": ("mask", {"chars": 2, "char": "0", "from_end": True})}, True, "merge_similar_or_contained", "My name is Bo00, James Bo00"),
    ("mask all", "My name is Bond", [("PERSON", 11, 15, 0.8)], {"PERSON": ("mask", {"char": "#"})}, True, "merge_similar_or_contained", "My name is ####"),
    ("default operator", "My name is Bond, James Bond", [("PERSON", 11, 15, 0.8), ("LOCATION", 17, 27, 0.8)], {"DEFAULT": ("redact", {}), "LOCATION": ("replace", {"new_value": "LOC"})}, True, "merge_similar_or_contained", "My name is , LOC"),
    ("contained", "Hello Mr. John Smith of Acme", [("FULL_NAME", 10, 20, 0.6), ("FIRST_NAME", 10, 14, 0.9), ("LAST_NAME", 15, 20, 0.6)], {}, True, "merge_similar_or_contained", "Hello Mr. <FULL_NAME> of Acme"),
    ("equal places", "Hello Mr. John Smith", [("A", 10, 20, 0.4), ("B", 10, 20, 0.9)], {}, True, "merge_similar_or_contained", "Hello Mr. <B>"),
    ("overlap of types", "Hello Mr. John Smith of Acme", [("A", 10, 16, 0.5), ("B", 14, 20, 0.5)], {}, True, "merge_similar_or_contained", "Hello Mr. <A><B> of Acme"),
    ("no intersections, first better", "abcdefghij", [("A", 0, 6, 0.9), ("B", 4, 9, 0.5)], {"DEFAULT": ("mask", {})}, True, "remove_intersections", "*********j"),
    ("no intersections, second better", "abcdefghij", [("A", 0, 6, 0.4), ("B", 4, 9, 0.5)], {"A": ("keep", {})}, True, "remove_intersections", "abcd<B>j"),
    ("no intersections, first kept", "abcdefghij", [("A", 0, 6, 0.9), ("B", 4, 9, 0.5)], {"A": ("keep", {})}, True, "remove_intersections", "abcdef<B>j"),
    ("over spaces", "John   Smith lives", [("PERSON", 0, 4, 0.8), ("PERSON", 7, 12, 0.8)], {}, True, "merge_similar_or_contained", "<PERSON> lives"),
    ("not over spaces", "John Smith lives", [("PERSON", 0, 4, 0.8), ("PERSON", 5, 10, 0.8)], {}, False, "merge_similar_or_contained", "<PERSON> <PERSON> lives"),
    ("zero length", "hello world", [("X", 5, 5, 0.5)], {}, True, "merge_similar_or_contained", "hello<X> world"),
    ("astral", "😈 Bond is here", [("PERSON", 2, 6, 0.8)], {}, True, "merge_similar_or_contained", "😈 <PERSON> is here"),
    ("none", "nothing to do here", [], {}, True, "merge_similar_or_contained", "nothing to do here"),
]
