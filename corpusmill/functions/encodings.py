"""Repairs of text that was read in the wrong code page: Arrow functions, since no built-in recodes text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def charmap(name: str, base: str, changes: dict[int, str]) -> None:
    """Registers an 8-bit codec: another code page with some bytes changed."""
    table = "".join(changes.get(b) or bytes([b]).decode(base, "replace") for b in range(256))
    encoding = codecs.charmap_build(table)
    info = codecs.CodecInfo(lambda t, errors="strict": codecs.charmap_encode(t, errors, encoding), lambda t, errors="strict": codecs.charmap_decode(t, errors, table), name=name)
    codecs.register(lambda n: info if n == name.replace("-", "_") else None)


# Bytes of Sámi and Mari code pages that differ from the page they extend.
MAC_SAMI = {
    0xA0: "Ý", 0xA2: "Č", 0xB0: "Đ", 0xB1: "Ŋ", 0xB2: "Ȟ", 0xB3: "ȟ", 0xB4: "Š", 0xB5: "Ŧ", 0xB7: "Ž", 0xB8: "č", 0xB9: "đ", 0xBA: "ŋ", 0xBB: "š", 0xBC: "ŧ", 0xBD: "ž", 0xDB: "¤", 0xDC: "Ð", 0xDD: "ð", 0xDE: "Þ", 0xDF: "þ", 0xE0: "ý",
    0xF6: "Ʒ", 0xF7: "ʒ", 0xF8: "Ǯ", 0xF9: "ǯ", 0xFA: "Ǥ", 0xFB: "ǥ", 0xFC: "Ǧ", 0xFD: "ǧ", 0xFE: "Ǩ", 0xFF: "ǩ",
}
WINSAMI2 = {
    0x82: "Č", 0x84: "č", 0x85: "Ʒ", 0x86: "ʒ", 0x87: "Ǯ", 0x88: "ǯ", 0x89: "Đ", 0x98: "đ", 0x99: "Ǧ", 0xA1: "ǧ", 0xA2: "Ǥ", 0xA5: "ǥ", 0xAA: "Ȟ", 0xAF: "ȟ", 0xB2: "Ǩ", 0xB3: "ǩ", 0xB8: "Ŋ", 0xB9: "ŋ", 0xBA: "Ŧ", 0xBC: "ŧ", 0xBE: "Ž", 0xBF: "ž",
}
ISO_IR_209 = {
    0x86: "¬", 0x87: "≠", 0x88: "£", 0x8A: "¿", 0x8B: "≤", 0x98: "®", 0x9A: "¡", 0x9B: "≥", 0xA1: "Č", 0xA2: "č", 0xA3: "Đ", 0xA4: "đ", 0xA5: "Ǥ", 0xA6: "ǥ", 0xA8: "Ǧ", 0xAA: "ǧ", 0xAB: "Ȟ", 0xAC: "Ǩ", 0xAE: "ǩ", 0xAF: "Ŋ", 0xB1: "ŋ",
    0xB2: "Š", 0xB3: "š", 0xB5: "Ŧ", 0xB8: "ŧ", 0xB9: "Ž", 0xBA: "ž", 0xBB: "ȟ", 0xBC: "Ʒ", 0xBD: "ʒ", 0xBE: "Ǯ", 0xBF: "ǯ",
}
ISO_IR_197 = ISO_IR_209 | {0xAB: "«", 0xBB: "»"}
# Bytes that these pages leave as control characters.
UNUSED = {b: chr(b) for b in (0x8D, 0x8E, 0x8F, 0x9D, 0x9E)}
MEADOW_MARI = {0x88: "Ҥ", 0x89: "ҥ", 0x99: "Ӱ", 0xA2: "ӱ", 0xAA: "Ӧ", 0xBA: "ӧ"}


def register() -> None:
    charmap("mac-sami", "mac_roman", MAC_SAMI)
    charmap("winsami2", "cp1252", UNUSED | WINSAMI2)
    charmap("iso-ir-197", "cp1252", UNUSED | ISO_IR_197)
    charmap("iso-ir-209", "cp1252", UNUSED | ISO_IR_209)
    charmap("meadow-mari", "cp1251", MEADOW_MARI)


# Names of guesses that a change of code page repairs: wrong page, right page, and what is put right afterwards.
_PAGES = {
    "mac-sami_to_cp1252": ("cp1252", "mac-sami", [("&#129;", "Å")]),
    "mac-sami_to_latin1": ("latin-1", "mac-sami", []),
    "mac-sami_to_mac": ("mac_roman", "mac-sami", [("&#8486;", "ž")]),
    "winsami2_to_cp1252": ("cp1252", "winsami2", []),
    "cp1251_cp1252": ("cp1252", "meadow-mari", [("&#1118;", "ӱ"), ("&#1038;", "Ӱ"), ("Ў", "Ӱ"), ("&#1108;", "ӧ"), ("&#1028;", "Ӧ")]),
}


# Names of guesses that replacements repair, in this order.
_REPLACED = {
    "mix-mac-sami-and-some-unknown-encoding": [
        ("\x87", "á"), ("_", "š"), ("ã", "č"), ("÷", "đ"), ("À", "ž"), ("ç", "Á"), ("â", "Č"), ("¼", "ŧ"), ("¿", "ø"),
    ],
    "latin4_to_cp1252": [
        ("á", "á"), ("¹", "š"), ("è", "č"), ("ð", "đ"), ("¾", "ž"), ("¿", "ŋ"), ("Á", "Á"), ("È", "Č"), ("¼", "ŧ"), ("©", "Š"), ("Ð", "Đ"),
        ("½", "Ŋ"), ("®", "Ž"), ("¬", "Ŧ"),
    ],
    "winsam_to_cp1252": [
        ("á", "á"), ("ó", "š"), ("ç", "č"), ("ð", "đ"), ("þ", "ž"), ("ñ", "ŋ"), ("Á", "Á"), ("Ç", "Č"), ("ý", "ŧ"), ("Ó", "Š"), ("Ð", "Đ"),
        ("Ñ", "Ŋ"), ("Þ", "Ž"), ("Ý", "Ŧ"),
    ],
    "iso-ir-197_to_cp1252": [
        ("á", "á"), ("³", "š"), ("¢", "č"), ("¤", "đ"), ("º", "ž"), ("±", "ŋ"), ("Á", "Á"), ("¡", "Č"), ("¸", "ŧ"), ("²", "Š"), ("£", "Đ"),
        ("¯", "Ŋ"), ("¹", "Ž"), ("µ", "Ŧ"),
    ],
    "mix-of-latin4-and-iso-ir-197_to_cp1252": [
        ("á", "á"), ("ó", "š"), ("ç", "č"), ("¤", "đ"), ("º", "ž"), ("Á", "Á"), ("Ç", "Č"), ("Ó", "Š"), ("£", "Đ"),
    ],
    "double-utf8": [
        ("Ã¡", "á"), ("Ã?", "Á"), ("Å¡", "š"), ("Â¹", "š"), ("Å\u00a0", "Š"), ("Å§", "ŧ"), ("Å‹", "ŋ"), ("ÅŠ", "Ŋ"), ("Ä‘", "đ"), ("Ã°", "đ"),
        ("Å¾", "ž"), ("Âº", "ž"), ("Å½", "Ž"), ("Ä?", "č"), ("Ã¨", "č"), ("ÄŒ", "Č"), ("Ã¦", "æ"), ("Ã¸", "ø"), ("Ã˜", "Ø"), ("Ã¥", "å"),
        ("Ã…", "Å"), ("Ã¤", "ä"), ("Ã„", "Ä"), ("Ã¶", "ö"), ("â€œ", "“"), ("â€?", "”"), ("â€“", "–"), ("Â«", "«"), ("â‰¤", "«"), ("Â»", "»"),
        ("â‰¥", "»"), ("Â´", "´"), ("â€¢", "•"),
    ],
    "finnish-lawtexts-in-pdf": [("þ", "č"), ("á", "á")],
    # the rest of the Cyrillic letters stand where code page 1251 has them
    "cyrillic_in_pdf": [
        ("¡", "ӱ"), ("¢", "ӱ"), ("ª", "Ӧ"), ("¯", "Ӹ"), ("²", "Ӓ"), ("³", "ӓ"), ("·", "Ё"), ("¸", "ё"), ("¹", "№"), ("º", "ӧ"), ("¿", "ӹ"),
        ("À", "A"), ("Á", "б"), *((chr(b), bytes([b]).decode("cp1251")) for b in range(0xC2, 0x100)),
    ],
}


def repaired(text: Column, guess: Column) -> Column:
    """Text put right as the name of its wrong decoding says; text without such a name stays as it is."""

    @F.pandas_udf("string")
    def run(s: pd.Series, names: pd.Series) -> pd.Series:
        register()

        def one(t: str | None, name: str | None) -> str | None:
            wrong, right, pairs = _PAGES.get(name, (None, None, _REPLACED.get(name, [])))
            if t is not None and wrong:
                t = t.encode(wrong, "xmlcharrefreplace").decode(right, "replace")
            for a, b in pairs if t is not None else ():
                t = t.replace(a, b)
            return t

        return pd.Series([one(t, n) for t, n in zip(s, names, strict=True)], dtype=object)

    return run(text, guess)


def recoded(text: Column, wrong: str, right: str) -> Column:
    """Text read as `wrong` although it was written as `right`; what `wrong` can't hold stays as a character reference."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        register()
        return s.map(lambda t: t.encode(wrong, "xmlcharrefreplace").decode(right, "replace"), na_action="ignore")

    return run(text)
