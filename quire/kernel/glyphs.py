"""Glyph names and base encodings, built by rule where a rule exists."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Names of signs, in the order of SIGNS.
SIGN_NAMES = """space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus
comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at
bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde
exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot registered
macron degree plusminus acute mu paragraph periodcentered cedilla ordmasculine guillemotright onequarter onehalf threequarters
questiondown multiply divide nbspace AE ae OE oe Oslash oslash Lslash lslash Eth eth Thorn thorn germandbls dotlessi
quoteleft quoteright quotesinglbase quotedblleft quotedblright quotedblbase dagger daggerdbl bullet ellipsis perthousand
guilsinglleft guilsinglright fraction Euro euro trademark minus endash emdash florin fi fl ff ffi ffl
circumflex caron breve dotaccent ring ogonek tilde hungarumlaut
element infinity integral intersection union lessequal greaterequal notequal product summation radical imaginaryunit
parenleftinferior parenrightinferior partialdiff approxequal lozenge Delta Omega pi""".split()
SIGNS = (
    " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿×÷\xa0ÆæŒœØøŁłÐðÞþßı"
    "‘’‚“”„†‡•…‰‹›⁄€€™−–—ƒﬁﬂﬀﬃﬄˆˇ˘˙˚˛˜˝∈∞∫∩∪≤≥≠∏∑√ⅈ₍₎∂≈◊∆Ωπ"
)
#: Further names of signs, in the order of MORE_SIGNS.
MORE_NAMES = """arrowleft arrowup arrowright arrowdown arrowboth arrowupdn arrowupdnbse carriagereturn arrowdblleft arrowdblup
arrowdblright arrowdbldown arrowdblboth universal existential emptyset gradient notelement suchthat minusmath asteriskmath
proportional orthogonal angle logicaland logicalor therefore similar congruent equivalence propersubset propersuperset
notsubset reflexsubset reflexsuperset circleplus circlemultiply perpendicular dotmath integraltp integralbt angleleft angleright
aleph Ifraktur Rfraktur weierstrass estimated minute second exclamdbl overline underscoredbl quotereversed
colonmonetary franc lira peseta dong afii61352 onethird twothirds oneeighth threeeighths fiveeighths seveneighths
upblock dnblock block lfblock rtblock ltshade shade dkshade filledbox triagup triagrt triagdn triaglf circle invbullet invcircle
openbullet smileface invsmileface sun female male spade club heart diamond musicalnote musicalnotedbl
Dcroat dcroat Hbar hbar Tbar tbar Eng eng IJ ij kgreenlandic longs napostrophe Ldot ldot
sigma1 theta1 Upsilon1 phi1 omega1 Deltagreek Omegagreek mugreek anoteleia dieresistonos tonos""".split()
MORE_SIGNS = (
    "←↑→↓↔↕↨↵⇐⇑⇒⇓⇔∀∃∅∇∉∋−∗∝∟∠∧∨∴∼≅≡⊂⊃⊄⊆⊇⊕⊗⊥⋅⌠⌡〈〉ℵℑℜ℘℮′″‼‾‗‛₡₣₤₧₫№⅓⅔⅛⅜⅝⅞▀▄█▌▐░▒▓■▲►▼◄○◘◙◦☺☻☼♀♂♠♣♥♦♪♫"
    "ĐđĦħŦŧŊŋĲĳĸſŉĿŀςϑϒϕϖΔΩμ·΅΄"
)
#: Runs of characters whose names count up, as prefix, first number and characters.
NUMBERED = (
    ("afii", 10017, "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯҐЂЃЄЅІЇЈЉЊЋЌЎ"), ("afii", 10065, "абвгдеёжзийклмнопрстуфхцчшщъыьэюяґђѓєѕіїјљњћќў"),
    ("afii", 10145, "Џ"), ("afii", 10193, "џ"), ("afii", 57664, "אבגדהוזחטיךכלםמןנסעףפץצקרשת"),
    ("afii", 57392, "٠١٢٣٤٥٦٧٨٩"), ("afii", 57409, "ءآأؤإئابةتثجحخدذرزسشصضطظعغ"), ("afii", 57440, "ـفقكلمنهوىي"),
)
DIGITS = "zero one two three four five six seven eight nine".split()
#: Scripts whose letters are named after their Unicode names, with the end of the glyph name.
SCRIPTS = {"CYRILLIC": "cyrillic", "HEBREW": "hebrew", "ARABIC": "arabic", "ARMENIAN": "armenian", "HIRAGANA": "hiragana", "KATAKANA": "katakana", "BOPOMOFO": "bopomofo", "DEVANAGARI": "deva", "BENGALI": "bengali", "GUJARATI": "gujarati", "GURMUKHI": "gurmukhi"}
#: Accents as combining characters.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨",
           "dotaccent": "\u0307", "hungarumlaut": "\u030b", "horn": "\u031b", "dotbelow": "\u0323", "hookabove": "\u0309", "commaaccent": "\u0327"}
#: StandardEncoding where it differs from ASCII, as code: character.
STANDARD_SIGNS = {0x27: "’", 0x60: "‘", 0xAE: "ﬁ", 0xAF: "ﬂ", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
STANDARD_RUNS = {0xA1: "¡¢£⁄¥ƒ§¤'“«‹›", 0xB1: "–†‡·", 0xB6: "¶•‚„”»…‰", 0xBF: "¿", 0xC1: "`´ˆ˜¯˘˙¨", 0xCA: "˚¸", 0xCD: "˝˛ˇ—"}
#: Adobe's Symbol encoding as runs of characters from a code.
SYMBOL_RUNS = {
    0x20: " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_",
    0x61: "αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼",
    0xA0: "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…",
    0xBF: "↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑",
    0xF1: "〉∫⌠",
}


@lru_cache(1)
def names() -> dict[str, str]:
    out = dict(zip(SIGN_NAMES, SIGNS, strict=True))
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        out[c] = c
        for name, mark in ACCENTS.items():
            composed = unicodedata.normalize("NFC", c + mark)
            if len(composed) == 1:
                out[c + name] = composed
    for c in "SsTt":
        out[c + "commaaccent"] = unicodedata.normalize("NFC", c + "\u0326")
    out |= dict(zip(MORE_NAMES, MORE_SIGNS, strict=True))
    for front, first, run in NUMBERED:
        out |= {f"{front}{first + i}": c for i, c in enumerate(run)}
    for i, d in enumerate(DIGITS):
        out[d + "superior"] = "⁰¹²³⁴⁵⁶⁷⁸⁹"[i]
        out[d + "inferior"] = chr(0x2080 + i)
    for c in map(chr, range(0x370, 0x3200)):
        for name in letter_names(c):
            out.setdefault(name, c)
    for c in map(chr, range(0x21, 0x7F)):
        plain = next((n for n, x in out.items() if x == c), None)
        if plain:
            out.setdefault(plain + "monospace", chr(ord(c) + 0xFEE0))
    return out


def letter_names(c: str) -> list[str]:
    """Glyph names of a letter that follow from its Unicode name."""
    words = unicodedata.name(c, "").split()
    if len(words) < 3 or "LETTER" not in words:
        return []
    at = words.index("LETTER")
    script, case, rest = words[0], words[1] if at == 2 else "", words[at + 1 :]
    if script == "GREEK" and case in ("CAPITAL", "SMALL"):
        marks = [m for m in rest[1:] if m not in ("WITH", "AND")]
        if not set(marks) <= {"TONOS", "DIALYTIKA"} or not rest:
            return []
        base = "lambda" if rest[0] == "LAMDA" else rest[0].lower()
        end = "".join({"TONOS": "tonos", "DIALYTIKA": "dieresis"}[m] for m in marks)
        return [(base.capitalize() if case == "CAPITAL" else base) + end]
    if script not in SCRIPTS or "WITH" in rest:
        return []
    small = script in ("HIRAGANA", "KATAKANA") and rest[:1] == ["SMALL"]
    base = "".join(rest[1:] if small else rest).lower().replace("-", "")
    base = base.capitalize() if case == "CAPITAL" else base
    return [base + ("small" if small else "") + SCRIPTS[script]] if base else []


def scalar(text: str) -> str | None:
    try:
        n = int(text, 16)
    except ValueError:
        return None
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 and "_" not in text and text[:1] not in "+- " else None


def glyph_text(name: str) -> str | None:
    """The character of a glyph name; a ``.variant`` suffix is ignored."""
    base = name.split(".", 1)[0]
    found = names().get(base)
    if found:
        return found
    if base.startswith("uni"):
        return scalar(base[3:7]) if len(base) >= 7 else None
    if base.startswith("u") and 4 <= len(base) - 1 <= 6:
        return scalar(base[1:])
    return None


def from_codec(codec: str) -> list[str]:
    out = []
    for i in range(256):
        c = bytes([i]).decode(codec, "ignore")
        out.append(c if i >= 32 and c and not unicodedata.category(c).startswith("Cc") else "")
    return out


@lru_cache(4)
def base_encoding(name: str | None) -> list[str]:
    """Code to text; fonts without a known encoding use WinAnsi."""
    if name == "MacRomanEncoding":
        return from_codec("mac_roman")
    if name == "StandardEncoding":
        out = [chr(i) if 32 <= i < 127 else "" for i in range(256)]
        for code, c in STANDARD_SIGNS.items():
            out[code] = c
        for start, run in STANDARD_RUNS.items():
            out[start : start + len(run)] = list(run)
        return out
    return from_codec("cp1252")


@lru_cache(1)
def symbol() -> dict[int, str]:
    return {start + i: c for start, run in SYMBOL_RUNS.items() for i, c in enumerate(run)}
