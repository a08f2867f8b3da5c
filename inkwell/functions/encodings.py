"""Glyph names, simple encodings and the metrics of the base fonts, built from rules wherever one exists."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Names of ASCII signs and digits, from U+0020 on where no letter stands.
ASCII_NAMES = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at".split()
BRACKET_NAMES = {"[": "bracketleft", "\\": "backslash", "]": "bracketright", "^": "asciicircum", "_": "underscore", "`": "grave", "{": "braceleft", "|": "bar", "}": "braceright", "~": "asciitilde"}
# Accents as they end glyph names, and their combining characters.
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "macron": "̄", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋", "commaaccent": "̧"}
# Names of other characters of the Latin sets.
OTHER_NAMES = """exclamdown ¡ cent ¢ sterling £ currency ¤ yen ¥ brokenbar ¦ section § dieresis ¨ copyright © ordfeminine ª guillemotleft « logicalnot ¬ registered ® macron ¯
degree ° plusminus ± twosuperior ² threesuperior ³ acute ´ mu µ paragraph ¶ periodcentered · middot · cedilla ¸ onesuperior ¹ ordmasculine º guillemotright » onequarter ¼ onehalf ½ threequarters ¾ questiondown ¿
AE Æ Oslash Ø germandbls ß ae æ eth ð Eth Ð oslash ø thorn þ Thorn Þ multiply × divide ÷ dotlessi ı Lslash Ł lslash ł OE Œ oe œ florin ƒ
circumflex ˆ caron ˇ breve ˘ dotaccent ˙ ring ˚ ogonek ˛ tilde ˜ hungarumlaut ˝ quotesinglbase ‚ quotedblbase „ quoteleft ‘ quoteright ’ quotedblleft “ quotedblright ” dagger † daggerdbl ‡ bullet • ellipsis …
perthousand ‰ guilsinglleft ‹ guilsinglright › fraction ⁄ Euro € trademark ™ endash – emdash — minus − fi ﬁ fl ﬂ infinity ∞ notequal ≠ lessequal ≤ greaterequal ≥ partialdiff ∂ summation ∑ product ∏ integral ∫ radical √ approxequal ≈ Delta ∆ Omega Ω pi π lozenge ◊""".split()


# Names of symbols, and of characters that have no rule.
SYMBOL_NAMES = """universal ∀ existential ∃ suchthat ∋ asteriskmath ∗ congruent ≅ therefore ∴ perpendicular ⊥ similar ∼ theta1 ϑ sigma1 ς phi1 ϕ omega1 ϖ Upsilon1 ϒ minute ′ second ″
proportional ∝ equivalence ≡ carriagereturn ↵ aleph ℵ Ifraktur ℑ Rfraktur ℜ weierstrass ℘ circlemultiply ⊗ circleplus ⊕ emptyset ∅ intersection ∩ union ∪ propersuperset ⊃ reflexsuperset ⊇
notsubset ⊄ propersubset ⊂ reflexsubset ⊆ element ∈ notelement ∉ angle ∠ gradient ∇ dotmath ⋅ logicaland ∧ logicalor ∨ angleleft 〈 angleright 〉 integraltp ⌠ integralbt ⌡
arrowleft ← arrowup ↑ arrowright → arrowdown ↓ arrowboth ↔ arrowupdn ↕ arrowdblleft ⇐ arrowdblup ⇑ arrowdblright ⇒ arrowdbldown ⇓ arrowdblboth ⇔ club ♣ diamond ♦ heart ♥ spade ♠
oneeighth ⅛ threeeighths ⅜ fiveeighths ⅝ seveneighths ⅞ onethird ⅓ twothirds ⅔ Dcroat Đ dcroat đ Hbar Ħ hbar ħ IJ Ĳ ij ĳ kgreenlandic ĸ Ldot Ŀ ldot ŀ napostrophe ŉ Eng Ŋ eng ŋ Tbar Ŧ tbar ŧ longs ſ
ff ﬀ ffi ﬃ ffl ﬄ peseta ₧ franc ₣ lira ₤ estimated ℮ female ♀ male ♂ sun ☼ smileface ☺ invsmileface ☻ musicalnote ♪ musicalnotedbl ♫ house ⌂ orthogonal ∟ exclamdbl ‼ underscoredbl ‗
quotereversed ‛ figuredash ‒ afii61289 ℓ afii61352 № afii00208 ― colonmonetary ₡ dong ₫ Iota Ι alphatonos ά epsilontonos έ etatonos ή iotatonos ί omicrontonos ό upsilontonos ύ omegatonos ώ
block █ dnblock ▄ upblock ▀ lfblock ▌ rtblock ▐ ltshade ░ shade ▒ dkshade ▓ filledbox ■ triagup ▲ triagdn ▼ triaglf ◄ triagrt ► circle ○ openbullet ◦ invbullet ◘ invcircle ◙""".split()
# The company's private codes of serif and sans-serif signs.
PRIVATE_NAMES = {"copyrightsans": 0xF8E9, "copyrightserif": 0xF6D9, "registersans": 0xF8E8, "registerserif": 0xF6DA, "trademarksans": 0xF8EA, "trademarkserif": 0xF6DB, "commaaccent": 0xF6C3, "radicalex": 0xF8E5, "arrowvertex": 0xF8E6, "arrowhorizex": 0xF8E7}
# First codes of numbered names, with the code points that they stand for, in order.
NUMBERED = {"afii": [(10017, [*range(0x410, 0x416), 0x401, *range(0x416, 0x430), *range(0x402, 0x40D), 0x40E, 0x40F][:47]), (10065, [*range(0x430, 0x436), 0x451, *range(0x436, 0x450), *range(0x452, 0x45D), 0x45E]), (57664, [*range(0x5D0, 0x5EB)]), (57409, [*range(0x621, 0x63B)]), (57440, [*range(0x640, 0x64B)]), (57392, [*range(0x660, 0x66A)])]}
# Scripts whose letters' names end with the script, and how their Unicode names begin.
SCRIPTS = {"cyrillic": "CYRILLIC", "hebrew": "HEBREW", "arabic": "ARABIC", "armenian": "ARMENIAN", "hiragana": "HIRAGANA", "katakana": "KATAKANA", "deva": "DEVANAGARI", "bengali": "BENGALI", "gujarati": "GUJARATI", "gurmukhi": "GURMUKHI", "thai": "THAI", "bopomofo": "BOPOMOFO"}
# More accents of Latin letters, below and in pairs.
MORE_ACCENTS = {"dotbelow": "\u0323", "hookabove": "\u0309", "horn": "\u031b", "linebelow": "\u0331", "ringbelow": "\u0325", "circumflexbelow": "\u032d", "tildebelow": "\u0330", "dieresisbelow": "\u0324", "dblgrave": "\u030f", "invertedbreve": "\u0311"}


@lru_cache(1)
def glyph_names() -> dict[str, str]:
    names = {n: chr(32 + i) for i, n in enumerate(ASCII_NAMES)} | {n: c for c, n in BRACKET_NAMES.items()}
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    names |= {c: c for c in letters}
    marks = ACCENTS | MORE_ACCENTS
    for c in letters:
        for first, mark in marks.items():
            for second, other in {"": "", **marks}.items():
                whole = unicodedata.normalize("NFC", c + mark + other)
                if len(whole) == 1:
                    names.setdefault(c + first + second, whole)
    for code in range(0x391, 0x3CA):  # Greek letters by their Unicode names
        if name := unicodedata.name(chr(code), ""):
            kind, _, rest = name.removeprefix("GREEK ").partition(" LETTER ")
            if rest.isalpha():
                names.setdefault(rest.capitalize() if kind == "CAPITAL" else rest.lower(), chr(code))
    for i, digit in enumerate(ASCII_NAMES[16:26]):
        names |= {f"{digit}inferior": chr(0x2080 + i), f"{digit}arabic": chr(0x660 + i), f"{digit}circle": chr(0x245F + i) if i else "⓪"}
        names.setdefault(f"{digit}superior", chr(0x2070 + i))
    for prefix, runs in NUMBERED.items():
        names |= {f"{prefix}{first + i}": chr(c) for first, codes in runs for i, c in enumerate(codes)}
    plain = dict(zip(OTHER_NAMES[::2], OTHER_NAMES[1::2], strict=True)) | dict(zip(SYMBOL_NAMES[::2], SYMBOL_NAMES[1::2], strict=True))
    return names | plain | {n: chr(c) for n, c in PRIVATE_NAMES.items()} | {"nbspace": "\u00a0", "sfthyphen": "\u00ad", "nonbreakingspace": "\u00a0", "softhyphen": "\u00ad"}


def _of_script(name: str) -> str | None:
    """A letter by its script's Unicode names: a capital first letter stands for a capital letter."""
    for ending, script in SCRIPTS.items():
        stem = name.removesuffix(ending)
        if stem and stem != name:
            kinds = ("CAPITAL LETTER", "LETTER") if stem[0].isupper() else ("SMALL LETTER", "LETTER", "VOWEL SIGN", "CHARACTER", "POINT", "")
            for kind in kinds:
                try:
                    return unicodedata.lookup(" ".join(f"{script} {kind} {stem.upper()}".split()))
                except KeyError:
                    continue
    return None


def glyph_text(name: str) -> str | None:
    """The characters of a glyph name: a suffix after a point is cut, parts joined by underscores are joined, uniXXXX and uXXXX[XX] are code points."""
    stem = name.split(".")[0]
    if "_" in stem:
        parts = [glyph_text(p) for p in stem.split("_")]
        return None if None in parts else "".join(parts)
    if stem in glyph_names():
        return glyph_names()[stem]
    if letter := _of_script(stem):
        return letter
    for prefix, sizes in (("uni", None), ("u", (4, 5, 6))):
        digits = stem[len(prefix) :]
        if stem.startswith(prefix) and digits and all(d in "0123456789ABCDEF" for d in digits) and (len(digits) % 4 == 0 if sizes is None else len(digits) in sizes):
            codes = [int(digits[i : i + 4], 16) for i in range(0, len(digits), 4)] if sizes is None else [int(digits, 16)]
            if all(c < 0xD800 or 0xE000 <= c <= 0x10FFFF for c in codes):
                return "".join(map(chr, codes))
    return None


# The upper part of the standard encoding, code then glyph name.
STANDARD_UPPER = """161 exclamdown 162 cent 163 sterling 164 fraction 165 yen 166 florin 167 section 168 currency 169 quotesingle 170 quotedblleft 171 guillemotleft 172 guilsinglleft 173 guilsinglright 174 fi 175 fl
177 endash 178 dagger 179 daggerdbl 180 periodcentered 182 paragraph 183 bullet 184 quotesinglbase 185 quotedblbase 186 quotedblright 187 guillemotright 188 ellipsis 189 perthousand 191 questiondown
193 grave 194 acute 195 circumflex 196 tilde 197 macron 198 breve 199 dotaccent 200 dieresis 202 ring 203 cedilla 205 hungarumlaut 206 ogonek 207 caron 208 emdash
225 AE 227 ordfeminine 232 Lslash 233 Oslash 234 OE 235 ordmasculine 241 ae 245 dotlessi 248 lslash 249 oslash 250 oe 251 germandbls""".split()


@lru_cache(8)
def encoding(name: str) -> dict[int, str]:
    """{code: text} of a base encoding; an unknown name gives the standard one."""
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        table = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256) if c != 127}
        if codec == "cp1252":
            table |= {c: "•" for c, t in table.items() if not t} | {0xA0: " ", 0xAD: "-", 127: "•"}
        else:
            table[0xCA] = " "
        return {c: t for c, t in table.items() if t}
    if name == "PDFDocEncoding":
        from inkwell.sources.document import DOC_ENCODING

        return {c: t for c, t in DOC_ENCODING.items() if c >= 24}
    plain = {c: chr(c) for c in range(32, 127)} | {39: "’", 96: "‘"}
    return plain | {int(c): glyph_names()[n] for c, n in zip(STANDARD_UPPER[::2], STANDARD_UPPER[1::2], strict=True)}


def with_differences(base: str, differences: list) -> dict[int, str]:
    table, code = dict(encoding(base)), 0
    for x in differences:
        if isinstance(x, int):
            code = x
        else:
            text = glyph_text(str(x))
            if text is not None:
                table[code] = text
            code += 1
    return table


# Advance widths of the base fonts for the characters U+0020 to U+007E, thousandths of the size.
BASE_WIDTHS = {
    "Helvetica": """278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584""",
    "Helvetica-Bold": """278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584""",
    "Times-Roman": """250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541""",
    "Times-Bold": """250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520""",
    "Times-Italic": """250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541""",
    "Times-BoldItalic": """250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570""",
}
# Widths of other characters, each in the fonts in the order of BASE_WIDTHS. Accented letters follow from their letters, but for some.
OTHER_WIDTHS = """¡ 333 333 333 333 389 389; ¢ 556 556 500 500 500 500; £ 556 556 500 500 500 500; ¤ 556 556 500 500 500 500; ¥ 556 556 500 500 500 500; ¦ 260 280 200 220 275 220
§ 556 556 500 500 500 500; ¨ 333 333 333 333 333 333; © 737 737 760 747 760 747; ª 370 370 276 300 276 266; « 556 556 500 500 500 500; ¬ 584 584 564 570 675 606
® 737 737 760 747 760 747; ¯ 333 333 333 333 333 333; ° 400 400 400 400 400 400; ± 584 584 564 570 675 570; ² 333 333 300 300 300 300; ³ 333 333 300 300 300 300
´ 333 333 333 333 333 333; µ 556 611 500 556 500 576; ¶ 537 556 453 540 523 500; · 278 278 250 250 250 250; ¸ 333 333 333 333 333 333; ¹ 333 333 300 300 300 300
º 365 365 310 330 310 300; » 556 556 500 500 500 500; ¼ 834 834 750 750 750 750; ½ 834 834 750 750 750 750; ¾ 834 834 750 750 750 750; ¿ 611 611 444 500 500 500
Æ 1000 1000 889 1000 889 944; Ð 722 722 722 722 722 722; × 584 584 564 570 675 570; Ø 778 778 722 778 722 722; Þ 667 667 556 611 611 611; ß 611 611 500 556 500 500
æ 889 889 667 722 667 722; ð 556 611 500 500 500 500; ÷ 584 584 564 570 675 570; ø 611 611 500 500 500 500; þ 556 611 500 556 500 500; ď 643 743 588 672 544 608
Đ 722 722 722 722 722 722; đ 556 611 500 556 500 500; ı 278 278 278 278 278 278; Ľ 556 611 611 667 611 611; ľ 299 400 344 394 300 382; Ł 556 611 611 667 556 611
ł 222 278 278 278 278 278; Œ 1000 1000 889 1000 944 944; œ 944 944 722 722 667 722; ť 317 389 326 416 300 366; ƒ 556 556 500 500 500 500; ˆ 333 333 333 333 333 333
ˇ 333 333 333 333 333 333; ˘ 333 333 333 333 333 333; ˙ 333 333 333 333 333 333; ˚ 333 333 333 333 333 333; ˛ 333 333 333 333 333 333; ˜ 333 333 333 333 333 333
˝ 333 333 333 333 333 333; – 556 556 500 500 500 500; — 1000 1000 1000 1000 889 1000; ‘ 222 278 333 333 333 333; ’ 222 278 333 333 333 333; ‚ 222 278 333 333 333 333
“ 333 500 444 500 556 500; ” 333 500 444 500 556 500; „ 333 500 444 500 556 500; † 556 556 500 500 500 500; ‡ 556 556 500 500 500 500; • 350 350 350 350 350 350
… 1000 1000 1000 1000 889 1000; ‰ 1000 1000 1000 1000 1000 1000; ‹ 333 333 333 333 333 333; › 333 333 333 333 333 333; ⁄ 167 167 167 167 167 167; ™ 1000 1000 980 1000 980 1000
∂ 476 494 476 494 476 494; ∆ 612 612 612 612 612 612; ∑ 600 600 600 600 600 600; − 584 584 564 570 675 606; √ 453 549 453 549 453 549; ≠ 549 549 549 549 549 549
≤ 549 549 549 549 549 549; ≥ 549 549 549 549 549 549; ◊ 471 494 471 494 471 494; U+F6C3 250 250 250 250 250 250; ﬁ 500 611 556 556 500 556; ﬂ 500 611 556 556 500 556"""
# Widths of the two pictorial fonts; the dingbats by the numbers in their glyphs' names, space by its code.
SYMBOL_WIDTHS = """U+0020 250 ! 333 # 500 % 833 & 778 ( 333 ) 333 + 549 , 250 . 250 / 278 0 500 1 500 2 500 3 500 4 500 5 500 6 500 7 500 8 500 9 500 : 278 ; 278 < 549
= 549 > 549 ? 444 [ 333 ] 333 _ 500 { 480 | 200 } 480 ¬ 713 ° 400 ± 549 µ 576 × 549 ÷ 549 ƒ 500 Α 722 Β 667 Γ 603 Ε 611 Ζ 611 Η 722 Θ 741 Ι 333
Κ 722 Λ 686 Μ 889 Ν 722 Ξ 645 Ο 722 Π 768 Ρ 556 Σ 592 Τ 611 Υ 690 Φ 763 Χ 722 Ψ 795 α 631 β 549 γ 411 δ 494 ε 439 ζ 494 η 603 θ 521 ι 329 κ 549
λ 549 ν 521 ξ 493 ο 549 π 549 ρ 549 ς 439 σ 603 τ 439 υ 576 φ 521 χ 549 ψ 686 ω 686 ϑ 631 ϒ 620 ϕ 603 ϖ 713 • 460 … 1000 ′ 247 ″ 411 ⁄ 167 € 750
ℑ 686 ℘ 987 ℜ 795 Ω 768 ℵ 823 ← 987 ↑ 603 → 987 ↓ 603 ↔ 1042 ↵ 658 ⇐ 987 ⇑ 603 ⇒ 987 ⇓ 603 ⇔ 1042 ∀ 713 ∂ 494 ∃ 549 ∅ 823 ∆ 612 ∇ 713 ∈ 713 ∉ 713
∋ 439 ∏ 823 ∑ 713 − 549 ∗ 500 √ 549 ∝ 713 ∞ 713 ∠ 768 ∧ 603 ∨ 603 ∩ 768 ∪ 768 ∫ 274 ∴ 863 ∼ 549 ≅ 549 ≈ 549 ≠ 549 ≡ 549 ≤ 549 ≥ 549 ⊂ 713 ⊃ 713
⊄ 713 ⊆ 713 ⊇ 713 ⊕ 768 ⊗ 768 ⊥ 658 ⋅ 250 ⌠ 686 ⌡ 686 〈 329 〉 329 ◊ 494 ♠ 753 ♣ 753 ♥ 753 ♦ 753 U+F6D9 790 U+F6DA 790 U+F6DB 890 U+F8E5 500 U+F8E6 603 U+F8E7 1000 U+F8E8 790 U+F8E9 790
U+F8EA 786 U+F8EB 384 U+F8EC 384 U+F8ED 384 U+F8EE 384 U+F8EF 384 U+F8F0 384 U+F8F1 494 U+F8F2 494 U+F8F3 494 U+F8F4 494 U+F8F5 686 U+F8F6 384 U+F8F7 384 U+F8F8 384 U+F8F9 384 U+F8FA 384 U+F8FB 384 U+F8FC 494 U+F8FD 494 U+F8FE 494 U+F8FF 790"""
DINGBAT_WIDTHS = """1 974 2 961 3 980 4 719 5 789 6 494 7 552 8 537 9 577 10 692 11 960 12 939 13 549 14 855 15 911 16 933 17 945 18 974 19 755 20 846 21 762 22 761 23 571 24 677 25 763 26 760 27 759 28 754 29 786 30 788
31 788 32 790 33 793 34 794 35 816 36 823 37 789 38 841 39 823 40 833 41 816 42 831 43 923 44 744 45 723 46 749 47 790 48 792 49 695 50 776 51 768 52 792 53 759 54 707 55 708 56 682 57 701 58 826 59 815 60 789
61 789 62 707 63 687 64 696 65 689 66 786 67 787 68 713 69 791 70 785 71 791 72 873 73 761 74 762 75 759 76 892 77 892 78 788 79 784 81 438 82 138 83 277 84 415 85 509 86 410 87 234 88 234 89 390 90 390 91 276
92 276 93 317 94 317 95 334 96 334 97 392 98 392 99 668 100 668 101 732 102 544 103 544 104 910 105 911 106 667 107 760 108 760 109 626 110 694 111 595 112 776 117 690 118 791 119 790 120 788 121 788 122 788 123 788 124 788 125 788
126 788 127 788 128 788 129 788 130 788 131 788 132 788 133 788 134 788 135 788 136 788 137 788 138 788 139 788 140 788 141 788 142 788 143 788 144 788 145 788 146 788 147 788 148 788 149 788 150 788 151 788 152 788 153 788 154 788 155 788
156 788 157 788 158 788 159 788 160 894 161 838 162 924 163 1016 164 458 165 924 166 918 167 927 168 928 169 928 170 834 171 873 172 828 173 924 174 917 175 930 176 931 177 463 178 883 179 836 180 867 181 696 182 874 183 760 184 946 185 865
186 967 187 831 188 873 189 927 190 970 191 918 192 748 193 836 194 771 195 888 196 748 197 771 198 888 199 867 200 696 201 874 202 974 203 762 204 759 205 509 206 410"""
# Ascent and descent by family.
FAMILY_BOX = {"Helvetica": (718, -207), "Times": (683, -217), "Courier": (627, -194), "Symbol": (0, 0), "ZapfDingbats": (0, 0)}
ALIASES = {"Arial": "Helvetica", "TimesNewRoman": "Times", "CourierNew": "Courier"}
STYLES = {"": "", "Bold": "-Bold", "Italic": "-Oblique", "BoldItalic": "-BoldOblique"}


def base_name(font: str) -> str | None:
    """The base font of a name or of one of its known aliases."""
    stem, _, style = font.partition(",")
    if stem in ALIASES and style in STYLES:
        font = ALIASES[stem] + STYLES[style]
        if font.startswith("Times"):
            font = font.replace("Oblique", "Italic") if style else "Times-Roman"
    family, _, style = font.partition("-")
    known = {"Times": ("Roman", "Bold", "Italic", "BoldItalic"), "Symbol": ("",), "ZapfDingbats": ("",)}.get(family, ("", "Bold", "Oblique", "BoldOblique"))
    return font if family in FAMILY_BOX and style in known else None


def _pairs(text: str) -> dict[str, float]:
    items = text.split()
    return {chr(int(c[2:], 16)) if c.startswith("U+") else c: float(w) for c, w in zip(items[::2], items[1::2], strict=True)}


@lru_cache(16)
def base_metrics(font: str) -> tuple[dict[str, float], float, float] | None:
    """(width by character, ascent, descent) of a base font. An accented letter is as wide as its letter."""
    name = base_name(font)
    if name is None:
        return None
    family = name.split("-")[0]
    ascent, descent = FAMILY_BOX[family]
    if family == "Symbol":
        return _pairs(SYMBOL_WIDTHS), ascent, descent
    if family == "ZapfDingbats":
        return {chr(int(n)): w for n, w in _pairs(DINGBAT_WIDTHS).items()}, ascent, descent
    latin = {c for t in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding") for c in encoding(t).values()} | set(map(chr, range(0x100, 0x180))) | set("Șș−")
    if family == "Courier":
        return {c: 600 for c in latin}, ascent, descent
    key = name.replace("-Oblique", "").replace("BoldOblique", "Bold") if family == "Helvetica" else name
    widths = dict(zip(map(chr, range(32, 127)), map(float, BASE_WIDTHS[key].split()), strict=True))
    at = 1 + list(BASE_WIDTHS).index(key)
    for row in OTHER_WIDTHS.replace("\n", ";").split(";"):
        c, w = row.split()[0], float(row.split()[at])
        widths[chr(int(c[2:], 16)) if c.startswith("U+") else c] = w
    for c in latin:
        letter, *marks = unicodedata.normalize("NFD", c)
        if c not in widths and marks and letter in widths:
            widths[c] = widths["ı" if letter == "i" and marks[0] != ACCENTS["ogonek"] else letter]
    return widths, ascent, descent
