"""Alphabets over one phoneme index.

A script lists, for each class of phoneme, the glyph of each index; indices mean the same sound in every script.  Scripts that
Unicode lays out in parallel blocks are built from the block's first code point by a rule; what deviates is named.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

VOWEL, MARK, CONSONANT, OTHER, SYMBOL, VEDIC, ACCENT, EXCLUSIVE = range(8)
CLASSES = ("vowel", "mark", "consonant", "other", "symbol", "vedic", "accent", "exclusive")
LETTERS = "vmcosSax"
INDIC, TAMIL, LATIN = "indic", "tamil", "latin"

# Offsets in a Brahmic block of vowels, vowel signs and consonants, in order of the phoneme index.
VOWEL_AT = "05 06 07 08 09 0A 0B 60 0C 61 0E 0F 10 12 13 14"
MARK_AT = "4D 3E 3F 40 41 42 43 44 62 63 46 47 48 4A 4B 4C"
CONSONANT_AT = "15 16 17 18 19 1A 1B 1C 1D 1E 1F 20 21 22 23 24 25 26 27 28 2A 2B 2C 2D 2E 2F 30 32 35 36 37 38 39 33 34 31 29"
DIGIT_AT, NUKTA_AT = 0x66, 0x3C
#: Consonants that have a dotted form (37 on) and a prenasalized form (45 on).
DOTTED, PRENASAL = (0, 1, 2, 7, 12, 13, 21, 25), (2, 7, 12, 17, 22)

# Signs that several scripts share.
VEDIC_ACCENTS = "॒ ॑ ᳚ ᳐ ᳑ ᳒ ᳓ ᳔ ᳕ ᳖ ᳗ ᳘ ᳙ ᳛ ᳜ ᳝ ᳞ ᳟ ᳠ ᳢ ᳣ ᳤ ᳥ ᳦ ᳧ ᳨ ᳩ ᳪ ᳫ ᳬ ᳮ ᳯ ᳰ ᳱ ᳲ ᳳ ᳴ ᳷ ᳸ ᳹ ᳺ".split()
LATIN_ACCENTS = "̱ ̍ ̎".split()
EXCLUSIVE_SIGNS = ["‌", "‍", "​", "", "ੱ", *"᳡ ꣡ ꣢ ꣣ ꣤ ꣥ ꣦ ꣧ ꣨ ꣩ ꣪ ꣫ ꣬ ꣭ ꣮ ꣯ ꣰ ꣱ ꣲ ꣵ ꣶ ꣷ ꣸ ꣹ ꣺ ꣻ ꣼ ꣽ".split()]
SKIP, ADHAK = 2, 4
SUPERSCRIPTS, SUBSCRIPTS = "¹²³⁴", "₁₂₃₄"
TAMIL_SPECIAL, MARKERS = "ʼˮˇ꞉ஃ·", "ʽʼˮˇ"
TAMIL_PREFIXES = "அது இது மா ஒரு அந்த இந்த".split()
TAMIL_TRADITIONAL = {"ஸ": "ச", "ஜ": "ச³", "ஜ²": "ச⁴"}
#: Only as a target, and read without regard to ASCII case; both hold for exactly these names.
WRITE_ONLY, CASELESS = frozenset({"readablelatin"}), frozenset({"iast", "iso"})


@dataclass(frozen=True)
class Script:
    name: str
    kind: str
    vedic: bool
    glyphs: tuple[tuple[str, ...], ...]
    aliases: tuple[str, ...] = ()
    equivalents: dict[str, list[str]] = field(default_factory=dict, hash=False)


def _finish(name: str, kind: str, vedic: bool, lists: list[list[str]], aliases: str = "", equivalents: dict[str, str] | None = None) -> Script:
    signs = [LATIN_ACCENTS, []] if kind == LATIN else [VEDIC_ACCENTS, EXCLUSIVE_SIGNS]
    sizes = [len(x) for x in lists]
    assert sizes == [19, 19, 50, 4, 13, 3], (name, sizes)
    return Script(name, kind, vedic, tuple(map(tuple, [*lists, *signs])), tuple(aliases.split()), {k: v.split(" ") for k, v in (equivalents or {}).items()})


def brahmic(
    name: str, base: int, nasal: int, om: str, rare: str, short: bool = True, dot: str = "", aliases: str = "", equivalents: dict[str, str] | None = None, **other: str | dict[int, str]
) -> Script:
    """A script of a Brahmic block at ``base``.

    ``nasal`` is the offset of the sign that starts prenasalized consonants, ``rare`` three "index suffix" pairs for the last vowels (by the vowel
    they are made from), ``short`` whether the block has short e and o, ``dot`` what dots a consonant (the block's nukta by default); ``other`` names
    deviations by class and index.
    """
    at = lambda x: chr(base + int(x, 16))
    vowels, marks, consonants = ([at(x) for x in row.split()] for row in (VOWEL_AT, MARK_AT, CONSONANT_AT))
    dot = dot or chr(base + NUKTA_AT)
    for letters in (vowels, marks):
        if not short:
            letters[10], letters[13] = letters[11] + "᳴", letters[14] + "᳴"
    for key, found in other.items():
        letters = {"vowels": vowels, "marks": marks, "consonants": consonants}.get(key)
        if letters is not None:
            for i, glyph in found.items():
                if i < len(letters):
                    letters[i] = glyph
    for letters in (vowels, marks):
        letters += [letters[int(i)] + suffix for i, suffix in (x.split(":") for x in rare.split())]
    consonants += [consonants[i] + dot for i in DOTTED]
    consonants += [chr(base + nasal) + "ˆ" + consonants[i] for i in PRENASAL]
    for key, letters in (("vowels", vowels), ("marks", marks), ("consonants", consonants)):
        for i, glyph in other.get(key, {}).items():
            letters[i] = glyph
    signs = other.get("signs", "").split() or [chr(base + 1), chr(base + 2), chr(base + 3), chr(base + 3) + "ʼ"]
    digits = [chr(other.get("digits", base + DIGIT_AT) + i) for i in range(10)]
    return _finish(name, INDIC, True, [vowels, marks, consonants, signs, [*digits, om, "।", "॥"], [other.get("avagraha") or chr(base + 0x3D), "ꣳ", "ꣴ"]], aliases, equivalents)


def listed(name: str, kind: str, vowels: str, marks: str, consonants: str, signs: str, symbols: str, vedic_signs: str, equivalents: dict[str, str] | None = None, upper: bool = False) -> Script:
    """A script whose glyphs are listed; in Latin the marks are the vowels, without the first.  ∅ stands for no glyph."""
    lists = [[x.replace("∅", "") for x in row.split()] for row in (vowels, marks or vowels, consonants, signs, symbols, vedic_signs)]
    if kind == LATIN:
        lists[1] = ["", *lists[0][1:]]
    script = _finish(name, kind, False, lists, "", equivalents)
    return latin_variants(script, upper) if kind == LATIN and (upper or name == "titus") else script


def decomposed(text: str) -> str:
    """Letters split into base and combining signs, but for a line below and ǣ."""
    parts = (unicodedata.normalize("NFD", c) for c in text)
    return "".join(c if "̱" in d or c in "ǣǢ" else d for c, d in zip(text, parts))


def upper_case(text: str) -> str:
    """Upper case, without letters whose capital is newer than Unicode's block Latin Extended-D."""
    return "".join(u if len(u := c.upper()) == 1 and ord(u) < 0xA7A0 else c for c in text)


def latin_variants(script: Script, upper: bool) -> Script:
    """The script with capitals (if ``upper``) and decomposed spellings as equivalents of its glyphs."""
    rows = dict(script.equivalents)
    for glyph in dict.fromkeys(g for row in script.glyphs[:6] for g in row if g):
        found = list(rows.get(glyph, []))
        for variant in [*([upper_case(glyph)] if upper else []), decomposed(glyph), *([upper_case(decomposed(glyph))] if upper else [])]:
            if variant != glyph and variant not in found:
                found.append(variant)
        if found:
            rows[glyph] = found
    return Script(script.name, script.kind, script.vedic, script.glyphs, script.aliases, rows)


def _joiners(virama: str) -> str:
    return f"{virama}‍ ‍{virama}"


# Glyphs and spellings of each script, in order of the phoneme index.
LATIN_SIGNS = {"x:0": "() ^", "x:1": "{} ^^"}
DANDAS = {"||": "// ..", "|": "/ ."}
ISO_CONSONANTS = "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḷ ḻ ṟ ṉ q k͟h ġ z ṛ ṛh f ẏ n̆g n̆j n̆ḍ n̆d m̆b"
EASTERN = "11:᳴ 11:ˇ 1:᳴"
SOUTHERN = "10:᳴ 11:ˇ 1:᳴"
MALAYALAM = {"base": 0x0D00, "nasal": 2, "dot": "·", "marks": {15: "ൗ"}}


@lru_cache(maxsize=1)
def scripts() -> dict[str, Script]:
    """All scripts by name, in the order of their names without regard to case."""
    bengali = {28: "ভ়", 33: "ল়", 34: "ষ়", 35: "র়", 36: "ন়", 41: chr(0x9DC), 42: chr(0x9DD), 44: chr(0x9DF)}
    found = [
        brahmic("assamese", 0x0980, 1, "ওঁ", EASTERN, False, equivalents={"ৰ": "র", "ৱ": "ভ়", "ৰ়": "র়"}, consonants=bengali | {26: "ৰ", 28: "ৱ", 35: "ৰ়"}),
        brahmic("bengali", 0x0980, 1, "ওঁ", EASTERN, False, aliases="bangla", equivalents={"র": "ৰ", "ভ়": "ৱ", "র়": "ৰ়"}, consonants=bengali),
        listed(
            "burmese", INDIC,
            "အ အာ ဣ ဤ ဥ ဦ ၒ ၓ ၔ ၕ ဧʽ ဧ အဲ ဩʽ ဩ ဪ ဧʽ ဧʽ အာʽ",
            "် ာ ိ ီ ု ူ ၖ ၗ ၘ ၙ ေʽ ေ ဲ ောʽ ော ော် ေʽ ေʽ ာʽ",
            "က ခ ဂ ဃ င စ ဆ ဇ ဈ ဉ ဋ ဌ ဍ ဎ ဏ တ ထ ဒ ဓ န ပ ဖ ဗ ဘ မ ယ ရ လ ဝ ၐ ၑ သ ဟ ဠ ဠʽ ရʽ နʽ ကʽ ခʽ ဂʽ ဇʽ ဍʽ ဎʽ ဖʽ ယʽ ံဂʽ ံဇʽ ံဍʽ ံဒʽ ံဗʽ",
            "ံʽ ံ း းʽ", "၀ ၁ ၂ ၃ ၄ ၅ ၆ ၇ ၈ ၉ ဥုံ ၊ ။", "' ꣳ ꣴ", {"x:0": "{} ^^", "x:1": "() ^"},
        ),
        brahmic(
            "devanagari", 0x0900, 1, "ॐ", "10: 11: 10:", aliases="hindi sanskrit",
            equivalents={chr(0x958 + n): chr(0x915 + i) + "़" for n, i in enumerate((0, 1, 2, 7, 12, 13, 22, 26))} | {"ॐ": "ओ३म्", "्": "᳭ " + _joiners("्"), "ऽ": "ᳵ ᳶ", "ऍ": "ॲ अॅ"},
            vowels={16: "ऍ", 17: "एॕ", 18: "ऑ"}, marks={16: "ॅ", 17: "ॕ", 18: "ॉ"}, consonants={37 + n: chr(0x958 + n) for n in range(8)},
        ),
        brahmic("gujarati", 0x0A80, 1, "ૐ", "11: 11: 14:", False, vowels={16: "ઍ", 17: "ઍˇ", 18: "ઑ"}, marks={16: "ૅ", 17: "ૅˇ", 18: "ૉ"}, consonants={34: "ળ઼", 35: "ર઼", 36: "ન઼"}),
        brahmic(
            "gurmukhi", 0x0A00, 1, "ੴ", EASTERN, False, aliases="punjabi", equivalents={"ਂ": "ੰ"}, avagraha="(ਅ)",
            vowels={6: "ਰੁʼ", 7: "ਰੂʼ", 8: "ਲੁʼ", 9: "ਲੂʼ"}, marks={6: "੍ਰੁʼ", 7: "੍ਰੂʼ", 8: "੍ਲੁʼ", 9: "੍ਲੂʼ"},
            consonants={29: chr(0xA36), 30: chr(0xA36) + "਼", 33: chr(0xA33), 34: chr(0xA33) + "਼", 35: "ਰ਼", 36: "ਨ਼", 38: chr(0xA59), 39: chr(0xA5A), 40: chr(0xA5B), 41: chr(0xA5C), 43: chr(0xA5E)},
        ),
        listed(
            "iast", LATIN, "a ā i ī u ū ṛ ṝ ḷ ḹ ĕ e ai ŏ o au æ ǣ ô", "",
            ISO_CONSONANTS.replace(" ḷ ", " l̤ ").replace(" ṛ ṛh ", " r̤ r̤h "), "m̐ ṃ ḥ ḵ", "0 1 2 3 4 5 6 7 8 9 oṃ | ||", "' gͫ gͫ̄", DANDAS | LATIN_SIGNS | {"ṛ": "r̥"}, True,
        ),
        listed(
            "ipa", LATIN, "ə ɑː ɪ iː u uː ɾɨ ɾɨː lɨ lɨː e eː əɪ o oː əu æ æː ɔ", "",
            "k kʰ g gʰ ŋ t͡ʃ t͡ʃʰ d͡ʒ d͡ʒʰ ɲ ʈ ʈʰ ɖ ɖʰ ɳ t̪ t̪ʰ d̪ d̪ʰ n̪ p pʰ b bʰ m j ɾ l ʋ ʃ ʂ s̪ ɦ ɭ ɻ r n q x ɣ z ɽ ɽʰ f ẏ ᵑɡ ᶮd͡ʒ ᶯɖ ⁿd ᵐb",
            "̃ʽ ̃ h xʽ", "0 1 2 3 4 5 6 7 8 9 oːm | ||", "ə̸ gͫ gͫ̄", DANDAS | LATIN_SIGNS | {"ɑː": "aː"}, True,
        ),
        listed(
            "iso", LATIN, "a ā i ī u ū r̥ r̥̄ l̥ l̥̄ e ē ai o ō au æ ǣ ô", "", ISO_CONSONANTS, "m̐ ṁ ḥ ḵ", "0 1 2 3 4 5 6 7 8 9 ōṁ | ||", "’ gͫ gͫ̄", DANDAS | LATIN_SIGNS, True,
        ),
        listed(
            "itrans", LATIN, "a aa i ee u uu R^i R^I L^i L^I ^e e ai ^o o au e.c a.C A.c", "",
            "k kh g gh ~N ch chh j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L zh R ^n q K G z .D .Dh f Y n*g n*j n*D n*d m*b",
            ".N M H K^", "0 1 2 3 4 5 6 7 8 9 OM | ||", ".a gum ggum",
            DANDAS | {"aa": "A", "ee": "I ii", "uu": "U oo", "R^i": "RRi", "R^I": "RRI", "L^i": "LLi", "L^I": "LLI", "e": "E", "o": "O", "e.c": "c.e", "A.c": "c.o", "chh": "Ch", "L": "ld", "z": "J", ".n": "M .m", "x:0": "() ^", "x:1": "{} ^^ +", "x:2": "_", "OM": "aum AUM oM", "shree": "SRI", "kSh": "x", "j~n": "GY dny"},
        ),
        brahmic("kannada", 0x0C80, 2, "ಓಂ", SOUTHERN, equivalents={"್": _joiners("್"), "ಽ": "ೱ ೲ"}, consonants={34: "ೞ", 36: "ನ಼"}),
        listed(
            "khmer", INDIC,
            "អ អា ឥ ឦ ឧ ឩ ឫ ឬ ឭ ឮ ឯʽ ឯ ឰ ឱʽ ឱ ឳ ឯʽ ឯʽ អាʽ",
            "៑ ា ិ ី ុ ូ ្ឫ ្ឬ ្ឭ ្ឮ េʽ េ ៃ ោʽ ោ ៅ េʽ េʽ ាʽ",
            "ក ខ គ ឃ ង ច ឆ ជ ឈ ញ ដ ឋ ឌ ឍ ណ ត ថ ទ ធ ន ប ផ ព ភ ម យ រ ល វ ឝ ឞ ស ហ ឡ ឡʽ រʽ នʽ កʽ ខʽ គʽ ជʽ ឌʽ ឍʽ ផʽ យʽ ំគʽ ំជʽ ំឌʽ ំទʽ ំពʽ",
            "ំʽ ំ ះ ះʽ", "០ ១ ២ ៣ ៤ ៥ ៦ ៧ ៨ ៩ ឱំ ។ ៕", "ៜ ꣳ ꣴ",
        ),
        brahmic(
            "malayalam", om="ഓം", rare=SOUTHERN, **MALAYALAM,
            equivalents={"ൌ": "ൗ", "്": _joiners("്")} | {c + "്": chillu for c, chillu in zip("ണനരലളകമയഴ", "ൺൻർൽൾൿൔൕൖ")},
        ),
        brahmic("oriya", 0x0B00, 1, "ଓଁ", EASTERN, False, aliases="odia", equivalents={"ୱ": "ଵ ଵ ବ଼"}, consonants={28: chr(0xB71), 34: "ଳ଼", 35: "ର଼", 36: "ନ଼", 41: chr(0xB5C), 42: chr(0xB5D), 44: chr(0xB5F)}),
        listed(
            "readableLatin", LATIN, "a aa i ee u oo r̥ rr̥ l̥ ll̥ e E ai o O au a e o", "",
            "k kh g gh n ch chh j jh n T Th D Dh N t th d dh n p ph b bh m y r l v sh sh s h L zh R n q qh gh z D Dh f y ng nj nD nd mb",
            "n̐ ∅ h q", "0 1 2 3 4 5 6 7 8 9 om ! !!", "~ gum ggum",
        ),
        listed(
            "sinhala", INDIC,
            "අ ආ ඉ ඊ උ ඌ ඍ ඎ ඏ ඐ එ ඒ ඓ ඔ ඕ ඖ ඇ ඈ ආ᳴",
            "් ා ි ී ු ූ ෘ ෲ ෟ ෳ ෙ ේ ෛ ො ෝ ෞ ැ ෑ ා᳴",
            "ක ඛ ග ඝ ඞ ච ඡ ජ ඣ ඤ ට ඨ ඩ ඪ ණ ත ථ ද ධ න ප ඵ බ භ ම ය ර ල ව ශ ෂ ස හ ළ ළ· ර· න· ක· ඛ· ග· ජ· ඩ· ඪ· ෆ ය· ඟ ඦ ඬ ඳ ඹ",
            "ංʼ ං ඃ ඃʼ", "෦ ෧ ෨ ෩ ෪ ෫ ෬ ෭ ෮ ෯ ඕං । ॥", "(අ) ꣳ ꣴ", {"්": _joiners("්")},
        ),
        tamil(),
        brahmic("tamilExtended", om="ௐ", rare="10:᳴ 11:᳴ 1:᳴", **(MALAYALAM | {"marks": {0: "്‌", 15: "ൗ"}}), signs="ഁ ം ഃ ஃ", digits=0x0BE6),
        brahmic(
            "telugu", 0x0C00, 1, "ఓం", "10: 11: 10:", dot="·", equivalents={"్": _joiners("్")}, signs="ఀ ం ః ఃʼ", consonants={36: "న·"},
            vowels={16: "ఎ᳴​", 17: "ఏ᳴", 18: "ఒ᳴​"}, marks={16: "ె॒​", 17: "ే॒​", 18: "ొ॒​"},
        ),
        listed(
            "thai", INDIC,
            "อ อา อิ อี อุ อู ฤ ฤๅ ฦ ฦๅ อเะ อเ อไ อโะ อโ อเา อแะ อแ อเาะ",
            "ฺ า ิ ี ุ ู ฺฤ ฺฤๅ ฺฦ ฺฦๅ เะ เ ไ โะ โ เา แะ แ เาะ",
            "ก ข ค ฆ ง จ ฉ ช ฌ ญ ฏ ฐ ฑ ฒ ณ ต ถ ท ธ น ป ผ พ ภ ม ย ร ล ว ศ ษ ส ห ฬ ฬʽ รʽ นʽ กʽ ฃ ฅ ซ รʽ รฺหʽ ฟ ยʽ ํคʽ ํชʽ ํฑʽ ํทʽ ํพʽ",
            "ํʽ ํ ห์ ห์ʽ", "๐ ๑ ๒ ๓ ๔ ๕ ๖ ๗ ๘ ๙ โอํ ฯ ๚", "' ꣳ ꣴ",
        ),
        listed(
            "tibetan", INDIC,
            "ཨ ཨཱ ཨི ཨཱི ཨུ ཨཱུ རྀ རཱྀ ལྀ ལཱྀ ཨེʽ ཨེ ཨཻ ཨོʽ ཨོ ཨཽ ཨེʽ ཨེʽ ཨཱʽ",
            "྄ ཱ ི ཱི ུ ཱུ ྲྀ ྲཱྀ ླྀ ླཱྀ ེʽ ེ ཻ ོʽ ོ ཽ ེʽ ེʽ ཱʽ",
            "ཀ ཁ ག གྷ ང ཙ ཚ ཛ ཛྷ ཉ ཊ ཋ ཌ ཌྷ ཎ ཏ ཐ ད དྷ ན པ ཕ བ བྷ མ ཡ ར ལ ཝ ཤ ཥ ས ཧ ལ༹ ཥ༹ ར༹ ན༹ ཀ༹ ཁ༹ ག༹ ཟ ཌ༹ ཌྷ༹ ཕ༹ ཡ༹ ྃཀʽ ྃཛʽ ྃཌʽ ྃདʽ ྃབʽ",
            "ྃ ཾ ཿ ཿʽ", "༠ ༡ ༢ ༣ ༤ ༥ ༦ ༧ ༨ ༩ ༀ ། ༎", "྅ ꣳ ꣴ",
        ),
        listed(
            "titus", LATIN, "a ā i ī u ū r̥ r̥̄ l̥ l̥̄ ĕ e ai ŏ o au æ ǣ ô", "",
            "k kʰ g gʰ ṅ c cʰ j jʰ ñ ṭ ṭʰ ḍ ḍʰ ṇ t tʰ d dʰ n p pʰ b bʰ m y r l v ś ṣ s h ḷ ḻ ṟ ṉ q k͟ʰ ġ z ṛ ṛʰ f ẏ n̆g n̆j n̆ḍ n̆d m̆b",
            "m̐ ṃ ḥ ḵ", "0 1 2 3 4 5 6 7 8 9 oṃ / //", "' gͫ gͫ̄", {"//": "|| ..", "/": "| ."} | LATIN_SIGNS,
        ),
        listed(
            "wx", LATIN, "a A i I u U q qV L LV eV e E oV o O aEV AEV aOV", "",
            "k K g G f c C j J F t T d D N w W x X n p P b B m y r l v S R s h lY lYY rY nY kY KY GY zY dY DY PY yY nYYg nYYj nYYd nYYx mYYb",
            "z M H kYY", "0 1 2 3 4 5 6 7 8 9 oM . ..", "Z gͫ gͫ̄", LATIN_SIGNS,
        ),
    ]
    return {s.name: s for s in sorted(found, key=lambda s: s.name.lower())}


def tamil() -> Script:
    """Tamil writes a varga's other stops as its first letter with a superscript number."""
    vowels = "அ ஆ இ ஈ உ ஊ ருʼ ரூʼ லுʼ லூʼ எ ஏ ஐ ஒ ஓ ஔ எ᳴ ஏ᳴ ஆ᳴".split()
    marks = "் ா ி ீ ு ூ ்ருʼ ்ரூʼ ்லுʼ ்லூʼ ெ ே ை ொ ோ ௌ ெ᳴ ே᳴ ா᳴".split()
    varga = lambda stop, nasal: [stop, stop + "²", stop + "³", stop + "⁴", nasal]
    consonants = [*varga("க", "ங"), "ச", "ச²", "ஜ", "ஜ²", "ஞ", *varga("ட", "ண"), *varga("த", "ந"), *varga("ப", "ம")]
    consonants += "ய ர ல வ ஶ ஷ ஸ ஹ ள ழ ற ன ஃக ஃக² ஃக³ ஃஜ ஃட² ஃட³ ஃப ஃய ங்ˆக³ ஞ்ˆஜ³ ண்ˆட³ ந்ˆத³ ம்ˆப³".split()
    equivalents = {"ொ": "ொ", "ோ": "ோ", "ௌ": "ௌ", "னஂ": "ம்ˮ", "மஂ": "ம்ʼ", "்": _joiners("்")}
    symbols = [*(chr(0x0BE6 + i) for i in range(10)), "ௐ", "।", "॥"]
    return _finish("tamil", TAMIL, True, [vowels, marks, consonants, "னஂ மஂ ꞉ ஃ".split(), symbols, "(அ) ꣳ ꣴ".split()], "", equivalents)


@lru_cache(maxsize=1)
def _names() -> dict[str, str]:
    found = {s.name.lower(): s.name for s in scripts().values()}
    return {alias.lower(): s.name for s in scripts().values() for alias in s.aliases} | found


def find(name: str) -> Script | None:
    """A script by name or alias, without regard to case."""
    known = _names().get(name.lower())
    return scripts()[known] if known else None


def supported_names() -> list[str]:
    """All names that can be a source or target: scripts, aliases and the source ``indic``."""
    return sorted({*scripts(), *(a for s in scripts().values() for a in s.aliases), "indic"})


def parse_name(text: str) -> str | None:
    """The name a script is registered under, from any case of it, also as ``Script.name``; None if there is none.  Aliases and ``indic`` are names too."""
    wanted = text.strip().rsplit(".", 1)[-1].lower()
    return next((n for n in supported_names() if n.lower() == wanted), None)
