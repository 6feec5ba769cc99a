"""The kernel: directions, inference and special behaviour, by hand-made cases."""

import random

import pyarrow as pa
import pytest

from lipika.functions import alphabets as A, batches, kernel as K, options as O

CASES = [
    # source, target, options, text, expected
    ("itrans", "devanagari", 0, "namaste", "नमस्ते"),
    ("itrans", "devanagari", 0, "SRI x", "श्री क्ष्"),
    ("itrans", "devanagari", 0, "a_i ai", "अइ ऐ"),
    ("devanagari", "iso", 0, "पंक्ती", "paṁktī"),
    ("devanagari", "tamil", 0, "पंक्ती", "பங்க்தீ"),
    ("devanagari", "tamil", 0, "नमः॒", "நம॒꞉"),
    ("devanagari", "telugu", 0, "कर्म", "కర్మ"),
    ("tamil", "readablelatin", 0, "பதக்கம்", "padakkam"),
    ("tamil", "readablelatin", 0, "தங்கப் ", "tanga "),
    ("tamil", "readablelatin", 0, "அதுபோல", "adupOla"),
    ("iast", "tamil", 0, "andanāl̤", "அந்தநாள்"),
    ("gurmukhi", "devanagari", 0, "ਹੱਦ", "हद्द"),
    ("gurmukhi", "devanagari", 0, "ਹੱ", "ह"),
    ("malayalam", "devanagari", 0, "ൺ", "ण्"),
    ("bangla", "odia", 0, "বাংলা", "ବାଂଲା"),
    ("indic", "iso", 0, "क క", "ka ka"),
    ("itrans", "devanagari", O.ASCII_NUMERALS, "12", "12"),
    ("itrans", "devanagari", 0, "12", "१२"),
    ("devanagari", "tamil", O.TAMIL_SUPERSCRIPTED, "गज", "க³ஜ"),
    ("devanagari", "tamil", O.TAMIL_TRADITIONAL, "सज", "சச"),
    ("devanagari", "iast", O.IGNORE_ACCENTS, "गु॒रु", "guru"),
    ("devanagari", "iast", 0, "गु॒रु", "gu̱ru"),
    # verbatim parts
    ("itrans", "devanagari", 0, "<b>ka</b>", "<b>क</b>"),
    ("itrans", "devanagari", 0, "##ka## ka", "ka क"),
    ("itrans", "devanagari", 0, "ka####ka", "क"),
    ("itrans", "devanagari", 0, "ka <b ka", "क "),
    ("itrans", "devanagari", 0, "ka ## ka", "क "),
    ("itrans", "devanagari", 0, "ka # ka", "क # क"),
    ("itrans", "devanagari", 0, "ʼ", ""),
    ("itrans", "devanagari", O.RETAIN_MARKERS, "ʼ", "ʼ"),
    ("itrans", "devanagari", 0, "ka\0ka", "क"),
    # names: aliases and case; guards hold for exact names
    ("HINDI", "Telugu", 0, "क", "క"),
    ("hindi", "devanagari", 0, "\u0915\u093c", "\u0958"),
    ("iast", "devanagari", 0, "KA", "क"),
    ("IAST", "devanagari", 0, "ṬH", "ठ्"),
    ("iast", "devanagari", 0, "ṬH", "ट्ह्"),
    ("readableLatin", "devanagari", 0, "ka", "क"),
    # an anusvara after a Latin vowel is a unit of its own
    ("iast", "readableLatin", 0, "aṃka", "aka"),
    ("devanagari", "readableLatin", 0, "कंक", "kanka"),
    ("devanagari", "readableLatin", 0, "कं", "kam"),
    ("devanagari", "readableLatin", 0, "कं।", "kaN!"),
]


@pytest.mark.parametrize("source,target,mask,text,expected", CASES)
def test_cases(source, target, mask, text, expected):
    assert K.transliterate(text, source, target, mask) == expected


@pytest.mark.parametrize("source,target", [("devanagari", "devanagari"), ("readablelatin", "iso"), ("none", "iso"), ("iso", "none"), ("iso", "indic")])
def test_unknown_directions(source, target):
    assert K.transliterate("ka", source, target) is None


def test_null_and_empty():
    assert K.transliterate(None, "iso", "iast") is None
    assert K.transliterate("", "iso", "iast") == ""


def test_lenient():
    assert K.lenient("ka", "wx", "iso") == "ka"
    assert K.lenient("ka", "iso", "indic") == "ka"
    assert K.lenient("ka", "iso", "iso") == "ka"
    assert K.lenient("ka", "itrans", "devanagari") == "क"
    assert K.lenient("", "itrans", "devanagari") == ""


def test_alphabets_have_their_sizes():
    assert len(A.scripts()) == 23
    for s in A.scripts().values():
        assert [len(x) for x in s.glyphs[:6]] == [19, 19, 50, 4, 13, 3]
        assert not any(" " in g for row in s.glyphs for g in row)
    assert len(A.supported_names()) == 29


def test_first_spelling_wins():
    spellings = K.reader("bengali").spellings
    assert spellings["এ᳴"] == ((A.VOWEL, 10, A.INDIC),)


def test_row_that_names_a_later_spelling_is_dead():
    assert ".m" not in K.reader("itrans").spellings


@pytest.mark.parametrize("script", ["telugu", "gujarati", "kannada", "iso", "itrans", "oriya"])
def test_round_trip(script):
    text = "अहं वृक्षः किन्नु ज्ञानं धर्मक्षेत्रे १२३ ।"
    there = K.transliterate(text, "devanagari", script, O.RETAIN_MARKERS)
    assert K.transliterate(there, script, "devanagari") == text


def test_word_memory_changes_nothing():
    rnd = random.Random(4)
    one = K.Transliterator("itrans", "iso")
    for _ in range(300):
        text = "".join(rnd.choice(["ka", "n", "M", "i", ".a", "_", " ", "\n", "X", "||", "gum", "^", "+", "R^i", "!", "è"]) for _ in range(rnd.randrange(25)))
        assert one(text) == one.whole(text)


def test_options():
    assert O.parse("TamilTraditional ASCIINumerals") == 5
    assert O.parse("asciinumerals") == 0
    assert O.parse("A||B") == 32
    assert O.parse("asciinumerals, IgnoreVedicAccents", "loose") == 12
    assert O.parse("ASCIINumerals Unknown", "plain") == 4
    assert O.names(12) == ["asciinumerals", "ignorevedicaccents"] and O.names(0) == ["none"]
    assert O.split_set("a, b;") == ["a", "", "b"]


def soup(rnd, alphabet, n):
    glyphs = [g for row in A.find(alphabet).glyphs for g in row if g]
    return "".join(rnd.choice([*glyphs, *glyphs, " ", " ", "\n", ", ", "x", "²"] if rnd.random() < 0.1 else [*glyphs, " "]) for _ in range(n))


@pytest.mark.parametrize("source,target", [("itrans", "tamil"), ("tamil", "readablelatin"), ("tamil", "devanagari"), ("devanagari", "tamil"), ("tamil", "iso"), ("iso", "telugu")])
@pytest.mark.parametrize("mask", [0, O.TAMIL_TRADITIONAL, O.TAMIL_SUPERSCRIPTED, O.TAMIL_TRADITIONAL | O.TAMIL_SUPERSCRIPTED])
def test_remembered_words_are_the_whole_text(source, target, mask):
    rnd = random.Random(31)
    one = K.Transliterator(source, target, mask)
    for _ in range(150):
        text = soup(rnd, source, rnd.randrange(60))
        if source == "tamil":  # words that start with the letter whose sound depends on the word before
            text = " ".join(rnd.choice(["ச", "சி", "ச்", ""]) + w for w in text.split(" "))
        assert one(text) == one.whole(text), text


@pytest.mark.parametrize("source", ["itrans", "iso", "devanagari", "tamil", "gurmukhi"])
def test_counts_are_those_of_tokens_and_units(source):
    rnd = random.Random(37)
    counter = K.counter(source)
    for _ in range(100):
        text = soup(rnd, source, rnd.randrange(60)) + rnd.choice(["", "##a##", "<b>", " # "])
        assert (counter.tokens(text), counter.units(text)) == counter.whole(text)


def test_names_modes_and_dialects():
    assert [A.parse_name(x) for x in ("Script.Hindi", "script.readablelatin", " INDIC ", "Script.x", "")] == ["hindi", "readableLatin", "indic", None, None]
    assert K.empty("ka", "nowhere", "iso") == "" and K.empty(None, "itrans", "iso") is None and K.empty("ka", "itrans", "iso") == "ka"
    assert K.mixed("telugu") == "indic" and K.mixed("iso") == "iso" and K.mixed("nowhere") == "nowhere"
    assert O.parse("TAMILtraditional,  asciinumerals", "loose") == 5 and O.parse("ASCIINumerals x", "plain") == 4 and O.add(1, 4, 5) == 5


@pytest.mark.parametrize("source,target,mask", [("itrans", "bengali", 0), ("iast", "readableLatin", 0), ("gurmukhi", "devanagari", 8), ("itrans", "tamil", 2), ("tamil", "readablelatin", 0), ("indic", "iso", 0)])
def test_remembered_pieces_are_the_whole(source, target, mask):
    """Words and chunks against the whole text, with verbatim parts, small digits and signs among the spellings."""
    rng, one = random.Random(7), K.Transliterator(source, target, mask)
    keys = [*K.reader(source).spellings]
    extra = ["-", " ", "\t", "#", "<b>", "##ka##", "####", "<", "\0", "X", "² ", "³", "க்", "(சா", "ੱ", "꣡", "Ü", "12"]
    for _ in range(400):
        text = "".join(rng.choice(extra if rng.random() < 0.2 else keys) for _ in range(rng.randint(0, 30)))
        assert one(text) == one.whole(text), text
        assert K.Counter(source, mask).units(text) == K.Counter(source, mask).whole(text)[1], text


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "MEMO_WORDS", 50)
    one = K.Transliterator("itrans", "bengali")
    for n in range(500):
        one(f"ka{n} ki{n}k {'ka' * 200}{n}")
    for memo in (one.words, one.pieces, one.after):
        assert len(memo) <= 50 and len(memo.older) <= 50 and all(len(k) <= K.MEMO_CHARS for k in memo)


def test_a_tamil_sibilant_after_a_sign_depends_on_the_word_before():
    for texts in (["கா (சொல்", "க் (சொல்"], ["க் (சொல்", "கா (சொல்"]):
        one = K.Transliterator("tamil", "iso")
        assert [one(t) for t in texts] == [one.whole(t) for t in texts]


def test_totals_count_tokens_and_runs():
    for text in ("", "kā#k x--é# <b>ka</b>##a####k̲ ka॒", "ab\0ab", "## open", "a < open", "é##é"):
        found = [len(K.reader("iso").tokens(text, mask)) for mask in (0, O.IGNORE_ACCENTS)]
        n_all, n_accents = K.Counter("iso").total(text)
        assert found == [n_all, n_all - n_accents]


@pytest.mark.parametrize(
    "source,target,mask",
    [("itrans", "thai", 0), ("itrans", "kannada", 4), ("iast", "devanagari", 0), ("iso", "readableLatin", 0), ("gurmukhi", "devanagari", 8), ("itrans", "tamil", 2), ("tamil", "readablelatin", 0), ("indic", "iso", 0)],
)
def test_batches_are_the_kernels_texts(source, target, mask):
    """Whole Arrow batches, with nulls, verbatim parts, Tamil letters and signs among the spellings, and off the array's start; words are no Python objects."""
    rng, one, batch = random.Random(11), K.Transliterator(source, target, mask), batches.Batches(source, target, mask)
    keys = [*K.reader(source).spellings]
    extra = [" ", "\n", "\t", "#", "<b>", "##ka##", "####", "<", "\0", "X", "²", "(சா", "ੱ", "꣡", "Ü", "中", "𝒳", "12"]
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(extra if rng.random() < 0.2 else keys) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 8))]
        assert batch(pa.array(["k", *texts, "k"], pa.string()).slice(1, len(texts))).to_pylist() == [one(t) for t in texts], texts
    if not one.to_tamil and not one.tamil:
        known = K.transliterator(source, target, mask)
        known.words.clear()
        assert batch(pa.array(["ka ki\nx"] * 3)).to_pylist() == [one("ka ki\nx")] * 3 and not known.words
