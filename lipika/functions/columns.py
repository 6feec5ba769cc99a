"""Column functions over the kernel, and their SQL registration.

Directions and options are resolved when the column is made: an unknown one is a null literal and costs no Python.  The kernel runs in
Arrow batches, without shuffle; tables are compiled once in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from lipika.functions import alphabets as A, batches, kernel, options as O

TOKEN = "struct<pos:int,class:string,idx:int,kind:string,literal:string>"
UNIT = "struct<pos:int,class:string,idx:int,mark:int,sign:int,accent:int,literal:string>"


#: Bytes of text that are Python objects at a time, and that ``batches`` has in its arrays, of some fifty times as many bytes.
SLICE_BYTES, ARRAY_BYTES = 1 << 20, 1 << 18


def _slices(texts: pa.Array, make: Callable[[pa.Array], pa.Array], most: int) -> pa.Array:
    """``make`` over the texts, a slice at a time."""
    step = max(1, len(texts) * most // max(texts.nbytes, 1))
    return pa.concat_arrays([make(texts.slice(at, step)) for at in range(0, max(len(texts), 1), step)])


def _sliced(texts: pa.Array, make: Callable[[list[str | None]], pa.Array]) -> pa.Array:
    """As ``_slices``, of Python objects: a batch of long texts is never whole in Python."""
    return _slices(texts, lambda some: make(some.to_pylist()), SLICE_BYTES)


def _lists(rows: list[list[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Arrow lists of structs from rows of tuples, column by column; null for None."""
    offsets, flat = [0], []
    for row in rows:
        flat.extend(row or ())
        offsets.append(len(flat))
    columns = zip(*flat) if flat else [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=pa.array([r is None for r in rows]))


_TOKEN_FIELDS = [(n, pa.string() if n in ("class", "kind", "literal") else pa.int32()) for n in ("pos", "class", "idx", "kind", "literal")]
_UNIT_FIELDS = [(n, pa.string() if n in ("class", "literal") else pa.int32()) for n in ("pos", "class", "idx", "mark", "sign", "accent", "literal")]


def _mask(options: int | str) -> int:
    return options if isinstance(options, int) else O.parse(options)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


MODES = {"strict": kernel.transliterate, "lenient": kernel.lenient, "empty": kernel.empty}


def transliterate(text: Column | str, source: str, target: str, options: int | str = 0, mode: str = "strict", force_indic: bool = False) -> Column:
    """The text in another script.

    ``strict``: null for a null text, an unknown or write-only source, an unknown target, and where both names are the same.  ``lenient``: such
    text comes back as it is, and ``readableLatin`` and ``wx`` cannot be read.  ``empty``: empty where ``strict`` is null for another reason than a null text.
    With ``force_indic`` every source that is not Latin is read as the mixed ``indic``.  Text of any length is written whole.
    """
    if force_indic:
        source = kernel.mixed(source)
    mask = _mask(options)
    known = kernel.transliterator(source, target, mask).known
    if mode == "strict" and not known:
        return F.lit(None).cast("string")
    whole = known and mode != "lenient"
    one = MODES[mode]

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        if whole:
            return _slices(texts, batches.batches(source, target, mask), ARRAY_BYTES)
        return _sliced(texts, lambda some: pa.array([one(t, source, target, mask) for t in some], pa.string()))

    return run(_column(text).cast("string")).alias("transliterated")


def tokens(text: Column | str, source: str, options: int | str = 0) -> Column:
    """Phoneme tokens and verbatim pieces, in order; null for a null text or an unknown source."""
    mask = _mask(options)
    if kernel.reader(source) is None:
        return F.lit(None).cast(f"array<{TOKEN}>")

    def one(t: str | None) -> list[tuple] | None:
        if t is None:
            return None
        found = enumerate(kernel.reader(source).tokens(t, mask))
        return [(n, "literal", None, None, x) if isinstance(x, str) else (n, A.CLASSES[x[0]], x[1], x[2], None) for n, x in found]

    @F.arrow_udf(f"array<{TOKEN}>")
    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, lambda some: _lists([one(t) for t in some], _TOKEN_FIELDS))

    return run(_column(text).cast("string"))


def units(text: Column | str, source: str, options: int | str = 0) -> Column:
    """Written units and verbatim pieces; ignored units have class ``ignored``.  Null for a null text or an unknown source."""
    mask = _mask(options)
    if kernel.reader(source) is None:
        return F.lit(None).cast(f"array<{UNIT}>")
    slots = [*range(max(map(len, A.scripts()["devanagari"].glyphs))), None]  # -1 is an empty slot

    def one(t: str | None) -> list[tuple] | None:
        if t is None:
            return None
        out: list[tuple] = []
        for n, u in enumerate(kernel.units(kernel.reader(source).tokens(t, mask), mask)):
            if isinstance(u, str):
                out.append((n, "literal", None, None, None, None, u))
            elif u[1] < 0:
                out.append((n, "ignored", None, None, None, None, None))
            else:
                out.append((n, A.CLASSES[u[1]], u[2], slots[u[3]], slots[u[4]], slots[u[5]], None))
        return out

    @F.arrow_udf(f"array<{UNIT}>")
    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, lambda some: _lists([one(t) for t in some], _UNIT_FIELDS))

    return run(_column(text).cast("string"))


def token_counts(text: Column | str, source: str, options: int | str = 0) -> Column:
    """(class, idx, n): how often each phoneme occurs; null for a null text or an unknown source."""
    mask = _mask(options)
    if kernel.reader(source) is None:
        return F.lit(None).cast("array<struct<class:string,idx:int,n:bigint>>")

    def one(t: str | None) -> list[tuple] | None:
        return None if t is None else [(A.CLASSES[c], i, n) for (c, i), n in kernel.counter(source, mask).tokens(t).items()]

    @F.arrow_udf("array<struct<class:string,idx:int,n:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, lambda some: _lists([one(t) for t in some], [("class", pa.string()), ("idx", pa.int32()), ("n", pa.int64())]))

    return run(_column(text).cast("string"))


def _numbers(text: Column | str, source: str, names: list[str], one: Callable[[str], tuple[int, ...]]) -> Column:
    """A struct of numbers for each text; null for a null text or an unknown source."""
    kind = "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"
    if kernel.reader(source) is None:
        return F.lit(None).cast(kind)

    def some(texts: list[str | None]) -> pa.Array:
        rows = [None if t is None else one(t) for t in texts]
        columns = [pa.array([None if r is None else r[i] for r in rows], pa.int64()) for i in range(len(names))]
        return pa.StructArray.from_arrays(columns, names=names, mask=pa.array([r is None for r in rows]))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, some)

    return run(_column(text).cast("string"))


def token_totals(text: Column | str, source: str) -> Column:
    """(n_all, n_accents): tokens with verbatim pieces, and accents among them; counted without making the tokens."""
    return _numbers(text, source, ["n_all", "n_accents"], lambda t: kernel.counter(source).total(t))


def unit_counts(text: Column | str, source: str, options: int | str = 0) -> Column:
    """(n_units, n_mute, n_signs): written units, those with a mute consonant and those with a sign; null for a null text or an unknown source."""
    mask = _mask(options)
    return _numbers(text, source, ["n_units", "n_mute", "n_signs"], lambda t: kernel.counter(source, mask).units(t))


# ---- built-in functions only

def chars(text: Column | str) -> Column:
    """The text's code points, as an array of one-character strings."""
    return F.filter(F.split(_column(text), ""), lambda c: c != "")


def char_count(text: Column | str) -> Column:
    return F.length(_column(text))


def byte_count(text: Column | str) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(_column(text))


def first_char(text: Column | str) -> Column:
    return F.left(_column(text), F.lit(1))


def last_char(text: Column | str) -> Column:
    return F.right(_column(text), F.lit(1))


def char_at(text: Column | str, at: int) -> Column:
    """The code point at a place from 0; empty beyond the end."""
    return F.substring(_column(text), at + 1, 1)


def code_points(text: Column | str) -> Column:
    """The numbers of the text's code points."""
    return F.transform(chars(text), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


#: Verbatim markup, closed or not; verbatim text between ``##``, closed or not; any other character.
SKIP = r"(?s)<[^>]*>|##(?:[^#]|#[^#])*##|<.*|##.*|[^<#]+|."


def split_skips(text: Column | str) -> Column:
    """Pieces of a text: (kind, text) with kind ``tag``, ``verbatim`` (without its ``##``), ``lost`` (unclosed, to the end) or ``text``."""
    pieces = F.regexp_extract_all(_column(text), F.lit(SKIP), F.lit(0))

    def kind(p: Column) -> Column:
        return (
            F.when(p.startswith("<") & p.endswith(">"), "tag")
            .when(p.startswith("##") & p.endswith("##") & (F.length(p) > 3), "verbatim")
            .when(p.startswith("<") | p.startswith("##"), "lost")
            .otherwise("text")
        )

    return F.transform(
        pieces, lambda p: F.struct(kind(p).alias("kind"), F.when(kind(p) == "verbatim", F.substring(p, F.lit(3), F.length(p) - 4)).otherwise(p).alias("text"))
    )


def strip_markers(text: Column | str) -> Column:
    """The text without special markers."""
    return F.translate(_column(text), A.MARKERS, "")


def ascii_numerals(text: Column | str) -> Column:
    """Digits of all scripts as ASCII digits."""
    found = {d: str(i) for s in A.scripts().values() if s.kind != A.LATIN for i, d in enumerate(s.glyphs[A.SYMBOL][:10])}
    return F.translate(_column(text), "".join(found), "".join(found.values()))


def drop_accents(text: Column | str) -> Column:
    """The text without Vedic accents."""
    return F.translate(_column(text), "".join(A.VEDIC_ACCENTS + A.LATIN_ACCENTS), "")


def cleanings(text: Column | str) -> Column:
    """(stripped, numerals, plain): what ``strip_markers``, ``ascii_numerals`` and ``drop_accents`` give, in one pass of Python beside a transliteration.

    ``translate`` looks every character up; a pattern finds the few that change.
    """
    digits = {ord(d): str(i) for s in A.scripts().values() if s.kind != A.LATIN for i, d in enumerate(s.glyphs[A.SYMBOL][:10])}
    markers, accents = (_any_of(cs) for cs in (A.MARKERS, "".join(A.VEDIC_ACCENTS + A.LATIN_ACCENTS)))
    numerals = _any_of(map(chr, digits))

    def some(texts: list[str | None]) -> pa.Array:
        made = [
            [t and re.sub(markers, "", t) for t in texts],
            [t and re.sub(numerals, lambda m: m[0].translate(digits), t) for t in texts],
            [t and re.sub(accents, "", t) for t in texts],
        ]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in made], names=["stripped", "numerals", "plain"])

    @F.arrow_udf("struct<stripped:string,numerals:string,plain:string>")
    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, some)

    return run(_column(text).cast("string"))


def _any_of(chars: Iterable[str]) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]+"


def is_script_supported(name: Column | str) -> Column:
    """Whether a script or alias has the name, without regard to case; ``indic`` is none."""
    return F.lower(_column(name)).isin([n.lower() for n in A.supported_names() if n != "indic"])


def resolve_script(name: Column | str) -> Column:
    """The script's own name for a name or alias, null if there is none."""
    known = F.create_map(*[F.lit(x) for n in A.supported_names() if n != "indic" for x in (n.lower(), A.find(n).name)])
    return F.try_element_at(known, F.lower(_column(name)))


def parse_script(name: Column | str) -> Column:
    """The registered name of a script, alias or ``indic`` written in any case, also as ``Script.name``; null if there is none."""
    known = F.create_map(*[F.lit(x) for n in A.supported_names() for x in (n.lower(), n)])
    return F.try_element_at(known, F.element_at(F.split(F.lower(F.btrim(_column(name))), r"\."), -1))


def option_names(mask: Column | str) -> Column:
    """Lower-case names of a mask's options, ``none`` if it has none."""
    found = F.array_compact(F.array(*[F.when(_column(mask).bitwiseAND(v) != 0, k.lower()) for k, v in O.NAMES.items() if v]))
    return F.when(_column(mask).isNotNull(), F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found))


def option_mask(text: Column | str, dialect: str = "strict") -> Column:
    """The mask of option names (``options.parse``): ``strict`` names split at a set of delimiters, ``loose`` ones without regard to case at white
    space and commas, ``plain`` ones at single spaces."""
    names = {k.lower(): v for k, v in O.NAMES.items()} if dialect == "loose" else O.NAMES
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)], *([F.lit(""), F.lit(32)] if dialect == "strict" else []))
    if dialect == "strict":
        pieces = split_delimiters(text)
    else:
        pieces = F.split(F.lower(_column(text)), r"[\s,]+") if dialect == "loose" else F.split(_column(text), " ")
    return F.aggregate(pieces, F.lit(0), lambda a, p: a.bitwiseOR(F.coalesce(F.try_element_at(known, p), F.lit(0))))


def split_delimiters(text: Column | str, delimiters: str = O.DELIMITERS) -> Column:
    """Pieces between any of the delimiters; empty ones stay, but for a last empty one."""
    pieces = F.split(_column(text), "[" + re.escape(delimiters) + "]", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def register(spark: SparkSession) -> None:
    """SQL functions ``transliterate(text, source, target, options)``, ``transliterate_lenient``, ``transliterate_or_empty``, ``translit_options_strict`` (``_loose``, ``_plain``) and the table function ``translit_tokens(text, source)``."""

    def scalar(one):
        @F.arrow_udf("string")
        def run(texts: pa.Array, sources: pa.Array, targets: pa.Array, masks: pa.Array) -> pa.Array:
            rows = zip(texts.to_pylist(), sources.to_pylist(), targets.to_pylist(), masks.to_pylist())
            return pa.array([None if t is None or s is None or d is None else one(t, s, d, m or 0) for t, s, d, m in rows], pa.string())

        return run

    spark.udf.register("transliterate", scalar(kernel.transliterate))
    spark.udf.register("transliterate_lenient", scalar(kernel.lenient))
    spark.udf.register("transliterate_or_empty", scalar(kernel.empty))

    def parsed(dialect: str):
        @F.arrow_udf("int")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else O.parse(t, dialect) for t in texts.to_pylist()], pa.int32())

        return run

    for dialect in ("strict", "loose", "plain"):
        spark.udf.register(f"translit_options_{dialect}", parsed(dialect))

    class Tokens:
        def eval(self, text: str, source: str):
            found = kernel.reader(source) if source else None
            for n, x in enumerate(found.tokens(text) if found and text is not None else ()):
                yield (n, "literal", None, None, x) if isinstance(x, str) else (n, A.CLASSES[x[0]], x[1], x[2], None)

    spark.udtf.register("translit_tokens", F.udtf(Tokens, returnType="pos int, class string, idx int, kind string, literal string"))
