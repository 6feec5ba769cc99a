"""The registered queries of the transliteration engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lipika.functions import alphabets as A, columns as C, kernel, options as O
from lipika.operators import relational
from lipika.plans import oracle
from lipika.sources import catalog
from lipika.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # whole texts go to Python
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(C.SLICE_BYTES))  # and come back in up to ten times their bytes
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by one key."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")


TURNS = "(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)"

#: (source, target, options) over documents, and over conversations.
DOCUMENT_DIRECTIONS = [("itrans", t, 0) for t in ("devanagari", "telugu", "bengali", "gujarati", "malayalam", "iso", "iast", "ipa", "thai")] + [("itrans", "kannada", O.ASCII_NUMERALS), ("iast", "devanagari", 0)]
TURN_DIRECTIONS = [("wx", "devanagari", 0), ("titus", "devanagari", 0), ("itrans", "burmese", 0), ("itrans", "gurmukhi", O.IGNORE_ACCENTS), ("iso", "sinhala", O.RETAIN_MARKERS), ("iso", "readableLatin", 0)]


def directed(spark: SparkSession, sf_dir: str, source: str, target: str, mask: int, turns: bool) -> DataFrame:
    df, key = (conversations(spark, sf_dir), "turn_id") if turns else (table(spark, sf_dir, "documents"), "doc_id")
    return df.select(key, C.transliterate("text", source, target, mask).alias("out"))


def by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and characters before and after, by language: the flagship query."""
    out = table(spark, sf_dir, "documents").select("lang", "text", C.transliterate("text", "itrans", "devanagari").alias("out"))
    return out.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars_in"), F.sum(F.length("out")).alias("chars_out"))


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = conversations(spark, sf_dir).select("turn_id", C.transliterate("text", "itrans", "devanagari").alias("deva"))
    return there.select("turn_id", "deva", C.transliterate("deva", "devanagari", "itrans").alias("back"))


def deva_to_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = conversations(spark, sf_dir).select("turn_id", C.transliterate("text", "itrans", "devanagari").alias("deva"))
    return there.select("turn_id", C.transliterate("deva", "devanagari", "readableLatin").alias("out"))


def tamil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To and from Tamil with its options; sequential inference, which SQL does not express."""
    df = conversations(spark, sf_dir)
    to = {f"tamil_{m}": C.transliterate("text", "itrans", "tamil", m) for m in (0, 1, 2, 3)}
    there = df.select("turn_id", *[c.alias(n) for n, c in to.items()])
    return there.withColumn("back", C.transliterate("tamil_0", "tamil", "readablelatin")).withColumn("mixed", C.transliterate("tamil_2", "indic", "iso"))


def skip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "pages").select("page_id", F.explode(C.split_skips("html")).alias("p"))
    return pieces.groupBy("page_id", F.col("p.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("p.text")).alias("chars"))


def skip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.split_skips("text")).alias("p"))
    return pieces.groupBy("doc_id", F.col("p.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("p.text")).alias("chars"))


def skip_sql(relation: str, key: str, text: str) -> str:
    return f"""
WITH cut AS (SELECT {key}, unnest(regexp_extract_all({text}, {oracle.quote(C.SKIP)})) AS p FROM {relation}),
k AS (SELECT {key}, p, CASE WHEN p LIKE '<%>' THEN 'tag' WHEN p LIKE '##%##' AND length(p) > 3 THEN 'verbatim' WHEN starts_with(p, '<') OR starts_with(p, '##') THEN 'lost' ELSE 'text' END AS kind FROM cut)
SELECT {key}, kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'verbatim' THEN length(p) - 4 ELSE length(p) END) AS BIGINT) AS chars FROM k GROUP BY ALL"""


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(C.token_counts("text", "itrans")).alias("t"))
    return found.groupBy(F.col("t.class").alias("class"), F.col("t.idx").alias("idx")).agg(F.sum("t.n").alias("n"))


def classes_sql(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(A.CLASSES)) + " END"


def units_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", C.unit_counts("text", "itrans").alias("u"))
    return counted.select("doc_id", *[F.coalesce(f"u.{n}", F.lit(0)).alias(n) for n in ("n_units", "n_mute", "n_signs")])


def relational_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational form of the stages, written out: the same as the kernel's."""
    df = conversations(spark, sf_dir)
    rows = relational.unit_rows(relational.token_rows(df, "turn_id", "text", "itrans"), "turn_id", "itrans")
    out = F.when(F.col("text").isNotNull(), F.coalesce("transliterated", F.lit("")))  # a text without units has no rows
    return df.join(relational.render_rows(rows, "turn_id", "devanagari"), "turn_id", "left").select("turn_id", out.alias("out"))


def strippers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = C.transliterate("text", "itrans", "telugu", O.RETAIN_MARKERS)
    return table(spark, sf_dir, "documents").select("doc_id", C.cleanings(text).alias("t")).select("doc_id", "t.stripped", "t.numerals", "t.plain")


def strippers_sql() -> str:
    digits = {d: str(i) for s in A.scripts().values() if s.kind != A.LATIN for i, d in enumerate(s.glyphs[A.SYMBOL][:10])}
    q = oracle.quote
    return f"""SELECT doc_id, translate(out, {q(A.MARKERS)}, '') AS stripped, translate(out, {q("".join(digits))}, {q("".join(digits.values()))}) AS numerals,
translate(out, {q("".join(A.VEDIC_ACCENTS + A.LATIN_ACCENTS))}, '') AS plain FROM {oracle.transliterate("documents", "doc_id", "text", "itrans", "telugu", O.RETAIN_MARKERS)}"""


def accent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents dropped at the source: all tokens and verbatim parts, with and without the option."""
    n = table(spark, sf_dir, "documents").select("doc_id", C.token_totals("text", "iso").alias("n"))
    return n.select("doc_id", F.coalesce("n.n_all", F.lit(0)).alias("n_all"), F.coalesce(F.col("n.n_all") - F.col("n.n_accents"), F.lit(0)).alias("n_kept"))


NAMES = ["Devanagari", "HINDI", "bangla", "odia", "Indic", "iast", "readablelatin", "klingon", "TamilExtended", "", "punjabi", "sanskrit"]
OPTION_TEXTS = ["None", "TamilTraditional", "TamilTraditional TamilSuperscripted", "ASCIINumerals,IgnoreVedicAccents", "asciinumerals", "RetainSpecialMarkers;ASCIINumerals", "A||B", "", "TamilTraditional "]


LOOSE_TEXTS = ["tamiltraditional, ASCIINUMERALS", "IgnoreVedicAccents\tRetainSpecialMarkers", "none", "", "Nothing,at  all", "TamilTraditional TamilTraditional"]
SCRIPT_TEXTS = ["Script.devanagari", "script.TAMILEXTENDED", " iast ", "Hindi", "Script.indic", "Script.", "Script.klingon", "readableLatin", "a.b.wx", ""]


def texts(spark: SparkSession, sf_dir: str, rows: list[str]) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, rows))).alias("written"))


def option_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as each dialect reads them, and the names of the mask."""
    df = texts(spark, sf_dir, LOOSE_TEXTS + OPTION_TEXTS)
    masks = df.select("r_regionkey", "written", C.option_mask("written", "loose").alias("loose"), C.option_mask("written", "plain").alias("plain"))
    return masks.select("*", F.array_join(C.option_names("loose"), " ").alias("names"))


def option_dialects_sql() -> str:
    q, known = oracle.quote, oracle.values([(k, v) for k, v in O.NAMES.items()])
    bits = " ".join(f"WHEN {v} THEN {q(k.lower())}" for k, v in O.NAMES.items() if v)
    return f"""WITH n(written) AS ({oracle.values([(x,) for x in dict.fromkeys(LOOSE_TEXTS + OPTION_TEXTS)])}), k(name, bit) AS ({known}),
l AS (SELECT written, CAST(bit_or(coalesce(bit, 0)) AS INTEGER) AS loose FROM (SELECT written, unnest(regexp_split_to_array(lower(written), '[\\s,]+')) AS p FROM n) LEFT JOIN k ON lower(name) = p GROUP BY written),
p AS (SELECT written, CAST(bit_or(coalesce(bit, 0)) AS INTEGER) AS plain FROM (SELECT written, unnest(string_split(written, ' ')) AS p FROM n) LEFT JOIN k ON name = p GROUP BY written)
SELECT r_regionkey, m.written, loose, plain, CASE WHEN loose = 0 THEN 'none' ELSE array_to_string(list_transform(list_filter([1, 2, 4, 8, 16], lambda b: loose & b <> 0), lambda b: CASE b {bits} END), ' ') END AS names
FROM region CROSS JOIN (SELECT unnest([{", ".join(q(x) for x in LOOSE_TEXTS + OPTION_TEXTS)}]) AS written) m JOIN l ON l.written = m.written JOIN p ON p.written = m.written"""


def script_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, SCRIPT_TEXTS).withColumn("script", C.parse_script("written"))


def script_parse_sql() -> str:
    known = oracle.values([(n.lower(), n) for n in A.supported_names()])
    return f"""WITH n(written) AS ({oracle.values([(x,) for x in SCRIPT_TEXTS])}), k(low, script) AS ({known})
SELECT r_regionkey, written, script FROM region CROSS JOIN n LEFT JOIN k ON low = lower(string_split(trim(written), '.')[-1])"""


def empty_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure gives an empty text, a write-only source is one, and a forced mixed source reads any alphabet."""
    df = conversations(spark, sf_dir).select("turn_id", "text", C.transliterate("text", "itrans", "telugu").alias("telugu"))
    return df.select(
        "turn_id",
        C.transliterate("text", "itrans", "devanagari", 0, "empty").alias("out"),
        C.transliterate("text", "nowhere", "iso", 0, "empty").alias("unknown"),
        C.transliterate("text", "readablelatin", "iso", 0, "empty").alias("unreadable"),
        C.transliterate("text", "readablelatin", "iso").alias("strict"),
        C.transliterate("telugu", "devanagari", "iso", force_indic=True).alias("forced"),
    )


def empty_mode_sql() -> str:
    there = oracle.transliterate(TURNS, "turn_id", "text", "itrans", "telugu")
    forced = oracle.transliterate(f"(SELECT turn_id, out AS telugu FROM {there})", "turn_id", "telugu", "indic", "iso")
    return f"""SELECT turn_id, a.out, '' AS unknown, '' AS unreadable, CAST(NULL AS VARCHAR) AS strict, b.out AS forced
FROM {oracle.transliterate(TURNS, "turn_id", "text", "itrans", "devanagari")} a JOIN {forced} b USING (turn_id)"""


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    at = F.slice(C.code_points(F.left("text", F.lit(50))), 1, 50)
    return df.select(
        "doc_id", C.char_count("text").cast("long").alias("n_chars_"), C.byte_count("text").cast("long").alias("n_bytes"), C.first_char("text").alias("first"), C.last_char("text").alias("last"),
        C.char_at("text", 7).alias("eighth"), F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum50"), F.size(C.chars("text")).cast("long").alias("n_split"),
    )


CHARACTERS_SQL = """SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_, CAST(strlen(text) AS BIGINT) AS n_bytes, left(text, 1) AS first, right(text, 1) AS last, substr(text, 8, 1) AS eighth,
CAST(coalesce(list_sum(list_transform(regexp_extract_all(left(text, 50), '(?s).'), lambda c: unicode(c))), 0) AS BIGINT) AS sum50, CAST(len(regexp_extract_all(text, '(?s).')) AS BIGINT) AS n_split FROM documents"""


def adhak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gurmukhi with doubled consonants written by their sign, read back."""
    there = conversations(spark, sf_dir).select("turn_id", C.transliterate("text", "itrans", "gurmukhi").alias("t"))
    signed = there.select("turn_id", F.regexp_replace("t", "([ਕਗਤਦਪਬਮਨਲਰਸਟ])", "ੱ$1").alias("signed"))
    return signed.select("turn_id", "signed", C.transliterate("signed", "gurmukhi", "devanagari").alias("out"))


def adhak_sql() -> str:
    there = oracle.transliterate(TURNS, "turn_id", "text", "itrans", "gurmukhi")
    signed = f"(SELECT turn_id, regexp_replace(out, '([ਕਗਤਦਪਬਮਨਲਰਸਟ])', 'ੱ\\1', 'g') AS signed FROM {there})"
    return f"SELECT s.turn_id, signed, o.out FROM {signed} s JOIN {oracle.transliterate(signed, 'turn_id', 'signed', 'gurmukhi', 'devanagari')} o USING (turn_id)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, NAMES))).alias("name"))
    return df.select("r_regionkey", "name", C.is_script_supported("name").alias("supported"), C.resolve_script("name").alias("script"))


def names_sql() -> str:
    known = oracle.values([(n.lower(), A.find(n).name) for n in A.supported_names() if n != "indic"])
    return f"""WITH n(name) AS ({oracle.values([(x,) for x in NAMES])}), k(low, script) AS ({known})
SELECT r_regionkey, name, script IS NOT NULL AS supported, script FROM region CROSS JOIN n LEFT JOIN k ON low = lower(name)"""


def script_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.script_catalog(spark)


def script_catalog_sql() -> str:
    rows = [(n, s.name, s.kind, s.vedic, n != s.name) for n in A.supported_names() if n != "indic" for s in [A.find(n)]]
    return f"SELECT * FROM ({oracle.values([*rows, ('indic', 'indic', 'indic', True, False)])}) t(name, script, kind, is_vedic, is_alias)"


def option_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, OPTION_TEXTS))).alias("options"))
    return df.select("r_regionkey", "options", C.option_mask("options").alias("mask"))


def option_masks_sql() -> str:
    known = oracle.values([*O.NAMES.items(), ("", 32)])
    delimiters = oracle.quote("[ \t,:;/|&]")
    return f"""WITH n(options) AS ({oracle.values([(x,) for x in OPTION_TEXTS])}), k(name, bit) AS ({known}),
s AS (SELECT options, regexp_split_to_array(options, {delimiters}) AS ps FROM n),
d AS (SELECT options, unnest(CASE WHEN ps[-1] = '' THEN ps[:-2] ELSE ps END) AS p FROM s),
m AS (SELECT options, CAST(bit_or(coalesce(bit, 0)) AS INTEGER) AS mask FROM d LEFT JOIN k ON k.name = p GROUP BY options)
SELECT r_regionkey, n.options, coalesce(mask, 0) AS mask FROM region CROSS JOIN n LEFT JOIN m ON m.options = n.options"""


def split_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = C.split_delimiters("text", " \n.,;")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pieces).cast("long").alias("n"), F.array_join(F.slice(pieces, 1, 3), "/").alias("head"), F.md5(F.array_join(pieces, "|").cast("binary")).alias("all_md5"))


SPLIT_SQL = """WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[ \n.,;]') AS ps FROM documents), d AS (SELECT doc_id, CASE WHEN ps[-1] = '' THEN ps[:-2] ELSE ps END AS ps FROM s)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS n, array_to_string(ps[1:3], '/') AS head, md5(array_to_string(ps, '|')) AS all_md5 FROM d"""


def untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the documents that start no spelling of the source: an anti join with its alphabet."""
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    starts = catalog.spellings(spark, "itrans").select(F.substring("spelling", 1, 1).alias("ch")).distinct()
    return chars.join(F.broadcast(starts), "ch", "left_anti")


def untranslated_sql() -> str:
    starts = oracle.values([(c,) for c in sorted({k[0] for k in kernel.reader("itrans").spellings})])
    return f"WITH k(ch) AS ({starts}) SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) WHERE ch NOT IN (SELECT ch FROM k) GROUP BY ch"


def indic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alphabet of the mixed source: the first script in order keeps a glyph."""
    order = ["devanagari", *(n for n in A.scripts() if n != "devanagari" and A.find(n).kind != A.LATIN)]
    rank = spark.createDataFrame(list(enumerate(order)), "rank int, script string")
    glyphs = catalog.alphabet(spark).where("glyph <> ''").join(F.broadcast(rank), "script")
    number = F.array_position(F.array(*map(F.lit, A.CLASSES)), F.col("class"))
    first = Window.partitionBy("glyph").orderBy("rank", number, "idx")
    return glyphs.withColumn("n", F.row_number().over(first)).where("n = 1").select("glyph", "script", "class", "idx")


def indic_union_sql() -> str:
    order = ["devanagari", *(n for n in A.scripts() if n != "devanagari" and A.find(n).kind != A.LATIN)]
    rows = oracle.values([(r, n, c, i, g) for r, n in enumerate(order) for c, row in enumerate(A.find(n).glyphs) for i, g in enumerate(row) if g])
    return f"""SELECT glyph, script, {classes_sql("c")} AS class, idx FROM ({rows}) t(r, script, c, idx, glyph) QUALIFY row_number() OVER (PARTITION BY glyph ORDER BY r, c, idx) = 1"""


def join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", C.transliterate("text", "itrans", "devanagari").alias("out"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum(F.length("out")).alias("chars"))


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select("n_nationkey", C.transliterate(F.lower("n_name"), "itrans", "devanagari").alias("nation"), C.transliterate(F.lower("r_name"), "itrans", "telugu").alias("region"))


def by_nation_sql() -> str:
    n = oracle.transliterate("(SELECT n_nationkey, lower(n_name) AS t FROM nation)", "n_nationkey", "t", "itrans", "devanagari")
    r = oracle.transliterate("(SELECT r_regionkey, lower(r_name) AS t FROM region)", "r_regionkey", "t", "itrans", "telugu")
    return f"SELECT n.n_nationkey, a.out AS nation, b.out AS region FROM nation n JOIN {n} a ON a.n_nationkey = n.n_nationkey JOIN {r} b ON b.r_regionkey = n.n_regionkey"


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream, transliterated and written until none is left, read back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lipika-stream-")
    out = f"{base}/lipika/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet" if _is_folder(spark, f"{sf_dir}/documents.parquet") else f"{sf_dir}/documents.parque[t]")
    streams.run_available(streams.transliterate_stream(stream.select("doc_id", "text"), "text", "itrans", "devanagari", into="out").drop("text"), out, f"{out}-checkpoint")
    return spark.read.schema("doc_id long, out string").parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("t"))
    return df.select("n_nationkey", C.transliterate("t", "wx", "devanagari", 0, "lenient").alias("same"), C.transliterate("t", "nowhere", "iso").alias("none"), C.transliterate("t", "itrans", "iso", 0, "lenient").alias("out"))


def lenient_sql() -> str:
    n = oracle.transliterate("(SELECT n_nationkey, lower(n_name) AS t FROM nation)", "n_nationkey", "t", "itrans", "iso")
    return f"SELECT n.n_nationkey, lower(n_name) AS same, CAST(NULL AS VARCHAR) AS none, a.out FROM nation n JOIN {n} a ON a.n_nationkey = n.n_nationkey"


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions: scalar and table function."""
    C.register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("lipika_nation")
    return spark.sql(
        """SELECT n_nationkey, transliterate(lower(n_name), 'itrans', 'devanagari', 0) AS out, count(*) AS n_tokens
        FROM lipika_nation, LATERAL translit_tokens(lower(n_name), 'itrans') t GROUP BY n_nationkey, n_name"""
    )


def sql_functions_sql() -> str:
    relation = "(SELECT n_nationkey, lower(n_name) AS t FROM nation)"
    # verbatim runs are one token in the kernel, single characters here
    return f"""SELECT a.n_nationkey, a.out, c.n AS n_tokens FROM {oracle.transliterate(relation, "n_nationkey", "t", "itrans", "devanagari")} a
JOIN (SELECT n_nationkey, count(*) FILTER (cls >= 0 OR prev >= 0 OR prev IS NULL) AS n FROM (SELECT *, lag(cls) OVER (PARTITION BY n_nationkey ORDER BY pos) AS prev FROM {oracle.tokens(relation, "n_nationkey", "t", "itrans")}) GROUP BY n_nationkey) c USING (n_nationkey)"""


def pairs() -> dict[str, tuple[Query, str | None]]:
    """Each query with its SQL."""
    out: dict[str, tuple[Query, str | None]] = {}
    for turns, directions in ((False, DOCUMENT_DIRECTIONS), (True, TURN_DIRECTIONS)):
        relation, key = (TURNS, "turn_id") if turns else ("documents", "doc_id")
        for source, target, mask in directions:
            name = f"translit_{source}_{target}".lower() + (f"_{mask}" if mask else "")
            out[name] = partial(directed, source=source, target=target, mask=mask, turns=turns), f"SELECT * FROM {oracle.transliterate(relation, key, 'text', source, target, mask)}"
    deva = oracle.transliterate(TURNS, "turn_id", "text", "itrans", "devanagari")
    docs = oracle.transliterate("documents", "doc_id", "text", "itrans", "devanagari")
    again = lambda target: oracle.transliterate(f"(SELECT turn_id, out AS deva FROM {deva})", "turn_id", "deva", "devanagari", target)
    tokens = oracle.tokens("documents", "doc_id", "text", "itrans")
    counted = oracle.units("documents", "doc_id", "text", "itrans")
    return out | {
        "translit_by_lang": (by_lang, f"SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars_in, CAST(sum(length(out)) AS BIGINT) AS chars_out FROM documents JOIN {docs} USING (doc_id) GROUP BY lang"),
        "roundtrip_itrans_devanagari": (roundtrip, f"SELECT a.turn_id, a.out AS deva, b.out AS back FROM {deva} a JOIN {again('itrans')} b USING (turn_id)"),
        "devanagari_readablelatin": (deva_to_readable, f"SELECT * FROM {again('readableLatin')}"),
        "translit_tamil": (tamil, None),
        "skip_tags_pages": (skip_pages, skip_sql("pages", "page_id", "html")),
        "skip_toggle_documents": (skip_documents, skip_sql("documents", "doc_id", "text")),
        "token_histogram": (token_histogram, f"SELECT {classes_sql('cls')} AS class, idx, count(*) AS n FROM {tokens} WHERE cls >= 0 GROUP BY cls, idx"),
        "units_per_document": (
            units_per_document,
            f"SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_mute, 0) AS n_mute, coalesce(n_signs, 0) AS n_signs FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_units, count(*) FILTER (mark = 0) AS n_mute, count(*) FILTER (sign >= 0) AS n_signs FROM {counted} WHERE cls >= 0 AND NOT (cls = {A.EXCLUSIVE} AND idx = {A.SKIP}) GROUP BY doc_id) u USING (doc_id)",
        ),
        "relational_itrans_devanagari": (relational_units, f"SELECT * FROM {deva}"),
        "strip_markers_numerals_accents": (strippers, strippers_sql()),
        "accent_filter": (accent_filter, f"SELECT doc_id, coalesce(n_all, 0) AS n_all, coalesce(n_all - n_accents, 0) AS n_kept FROM documents LEFT JOIN {oracle.token_count('documents', 'doc_id', 'text', 'iso')} USING (doc_id)"),
        "script_names": (names, names_sql()),
        "script_catalog": (script_catalog, script_catalog_sql()),
        "option_masks": (option_masks, option_masks_sql()),
        "split_delimiters": (split_delimiters, SPLIT_SQL),
        "untranslated_antijoin": (untranslated, untranslated_sql()),
        "indic_union_alphabet": (indic_union, indic_union_sql()),
        "translit_join_labels": (join_labels, f"SELECT lang, quality, count(*) AS n, CAST(sum(length(out)) AS BIGINT) AS chars FROM documents JOIN {docs} USING (doc_id) JOIN labels USING (doc_id) GROUP BY lang, quality"),
        "translit_by_nation": (by_nation, by_nation_sql()),
        "stream_translit_documents": (stream_documents, f"SELECT * FROM {docs}"),
        "option_dialects": (option_dialects, option_dialects_sql()),
        "script_parse": (script_parse, script_parse_sql()),
        "empty_mode_force_indic": (empty_mode, empty_mode_sql()),
        "characters": (characters, CHARACTERS_SQL),
        "gurmukhi_adhak": (adhak, adhak_sql()),
        "lenient_mode": (lenient, lenient_sql()),
        "sql_functions": (sql_functions, sql_functions_sql()),
    }
