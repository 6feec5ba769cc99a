"""Column functions, relational stages, sources, streams and SQL on Spark."""

import json

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lipika.functions import alphabets as A, columns as C, kernel as K
from lipika.operators import relational as R
from lipika.plans import oracle, queries
from lipika.sources import catalog
from lipika.streaming import streams

TEXTS = [None, "", "ka", "namaste jagat!", "<b>ka</b> ##ka## kaM", "aM ki_i na####ka", "x SRI # ka <open", "~Na n*ga K^a 12 || OM", "W ÄÖ ka" * 50]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")


def test_column(texts):
    got = texts.select("k", C.transliterate("text", "itrans", "devanagari").alias("o"), C.transliterate("text", "itrans", "nowhere").alias("n")).collect()
    assert {r["k"]: r["o"] for r in got} == {k: K.transliterate(t, "itrans", "devanagari") for k, t in enumerate(TEXTS)}
    assert all(r["n"] is None for r in got)


def test_empty_table(texts):
    none = texts.limit(0)
    assert none.select(C.transliterate("text", "itrans", "iso")).collect() == []
    assert R.token_rows(none, "k", "text", "itrans").collect() == []


@pytest.mark.parametrize("source,target", [("itrans", "devanagari"), ("itrans", "readableLatin"), ("iso", "telugu"), ("iast", "burmese")])
def test_relational_form_is_the_kernel(texts, source, target):
    rows = R.render_rows(R.unit_rows(R.token_rows(texts, "k", "text", source), "k", source), "k", target).collect()
    want = {k: K.transliterate(t, source, target) for k, t in enumerate(TEXTS) if t and K.reader(source).tokens(t)}
    assert {r["k"]: r["transliterated"] for r in rows} == want


def test_relational_indic_source(spark):
    texts = ["पंक्ती कर्म ॐ", "अंः", "ा कि"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = R.render_rows(R.unit_rows(R.token_rows(df, "k", "text", "devanagari"), "k", "devanagari"), "k", "iso").collect()
    assert {r["k"]: r["transliterated"] for r in rows} == {k: K.transliterate(t, "devanagari", "iso") for k, t in enumerate(texts)}


def test_stages(texts):
    row = texts.where("k = 4").select(C.split_skips("text").alias("s"), C.tokens("text", "itrans").alias("t"), C.units("text", "itrans").alias("u")).first()
    assert [(p["kind"], p["text"]) for p in row["s"]] == [("tag", "<b>"), ("text", "ka"), ("tag", "</b>"), ("text", " "), ("verbatim", "ka"), ("text", " kaM")]
    assert [t["class"] for t in row["t"]][:3] == ["literal", "consonant", "vowel"]
    assert row["u"][-1]["sign"] == 1


def test_helpers(spark):
    row = spark.range(1).select(
        C.strip_markers(F.lit("aʼb")).alias("a"), C.ascii_numerals(F.lit("१౨")).alias("b"), C.drop_accents(F.lit("क॒")).alias("c"),
        C.is_script_supported(F.lit("Hindi")).alias("d"), C.is_script_supported(F.lit("indic")).alias("e"), C.resolve_script(F.lit("odia")).alias("f"),
        C.option_mask(F.lit("TamilTraditional,ASCIINumerals")).alias("g"),
    ).first()
    assert tuple(row) == ("ab", "12", "क", True, False, "oriya", 5)


def test_sql(spark):
    C.register(spark)
    assert spark.sql("SELECT transliterate('ka', 'itrans', 'telugu', 0)").first()[0] == "క"
    assert spark.sql("SELECT transliterate(NULL, 'itrans', 'telugu', 0)").first()[0] is None
    assert spark.sql("SELECT count(*) FROM translit_tokens('kaM', 'itrans')").first()[0] == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ka\nnamaste\n")
    streams.run_available(streams.lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"क", "नमस्ते"}


def test_sources(spark, tmp_path):
    case = [{"description": "d", "script": "itrans", "text": "ka", "targets": [{"script": "telugu", "text": "క"}]}]
    (tmp_path / "c.json").write_text("/* cases */ " + json.dumps(case, indent=1))
    df = catalog.test_cases(spark, str(tmp_path / "c.json")).select("text", F.explode("targets").alias("t"))
    assert df.select("text", "t.script", "t.text").collect() == [("ka", "telugu", "క")]
    (tmp_path / "w.txt").write_text("a\nb")
    assert catalog.whole_texts(spark, str(tmp_path / "w.txt")).select("text").first()[0] == "a\nb"
    assert catalog.alphabet(spark).where("script = 'tamil' AND class = 'consonant'").count() == 50


def test_transliteration_needs_no_shuffle(texts):
    plan = texts.select(C.transliterate("text", "itrans", "iso"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_queries_match_their_sql(spark, tmp_path):
    """Every query against its SQL on small tables."""
    long = [(i, t or "", "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    tables = {
        "documents": (long, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a", "<p>ka ## <b>x</b> ##y"), (2, "http://b", "plain")], "page_id long, url string, html string"),
        "conversations": ([(i, 0, "user", t or "") for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string"),
        "nation": ([(0, "ALGERIA", 0), (1, "INDIA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    con = duckdb.connect()
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, (query, sql) in queries.pairs().items():
        df = query(spark, str(tmp_path))
        rows = sorted(map(str, ([r[c] for c in sorted(df.columns)] for r in df.collect())))
        if sql:
            found = con.execute(sql)
            order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
            assert rows == sorted(str([r[i] for i in order]) for r in found.fetchall()), name


def test_iast_is_read_from_documents(spark, tmp_path):
    """Whole documents, very long ones and upper case too, against the kernel and SQL."""
    texts = [None, "", "Kṛṣṇa ĀTMĀ aï", "<b>ka</b> ##ka## kaṃ 12", "namaste JAGAT! " * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = queries.pairs()["translit_iast_devanagari"]
    got = {r["doc_id"]: r["out"] for r in query(spark, str(tmp_path)).collect()}
    assert got == {i: K.transliterate(t, "iast", "devanagari") for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute(sql).fetchall()) == got


def test_sql_form_of_every_indic_target():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 1 AS k, 'namaste paMktI ~Na 12' AS x")
    for target in ("assamese", "khmer", "tibetan", "sinhala", "tamilExtended", "titus", "wx"):
        got = con.execute(f"SELECT out FROM {oracle.transliterate('t', 'k', 'x', 'itrans', target)}").fetchone()[0]
        assert got == K.transliterate("namaste paMktI ~Na 12", "itrans", target)


def test_long_batches_are_read_in_slices(spark, monkeypatch):
    """What a batch of long texts makes in Python stays bounded; results are the same."""
    import pyarrow as pa

    most = []
    got = C._sliced(pa.array(["ka" * 1000, None, "ki"] * 2000), lambda some: most.append(sum(len(t or "") for t in some)) or pa.array(some))
    assert got.to_pylist() == ["ka" * 1000, None, "ki"] * 2000 and max(most) < 2 * C.SLICE_BYTES and len(most) > 1
    assert C._sliced(pa.array([], pa.string()), lambda some: pa.array(some, pa.string())).to_pylist() == []


def test_accents_and_units_of_null_texts_are_counted_as_sql_does(spark, tmp_path):
    texts = [None, "", "kā#k x--é# <b>ka</b>##a####k̲ ka॒", "é KA" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("accent_filter", "units_per_document"):
        query, sql = queries.pairs()[name]
        df = query(spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(sql).fetchall()), name
        assert "array<struct" not in df._jdf.queryExecution().analyzed().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_relational_units_cut_texts_once(texts):
    """Slots come from windows: the texts are not read and cut again for a join of the units with themselves."""
    plan = R.unit_rows(R.token_rows(texts, "k", "text", "itrans"), "k", "itrans")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


@pytest.mark.parametrize("source", ["itrans", "iso", "devanagari"])
def test_spelling_pattern_cuts_as_the_pattern_of_the_sql(spark, source):
    texts = [t for t in TEXTS if t] + ["a##b#c##d ## e", "x<y", "###a##", "".join(K.reader(source).spellings), "ka##" + "é#x" * 5000 + "##ka"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    con = duckdb.connect()
    for (text,), row in zip(df.collect(), df.select(F.regexp_extract_all("t", F.lit(R.spelling_pattern(source)), F.lit(0))).collect()):
        assert row[0] == con.execute("SELECT regexp_extract_all(?, ?)", [text, R.piece_pattern(source)]).fetchone()[0]


def test_cleanings_are_what_translate_gives(spark):
    """All three in one pass of Python over the transliterated text, as the registered query asks for them."""
    marks = A.MARKERS + "".join(A.VEDIC_ACCENTS + A.LATIN_ACCENTS)
    df = spark.createDataFrame([(t,) for t in (None, "", "a", f"x{marks}1२३ ౪5{marks[::-1]}𑓑", *(t for t in TEXTS if t))], "t string")
    got = df.select(C.cleanings("t").alias("c"), C.strip_markers("t").alias("a"), C.ascii_numerals("t").alias("b"), C.drop_accents("t").alias("d")).collect()
    assert [tuple(r["c"]) for r in got] == [(r["a"], r["b"], r["d"]) for r in got]
    spark.createDataFrame([(1, "ka")], "doc_id long, text string").createOrReplaceTempView("one")
    plan = spark.table("one").select(C.cleanings(C.transliterate("text", "itrans", "telugu")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batches_to_python_are_bounded_in_bytes(spark):
    queries.table(spark, "/root/testdata/sf0.001", "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == C.SLICE_BYTES
    seen = []
    C._slices(pa.array(["ka" * 50_000] * 40), lambda some: seen.append(some.nbytes) or some, C.ARRAY_BYTES)
    assert max(seen) <= 2 * C.ARRAY_BYTES and len(seen) > 10
