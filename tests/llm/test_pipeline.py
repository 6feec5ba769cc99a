"""The pipeline's stages and the queries' registration."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

from test_operators import sample_texts, words  # noqa: F401


def test_queries_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted({n.split("_")[0] for n in names}) == sorted({f"op{i}" for i in range(1, 11)} | {"pipeline"})
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_operators_run_no_python():
    for module in ("lines", "sharding"):
        text = (Path(entry.ROOT) / "lipika/llm" / f"{module}.py").read_text()
        assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas|pyarrow", text)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    langs, rows = ("en", "de"), sample_texts()
    data = [(i, t, langs[(i or 0) % 2], f"src{(i or 0) % 14}", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "pack"]
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    pieces = pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}
    assert pipeline.run(spark, folder).count() == pieces.count()


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
