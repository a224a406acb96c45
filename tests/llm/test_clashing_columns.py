"""Stages of the pipeline keep extra columns, whatever their names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accordance.llm import common, decontaminate, language, near_dup, personal

NAMES = (
    "rejected", "score", "lang_pred", "block", "packed", "n_words", "items", "contaminated", "found", "_candidates", "_set", "_kept",
    "_of", "_several", "_blank", "set_id", "component", "slot", "a b", "spans",
)
PLAIN = "this is a plain english sentence about nothing at all with some more words number "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, PLAIN + str(k), "en", "s") for k in range(40)] + [(50, None, "en", "s"), (51, "", None, None), (None, PLAIN + "x", "en", "s")]
    rows += [(7, PLAIN + "7", "en", "s"), (60, "mail me at joe.doe@example.org now please", "en", "s")]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return base.withColumns({n: F.lit(n) for n in NAMES})


def stages():
    return [
        language.keep_known,
        near_dup.keep_one,
        lambda d: decontaminate.keep_clean(d, d.sparkSession.createDataFrame([("i", "a benchmark text " * 9)], "item_id string, text string")),
        personal.mask_documents,
    ]


@pytest.mark.parametrize("k", range(4))
def test_other_columns_come_back(docs, k):
    out = stages()[k](docs)
    assert out.columns == docs.columns and out.schema["a b"].dataType == docs.schema["a b"].dataType
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in NAMES)


@pytest.mark.parametrize("k", range(4))
def test_empty_tables(docs, k):
    assert stages()[k](docs.where("false")).collect() == []


def test_whole_pipeline_with_null_and_repeated_ids_and_empty(spark, docs, tmp_path):
    benchmark = spark.createDataFrame([("i", "a benchmark text " * 9)], "item_id string, text string")
    for name, table in (("some", docs.drop("a b")), ("none", docs.drop("a b").where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == (name == "some")
        assert all(r["n_tokens"] > 0 for r in out)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Remote:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Remote()
        conf = type("C", (), {"get": staticmethod(lambda key, other: other)})

    with pytest.raises(ValueError):
        common.shared_folder(Session())
