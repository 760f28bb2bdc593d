import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lumenframe.llm.base import saved


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = saved(stage(spark, docs, d), name)
    return out


def test_stages_return_documents_and_keep_what_they_should(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert tuple(stages[name].columns) == corpus_pipeline.COLUMNS
    assert stages["language"].count() == stages["documents"].where(r"text rlike '\\p{L}'").count()
    assert stages["personal_data"].count() == stages["near_dedup"].count()
    assert stages["near_dedup"].select("doc_id").distinct().count() == stages["near_dedup"].count()


def test_no_personal_data_is_left(stages):
    from lumenframe.llm.pii import find_pii

    assert find_pii(stages["near_dedup"]).where("size(pii) > 0").count() > 0
    assert find_pii(stages["personal_data"]).where("size(pii) > 0").count() == 0


def test_mixture_keeps_the_word_total(stages):
    words = lambda df: df.selectExpr(r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+'))").first()[0]
    assert abs(words(stages["mixture"]) - words(stages["personal_data"])) <= 20


def test_packing_is_gapless(stages):
    by = stages["packing"].toPandas().sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id")["length"].cumsum() - by["length"]) == by["offset"]).all()
    assert np.array_equal(np.unique(by["sequence_id"]), np.arange(by["sequence_id"].max() + 1))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(got) == key(stages["packing"])


def test_odd_and_empty_tables_pass_every_stage(spark, odd, none):
    for table in (odd, none):
        docs = table.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, ""), "odd")
        assert (docs.count() > 0) == (table is odd)


def test_rows_without_an_id_are_kept(spark):
    rows = [(None, "a text of its own kind", "en", "s", 22), (1, "another text of another kind", "en", "s", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2


def test_one_row_of_a_component_is_kept(spark):
    words = " ".join(f"word{i}" for i in range(60))
    lone = " ".join(f"lone{i}" for i in range(60))
    texts = [(5, words), (5, words), (None, words), (7, words.replace("word59", "other")), (None, lone), (None, lone), (None, lone.replace("lone59", "other")), (3, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "5", "None"]
    ids = [r["component_id"] for r in corpus_pipeline.near_duplicates(docs.where("doc_id IS NULL OR doc_id = 3").unionByName(docs.limit(1).selectExpr("9L AS doc_id", f"'{lone.replace('lone58 lone59', 'last')}' AS text", "lang", "source", "n_chars"))).collect()]
    assert sorted(map(str, ids)).count("9") == 4  # rows without an id link with document 9


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
