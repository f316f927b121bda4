"""The stages of the pipeline on a small corpus with planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, WORDS, empty, untidy


def text_of(i, n):
    """Texts of which no two are alike."""
    rng = np.random.default_rng(i)
    return " ".join(WORDS[a] + str(b) for a, b in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 17, n), strict=True))


@pytest.fixture()
def corpus(spark, tmp_path):
    rows = [(i, text_of(i, 120), "en", "a", 0) for i in range(120)]
    rows += [(200 + i, text_of(i, 120) + " vilefool rotbrain scumm " + text_of(i, 9), "en", "a", 0) for i in range(20)]
    rows += [(300 + i, text_of(i, 120) + " last words", "en", "a", 0) for i in range(10)]
    rows += [(400, text_of(3, 60) + " mail me.now@mail1.example.com " + text_of(5, 60), "en", "a", 0)]
    rows += [(500, "few words", "en", "a", 0), (501, " ".join(w + "###$$$" for w in text_of(9, 120).split()), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.col("doc_id").between(200, 219).cast("int").alias("toxic")).where("doc_id % 5 <> 0").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs


def test_decisions_take_effect(spark, corpus):
    folder, docs = corpus
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        seen.append({r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()})
        docs = after
    assert seen[0] == set(range(200, 220))
    assert {500, 501} <= seen[1] and not seen[1] & set(range(100))
    assert seen[2] == set(range(300, 310)) and seen[3] == set()
    assert "me.now@mail1" not in docs.where("doc_id = 400").first()["text"]


def test_run_packs_what_is_left(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    left = {r["doc_id"] for r in rows}
    assert not left & {*range(200, 220), *range(300, 310), 500, 501} and {*range(100), 400} <= left


def test_rows_are_judged_whatever_their_ids(spark, corpus, tmp_path):
    """Rows without an id, a repeated row, and rows of other texts under an id that is there."""
    folder, docs = corpus
    toxic, poor = (" vilefool rotbrain scumm " + text_of(2, 9)), " ".join(w + "###$$$" for w in text_of(9, 120).split())
    gone = [(None, text_of(900, 120) + toxic), (None, "few words"), (None, poor), (None, text_of(40, 120) + " last words")]
    gone += [(10, text_of(901, 120) + toxic), (15, poor), (95, text_of(30, 120) + " last words")]
    stay = [(None, text_of(902, 120)), (130, text_of(903, 120)), (130, text_of(904, 120)), (10, text_of(10, 120)), (15, text_of(15, 120)), (95, text_of(95, 120)), (40, text_of(40, 120)), (30, text_of(30, 120))]
    more = [(i, t, "en", "a", 0) for i, t in [*gone, *stay[:3], (20, text_of(20, 120))]]
    docs = spark.createDataFrame(more, docs.schema).union(docs)
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert not set(gone) & set(left)
    assert all(left.count(x) == 1 for x in [*stay, (20, text_of(20, 120))])


@pytest.mark.parametrize("make", [untidy, empty])
def test_stages_take_untidy_and_empty_tables(spark, tmp_path, make):
    docs = make(spark)
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
