import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm.staging import checkpoint_dir, staged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: copies, near copies, junk, a repeated passage, odd rows, a column with a name of our own."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8)))
    passage, rows = " ".join(word() for _ in range(60)), []
    for i in range(240):
        w = [word() for _ in range(r.randint(30, 90))]
        text = " ".join(w)
        if i % 6 == 0:
            text = " ".join(x + "***" for x in w)
        elif i % 10 == 1:
            text = f"{text} {passage} {word()}"
        elif i % 10 == 3 and i > 20:
            text = rows[-2][1]
        rows.append((i, text, "en", "abc"[i % 3] if i % 4 else None, len(text), "x"))
    rows += [(900, None, None, None, None, "x"), (901, "", "en", "a", 0, "x"), (902, "word " * 30_000, "en", "a", 150_000, "x"), (5, *rows[5][1:])]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, folder))
        assert docs.columns == columns
        counts[name] = docs.count()
        assert docs.select("doc_id").distinct().exceptAll(before.select("doc_id").distinct()).count() == 0
        if name == "quality":
            ids = {x["doc_id"] for x in docs.collect()}
            assert {i for i in range(240) if i % 6} - ids == set() and len([i for i in range(0, 240, 6) if i in ids]) <= 2
        if name == "near_duplicates":
            assert docs.where("doc_id < 240").groupBy("text").count().where("count > 1 and text is not null").where(F.length("text") > 0).count() <= 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    used = pieces.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert used["s"] - used["n"] / 1024 < 2
    run = corpus_pipeline.run(spark, folder)
    assert run.columns == pieces.columns and run.agg(F.sum("length")).first()[0] == used["n"]


def test_stages_of_nothing(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_staging_follows_the_session(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    assert checkpoint_dir(spark)
    assert staged(spark.range(3)).count() == 3
