"""The pipeline's stages: columns, what stays and what goes, on a small corpus with known cases."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    at = tmp_path_factory.mktemp("sf")
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    rows = [[i, prose(150), "en", f"s{i % 3}"] for i in range(600)]
    for i in range(0, 300, 5):
        w = rows[i][1].split()
        w[10], w[60], w[100], w[140] = "vile", "nasty", "vile", "nasty"
        rows[i][1] = " ".join(w)
    rows[601:] = [[601, rows[1][1], "en", "s0"], [602, rows[2][1] + " end", "en", "s1"], [603, prose(50) + " " + item + " " + prose(50), "en", "s2"], [604, prose(60) + " write to jo.doe@mail.example.com today", "en", "s2"]]
    docs = spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 300 and i % 5 == 0)) for i in range(0, 600) if i % 2 == 0 or i % 5 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    toxic, *rest = [f(spark, docs, folder) for _, f in corpus_pipeline.STAGES[:-1]]
    assert all(d.columns == docs.columns for d in (toxic, *rest))
    kept = {r.doc_id for r in toxic.collect()}
    assert not [i for i in range(0, 300, 5) if i in kept] and len(kept) >= 540
    kept = {r.doc_id for r in rest[0].collect()}
    assert {601, 602}.isdisjoint(kept) and len(kept) == docs.count() - 2
    kept = {r.doc_id for r in rest[1].collect()}
    assert 603 not in kept and len(kept) == docs.count() - 1
    text = {r.doc_id: r for r in rest[2].collect()}
    assert "[EMAIL]" in text[604].text and "jo.doe" not in text[604].text and text[604].n_chars == len(text[604].text) and len(text) == docs.count()


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r.source for r in got} == {"s0", "s1", "s2"} and not any("jo.doe" in r.text for r in got)
    assert all(0 not in r.doc_ids and 603 not in r.doc_ids for r in got)
