"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every
operator and stage; none may crash, and each has a defined result."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithos.llm.decontam import drop_leaks, leaks
from lithos.llm.jaccard import jaccard_components, near_duplicates
from lithos.llm.langid import Ecoc, fit, identify
from lithos.llm.linededup import line_dedup
from lithos.llm.packing import pack
from lithos.llm.quality import quality
from lithos.llm.secrets import secrets
from lithos.llm.sharding import shard
from lithos.llm.toxicity import drop_toxic, score_toxicity, train_toxicity
from lithos.llm.urls import UrlRule, judge_urls

LONG = " ".join(f"word{i % 977} seven{i % 1009}" for i in range(60_000))
ROWS = [(1, "a b c", "en"), (1, "a b c", "en"), (None, "x y z w v u", None), (2, None, None), (3, "", "de"), (4, " \n\t ", "de"), (5, LONG, "en"), (6, LONG, "en"), (7, "é", "fr"), (8, "　…", "fr")]
CLASH = ("score", "spans", "removed", "rule", "verdict", "bucket", "batch", "slot", "shard", "size", "cls", "key", "sig", "words", "n_words", "h", "lo", "component_id", "rid", "bits", "unit", "n_tokens")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9)))
    rows = []
    for i in range(120):
        w = [word() for _ in range(60)]
        if i % 2:
            for bad in ("idiot", "scum", "trash"):
                w[rnd.randrange(60)] = bad
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    return train_toxicity(d, lab)


def operators(model, spark):
    ecoc = fit(["the cat and the dog", "der hund und die katze"] * 5, ["en", "de"] * 5, 50)
    bench = spark.createDataFrame([(1, "x y z w v u"), (2, None), (3, "")], "item_id long, text string")
    return {
        "op1": lambda d: quality(d), "op2": lambda d: identify(d, ecoc), "op4": lambda d: score_toxicity(d, model), "op5": lambda d: pack(d), "op6": lambda d: line_dedup(d), "op7": lambda d: jaccard_components(d),
        "op8": lambda d: shard(d, 3), "op9": lambda d: leaks(d, bench), "op10": lambda d: secrets(d),
        "op3": lambda d: judge_urls(d.withColumn("url", F.col("text")), [UrlRule("block", "com/en/")], key="doc_id"),
        "drop_toxic": lambda d: drop_toxic(d, model), "near": lambda d: near_duplicates(d), "drop_leaks": lambda d: drop_leaks(d, bench),
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "drop_toxic", "near", "drop_leaks"]
SAME_ROWS = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, docs, model, name):
    out = operators(model, spark)[name](docs)
    rows = out.collect()
    if name in SAME_ROWS:
        assert len(rows) == len(ROWS) and sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    if name == "op1":
        assert by[2][0].n_words == 0 and by[2][0].base_failed and not by[3][0].kept and by[5][0].n_words == 120_000 and by[5][0].base_failed is False
    elif name == "op2":
        assert {by[k][0].lang_pred for k in (2, 3, 4, 8)} == {"und"} and by[1][0].lang_pred in ("en", "de")
    elif name == "op3":
        assert by[2][0].verdict == "allow" and by[2][0].host == "" and by[2][0].rule is None
    elif name == "op4":
        assert by[2][0].score == by[3][0].score == 0 and by[2][0].spans == []
    elif name == "op5":
        assert by[2][0].batch is None and by[4][0].n_tokens == 0 and by[5][0].bound == by[6][0].bound == 120_000
    elif name == "op6":
        assert by[5][0].text == LONG and by[2][0].text is None and by[1][0].text == by[1][1].text == "a b c" and by[5][0].source == "s"
    elif name == "op7":
        assert by[6][0].component_id == 5 and by[5][0].component_id == 5 and by[3][0].n_shingles == 0 and by[4][0].component_id == 4 and by[None][0].component_id is None and by[1][0].n_shingles == 1
    elif name == "op8":
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(3)) and by[2][0].size == 1
    elif name == "op9":
        assert [(r.doc_id, r.item_id, r.similarity) for r in rows] == [(None, 1, 1.0)]
    elif name == "op10":
        assert by[2][0].spans == "" and by[2][0].n_hex == 0 and len(by[2][0].base_sha256) == 64
    elif name == "near":
        assert 6 not in by and len(by[1]) == 2 and len(rows) == len(ROWS) - 1
    elif name == "drop_leaks":
        assert None not in by and len(rows) == len(ROWS) - 1
    elif name == "drop_toxic":
        assert len(rows) == len(ROWS) and rows[0].score == "mine"


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, model, name):
    assert operators(model, spark)[name](docs.where("false")).count() == 0


def test_no_models_and_no_items(spark, docs):
    assert {r.lang_pred for r in identify(docs, fit([], [])).collect()} == {"und"}
    assert isinstance(fit([], []), Ecoc)
    assert leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    none = train_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in score_toxicity(docs, none).collect()) < 0.5


def test_stages_keep_columns_and_take_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, 0), (5, 0), (7, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q q q q q q")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        full, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and full.count() > 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert full.columns == docs.columns and full.dtypes == docs.dtypes
