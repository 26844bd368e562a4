"""Each stage of the pipeline against brute force on its own input, and run() against the last of them."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from pitchlake.llm import knn_quality, pfair_mix
from pitchlake.llm.common import materialise
from pitchlake.llm.queries import MIX_WEIGHTS
from tests.llm.test_text_operators import brute_near

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = materialise(stage(spark, docs, SF), name)
        seen[name] = (before, {r["doc_id"]: r for r in out.collect()})
        assert out.count() == len(seen[name][1])
        if name != "encode":
            assert out.columns == columns
        docs = docs if name == "encode" else out

    before, after = seen["quality"]
    all_docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    accepted = {r["doc_id"] for r in knn_quality.classify(all_docs, labels).where("predicted = 1").collect()}
    assert set(after) == accepted and len(after) < len(before)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([(i in after) == bool(q) for i, q in truth.items()]) > 0.9

    before, after = seen["exact"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert set(after) == set(first.values())

    before, after = seen["near"]
    assert set(after) == {i for i, (_, _, kept) in brute_near(before).items() if kept}

    before, after = seen["mix"]
    assert {i: r["text"] for i, r in after.items()} == before

    before, after = seen["encode"]
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for i, t in before.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert after[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    mixed = pfair_mix.mixed_positions(docs, MIX_WEIGHTS, tie=F.xxhash64("text"))
    assert {r["doc_id"]: r["position"] for r in mixed.select("row.doc_id", "position").collect()} == {i: r["position"] for i, r in after.items()}


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position"] and 100 < rows.count() < 200
    assert rows.select("position").distinct().count() == rows.count()


def folder(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    good = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["doc_id"] % 4]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in good]
    extra = [(None, None, None, None, None), (None, rows[3][1] + " of a null id", None, None, 1), (rows[5][0], rows[6][1] + " and more", "xx", "src1", 2), rows[7], rows[7]]
    path = folder(spark, tmp_path, rows + extra)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = materialise(stage(spark, docs, path), name)
        assert 0 < docs.count() <= before
        if name == "mix":
            assert docs.count() == before
    assert docs.count() == docs.select("position").distinct().count()
