"""The pipeline against plain Python on the smallest tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline as P
import public_tokenizers
from duelframe.llm.mixing import mix_plan
from duelframe.llm.quality import classify
from duelframe.llm.queries import QUERIES
from duelframe.llm.tables import table
from duelframe.session import stored
from helpers import DOC, documents, prose
from pyspark.sql import functions as F
from test_ngram_join import brute
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    results = []
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SMALL))
        results.append((name, docs))
        if name != P.STAGES[-1][0]:
            assert docs.columns == names
    kept = {name: df.collect() for name, df in results}
    scores = {r["id"]: r["score"] for r in classify(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).collect()}
    want = {i for i in rows if scores[i] >= P.LEAST_QUALITY}
    assert {r["doc_id"] for r in kept["quality"]} == want
    first = {}
    for i in sorted(want):
        first.setdefault(rows[i], i)
    want = set(first.values())
    assert {r["doc_id"] for r in kept["exact_dedup"]} == want
    want = {d for d, _, least in brute([(i, rows[i]) for i in sorted(want)]) if d == least}
    assert {r["doc_id"] for r in kept["near_dedup"]} == want
    taken = {r["id"]: r["taken"] for r in mix_plan(results[2][1]).collect()}
    words = dict.fromkeys(taken, 0)
    for r in kept["mixing"]:
        words[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert words == taken
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in kept["mixing"]]
    assert sorted((r["doc_id"], list(r["ids"])) for r in kept["token_ids"]) == sorted(ids)
    assert {r["ids_sha256"] for r in kept["token_ids"]} == {hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for _, x in ids}


def test_run_and_empty_documents(spark):
    out = P.run(spark, SMALL)
    assert out.count() > 100 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    docs = spark.createDataFrame([], DOC)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_quality_stage_keeps_what_op4_predicts_as_good(spark, tmp_path):
    rows = [(i, f"some text number {i}") for i in range(12)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    # labels of one class alone: every score is the prior 1 / (n + 2), between 0.05 and 0.5
    spark.createDataFrame([(i, 0) for i in range(12)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    scored = QUERIES["op4_quality"](spark, str(tmp_path)).collect()
    assert all(0.05 < r["score"] < 0.5 and r["predicted"] == 0 for r in scored) and len(scored) == 12
    assert P.quality_stage(spark, documents(spark, rows), str(tmp_path)).count() == 0


def test_odd_rows_and_extra_columns(spark, tmp_path):
    words = [prose(i, 40) for i in range(30)]
    rows = [(i, w, "s" if i % 3 else "t") for i, w in enumerate(words)]
    rows += [(100, None, "s"), (101, "", "s"), (102, " \n ", None), (103, words[3], "t"), (104, words[4] + " more", "s"), (5, words[5], "s"), (5, words[5], "s"),
             (None, prose(77, 50), "t"), (105, "word " * 120_000, "s"), (106, "x", None)]
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in ("row", "id", "score", "size", "node", "shard", "token", "f")})
    spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(30)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    names, ids = docs.columns, {}
    for name, stage in P.STAGES:
        if name == "quality":
            assert set(stage(spark, docs, str(tmp_path)).columns) == set(names)
            continue  # these labels say nothing about the texts: all go on
        docs = stored(stage(spark, docs, str(tmp_path)))
        if name != "token_ids":
            assert docs.columns == names
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    # null and empty texts are equal; so are repeated rows and copies; texts of other blanks are texts
    assert sorted(ids["exact_dedup"], key=str) == sorted([*range(30), 100, 102, 104, None, 105, 106], key=str)
    assert sorted(ids["near_dedup"], key=str) == sorted([*range(30), 100, 102, None, 105, 106], key=str)
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and len(ids["token_ids"]) == len(ids["mixing"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    whole = [r for r in docs.collect() if list(r["ids"]) == want[r["doc_id"]]]
    assert len(whole) >= 25 and all(len(r["ids"]) == r["n_tokens"] for r in docs.collect())
