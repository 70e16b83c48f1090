from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from duelframe.llm import bpe
from duelframe.llm.queries import VOCABULARY
from duelframe.session import BATCH_BYTES
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, encoding="utf-8").read()))
TEXTS = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaa" * 40, "It's  we'll\n\n\tgo  ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext",
         "日本語 текст ñandú 🏳️‍🌈 ̀​  \x1c\x85\x00", "0123456789 3.14 ½ ²", prose(1, 3000), "\n" * 999, "!?;" * 300]


def test_ids_and_decoding_equal_the_library():
    ids = ENCODER.encode(TEXTS)
    want = [e.ids for e in LIBRARY.encode_batch(TEXTS, add_special_tokens=False)]
    assert [x.tolist() for x in ids] == want
    assert [ENCODER.decode(x) for x in want] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want] == TEXTS


def test_every_code_point_block():
    texts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 64 * 19)]
    assert [x.tolist() for x in ENCODER.encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '\n<|endoftext|>", max_size=60), max_size=8))
def test_any_text(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_lone_bytes_decode_like_the_library():
    for ids in ([200, 201], [0xE9 % 256], [50256, 15], list(range(180, 256))):
        assert ENCODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_columns(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[4]])]
    df = documents(spark, rows).withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    out = df.select("doc_id", "text", bpe.encode_and_decode(spark, F.col("text"), VOCABULARY, slice_chars=50).alias("t"),
                    bpe.encode(spark, F.col("text"), VOCABULARY).alias("e"))
    out = out.withColumn("d", bpe.decode(spark, F.col("e"), VOCABULARY)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["t"]["ids"]) == list(r["e"]) == want and r["t"]["decoded"] == r["d"] == (r["text"] or "")
    empty = df.limit(0).select(bpe.encode_and_decode(spark, F.col("text"), VOCABULARY).alias("t"))
    assert empty.count() == 0


def test_slices_go_on_over_batches():
    batches = [pa.array(["ab"]), pa.array(["c", None]), pa.array([], pa.string()), pa.array(["defg"])]
    assert list(bpe._slices(batches, 3)) == [["ab", "c"], ["", "defg"]]


def test_workers_get_batches_of_bounded_bytes(spark):
    """Before, 10,000 rows whatever their length: 15 MB here, held several times by each task."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = documents(spark, [(i, f"{i} " + "word " * 600) for i in range(3)]).drop("doc_id").crossJoin(
        spark.range(5_000, numPartitions=1).withColumnRenamed("id", "doc_id")).coalesce(1)
    got = docs.select("doc_id", bpe.digests(spark, F.col("text"), VOCABULARY).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    largest = docs.select("text").mapInArrow(sizes, "size bigint").agg(F.max("size")).first()[0]
    assert largest < 1.5 * BATCH_BYTES
    assert got.where("t.n_tokens > 600").count() == 15_000
    assert got.select("t.ids_sha256").distinct().count() == 3
