from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
from duelframe.llm import token_alignment as T
from duelframe.llm.queries import PIECES, QUERIES, VOCABULARY
from duelframe.llm.words import decimal_table, decimals
from helpers import documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaa" * 40, "It's  we'll\n\n\tgo  ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁",
         "日本語 текст ñandú 🏳️‍🌈 ̀​  \x1c\x85\x00", "0123456789 3.14 ½ ² ﬁ Å", prose(1, 3000), "\n" * 999, "!?;" * 300, "x" + " " * 30_000 + "y",
         "𝕏𝕐ℤ𓀀𓀁" * 200, "word " * 2000, "Übergrößenträger " * 700]


def bytes_a():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {i: bytes(chars[c] for c in t) for t, i in A.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}


OF_A = bytes_a()


def byte_of_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def groups(text):
    """Groups of (A ids, B ids), by the library encoders and a plain walk over all offsets."""
    raw = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    x, y = [OF_A[i] for i in a], [byte_of_b(i) for i in b]
    if not text or b"".join(x) != raw or b"".join(y) != raw:
        return [], [], []
    ends = [np.cumsum([len(t) for t in side]).tolist() for side in (x, y)]
    both, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        i2, j2 = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return a, b, out


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    cut = [(i, *groups(t or "")) for i, t in rows]
    count = collections.Counter(p for _, _, _, g in cut for p in {(x, y) for l, r in g for x in l for y in r})
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, a, b, g in cut:
        links = [(x, y) for l, r in g for x in l for y in r]
        text = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in g)
        out.append((i, len(a), len(b), len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


COLUMNS = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = [*enumerate(TEXTS), (100, None), (None, "no id"), (3, TEXTS[3]), (101, "the same"), (101, "the same")]
    df = documents(spark, rows).withColumns({c: F.lit(1) for c in ("id", "slice", "pair", "n", "best", "codes")}).repartition(3)
    for bounds in ({}, {"slice_chars": 3000, "chunk_chars": 1000}):
        got, pairs = T.align_tokens(df, VOCABULARY, PIECES, **bounds)
        assert rows_of(got) == brute(rows)
    want = collections.Counter(p for _, t in rows for p in {(x, y) for l, r in groups(t or "")[2] for x in l for y in r})
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(want)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = QUERIES["op11_token_alignment"](spark, SMALL)
    assert set(got.columns) == {"doc_id", *COLUMNS[1:]}
    assert rows_of(got.withColumnRenamed("doc_id", "id")) == brute(rows)


def test_empty_table_and_texts_without_tokens(spark):
    empty = documents(spark, [])
    assert T.align_tokens(empty, VOCABULARY, PIECES)[0].count() == 0
    got, pairs = T.align_tokens(documents(spark, [(1, None), (2, ""), (3, "▁")]), VOCABULARY, PIECES)
    assert rows_of(got) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)] and pairs.count() == 0


def test_lanes_and_dense_groups_give_the_same_merge(monkeypatch):
    r = random.Random(2)
    sides = []
    for _ in range(2):  # token lengths whose sums agree document by document
        sides.append([])
    for n in (1, 5, 400, 3000, 40, 2500):
        total = r.randrange(3 * n, 4 * n)
        for side in sides:
            cuts = sorted({r.randrange(1, total) for _ in range(n)} | {total}) if total > 1 else [total]
            side.append(np.diff([0, *cuts]))
    ids = [np.concatenate([np.array([r.randrange(50) for _ in d], np.int32) for d in side]) for side in sides]
    ends = [np.cumsum(np.concatenate(side)) for side in sides]
    bounds = [np.cumsum([0, *map(len, side)]) for side in sides]

    def run():
        cuts_a, cuts_b, places, keys, times = T.merge(*ids, *ends, *bounds, 50)
        doc = np.searchsorted(bounds[0], places, side="right") - 1
        return cuts_a.tolist(), cuts_b.tolist(), collections.Counter({k: int(times[m].sum()) for k in {(int(d), int(x)) for d, x in zip(doc, keys)}
                                                                     for m in [(doc == k[0]) & (keys == k[1])]})

    whole = run()
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    assert ends[0][whole[0]].tolist() == ends[1][whole[1]].tolist() == common
    monkeypatch.setattr(T, "LANE", 7)
    assert len(T._lanes(*ends, *bounds)[0]) > 50 and run() == whole
    monkeypatch.setattr(T, "DENSE", 2)
    assert run() == whole


def test_decimals():
    ids = np.array([0, 1, 9, 10, 99, 100, 1000, 7])
    assert decimals(ids, np.full(8, ord(","), np.uint8), decimal_table(1001)) == b"0,1,9,10,99,100,1000,7,"
