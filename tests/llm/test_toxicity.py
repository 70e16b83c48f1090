from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from duelframe.llm import toxicity as X
from duelframe.llm.queries import QUERIES
from duelframe.llm.tables import table
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

MID = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_match(terms, word):
    """(term, edits) by distances to every term."""
    best = None
    for k, t in enumerate(terms):
        bare = t.rstrip("$")
        d = distance(bare, word) if t.endswith("$") else min(distance(bare, word[:j]) for j in range(len(word) + 1))
        if d <= X.edits_of(t) and (best is None or (d, -len(t), k) < best):
            best = (d, -len(t), k)
    return None if best is None else (best[2], best[0])


TERMS = ["idiot$", "idio", "pathetic", "pathet$", "réeux", "boco", "ab", "worthless$", "disgusting$", "worth", "moron$", "moronic"]


def misspelled(r, word):
    for _ in range(r.randrange(4)):
        k, c = r.randrange(len(word) + 1), r.choice("abcdeiox1é")
        word = r.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])
    return word


def test_automata_on_the_trie_equal_plain_distances():
    r = random.Random(1)
    words = [misspelled(r, r.choice(TERMS).rstrip("$") + r.choice(["", "s", "ment"])) for _ in range(1500)] + ["x", "a" * 40, "idiot" * 20, "pathetically"]
    words = [w for w in words if w]
    assert X.Lexicon(TERMS).match(words) == [plain_match(TERMS, w) for w in words]
    assert X.Lexicon([]).match(["a"]) == [None] and X.Lexicon(TERMS).match([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=12), min_size=1, max_size=6, unique=True), st.lists(st.text("abcé", min_size=1, max_size=16), max_size=8))
def test_any_lexicon(terms, words):
    assert X.Lexicon(terms).match(words) == [plain_match(terms, w) for w in words]


def test_context_separates_quotation_from_abuse():
    matcher = X.Matcher(X.Lexicon(["idiot$", "moron$"]))
    texts = ["You idiot, go away.", 'He said "you idiot" to her.', "Der Begriff „Idiot“ ist alt.", "« idiot » dit-il", "idiot moron idiot",
             "It's an idiot's guide", "the word idiot", "Idi0t!", ""]
    shares = [[h[4] for h in hits] for _, hits in matcher.hits(texts)]
    assert shares[0] == [1.0] and shares[1] == [0.0] and shares[2] == [0.0] and shares[3] == [0.0] and shares[4] == [1.0] * 3
    assert shares[5] == [1.0] and shares[6] == [0.7] and shares[7] == [1.0] and shares[8] == []
    (n, ((start, end, term, edits, _),)), = matcher.hits(["An IDIIOT!"])
    assert (n, start, end, term, edits) == (2, 3, 9, 0, 1)


@pytest.fixture(scope="module")
def corpus():
    rows, labels = [], []
    for i in range(500):
        words = prose(i, 60 + i % 90).split()
        bad = i % 5 == 0
        if bad:
            r = random.Random(i)
            for _ in range(2 + len(words) // 40):
                words.insert(r.randrange(len(words)), r.choice(["numskull", "dimwit", "blockhead", "grobian" + r.choice(["en", "isch", "tum"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_terms_and_scores(spark, corpus):
    rows, labels = corpus
    copies = [(1000 + k, rows[0][1] + " only here and nowhere else zzyzx") for k in range(60)]
    known = spark.createDataFrame([*labels, *((i, 1) for i, _ in copies), (3, 7), (None, 1), (8, None)], "doc_id bigint, toxic int")
    planted = [(2000, "What a numskul and dimvit, you blokhead."), (2001, 'He wrote: "numskull", "dimwit" and "blockhead".'),
               (2002, prose(9999, 80)), (2003, None), (2004, ""), (None, "no id"), (3, rows[3][1]), (2005, "w " * 300_000 + "end")]
    df = documents(spark, rows + copies + planted).withColumns({c: F.lit(1) for c in ("id", "label", "score", "hits", "minima", "h", "term")})
    sample, totals = X._learning(df, known, "doc_id", "text", "toxic")
    terms = X.learn_terms(sample)
    assert {"numskull$", "dimwit$", "blockhead$", "grobian"} <= set(terms) and not any("zzyzx" in t for t in terms)
    assert sample.where("text like '%zzyzx%'").count() <= 1
    out = X.detect_toxicity(df, known).collect()
    assert len(out) == len(rows) + len(copies) + len(planted)
    score = {r["id"]: r["score"] for r in out}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= X.DECISION) == bool(t) for i, t in held]) >= 0.97
    assert score[2000] >= X.DECISION > score[2001] and all(score[i] < 0.5 for i in (2002, 2003, 2004, 2005))
    hits = {r["id"]: [(h["term"], h["edits"]) for h in r["hits"]] for r in out}
    assert hits[2000] == [("numskull$", 1), ("dimwit$", 1), ("blockhead$", 1)]


def test_held_out_labels_are_never_learnt(spark, corpus):
    rows, labels = corpus
    df = documents(spark, rows)

    def scores(known):
        return {r["id"]: r["score"] for r in X.detect_toxicity(df, spark.createDataFrame(known, "doc_id bigint, toxic int")).collect()}

    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert scores(labels) == scores([(i, 1 - t if i in held else t) for i, t in labels])


def test_without_labels_of_both_classes(spark, corpus):
    rows, labels = corpus
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    learnt = len({t for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1 and i % 5})
    one = X.detect_toxicity(documents(spark, rows), known.where("toxic = 0")).select("score").distinct().collect()
    assert len(one) == 1 and abs(one[0][0] - 1 / (learnt + 2)) < 1e-9
    assert X.detect_toxicity(documents(spark, rows[:2]), known.limit(0)).first()["score"] == 0.5
    assert X.detect_toxicity(documents(spark, []), known).count() == 0


def test_held_out_accuracy(spark):
    rows = QUERIES["op12_toxicity"](spark, MID).join(table(spark, MID, "labels"), "doc_id").where("held_out").collect()
    found = [r["predicted"] == 1 for r in rows if r["toxic"] == 1]
    wrong = [r["predicted"] == 1 for r in rows if r["toxic"] == 0]
    # some 6 % of the toxic labels are on texts without any abusive word
    assert len(found) > 100 and np.mean(found) >= 0.9 and np.mean(wrong) <= 0.01
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
