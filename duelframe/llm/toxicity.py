"""Toxicity by Levenshtein automata over a lexicon trie, with context-window scores.

Lexicon: words and word stems that stand in toxic learning texts far more often than
in clean ones (log-likelihood ratio of documents above 2 ln(candidates) + 4, frequency
ratio of at least 4, three toxic texts; of candidates that extend each other the best,
at most ``MAX_TERMS``). Matching: the distinct words of a slice are one batch of
Levenshtein automata, whose states (rows of edit distances, one for each word) run
down the trie of terms together; a branch drops the words whose state can no longer
accept. Terms of 5 letters accept one edit, of 8 letters two; a stem accepts words
that begin like it.

Context: a hit counts as abuse by a score between 0 and 1 that falls inside quotation
marks (0.7) and beside words of reporting (0.3) within ``WINDOW`` words, and, outside of marks, rises
beside another hit (0.3); the rest of its weight counts as quotation. A term's weight at each distance is
the log ratio of its rates in the two classes, shrunk towards the exact term's.
A document's score is a ridge logistic regression on the density and the sum of abuse
and the density of quotation.

Learning uses at most ``LEARN`` texts of each class (documented bound; those of
smallest hashed id among texts that differ, near copies by shared minima of hashed
word triples left out); their hits, a bounded table, are fitted by the driver. Scoring
reads every whole text once and shuffles nothing.

Defined results: a null text counts as empty and is scored like any other; labels
other than 0 and 1 are ignored; without labels of both classes, or without terms, the
score is the smoothed prior (n1 + 1) / (n + 2) of the distinct learning texts; a
repeated row is scored as often as it occurs and learnt from once; rows with null ids
are scored, not learnt from; very long texts are slices of their own; an empty table
gives an empty result; other columns, whatever their names, are passed by. Only the
text is an input of a score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .quality import held_out
from .words import mix, releasing, words_of

LEARN = 4_000
MAX_TERMS = 512
STEMS = (3, 12)  # letters of a stem
SUPPORT = 3  # toxic texts that hold a term
RATIO = 4.0  # of frequencies
WINDOW = 8  # words on either side of a hit
NEAR = 160  # characters in which a quotation mark is looked for
SLICE_CHARS = 4_000_000
CACHE = 1_000_000  # words whose matches a task remembers
DECISION = 0.7  # a score from here on is class 1
RIDGE = 0.1
MINIMA = 4

WORD = re.compile(r"[^\W_]+")
# Marks that open and close a quotation, and words that report one.
OPENING, CLOSING, STRAIGHT = "«“„‘‹", "»”“’›", "\"`"
REPORTING = frozenset("""said says say called calls call wrote writes quote quoted quotes word words term terms insult insulted
 dit disait appelé écrit cité mot mots terme insulte sagte sagt nannte schrieb zitat zitiert wort wörter begriff beleidigung
 dijo dice llamó escribió cita citó palabra palabras término insulto""".split())


def edits_of(term: str) -> int:
    """Edits that a term accepts."""
    n = len(term.rstrip("$"))
    return 0 if n < 5 else 1 if n < 8 else 2


class Lexicon:
    """Terms in a trie; a term that ends in ``$`` is a whole word, any other a stem."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.slack = [0]  # most edits that a term below accepts
        for k, term in enumerate(terms):
            at = 0
            self.slack[0] = max(self.slack[0], edits_of(term))
            for c in term.rstrip("$"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.slack.append(0)
                at = self.children[at][c]
                self.slack[at] = max(self.slack[at], edits_of(term))
            self.ends[at].append(k)
        self.longest = max((len(t) for t in terms), default=0)

    def match(self, words: list[str]) -> list[tuple[int, int] | None]:
        """(term, edits) of each word: fewest edits, then longest term, then first; None without a match."""
        best = np.full(len(words), -1, np.int64)  # of terms
        rank = np.full(len(words), np.iinfo(np.int64).max)
        if not self.terms or not words:
            return [None] * len(words)
        wide = self.longest + 2
        letters = np.array(words, f"U{wide}").view(np.uint32).reshape(len(words), wide)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(wide + 1, dtype=np.int8)
        # cells beyond a word's end are never accepted: they stand at a distance no term allows
        beyond = np.where(place > np.minimum(lengths, wide)[:, None], np.int8(64), np.int8(0))
        todo = [(0, 0, np.arange(len(words)), np.broadcast_to(place, (len(words), wide + 1)))]
        while todo:
            node, depth, who, rows = todo.pop()
            for k in self.ends[node]:
                whole = self.terms[k].endswith("$")
                if whole:
                    far = np.where(lengths[who] <= wide, rows[np.arange(len(who)), np.minimum(lengths[who], wide)], 64)
                else:
                    far = (rows + beyond[who]).min(1)
                key = (far.astype(np.int64) * 64 + (63 - len(self.terms[k]))) * MAX_TERMS + k
                good = (far <= edits_of(self.terms[k])) & (key < rank[who])
                best[who[good]], rank[who[good]] = k, key[good]
            for c, child in self.children[node].items():
                # one letter of the term read: substitution or match, deletion, then insertions from the left
                step = np.empty_like(rows, dtype=np.int8)
                step[:, 0] = depth + 1
                np.minimum(rows[:, :-1] + (letters[who] != ord(c)), rows[:, 1:] + 1, out=step[:, 1:], casting="unsafe")
                step = np.minimum.accumulate(step - place, axis=1) + place
                alive = step.min(1) <= self.slack[child]
                if alive.any():
                    todo.append((child, depth + 1, who[alive], step[alive]))
        found = rank // (64 * MAX_TERMS)
        return [None if k < 0 else (k, e) for k, e in zip(best.tolist(), found.tolist(), strict=True)]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands between quotation marks of its line."""
    left = text[max(0, start - NEAR) : start].rpartition("\n")[2]
    right = text[end : end + NEAR].partition("\n")[0]
    for a, b in zip(OPENING, CLOSING, strict=True):
        if left.rfind(a) > (left.rfind(b) if a != b else -1) and b in right:
            return True
    at = left.rfind("'")  # an apostrophe inside a word opens nothing
    single = at >= 0 and not left[at - 1 : at].isalnum() and "'" in right
    return single or any(left.count(m) % 2 == 1 and m in right for m in STRAIGHT)


def abuse_share(words: list[str], k: int, in_quotes: bool, hits: set[int]) -> float:
    """How far the hit at word k is abuse rather than quotation, by its window."""
    around = range(max(0, k - WINDOW), min(len(words), k + WINDOW + 1))
    reports = any(words[i] in REPORTING for i in around)
    crowd = not in_quotes and any(i in hits for i in around if i != k)
    return min(10, max(0, 10 - 7 * in_quotes - 3 * reports + 3 * crowd)) / 10


class Matcher:
    """Finds hits in texts; remembers the matches of at most ``CACHE`` words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, int, int, float]]]]:
        """(number of words, [(start, end, term, edits, abuse share)]) of each text; places are code points of the lower-cased text."""
        low = [t.lower() for t in texts]
        split = [WORD.findall(t) for t in low]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, set().union(*split)
        fresh = sorted(new)
        for k in range(0, len(fresh), 50_000):
            part = fresh[k : k + 50_000]
            self.known.update(zip(part, self.lexicon.match(part), strict=True))
        known, out = self.known, []
        for text, words in zip(low, split, strict=True):
            at = [k for k, w in enumerate(words) if known[w] is not None]
            found = []
            if at:
                places, every = [m.span() for m in WORD.finditer(text)], set(at)
                for k in at:
                    start, end = places[k]
                    found.append((start, end, *known[words[k]], abuse_share(words, k, quoted(text, start, end), every)))
            out.append((len(words), found))
        return out


def _texts(column: pa.Array, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in column:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


# ---- learning

def _minima(text: str) -> list[int]:
    """Smallest hashed word triples under ``MINIMA`` mixings; texts of under three words hash as a whole."""
    hashes = words_of([text.encode()])[0]
    if len(hashes) >= 3:
        hashes = mix(mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:])
    elif len(hashes):
        hashes = mix(hashes * np.uint64(7)).sum(keepdims=True)
    else:
        hashes = np.zeros(1, np.uint64)
    return [int(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))).min().astype(np.int64)) for k in range(MINIMA)]


def _learning(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of the learning sample, and how many distinct texts of each label there are."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(~held_out(F.col("id")))
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & ~held_out(F.col("id"))))
    narrow = rows.select("id", F.xxhash64("text").alias("h")).join(known, "id")
    distinct = stored(narrow.groupBy("h", "label").agg(F.min("id").alias("id")))
    totals = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("id").cast("string")), F.col("id")
    picked = [distinct.where(F.col("label") == k).orderBy(*order).limit(LEARN).select("id", "label") for k in (0, 1)]
    ids = stored(picked[0].unionAll(picked[1]))  # at most 2 * LEARN rows
    sample = rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.max("text").alias("text"))

    @F.arrow_udf("array<bigint>")
    @releasing
    def minima(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_minima(t.as_py()) for t in texts], pa.list_(pa.int64()))

    left = stored(sample.withColumn("minima", minima(F.col("text"))))
    for k in range(MINIMA):
        left = left.groupBy("label", F.col("minima")[k]).agg(F.min_by(F.struct("id", "text", "minima"), "id").alias("r")).select("label", "r.*")
    return stored(left.select("label", "text")), totals


def _candidates(sample: DataFrame) -> DataFrame:
    """(term, t, c, ft, fc): texts of either class that hold a candidate, and its summed frequencies (5 % of a text at most)."""

    @releasing
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0.0, 0.0])

        def out() -> pa.RecordBatch:
            names = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([counts[x][k] for x in names], pa.int64() if k < 2 else pa.float64()) for k in range(4))],
                ["term", "t", "c", "ft", "fc"])

        chars = 0
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, own = WORD.findall(text.lower()), defaultdict(int)
                for w in words:
                    own[w] += 1
                stems = defaultdict(int)
                for w, n in own.items():
                    for size in range(STEMS[0], min(len(w), STEMS[1]) + 1):
                        stems[w[:size]] += n
                    if len(w) >= STEMS[0]:
                        stems[w[: 2 * STEMS[1]] + "$"] += n
                for s, n in stems.items():
                    x = counts[s]
                    x[1 - label] += 1
                    x[3 - label] += min(0.05, n / len(words))
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield out()
                    counts.clear()
                    chars = 0
        if counts:
            yield out()

    parts = sample.select("label", "text").mapInArrow(counted, "term string, t bigint, c bigint, ft double, fc double")
    return parts.groupBy("term").agg(*[F.sum(x).alias(x) for x in ("t", "c", "ft", "fc")])


def learn_terms(sample: DataFrame) -> list[str]:
    """Terms of the lexicon, best first."""
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    seen = stored(_candidates(sample).where(F.col("t") >= SUPPORT))

    def part(x: Column, share: Column, whole: Column) -> Column:
        return F.when(x > 0, x * F.log(share / whole)).otherwise(0.0)

    t, c = F.col("t"), F.col("c")
    p1, p0, p = t / n1, c / n0, (t + c) / (n0 + n1)
    fit = 2 * (part(t, p1, p) + part(n1 - t, 1 - p1, 1 - p) + part(c, p0, p) + part(n0 - c, 1 - p0, 1 - p))
    ratio = (F.col("ft") / n1) / (F.col("fc") / n0 + 1e-9)
    least = 2 * float(np.log(max(2, seen.count()))) + 4
    best = (seen.withColumn("fit", F.round(fit, 6)).where((F.col("fit") >= least) & (ratio >= RATIO) & (p1 > p0))
            .orderBy(F.desc("fit"), F.desc(F.length("term")), "term").limit(16 * MAX_TERMS))
    out: list[str] = []
    for r in best.select("term").collect():  # 16 * MAX_TERMS rows at most
        term = r["term"].rstrip("$")
        if len(out) < MAX_TERMS and not any(term.startswith(o.rstrip("$")) or o.startswith(term) for o in out):
            out.append(r["term"])
    return out


@dataclass(frozen=True)
class Model:
    """Terms, their weights by (term, edits), and the logistic's offset, scale and coefficients."""

    terms: list[str]
    weights: dict[tuple[int, int], float]
    prior: float
    centre: np.ndarray | None
    spread: np.ndarray | None
    slopes: np.ndarray | None

    def features(self, n_words: int, hits: list[tuple]) -> list[float]:
        abuse = quotation = 0.0
        for *_, term, edits, share in hits:
            w = self.weights.get((term, edits), 0.0)
            abuse += w * share
            quotation += w * (1 - share)
        per = 1000 / (n_words + 10)
        return [float(np.log1p(abuse * per)), float(np.log1p(abuse)), float(np.log1p(quotation * per))]

    def score(self, n_words: int, hits: list[tuple]) -> float:
        if self.slopes is None:
            return self.prior
        x = (np.array(self.features(n_words, hits)) - self.centre) / self.spread
        return float(1 / (1 + np.exp(-np.clip(self.slopes[0] + x @ self.slopes[1:], -700, 700))))


def _weights(terms: list[str], rows: list[tuple[int, int, list[tuple]]]) -> dict[tuple[int, int], float]:
    """Weight of every (term, edits), 0 to 1: log ratio of its rates in the classes over log 64, shrunk to the exact term's."""
    words = [1.0, 1.0]
    counts: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for label, n_words, hits in rows:
        own: dict[tuple[int, int], int] = defaultdict(int)
        for *_, term, edits, _ in hits:
            own[term, edits] += 1
        words[label] += n_words
        for key, n in own.items():
            counts[key][label] += min(n, 5)
    out = {}
    for k, term in enumerate(terms):
        prior = 0.0
        for e in range(edits_of(term) + 1):
            c, t = counts[k, e]
            ratio = float(np.log((t + 0.5) / words[1]) - np.log((c + 0.5) / words[0]))
            shrunk = ratio if e == 0 else (2 * 0.6 * prior + (t + c) * ratio) / (2 + t + c)
            prior = shrunk
            out[k, e] = min(1.0, max(0.0, shrunk / np.log(64)))
    return out


def fit(sample: DataFrame, totals: dict[int, int]) -> Model:
    """Lexicon, weights and regression from the learning sample, whose hits (at most 2 * LEARN texts) the driver gets."""
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    terms = learn_terms(sample)
    if not terms:
        return Model([], {}, prior, None, None, None)
    rows = [(r["label"], r["f"]["n"], [tuple(h) for h in r["f"]["hits"]]) for r in
            sample.select("label", _hits_udf(terms)(F.col("text")).alias("f")).collect()]
    model = Model(terms, _weights(terms, rows), prior, None, None, None)
    x = np.array([model.features(n, hits) for _, n, hits in rows])
    y = np.array([label for label, _, _ in rows], float)
    each = np.array([totals[0] / max(1, (y == 0).sum()), totals[1] / max(1, (y == 1).sum())])[y.astype(int)]
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    design = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    slopes, ridge = np.zeros(design.shape[1]), np.diag([0.0, *[RIDGE] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ slopes, -30, 30)))
        step = np.linalg.solve((design * (each * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge + 1e-9 * np.eye(len(slopes)),
                               design.T @ (each * (y - p)) - ridge @ slopes)
        slopes = slopes + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Model(terms, model.weights, prior, centre, spread, slopes)


_HIT = "array<struct<start:int,end:int,term:int,edits:int,abuse:double>>"


def _hits_udf(terms: list[str]):
    @F.arrow_udf(f"struct<n:int,hits:{_HIT}>")
    @releasing
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(Lexicon(terms))
        kind = pa.struct([("n", pa.int32()), ("hits", pa.list_(pa.struct([
            ("start", pa.int32()), ("end", pa.int32()), ("term", pa.int32()), ("edits", pa.int32()), ("abuse", pa.float64())])))])
        for texts in batches:
            for part in _texts(texts):
                yield pa.array([{"n": n, "hits": [dict(zip(("start", "end", "term", "edits", "abuse"), h, strict=True)) for h in hits]}
                                for n, hits in matcher.hits(part)], kind)

    return of


SCORED = "struct<score:double,hits:array<struct<start:int,end:int,term:string,edits:int,abuse:double>>>"


def score(text: Column, model: Model) -> Column:
    """Score of a text column and its hits: places (code points of the lower-cased text), terms, edits, share of abuse."""

    @F.arrow_udf(SCORED)
    @releasing
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(Lexicon(model.terms))
        kind = pa.struct([("score", pa.float64()), ("hits", pa.list_(pa.struct([
            ("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("abuse", pa.float64())])))])
        for texts in batches:
            for part in _texts(texts):
                yield pa.array([{"score": model.score(n, hits), "hits": [
                    {"start": a, "end": b, "term": model.terms[t], "edits": e, "abuse": s} for a, b, t, e, s in hits]}
                    for n, hits in matcher.hits(part)], kind)

    return of(text)


def detect_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, score, hits) of every row."""
    sample, totals = _learning(docs, labels, id_col, text_col, label_col)
    model = fit(sample, totals)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), score(F.col(f"`{text_col}`"), model).alias("found"))
    return rows.select("id", "found.score", "found.hits")
