"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives a short vector of statistics (sizes, shares of byte
classes, entropy, repetition), transformed to steady their variance. Class
means and covariances come from sums that every partition forms by itself; the
driver receives two small matrices whatever the input. Covariances are shrunk
towards the pooled variances, factored once by Cholesky, and a row's score is
the logistic of the difference of the two log densities plus the log prior.

Defined results: a null text counts as empty and is scored like any other;
labels other than 0 and 1 are ignored; without labels of both classes every
score is the smoothed prior (n1 + 1) / (n + 2); a repeated row counts as often
as it occurs; a very long text is a slice of its own; an empty table gives an empty
result; other columns, whatever their names, are passed by. Only the text is an
input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import distinct, mix, releasing, slices, words_of

SHRINK = 0.2  # share of the pooled variances in each class covariance
DECISION = 0.5  # a score from here on is class 1


def _chars(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_LOWER, _UPPER = _chars("abcdefghijklmnopqrstuvwxyz"), _chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_GROUPS = {
    "upper": _UPPER, "digit": _chars("0123456789"), "space": _chars(" \t"), "line": _chars("\n\r"),
    "sentence": _chars(".,;:?'\"()-"), "mark": _chars("!"), "symbol": _chars("#$%&*@^~|<>{}[]\\/_+=`"),
    "high": np.arange(256) >= 128,
}
STATISTICS = ("bytes", "words", *_GROUPS, "entropy", "word_mean", "word_sd", "distinct", "repeated", "top", "pairs")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One transformed row of ``STATISTICS`` for each text; all finite, empty texts included."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + np.frombuffer(b"".join(texts), np.uint8), minlength=n * 256).reshape(n, 256)
    share = counts / np.maximum(size, 1)[:, None]
    out = [np.log1p(size)]
    hashes, lengths, bounds = words_of(texts)
    n_words = np.diff(bounds)
    out.append(np.log1p(n_words))
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))  # noqa: E731  steadies the variance of a share
    out += [root(share[:, g].sum(1)) for g in _GROUPS.values()]
    out.append(-(share * np.log2(np.where(share > 0, share, 1))).sum(1))
    at_least = np.maximum(n_words, 1)

    def total(values: np.ndarray, owner_of: np.ndarray) -> np.ndarray:
        return np.bincount(owner_of, values, n)

    who = np.repeat(np.arange(n), n_words)
    mean = total(lengths, who) / at_least
    sd = np.sqrt(np.maximum(total(lengths.astype(float) ** 2, who) / at_least - mean**2, 0))
    out += [np.log1p(mean), np.log1p(sd)]
    _, often, places = distinct(hashes, bounds)
    whose = np.repeat(np.arange(n), np.diff(places))
    top = np.zeros(n)
    np.maximum.at(top, whose, often)
    inner = who[1:] == who[:-1]
    pairs = mix(hashes[:-1] * np.uint64(3) + mix(hashes[1:]))[inner]
    pair_owner = who[1:][inner]
    _, _, pair_places = distinct(pairs, np.searchsorted(pair_owner, np.arange(n + 1)))
    out += [root(np.diff(places) / at_least), root(total((hashes[1:] == hashes[:-1])[inner], pair_owner) / at_least),
            root(top / at_least), root(np.diff(pair_places) / np.maximum(n_words - 1, 1))]
    return np.column_stack(out)


def with_statistics(docs: DataFrame, text: Column, name: str = "statistics") -> DataFrame:
    """``docs`` with an array<double> of the text's statistics."""

    @F.arrow_udf("array<double>")
    @releasing
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [statistics(part) for _, part in slices(pa.nulls(len(texts)), texts)]
            values = np.concatenate([np.empty((0, len(STATISTICS))), *rows])
            offsets = np.arange(0, values.size + 1, len(STATISTICS), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), pa.float64()))

    return docs.withColumn(name, of(text))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, and log prior and determinants."""

    means: tuple[np.ndarray, np.ndarray] | None
    whiten: tuple[np.ndarray, np.ndarray] | None
    offset: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        odds = np.full(len(rows), self.offset)
        if self.means is not None:
            far = [(((rows - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whiten, strict=True)]
            odds += (far[0] - far[1]) / 2
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _moments(labelled: DataFrame, p: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(count, sums, sums of products) by label; one row per partition and label, then added up."""

    @releasing
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros((p + 1, p + 1)), 1: np.zeros((p + 1, p + 1))}
        for batch in batches:
            rows = np.asarray(batch.column("statistics").flatten()).reshape(-1, p)
            label = np.asarray(batch.column("label"))
            for k, total in sums.items():
                x = np.column_stack([np.ones((label == k).sum()), rows[label == k]])
                total += x.T @ x
        k = np.repeat(np.array([0, 1], np.int32), (p + 1) ** 2)
        at = np.tile(np.arange((p + 1) ** 2, dtype=np.int32), 2)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(np.r_[sums[0].ravel(), sums[1].ravel()])],
                                         ["label", "place", "value"])

    out = {k: np.zeros((p + 1) ** 2) for k in (0, 1)}
    added = (labelled.select("statistics", "label").mapInArrow(partial, "label int, place int, value double")
             .groupBy("label", "place").agg(F.sum("value").alias("value")))
    for r in added.collect():  # 2 * (p + 1) ** 2 numbers at any input size
        out[r["label"]][r["place"]] = r["value"]
    m = {k: v.reshape(p + 1, p + 1) for k, v in out.items()}
    return {k: (v[0, 0], v[0, 1:], v[1:, 1:]) for k, v in m.items()}


def fit(labelled: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """Fit on all rows of (statistics, label)."""
    p = len(STATISTICS)
    known = labelled.where(F.col("label").isin(0, 1)).select("statistics", F.col("label").cast("int").alias("label"))
    moments = _moments(known, p)
    n0, n1 = moments[0][0], moments[1][0]
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if min(n0, n1) < 2:
        return Discriminant(None, None, prior)
    means, spreads = [], []
    for n, s, ss in (moments[0], moments[1]):
        means.append(s / n)
        spreads.append(ss / n - np.outer(s / n, s / n))
    pooled = np.diag((n0 * spreads[0] + n1 * spreads[1]) / (n0 + n1))
    target = np.diag(np.maximum(pooled, 1e-6 * max(1e-6, float(pooled.max()))))
    factors = [np.linalg.cholesky((1 - shrink) * s + shrink * target + 1e-9 * target) for s in spreads]
    halves = [float(np.log(np.diag(f)).sum()) for f in factors]  # half log determinants
    return Discriminant((means[0], means[1]), (np.linalg.inv(factors[0]), np.linalg.inv(factors[1])),
                        prior + halves[0] - halves[1])


def score(rows: DataFrame, model: Discriminant, statistics_col: str = "statistics", name: str = "score") -> DataFrame:
    """``rows`` with the model's probability of class 1."""
    p = len(STATISTICS)

    @F.arrow_udf("double")
    @releasing
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array(model.scores(np.asarray(values.flatten()).reshape(-1, p)))

    return rows.withColumn(name, of(F.col(statistics_col)))


def text_scores(text: Column, model: Discriminant) -> Column:
    """The model's probability of class 1 of a text column, by one pass through one worker."""

    @F.arrow_udf("double")
    @releasing
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for _, part in slices(pa.nulls(len(texts)), texts):
                yield pa.array(model.scores(statistics(part)))

    return of(text)


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _learnable(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(statistics, label) of the labelled rows that aren't held out; ``rows`` is (id, statistics)."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    return rows.where(~held_out(F.col("id"))).join(known.where(~held_out(F.col("id"))), "id")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", shrink: float = SHRINK) -> DataFrame:
    """(id, statistics, score) of every row; statistics are computed once and stored (some 150 bytes a row)."""
    rows = stored(with_statistics(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")),
                                  F.col("text")).drop("text"))
    return score(rows, fit(_learnable(rows, labels, id_col, label_col), shrink))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", shrink: float = SHRINK) -> DataFrame:
    """The rows whose score is at least ``least``, with every input column and no other.

    Texts are read twice, once to learn and once to score, and never stored or shuffled.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    model = fit(_learnable(with_statistics(text, F.col("text")).drop("text"), labels, id_col, label_col), shrink)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.where(text_scores(F.col(f"row.`{text_col}`"), model) >= least).select("row.*")
