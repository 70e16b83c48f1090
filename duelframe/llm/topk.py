"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are cut into ``PARTS`` slices; each slice gives a list of
partial scores, a score is the sum of its partial scores. Candidates lie in
groups of bounded size, queries in blocks, and every block visits every group.

1. In a group, each slice's local list gives its k best entries; their scores
   are gathered. The k-th best of a query over all groups is a safe cutoff: its
   true k-th best score can't be lower.
2. The cutoffs go to all groups. With a group's smallest partial score m_i of
   each slice, a score of at least c needs a slice that is at least
   (c - sum m_i) / PARTS above its m_i: only such entries are collected.
3. The scores of the collected entries are resolved exactly, those below the
   cutoff go, and the k best of each group meet once more.

A task holds one group and one block (some MB). Blocks with their cutoffs are
rows that travel to the groups; nothing that grows with the input is broadcast
or brought to the driver.

Defined results: components are floor(256 * x), x as double; vectors that are
null or hold a null or non-finite component take no part; of vectors of unequal
length the shorter is filled up with zeros (an empty one scores 0); ties go to
the smaller id; a row is never compared with rows of its own id; each of
several rows with one id is asked for and found like any other; scores beyond a
long stop at its ends; a null id takes no part; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import releasing

PARTS = 4  # slices of the dimensions
GROUP_ROWS = 2048
BLOCK_ROWS = 512
_NONE = np.iinfo(np.int64).min

_PACKED = "block bigint, ids binary, vectors binary, width int"
_LISTS = "block bigint, ids binary, found binary, scores binary"


def _matrix(vectors: list) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


@releasing
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            rows = _matrix([np.asarray(v.values, np.float64) for v in part.column("vector")])
            ids = np.asarray(part.column("id"), np.int64)
            yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "vectors": [rows.tobytes()], "width": pa.array([rows.shape[1]], pa.int32())})


def _whole(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(256 * x), as doubles where they are exact, else as Python integers."""
    if not exact:
        return np.floor(256 * x)
    return np.array([[math.floor(256 * v) if abs(v) < 1e300 else 256 * int(v) for v in row] for row in x.tolist()],
                    object).reshape(x.shape)


def partial_scores(queries: np.ndarray, group: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """Partial scores (queries x group) of each slice of the dimensions."""
    width = max(queries.shape[1], group.shape[1], 1)
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, group))
    top = [float(np.abs(x).max(initial=0)) * 256 + 1 for x in (q, c)]
    large = not top[0] * top[1] * width < 2**53  # beyond, doubles would round
    q, c = _whole(q, large), _whole(c, large)
    return [q[:, s] @ c[:, s].T for s in np.array_split(np.arange(width), min(parts, width))]


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(v), _NONE + 1), 2**63 - 1) for v in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (id, score) of each row, ties to the smaller id; unused places score ``_NONE``."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    out_ids, out = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    short = k - out.shape[1]
    if short > 0:
        out_ids = np.pad(out_ids, ((0, 0), (0, short)))
        out = np.pad(out, ((0, 0), (0, short)), constant_values=_NONE)
    return out_ids, out


def first_lists(parts: list[np.ndarray], own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: scores of the entries that lead the slices' lists; ``own`` marks entries that don't count."""
    n = parts[0].shape[1]
    lead = []
    for p in parts:
        if p.dtype == object:  # the lists only have to lead to good entries
            p = np.array([float(min(max(v, -10**300), 10**300)) for v in p.ravel()]).reshape(p.shape)
        p = np.where(own, -np.inf, p)
        lead.append(np.argpartition(-p, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), p.shape))
    at = np.sort(np.concatenate(lead, axis=1), axis=1)
    twice = np.c_[np.zeros(len(at), bool), at[:, 1:] == at[:, :-1]]
    total = _as_long(sum(np.take_along_axis(p, at, 1) for p in parts))
    total[twice | np.take_along_axis(own, at, 1)] = _NONE
    return _best(total, ids[at], k)


def sufficient(parts: list[np.ndarray], own: np.ndarray, ids: np.ndarray, cutoff: np.ndarray, k: int):
    """Phases 2 and 3: the k best entries at or above the cutoff, of those that reach the uniform threshold."""
    found = np.zeros((len(cutoff), k), np.int64)
    scores = np.full((len(cutoff), k), _NONE)
    least = [p.min(axis=1) for p in parts]
    for i, c in enumerate(cutoff.tolist()):
        keep = ~own[i]
        if c > _NONE + 1:  # scores that stop at a long's lower end are equal
            step = (int(c) - sum(int(low[i]) for low in least)) // len(parts)  # exact, rounded down
            keep &= np.logical_or.reduce([p[i] - low[i] >= step for p, low in zip(parts, least, strict=True)])
        at = np.flatnonzero(keep)
        total = _as_long(sum(p[i, at] for p in parts))
        at, total = at[total >= c], total[total >= c]
        if len(at):
            if len(at) > 4 * k:  # entries below the k-th best can't stay; equal ones are settled by id
                bound = np.partition(total, len(total) - k)[len(total) - k]
                at, total = at[total >= bound], total[total >= bound]
            order = np.lexsort((ids[at], ~total))[:k]
            found[i, :len(order)], scores[i, :len(order)] = ids[at][order], total[order]
    return found, scores


def _visit(k: int, last: bool):
    """Tasks of (group, block): rows come sorted by group, its candidates first."""

    @releasing
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, rows, ready = None, [], [], None
        for batch in batches:
            for g, kind, block, i, vector, names, packed, width, cutoff in zip(*batch.columns, strict=True):
                if g.as_py() != group:
                    group, ids, rows, ready = g.as_py(), [], [], None
                if kind.as_py() == 0:
                    ids.append(i.as_py())
                    rows.append(np.asarray(vector.values, np.float64))
                    continue
                if ready is None:
                    ready = np.array(ids, np.int64), _matrix(rows)
                    rows = []
                if not len(ready[0]):
                    continue
                query = np.frombuffer(names.as_py(), np.int64)
                matrix = np.frombuffer(packed.as_py(), np.float64).reshape(len(query), width.as_py())
                parts = partial_scores(matrix, ready[1])
                own = query[:, None] == ready[0][None, :]
                if last:
                    found, scores = sufficient(parts, own, ready[0], np.frombuffer(cutoff.as_py(), np.int64), k)
                else:
                    found, scores = first_lists(parts, own, ready[0], k)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block.as_py()], pa.int64()), "ids": [names.as_py()],
                                                  "found": [found.tobytes()], "scores": [scores.tobytes()]})

    return visit


def _merged(k: int):
    """One list a block out of all groups' lists."""

    @releasing
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, ids, found, scores in zip(*batch.columns, strict=True):
                n = len(ids.as_py()) // 8
                new = (np.frombuffer(x.as_py(), np.int64).reshape(n, k) for x in (found, scores))
                if block.as_py() in held:
                    _, f, s = held[block.as_py()]
                    new_f, new_s = new
                    f, s = _best(np.concatenate([s, new_s], 1), np.concatenate([f, new_f], 1), k)
                else:
                    f, s = new
                held[block.as_py()] = ids.as_py(), f, s
        for block, (ids, f, s) in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "ids": [ids],
                                              "found": [f.tobytes()], "scores": [s.tobytes()]})

    return merge


def _cutoffs(k: int):
    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [np.frombuffer(s.as_py(), np.int64).reshape(-1, k)[:, -1].tobytes() for s in batch.column("scores")]
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "cutoff": last})

    return cut


def _spread(k: int):
    @releasing
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found, scores in zip(*(batch.column(c) for c in ("ids", "found", "scores")), strict=True):
                query = np.frombuffer(ids.as_py(), np.int64)
                f, s = (np.frombuffer(x.as_py(), np.int64).reshape(-1, k) for x in (found, scores))
                there = s != _NONE
                at, rank = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(query[at]), pa.array((rank + 1).astype(np.int32)), pa.array(f[there]),
                                                  pa.array(s[there])], ["query_id", "rank", "found_id", "score"])

    return rows


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, found_id, score): the k best other rows for each row that ``is_query`` holds for."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.where(sound & F.col(f"`{id_col}`").isNotNull())
    candidates = named.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("vector"))
    groups = max(1, -(-rows.count() // group_rows))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(named.where(is_query).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("vector"))
                    .mapInArrow(_pack, "ids binary, vectors binary, width int")
                    .withColumn("block", F.monotonically_increasing_id()).select("block", "ids", "vectors", "width"))
    none = {c: F.lit(None).cast(t) for c, t in (("block", "bigint"), ("ids", "binary"), ("vectors", "binary"), ("width", "int"),
                                                ("cutoff", "binary"), ("id", "bigint"), ("vector", "array<double>"))}
    names = ["id", "vector", "ids", "vectors", "width", "cutoff"]
    held = candidates.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), F.lit(0).alias("kind"), none["block"].alias("block"),
                             "id", "vector", *[none[c].alias(c) for c in names[2:]])

    def visited(asked: DataFrame, last: bool) -> DataFrame:
        sent = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"),
                            F.lit(1).alias("kind"), "block", *[none[c].alias(c) for c in names[:2]], *names[2:])
        return (held.unionByName(sent).repartition(max(1, min(groups, parts)), "g").sortWithinPartitions("g", "kind")
                .mapInArrow(_visit(k, last), _LISTS).repartition("block").mapInArrow(_merged(k), _LISTS))

    first = visited(blocks.withColumn("cutoff", none["cutoff"]), False)
    cutoffs = first.mapInArrow(_cutoffs(k), "block bigint, cutoff binary")
    asked = stored(blocks.join(cutoffs, "block"))
    return visited(asked, True).mapInArrow(_spread(k), "query_id bigint, rank int, found_id bigint, score bigint")
