"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct five-word shingles. Documents link when
100 * |intersection| >= 80 * |union|. Equal sets share a fingerprint and are one
node; candidates among the nodes come from prefixes under one global order:

* Rare tokens come first, frequent ones last. Frequent are the tokens that
  occur in many documents, counted over all of them.
* x loses at most |x| // 5 tokens to a partner, so of a prefix with
  |x| // 5 + 1 rare tokens at least one is shared: each is indexed by itself.
* Where rare tokens run out the prefix is extended by frequent tokens, which
  are dealt into classes by hash. A class with s tokens in the prefix still has
  two in common after s - 2 losses, so it counts s - 1 towards the needed
  number, and all pairs of tokens of a class are indexed. The number of classes
  goes with the size of the set (a power of two); a set whose smallest partner
  lies in the next lower size band is indexed for both bands.

Keys carry how large a partner may be. |x & y| >= 4 (|x| + |y|) / 9 is needed, and a
set's overlap is at most its size less the rare tokens that come before the key
(all of them, for a pair of frequent tokens: partners that share a rare token
meet under that one). The smaller set of a pair loses at most a ninth of its
tokens, so a key beyond the prefix for |x| // 9 + 1 admits smaller partners only.

Documents under one key are candidates. They are not paired off: in each round
a key links its documents to one pivot, another one in every round; the best
new candidates of each document are verified and components formed. After
``ROUNDS`` rounds the pairs of a key that are left in different components are
all looked at, so no link that could join two components is left out, and dense
groups cost a few stars only.

Candidates first pass a parity sketch: 1,024 bits, each the parity of the tokens
that hash to it. Sketches of two sets differ in no more bits than the sets have
tokens in one only, and a link allows (|x| + |y|) / 9 of those, so the sketch
drops no link. Verification compares whole sets. Only the texts of candidates are read for
it, found by a Bloom filter of fixed size and an exact join after it.

Bounds: at most ``MAX_FREQUENT`` tokens are frequent (the threshold rises with
the input until a histogram of the counts shows so), and the Bloom filter has
2 ** ``BLOOM_BITS`` bits. Neither changes the result. Shingles are 64-bit
hashes of all bytes; a node is a 64-bit fingerprint checked by a second one.

Defined results: a null or empty text, or one without words, has no tokens and
links with nothing; with fewer than five words the whole sequence is the only
token; a null identifier takes part and gives way to any other in a component;
repeated rows are equal sets; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .words import distinct, mix, releasing, slices, words_of

SHINGLE = 5
PERCENT = 80
FREQUENT = 64  # documents from which on a token may be frequent
MAX_FREQUENT = 1 << 20
BLOOM_BITS = 26
SKETCH = 1 << 10  # bits
DENSE = 64  # members of a key from which on sketches are compared in the join
BEST = 8  # candidates of a document that a round looks at
ROUNDS = 2  # of stars; the pairs that are left are all looked at
FLUSH = 1 << 20  # tokens or keys held by a task before they are handed on

_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_U = np.uint64


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles in order, bounds) of each text."""
    words, _, bounds = words_of(texts)
    n = np.diff(bounds)
    spread = max(0, len(words) - SHINGLE + 1)
    total = np.full(spread, _U(SHINGLE))
    for i in range(SHINGLE):
        total += words[i:spread + i] * _PLACE[i]
    count = np.maximum(n - SHINGLE + 1, (n > 0).astype(np.int64))
    places = np.r_[0, np.cumsum(count)]
    whole = n >= SHINGLE
    out = np.empty(places[-1], np.uint64)
    keep = np.zeros(len(words) + 1, np.int64)  # +1 where a text's shingles begin, -1 behind their end
    np.add.at(keep, bounds[:-1][whole], 1)
    np.add.at(keep, bounds[1:][whole] - SHINGLE + 1, -1)
    short = np.ones(len(out), bool)
    few = np.flatnonzero(~whole & (n > 0))
    short[places[few]] = False
    out[short] = mix(total[np.cumsum(keep)[:spread] > 0])
    for i in few.tolist():
        own = words[bounds[i]:bounds[i + 1]]
        out[places[i]] = mix((own * _PLACE[:len(own)]).sum(dtype=np.uint64, keepdims=True) + _U(len(own)))[0]
    return out, places


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, bounds) of each text."""
    tokens, _, places = distinct(*shingles(texts))
    return tokens, places


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.r_[_U(0), np.cumsum(values, dtype=np.uint64)]
    return run[bounds[1:]] - run[bounds[:-1]]


def fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    sizes = np.diff(bounds).astype(np.uint64)
    return (mix(_sums(mix(tokens + _U(0xA5A5)), bounds) + sizes).view(np.int64),
            mix(_sums(mix(tokens * _U(0x9E3779B97F4A7C15) + _U(77)), bounds) + sizes).view(np.int64))


def parities(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketch of each set."""
    n = len(bounds) - 1
    cell = np.repeat(np.arange(n), np.diff(bounds)) * SKETCH + (mix(tokens + _U(3)) >> _U(64 - 10)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * SKETCH) & 1).astype(bool).reshape(n, SKETCH)
    return [row.tobytes() for row in np.packbits(odd, axis=1)]


def _slot(tokens: np.ndarray) -> np.ndarray:
    """32 bits of a token, by which it is counted. Tokens that share a slot are frequent together."""
    return (tokens >> _U(32)).astype(np.uint32)


def _new_sets(nodes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows whose node this task has not met yet, so copies are handled once in a task."""
    fresh = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes.tolist()):
        if node not in seen:
            seen.add(node)
            fresh[i] = True
    return fresh


def _take(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of chosen rows, and their new bounds."""
    sizes = np.diff(bounds)[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(bounds[:-1][rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    return at, np.r_[0, ends]


# ------------------------------------------------------------- frequent tokens

def _token_blobs(parts: int):
    def emit(slots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(slots), return_counts=True)
        cuts = np.searchsorted(values, (np.arange(1, parts) << 32) // parts)
        rows = [(p, v[c == 1].tobytes(), v[c > 1].tobytes(), c[c > 1].astype(np.int32).tobytes())
                for p, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts), strict=True)) if len(v)]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "once", "more", "counts"), r, strict=True)) for r in rows],
            pa.schema([("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())]))

    @releasing
    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in batches:
            for _, texts in slices(batch.column(0), batch.column(1)):
                tokens, bounds = shingle_sets(texts)
                at, _ = _take(bounds, np.flatnonzero(_new_sets(fingerprints(tokens, bounds)[0], seen)))
                held.append(_slot(tokens[at]))
                n += len(at)
                if n >= FLUSH:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    return blobs


@releasing
def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for batch in batches:
        for once, more, often in zip(*(batch.column(c) for c in ("once", "more", "counts")), strict=True):
            one, many = np.frombuffer(once.as_py(), np.uint32), np.frombuffer(more.as_py(), np.uint32)
            slots += [one, many]
            counts += [np.ones(len(one), np.int64), np.frombuffer(often.as_py(), np.int32).astype(np.int64)]
    slots, counts = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.empty(0, np.int64)
    total = np.add.reduceat(counts, first) if len(first) else counts
    often = total >= FREQUENT
    yield pa.RecordBatch.from_arrays([pa.array(slots[first][often].astype(np.int64)), pa.array(total[often])], ["slot", "n"])


def frequent_slots(rows: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted slots, their document counts) of the frequent tokens; at most ``MAX_FREQUENT``."""
    counted = stored(rows.mapInArrow(_token_blobs(parts), "part int, once binary, more binary, counts binary")
                     .repartition("part").mapInArrow(_count_slots, "slot bigint, n bigint"))
    levels = counted.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 rows at most
    least, total = 0, 0
    for level, n in sorted(((r["level"], r["n"]) for r in levels), reverse=True):
        total += n
        if total > MAX_FREQUENT:
            least = 1 << (level + 1)
            break
    found = counted.where(F.col("n") >= least).toPandas().sort_values("slot")
    return found["slot"].to_numpy(np.uint32), found["n"].to_numpy(np.int64)


# ----------------------------------------------------------------- prefix keys

def _combination_keys(frequent: np.ndarray, need: int, need_short: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of one class in the prefix that counts ``need``, and which lie in the one for ``need_short``.

    ``frequent`` is in global order.
    """
    classes = max(1, 1 << (band - 1))
    kind = (mix(frequent + _U(band)) & _U(classes - 1)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    later = np.r_[False, kind[order][1:] == kind[order][:-1]]  # not the first of its class
    gain = np.zeros(len(frequent), np.int64)
    gain[order] = later
    total = np.cumsum(gain)
    size = int(np.searchsorted(total, need)) + 1
    short = np.arange(len(frequent)) <= np.searchsorted(total, need_short) if need_short > 0 else np.zeros(len(frequent), bool)
    kind, short, tokens = kind[:size], short[:size], mix(frequent[:size] + _U(band))
    order = np.argsort(kind, kind="stable")
    kind, short, tokens = kind[order], short[order], tokens[order]
    out, marks, step = [np.empty(0, np.uint64)], [np.empty(0, bool)], 1
    while step < len(kind):
        same = kind[step:] == kind[:-step]
        if not same.any():
            break
        out.append(mix(tokens[step:][same] + tokens[:-step][same] + _U(2)))
        marks.append((short[step:] & short[:-step])[same])
        step += 1
    return np.concatenate(out), np.concatenate(marks)


class Prefixes:
    """Keys of sets, given the frequent slots and their counts."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        self.slots, self.counts = slots, counts
        self.heads = np.zeros(1 << 20, bool)
        self.heads[slots >> np.uint32(12)] = True

    def often(self, tokens: np.ndarray) -> np.ndarray:
        """Documents of each token, 0 for a rare one."""
        slot = _slot(tokens)
        out = np.zeros(len(tokens), np.int64)
        maybe = np.flatnonzero(self.heads[slot >> np.uint32(12)])
        at = np.minimum(np.searchsorted(self.slots, slot[maybe]), max(len(self.slots) - 1, 0))
        hit = self.slots[at] == slot[maybe] if len(self.slots) else np.zeros(0, bool)
        out[maybe[hit]] = self.counts[at[hit]]
        return out

    def keys(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, largest size of a partner, number of its set) for sets of four tokens or more; smaller ones have only equal partners."""
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        often = self.often(tokens)
        rare = often == 0
        first = np.r_[0, np.cumsum(rare)]
        place = first[:-1] - np.repeat(first[bounds[:-1]], n)  # among the set's rare tokens, in order of their hash
        need, short = n // 5 + 1, n // 9 + 1
        chosen = rare & (place < need[owner]) & (n[owner] >= 4)
        size = n[owner[chosen]]
        keys, reach, owners = [mix(tokens[chosen] + _U(1))], [9 * (size - place[chosen]) // 4 - size], [owner[chosen]]
        n_rare = first[bounds[1:]] - first[bounds[:-1]]
        for i in np.flatnonzero((n_rare < need) & (n >= 4)).tolist():
            own, count = tokens[bounds[i]:bounds[i + 1]], often[bounds[i]:bounds[i + 1]]
            own, count = own[count > 0], count[count > 0]
            own = own[np.lexsort((own, count))]
            size, left = int(n[i]), int(n_rare[i])
            low = (-(-size * PERCENT // 100)).bit_length() - 1
            for band in range(low, size.bit_length()):
                key, mark = _combination_keys(own, int(need[i]) - left, int(short[i]) - left, band)
                most = 9 * (size - left) // 4 - size
                keys.append(key)
                reach.append(np.where(mark, most, min(most, size - 1)))
                owners.append(np.full(len(key), i))
        return np.concatenate(keys), np.concatenate(reach), np.concatenate(owners)


_PLAIN = ("a", "b", "x", "y")
_BLOBS = ("keys", "nodes", "repeats", "sizes", "reach")
_INDEX = f"part int, kind string, {', '.join(f'{c} bigint' for c in _PLAIN)}, bits binary, {', '.join(f'{c} binary' for c in _BLOBS)}"
_INDEX_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.string()), *((c, pa.int64()) for c in _PLAIN),
                          *((c, pa.binary()) for c in ("bits", *_BLOBS))])
_FOUND = "kind string, a bigint, b bigint, x bigint, y bigint, bits binary"


class _Held:
    """Keys with their nodes, set sizes and largest partner sizes, gathered in pieces."""

    def __init__(self):
        self.pieces = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
        self.rows = 0

    def add(self, *piece: np.ndarray) -> None:
        self.pieces.append(piece)
        self.rows += len(piece[0])

    def groups(self):
        """Sorted by key and node, each once: (all columns, rows that begin a key, rows whose key has several nodes)."""
        keys, nodes, sizes, reach = (np.concatenate(x) for x in zip(*self.pieces, strict=True))
        order = np.lexsort((-reach, nodes, keys))
        keys, nodes, sizes, reach = keys[order], nodes[order], sizes[order], reach[order]
        once = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])][:len(keys)]
        keys, nodes, sizes, reach = keys[once], nodes[once], sizes[once], reach[once]
        new = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
        several = ~(new & np.r_[new[1:], True][:len(keys)])
        return (keys, nodes, sizes, reach), new, several


def _members(columns, rows: np.ndarray) -> dict:
    keys, nodes, sizes, reach = (c[rows] for c in columns)
    return {"kind": pa.array(["b"] * len(keys), pa.string()), "a": pa.array(keys.view(np.int64)), "b": pa.array(nodes),
            "x": pa.array(sizes), "y": pa.array(reach), "bits": pa.nulls(len(keys), pa.binary())}


def _index(parts: int, prefixes):
    """Documents as rows ``d`` (id, node, size, second fingerprint), and keys by part.

    Where several nodes of one flush share a key the task hands on one of them
    and lists all as rows ``b`` (key, node, size, reach), which travel evenly: of
    a very frequent key a task sends one row to the place where the key meets.
    """

    def flush(held: _Held) -> Iterator[pa.RecordBatch]:
        columns, new, several = held.groups()
        rows = _members(columns, several)
        spread = (mix(columns[1][several].view(np.uint64)) % _U(parts)).astype(np.int32)
        none = pa.nulls(int(several.sum()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(spread), *rows.values(), *[none] * len(_BLOBS)], schema=_INDEX_ARROW)
        key, node, size, reach = (c[new] for c in columns)
        part = (key % _U(parts)).astype(np.int32)
        order = np.lexsort((node, part))
        key, node, size, reach, part = key[order], node[order], size[order], reach[order], part[order]
        blobs = []
        for own in np.split(np.arange(len(key)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            if len(own):
                names, at, repeats = np.unique(node[own], return_index=True, return_counts=True)
                values = (key[own], names, repeats.astype(np.int32), size[own][at].astype(np.int32), reach[own].astype(np.int32))
                blobs.append({"part": int(part[own[0]]), "kind": "k",
                              **{c: v.tobytes() for c, v in zip(_BLOBS, values, strict=True)}})
        yield pa.RecordBatch.from_pylist(blobs, _INDEX_ARROW)

    @releasing
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, held = Prefixes(*prefixes.value), set(), _Held()
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                tokens, bounds = shingle_sets(texts)
                node, check = fingerprints(tokens, bounds)
                size = np.diff(bounds)
                rows = np.flatnonzero(_new_sets(node, seen))
                spread = np.arange(len(ids), dtype=np.int32) % parts  # documents travel evenly, copies too
                bits = [None] * len(ids)  # once for a task's copies
                for i, sketch in zip(rows.tolist(), parities(tokens, bounds) if len(rows) == len(ids) else
                                     parities(tokens[_take(bounds, rows)[0]], _take(bounds, rows)[1]), strict=True):
                    bits[i] = sketch
                none = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread), pa.array(["d"] * len(ids)), pa.array(ids, pa.int64()), pa.array(node),
                     pa.array(size), pa.array(check), pa.array(bits, pa.binary()), *[none] * len(_BLOBS)], schema=_INDEX_ARROW)
                at, new = _take(bounds, rows)
                keys, reach, owner = make.keys(tokens[at], new)
                held.add(keys, node[rows][owner], size[rows][owner], reach)
                if held.rows >= FLUSH:
                    yield from flush(held)
                    held = _Held()
        if held.rows:
            yield from flush(held)

    return index


@releasing
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition: documents and members as they are, and the members of keys that meet here."""
    held, names = _Held(), ["kind", *_PLAIN, "bits"]
    for batch in batches:
        kind = np.asarray(batch.column("kind").to_pandas())
        plain = batch.filter(pa.array(kind != "k")).select(names)
        if len(plain):
            yield plain
        for row in batch.filter(pa.array(kind == "k")).select(list(_BLOBS)).to_pylist():
            repeats = np.frombuffer(row["repeats"], np.int32)
            held.add(np.frombuffer(row["keys"], np.uint64), np.repeat(np.frombuffer(row["nodes"], np.int64), repeats),
                     np.repeat(np.frombuffer(row["sizes"], np.int32), repeats).astype(np.int64),
                     np.frombuffer(row["reach"], np.int32).astype(np.int64))
    columns, _, several = held.groups()
    yield pa.RecordBatch.from_pydict(_members(columns, several))


# ---------------------------------------------------------------- verification

def _bloom_places(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h >> _U(64 - BLOOM_BITS), mix(h + _U(1)) >> _U(64 - BLOOM_BITS)])


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of a column ``id``; 2 ** BLOOM_BITS whatever their number."""

    @releasing
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bloom_places(np.asarray(batch.column("id"))))
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)),
                                              pa.array((_U(1) << (at & _U(63))).view(np.int64))], ["word", "bits"])

    words = (ids.where("id IS NOT NULL").mapInArrow(places, "word bigint, bits bigint")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())  # 2 ** (BLOOM_BITS - 6) rows at most
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_filter(ids, bits):
    """Whether the filter may hold an id; rows without id pass."""

    @F.arrow_udf("boolean")
    @releasing
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            at = _bloom_places(np.asarray(values.fill_null(0)))
            yield pa.array((bits.value[at >> _U(6)] >> (at & _U(63)) & _U(1)).all(0) | np.asarray(values.is_null()))

    return held(ids.cast("bigint"))


def _node_in_filter(ids, text, bits):
    """struct<held, node>: whether the filter may hold the id, and then the node of its text; one worker does both."""

    @F.arrow_udf("struct<held:boolean,node:bigint>")
    @releasing
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, texts in batches:
            at = _bloom_places(np.asarray(values.fill_null(0)))
            hit = (bits.value[at >> _U(6)] >> (at & _U(63)) & _U(1)).all(0) | np.asarray(values.is_null())
            some = texts.filter(pa.array(hit))
            parts = [fingerprints(*shingle_sets(part))[0] for _, part in slices(pa.nulls(len(some)), some)]
            nodes = np.zeros(len(texts), np.int64)
            nodes[hit] = np.concatenate([np.empty(0, np.int64), *parts])
            yield pa.StructArray.from_arrays([pa.array(hit), pa.array(nodes)], ["held", "node"])

    return found(ids.cast("bigint"), text)


def _sets_of(bits):
    """(node, tokens) of the rows whose id is in the filter; rows without id pass."""

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            at = _bloom_places(np.asarray(ids.fill_null(0)))
            hit = (bits.value[at >> _U(6)] >> (at & _U(63)) & _U(1)).all(0) | np.asarray(ids.is_null())
            batch = batch.filter(pa.array(hit))
            for _, texts in slices(batch.column(0), batch.column(1)):
                tokens, bounds = shingle_sets(texts)
                node, _ = fingerprints(tokens, bounds)
                rows = np.flatnonzero(_new_sets(node, seen))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.array([tokens[bounds[i]:bounds[i + 1]].tobytes() for i in rows.tolist()], pa.binary())],
                    ["node", "tokens"])

    return sets


@releasing
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, two in zip(batch.column("left"), batch.column("right"), strict=True):
            u, v = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(u) + len(v) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link. ``nodes``: (node, id of one of its rows)."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node"))
    bits = rows.sparkSession.sparkContext.broadcast(_bloom(wanted))
    sets = stored(rows.mapInArrow(_sets_of(bits), "node bigint, tokens binary")
                  .join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    side = {c: sets.join(pairs.select(F.col(c).alias("node")).distinct(), "node", "left_semi")
            .withColumnsRenamed({"node": c, "tokens": name}) for c, name in (("a", "left"), ("b", "right"))}
    both = pairs.select("a", "b").join(side["b"], "b").join(side["a"], "a")
    return stored(both.select("a", "b", "left", "right").mapInArrow(_linked, "a bigint, b bigint"))


#: Two rows of one key that can link.
_CAN_LINK = "size1 <= reach2 AND size2 <= reach1"


def _numbered(group: DataFrame, i: int) -> DataFrame:
    return group.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("node", "size", "reach", "component")])


@releasing
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint64).reshape(batch.num_rows, -1)
                    for c in ("bits_a", "bits_b"))
        apart = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(9 * apart <= np.asarray(batch.column("sizes"))))


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    side = {c: nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("size").alias(f"n_{c}")) for c in "ab"}
    both = pairs.select("a", "b").join(side["a"], "a").join(side["b"], "b")
    return both.select("a", "b", "bits_a", "bits_b", (F.col("n_a") + F.col("n_b")).alias("sizes")).mapInArrow(_close, "a bigint, b bigint")


def _round(group: DataFrame, tried: DataFrame, number: int, best: int) -> DataFrame:
    """New pairs (a, b): each document's best candidates among the pivots of its keys, by the keys they share."""
    order = F.xxhash64("node", F.lit(number))
    pivot = group.groupBy("key").agg(
        F.max_by(F.struct("node", "size", "reach", "component"), order).alias("pivot")).select("key", "pivot.*")
    pairs = (_numbered(group, 1).join(_numbered(pivot, 2), "key").where("component1 <> component2").where(_CAN_LINK)
             .groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("shared"))
             .join(tried.select(F.col("a").alias("node1"), F.col("b").alias("node2"), F.lit(1).alias("old"))
                   .unionAll(tried.select("b", "a", F.lit(1))), ["node1", "node2"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("node1").orderBy(F.desc("shared"), "node2"))  # a set's keys at most
    return (pairs.withColumn("place", place).where(F.col("place") <= best)
            .select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct())


def _sketch_words(nodes: DataFrame) -> DataFrame:
    """(node, w0, w1, ...): the sketch as 64-bit words."""
    word = [F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("bigint").alias(f"w{i}") for i in range(SKETCH // 64)]
    return nodes.select("node", *word)


def _cross_pairs(group: DataFrame, words: list[str]) -> DataFrame:
    """Rows (a, b, size1, size2, words of both) for pairs under one key that can link and lie in different components."""
    one, two = (group.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("node", "size", "reach", "component")],
                             *[F.col(w).alias(f"{w}_{i}") for w in words]) for i in (1, 2))
    return (one.join(two, "key").where("node1 < node2 AND component1 <> component2").where(_CAN_LINK)
            .withColumnsRenamed({"node1": "a", "node2": "b"}))


def _mixed(members: DataFrame, parts_of: DataFrame) -> DataFrame:
    """Members of the keys whose members lie in different components."""
    group = members.join(parts_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (group.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                      F.count(F.lit(1)).alias("members")).where("low <> high"))
    return stored(group.join(mixed.select("key", "members"), "key"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, node, n_tokens, component (smallest id reachable by links, itself included).

    Words are runs of other bytes than \\x20 and \\x09-\\x0D, A-Z in lower case.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prefixes = spark.sparkContext.broadcast(frequent_slots(rows, parts))
    found = stored(rows.mapInArrow(_index(parts, prefixes), _INDEX).repartition("part").mapInArrow(_meet, _FOUND))
    listed = found.where("kind = 'd'").select(F.col("a").alias("id"), F.col("b").alias("node"), F.col("x").alias("size"),
                                              F.col("y").alias("check"), "bits")
    nodes = stored(listed.groupBy("node").agg(F.min("id").alias("id"), F.min("check").alias("low"), F.max("check").alias("high"),
                                              F.max("size").alias("size"), F.max("bits").alias("bits")))
    if not nodes.where("low <> high").isEmpty():
        raise RuntimeError("two different sets share a fingerprint; change the constants of fingerprints()")

    members = found.where("kind = 'b'").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("x").alias("size"),
                                               F.col("y").alias("reach"))
    members = stored(members.groupBy("key", "node").agg(F.max("size").alias("size"), F.max("reach").alias("reach")))
    tried = links = spark.createDataFrame([], "a bigint, b bigint")
    parts_of = spark.createDataFrame([], "node bigint, component bigint")
    group = members.withColumn("component", F.col("node"))
    for number in range(ROUNDS):
        pairs = stored(_round(group, tried, number, BEST))
        tried = tried.unionAll(pairs)
        links = links.unionAll(_verify(stored(_promising(pairs, nodes)), rows, nodes))
        parts_of = components(links)
        group = _mixed(members, parts_of)
    # keys with many members compare sketches while they are joined, so only promising pairs become rows
    apart = " + ".join(f"bit_count(w{i}_1 ^ w{i}_2)" for i in range(SKETCH // 64))
    dense = group.where(F.col("members") > DENSE).join(_sketch_words(nodes), "node")
    rest = (_cross_pairs(group.where(F.col("members") <= DENSE), [])
            .select("a", "b").unionAll(_cross_pairs(dense, [f"w{i}" for i in range(SKETCH // 64)]).where(f"9 * ({apart}) <= size1 + size2").select("a", "b"))
            .distinct().join(tried, ["a", "b"], "left_anti"))
    rest = stored(_promising(rest, nodes))
    if not rest.isEmpty():
        links = links.unionAll(_verify(rest, rows, nodes))
        parts_of = components(links)

    of_node = nodes.join(parts_of, "node", "left").select("node", "id", F.coalesce("component", "node").alias("set"))
    least = of_node.join(of_node.groupBy("set").agg(F.min("id").alias("least")), "set").select("node", "least")
    return (listed.drop("bits").join(least, "node")
            .select("id", "node", F.col("size").alias("n_tokens"),
                    F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id")).alias("component")))


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component, with every input column and no other.

    Rows without tokens link with nothing and stay; rows of one component that
    share its smallest id all stay, as do those of a component without any id.
    """
    found = similar_documents(docs, id_col, text_col)
    gone = stored(found.where("id IS DISTINCT FROM component").select("id", "node").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(gone.select("id")))
    # only rows that the filter lets through are joined, so the texts of the others are not shuffled
    free = rows.where(~_in_filter(F.col("id"), bits)).select("row")
    maybe = (rows.withColumn("f", _node_in_filter(F.col("id"), F.col(f"row.`{text_col}`"), bits)).where("f.held")
             .select("row", "id", F.col("f.node").alias("node")))
    same = maybe["id"].eqNullSafe(gone["id"]) & (maybe["node"] == gone["node"])
    return free.unionAll(maybe.join(gone, same, "left_anti").select("row")).select("row.*")
