"""Conversation structure repair by a grammar-compressed dynamic program.

A conversation is its rows by (turn, nulls first; role; text). Each row's first
fault counts: ``blank`` (no character but \\x20 and \\x09-\\x0D), ``duplicate``
(role and text seen earlier in the conversation), ``truncated`` (the last such
character is none of ``.!?``). The cheapest edits then give role initials
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank
and duplicate rows), Insert an empty user or assistant turn 2; a truncated row that
stays adds 1. Ties go to the ASCII-least string of edit initials.

A row is one of nine symbols (initial s, u, a or another, truncated or not; or
"must go"). The symbol sequences of a slice of conversations are compressed
together by Re-Pair: the most frequent pair becomes a rule until no pair occurs
twice, so rules are shared across conversations. Every symbol and rule has one
transfer matrix over the four states of the target grammar (nothing yet, after s,
after u, after a) in the min-plus semiring, each entry with the rope of its
edits; matrices are made bottom-up, once a rule, and a conversation is the product
of its few top symbols. Equal costs between the same two states never have one
audit as a prefix of another (it would differ by inserts, which cost), so the
least audit of a product is made of least audits.

Spark sorts rows by sampled ranges of (conversation, turn, role, head of the
text). Conversations that lie inside one range and under ``MAX_ROWS`` rows and
``MAX_CHARS`` characters are finished there in one pass. The others (at most two a
range, and large ones) go a second way: earlier occurrences come from a grouped
minimum, ranges are cut into pieces under the same bounds, one small task a
conversation folds the pieces' matrices, and the pieces are repaired in parallel.
A conversation of any size is spread over all ranges; what one task holds of it is
its pieces' matrices, some bytes a row.

Defined results: null conversation ids form one conversation; null turns come first
and form no gap; a null role or text is one space; role initials are the first
character as it stands, so other roles than s..., u..., a... can't be kept; rows equal
in all columns are duplicates after the first; a row marked as absent only keeps its
conversation in the result, so one without rows gives zeros, an empty audit and no
turns; very long texts are pieces of their own; gaps saturate at 2^63 - 1; an empty
table gives an empty result; other columns of the input, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stored
from .words import releasing

MAX_ROWS = 4_000  # of a piece
MAX_CHARS = 4_000_000
HEAD = 32  # characters of a text that sort ranges

ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
GONE = 8  # symbol of rows that must go
LARGEST = (1 << 63) - 1

Rope = str | tuple
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


# ---- the min-plus semiring with audit ropes

def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def joined(a: Rope, b: Rope) -> Rope:
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) < 64:
        return a + b
    return (a, b)


def least(entries: Iterable[Entry]) -> Entry:
    """Cheapest entry, ties to the ASCII-least audit."""
    best, text = None, None
    for e in entries:
        if e is None or best is not None and e[0] > best[0]:
            continue
        if best is None or e[0] < best[0]:
            best, text = e, None
            continue
        text, other = flat(best[1]) if text is None else text, flat(e[1])
        if other < text:
            best, text = e, other
    return best


def times(a: Matrix, b: Matrix) -> Matrix:
    def through(row: list[Entry], q: int) -> Entry:
        return least((x[0] + y[0], joined(x[1], y[1])) for x, y in zip(row, (r[q] for r in b), strict=True) if x and y)
    return [[through(row, q) for q in range(4)] for row in a]


def _step(state: int, initial: str) -> int | None:
    """State after a turn with this initial; None where the grammar has no such turn."""
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))


def _needed(state: int) -> str:
    return "a" if state == 2 else "u"


def _inserts() -> Matrix:
    """Fewest inserts from state to state."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        q, edits = p, ""
        while out[p][q] is None:
            out[p][q] = (2 * len(edits), edits)
            q, edits = _step(q, _needed(q)), edits + "I"
    return out


INSERTS = _inserts()


def _row_matrix(symbol: int) -> Matrix:
    """Inserts before a row, then the row's own edit."""
    out: list[list[list[Entry]]] = [[[] for _ in range(4)] for _ in range(4)]
    for p in range(4):
        out[p][p].append((3, "D"))
        if symbol != GONE:
            late = symbol // 4
            kept = _step(p, "sua?"[symbol % 4])
            if kept is not None:
                out[p][kept].append((late, "K"))
            out[p][_step(p, _needed(p))].append((2 + late, "R"))
    return times(INSERTS, [[least(e) for e in row] for row in out])


TERMINALS = [_row_matrix(k) for k in range(GONE + 1)]


# ---- Re-Pair

def repair_rules(sequences: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """(rules, compressed sequences): rule i stands for symbol GONE + 1 + i; no pair is left that occurs twice."""
    x = np.concatenate([np.empty(0, np.int64), *(np.r_[s.astype(np.int64), -1] for s in sequences)])
    rules: list[tuple[int, int]] = []
    while len(x) > 1:
        a, b = x[:-1], x[1:]
        keys = ((a << 32) | b)[(a >= 0) & (b >= 0)]
        found, counts = np.unique(keys, return_counts=True)
        left, right = found >> 32, found & 0xFFFFFFFF
        order = np.argsort(-counts, kind="stable")
        for k in order[counts[order] > 1].tolist():
            at = np.flatnonzero((a == left[k]) & (b == right[k]))
            if left[k] == right[k]:  # in a run every other place begins a pair
                first = np.r_[True, np.diff(at) != 1]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            if len(at) > 1:
                break
        else:
            break
        x = x.copy()
        x[at] = GONE + 1 + len(rules)
        rules.append((int(left[k]), int(right[k])))
        x = np.delete(x, at + 1)
    ends = np.flatnonzero(x == -1)
    return rules, [part[part >= 0] for part in np.split(x, ends + 1)[: len(sequences)]]


def transfer(sequences: list[bytes]) -> dict[bytes, Matrix]:
    """Matrix of each distinct sequence of symbols, by way of one shared grammar."""
    distinct = sorted(set(sequences))
    rules, tops = repair_rules([np.frombuffer(s, np.uint8) for s in distinct])
    matrices = list(TERMINALS)
    for left, right in rules:
        matrices.append(times(matrices[left], matrices[right]))
    out = {}
    for name, top in zip(distinct, tops, strict=True):
        m = None
        for k in top.tolist():
            m = matrices[k] if m is None else times(m, matrices[k])
        out[name] = m
    return out


def closed(vector: list[Entry]) -> Entry:
    """Cheapest end in an accepting state, after the last inserts."""
    return least(times([vector, *[[None] * 4] * 3], INSERTS)[0][q] for q in (0, 3))


def repaired(audit: str, rows: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave or make, from ``state`` on."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[_needed(state)]
        state = _step(state, role[:1])
        out.append((edit, role, text))
    return out


# ---- rows

def _fault(text: str) -> str:
    bare = text.strip(BLANKS)
    return "blank" if not bare else "" if bare[-1] in ".!?" else "truncated"


class _Piece:
    """Rows of one conversation that follow each other, with additive counts."""

    def __init__(self, conv, before: _Piece | None = None):
        self.conv, self.before = conv, before
        self.rows: list[tuple[str, str]] = []
        self.symbols = bytearray()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "gaps"), 0)
        self.chars = 0
        self.first: tuple | None = None  # (turn, initial) of the first row
        self.last: tuple | None = None
        self.row = before.row if before else None  # the row before

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        seen = seen or self.row == (turn, role, text)
        self.row = (turn, role, text)
        fault = _fault(text)
        fault = "duplicate" if fault != "blank" and seen else fault
        initial = role[:1]
        self.symbols.append(GONE if fault in ("blank", "duplicate") else ("sua".find(initial) % 4 if initial else 3) + 4 * (fault == "truncated"))
        if fault:
            self.counts[fault] += 1
        link(self.counts, self.last, (turn, initial))
        self.first = self.first or (turn, initial)
        self.last = (turn, initial)
        self.rows.append((role, text))
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= MAX_ROWS or self.chars >= MAX_CHARS


def link(counts: dict, one: tuple | None, two: tuple | None) -> None:
    """Count what lies between two neighbours (turn, initial)."""
    if one and two:
        counts["illegal"] += (one[1] + two[1]) not in ("su", "ua", "au")
        if one[0] is not None and two[0] is not None:
            counts["gaps"] = min(LARGEST, counts["gaps"] + max(0, two[0] - one[0] - 1))


COUNTED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
REPAIRED = "cost bigint, audit string, turns array<struct<edit:string,role:string,text:string>>"
_COUNTS = [c.split()[0] for c in COUNTED.split(", ")]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _finish(pieces: list[_Piece]) -> Iterator[dict]:
    """Whole conversations of a slice, repaired with one grammar."""
    matrices = transfer([bytes(p.symbols) for p in pieces if p.rows])
    for p in pieces:
        cost, audit = 0, ""
        if p.rows:
            cost, rope = closed(matrices[bytes(p.symbols)][0])
            audit = flat(rope)
        yield {"conv": p.conv, **p.counts, "cost": cost, "audit": audit, "turns": _structs(repaired(audit, p.rows)), "open": False}


def _structs(turns: list[tuple[str, str, str]]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in turns]


def _whole_conversations(schema: pa.Schema):
    """Task over a sorted range: the conversations inside it; of the first, the last and large ones only the ids."""

    @releasing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pieces: list[_Piece], opened: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([*_finish(pieces), *({"conv": c, "open": True} for c in opened)], schema=schema)

        ready: list[_Piece] = []
        held, now, known, first, large = 0, None, set(), True, False
        for r in _stream(batches):
            if now is None or r["conv"] != now.conv:
                if now is not None:
                    if first or large:
                        yield out([], [now.conv])
                    else:
                        ready.append(now)
                        held += len(now.rows) + now.chars * MAX_ROWS // MAX_CHARS
                    first = False
                if held >= MAX_ROWS:
                    yield out(ready, [])
                    ready, held = [], 0
                now, known, large = _Piece(r["conv"]), set(), False
            if r["absent"] or large:
                continue
            key = (r["role"], r["text"])
            now.add(r["turn"], *key, key in known)
            known.add(key)
            if now.full:
                now, known, large = _Piece(r["conv"]), set(), True
        if now is not None:
            yield out(ready, [now.conv])

    return task


def _cut_pieces(schema: pa.Schema):
    """Task over a sorted range: its rows as pieces of one conversation each, with their matrices."""

    @releasing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out(p: _Piece, number: int) -> pa.RecordBatch:
            m = transfer([bytes(p.symbols)])[bytes(p.symbols)] if p.rows else _nothing()
            first, last = p.first or (None, None), p.last or (None, None)
            return pa.RecordBatch.from_pylist([{
                "conv": p.conv, **p.counts, "part": part, "number": number, "symbols": bytes(p.symbols),
                "first_turn": first[0], "first_initial": first[1], "last_turn": last[0], "last_initial": last[1],
                "costs": [e and e[0] for r in m for e in r], "audits": [e and flat(e[1]) for r in m for e in r],
                "rows": [{"role": r, "text": t} for r, t in p.rows]}], schema=schema)

        now, number = None, 0
        for r in _stream(batches):
            if now is None or r["conv"] != now.conv or now.full:
                if now is not None:
                    yield out(now, number)
                    number += 1
                now = _Piece(r["conv"], now if now is not None and r["conv"] == now.conv else None)
            if not r["absent"]:
                now.add(r["turn"], r["role"], r["text"], r["seen"])
        if now is not None:
            yield out(now, number)

    return task


def _nothing() -> Matrix:
    return [[(0, "") if p == q else None for q in range(4)] for p in range(4)]


def _chosen(vector: list[Entry], pieces: list[dict]) -> Iterator[dict]:
    """The cheapest edits of a whole conversation, cut at its pieces."""
    audit = flat(closed(vector)[1])
    at, state, before, last = 0, 0, None, len(pieces) - 1
    for n, p in enumerate(pieces):
        start, entered, cost = at, state, 0
        symbols = iter(p["symbols"])
        left = len(p["symbols"])
        while at < len(audit) and (left or n == last):
            edit = audit[at]
            symbol = GONE if edit == "I" else next(symbols)
            left -= edit != "I"
            cost += {"K": 0, "D": 3}.get(edit, 2) + (edit in "KR" and symbol // 4)
            if edit != "D":
                state = _step(state, "sua"[symbol % 4] if edit == "K" else _needed(state))
            at += 1
        counts = {"gaps": p["gaps"], "illegal": p["illegal"]}
        first = (p["first_turn"], p["first_initial"]) if p["symbols"] else None
        link(counts, before, first)
        before = (p["last_turn"], p["last_initial"]) if p["symbols"] else before
        yield {"part": p["part"], "number": p["number"], "piece": n, "pieces": len(pieces), "state": entered,
               "audit": audit[start:at], "cost": cost, **counts}


def _fold(schema: pa.Schema):
    """Task over pieces by (conv, part, number): which edits each piece takes, from which state, and what its start adds."""

    @releasing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, vector, pieces = None, [], []
        for p in _stream(batches):
            if pieces and p["conv"] != conv:
                yield pa.RecordBatch.from_pylist(list(_chosen(vector, pieces)), schema=schema)
                pieces = []
            if not pieces:
                conv, vector = p["conv"], [(0, ""), None, None, None]
            flat_matrix = [None if c is None else (c, a) for c, a in zip(p.pop("costs"), p.pop("audits"), strict=True)]
            vector = times([vector, *[[None] * 4] * 3], [flat_matrix[4 * k : 4 * k + 4] for k in range(4)])[0]
            pieces.append(p)
        if pieces:
            yield pa.RecordBatch.from_pylist(list(_chosen(vector, pieces)), schema=schema)

    return task


def _mend(schema: pa.Schema):
    """Task over pieces with their edits: the repaired turns."""

    @releasing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _stream(batches):
            rows = [(r["role"], r["text"]) for r in p.pop("rows")]
            yield pa.RecordBatch.from_pylist([p | {"turns": _structs(repaired(p["audit"], rows, p["state"]))}], schema=schema)

    return task


def _in_arrow(df: DataFrame, task, columns: str) -> DataFrame:
    """``df`` through ``task``, whose result has the conversation's id, if ``df`` has it, and ``columns``."""
    schema = StructType([f for f in df.schema.fields if f.name == "conv"])
    for f in StructType.fromDDL(columns).fields:
        schema = schema.add(f)
    return df.mapInArrow(task(to_arrow_schema(schema)), schema)


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in sampled ranges; equal rows share a range, and only a text's head is sampled."""
    head = rows.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange("conv", "turn", "role", "head")
    return head.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").drop("head")


def _across_ranges(rows: DataFrame) -> DataFrame:
    """Conversations of any size, by pieces."""
    digest = F.sha2("text", 256)
    firsts = (rows.where(~F.col("absent")).groupBy("conv", "role", digest.alias("digest"))
              .agg(F.max(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("least"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "nulls", "least"))
    seen = F.when(F.col("nulls"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    marked = (rows.withColumn("digest", digest)
              .join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
              .select("conv", "turn", "role", "text", "absent", F.coalesce(seen, F.lit(False)).alias("seen")))
    edges = "first_turn bigint, first_initial string, last_turn bigint, last_initial string"
    pieces = stored(_in_arrow(_sorted(marked), _cut_pieces, f"{COUNTED}, part int, number int, symbols binary, {edges}, "
                              "costs array<bigint>, audits array<string>, rows array<struct<role:string,text:string>>"))
    narrow = pieces.drop("rows").repartition("conv").sortWithinPartitions("conv", "part", "number")
    folded = narrow.select("conv", "part", "number", "symbols", "gaps", "illegal", "first_turn", "first_initial", "last_turn",
                           "last_initial", "costs", "audits")
    chosen = stored(_in_arrow(folded, _fold, "part int, number int, piece int, pieces int, state int, audit string, cost bigint, "
                              "gaps bigint, illegal bigint").drop("conv"))
    both = pieces.select("conv", "part", "number", "blank", "duplicate", "truncated", "rows").join(chosen, ["part", "number"])
    return _in_arrow(both, _mend, f"piece int, pieces int, {COUNTED}, {REPAIRED}")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         absent: Column | None = None) -> DataFrame:
    """Repaired conversations: (conv, piece, pieces, counts, cost, audit, turns), one row for most.

    A conversation cut into several ``pieces`` has one row for each, numbered by ``piece``; counts and cost add
    up, audits and turns follow each other. ``absent`` marks rows that are not there but name their conversation.
    """
    there = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(False) if absent is None else absent, F.lit(False)).alias("absent"))
    first = stored(_in_arrow(_sorted(there), _whole_conversations, f"{COUNTED}, {REPAIRED}, open boolean"))
    order = ["conv", "piece", "pieces", *_COUNTS, "cost", "audit", "turns"]
    inside = first.where(~F.col("open")).withColumns({"piece": F.lit(0), "pieces": F.lit(1)}).select(order)
    ids = first.where("open").select(F.col("conv").alias("c")).distinct()
    rest = there.join(ids, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    return inside.unionAll(_across_ranges(rest).select(order))


def whole_digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv, counts, cost, audit, repaired_sha256): the digest of role:text lines of the repaired conversation.

    Conversations in one piece are digested where they are. The digest of one in several pieces is a
    sequence by its definition: its pieces go through one task in order, which holds one piece and the audit.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    names = ["conv", *_COUNTS, "cost", "audit", "repaired_sha256"]
    one = repaired_rows.where("pieces = 1").withColumn("repaired_sha256", F.sha2(lines, 256)).select(names)
    more = repaired_rows.where("pieces > 1").select("conv", "piece", *_COUNTS, "cost", "audit", lines.alias("lines"),
                                                    F.size("turns").alias("n"))

    def task(schema: pa.Schema):
        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import hashlib

            def out(total: dict, audits: list[str], digest) -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([total | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema=schema)

            total, audits, digest, any_ = None, [], None, False
            for p in _stream(batches):
                if total is None or p["conv"] != total["conv"]:
                    if total is not None:
                        yield out(total, audits, digest)
                    total, audits, digest, any_ = {"conv": p["conv"], "cost": 0, **dict.fromkeys(_COUNTS, 0)}, [], hashlib.sha256(), False
                for c in (*_COUNTS, "cost"):
                    total[c] = min(LARGEST, total[c] + p[c])
                audits.append(p["audit"])
                if p["n"]:
                    digest.update((("\n" if any_ else "") + p["lines"]).encode())
                    any_ = True
            if total is not None:
                yield out(total, audits, digest)

        return run

    streamed = more.repartition("conv").sortWithinPartitions("conv", "piece")
    return one.unionAll(_in_arrow(streamed, task, f"{COUNTED}, cost bigint, audit string, repaired_sha256 string"))


def inject_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Seeded damage by crc32(conv:turn) % 20, null as a space: 0 drops a row (it is marked ``absent``), 1 empties its
    text, 2 removes ``.!?``, 3 repeats the row, 4 sets the role to user."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    code = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    given = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"),
                        spaced(text).alias("text"), code.alias("code"))
    return given.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("absent"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
