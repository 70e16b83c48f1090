"""Chat formatting in budgeted windows (DataFrame operations only).

A conversation is cut into spans of turns by prefix sums of the turns' tokens:
a turn belongs to the span its prefix sum falls in, in steps of half the room
for new turns, and a turn of more than half the room ends its span alone. So a
span of several turns never exceeds the room, and no turn is cut.

A window is the text of one training example: the system turn that opens the
conversation, then up to ``history`` earlier turns of at most
``history_tokens``, then the span's own turns. Repeated turns (system, history)
carry no loss; each assistant turn is a target in the one window that owns it.

Template: ``### <role>: <text></turn>\\n`` for each turn. In roles and texts a
backslash becomes ``\\b``, ``</turn>`` becomes ``\\e`` and ``### `` becomes
``\\h``; in roles ``: `` becomes ``\\c`` too. No control string is then left
inside a text, a turn ends at the first ``</turn>\\n``, and unescaping (``\\b``
last) gives back any text, whatever it quotes.

A long conversation is not held in one task: turns are numbered and summed in
blocks of turn numbers, and the blocks' offsets added; windows are then made
from chunks of positions with the neighbouring turns copied in. A window's text
is bounded by the budget and its longest turn.

Defined results: a null text or role counts as empty; null turns come first,
and turns with equal numbers follow by role and text; repeated rows are turns
of their own; a null conversation id is a conversation; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024  # tokens of a window's own turns, system turn and history not counted
HISTORY, HISTORY_TOKENS = 2, 256
BLOCK, CHUNK = 1024, 1024  # turn numbers of a block, positions of a chunk

OPEN, AFTER_ROLE, CLOSE, LINE = "### ", ": ", "</turn>", "\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(F.replace(out, F.lit(CLOSE), F.lit("\\e")), F.lit(OPEN), F.lit("\\h"))
    return F.replace(out, F.lit(AFTER_ROLE), F.lit("\\c")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\c"), F.lit(AFTER_ROLE)) if role else text
    out = F.replace(F.replace(out, F.lit("\\h"), F.lit(OPEN)), F.lit("\\e"), F.lit(CLOSE))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Words, and one for the template."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("bigint")


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their position ``k`` and the tokens before them in the conversation."""
    turns = turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    order = ["turn", "role", "text"]
    key = F.col("conv").isNull(), F.coalesce("conv", F.lit(0))
    turns = turns.withColumns({"none": key[0], "key": key[1]})
    inside = Window.partitionBy("none", "key", "block").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("none", "key", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("none", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("none", "key", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                           F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    return (turns.withColumns({"i": F.row_number().over(inside) - 1, "s": F.coalesce(F.sum("tokens").over(before), F.lit(0))})
            .join(blocks, ["none", "key", "block"])
            .withColumns({"k": (F.col("n0") + F.col("i")).cast("bigint"), "before": F.col("t0") + F.col("s")})
            .drop("block", "i", "s", "n0", "t0"))


def format_windows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", budget: int = BUDGET, history: int = HISTORY,
                   history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv, first (position of its first own turn), formatted, spans.

    ``spans`` is an array of (start, end, kind, k): code points of ``formatted``
    between role and end mark, kind "system", "history", "own" or "target" (a
    target carries the loss), and the turn's position.
    """
    turns = conversations.select(
        F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    turns = _numbered(turns.withColumn("tokens", tokens(F.col("text"))))
    half = max(1, budget // 2)
    turns = turns.withColumn("span", F.struct(F.floor(F.col("before") / half).alias("step"), (F.col("tokens") > half).alias("alone")))

    # every turn also visits the next chunk, where it may be history
    near = F.col("k") % CHUNK >= CHUNK - history
    own = F.floor(F.col("k") / CHUNK)
    turns = turns.withColumn("chunk", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))))
    turns = turns.withColumn("copy", F.floor(F.col("k") / CHUNK) != F.col("chunk"))
    line = Window.partitionBy("none", "key", "chunk").orderBy("k")
    opens = F.lag("span").over(line).isNull() | (F.lag("span").over(line) != F.col("span"))
    turns = turns.withColumn("opens", (~F.col("copy")) & ((F.col("k") == 0) | opens))
    body = F.struct("k", "role", "text")
    uses = [F.when(~F.col("copy"), F.struct(F.col("span.step").alias("step"), F.col("span.alone").alias("alone"), F.lit("own").alias("kind")))]
    for ahead in range(1, history + 1):
        span, start = F.lead("span", ahead).over(line), F.lead("before", ahead).over(line)
        fits = F.lead("opens", ahead).over(line) & (start - F.col("before") <= history_tokens)
        uses.append(F.when(fits, F.struct(span["step"].alias("step"), span["alone"].alias("alone"), F.lit("history").alias("kind"))))
    used = turns.withColumn("uses", F.array(*uses))  # windows first, rows from them after
    used = used.withColumn("use", F.explode(F.filter("uses", lambda u: u.isNotNull())))
    used = used.select("conv", "none", "key", body.alias("body"), "use.*", "tokens")

    windows = used.groupBy("none", "key", "step", "alone").agg(
        F.first("conv").alias("conv"), F.min(F.when(F.col("kind") == "own", F.col("body.k"))).alias("first"),
        F.array_sort(F.collect_list(F.struct("body.k", "kind", "body.role", "body.text"))).alias("turns"))
    system = turns.where((F.col("k") == 0) & (F.col("role") == "system") & ~F.col("copy")).select(
        "none", "key", F.struct(F.col("k"), F.lit("system").alias("kind"), "role", "text").alias("system"))
    windows = windows.join(system, ["none", "key"], "left")
    kept = F.filter("turns", lambda t: F.col("system").isNull() | (t["k"] > 0) | (t["kind"] == "own"))
    # the opening window owns the system turn, the others repeat it
    windows = windows.withColumn("turns", F.when(F.col("system").isNotNull() & (F.col("first") > 0),
                                                 F.concat(F.array("system"), kept)).otherwise(kept))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(AFTER_ROLE)).alias("head"),
        F.concat(escape(t["text"]), F.lit(CLOSE + LINE)).alias("tail"), t["k"].alias("k"),
        F.when((t["kind"] == "own") & (t["role"] == "assistant"), F.lit("target")).otherwise(t["kind"]).alias("kind")))
    windows = windows.select("conv", "first", parts.alias("parts"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,k:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["tail"])
        span = F.struct(begin.alias("start"), (end - len(CLOSE + LINE)).alias("end"), p["kind"].alias("kind"), p["k"].alias("k"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return windows.select("conv", "first", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["tail"])), "").alias("formatted"),
                          F.aggregate("parts", start, add)["spans"].alias("spans"))


def read_turns(windows: DataFrame) -> DataFrame:
    """Turns read back from the windows' text: conv, first, formatted length, turns of (k, role, text, target) that the window owns.

    The text is cut at the end marks and the roles are read from the cuts; the
    spans only tell which turns are repeated and which carry the loss.
    """
    cuts = F.split("formatted", CLOSE + LINE)  # the last cut is empty
    turn = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), "spans", lambda cut, s: F.struct(
        s["k"].alias("k"), s["kind"].alias("kind"),
        unescape(F.substring_index(F.substr(cut, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1), role=True).alias("role"),
        unescape(F.substr(cut, F.instr(cut, AFTER_ROLE) + len(AFTER_ROLE))).alias("text")))
    masked = F.transform(F.filter("spans", lambda s: s["kind"] == "target"),
                         lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv", "first", F.length("formatted").cast("bigint").alias("chars"),
                          F.filter(turn, lambda t: t["kind"].isin("own", "target")).alias("turns"), masked.alias("masked"))
