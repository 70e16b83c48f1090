"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources are ordered by code point, null last, and weigh 3, 1, 2 repeating. They
share a budget of 150 % of all words; a source's target stops at twice its
size, and what is above is shared again by weight. The whole budget is dealt to
the sources by the highest quotients target / (2 s + 1), and a source's part to
its shards by size / (2 s + 1); a shard is a hashed part of a source, so a hot
source has many. Both deal blocks of one word, the finest equal ones: blocks of
``BLOCK_WORDS`` would leave a source of a few words without any.

In a shard the documents lie in seeded random order on a line of n words. A
quota of q words takes the line q div n times and then the q mod n words that
follow a seeded place, a multiple of the block, around the end: whole blocks
and, at the run's end, the part of one that is still missing. They are one run,
so almost every document is taken whole; only those at the two ends of the run
are cut. No word is taken more than twice, so no document either.

The tables of sources and shards are tiny beside the documents (a shard has
about ``SHARD_WORDS`` words); of documents, only (id, source, size) are shuffled.

Defined results: a null text has no words and nothing is taken of it; rows
without source are one source, the last; repeated rows are taken one by one;
an empty table gives an empty result; equal inputs give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0  # words of the mix, and of one source at most, as shares of what there is
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in order of most * size / weight: the first ones stop at their
    most, the others share the rest by weight. One row a source is windowed.
    """
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    source = source.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    full = F.col("source_size") * F.lit(most)
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    source = (source.withColumns({"full": full, "ratio": full / F.col("weight")})
              .withColumn("level", (F.sum("source_size").over(every) * F.lit(budget)
                                    - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
              .withColumn("level", F.max("level").over(every)))  # it rises while sources fill up and falls beyond
    return source.select("source", "source_size", F.least("full", F.col("level") * F.col("weight")).alias("target"))


def apportion(rows: DataFrame, group: str, weight: str, seats: str, name: str = "quota") -> DataFrame:
    """``rows`` with each row's seats by the highest quotients weight / (2 s + 1) within its group.

    ``seats`` is the group's number of seats, the same in all its rows; ``key``
    breaks ties. A row's seats differ little from its share, so only the
    quotients around it are ranked; where a row's whole stretch is taken or
    none of it, the stretch was too short and is doubled.
    """
    total = F.sum(weight).over(Window.partitionBy(group))
    rows = rows.withColumn("_share", F.when(total > 0, F.floor(F.col(seats) * F.col(weight) / total)).otherwise(0))
    reach = 2
    while True:
        low = rows.withColumn("_low", F.greatest(F.lit(0), F.col("_share") - reach))
        low = low.withColumn("_left", F.col(seats) - F.sum("_low").over(Window.partitionBy(group)))
        each = low.select(group, "key", "_low", "_left", weight, F.explode(F.sequence("_low", F.col("_share") + reach)).alias("_s"))
        rank = F.row_number().over(Window.partitionBy(group).orderBy(
            (F.col(weight) / (2 * F.col("_s") + 1)).desc(), "key", "_s"))
        won = (each.where(F.col(weight) > 0).withColumn("_rank", rank).groupBy(group, "key", "_low")
               .agg(F.count(F.when(F.col("_rank") <= F.col("_left"), 1)).alias("_won")))
        won = stored(won)
        short = won.where((F.col("_won") > 2 * reach) | ((F.col("_won") == 0) & (F.col("_low") > 0)))
        if short.isEmpty():
            quota = won.select(F.col(group).alias("_g"), F.col("key").alias("_k"), (F.col("_low") + F.col("_won")).alias(name))
            return (rows.join(quota, (F.col(group) == F.col("_g")) & (F.col("key") == F.col("_k")), "left")
                    .drop("_g", "_k", "_share").fillna(0, [name]))
        reach *= 2
        if reach > 1 << 20:  # seats differ from shares by about half a row's quotient: this is a fault of the weights
            raise RuntimeError("no whole quotas within 2^20 seats of the shares; are weights finite and above 0?")


def source_quotas(targets: DataFrame, most: float = MOST) -> DataFrame:
    """``targets`` with each source's number, which stands for it, null included, and its words of the whole budget."""
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = targets.withColumns({"number": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())),
                                "all": F.lit(0), "seats": F.round(F.sum("target").over(every)).cast("bigint")})
    dealt = apportion(stored(rows.withColumn("key", F.col("number"))), "all", "target", "seats", "source_words")
    full = F.floor(F.col("source_size") * F.lit(most))
    return dealt.withColumn("source_words", F.least("source_words", full)).drop("all", "key", "seats")


def _sharded(sized: DataFrame, targets: DataFrame, shard_words: int, seed: int) -> DataFrame:
    """Rows with their shard and their source's figures."""
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    figures = targets.withColumn("shards", shards).withColumnRenamed("source", "_source")
    return (sized.join(figures, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("shards"))))


def _shard_plans(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """Words, quota and first word of every shard."""
    shards = (rows.groupBy("number", "shard").agg(F.sum("size").alias("words"), F.first("source_words").alias("seats"))
              .withColumn("key", F.col("shard")))
    shards = apportion(shards, "number", "words", "seats")
    quota = F.least(F.col("quota"), 2 * F.col("words"))
    blocks = F.ceil(F.col("words") / block)
    return (shards.where("words > 0").withColumns({
        "passes": F.floor(quota / F.col("words")), "extra": quota % F.col("words"),
        "first": block * F.pmod(F.xxhash64("number", "shard", F.lit(seed)), blocks)})
        .select("number", "shard", "words", "passes", "extra", "first"))


def _taken(rows: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """Rows with ``passes`` and the cut spans (from, to) of their words."""
    line = Window.partitionBy("number", "shard").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "tie")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = rows.join(shards, ["number", "shard"], "left")
    last = F.col("first") + F.col("extra")

    def span(a: Column, b: Column) -> Column:
        begin = F.greatest(F.col("start"), a) - F.col("start")
        end = F.least(F.col("start") + F.col("size"), b) - F.col("start")
        return F.when(end > begin, F.struct(begin.alias("from"), end.alias("to")))

    spans = F.array(span(F.col("first"), F.least(last, F.col("words"))), span(F.lit(0), last - F.col("words")))
    return rows.withColumns({"passes": F.coalesce("passes", F.lit(0)), "spans": F.filter(spans, lambda s: s.isNotNull())})


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words, repeats counted)."""
    text = F.col(f"`{text_col}`")
    sized = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                               words_in(text).alias("size"), F.xxhash64(text).alias("tie")))
    rows = _sharded(sized, stored(source_quotas(stored(source_targets(sized)))), shard_words, seed)
    shards = _shard_plans(rows, block, seed)
    cut = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    return _taken(rows, shards, seed).select(
        "id", "size", "source_size", "target", (F.col("passes") * F.col("size") + cut).cast("bigint").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """The mix itself: each document once for every whole pass, and once for each cut span with those words.

    Columns are those of the input; of a cut document the words are joined by spaces.
    """
    text = F.col(f"`{text_col}`")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.col(f"`{source_col}`").alias("source"), words_in(text).alias("size"), F.xxhash64(text).alias("tie"))
    small = stored(sized.drop("row"))
    targets = stored(source_quotas(stored(source_targets(small))))
    shards = stored(_shard_plans(_sharded(small, targets, shard_words, seed), block, seed))
    rows = _sharded(sized, targets, shard_words, seed)
    rows = _taken(rows, shards, seed)
    body = F.col("row").getField(text_col)
    whole = F.array_repeat(body, F.col("passes").cast("int"))
    pieces = F.transform("spans", lambda s: F.when((s["from"] == 0) & (s["to"] == F.col("size")), body).otherwise(F.array_join(
        F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), (s["from"] + 1).cast("int"),
                (s["to"] - s["from"]).cast("int")), " ")))
    rows = rows.where("size > 0").select("row", F.explode(F.concat(whole, pieces)).alias("piece"))
    return rows.select(F.col("row").withField(text_col, F.col("piece")).alias("row")).select("row.*")
