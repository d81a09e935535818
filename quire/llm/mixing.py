"""Mixing sources to target weights with hash thresholds: no sort, no random numbers, the same rows on every run.

Sizes are summed by source and by the leading bits of a hash. Where the running sum of a source passes its budget lies the
boundary bucket; only its rows are counted again by the next bits, and so on. The final threshold is a hash prefix, so a
smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import checked_broadcast, fresh, split_words, stored

#: Bits of the hash that each level of the histogram looks at, and the number of levels.
BITS, LEVELS = 12, 4
HASH_BITS = BITS * LEVELS


def place(key: Column, text: Column) -> Column:
    """48 bits of a hash of a row's id and text."""
    row = F.concat_ws("\x01", F.coalesce(key.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(row), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, budget: int | None = None) -> DataFrame:
    """(source, source_size) with ``target``: shares of ``budget`` (all sizes, if None) by weight, none above ``cap`` times its size.

    Sources by code point, null last, weigh ``weights`` in turn. What a source cannot take is shared by weight among the
    rest until none is above its cap: the full ones are those with the smallest cap per weight. One row per source goes
    through one task; sources are names of collections, thousands of them at most.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("cap"))
    total = F.sum("source_size").over(every) if budget is None else F.least(F.lit(budget).cast("long"), F.sum("cap").over(every))
    rows = rows.withColumn("total", total)
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.sum("cap").over(filled) - F.col("cap")
    weight_left = F.sum("weight").over(every) - F.sum("weight").over(filled) + F.col("weight")
    rows = rows.withColumn("full", F.col("cap") * weight_left <= (F.col("total") - before) * F.col("weight"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    share = (left * F.col("weight")).cast("double") / open_weight
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): each row is taken ``whole`` times, and once more where its place is under ``below``.

    ``rows``: (source, place, size), stored. A histogram has at most 4,096 buckets a source, however many rows it has.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.select("source", "source_size", "target", whole.alias("whole")).select(
        "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("below")
    )
    state = stored(state.select("*", (F.col("left") > 0).alias("open")))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        looked = checked_broadcast(state.filter("open").select(F.col("source").alias("s"), "below", "left"))
        in_edge = F.shiftright("place", shift + BITS) == F.shiftright("below", shift + BITS)
        inside = rows.join(looked, F.col("source").eqNullSafe(F.col("s")) & in_edge)
        buckets = inside.groupBy("s", "left", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("sum"))
        buckets = buckets.withColumn("through", F.sum("sum").over(W.partitionBy("s").orderBy("bucket")))
        edge = buckets.filter("through > left").groupBy("s").agg(
            F.min("bucket").alias("bucket"), F.min_by(F.struct("sum", "through"), "bucket").alias("at")
        )
        moved = state.join(edge, F.col("source").eqNullSafe(F.col("s")) & F.col("open"), "left")
        remains = F.col("left") - (F.col("at.through") - F.col("at.sum"))
        # the last bucket is taken or left, whichever comes nearer to the budget
        more = F.when(2 * remains >= F.col("at.sum"), 1).otherwise(0) if level == LEVELS else F.lit(0)
        below = F.coalesce(F.shiftleft(F.col("bucket") + more, shift), F.col("below") + F.when(F.col("open"), 1 << (shift + BITS)).otherwise(0))
        state = stored(moved.select(
            "source", "source_size", "target", "whole", F.coalesce(remains, F.col("left")).alias("left"),
            below.cast("long").alias("below"), (F.col("open") & F.col("bucket").isNotNull()).alias("open"),
        ))
    return state.select("source", "source_size", "target", "whole", "below")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, budget: int | None = None,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of its source) and ``taken`` (words the mix takes).

    Every row stays; one that the mix leaves out has ``taken`` 0, one taken twice twice its size. A null text has size 0, null
    sources form a source of their own. Rows equal in id and text share a place and are taken alike, so a source made of
    copies of one row can miss its target by half their size at most. An empty table gives an empty one. Columns of ``docs`` named like the four new ones
    are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    s, p, n, q, v = fresh(docs, "s_", "p_", "n_", "q_", "v_")
    placed = docs.select(
        *[F.col(f"`{c}`") for c in rest], F.col(source).alias(s), place(F.col(key), F.col(text)).alias(p),
        F.size(split_words(F.col(text))).cast("long").alias(n),
    )
    rows = stored(placed.select(F.col(s).alias("source"), F.col(p).alias("place"), F.col(n).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = thresholds(rows, targets(sizes, weights, cap, budget))
    per = checked_broadcast(per.select(F.col("source").alias(q), F.struct("source_size", "target", "whole", "below").alias(v)))
    got = F.col(v)
    return placed.join(per, F.col(s).eqNullSafe(F.col(q)), "left").select(
        *[F.col(f"`{c}`") for c in rest], F.col(n).alias("size"), got["source_size"].alias("source_size"), got["target"].alias("target"),
        (F.col(n) * (got["whole"] + (F.col(p) < got["below"]).cast("long"))).alias("taken"),
    )
