"""Ordered computations over works whose sections do not fit one task.

A window ``PARTITION BY work ORDER BY number`` sends a whole work to one task, and one work may hold a third of all
rows. Here the order column, an integer that is unique in its work, is cut into value blocks of ``width`` numbers.
The window runs per (work, block); one small row per block carries the state across blocks. Where the order column has more
numbers than FAN blocks, as a 64-bit id has, the blocks are cut into blocks in their turn, and so on until a work has at most FAN of
them. So no window sees more than ``width`` rows or FAN blocks, whether the numbers lie dense or are hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 65_536
#: Blocks that one window may carry its state across.
FAN = 65_536
BLOCK = "_block"


@dataclass
class Running:
    """Running ``sum`` or ``max`` of ``value``; ``inclusive=False`` stops one row earlier."""

    value: Column
    how: str = "sum"
    inclusive: bool = True

    def local(self, group, order):
        last = Window.currentRow if self.inclusive else -1
        return self._agg()(self.value).over(
            Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        )

    def block(self, order):
        return self._agg()(self.value)

    def above(self, state):
        return Running(state, self.how, inclusive=False)

    def merge(self, local, carried):
        if self.how == "sum":
            zero = F.lit(0)
            return F.coalesce(local, zero) + F.coalesce(carried, zero)
        return F.greatest(local, carried)

    def _agg(self):
        return F.sum if self.how == "sum" else F.max


@dataclass
class Neighbour:
    """Value of the previous (``step=-1``) or next (``step=1``) row of the work."""

    value: Column
    step: int = -1

    def _fn(self):
        return F.lag if self.step < 0 else F.lead

    def local(self, group, order):
        return self._fn()(F.struct(self.value.alias("v"))).over(Window.partitionBy(*group).orderBy(order))

    def block(self, order):
        pick = F.max_by if self.step < 0 else F.min_by
        return pick(F.struct(self.value.alias("v")), F.col(order))

    def above(self, state):
        return Neighbour(state, self.step)

    def merge(self, local, carried):
        return F.coalesce(local, carried)["v"]


@dataclass
class Total:
    """``sum``, ``max`` or ``min`` of ``value`` over the whole work, on every row."""

    value: Column
    how: str = "sum"

    def local(self, group, order):
        return getattr(F, self.how)(self.value).over(Window.partitionBy(*group))

    def block(self, order):
        return getattr(F, self.how)(self.value)

    def above(self, state):
        return Total(state, self.how)

    def merge(self, local, carried):
        return F.coalesce(carried, local)


_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def block_of(order: str, width: int = WIDTH) -> Column:
    """The block of a number, rounded down."""
    return F.floor(F.expr(f"`{order}` div {width}") - F.when(F.expr(f"`{order}` % {width} < 0"), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def ordered(df: DataFrame, by: list[str] | str, order: str, width: int = WIDTH, **columns) -> DataFrame:
    """Add ``columns`` (Running / Neighbour / Total) computed over each work in ``order``."""
    by = [by] if isinstance(by, str) else list(by)
    return _ordered(df, by, order, columns, width, 1 << _BITS[df.schema[order].dataType.simpleString()], 0)


def _ordered(df: DataFrame, by: list[str], order: str, columns: dict, width: int, numbers: int, level: int) -> DataFrame:
    """``numbers``: how many different ones the order column may hold in a work."""
    kept = [c for c in df.columns if c not in columns]
    if level and numbers <= FAN:
        return df.select(*kept, *[spec.merge(spec.local(by, order), F.lit(None)).alias(n) for n, spec in columns.items()])
    block = f"{BLOCK}{level}"
    base = df.withColumn(block, block_of(order, width))
    blocks = base.groupBy(*by, block).agg(*[spec.block(order).alias(f"_b_{n}") for n, spec in columns.items()])
    above = {f"_c_{n}": spec.above(F.col(f"_b_{n}")) for n, spec in columns.items()}
    carried = _ordered(blocks, by, block, above, FAN, math.ceil(numbers / width), level + 1)
    carried = carried.select(*[F.col(k).alias(f"_k_{k}") for k in [*by, block]], *above)
    local = base.select("*", *[spec.local([*by, block], order).alias(f"_l_{n}") for n, spec in columns.items()])
    same_block = [F.col(k) == F.col(f"_k_{k}") for k in [*by, block]]
    condition = same_block[0]
    for term in same_block[1:]:
        condition = condition & term
    joined = local.join(carried, condition)
    return joined.select(*kept, *[spec.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, spec in columns.items()])


def row_number(df: DataFrame, by, order: str, name: str = "number", width: int = WIDTH) -> DataFrame:
    out = ordered(df, by, order, width, **{name: Running(F.lit(1))})
    return out.withColumn(name, F.col(name).cast("int"))


def run_heads(df: DataFrame, by, order: str, joins: Column, name: str = "head", width: int = WIDTH) -> DataFrame:
    """First number of the run each row belongs to.

    A row with ``joins`` true continues the run of the row numbered one less; a missing predecessor starts a new run.
    Blocks are aligned to the number, so only the first row of a block needs to know its neighbour block.
    """
    by = [by] if isinstance(by, str) else list(by)
    in_block = Window.partitionBy(*by, BLOCK).orderBy(order)
    o = F.col(order)
    base = df.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn(BLOCK, block_of(order, width))
    before = F.lag(order).over(in_block)
    # null = the block's first row, which may continue the block before it
    starts = F.when(
        before.isNull(), F.when(F.col("_joins") & (o % width == 0), F.lit(None)).otherwise(F.lit(True))
    ).otherwise(~F.col("_joins") | (before != o - 1))
    local = base.withColumn("_starts", starts).withColumn(
        "_head",
        F.max(F.when(F.col("_starts"), o)).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    blocks = local.groupBy(*by, BLOCK).agg(
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        F.max("_head").alias("_tail_head"),
        F.max(F.col("_starts").isNull()).alias("_open"),
    )
    numbers = math.ceil((1 << _BITS[df.schema[order].dataType.simpleString()]) / width)

    def across(blocks: DataFrame, **columns) -> DataFrame:
        return _ordered(blocks, by, BLOCK, columns, FAN, numbers, 1)

    blocks = across(blocks, _before=Neighbour(F.col("_last")))
    linked = F.coalesce(F.col("_open") & (F.col("_before") == F.col("_first") - 1), F.lit(False))
    blocks = blocks.withColumn("_own", F.when(~linked, F.col("_first")))
    blocks = across(blocks, _came=Running(F.coalesce("_tail_head", "_own"), "max", inclusive=False))
    out = local.join(blocks.select(*by, BLOCK, F.coalesce("_own", "_came").alias("_entry")), [*by, BLOCK])
    return out.select(*df.columns, F.coalesce("_head", "_entry").alias(name))


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """0-based position in the total order of ``keys`` (which must be unique), without a one-task window.

    Range partitioning sorts and splits the rows evenly, hot works included; the checkpoint pins the layout, so a
    row's position is the size of the partitions before it plus its place in its own partition.
    """
    from quire.session import checkpoint

    place = F.monotonically_increasing_id()
    laid = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition
    starts = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_s"),
    )
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_s") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_place", "_s")
    )
