"""Splitting long sections, packing sections and paragraphs into bounded parts, subtitle cues."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as t
from quire.functions.predicates import is_published
from quire.functions.text import SPACE, col
from quire.operators.changes import section_id
from quire.operators.ordered import BLOCK, WIDTH, Running, ordered
from quire.session import checkpoint


def _parts_of(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), t.strip), lambda x: x != "")


def paragraphs(c, min_words: int = 800) -> Column:
    """G1: paragraphs by blank line, else by line; a long text with fewer than five is reflowed, else its sentences
    are grouped."""
    c = col(c)
    plain = F.when(F.contains(c, F.lit("\n\n")), _parts_of(c, "\n\n")).otherwise(_parts_of(c, "\n"))
    flowed = t.reflow(c)
    by_gap, by_line = _parts_of(flowed, "\n\n"), _parts_of(flowed, "\n")
    told = _parts_of(t.strip(c), rf"(?<=[.!?…])[{SPACE}]+")
    step = F.greatest(F.lit(3), F.floor(F.size(told) / 18).cast("int"))
    grouped = t.let(F.struct(told.alias("s"), step.alias("n")), _grouped)
    return (
        F.when((F.size(plain) >= 5) | (t.word_count(c) < min_words), plain)
        .when(F.size(by_gap) >= 5, by_gap)
        .when(F.size(by_line) >= 5, by_line)
        .when(F.size(told) >= 10, grouped)
        .otherwise(plain)
    )


def _grouped(x: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x["s"]) - 1) / x["n"]).cast("int")),
        lambda i: F.array_join(F.slice(x["s"], i * x["n"] + 1, x["n"]), " "),
    )


def even_cuts(n_paragraphs: Column, n_pieces: Column) -> Column:
    """Cut points of an even split; the last piece takes the remainder."""
    step = F.floor(n_paragraphs / n_pieces).cast("int")
    return F.when(n_pieces > 1, F.transform(F.sequence(F.lit(1), n_pieces - 1), lambda i: i * step)).otherwise(
        F.array().cast("array<int>")
    )


def cut_pieces(parts: Column, cuts: Column, titles: Column | None = None) -> Column:
    """Titled pieces between the cut points."""
    bounds = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(parts)))
    default = lambda i: F.concat(F.lit("Phần "), i.cast("string"))

    def build(x):
        return F.transform(
            F.sequence(F.lit(1), F.size(x["b"]) - 1),
            lambda i: F.struct(
                (default(i) if titles is None else F.coalesce(F.nullif(F.get(titles, i - 1), F.lit("")), default(i))).alias("title"),
                F.array_join(
                    F.slice(x["p"], F.element_at(x["b"], i) + 1, F.element_at(x["b"], i + 1) - F.element_at(x["b"], i)), "\n\n"
                ).alias("content"),
            ),
        )

    return t.let(F.struct(parts.alias("p"), bounds.alias("b")), build)


def allocate(sections: DataFrame, target: int, min_piece: int = 400) -> DataFrame:
    """(work_id, number, words, pieces) for the works that can be split into ``target`` pieces.

    Only works with fewer than ``target`` sections take part, so the windows below see fewer than ``target`` rows.
    Shares are rounded half to even and capped; what is missing or over goes to the longest sections first.
    """
    facts = sections.select("work_id", "number", t.word_count("content").alias("words"))
    totals = facts.groupBy("work_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("words").alias("_total"))
    able = totals.filter((F.col("_n") < target) & (F.col("_total") >= target * min_piece))
    rows = facts.join(able, "work_id")
    cap = F.greatest(F.lit(1), F.floor(F.col("words") / min_piece)).cast("int")
    share = F.bround(F.lit(target) * F.col("words") / F.col("_total")).cast("int")
    rows = rows.withColumn("_p", F.least(F.greatest(F.lit(1), share), cap))
    rows = rows.withColumn("_diff", F.lit(target) - F.sum("_p").over(Window.partitionBy("work_id")))
    room = F.when(F.col("_diff") > 0, F.greatest(F.lit(0), F.floor(F.col("words") / min_piece) - F.col("_p"))).otherwise(F.col("_p") - 1)
    before = Window.partitionBy("work_id").orderBy(F.desc("words"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_room", room).withColumn("_used", F.coalesce(F.sum("_room").over(before), F.lit(0)))
    step = F.least(F.col("_room"), F.greatest(F.lit(0), F.abs("_diff") - F.col("_used")))
    return rows.select("work_id", "number", "words", (F.col("_p") + F.signum("_diff") * step).cast("int").alias("pieces"))


def split_pieces(sections: DataFrame, plan: DataFrame, min_split: int = 800, cuts: DataFrame | None = None) -> DataFrame:
    """(work_id, number, piece, title, content): every planned section, cut where it has paragraphs enough.

    ``cuts`` may carry (work_id, number, splits, titles); sections without an entry are cut evenly.
    """
    rows = sections.select("work_id", "number", "title", "content").join(plan.select("work_id", "number", "pieces"), ["work_id", "number"])
    rows = rows.withColumn("_parts", F.when(F.col("pieces") > 1, paragraphs("content", min_split)))
    enough = (F.col("pieces") > 1) & (F.size("_parts") >= 2 * F.col("pieces"))
    whole = F.array(F.struct("title", "content"))
    if cuts is None:
        cut = cut_pieces(F.col("_parts"), even_cuts(F.size("_parts"), F.col("pieces")))
    else:
        rows = rows.join(cuts, ["work_id", "number"], "left")
        given = F.size("splits") == F.col("pieces") - 1
        cut = F.when(given, cut_pieces(F.col("_parts"), F.col("splits"), F.col("titles"))).otherwise(
            cut_pieces(F.col("_parts"), even_cuts(F.size("_parts"), F.col("pieces")))
        )
    exploded = rows.select("work_id", "number", F.posexplode(F.when(enough, cut).otherwise(whole)).alias("piece", "_x"))
    return exploded.select("work_id", "number", "piece", "_x.title", "_x.content")


def split_to_target(sections: DataFrame, target: int, min_piece: int = 400, cuts: DataFrame | None = None,
                    min_split: int | None = None) -> DataFrame:
    """The new sections of every work that could be split, numbered 1..N.

    A work whose words are not kept within 2 % is left out and so stays as it is.
    """
    plan = allocate(sections, target, min_piece)
    pieces = split_pieces(sections, plan, min_split or 2 * min_piece, cuts).withColumn("word_count", t.word_count("content"))
    work = Window.partitionBy("work_id")  # at most about ``target`` rows
    old = plan.groupBy("work_id").agg(F.sum("words").alias("_old"))
    out = pieces.withColumn("_new", F.sum("word_count").over(work)).withColumn(
        "new_number", F.row_number().over(work.orderBy("number", "piece"))
    )
    out = out.join(old, "work_id").filter(F.abs(F.col("_new") - F.col("_old")) <= F.col("_old") * 0.02)
    return out.select(
        section_id("work_id", "new_number", "content").alias("section_id"), "work_id", F.col("new_number").alias("number"),
        "title", "content", "word_count", F.lit("published").alias("publish_status"),
    )


def split_status(sections: DataFrame, target: int, min_piece: int = 400) -> DataFrame:
    """Why each work is or is not split: ok, already_enough, too_short."""
    totals = sections.groupBy("work_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(t.word_count("content")).alias("_w"))
    status = F.when(F.col("_n") >= target, "already_enough").when(F.col("_w") < target * min_piece, "too_short").otherwise("ok")
    return totals.select("work_id", status.alias("status"))


def split_thin(works: DataFrame, sections: DataFrame, limit: int = 5, target: int = 10, min_piece: int = 400,
               max_works: int | None = None, min_split: int | None = None) -> DataFrame:
    """Split every published work with at least one and fewer than ``limit`` published sections."""
    from quire.operators.catalog import few_sections

    thin = few_sections(works.filter(is_published()), sections, limit)
    if max_works:
        thin = thin.orderBy("sections", "slug").limit(max_works)
    return split_to_target(sections.join(thin.select("work_id"), "work_id", "left_semi"), target, min_piece, min_split=min_split)


def cues(c, seconds: float = 20.0, words_per_second: float = 3.0) -> Column:
    """Array of (idx, start, end, text) with a fixed number of words each; times in seconds."""
    size = max(1, int(seconds * words_per_second))

    def build(w):
        return F.transform(
            F.when(F.size(w) > 0, F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>")),
            lambda k: F.struct(
                (k + 1).alias("idx"),
                (k * size / F.lit(words_per_second)).alias("start"),
                (F.least(F.size(w), (k + 1) * size) / F.lit(words_per_second)).alias("end"),
                F.array_join(F.slice(w, k * size + 1, F.lit(size)), " ").alias("text"),
            ),
        )

    return t.let(t.words(col(c)), build)


def srt_stamp(seconds: Column) -> Column:
    return t.srt_time((F.floor(seconds) * 1000 + F.floor((seconds % 1) * 1000)).cast("bigint"))


def srt(c, seconds: float = 20.0, words_per_second: float = 3.0) -> Column:
    """K5: a text as one subtitle file."""
    return F.array_join(
        F.transform(
            cues(c, seconds, words_per_second),
            lambda q: F.concat(
                q["idx"].cast("string"), F.lit("\n"), srt_stamp(q["start"]), F.lit(" --> "), srt_stamp(q["end"]), F.lit("\n"), q["text"], F.lit("\n\n")
            ),
        ),
        "",
    )


def pack_texts(parts: Column, limit: int) -> Column:
    """Neighbouring paragraphs up to ``limit`` characters (separators not counted); a longer one stands alone."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n")
    )

    def step(s, p):
        full = (s["n"] + F.length(p) > limit) & (F.size(s["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(s["open"], F.array(p))).alias("open"),
            F.when(full, F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"),
        )

    return F.aggregate(
        parts, start, step,
        lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"]),
    )


def text_chunks(c, limit: int = 1200) -> Column:
    """A text as chunks of whole paragraphs; short texts stay untouched."""
    c = col(c)
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(pack_texts(F.split(c, "\n\n"), limit))


def numbered_paragraphs(parts: Column, label: str = "Đoạn") -> Column:
    """P3."""
    return F.array_join(
        F.transform(parts, lambda p, i: F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("] "), p)), "\n\n"
    )


# --- greedy packing of sections, exact and in parallel -------------------------------------------------------------
#
# The part a section falls into depends on everything before it, but only through one number: the characters already
# in the open part. Each block of a work is reduced to how it maps that number at its start to the number at its end
# (a step function with one step per section that fits the first part). Two neighbouring functions compose to one of the
# same kind, so the blocks of a long work are composed as a tree: up, FOLD functions to one, until a work has one; down, every
# function gets the number at its start from the one above. Then every block is packed on its own.

#: Functions that one group composes.
FOLD = 32
#: What the number is before the first section: nothing fits, so that section opens a part.
_FULL = 1


@dataclass
class Steps:
    """From ``chars`` in the open part at the start of some sections to those at the end, and how many parts are opened between.

    With room for less than ``sums[j]`` characters more but for ``sums[j - 1]``, the first part opened begins there: ``tails[j]`` characters are open at
    the end and ``opened[j]`` parts were opened. With room for all sums nothing is opened and ``total`` is added. ``sums`` ends with the first
    over the limit, so a function has at most as many steps as a part can have different lengths.
    """

    total: int
    sums: np.ndarray
    opened: np.ndarray
    tails: np.ndarray

    def after(self, chars, parts, limit: int):
        """The numbers at the end for those at the start."""
        at = np.searchsorted(self.sums, limit - np.asarray(chars), side="right")
        breaks = at < len(self.sums)
        at = np.minimum(at, len(self.sums) - 1)
        return np.where(breaks, self.tails[at], chars + self.total), parts + np.where(breaks, self.opened[at], 0)

    def then(self, other: Steps, limit: int) -> Steps:
        """This function, then the ``other``."""
        tails, opened = other.after(self.tails, self.opened, limit)
        sums, more = self.sums, other.sums[:0]
        if sums[-1] <= limit:
            more = other.sums + self.total
            more = more[: int(np.searchsorted(more, limit, side="right")) + 1]
        n = len(more)
        return Steps(self.total + other.total, np.concatenate([sums, more]), np.concatenate([opened, other.opened[:n]]), np.concatenate([tails, other.tails[:n]]))


def steps_of(lengths: np.ndarray, limit: int) -> Steps:
    """The step function of sections of these lengths."""
    m = len(lengths)
    sums = np.cumsum(lengths)
    upto = np.concatenate([[0], sums])
    nxt = np.maximum(np.searchsorted(sums, upto[:-1] + limit, side="right"), np.arange(1, m + 1))
    opened = np.ones(m + 1, dtype=np.int64)
    opened[m] = 0
    tail = np.zeros(m + 1, dtype=np.int64)
    for i in range(m - 1, -1, -1):
        if nxt[i] < m:
            opened[i] = opened[nxt[i]] + 1
            tail[i] = tail[nxt[i]]
        else:
            tail[i] = sums[-1] - upto[i]
    stop = min(int(np.searchsorted(sums, limit, side="right")), m - 1)
    at = np.flatnonzero(np.concatenate([[True], sums[1 : stop + 1] > sums[:stop]]))
    return Steps(int(sums[-1]), sums[at], opened[at], tail[at])


_STEPS = f"work_id string, {BLOCK} bigint, total bigint, sums array<bigint>, opened array<bigint>, tails array<bigint>"
_ENTRIES = f"work_id string, {BLOCK} bigint, entry_chars bigint, entry_part bigint"


def _steps_in(frame) -> list[Steps]:
    return [Steps(r.total, *[np.asarray(x, np.int64) for x in (r.sums, r.opened, r.tails)]) for r in frame.itertuples(index=False)]


def _entries(functions: DataFrame, top: int, limit: int) -> DataFrame:
    """(work, block, entry_chars, entry_part) from a step function per block, blocks 0 to ``top``. No group holds more than FOLD functions."""
    import pandas as pd

    parent = F.floor(F.col(BLOCK) / FOLD).cast("bigint")

    def compose(key, frame):
        first, *rest = _steps_in(frame.sort_values(BLOCK))
        for f in rest:
            first = first.then(f, limit)
        return pd.DataFrame({"work_id": [key[0]], BLOCK: [key[1]], "total": [first.total], "sums": [first.sums], "opened": [first.opened], "tails": [first.tails]})

    def hand_down(key, children, start):
        children = children.sort_values(BLOCK)
        chars, part = (int(start["entry_chars"].iloc[0]), int(start["entry_part"].iloc[0])) if len(start) else (limit + _FULL, 0)
        rows = []
        for block, f in zip(children[BLOCK], _steps_in(children)):
            rows.append((key[0], block, chars, part))
            chars, part = (int(x) for x in f.after(chars, part, limit))
        return pd.DataFrame(rows, columns=["work_id", BLOCK, "entry_chars", "entry_part"])

    if top < FOLD:
        return functions.groupBy("work_id").applyInPandas(lambda key, frame: hand_down(key, frame, frame.iloc[:0]), _ENTRIES)
    composed = checkpoint(functions.groupBy("work_id", parent.alias(BLOCK)).applyInPandas(compose, _STEPS))
    above = _entries(composed, top // FOLD, limit)
    return functions.groupBy("work_id", parent).cogroup(above.groupBy("work_id", BLOCK)).applyInPandas(hand_down, _ENTRIES)


def pack_sections(sections: DataFrame, limit: int = 60_000, width: int = WIDTH) -> DataFrame:
    """(work_id, number, length, part): sections in order, parts of at most ``limit`` characters, a longer section
    alone. ``sections``: work_id, number, length. Blocks are ``width`` sections, whatever their numbers are."""
    import pandas as pd

    rows = sections.select("work_id", F.col("number").cast("bigint").alias("number"), F.col("length").cast("bigint").alias("length"))
    rows = ordered(rows, "work_id", "number", width, _at=Running(F.lit(1), inclusive=False))
    rows = checkpoint(rows.select("work_id", "number", "length", F.floor(F.col("_at") / width).cast("bigint").alias(BLOCK)))

    def reduce_block(key, frame):
        f = steps_of(frame.sort_values("number")["length"].to_numpy(), limit)
        return pd.DataFrame({"work_id": [key[0]], BLOCK: [key[1]], "total": [f.total], "sums": [f.sums], "opened": [f.opened], "tails": [f.tails]})

    def pack(frame):
        works, blocks = frame["work_id"].to_numpy(), frame[BLOCK].to_numpy()
        lengths, chars_in, part_in = frame["length"].tolist(), frame["entry_chars"].tolist(), frame["entry_part"].tolist()
        first = np.ones(len(frame), dtype=bool)
        first[1:] = (works[1:] != works[:-1]) | (blocks[1:] != blocks[:-1])
        parts, part, chars = [], 0, 0
        for n, new_group, chars_0, part_0 in zip(lengths, first.tolist(), chars_in, part_in):
            if new_group:
                part, chars = part_0, chars_0
            if chars + n > limit:
                part, chars = part + 1, 0
            chars += n
            parts.append(part)
        return frame[["work_id", "number", "length"]].assign(part=parts)

    def pack_sorted(frames):
        """Rows come sorted by work and block; the last block of a frame waits for the next frame."""
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame["work_id"] == frame["work_id"].iloc[-1]) & (frame[BLOCK] == frame[BLOCK].iloc[-1])
            cut = int(last.to_numpy().argmax())
            held = frame.iloc[cut:]
            if cut:
                yield pack(frame.iloc[:cut])
        if held is not None and len(held):
            yield pack(held)

    # a work that fits one block starts empty; only longer ones need their blocks composed
    top = rows.agg(F.max(BLOCK)).first()[0] or 0
    placed = rows.withColumns({"entry_chars": F.lit(limit + _FULL).cast("bigint"), "entry_part": F.lit(0).cast("bigint")})
    if top:
        long_works = rows.filter(f"{BLOCK} = 1").select("work_id").distinct()
        functions = checkpoint(rows.join(long_works, "work_id", "left_semi").groupBy("work_id", BLOCK).applyInPandas(reduce_block, _STEPS))
        placed = rows.join(_entries(functions, top, limit), ["work_id", BLOCK], "left").withColumns(
            {"entry_chars": F.coalesce("entry_chars", F.lit(limit + _FULL)), "entry_part": F.coalesce("entry_part", F.lit(0))}
        )
    placed = placed.repartition("work_id", BLOCK).sortWithinPartitions("work_id", BLOCK, "number")
    packed = placed.select("work_id", BLOCK, "number", "length", "entry_chars", "entry_part").mapInPandas(pack_sorted, "work_id string, number bigint, length bigint, part bigint")
    return packed.select("work_id", F.col("number").cast("int").alias("number"), "length", F.col("part").cast("int").alias("part"))
