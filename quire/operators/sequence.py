"""Ordered-sequence operators over sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import genres as g
from quire.functions import text as t
from quire.functions.predicates import is_blank, is_published

from quire.operators.ordered import Neighbour, Running, Total, ordered, row_number, run_heads
from quire.session import checkpoint


def first_rows(df: DataFrame, order: str, n: int, by: str = "work_id") -> DataFrame:
    """The first ``n`` rows of each work; 0 keeps all.

    Under a thousand rows the limit is applied map-side before the shuffle. A larger ``n`` is beyond what that can do: then the place
    of each row is counted in blocks of its work (``order`` must be a whole number).
    """
    if n <= 0:
        return df
    if n >= 1_000:
        return row_number(df, by, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def renumbered(sections: DataFrame, width: int | None = None) -> DataFrame:
    """(work_id, number, new_number), numbering each work 1..N in its current order."""
    args = {} if width is None else {"width": width}
    return row_number(sections.select("work_id", "number"), "work_id", "number", "new_number", **args)


def renumber_counts(sections: DataFrame) -> DataFrame:
    """Per work the sections and how many change their number."""
    return renumbered(sections).groupBy("work_id").agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(F.col("number") != F.col("new_number")).alias("renumbered")
    )


def merge_plan(works: DataFrame, sections: DataFrame, min_words: int, width: int | None = None) -> DataFrame:
    """(work_id, number, short, head): the number each section's text ends up under.

    Descending merging of k into k-1 leaves the numbers below k as they were when k is handled, so a short section
    joins the run of its predecessor whenever that number exists. Number 1 has no predecessor: it moves into 2 if 2
    is still there, which means 2 did not itself join 1.
    """
    args = {} if width is None else {"width": width}
    open_works = works.filter(is_published()).select("work_id", F.lit(True).alias("_open"))
    facts = sections.select(
        "work_id", "number", (is_published() & (F.col("word_count") < min_words)).alias("_short")
    ).join(open_works, "work_id", "left")
    facts = facts.select(
        "work_id", "number", (F.coalesce("_short", F.lit(False)) & F.col("_open").isNotNull()).alias("short")
    )
    runs = run_heads(facts, "work_id", "number", F.col("short") & (F.col("number") != 1), **args)
    return _fold_first(runs, facts)


def _fold_first(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Move number 1 under 2 where 1 is short and 2 exists and is not (a short 2 has joined 1)."""
    pair = facts.filter(F.col("number").isin(1, 2)).groupBy("work_id").agg(
        F.max(F.when(F.col("number") == 1, F.col("short"))).alias("_s1"),
        F.max(F.when(F.col("number") == 2, F.col("short"))).alias("_s2"),
    )
    folding = pair.filter(F.col("_s1") & ~F.col("_s2")).select("work_id", F.lit(1).alias("number"), F.lit(2).alias("_to"))
    moved = runs.join(folding, ["work_id", "number"], "left")
    return moved.select("work_id", "number", "short", F.coalesce("_to", "head").alias("head"))


def merge_counts(plan: DataFrame) -> DataFrame:
    """Per work with a short section: merged, failed (target missing) and left sections."""
    moved = F.col("head") != F.col("number")
    out = plan.groupBy("work_id").agg(
        F.count_if(F.col("short") & moved).alias("merged"),
        F.count_if(F.col("short") & ~moved).alias("failed"),
        F.count_if(~moved).alias("left"),
    )
    return out.filter((F.col("merged") > 0) | (F.col("failed") > 0))


def apply_merge(sections: DataFrame, plan: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """The sections after merging; ``numbers`` (work_id, number, new_number) gives those that stay a new number.

    Texts meet the plan in one join. Only sections of groups with more than one member move again, by (work, head).
    """
    moved = plan.filter("head <> number").select("work_id", "number", "head")
    tags = moved.unionByName(moved.select("work_id", F.col("head").alias("number"), "head").distinct())
    if numbers is None:
        tags = tags.withColumn("new_number", F.col("head").cast("int"))
    else:
        tags = tags.join(numbers, ["work_id", "number"], "full")
    tagged = sections.join(tags, ["work_id", "number"], "left")
    number = F.coalesce("new_number", "number").cast(sections.schema["number"].dataType).alias("number")
    alone = tagged.filter(F.col("head").isNull()).select(*[number if c == "number" else F.col(c) for c in sections.columns])
    parts = F.array_sort(F.collect_list(F.struct("number", "content")))
    joined = tagged.filter(F.col("head").isNotNull()).groupBy("work_id", "head").agg(
        parts.alias("_parts"),
        F.max(F.when(F.col("number") == F.col("head"), F.struct(*[number if c == "number" else F.col(c) for c in sections.columns if c != "content"]))).alias("_kept"),
    )
    n = F.size("_parts")
    texts = F.transform(
        F.col("_parts"),
        lambda x, i: F.when(i == 0, t.rstrip(x["content"])).when(i == n - 1, t.lstrip(x["content"])).otherwise(t.strip(x["content"])),
    )
    merged = joined.withColumn("content", F.array_join(texts, "\n\n")).select(
        *[
            F.col("content") if c == "content" else t.word_count("content").cast("int").alias(c) if c == "word_count"
            else F.col(f"_kept.{c}").alias(c)
            for c in sections.columns
        ]
    )
    return alone.unionByName(merged)


def merge_short(works: DataFrame, sections: DataFrame, min_words: int, renumber: bool = True, max_works: int | None = None,
                width: int | None = None) -> DataFrame:
    """Merge short sections into their neighbours and renumber the works that had one.

    The plan (four narrow columns) is used five times below, so it is written once.
    """
    plan = checkpoint(merge_plan(works, sections, min_words, width))
    touched = plan.filter("short").select("work_id").distinct()
    if max_works is not None:
        touched = touched.join(works.select("work_id", "slug"), "work_id").orderBy("slug").limit(max_works).select("work_id")
        plan = checkpoint(plan.join(touched, "work_id", "left_semi"))
    if not renumber:
        return apply_merge(sections, plan)
    survivors = plan.join(touched, "work_id", "left_semi").filter("head = number").select("work_id", "number")
    return apply_merge(sections, plan, renumbered(survivors, width))


def merge_one(sections: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge chosen sections into the one before or after. ``seeds``: work_id, number, direction (prev / next).

    Returns the new sections and one status row per different seed: ok, no_previous, missing_source, missing_target or
    overlap. The section numbered one less or one more is the target, whatever its status. Seeds that share a section with
    another one (2 into 1 and 3 into 2) are not applied, as the order of the two would decide the outcome.
    """
    seeds = seeds.select("work_id", "number", "direction").distinct()
    step = F.when(F.col("direction") == "prev", -1).otherwise(1)
    keys = sections.select("work_id", "number")
    goal = seeds.withColumn("target", F.col("number") + step)
    goal = goal.join(keys.withColumn("_source", F.lit(True)), ["work_id", "number"], "left")
    goal = goal.join(
        keys.select("work_id", F.col("number").alias("target"), F.lit(True).alias("_target")), ["work_id", "target"], "left"
    )
    status = (
        F.when((F.col("direction") == "prev") & (F.col("number") <= 1), "no_previous")
        .when(F.col("_source").isNull(), "missing_source").when(F.col("_target").isNull(), "missing_target").otherwise("ok")
    )
    goal = goal.withColumn("status", status)
    members = goal.filter("status = 'ok'").select("work_id", F.explode(F.array("number", "target")).alias("_member"))
    shared = members.groupBy("work_id", "_member").count().filter("count > 1")
    crossing = shared.select("work_id", F.explode(F.array(F.col("_member") - 1, "_member", F.col("_member") + 1)).alias("number"), "_member")
    crossing = crossing.groupBy("work_id", "number").agg(F.collect_set("_member").alias("_shared"))
    overlaps = F.coalesce(F.array_contains("_shared", F.col("number")) | F.array_contains("_shared", F.col("target")), F.lit(False))
    goal = goal.join(crossing, ["work_id", "number"], "left")
    goal = goal.withColumn("status", F.when((F.col("status") == "ok") & overlaps, "overlap").otherwise(F.col("status")))
    good = goal.filter("status = 'ok'")
    plan = good.select("work_id", "number", F.col("target").alias("head")).unionByName(
        good.select("work_id", F.col("target").alias("number"), F.col("target").alias("head"))
    )
    return apply_merge(sections, plan), goal.select("work_id", "number", "direction", "status")


def neighbours(sections: DataFrame, width: int | None = None) -> DataFrame:
    """(work_id, number, previous_title, next_title)."""
    args = {} if width is None else {"width": width}
    return ordered(
        sections.select("work_id", "number", "title"), "work_id", "number", **args,
        previous_title=Neighbour(F.col("title")), next_title=Neighbour(F.col("title"), 1),
    ).drop("title")


def usable_fetches(fetches: DataFrame, min_length: int = 50, run: int = 3) -> DataFrame:
    """Drop short fetches and everything from the third short one in a row on.

    ``fetches``: work_id, pos (0-based, without gaps), length, loaded. Loaded rows break a run. Each short row votes
    for the ``run`` positions a run through it may end at; a position with all votes ends the listing.
    """
    short = ~F.col("loaded") & (F.coalesce("length", F.lit(0)) < min_length)
    votes = fetches.filter(short).select("work_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + run - 1)).alias("end"))
    stops = votes.groupBy("work_id", "end").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == run)
    stops = stops.groupBy("work_id").agg(F.min("end").alias("_stop"))
    kept = fetches.filter(~short).join(stops, "work_id", "left")
    return kept.filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).drop("_stop")


def even_positions(rows: DataFrame, n: int, by: str = "work_id", pos: str = "pos") -> DataFrame:
    """``n`` evenly spread rows per work, or all of them and then round again when there are fewer.

    ``pos`` is 0-based without gaps. Adds ``slot`` 0..n-1.
    """
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    slots = totals.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    spread = F.floor(F.col("slot") * (F.col("_total") - 1) / F.lit(max(n - 1, 1)))
    slots = slots.select(by, "slot", F.when(F.col("_total") >= n, spread).otherwise(F.col("slot") % F.col("_total")).cast("int").alias(pos))
    return rows.withColumn(pos, F.col(pos).cast("int")).join(slots, [by, pos])


def quartile_rows(sections: DataFrame, width: int | None = None) -> DataFrame:
    """Sections at positions 0, n/3, 2n/3 and n-1 of each work, with ``pos`` and ``total``."""
    args = {} if width is None else {"width": width}
    placed = ordered(
        sections, "work_id", "number", **args, pos=Running(F.lit(1), inclusive=False), total=Total(F.lit(1))
    )
    n = F.col("total")
    return placed.filter(F.col("pos").isin(0) | (F.col("pos") == n - 1) | (F.col("pos") == F.floor(n / 3)) | (F.col("pos") == F.floor(2 * n / 3)))


def quartile_excerpt(sections: DataFrame, limit: int = 5000, label: str = "Chương", tidy=lambda c: c) -> DataFrame:
    """W9 + T22: per work the quartile sections' heads, cut at a sentence, joined in order. At most four rows per work."""
    places = quartile_rows(sections.select("work_id", "number")).select("work_id", "number")
    # four places a work are found on the numbers alone; only their texts move
    picked = sections.select("work_id", "number", "content").join(places, ["work_id", "number"], "left_semi")
    per = picked.withColumn("content", t.strip(tidy(F.coalesce("content", F.lit("")))))
    n = F.count(F.lit(1)).over(Window.partitionBy("work_id"))
    cut = per.withColumn("_per", F.floor(F.lit(limit) / n).cast("int")).filter("content <> ''")
    piece = F.concat(F.lit(f"[{label} "), F.col("number").cast("string"), F.lit("]\n"), t.sentence_excerpt("content", F.col("_per")))
    parts = cut.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("number", piece.alias("p")))).alias("_p"))
    return parts.select("work_id", F.array_join(F.transform("_p", lambda x: x["p"]), "\n\n").alias("excerpt"))


def budget_prefix(sections: DataFrame, first: int = 5, budget: int = 3000) -> DataFrame:
    """The first sections' text until ``budget`` characters are used. At most ``first`` rows per work."""
    rows = first_rows(sections.select("work_id", "number", "content"), "number", first)
    rows = rows.withColumn("content", t.strip(F.coalesce("content", F.lit("")))).filter("content <> ''")
    used = F.coalesce(
        F.sum(F.length("content")).over(Window.partitionBy("work_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    cut = rows.withColumn("_left", F.lit(budget) - used).filter("_left > 0")
    cut = cut.withColumn("chunk", F.substring("content", F.lit(1), F.col("_left").cast("int")))
    parts = cut.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("number", "chunk"))).alias("_p"))
    return parts.select("work_id", F.array_join(F.transform("_p", lambda x: x["chunk"]), "\n\n").alias("sample"))


def story_digest(works: DataFrame, sections: DataFrame, first: int = 3, per: int = 800, limit: int = 4000) -> DataFrame:
    """Description plus the heads of the first sections, capped."""
    rows = first_rows(sections.select("work_id", "number", "content"), "number", first).filter(~is_blank("content"))
    piece = F.concat(F.lit("--- Chương "), F.col("number").cast("string"), F.lit(" ---\n"), F.substring("content", 1, per))
    parts = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("number", piece.alias("p")))).alias("_p"))
    out = works.select("work_id", "description").join(parts, "work_id", "left")
    about = F.when(~is_blank("description"), F.array(F.concat(F.lit("Mô tả: "), "description"))).otherwise(F.array().cast("array<string>"))
    heads = F.coalesce(F.transform("_p", lambda x: x["p"]), F.array().cast("array<string>"))
    text = F.array_join(F.concat(about, heads), "\n\n")
    return out.select("work_id", F.nullif(F.substring(text, 1, limit), F.lit("")).alias("digest"))


def cyclic_slots(items: DataFrame, lengths: DataFrame, step: float, by: str = "work_id") -> DataFrame:
    """K items fill ceil(total/step)+1 slots, again and again. ``items``: by, pos, item; ``lengths``: by, total."""
    k = items.groupBy(by).agg(F.count(F.lit(1)).alias("_k"))
    slots = lengths.join(k, by).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / step).cast("int")))
    )
    slots = slots.select(by, "slot", (F.col("slot") % F.col("_k")).cast("int").alias("pos"))
    return slots.join(items.withColumn("pos", F.col("pos").cast("int")), [by, "pos"])


def equal_timeline(items: DataFrame, lengths: DataFrame, fade: float = 0.4, tail: float = 0.5, by: str = "work_id") -> DataFrame:
    """Equal shares of the total, the last a bit longer, and the crossfade offset of each item after the first."""
    n = items.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    out = items.join(lengths.join(n, by), by)
    share = F.col("total") / F.col("_n")
    return out.select(
        by, "pos",
        (share + F.when(F.col("pos") == F.col("_n") - 1, tail).otherwise(0.0)).alias("duration"),
        F.when(F.col("pos") > 0, F.greatest(F.lit(0.01), F.col("pos") * share - fade)).alias("fade_offset"),
    )


def shots(scenes: DataFrame, by: str = "work_id") -> DataFrame:
    """A shot type per scene from its place and emotion. ``scenes``: by, pos, emotion."""
    n = scenes.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return scenes.join(n, by).withColumn("shot", g.shot_type("pos", "_n", "emotion")).drop("_n")


def choose_attempts(attempts: DataFrame, ratio: Column, retry_above: float = 0.02, reject_above: float = 0.10) -> DataFrame:
    """Per chunk the first or second attempt or, when neither is good enough, the source.

    ``attempts``: chunk_id, attempt (1, 2), source_text, text; ``ratio``: share of damaged words in ``text``.
    """
    from quire.functions.predicates import is_truncated

    scored = attempts.withColumn("_r", ratio).withColumn("_t", is_truncated("text")).withColumn(
        "_u", F.coalesce(F.length("text") > F.length("source_text") * 0.3, F.lit(False))
    )
    pick = lambda n, c: F.max(F.when(F.col("attempt") == n, F.col(c)))
    row = scored.groupBy("chunk_id").agg(
        F.max("source_text").alias("source_text"),
        *[pick(n, c).alias(f"{c.strip('_')}{n}") for n in (1, 2) for c in ("text", "_r", "_t", "_u")],
    )
    u1, u2 = F.coalesce("u1", F.lit(False)), F.coalesce("u2", F.lit(False))
    retry = u1 & ((F.col("r1") > retry_above) | F.col("t1"))
    better = ((F.col("r2") <= F.col("r1")) & ~F.col("t2")) | ((F.col("r2") < F.col("r1")) & (F.col("t2") == F.col("t1")))
    second = retry & u2 & F.coalesce(better, F.lit(False))
    r, cut = F.when(second, F.col("r2")).otherwise(F.col("r1")), F.when(second, F.col("t2")).otherwise(F.col("t1"))
    ok = u1 & ~(retry & ((r > reject_above) | cut))
    chosen = F.when(~ok, 0).when(second, 2).otherwise(1)
    text = F.when(chosen == 0, F.col("source_text")).when(chosen == 2, F.col("text2")).otherwise(F.col("text1"))
    out = row.select("chunk_id", chosen.alias("chosen"), text.alias("_text"))
    final = t.reflow(F.when(F.col("chosen") == 0, F.col("_text")).otherwise(t.strip_foreign("_text")))
    return out.select("chunk_id", "chosen", final.alias("text"))


def top_by_margin(scores: DataFrame, margin: float = 1.5, key: str = "bad", score: str = "score") -> DataFrame:
    """The best candidate of each key when it leads the next one by ``margin``; a lone candidate is not accepted."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "cand")
    two = scores.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    pair = two.groupBy(key).agg(
        F.max_by("cand", score).alias("cand"), F.max(score).alias("_top"), F.min(score).alias("_next"), F.count(F.lit(1)).alias("_n")
    )
    return pair.filter((F.col("_n") == 2) & (F.col("_top") - F.col("_next") >= margin)).select(key, "cand")


def listing_order(listing: DataFrame, newest_first: bool | None = None, by: str = "work_id") -> DataFrame:
    """Reading order of a listing. ``listing``: by, pos (0-based, without gaps), number.

    ``newest_first`` True always reverses; None reverses when the first number exceeds the last.
    """
    ends = listing.groupBy(by).agg(
        F.min_by("number", "pos").alias("_first"), F.max_by("number", "pos").alias("_last"), F.max("pos").alias("_end")
    )
    turn = F.lit(True) if newest_first else (F.col("_first") > F.col("_last"))
    out = listing.join(ends, by)
    return out.withColumn("pos", F.when(turn, F.col("_end") - F.col("pos")).otherwise(F.col("pos"))).select(*listing.columns)
