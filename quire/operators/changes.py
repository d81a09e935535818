"""Applying changes to the stored tables: every operator returns the new table and never touches the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import urls
from quire.functions.predicates import is_blank
from quire.operators.held import held, with_held, without_held
from quire.session import checkpoint

KEY = ["work_id", "number"]


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. A partial minimum runs before the shuffle, so repeated keys do not pile up."""
    whole = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.col(order)).alias("_row")).select("_row.*")


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    keys = [F.col(k).alias(f"_{k}") for k in key]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(version)).alias("_row")).select("_row.*")


def earliest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row that comes first of each key; rows that share a place by all their columns."""
    keys = [F.col(k).alias(f"_{k}") for k in key]
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"))).alias("_first")).select("_first._row.*")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str] = KEY, *, version: str) -> DataFrame:
    """Incoming rows replace stored rows of the same key; among incoming rows the highest version wins."""
    new = latest(incoming, key, version)
    kept = stored.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new.select(*stored.columns))


def resume(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Insert only the numbers a work does not have; of a number sent twice the first by ``order`` is inserted."""
    return stored.unionByName(resume_inserts(stored, incoming, order).select(*stored.columns))


def resume_inserts(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The rows that ``resume`` inserts. The stored side enters the join as bitmaps of its numbers."""
    return earliest(without_held(incoming, held(stored)), KEY, order)


def resume_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Inserted and skipped per work."""
    marked = with_held(incoming.select(*KEY).distinct(), held(stored), "_known")
    return marked.groupBy("work_id").agg(F.count_if(~F.col("_known")).alias("inserted"), F.count_if("_known").alias("skipped"))


def replace_works(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Drop all sections of the incoming works, then insert the payload."""
    kept = stored.join(incoming.select("work_id").distinct(), "work_id", "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def replace_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Deleted and inserted per work, and how many deleted rows carried audio or enrichment that is now gone."""
    lost = ~is_blank("audio_url") | ~is_blank("summary") | ~is_blank("highlight") | ~is_blank("next_preview")
    new = incoming.groupBy("work_id").agg(F.count(F.lit(1)).alias("inserted"))
    old = stored.groupBy("work_id").agg(F.count(F.lit(1)).alias("deleted"), F.count_if(lost).alias("lost_extras"))
    out = new.join(old, "work_id", "left")
    return out.select(
        "work_id", F.coalesce("deleted", F.lit(0)).alias("deleted"), "inserted",
        F.coalesce("lost_extras", F.lit(0)).alias("lost_extras"),
    )


def update_filled(stored: DataFrame, incoming: DataFrame, key: list[str], columns: list[str], version: str | None = None) -> DataFrame:
    """Incoming values that are not blank overwrite; the rest stays. Of a key sent twice the highest version counts, or
    without one the smallest row by all columns."""
    new = latest(incoming, key, version) if version else earliest(incoming.withColumn("_all", F.lit(0)), key, "_all")
    new = new.select(*key, *[F.nullif(F.col(c), F.lit("")).alias(f"_n_{c}") for c in columns])
    joined = stored.join(new, key, "left")
    return joined.select(
        *[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns]
    )


def update_report(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming keys and whether a stored row exists for them."""
    known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
    return incoming.select(*key).join(known, key, "left").select(
        *key, F.when(F.col("_known"), F.lit("updated")).otherwise(F.lit("not_found")).alias("status")
    )


def delete_works(works: DataFrame, sections: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove works and their sections."""
    ids = doomed.select("work_id").distinct()
    return works.join(ids, "work_id", "left_anti"), sections.join(ids, "work_id", "left_anti")


def slug_candidate(slug: Column, work_id: Column, k: int) -> Column:
    """The ``k``-th slug a work asks for: its own, then one with a suffix from its id, then that one numbered."""
    if not k:
        return slug
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(work_id, 256), 1, 8), F.lit(f"-{k}" if k > 1 else ""))


def unique_slugs(incoming: DataFrame, works: DataFrame) -> DataFrame:
    """A slug that is taken, by a stored work or by an earlier incoming row, gets suffixes until one is free.

    In round k every work without a slug asks for its k-th candidate. It gets it if no stored work and no work of an earlier round has it and it
    is the earliest by (created_at, work_id) of those that ask now. Works that lost ask again, so after the first round only clashing rows
    move; a popular slug does not gather its rows, its minimum is found by partial aggregates. Null slugs stay null.
    """
    taken = works.select("slug").distinct()
    asking = incoming.filter(F.col("slug").isNotNull()).select("work_id", "created_at", "slug")
    placed, k = [], 0
    while True:
        asked = asking.withColumn("_try", slug_candidate(F.col("slug"), F.col("work_id"), k))
        first = asked.groupBy("_try").agg(F.min(F.struct("created_at", "work_id")).alias("_first"))
        free = first.join(taken, first["_try"] == taken["slug"], "left_anti").select(F.col("_try").alias("_free"), "_first")
        judged = checkpoint(asked.join(free, (F.col("_try") == F.col("_free")) & (F.struct("created_at", "work_id") == F.col("_first")), "left"))
        won = judged.filter("_free IS NOT NULL").select("work_id", "_try")
        placed.append(won)
        asking = judged.filter("_free IS NULL").select("work_id", "created_at", "slug")
        if asking.isEmpty():
            break
        taken = checkpoint(taken.unionByName(won.select(F.col("_try").alias("slug"))))
        k += 1
    names = placed[0]
    for part in placed[1:]:
        names = names.unionByName(part)
    out = incoming.join(names.withColumnRenamed("_try", "_name").distinct(), "work_id", "left")
    return out.select(*[F.col("_name").alias("slug") if c == "slug" else F.col(c) for c in incoming.columns])


def change_log(df: DataFrame, key: list[str], column: str, new: Column) -> DataFrame:
    """Rows whose column would change, with the value before and after."""
    changed = df.select(*key, F.col(column).alias("before"), new.alias("after"))
    return changed.filter(~F.col("before").eqNullSafe(F.col("after")))


def section_id(work_id="work_id", number="number", content="content") -> Column:
    """Deterministic id of a section written by a job."""
    basis = F.concat_ws("|", F.col(work_id), F.col(number).cast("string"), F.col(content))
    return F.concat(F.lit("c"), F.substring(F.sha2(basis, 256), 1, 24))


def normal_time(iso: Column, epoch_ms: Column) -> Column:
    """A timestamp from ISO text or, where that does not parse, from epoch milliseconds."""
    return F.coalesce(F.try_to_timestamp(iso), F.timestamp_millis(epoch_ms))


def watch_add(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """New URLs to watch; one already watched, compared without trailing slash, is refused."""
    canonical = incoming.withColumn("_u", urls.trimmed("url"))
    fresh = canonical.join(state.select(urls.trimmed("url").alias("_u")).distinct(), "_u", "left_anti")
    return fresh.groupBy("_u").agg(F.min(F.struct(*incoming.columns)).alias("_row")).select("_row.*")


def watch_remove(state: DataFrame, doomed: DataFrame) -> DataFrame:
    """I2."""
    gone = doomed.select(urls.trimmed("url").alias("_u")).distinct()
    return state.withColumn("_u", urls.trimmed("url")).join(gone, "_u", "left_anti").drop("_u")
