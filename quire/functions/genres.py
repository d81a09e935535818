"""Genre, era and scene rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import rules
from quire.functions.text import col, strip


def _lookup(table: dict[str, str], key: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def map_genres(raw) -> Column:
    """Raw names to (genres, tags). A name whose genre is already taken goes to the tags, like an unknown one."""
    start = F.struct(
        F.array().cast("array<string>").alias("genres"), F.array().cast("array<string>").alias("tags")
    )

    def step(state, name):
        mapped = _lookup(rules.GENRES, F.lower(strip(name)))
        fresh = mapped.isNotNull() & ~F.array_contains(state["genres"], F.coalesce(mapped, F.lit("")))
        return F.struct(
            F.when(fresh, F.concat(state["genres"], F.array(mapped))).otherwise(state["genres"]).alias("genres"),
            F.when(fresh, state["tags"]).otherwise(F.concat(state["tags"], F.array(strip(name)))).alias("tags"),
        )

    def finish(state):
        joined = F.array_join(state["genres"], ",")
        return F.struct(
            F.when(joined == "", F.lit(rules.DEFAULT_GENRE)).otherwise(joined).alias("genres"),
            F.array_join(state["tags"], ",").alias("tags"),
        )

    return F.aggregate(col(raw), start, step, finish)


def split_names(c) -> Column:
    """A comma-joined list as an array; blank gives the empty array."""
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(col(c), ","))


def first_era(genres) -> Column:
    """Era of the first genre slug that has one."""
    eras = F.transform(split_names(genres), lambda g: _lookup(rules.ERAS, strip(g)))
    return F.coalesce(F.get(F.filter(eras, lambda e: e.isNotNull()), F.lit(0)), F.lit(rules.DEFAULT_ERA))


def chosen_era(genres, stored) -> Column:
    """The era of the first genre wins over the stored one unless that is ``thap-nien``."""
    by_genre = _lookup(rules.FIRST_GENRE_ERAS, strip(F.get(split_names(genres), F.lit(0))))
    stored = F.nullif(col(stored), F.lit(""))
    return F.when(by_genre.isNotNull() & ~(F.coalesce(stored, F.lit("")) == "thap-nien"), by_genre).otherwise(
        F.coalesce(stored, by_genre, F.lit(rules.DEFAULT_ERA))
    )


def shot_type(position, total, emotion) -> Column:
    """First and last scene fixed, then the emotion's shot, else the rotation."""
    position, total = col(position), col(total)
    by_emotion = _lookup(rules.SHOT_BY_EMOTION, F.lower(col(emotion)))
    turn = F.element_at(F.array(*[F.lit(s) for s in rules.SHOT_ROTATION]), F.pmod(position, F.lit(len(rules.SHOT_ROTATION))).cast("int") + 1)
    return (
        F.when(position == 0, F.lit("medium")).when(position == total - 1, F.lit("close_up")).otherwise(F.coalesce(by_emotion, turn))
    )
