"""The catalogue audit: five findings and the thresholds they used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quire.operators import catalog


@dataclass(frozen=True)
class Thresholds:
    min_sections: int = 5
    min_words: int = 300
    min_description: int = 80
    short_rows: int = 200


def audit(works: DataFrame, sections: DataFrame, limits: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """A2: one DataFrame per finding."""
    return {
        "thin_works": catalog.thin_works(works, sections, limits.min_sections).select("slug", "title", "sections"),
        "unenriched_works": catalog.unenriched_works(works),
        "weak_description": catalog.weak_descriptions(works, limits.min_description),
        "unenriched_sections": catalog.unenriched_sections(works, sections).drop("work_id"),
        "short_sections": catalog.shortest(works, sections, limits.min_words, limits.short_rows).drop("work_id"),
    }


def audit_rows(works: DataFrame, sections: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """K9: the audit as rows (signal, work_slug, number, item): one JSON item per finding plus the thresholds.

    The findings stay rows of a data set, since their number grows with the catalogue; written with
    ``write.json`` they form a JSON-lines report.
    """
    out = None
    for signal, found in audit(works, sections, limits).items():
        slug = "slug" if "slug" in found.columns else "work_slug"
        number = F.col("number") if "number" in found.columns else F.lit(None)
        rows = found.select(
            F.lit(signal).alias("signal"), F.col(slug).alias("work_slug"), number.cast("int").alias("number"),
            F.to_json(F.struct(*found.columns)).alias("item"),
        )
        out = rows if out is None else out.unionByName(rows)
    used = works.sparkSession.range(1).select(
        F.lit("thresholds").alias("signal"), F.lit(None).cast("string").alias("work_slug"),
        F.lit(None).cast("int").alias("number"),
        F.to_json(
            F.struct(
                F.lit(limits.min_sections).alias("min_sections"), F.lit(limits.min_words).alias("min_words"),
                F.lit(limits.min_description).alias("min_description"),
            )
        ).alias("item"),
    )
    return out.unionByName(used)


def audit_summary(works: DataFrame, sections: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Findings per signal and work."""
    rows = audit_rows(works, sections, limits).filter(F.col("signal") != "thresholds")
    return rows.groupBy("signal", "work_slug").agg(F.count(F.lit(1)).alias("findings"))
