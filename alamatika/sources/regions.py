"""Gazetteer scans (S5..S10, G9): filters that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("deleted_at").isNull())


def _scan(regions: DataFrame, level_id: int, source_id: int | None, postal: bool) -> DataFrame:
    rows = active(regions).where(F.col("level_id") == level_id)
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    cols: list[str | Column] = ["id", "source_id", "kode", "name", "norm_name"]
    if postal:
        cols.append(F.coalesce("postal_code", F.lit("")).alias("postal_code"))
    return rows.select(*cols)


def provinces(regions: DataFrame) -> DataFrame:
    """Provinces of all sources."""
    return _scan(regions, 2, None, postal=False)


def cities(regions: DataFrame) -> DataFrame:
    """Cities of all sources."""
    return _scan(regions, 3, None, postal=True)


def districts(regions: DataFrame, source_id: int) -> DataFrame:
    """Districts of one source."""
    return _scan(regions, 4, source_id, postal=False)


def subdistricts(regions: DataFrame, source_id: int) -> DataFrame:
    """Subdistricts of one source."""
    return _scan(regions, 5, source_id, postal=True)


def parent_map(hierarchy: DataFrame, child: str, parent: str) -> DataFrame:
    """One (child, parent) row per child; the highest parent id wins a clash."""
    return active(hierarchy).groupBy(child).agg(F.max(parent).alias(parent))


def parent_maps(hierarchy: DataFrame) -> dict[str, DataFrame]:
    """The three child-to-parent maps, keyed by the child's column."""
    return {
        "city_id": parent_map(hierarchy, "city_id", "province_id"),
        "district_id": parent_map(hierarchy, "district_id", "city_id"),
        "subdistrict_id": parent_map(hierarchy, "subdistrict_id", "district_id"),
    }


def city_provinces(hierarchy: DataFrame, source_id: int) -> DataFrame:
    """(city_id, province_id) of one source; the lowest province id wins a clash."""
    return (
        active(hierarchy)
        .where(F.col("source_id") == source_id)
        .groupBy("city_id")
        .agg(F.min("province_id").alias("province_id"))
    )
