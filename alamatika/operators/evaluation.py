"""Evaluation operators (E1..E16) on any table of candidates.

Besides the candidate columns a row carries ``evidence``, the array of its matched
evidence (type, value, entity_id, level, name), and may carry ``all_evidence``, the
array of (type, value) found in the text. A null array counts as an empty one. Only E1 needs other tables; all else is
row-local, so a table of structured addresses is checked without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import scoring as S
from alamatika.operators.bounded import lookup_left
from alamatika.operators.candidates import SLOT_OF, SLOTS


def _ev(column: str = "evidence") -> Column:
    return F.coalesce(F.col(column), F.array())


def _slots() -> list[Column]:
    return [F.col(s) for s in SLOTS]


def hierarchy_conflict(
    candidates: DataFrame, parents: dict[str, DataFrame] | None, small: bool = False
) -> DataFrame:
    """Adds ``hierarchy_conflict``: message of the first broken link, or null.

    A child that is not in the parent map is a broken link; empty slots are skipped.
    ``small``: the maps are measured within the broadcast bound; otherwise rows with an empty
    slot and those of popular regions are spread. Without parent maps nothing is checked.
    """
    if parents is None:
        return candidates.withColumn("hierarchy_conflict", F.lit(None).cast("string"))
    out = candidates
    broken = F
    for child, parent, message in (
        ("city_id", "province_id", K.CITY_NOT_IN_PROVINCE),
        ("district_id", "city_id", K.DISTRICT_NOT_IN_CITY),
        ("subdistrict_id", "district_id", K.SUBDISTRICT_NOT_IN_DISTRICT),
    ):
        lookup = parents[child].select(
            F.col(child).alias(f"_{child}"), F.col(parent).alias(f"_up_{child}")
        )
        out = lookup_left(out, child, lookup, f"_{child}", small)
        wrong = (
            F.col(child).isNotNull()
            & F.col(parent).isNotNull()
            & ~F.col(parent).eqNullSafe(F.col(f"_up_{child}"))
        )
        broken = broken.when(wrong, F.lit(message))
    return out.withColumn("hierarchy_conflict", broken.otherwise(F.lit(None))).drop(
        *[f"_up_{c}" for c in SLOTS[1:]]
    )


def unused_evidence() -> Column:
    """Evidence of the text whose value no matched evidence has."""
    used = F.array(F.transform(_ev(), lambda e: e["value"]))
    left = F.transform(
        used,  # one element, so the list of used values is built once
        lambda u: F.filter(_ev("all_evidence"), lambda e: ~F.array_contains(u, e["value"])),
    )
    return F.get(left, F.lit(0))


def postal_mismatch() -> Column:
    """E5: the postal slot belongs to another subdistrict."""
    wrong = (
        F.col("postal_id").isNotNull()
        & F.col("subdistrict_id").isNotNull()
        & (F.col("postal_id") != F.col("subdistrict_id"))
    )
    return F.when(wrong, S.one_conflict(*K.POSTAL_MISMATCH))


def orphan_city() -> Column:
    """A city beside another level but no province."""
    return S.orphan_city(F.col("province_id"), F.col("city_id"), S.filled_levels(*_slots()))


def multiple_cities() -> Column:
    """Each city in the evidence that is not the candidate's, once per id under the name
    that comes first.
    """
    other = F.filter(
        _ev(),
        lambda e: (e["level"] == K.CITY)
        & F.col("city_id").isNotNull()
        & (e["entity_id"] != F.col("city_id")),
    )
    city = "array<struct<id:bigint,name:string>>"
    distinct = F.aggregate(
        other,
        F.array().cast(city),
        lambda done, e: F.when(F.exists(done, lambda d: d["id"] == e["entity_id"]), done).otherwise(
            F.concat(done, F.array(
                F.struct(e["entity_id"].cast("bigint").alias("id"), e["name"].alias("name"))
            ))
        ),
    )
    kind, text = K.MULTIPLE_CITY
    return F.transform(
        distinct,
        lambda d: F.struct(
            F.lit(kind).alias("type"),
            F.concat(F.lit(text), F.coalesce(d["name"], F.lit(""))).alias("message"),
        ),
    )


def duplicate_levels() -> Column:
    """Evidence for another province, district or subdistrict; repeats are kept."""
    kind, text = K.DUPLICATE_LEVEL

    def clashes(e: Column) -> Column:
        out = F.lit(False)
        for level in (K.PROVINCE, K.DISTRICT, K.SUBDISTRICT):
            slot = F.col(SLOT_OF[level])
            out = out | ((e["level"] == level) & slot.isNotNull() & (e["entity_id"] != slot))
        return F.coalesce(out, F.lit(False))

    return F.transform(
        F.filter(_ev(), clashes),
        lambda e: F.struct(
            F.lit(kind).alias("type"),
            F.concat(F.lit(text), e["level"], F.lit(": "), F.coalesce(e["name"], F.lit("")))
            .alias("message"),
        ),
    )


def conflicts() -> Column:
    """All conflicts in their fixed order; never null."""
    hierarchy = F.when(
        F.col("hierarchy_conflict").isNotNull(),
        F.struct(
            F.lit(K.HIERARCHY_CONFLICT).alias("type"),
            F.col("hierarchy_conflict").alias("message"),
        ),
    )
    single = F.array_compact(F.array(hierarchy, postal_mismatch(), orphan_city()))
    return F.concat(single, multiple_cities(), duplicate_levels()).cast(S.CONFLICTS_TYPE)


def has_exact() -> Column:
    """Whether any evidence is resolved."""
    return F.exists(_ev(), lambda e: e["entity_id"].isNotNull())


def matched_levels() -> dict[str, Column]:
    """Levels whose entity is confirmed by evidence."""

    def confirmed(level: str, slot: str) -> Column:
        return F.col(slot).isNotNull() & F.exists(
            _ev(),
            lambda e: F.coalesce(
                (e["level"] == level) & (e["entity_id"] == F.col(slot)), F.lit(False)
            ),
        )

    return {level: confirmed(level, slot) for level, slot in SLOT_OF.items()}


def postal_prefix() -> Column:
    """Score of the first postal evidence that shares a prefix with the slot."""
    scores = F.transform(
        F.filter(_ev(), lambda e: e["type"] == K.POSTAL_CODE),
        lambda e: S.prefix_score(e["value"], F.col("postal_code")),
    )
    first = F.get(F.filter(scores, lambda s: s > 0), F.lit(0))
    return F.coalesce(first, F.lit(0.0))


def multi_evidence_bonus() -> Column:
    """Entities with two or more evidence rows earn their level's bonus once.

    Sorted by entity, a pass counts each run and pays at its second row: no pairs.
    """
    resolved = F.filter(_ev(), lambda e: e["entity_id"].isNotNull())
    entities = F.sort_array(
        F.transform(
            resolved,
            lambda e: F.struct(
                e["entity_id"].alias("id"), F.coalesce(e["level"], F.lit("")).alias("level")
            ),
        )
    )
    state = "struct<id:bigint,run:int,total:double>"
    start = F.struct(F.lit(None).alias("id"), F.lit(0).alias("run"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["id"].eqNullSafe(x["id"]), acc["run"] + 1).otherwise(F.lit(1))
        pay = F.when(run == 2, S.level_weight(x["level"], K.W_MULTI)).otherwise(F.lit(0.0))
        return F.struct(
            x["id"].alias("id"), run.alias("run"), (acc["total"] + pay).alias("total")
        ).cast(state)

    total = F.aggregate(entities, start.cast(state), step, lambda acc: acc["total"])
    return S.capped_bonus(total)


def evaluate(
    candidates: DataFrame, parents: dict[str, DataFrame] | None, small: bool = False
) -> DataFrame:
    """E1..E15 of every candidate; ``small`` as for E1."""
    rows = hierarchy_conflict(candidates, parents, small).withColumn("conflicts", conflicts())
    # Facts used by both score and reasons, computed once per row.
    facts = {f"_{level}": flag for level, flag in matched_levels().items()}
    rows = rows.withColumns({
        **facts,
        "_exact": has_exact(),
        "postal_prefix": postal_prefix(),
        "multi_bonus": multi_evidence_bonus(),
    })
    matched = {level: F.col(f"_{level}") for level in SLOT_OF}
    exact = F.col("_exact")
    city_in_place = F.col("city_id").isNotNull() & F.col("hierarchy_conflict").isNull()
    score = S.confidence(
        exact,
        city_in_place,
        F.col("postal_id").isNotNull(),
        F.col("postal_prefix"),
        matched,
        F.col("multi_bonus"),
    )
    rows = (
        rows.withColumn("confidence", score)
        .withColumn("status", S.status(F.col("conflicts"), *_slots()))
        .withColumn("matched", S.matched_components(*_slots(), F.col("postal_id")))
        .withColumn("missing", S.missing_components(*_slots()))
        .withColumn("reasons", S.reasons(exact, matched, F.col("postal_prefix")))
        .drop(*facts, "_exact")
    )
    if "all_evidence" in candidates.columns:
        rows = rows.withColumn("unused", unused_evidence())
    return rows
