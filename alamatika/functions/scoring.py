"""Score, status and reason expressions shared by the batch plan and the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alamatika.functions import constants as K

LEVELS = (K.PROVINCE, K.CITY, K.DISTRICT, K.SUBDISTRICT)
CONFLICTS_TYPE = "array<struct<type:string,message:string>>"


def _worth(flag: Column, weight: float) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))


def level_weight(level: Column, weights: dict[str, float]) -> Column:
    out = F
    for name, weight in weights.items():
        out = out.when(level == name, F.lit(weight))
    return out.otherwise(F.lit(0.0))


def prefix_score(evidence: Column, code: Column) -> Column:
    """Worth of the digits two postal codes share from the left (5, 4 or 3)."""
    out = F
    for n, weight in K.W_PREFIX.items():
        same = (
            (F.length(evidence) >= n)
            & (F.length(code) >= n)
            & (F.substring(evidence, 1, n) == F.substring(code, 1, n))
        )
        out = out.when(same, F.lit(weight))
    return out.otherwise(F.lit(0.0))


def capped_bonus(bonus: Column) -> Column:
    """The multi-evidence bonus never exceeds its cap."""
    return F.round(F.least(F.lit(K.MAX_MULTI), F.coalesce(bonus, F.lit(0.0))), 4)


def flat_bonus(repeated: dict[str, Column]) -> Column:
    """E13 where each level has one entity: flags say 'two or more evidence rows'."""
    total = F.lit(0.0)
    for level in LEVELS:
        total = total + _worth(repeated[level], K.W_MULTI[level])
    return capped_bonus(total)


def confidence(
    exact: Column,
    city_in_place: Column,
    has_postal: Column,
    prefix: Column,
    matched: dict[str, Column],
    bonus: Column,
) -> Column:
    """Weighted sum, at most 1, four decimals."""
    total = _worth(exact, K.W_EXACT) + _worth(city_in_place, K.W_HIERARCHY)
    total = total + _worth(has_postal, K.W_POSTAL)
    total = total + F.when(F.coalesce(has_postal, F.lit(False)), prefix).otherwise(F.lit(0.0))
    for level in LEVELS:
        total = total + _worth(matched[level], K.W_LEVEL[level])
    return F.round(F.least(F.lit(1.0), total + bonus), 4)


def reasons(exact: Column, matched: dict[str, Column], prefix: Column) -> Column:
    """Reasons in their fixed order."""
    items = [F.when(exact, F.lit(K.REASON_EXACT))]
    items += [F.when(matched[level], F.lit(K.REASON_LEVEL[level])) for level in LEVELS]
    tier = F
    for n, weight in K.W_PREFIX.items():
        tier = tier.when(prefix >= weight, F.lit(K.REASON_PREFIX[n]))
    return F.array_compact(F.array(*items, tier.otherwise(F.lit(None))))


def status(
    conflicts: Column, province: Column, city: Column, district: Column, subdistrict: Column
) -> Column:
    """CONFLICT, UNKNOWN, INCOMPLETE or VALID."""
    return (
        F.when(F.size(conflicts) > 0, F.lit(K.CONFLICT))
        .when(F.coalesce(province, city, district, subdistrict).isNull(), F.lit(K.UNKNOWN))
        .when(province.isNull() | city.isNull() | district.isNull(), F.lit(K.INCOMPLETE))
        .otherwise(F.lit(K.VALID))
    )


def matched_components(*slots: Column) -> Column:
    """Names of the filled slots (province, city, district, sub_district, postal_code)."""
    return F.array_compact(
        F.array(*[F.when(s.isNotNull(), F.lit(n)) for n, s in zip(K.COMPONENTS, slots)])
    )


def missing_components(*slots: Column) -> Column:
    """Names of the empty slots; a missing postal code is not reported."""
    return F.array_compact(
        F.array(*[F.when(s.isNull(), F.lit(n)) for n, s in zip(K.COMPONENTS[:4], slots)])
    )


def filled_levels(*slots: Column) -> Column:
    """C14: how many administrative slots are filled."""
    total = F.lit(0)
    for slot in slots:
        total = total + slot.isNotNull().cast("int")
    return total


def one_conflict(kind: str, message: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"))


def orphan_city(province: Column, city: Column, levels: Column) -> Column:
    """A city with another level but no province, as a conflict or null."""
    return F.when(
        (levels > 1) & city.isNotNull() & province.isNull(), one_conflict(*K.ORPHAN_CITY)
    )


def ambiguous(status_: Column, top: Column, second: Column) -> Column:
    """R2: a VALID winner whose runner-up is nearer than the gap is AMBIGUOUS."""
    near = second.isNotNull() & (F.abs(top - second) < F.lit(K.AMBIGUITY_GAP))
    return F.when((status_ == K.VALID) & near, F.lit(K.AMBIGUOUS)).otherwise(status_)
