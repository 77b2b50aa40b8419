"""Gazetteer build operators (G1..G12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import text as T
from alamatika.sources.regions import active, parent_maps

REGION_COLUMNS = (
    "id", "source_id", "kode", "name", "norm_name", "level_id", "postal_code", "deleted_at",
)
SOURCE_COLUMNS = ("id", "code", "version", "name", "code_date", "desc", "deleted_at")


def level_dimension(spark: SparkSession) -> DataFrame:
    """Level ids and names."""
    return spark.createDataFrame(
        [(i, i, name) for i, name in K.LEVELS], "id int, code int, name string"
    )


def entity_level(level_id: Column) -> Column:
    """Level id to entity level name."""
    out = F
    for key, name in K.ENTITY_LEVELS.items():
        out = out.when(level_id == key, F.lit(name))
    return out


def attach_postal_codes(regions: DataFrame, postal_codes: DataFrame) -> DataFrame:
    """G1: left join of codes by kode; regions without a code stay."""
    return regions.drop("postal_code").join(postal_codes, "kode", "left")


def _numbered(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Give new rows unique ids above the existing ones, each task numbering its own.

    Ids rise within a task and are not dense, like any auto-increment with gaps. Rows
    are ordered inside the task first, so a re-run task hands out the same ids.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).scalar()
    return rows.sortWithinPartitions(*order).withColumn(
        "id", F.monotonically_increasing_id() + 1 + top
    )


def register_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-ignore on (code, version); returns all sources with their ids."""
    keys = ["code", "version"]
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    fresh = fresh.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    added = _numbered(fresh, existing, keys)
    return existing.select(*SOURCE_COLUMNS).unionByName(added.select(*SOURCE_COLUMNS))


def first_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the smallest in ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def insert_regions(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows to append for (source_id, kode) not yet present.

    ``rows``: source_id, line_pos, kode, name, level_id, postal_code. The first line of
    a kode wins; existing rows are never updated; the normalised name is stored.
    """
    keys = ["source_id", "kode"]
    fresh = first_rows(rows, keys, "line_pos").join(
        existing.select(*keys), keys, "left_anti"
    )
    return _numbered(
        fresh.withColumn("norm_name", T.normalize(F.col("name"))).withColumn(
            "deleted_at", F.lit(None).cast("timestamp")
        ),
        existing,
        keys,
    ).select(*REGION_COLUMNS)


def rebuild_normalized(regions: DataFrame) -> DataFrame:
    """Recompute the normalised name of active rows."""
    return regions.withColumn(
        "norm_name",
        F.when(F.col("deleted_at").isNull(), T.normalize(F.col("name"))).otherwise(
            F.col("norm_name")
        ),
    )


def _prefix(n: int) -> Column:
    return F.substring_index("kode", ".", n)


def _leaves(regions: DataFrame) -> DataFrame:
    return (
        active(regions)
        .where((F.col("level_id") == 5) & (F.size(F.split("kode", r"\.")) == 4))
        .select(
            "source_id",
            F.col("id").alias("subdistrict_id"),
            "kode",
            _prefix(1).alias("province_kode"),
            _prefix(2).alias("city_kode"),
            _prefix(3).alias("district_kode"),
        )
    )


def _parents(regions: DataFrame, level: str) -> DataFrame:
    # A parent is any active row of levels 2..4 with the code; codes are unique.
    return (
        active(regions)
        .where(F.col("level_id").isin(2, 3, 4))
        .select(
            "source_id",
            F.col("kode").alias(f"{level}_kode"),
            F.col("id").alias(f"{level}_id"),
        )
    )


def _with_parents(regions: DataFrame) -> DataFrame:
    """Leaves with the ids of their parents, null where a parent is missing.

    The chain above is looked up once per district code, which is few rows; the leaves then
    meet it on the district code, a key of many values.
    """
    leaves = _leaves(regions)
    levels = ("province", "city", "district")
    chain = leaves.select("source_id", *[f"{level}_kode" for level in levels]).distinct()
    for level in levels:
        chain = chain.join(_parents(regions, level), ["source_id", f"{level}_kode"], "left")
    return leaves.join(
        chain.select("source_id", "district_kode", *[f"{level}_id" for level in levels]),
        ["source_id", "district_kode"], "left",
    )


def flatten_hierarchy(regions: DataFrame) -> DataFrame:
    """One (province, city, district, subdistrict) row per complete chain."""
    return (
        _with_parents(regions)
        .where(
            F.col("province_id").isNotNull()
            & F.col("city_id").isNotNull()
            & F.col("district_id").isNotNull()
        )
        .select(
            "source_id",
            "province_id",
            "city_id",
            "district_id",
            "subdistrict_id",
            F.lit(None).cast("timestamp").alias("deleted_at"),
        )
    )


def hierarchy_rejects(regions: DataFrame) -> DataFrame:
    """Subdistricts left out of the hierarchy, with the first missing parent."""
    missing = (
        F.when(F.col("province_id").isNull(), F.lit("parent province not found"))
        .when(F.col("city_id").isNull(), F.lit("parent city not found"))
        .when(F.col("district_id").isNull(), F.lit("parent district not found"))
    )
    return (
        _with_parents(regions)
        .select("source_id", "subdistrict_id", "kode", missing.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def latest_sources(sources: DataFrame) -> DataFrame:
    """Per code the active source with the highest id: (code, id, version)."""
    return (
        active(sources)
        .groupBy("code")
        .agg(F.max(F.struct("id", "version")).alias("s"))
        .select("code", "s.id", "s.version")
    )


def name_index(regions: DataFrame) -> DataFrame:
    """Entities by source and normalised name."""
    return (
        active(regions)
        .where(F.col("level_id").between(2, 5))
        .select(
            "source_id",
            F.col("norm_name").alias("phrase"),
            F.col("id").alias("entity_id"),
            entity_level(F.col("level_id")).alias("level"),
            "kode",
            "name",
            F.when(F.col("level_id").isin(3, 5), F.coalesce("postal_code", F.lit("")))
            .otherwise(F.lit(""))
            .alias("postal_code"),
        )
    )


def phrase_dict(regions: DataFrame) -> DataFrame:
    """The phrase dictionary: names of the four levels that have any word."""
    return name_index(regions).where(F.col("phrase") != "")


ALIAS_COLUMNS = ("id", "location_id", "alias", "created_at", "updated_at", "deleted_at")


def alias_index(aliases: DataFrame, regions: DataFrame) -> DataFrame:
    """Other names of regions: (source_id, phrase, entity_id, level, kode, name, postal_code).

    ``aliases``: location_id, alias, deleted_at. Soft-deleted aliases and those of deleted
    regions are left out, as are names without a word and those that only repeat the region's
    own; spellings that normalise alike count once. ``name`` is the region's own name.
    """
    own = name_index(regions)
    given = active(aliases).select(
        F.col("location_id").alias("entity_id"), T.normalize(F.col("alias")).alias("_alias")
    ).where(F.coalesce("_alias", F.lit("")) != "").distinct()
    return (
        own.join(given, "entity_id")
        .where(~F.col("_alias").eqNullSafe(F.col("phrase")))
        .withColumn("phrase", F.col("_alias"))
        .select(*own.columns)
    )


def named_phrases(regions: DataFrame, aliases: DataFrame) -> DataFrame:
    """G8 with X2: the dictionary of own names and aliases, told apart by ``origin``."""
    return phrase_dict(regions).withColumn("origin", F.lit(K.BY_NAME)).unionByName(
        alias_index(aliases, regions).withColumn("origin", F.lit(K.BY_ALIAS))
    )


def longest_phrase(phrases: DataFrame) -> int:
    """Words of the longest phrase, the bound for spans (one number back)."""
    words = F.size(F.split("phrase", " "))
    return phrases.agg(F.coalesce(F.max(words), F.lit(0)).alias("n")).first()["n"]


def lexicon(regions: DataFrame, hierarchy: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Phrase dictionary with each entity's whole chain of ancestors (C10 done once).

    With ``aliases`` (X2) a region has one row for its own name and one for each alias, told
    apart by ``origin``; ``*_phrase`` are own names in both.

    Ancestors come from the hierarchy's parent maps, level by level, and only when the
    parent row is active. ``*_phrase`` is null for names without a place word: they are
    found in a text but are evidence for nothing.
    """
    maps = parent_maps(hierarchy)
    # A region whose own name has no word can still have an alias.
    rows = phrase_dict(regions) if aliases is None else name_index(regions)

    def place_phrase(phrase: Column) -> Column:
        return F.when(F.size(T.place_words(phrase)) > 0, phrase)

    own = {}
    for level, name in (
        (K.PROVINCE, "province"), (K.CITY, "city"), (K.DISTRICT, "district"),
        (K.SUBDISTRICT, "subdistrict"),
    ):
        here = F.col("level") == level
        own[f"{name}_id"] = F.when(here, F.col("entity_id"))
        own[f"{name}_name"] = F.when(here, F.col("name"))
        own[f"{name}_phrase"] = F.when(here, F.col("phrase"))
    out = rows.select(
        "source_id", "phrase", "entity_id", "level", "kode",
        F.when(F.col("level") == K.SUBDISTRICT, F.nullif("postal_code", F.lit("")))
        .alias("postal_code"),
        *[c.alias(n) for n, c in own.items()],
    )
    names = active(regions).where(F.col("level_id").isin(2, 3, 4)).select(
        "id", "level_id", "name", "norm_name"
    )
    for child, parent, level_id in (
        ("subdistrict", "district", 4), ("district", "city", 3), ("city", "province", 2),
    ):
        up = maps[f"{child}_id"].select(
            F.col(f"{child}_id").alias("_child"), F.col(f"{parent}_id").alias("_up")
        )
        row = names.where(F.col("level_id") == level_id).select(
            F.col("id").alias("_up"), F.col("name").alias("_name"),
            F.col("norm_name").alias("_norm"),
        )
        step = up.join(row, "_up")
        out = (
            out.join(step, F.col(f"{child}_id") == F.col("_child"), "left")
            .withColumn(f"{parent}_id", F.coalesce(f"{parent}_id", "_up"))
            .withColumn(f"{parent}_name", F.coalesce(f"{parent}_name", "_name"))
            .withColumn(f"{parent}_phrase", F.coalesce(f"{parent}_phrase", "_norm"))
            .drop("_child", "_up", "_name", "_norm")
        )
    out = out.withColumn("place_words", F.size(T.place_words(F.col("phrase"))))
    for name in ("province", "city", "district", "subdistrict"):
        phrase = place_phrase(F.col(f"{name}_phrase"))
        out = out.withColumn(f"{name}_phrase", phrase).withColumn(
            f"{name}_words",
            F.when(phrase.isNotNull(), F.size(T.place_words(phrase))).otherwise(F.lit(0)),
        )
    if aliases is None:
        return out
    other = alias_index(aliases, regions).select("entity_id", F.col("phrase").alias("_alias"))
    found = out.join(other, "entity_id").withColumns({
        "phrase": F.col("_alias"), "place_words": F.size(T.place_words(F.col("_alias"))),
        "origin": F.lit(K.BY_ALIAS),
    })
    own = out.where(F.col("phrase") != "").withColumn("origin", F.lit(K.BY_NAME))
    return own.unionByName(found.select(*own.columns))


def lookup_phrases(lexicon_: DataFrame) -> DataFrame:
    """Distinct (source_id, phrase) of a lexicon; with aliases also ``alias_of``: the regions
    whose alias it is, if the alias has a place word.
    """
    if "origin" not in lexicon_.columns:
        return lexicon_.select("source_id", "phrase").distinct()
    by_alias = (F.col("origin") == K.BY_ALIAS) & (F.col("place_words") > 0)
    ids = F.sort_array(F.collect_set(F.when(by_alias, F.col("entity_id"))))
    return lexicon_.groupBy("source_id", "phrase").agg(ids.alias("alias_of")).withColumn(
        "alias_of", F.when(F.size("alias_of") > 0, F.col("alias_of"))
    )


LEAF_COLUMNS = (
    "entity_id", "kode", "postal_code", "district_id", "subdistrict_name", "subdistrict_phrase",
    "subdistrict_words", "place_words",
)
_ABOVE = tuple(f"{level}_{c}" for level in ("province", "city", "district") for c in ("id", "name", "phrase", "words"))
CHAIN_MARK = "#:"  # of a join key that asks for the chain of a district; '#' is in no phrase


def chain_key(district_id: Column) -> Column:
    """Join key that asks ``upper_lexicon`` for a district with its ancestors."""
    return F.concat(F.lit(CHAIN_MARK), district_id.cast("string"))


def leaf_names(lexicon_: DataFrame) -> DataFrame:
    """Subdistricts by name: (source_id, phrase, leaves), without the names above them.

    That is the part of a lexicon that grows; a subdistrict tells its district, whose chain
    is in ``upper_lexicon``.
    """
    origin = [c for c in ("origin",) if c in lexicon_.columns]
    return (
        lexicon_.where(F.col("level") == K.SUBDISTRICT)
        .select("source_id", "phrase", F.struct(*LEAF_COLUMNS, *origin).alias("leaf"))
        .distinct()
        .groupBy("source_id", "phrase")
        .agg(F.collect_list("leaf").alias("leaves"))
    )


def upper_lexicon(lexicon_: DataFrame) -> DataFrame:
    """Provinces, cities and districts by name, and the chain of each district that has
    subdistricts by ``chain_key``: the lexicon without ``phrase`` but with ``key``.
    """
    rest = [c for c in lexicon_.columns if c != "phrase"]
    is_leaf = F.col("level") == K.SUBDISTRICT
    named = lexicon_.where(~is_leaf & (F.col("place_words") > 0)).select(F.col("phrase").alias("key"), *rest)
    types = dict(lexicon_.dtypes)
    chains = (
        lexicon_.where(is_leaf & F.col("district_id").isNotNull())
        .select("source_id", *_ABOVE)
        .distinct()
        .select(chain_key(F.col("district_id")).alias("key"), *[
            F.col(c) if c in ("source_id", *_ABOVE) else F.lit(None).cast(types[c]).alias(c) for c in rest
        ])
    )
    return named.unionByName(chains)


SIEVE_BITS = 16  # per name, in words of 64
MAX_SIEVE_WORDS = 1 << 21


def sieve_word(words: int) -> Column:
    """The word of the sieve that holds a (source_id, phrase)."""
    return F.pmod(F.xxhash64(F.col("source_id").cast("long"), "phrase"), F.lit(words))


def sieve_mask() -> Column:
    """The bits of a (source_id, phrase) in its word."""
    h = F.xxhash64("phrase", F.col("source_id").cast("long"))
    mask = F.lit(0).cast("long")
    for shift in (0, 6, 12):
        bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def sieve_words(n_names: int) -> int:
    """Size of the sieve: in proportion up to a bound, above which it lets more through."""
    return max(1, min(MAX_SIEVE_WORDS, n_names * SIEVE_BITS // 64))


def sieve(names: DataFrame, words: int) -> DataFrame:
    """A Bloom filter of names as a table (word, bits), for a broadcast: a name whose bits are
    not all in its word is surely unknown; others are looked up.
    """
    return names.groupBy(sieve_word(words).alias("word")).agg(F.bit_or(sieve_mask()).alias("bits"))


def reverse_postal(regions: DataFrame) -> DataFrame:
    """Every coded region with the names of its ancestors by kode prefix.

    ``sub_district`` is the row's own name whatever its level; names that cannot be
    found are ''.
    """
    rows = active(regions)
    parts = F.size(F.split("kode", r"\."))
    upper = F.when(parts.isin(2, 3, 4), F.regexp_extract("kode", r"^(.*)\.", 1))
    coded = rows.where(F.coalesce("postal_code", F.lit("")) != "").select(
        "source_id", "postal_code", "kode", F.col("name").alias("sub_district"), upper.alias("_upper")
    )
    # Names above are looked up once per code above; only codes of at most three parts occur.
    depth = F.size(F.split("_upper", r"\."))
    chain = coded.where(F.col("_upper").isNotNull()).select("source_id", "_upper").distinct().select(
        "*",
        F.when(depth == 3, F.col("_upper")).alias("_district"),
        F.when(depth >= 2, F.substring_index("_upper", ".", 2)).alias("_city"),
        F.substring_index("_upper", ".", 1).alias("_province"),
    )
    parents = rows.where(parts <= 3)
    levels = ("district", "city", "province")
    for level in levels:
        names = parents.select(
            "source_id", F.col("kode").alias(f"_{level}"), F.col("name").alias(level)
        )
        chain = chain.join(names, ["source_id", f"_{level}"], "left")
    coded = coded.join(
        chain.select("source_id", "_upper", *levels), ["source_id", "_upper"], "left"
    ).fillna("", levels)
    return coded.select(
        "source_id", "postal_code", "kode", "sub_district", "district", "city", "province"
    )


def postal_guesses(reverse: DataFrame) -> DataFrame:
    """Per (source, code) the first row of the most frequent district name.

    Ties go to the smaller name, the first row is the one with the smallest kode. Two
    aggregates, both combined before their shuffle; no group is held in one place.
    """
    place = F.struct("postal_code", "sub_district", "district", "city", "province")
    return (
        reverse.groupBy("source_id", "postal_code", "district")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(place, F.col("kode")).alias("place"))
        .groupBy("source_id", "postal_code")
        .agg(F.min_by("place", F.struct(-F.col("n"), F.col("district"))).alias("guess"))
    )
