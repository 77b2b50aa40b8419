"""The gazetteer as a bundle of tables, and the job that seeds it from dumps."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.operators import gazetteer as G
from alamatika.operators.bounded import MAX_BROADCAST_BYTES, measured_bytes
from alamatika.sources import dumps
from alamatika.sources.requests import registry_of


_LOCAL_FOLDERS: dict[str, str] = {}

# Above this a lexicon is split: its hash table in every executor and the wide rows it adds
# to a shuffle both grow with the number of subdistricts.
MAX_LEXICON_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", None) or ""):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="alamatika-")
    return _LOCAL_FOLDERS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back: cuts the lineage of a
    result that is used more than once.
    """
    return _Writer(df.sparkSession)(df, name)


@dataclass(frozen=True)
class SplitLexicon:
    """A large lexicon in two parts, so that addresses meet the large one in narrow rows.

    ``leaves``: subdistricts by name, joined by shuffle. ``sieve``: what tells most other
    spans from their names beforehand. ``upper``: levels above, and the chains of districts;
    ``upper_phrases``: its distinct phrases. The last three are broadcast. ``leaf_words`` and
    ``upper_words`` bound the spans that are looked up in either part.
    """

    leaves: DataFrame
    upper: DataFrame
    upper_phrases: DataFrame
    sieve: DataFrame
    sieve_words: int
    leaf_words: int
    upper_words: int


@dataclass(frozen=True)
class Gazetteer:
    """Regions with the lookup tables a validation job joins.

    ``registry``: the newest version of each source code. ``phrases``: distinct (source_id, phrase). ``lexicon``: one row per entity with its
    chain. ``guesses``: inferred location per (source_id, postal_code). ``max_words``
    bounds the spans looked up; ``small`` names the tables that were measured within the
    broadcast bound. ``split``: the parts of a lexicon that is large but has few regions above
    its subdistricts.
    """

    registry: DataFrame
    regions: DataFrame
    hierarchy: DataFrame
    phrases: DataFrame
    lexicon: DataFrame
    guesses: DataFrame
    max_words: int
    small: frozenset[str]
    split: SplitLexicon | None = None

    @staticmethod
    def build(
        sources: DataFrame,
        regions: DataFrame,
        hierarchy: DataFrame | None = None,
        *,
        aliases: DataFrame | None = None,
        save: bool = True,
        max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
        max_lexicon_bytes: int = MAX_LEXICON_BYTES,
    ) -> "Gazetteer":
        """Derive the lookup tables; ``save`` writes them once to the shared folder.

        ``aliases`` (location_id, alias, deleted_at): other names under which regions are
        found too.
        """
        spark = regions.sparkSession
        write = _Writer(spark) if save else (lambda df, name: df)
        regions = write(regions, "regions")
        hierarchy = write(
            G.flatten_hierarchy(regions) if hierarchy is None else hierarchy, "hierarchy"
        )
        lexicon = write(G.lexicon(regions, hierarchy, aliases), "lexicon")
        guesses = write(G.postal_guesses(G.reverse_postal(regions)), "guesses")
        phrases = write(G.lookup_phrases(lexicon), "phrases")
        tables = {"phrases": phrases, "lexicon": lexicon, "guesses": guesses, "hierarchy": hierarchy}
        size = {name: measured_bytes(df) for name, df in tables.items()}
        small = frozenset(name for name, n in size.items() if n <= max_broadcast_bytes)
        split = None
        if size["lexicon"] > min(max_lexicon_bytes, max_broadcast_bytes):
            split = _split(lexicon, write, max_broadcast_bytes)
        return Gazetteer(
            registry=registry_of(sources),
            regions=regions,
            hierarchy=hierarchy,
            phrases=phrases,
            lexicon=lexicon,
            guesses=guesses,
            max_words=G.longest_phrase(lexicon),
            small=small,
            split=split,
        )

    def lookup(self, name: str, df: DataFrame) -> DataFrame:
        """A view of a lookup table as join side: broadcast only when measured small."""
        return F.broadcast(df) if name in self.small else df


def _split(lexicon: DataFrame, write, max_broadcast_bytes: int) -> SplitLexicon | None:
    """The parts of a lexicon, or nothing if the upper one cannot be broadcast either."""
    upper = write(G.upper_lexicon(lexicon), "upper")
    if measured_bytes(upper) > max_broadcast_bytes:
        return None
    leaves = write(G.leaf_names(lexicon), "leaves")
    words = G.sieve_words(leaves.count())
    phrases = write(G.lookup_phrases(lexicon.where(F.col("level") != K.SUBDISTRICT)), "upper_phrases")
    return SplitLexicon(
        leaves=leaves,
        upper=upper,
        upper_phrases=phrases,
        sieve=write(G.sieve(leaves, words), "sieve"),
        sieve_words=words,
        leaf_words=G.longest_phrase(leaves),
        upper_words=G.longest_phrase(phrases),
    )


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, below the one of this application: what an
    application leaves there can be deleted as a whole when it has ended.
    """
    return f"{shared_folder(spark)}/alamatika-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class _Writer:
    """Writes tables under one new folder and reads them back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = new_folder(spark)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def seed_from_dumps(
    region_dump: str,
    postal_dump: str,
    sources: DataFrame,
    regions: DataFrame,
    *,
    code: str,
    version: str,
    name: str,
    code_date: str = "",
    desc: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Seed job: register the source, scan both dumps, attach codes, append new regions.

    Returns (all sources, regions to append).
    """
    spark = regions.sparkSession
    new = spark.range(1).select(
        F.lit(code).alias("code"),
        F.lit(version).alias("version"),
        F.lit(name).alias("name"),
        F.lit(code_date).alias("code_date"),
        F.lit(desc).alias("desc"),
    )
    # Written once: ids handed out anew by each evaluation could differ from the rows' own.
    all_sources = written(G.register_sources(sources, new), "sources")
    source_id = (
        all_sources.where(
            (F.col("code") == code) & (F.col("version") == version) & F.col("deleted_at").isNull()
        )
        # A deleted (code, version) is not registered again and has no id to seed under.
        .agg(F.coalesce(F.max("id"), F.raise_error(F.lit("the location source is deleted"))))
        .scalar()
    )
    rows = G.attach_postal_codes(
        dumps.read_region_dump(spark, region_dump), dumps.read_postal_dump(spark, postal_dump)
    ).withColumn("source_id", source_id)
    return all_sources, G.insert_regions(regions, rows)


def save_regions(regions: DataFrame, path: str, mode: str = "append") -> None:
    """Write regions partitioned by source; ``mode='overwrite'`` reloads (G10) only the
    sources present in ``regions`` and leaves the others alone.
    """
    (
        regions.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id")
        .parquet(path)
    )
