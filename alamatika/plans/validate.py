"""Validate a table of addresses against a gazetteer, as one Spark plan.

One exchange, of the raw requests on ``address_id``. An address is exploded into its spans next to one
carrier row that holds its text; the spans meet the (broadcast) phrases, the hits and the
carrier come together again by address, the chosen phrases are exploded the same way into
candidates with their chain already attached, each candidate is scored in its own row, and
the rows are grouped by address once more. Neither grouping needs another exchange. The
grouping key is the request (its id and a hash of its text), so copies of one text, popular
names and popular sources never meet in one task; what one group holds is the candidate list
of one address, which is its result. A repeated request is answered once.

A lookup table above the broadcast bound is joined by shuffle instead; the phrases, the
smallest, are measured on their own so that spans stay local for as long as possible. The
carrier's join key is then its own address id, so carriers spread evenly, and adaptive
execution splits the partitions of popular phrases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import scoring as S
from alamatika.functions import text as T
from alamatika.operators import gazetteer as G
from alamatika.operators import matching as M
from alamatika.operators import resolution as R
from alamatika.operators.candidates import candidate_id
from alamatika.plans.gazetteer import Gazetteer
from alamatika.sources import requests as Q

LEVEL_NAMES = dict(
    zip(S.LEVELS, ("province", "city", "district", "subdistrict"))
)


def prepare(
    requests: DataFrame,
    registry: DataFrame,
    default_source: str = K.DEFAULT_SOURCE,
    max_bytes: int = K.MAX_ADDRESS_BYTES,
    keep: Sequence[str] = (),
    refused: bool = False,
) -> DataFrame:
    """Accepted requests with clean text: T1, R11, T2, T9.

    ``keep``: further columns, as a struct ``kept``. With ``refused`` the other requests stay
    too, with an empty text and ``refused`` true.
    """
    kept = [F.struct(*keep).alias("kept")] if keep else []
    requests = requests.select("address_id", "address", "source_code", *kept)
    routed = Q.route(requests, registry, default_source, max_bytes)
    clean = T.normalize(T.strip_html(F.col("address")))
    rest = ["kept"] if keep else []
    if refused:
        good = F.col("reject_reason").isNull()
        clean = F.when(good, clean).otherwise(F.lit(""))
        rest.append((~good).alias("refused"))
    else:
        routed = Q.accepted(routed)
    return routed.select(
        "address_id",
        F.col("address").alias("raw_input"),
        clean.alias("normalized"),
        "source_id",
        "source_code",
        "source_version",
        *rest,
    )


CARRIED = ("kept", "refused", "times")


def told_apart(texts: DataFrame) -> DataFrame:
    """Texts with ``copy``, which tells those of one id apart."""
    columns = ["raw_input", "source_id", "source_code", *[c for c in texts.columns if c == "kept"]]
    return texts.withColumn("copy", F.xxhash64(*columns))


def choose_phrases(
    texts: DataFrame, gazetteer: Gazetteer, partitions: int | None = None
) -> DataFrame:
    """M1..M4: one row per address: its text columns and ``chosen`` distinct phrases.

    A repeated id with the same text is one request, with another text a request of its own.
    """
    texts = told_apart(texts)
    split = gazetteer.split
    if split is not None:
        return M.chosen_phrases(texts, split.upper_phrases, gazetteer.max_words, split, partitions)
    return M.chosen_phrases(
        texts, gazetteer.lookup("phrases", gazetteer.phrases), gazetteer.max_words
    )


def _has_alias(entity: Column) -> Column:
    """An alias of the entity was selected in the text."""
    return F.coalesce(F.array_contains("aliased.ids", entity), F.lit(False))


def _first_alias(entity: Column, field: str) -> Column:
    at = F.array_position("aliased.ids", entity).cast("int") - 1
    return F.get(f"aliased.{field}", at)


def _alias_phrases(entity: Column) -> Column:
    """Selected phrases of the text that are an alias of an entity which has any."""
    every = F.filter("aliased.names", lambda n, i: F.get("aliased.ids", i) == entity)
    several = F.array_contains("aliased.several", entity)
    return F.when(several, every).otherwise(F.array(_first_alias(entity, "names")))


def expand_candidates(
    chosen: DataFrame, gazetteer: Gazetteer, with_evidence: bool = False
) -> DataFrame:
    """C1..C11: per address one carrier row and one row per candidate with its chain.

    ``with_evidence``: rows also hold ``all_evidence``, the evidence of their text in order.

    With aliases a region that the text names several times is one candidate: found by its
    own name if that was selected, else by the first of its aliases.
    """
    aliased = [c for c in ("aliased",) if c in chosen.columns]
    evidence = ["all_evidence"] if with_evidence else []
    if with_evidence:
        chosen = chosen.withColumn("all_evidence", T.extract_evidence(F.col("normalized")))
    payload = F.struct(
        "raw_input", "normalized", "source_code", "source_version",
        *[c for c in CARRIED if c in chosen.columns],
    )
    payload_type = chosen.select(payload.alias("p")).schema["p"].dataType
    carried = [
        "address_id", "copy", "source_id", "chosen", *aliased, *evidence,
        T.first_postal_code(F.col("normalized")).alias("input_code"),
    ]
    if gazetteer.split is not None:
        out = _expand_split(chosen, carried, payload, payload_type, gazetteer)
    else:
        carrier = F.struct(M.carrier_key().alias("phrase"), payload.alias("payload"))
        names = F.transform(
            "chosen",
            lambda p: F.struct(p.alias("phrase"), F.lit(None).cast(payload_type).alias("payload")),
        )
        rows = chosen.select(*carried, F.inline(F.concat(F.array(carrier), names)))
        # Only names with a place word root a candidate.
        entities = gazetteer.lexicon.where(F.col("place_words") > 0)
        out = rows.join(gazetteer.lookup("lexicon", entities), ["source_id", "phrase"], "left").where(
            F.col("entity_id").isNotNull() | F.col("payload").isNotNull()
        )
    if not aliased:
        return out
    own = F.coalesce(*[
        F.when(F.col("level") == level, F.array_contains("chosen", F.col(f"{name}_phrase")))
        for level, name in LEVEL_NAMES.items()
    ], F.lit(False))
    entity = F.col("entity_id")
    by_alias = ~own & _has_alias(entity) & (F.col("phrase") == F.array_min(_alias_phrases(entity)))
    return out.where((F.coalesce("origin", F.lit(K.BY_NAME)) == K.BY_NAME) | by_alias)


def _expand_split(
    chosen: DataFrame, carried: list, payload: Column, payload_type, gazetteer: Gazetteer
) -> DataFrame:
    """Candidates of a split lexicon: names of upper regions ask for them, subdistricts came
    with their text and ask for the chain of their district; one broadcast answers both.
    """
    leaf_type = chosen.schema["leaves"].dataType.elementType["leaf"].dataType
    no_leaf, no_text = F.lit(None).cast(leaf_type), F.lit(None).cast(payload_type)

    def row(key: Column, phrase: Column, leaf: Column, text: Column) -> Column:
        return F.struct(key.alias("key"), phrase.alias("phrase"), leaf.alias("leaf"), text.alias("payload"))

    names = F.transform("chosen", lambda p: row(p, p, no_leaf, no_text))
    # Only names with a place word root a candidate.
    rooted = F.filter("leaves", lambda e: e["leaf"]["place_words"] > 0)
    below = F.transform(rooted, lambda e: row(
        G.chain_key(e["leaf"]["district_id"]), e["phrase"], e["leaf"], no_text))
    carrier = row(M.carrier_key(), M.carrier_key(), no_leaf, payload)
    rows = chosen.select(*carried, F.inline(F.concat(F.array(carrier), names, below)))
    is_leaf = F.col("leaf").isNotNull()
    # A carrier's key is made of a given id, which may look like that of a chain.
    asked = rows.withColumn("key", F.when(F.col("payload").isNull(), F.col("key")))
    out = asked.join(F.broadcast(gazetteer.split.upper), ["source_id", "key"], "left").where(
        F.col("entity_id").isNotNull() | F.col("payload").isNotNull() | is_leaf
    )
    own = {c: F.col(f"leaf.{c}") for c in leaf_type.names}
    own["level"], own["subdistrict_id"] = F.lit(K.SUBDISTRICT), F.col("leaf.entity_id")
    overlaid = {c: F.when(is_leaf, value).otherwise(F.col(c)) for c, value in own.items()}
    for name in LEVEL_NAMES.values():  # a subdistrict without a district has no words above
        words = f"{name}_words"
        overlaid[words] = F.coalesce(overlaid.get(words, F.col(words)), F.lit(0))
    return out.withColumns(overlaid).drop("leaf", "key")


def score_candidates(rows: DataFrame) -> DataFrame:
    """E1..E15 on expanded rows; nothing but the row itself is needed.

    A level is confirmed when its own name is among the chosen phrases; each distinct
    place word of that name is one piece of evidence, a matching postal code another.
    """
    same_code = F.coalesce(
        (F.col("input_code") != "") & (F.col("input_code") == F.col("postal_code")), F.lit(False)
    )
    out = rows.withColumn("same_code", same_code)
    aliases = "aliased" in rows.columns
    for name in LEVEL_NAMES.values():
        named = F.coalesce(F.array_contains("chosen", F.col(f"{name}_phrase")), F.lit(False))
        if aliases:  # all selected names of the region: its words count once
            entity, own = F.col(f"{name}_id"), F.when(named, F.col(f"{name}_phrase"))
            also = _has_alias(entity)
            said = F.when(also, F.concat_ws(" ", own, _alias_phrases(entity))).otherwise(own)
            alone = also & ~named & ~F.array_contains("aliased.several", entity)
            words = (
                F.when(~also, F.col(f"{name}_words"))
                .when(alone, _first_alias(entity, "counts"))
                .otherwise(F.size(T.place_words(said)))
            )
            out = out.withColumns({f"{name}_said": said, f"{name}_words": words})
            named = named | also
        out = out.withColumn(f"{name}_named", named)
    named = {level: F.col(f"{name}_named") for level, name in LEVEL_NAMES.items()}
    said = "said" if aliases else "phrase"
    matched = dict(named)
    matched[K.SUBDISTRICT] = F.col("subdistrict_named") | F.col("same_code")
    counts = {
        level: F.when(named[level], F.col(f"{name}_words")).otherwise(F.lit(0))
        for level, name in LEVEL_NAMES.items()
    }
    counts[K.SUBDISTRICT] = counts[K.SUBDISTRICT] + F.col("same_code").cast("int")
    exact = F.lit(False)
    for flag in matched.values():
        exact = exact | flag
    prefix = F.when(F.col("same_code"), F.lit(K.W_PREFIX[5])).otherwise(F.lit(0.0))
    slots = [F.col(f"{n}_id") for n in LEVEL_NAMES.values()]
    orphan = S.orphan_city(F.col("province_id"), F.col("city_id"), S.filled_levels(*slots))
    score = S.confidence(
        exact,
        F.col("city_id").isNotNull(),
        F.col("postal_code").isNotNull(),
        prefix,
        matched,
        S.flat_bonus({level: n >= 2 for level, n in counts.items()}),
    )
    used = F.concat_ws(
        " ", *[F.when(named[lv], F.col(f"{n}_{said}")) for lv, n in LEVEL_NAMES.items()]
    )
    found = [
        F.col("phrase").alias("matched_name"),
        F.when(F.col("origin") == K.BY_ALIAS, F.array(*map(F.lit, (*K.STRATEGIES, K.ALIAS_STRATEGY))))
        .otherwise(F.array(*map(F.lit, K.STRATEGIES))).alias("strategies"),
    ] if aliases else []
    return out.select(
        "address_id",
        "copy",
        "source_id",
        "input_code",
        "payload",
        "entity_id",
        "kode",
        score.alias("confidence"),
        S.filled_levels(*slots).alias("levels"),
        F.array_compact(F.array(orphan)).cast(S.CONFLICTS_TYPE).alias("conflicts"),
        S.reasons(exact, matched, prefix).alias("reasons"),
        R.location(
            F.col("postal_code"), F.lit(None).cast("string"), F.col("subdistrict_name"),
            F.col("district_name"), F.col("city_name"), F.col("province_name"),
        ).alias("location"),
        used.alias("used"),
        "same_code",
        *[f"{n}_id" for n in LEVEL_NAMES.values()],
        "postal_code",
        *found,
    )


def gather(scored: DataFrame) -> DataFrame:
    """Per address its text, ``ranked`` (candidates in rank order) and ``top``.

    Each candidate's response entry is built in its own row; what only the winner needs
    is kept by a minimum, not collected.
    """
    order = F.struct(
        (-F.col("confidence")).alias("minus_confidence"),
        (-F.col("levels")).alias("minus_levels"),
        F.size("conflicts").alias("n_conflicts"),
        "kode",
        "entity_id",
    )
    entry = F.struct(
        candidate_id(F.col("address_id"), F.col("entity_id")).alias("uuid"),
        F.col("confidence").alias("score"),
        "location",
        "reasons",
        *[c for c in ("matched_name", "strategies") if c in scored.columns],
    )
    # A candidate without a province is ranked but not listed.
    listed = F.when(F.col("province_id").isNotNull(), entry)
    found = F.col("entity_id").isNotNull()
    winner = F.struct(
        "confidence", "conflicts", "reasons", "location", "used", "same_code",
        *[f"{n}_id" for n in LEVEL_NAMES.values()], "postal_code",
    )
    text = F.struct("source_id", "input_code", "payload")
    return (
        scored.groupBy("address_id", "copy")
        .agg(
            F.first(F.when(F.col("payload").isNotNull(), text), ignorenulls=True).alias("t"),
            F.sort_array(
                F.collect_list(F.when(found, F.struct(order.alias("o"), listed.alias("entry"))))
            ).alias("ranked"),
            F.min_by(winner, F.when(found, order)).alias("top"),
        )
        .select("address_id", "t.source_id", "t.input_code", "t.payload.*", "ranked", "top")
    )


def respond(gathered: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """R2..R9: status, postal fallback and the response columns (then those carried along)."""
    carried = [c for c in CARRIED if c in gathered.columns]
    has_winner = F.col("top").isNotNull()

    # R5 is asked only for addresses without a candidate; other rows get a key of their
    # own that finds nothing, which also spreads them if this is a shuffle join.
    guesses = gazetteer.guesses.select(
        "source_id", F.col("postal_code").alias("ask"), F.col("guess").cast(R.LOCATION_TYPE)
        .alias("guess"),
    )
    ask = F.when(~has_winner & (F.col("input_code") != ""), F.col("input_code")).otherwise(
        F.concat(F.lit("#"), F.col("address_id").cast("string"))
    )
    rows = gathered.withColumn("ask", ask).join(
        gazetteer.lookup("guesses", guesses), ["source_id", "ask"], "left"
    )

    empty = F.struct(*[F.lit("").alias(n) for n in
                       ("postal_code", "sub_district", "district", "city", "province")])
    filled, looked_up = R.fill_postal(F.col("top.location"), F.col("input_code"))
    looked_up = has_winner & looked_up
    inferred = ~has_winner & F.col("guess").isNotNull()
    no_text = F.array().cast("array<string>")
    slots = [F.col(f"top.{n}_id") for n in LEVEL_NAMES.values()]
    postal_slot = F.col("top.postal_code")
    values = T.evidence_values(F.col("normalized"))
    used = F.concat(
        F.split(F.col("top.used"), " "),
        F.when(F.col("top.same_code"), F.array("input_code")).otherwise(no_text),
    )
    status = S.ambiguous(
        S.status(F.col("top.conflicts"), *slots),
        F.col("top.confidence"),
        -F.get("ranked", F.lit(1))["o"]["minus_confidence"],
    )
    rows = (
        rows.withColumn("location", F.when(has_winner, filled).otherwise(
            F.coalesce(F.col("guess"), empty)))
        .withColumn("looked_up", looked_up)
        .withColumn("inferred", inferred)
    )
    strategy = F.when(
        has_winner, R.append_reason(F.col("top.reasons"), F.col("looked_up"), K.REASON_LOOKUP)
    ).otherwise(R.append_reason(no_text, F.col("inferred"), K.REASON_INFERRED))
    # The winner's entry, if it is listed, also tells that its code was looked up.
    entries = F.array_compact(F.col("ranked.entry"))
    amended = F.get("ranked", F.lit(0))["entry"].withField("reasons", strategy)
    candidates = F.when(
        F.col("looked_up") & F.col("top.province_id").isNotNull(),
        F.concat(F.array(amended), F.slice(entries, F.lit(2), F.size(entries))),
    ).otherwise(entries)
    return rows.select(
        F.col("address_id").cast("string").alias("address_id"),
        F.when(has_winner, status).otherwise(F.lit(K.UNKNOWN)).alias("status"),
        F.when(has_winner, F.col("top.confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        "raw_input",
        F.col("normalized").alias("normalized_input"),
        R.format_place(F.col("location")).alias("formatted_address"),
        "location",
        F.struct(
            F.when(has_winner, S.matched_components(*slots, postal_slot)).otherwise(no_text)
            .alias("matched"),
            F.when(has_winner, S.missing_components(*slots)).otherwise(no_text).alias("missing"),
            F.col("top.conflicts").alias("conflicts"),
            F.when(has_winner, F.array_except(values, used)).otherwise(no_text)
            .alias("ambiguous"),
        ).alias("assessment"),
        strategy.alias("strategy"),
        candidates.alias("candidates"),
        F.struct(
            F.col("source_code").alias("location_source"),
            F.col("source_version").alias("location_version"),
        ).alias("metadata"),
        *carried,
    ).select(
        "address_id", "status", "confidence", "raw_input", "normalized_input",
        "formatted_address", "location", "assessment",
        F.struct(
            "strategy", F.size("candidates").alias("candidate_count"), "candidates"
        ).alias("resolution"),
        "metadata",
        *carried,
    )


RESPONSE = (
    "address_id", "status", "confidence", "raw_input", "normalized_input", "formatted_address",
    "location", "assessment", "resolution", "metadata",
)


def dealt(
    requests: DataFrame, gazetteer: Gazetteer, partitions: int | None = None, by_address: bool = False
) -> DataFrame:
    """Requests dealt by address where the phrases or a sieve of them are broadcast, which
    spreads the work on texts. In the former case it is the one exchange; with a split lexicon
    ``choose_phrases`` deals by address what it needs, so rows are dealt by hash of the request
    only, unless ``by_address``.

    A number of partitions is given because rows grow a lot after it: adaptive execution
    would merge partitions by their small size here.
    """
    if "phrases" not in gazetteer.small and gazetteer.split is None:
        return requests
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if gazetteer.split is None or by_address:
        return requests.repartition(n, "address_id")
    return requests.repartition(n, F.xxhash64("address_id", "address"))


ADDRESSES_A_TASK = 20_000  # an address has tens of candidates, so rows grow after the exchange


def tasks_for(requests: DataFrame, gazetteer: Gazetteer) -> int | None:
    """With a split lexicon: partitions as set, or more if there are many requests (one count),
    so that the candidates of a task fit its memory however many there are.
    """
    if gazetteer.split is None:
        return None
    given = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(given, -(-requests.count() // ADDRESSES_A_TASK))


def answer(
    requests: DataFrame,
    gazetteer: Gazetteer,
    default_source: str = K.DEFAULT_SOURCE,
    max_bytes: int = K.MAX_ADDRESS_BYTES,
    partitions: int | None = None,
    keep: Sequence[str] = (),
    refused: bool = False,
) -> DataFrame:
    """R10 with what a caller knows of its requests: response columns, then ``kept`` (a struct
    of the columns named by ``keep``), ``refused`` where asked for, and ``times``.

    Requests with other kept values are requests of their own; equal ones are one row, and
    ``times`` tells how many they were. Nothing is joined back: kept values travel on the
    carrier row of their text.
    """
    columns = dict.fromkeys(("address_id", "address", "source_code", *keep))
    requests = requests.select(*columns)
    partitions = partitions or tasks_for(requests, gazetteer)
    requests = dealt(requests, gazetteer, partitions)
    texts = prepare(requests, gazetteer.registry, default_source, max_bytes, keep, refused)
    chosen = choose_phrases(texts, gazetteer, partitions)
    scored = score_candidates(expand_candidates(chosen, gazetteer))
    return respond(gather(scored), gazetteer)


def validate(
    requests: DataFrame,
    gazetteer: Gazetteer,
    default_source: str = K.DEFAULT_SOURCE,
    max_bytes: int = K.MAX_ADDRESS_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """One response row per accepted request.

    ``requests``: address_id, address, source_code. Copies of a request (a client's retry)
    are answered once; one id with several texts gets an answer for each. Requests that are
    refused are left out; ``sources.requests.route`` tells why. ``partitions`` of the
    exchange default to ``spark.sql.shuffle.partitions``. With a gazetteer of aliases each
    listed candidate also tells the ``matched_name`` and its discovery ``strategies``.
    """
    return answer(requests, gazetteer, default_source, max_bytes, partitions).select(*RESPONSE)
