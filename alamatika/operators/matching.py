"""Dictionary matching (M1..M9): phrases of a text that are names in the gazetteer.

Tables: ``addresses(address_id, source_id, normalized)``, ``phrases`` as built by
``gazetteer.phrase_dict``. Everything is keyed by address; only the phrase and postal
lookups join on other keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import text as T
from alamatika.operators import gazetteer as G

SPANS_TYPE = "array<struct<start:int,end:int,phrase:string>>"


def _span(start: Column, end: Column, phrase: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), phrase.alias("phrase"))


def spans(words: Column, max_words: int, item: Callable[..., Column] = _span) -> Column:
    """M1: all runs of up to ``max_words`` words, each built by ``item(start, end, phrase)``.

    ``words`` should be a plain column: it is read once per run.
    """

    def runs_of(length: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - length),
            lambda i: item(
                i.cast("int"),
                (i + length).cast("int"),
                F.array_join(F.slice(words, i + 1, length), " "),
            ),
        )

    bound = F.least(F.size(words), F.lit(max_words))
    # A text without words has no runs: its sequence is the empty array.
    lengths = F.filter(F.sequence(F.lit(0), bound), lambda n: n > 0)
    return F.flatten(F.transform(lengths, runs_of))


def greedy(hits: Column) -> Column:
    """M3 + M4: longest hit at each start, left to right, without overlap.

    ``hits`` is an array of (start, minus_end, phrase); sorted, the longest hit of a
    start comes first, so one pass that keeps what begins after the last end is exact.
    """
    state = "struct<last:int,kept:array<struct<start:int,end:int,phrase:string>>>"
    first = F.struct(F.lit(0).alias("last"), F.array().cast(SPANS_TYPE).alias("kept"))

    def step(acc: Column, hit: Column) -> Column:
        end = -hit["minus_end"]
        item = F.struct(
            hit["start"].alias("start"), end.alias("end"), hit["phrase"].alias("phrase")
        )
        grown = F.struct(
            end.alias("last"), F.concat(acc["kept"], F.array(item)).alias("kept")
        )
        return F.when(hit["start"] >= acc["last"], grown.cast(state)).otherwise(acc)

    return F.aggregate(F.sort_array(hits), first.cast(state), step, lambda acc: acc["kept"])


def ngrams(addresses: DataFrame, max_words: int) -> DataFrame:
    """M1 as rows: (address_id, source_id, start, end, phrase)."""
    words = addresses.select("address_id", "source_id", T.words_of(F.col("normalized")).alias("w"))
    return words.select("address_id", "source_id", F.inline(spans(F.col("w"), max_words)))


def phrase_hits(grams: DataFrame, phrases: DataFrame) -> DataFrame:
    """M2: spans that are a name of the same source."""
    return grams.join(phrases.select("source_id", "phrase"), ["source_id", "phrase"], "left_semi")


def longest_hits(hits: DataFrame) -> DataFrame:
    """M3: the longest hit at each start."""
    return hits.groupBy("address_id", "source_id", "start").agg(
        F.max("end").alias("end"), F.max_by("phrase", "end").alias("phrase")
    )


def greedy_spans(hits: DataFrame) -> DataFrame:
    """M4: the selected spans of every address (a list no longer than its words)."""
    hit = F.struct("start", (-F.col("end")).alias("minus_end"), "phrase")
    return (
        hits.groupBy("address_id", "source_id")
        .agg(F.collect_list(hit).alias("hits"))
        .select("address_id", "source_id", F.inline(greedy(F.col("hits"))))
    )


def word_entities(selected: DataFrame, phrases: DataFrame) -> DataFrame:
    """M5: each word of a selected span with the entities of its phrase.

    A word in two spans gets the union; phrases are made distinct per address before
    the entities are joined, so no entity is repeated for a word.
    """
    per_word = selected.select(
        "address_id", "source_id", "phrase", F.explode(F.split("phrase", " ")).alias("word")
    ).distinct()
    return per_word.join(phrases, ["source_id", "phrase"]).select(
        "address_id", "source_id", "word", "phrase", "entity_id", "level", "kode", "name",
        "postal_code", *_origin(phrases),
    )


def _origin(df: DataFrame) -> list[str]:
    """Columns that only a dictionary with aliases has."""
    return [c for c in ("origin", "matched_name") if c in df.columns]


def carrier_key() -> Column:
    """Join key of a row that only carries its text along: '#' is in no phrase, so the key
    finds nothing and spreads carriers by address.
    """
    return F.concat(F.lit("#"), F.col("address_id").cast("string"))


def chosen_phrases(
    texts: DataFrame, phrases: DataFrame, max_words: int, split=None, partitions: int | None = None
) -> DataFrame:
    """M1..M4 in one pass: per text its columns and ``chosen``, its distinct selected phrases.

    ``texts``: address_id, copy (tells texts of one id apart), source_id, normalized and
    others, which travel on one carrier row beside the spans. ``phrases``: distinct
    (source_id, phrase), hinted or not; texts dealt by address stay so if it is broadcast.
    Equal texts of one id are one row, ``times`` tells how many they were. If phrases have
    ``alias_of`` (ids of regions), ``aliased`` holds the selected ones and whose they are.

    With a ``split`` lexicon ``phrases`` are those of its upper part, and ``leaves`` holds
    (phrase, leaf) of the selected names of subdistricts; texts are dealt to ``partitions`` once
    and meet there what their spans found.
    """
    named = "alias_of" in phrases.columns
    payload = F.struct(*[c for c in texts.columns if c not in ("address_id", "copy")])
    payload_type = texts.select(payload.alias("p")).schema["p"].dataType
    carrier = F.struct(
        carrier_key().alias("phrase"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("minus_end"),
        payload.alias("payload"),
    )

    def looked_up(start: Column, end: Column, phrase: Column) -> Column:
        return F.struct(
            phrase.alias("phrase"),
            start.alias("start"),
            (-end).alias("minus_end"),
            F.lit(None).cast(payload_type).alias("payload"),
        )

    known = phrases.withColumn("known", F.lit(True))
    is_span = F.col("start").isNotNull()
    if split is not None:
        partitions = partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found, max_words = _leaf_hits(texts, split, partitions), split.upper_words
        texts, known = texts.repartition(partitions, "address_id"), F.broadcast(known)
    rows = texts.withColumn("words", T.words_of(F.col("normalized"))).select(
        "address_id",
        "copy",
        "source_id",
        F.inline(F.concat(F.array(carrier), spans(F.col("words"), max_words, looked_up))),
    )
    hits = rows.join(known, ["source_id", "phrase"], "left").where(F.col("known") | ~is_span)
    if split is not None:
        # A name of both parts comes twice, which greedy() passes over.
        hits = hits.drop("source_id", "known").unionByName(found, allowMissingColumns=True)
    aggs = [
        F.first("payload", ignorenulls=True).alias("p"),
        F.collect_list(F.when(is_span, F.struct("start", "minus_end", "phrase"))).alias("hits"),
        F.count_if(~is_span).alias("times"),
    ]
    extra = []
    if named:
        other = F.when(is_span & F.col("alias_of").isNotNull(), F.struct("phrase", "alias_of"))
        aggs.append(F.collect_set(other).alias("others"))
        extra.append("others")
    if split is not None:
        # A phrase has one list of leaves; a span that comes again repeats it.
        found = F.when(is_span & F.col("leaves").isNotNull(), F.struct("phrase", "leaves"))
        aggs.append(F.collect_list(found).alias("found"))
        extra.append("found")
    chosen = F.array_distinct(F.transform(greedy(F.col("hits")), lambda s: s["phrase"]))
    out = hits.groupBy("address_id", "copy").agg(*aggs).select(
        "address_id", "copy", "p.*", "times", chosen.alias("chosen"), *extra
    )
    if split is not None:
        selected = F.array_distinct(F.filter("found", lambda f: F.array_contains("chosen", f["phrase"])))
        out = out.withColumn("leaves", F.flatten(F.transform(selected, lambda f: F.transform(
            f["leaves"], lambda e: F.struct(f["phrase"].alias("phrase"), e.alias("leaf"))
        )))).drop("found")
    if not named:
        return out
    selected = F.filter("others", lambda o: F.array_contains("chosen", o["phrase"]))
    pairs = F.flatten(F.transform(selected, lambda o: F.transform(
        o["alias_of"], lambda e: F.struct(e.alias("entity_id"), o["phrase"].alias("phrase"))
    )))
    if split is not None:
        by_alias = F.filter("leaves", lambda e: (e["leaf"]["origin"] == K.BY_ALIAS) & (e["leaf"]["place_words"] > 0))
        pairs = F.concat(pairs, F.transform(by_alias, lambda e: F.struct(
            e["leaf"]["entity_id"].alias("entity_id"), e["phrase"].alias("phrase"))))
    # Beside each other, so that a candidate finds its alias by position; regions of several
    # aliases are named apart.
    out = out.withColumn("pairs", pairs)
    ids = F.transform("pairs", lambda a: a["entity_id"])
    names = F.transform("pairs", lambda a: a["phrase"])
    out = out.withColumns({"ids": ids, "names": names})
    return out.withColumn("aliased", F.struct(
        "ids", "names",
        F.transform("names", lambda n: F.size(T.place_words(n))).alias("counts"),
        F.filter("ids", lambda x, i: F.array_position("ids", x) != i + 1).alias("several"),
    )).drop("pairs", "ids", "names", "others")


def _leaf_hits(texts: DataFrame, split, partitions: int) -> DataFrame:
    """M2 in the lower part of a split lexicon: spans that name subdistricts, with ``leaves``.

    Only spans that pass the sieve are exchanged for the lookup by name, and only those found
    go on to their text. The text itself and the names above stay out of both exchanges.
    """
    word, mask = G.sieve_word(split.sieve_words), G.sieve_mask()

    def asking(start: Column, end: Column, phrase: Column) -> Column:
        return F.struct(phrase.alias("ask"), start.alias("start"), (-end).alias("minus_end"))

    rows = texts.withColumn("words", T.words_of(F.col("normalized"))).select(
        "address_id", "copy", "source_id", F.inline(spans(F.col("words"), split.leaf_words, asking))
    )
    asked = (
        rows.withColumn("phrase", F.col("ask"))
        .withColumn("word", word)
        .withColumn("mask", mask)
        .join(F.broadcast(split.sieve), "word")
        .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        .drop("word", "mask", "bits", "phrase")
    )
    leaves = split.leaves.select("source_id", F.col("phrase").alias("ask"), "leaves")
    return (
        asked.join(leaves, ["source_id", "ask"])
        .select("address_id", "copy", F.col("ask").alias("phrase"), "start", "minus_end", "leaves")
        .repartition(partitions, "address_id")
    )


def match_phrases(addresses: DataFrame, phrases: DataFrame, max_words: int) -> DataFrame:
    """M1..M5: (address_id, word, entity) of every word inside a selected phrase."""
    hits = phrase_hits(ngrams(addresses, max_words), phrases)
    return word_entities(greedy_spans(longest_hits(hits)), phrases)


def evidence(addresses: DataFrame) -> DataFrame:
    """T12 as rows: (address_id, source_id, ev_pos, type, value)."""
    return addresses.select(
        "address_id",
        "source_id",
        F.posexplode(T.extract_evidence(F.col("normalized"))).alias("ev_pos", "e"),
    ).select("address_id", "source_id", "ev_pos", "e.type", "e.value")


_ENTITY = ("entity_id", "level", "kode", "name", "postal_code")


def _postal_lookup(evidence_: DataFrame, phrases: DataFrame, how: str) -> DataFrame:
    if "origin" in phrases.columns:
        phrases = phrases.where(F.col("origin") == K.BY_NAME)  # a region once
    codes = phrases.where(
        (F.col("level") == K.SUBDISTRICT) & (F.col("postal_code") != "")
    ).select("source_id", F.col("postal_code").alias("value"), *_ENTITY)
    return evidence_.where(F.col("type") == K.POSTAL_CODE).join(
        codes, ["source_id", "value"], how
    ).select(*evidence_.columns, *_ENTITY)


def _place_lookup(evidence_: DataFrame, words: DataFrame, how: str) -> DataFrame:
    words = words.withColumnRenamed("word", "value")
    key = ["address_id", "value", "entity_id"]
    if "origin" in words.columns:
        # A region once per word: under its own name if that was selected, else its first alias.
        first = F.min(F.struct(F.col("origin") != K.BY_NAME, "origin", F.col("phrase").alias("matched_name")))
        found = words.groupBy(*key).agg(
            *[F.first(c).alias(c) for c in _ENTITY if c not in key], first.alias("_m")
        ).select(*key, *[c for c in _ENTITY if c not in key], "_m.origin", "_m.matched_name")
    else:
        found = words.select("address_id", "value", *_ENTITY).dropDuplicates(key)
    return evidence_.where(F.col("type") == K.PLACE_NAME).join(
        found, ["address_id", "value"], how
    ).select(*evidence_.columns, *_ENTITY, *_origin(found))


POSTAL_COPIES = 4  # of a coded region in a lookup by shuffle: a popular code has several tasks


def _postal_dealt(
    evidence_: DataFrame, phrases: DataFrame, how: str, partitions: int, once: bool = False
) -> DataFrame:
    """``_postal_lookup`` by a shuffle into a given number of partitions.

    A code belongs to many regions, so rows grow after the exchange: adaptive execution would
    merge its partitions by their small size and leave the growth to a few tasks. With ``once``
    equal rows are one, which needs no exchange of its own.
    """
    key = ["source_id", "value", "_copy"]
    codes = tagged_entities(phrases).where(F.col("type") == K.POSTAL_CODE).select(
        "source_id", F.col("key").alias("value"), *_ENTITY,
        F.explode(F.sequence(F.lit(0), F.lit(POSTAL_COPIES - 1))).alias("_copy"),
    )
    copy = F.pmod(F.xxhash64("address_id"), F.lit(POSTAL_COPIES)).cast("int")
    asked = evidence_.where(F.col("type") == K.POSTAL_CODE).withColumn("_copy", copy)
    asked = asked.repartition(partitions, *key)
    if once:
        asked = asked.distinct()
    return asked.join(
        codes.repartition(partitions, *key), key, how
    ).select(*evidence_.columns, *_ENTITY)


def resolve_postal(
    evidence_: DataFrame, phrases: DataFrame, partitions: int | None = None
) -> DataFrame:
    """M6: postal evidence with the subdistricts of the source that have the code.

    ``partitions``: of a dictionary that is too large to broadcast.
    """
    if partitions is not None:
        return _postal_dealt(evidence_, phrases, "inner", partitions)
    return _postal_lookup(evidence_, phrases, "inner")


def resolve_place(evidence_: DataFrame, words: DataFrame) -> DataFrame:
    """M7: place evidence with the entities of its word, once per entity."""
    return _place_lookup(evidence_, words, "inner")


def resolve_evidence(evidence_: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """M9: M6 and M7 together; evidence that resolves to nothing stays with nulls."""
    return _postal_lookup(evidence_, phrases, "left").unionByName(
        _place_lookup(evidence_, words, "left"), allowMissingColumns=True
    )


def tagged_entities(phrases: DataFrame) -> DataFrame:
    """One dimension for M6 and M7: entities keyed (type, source_id, key), by phrase for place
    evidence and by postal code for postal evidence.
    """
    places = phrases.select(
        F.lit(K.PLACE_NAME).alias("type"), "source_id", F.col("phrase").alias("key"), *_ENTITY
    )
    coded = phrases.where((F.col("level") == K.SUBDISTRICT) & (F.col("postal_code") != ""))
    return places.unionByName(coded.select(
        F.lit(K.POSTAL_CODE).alias("type"), "source_id", F.col("postal_code").alias("key"), *_ENTITY
    ))


def resolve_chosen(chosen: DataFrame, tagged: DataFrame) -> DataFrame:
    """M9 on texts with their chosen phrases (``chosen_phrases``), by one lookup in
    ``tagged_entities``.

    A place word asks with each selected phrase it is a word of, a postal code with itself;
    what has nothing to ask with gets a key of its own that finds nothing, so unresolved
    evidence stays, and is spread by address if this is a shuffle join.
    """
    rows = chosen.select(
        "address_id", "source_id", "chosen",
        F.posexplode(T.extract_evidence(F.col("normalized"))).alias("ev_pos", "e"),
    ).select("address_id", "source_id", "ev_pos", "e.type", "e.value", "chosen")
    keys = F.when(F.col("type") == K.POSTAL_CODE, F.array("value")).otherwise(
        F.filter("chosen", lambda p: F.array_contains(F.split(p, " "), F.col("value")))
    )
    asked = rows.withColumn("keys", keys).select(
        "address_id", "source_id", "ev_pos", "type", "value",
        F.explode(F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(carrier_key()))).alias("key"),
    )
    return asked.join(tagged, ["type", "source_id", "key"], "left").select(
        "address_id", "source_id", "ev_pos", "type", "value", *_ENTITY
    )


def resolve_places(chosen: DataFrame, phrases: DataFrame) -> DataFrame:
    """M7 on texts of a split lexicon: place evidence with the entities of its word.

    Subdistricts came with their text (``leaves``), those above are a broadcast dimension, so
    nothing is exchanged. Unresolved evidence stays with nulls. ``district_of`` is the district
    that the gazetteer gives a subdistrict, the parent C10 fills.
    """
    fields = (*_ENTITY, "district_of")
    above = F.struct(*_ENTITY, F.lit(None).cast("long").alias("district_of"))
    upper = (
        phrases.where(F.col("level") != K.SUBDISTRICT)
        .groupBy("source_id", F.col("phrase").alias("key"))
        .agg(F.collect_list(above).alias("named"))
    )
    leaves = F.col("leaves")
    if "origin" in chosen.schema["leaves"].dataType.elementType["leaf"].dataType.names:
        leaves = F.filter(leaves, lambda e: e["leaf"]["origin"] == K.BY_NAME)
    rows = chosen.select(
        "address_id", "source_id", "chosen", leaves.alias("leaves"),
        F.posexplode(T.extract_evidence(F.col("normalized"))).alias("ev_pos", "e"),
    ).where(F.col("e.type") == K.PLACE_NAME)
    keys = F.filter("chosen", lambda p: F.array_contains(F.split(p, " "), F.col("e.value")))
    asked = rows.select("*", F.explode_outer(keys).alias("key"))

    def entity(e: Column) -> Column:
        return F.struct(
            e["leaf"]["entity_id"].alias("entity_id"), F.lit(K.SUBDISTRICT).alias("level"),
            e["leaf"]["kode"].alias("kode"), e["leaf"]["subdistrict_name"].alias("name"),
            F.coalesce(e["leaf"]["postal_code"], F.lit("")).alias("postal_code"),
            e["leaf"]["district_id"].alias("district_of"),
        )

    own = F.transform(F.filter("leaves", lambda e: e["phrase"] == F.col("key")), entity)
    found = asked.join(F.broadcast(upper), ["source_id", "key"], "left")
    every = F.flatten(F.array_compact(F.array("named", own)))
    return found.select(
        "address_id", "source_id", "ev_pos", "e.type", "e.value", F.inline_outer(every)
    ).toDF("address_id", "source_id", "ev_pos", "type", "value", *fields)


def resolve_split(
    chosen: DataFrame, phrases: DataFrame, partitions: int, texts: DataFrame | None = None
) -> DataFrame:
    """M9 on texts of a split lexicon: M7 without an exchange and M6 by one of the codes.

    ``texts``: those that ``chosen`` was made of, with their ``copy``. Codes are then read from
    them, so the choice of phrases, which codes do not need, is made once.
    """
    # Not a filter: that would be pushed below the exchange of texts, which is then made again.
    code = F.filter(F.array(T.first_postal_code(F.col("normalized"))), lambda c: c != "")
    codes = (chosen if texts is None else texts).select(
        "address_id", "copy", "source_id", F.lit(0).alias("ev_pos"),
        F.lit(K.POSTAL_CODE).alias("type"), F.explode(code).alias("value"),
    )
    return _postal_dealt(codes, phrases, "left", partitions, texts is not None).drop("copy").unionByName(
        resolve_places(chosen, phrases).drop("district_of")
    )
