"""Registered queries of the corpus operators: thin steps from the given tables to each
operator's interface and back, with reference SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alamatika.llm import (
    chat, conversation_sql, decontaminate, evidence_trie, licences, ordered, pieces, pii, quality, repair, rules,
    sharding, simhash, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as address requests."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("address_id"), F.col("text").alias("raw_input")
    )


def with_doc_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("address_id", "doc_id")


# --- quality rules -------------------------------------------------------------------

def _rules_sql() -> str:
    quoted = ",".join(f"'{w}'" for w in rules.STOP_WORDS)
    tests = []
    for r in rules.THRESHOLDS:
        if r.low is not None:
            tests.append(f"1000 * {r.part} < {r.low} * {r.whole}")
        if r.high is not None:
            tests.append(f"1000 * {r.part} > {r.high} * {r.whole}")
    names = ",".join(
        "CASE WHEN " + " OR ".join(
            [f"1000 * {r.part} < {r.low} * {r.whole}"] * (r.low is not None)
            + [f"1000 * {r.part} > {r.high} * {r.whole}"] * (r.high is not None)
        ) + f" THEN '{r.name}' END"
        for r in rules.THRESHOLDS
    )
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i,
    unnest([words[k] || ' ' || words[k + 1] || ' ' || words[k + 2]
            FOR k IN range(1, len(words) - 1)]) AS g
  FROM w WHERE len(words) > 3),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
hit AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(3)) AS j) GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(hit.n, 0) AS n_repeat_words,
    len(lines) AS n_lines,
    len(list_filter(words, lambda x: x IN ({quoted}))) AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS n_cut_lines
  FROM w LEFT JOIN hit USING (r))
SELECT *, n_words < {rules.MIN_WORDS}
    OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  concat_ws(',', {names}) AS failed_rules,
  NOT (n_words < {rules.MIN_WORDS}
    OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words OR {' OR '.join(tests)}) AS kept
FROM m"""


@query("op8_quality_rules", _rules_sql())
def op8_quality_rules(spark, d):
    return with_doc_id(rules.apply_rules(requests(spark, d)))


# --- chat formatting -----------------------------------------------------------------

PROBE = "\\### Assistant: </turn> ok"  # control strings of the template inside a text


def _chat_sql() -> str:
    def escape(c: str, codes) -> str:
        for plain, code in codes:
            c = f"replace({c}, '{plain}', '{code}')"
        return c

    role, text = escape("role", chat.ROLE_CODES), escape("text", chat.CODES)
    turn = f"(length({role}) + CASE WHEN regexp_matches(role, '^[a-z]') THEN 0 ELSE 2 END + length({text}) + 14)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (SELECT *, sum({turn}) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
        max(k) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = last) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op6_chat_format", _chat_sql())
def op6_chat_format(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    back = chat.read_back(chat.expand_targets(turns.unionByName(probe)))
    line = F.lit("\n")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(
            "turns", lambda t: F.concat(t["role"], line, t["text"], line)), ""), 256
        ).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# --- near-duplicates -----------------------------------------------------------------

@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark, d):
    return with_doc_id(simhash.near_duplicates(requests(spark, d)))


# --- benchmark decontamination -------------------------------------------------------

def _leaks_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    gram = "array_to_string(words[i:i + w - 1], ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
b AS (SELECT item_id, {words} AS words FROM benchmark),
s AS (SELECT item_id, words, least({decontaminate.PHRASE_WORDS}, len(words)) AS w FROM b WHERE len(words) > 0),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w, {gram} AS g
       FROM (SELECT *, unnest(range(1, len(words) - w + 2)) AS i FROM s)),
dw AS (SELECT r, i, w, {gram} AS g
       FROM (SELECT d.r, d.words, k.w, unnest(range(1, len(d.words) - k.w + 2)) AS i
             FROM d, (SELECT DISTINCT w FROM iw) AS k)),
hit AS (SELECT r, i, w, item FROM dw JOIN iw USING (g, w)),
n AS (SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(range(i, i + w)) AS p FROM hit) GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)"""


@query("op2_benchmark_decontamination", _leaks_sql())
def op2_benchmark_decontamination(spark, d):
    labels = table(spark, d, "benchmark").select(
        F.col("item_id").alias("label_id"), F.col("text").alias("address_raw")
    )
    found = decontaminate.find_leaks(requests(spark, d), labels)
    return found.select(
        F.col("address_id").alias("doc_id"), "n_words", "n_hit",
        F.size("label_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("label_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# --- SentencePiece -------------------------------------------------------------------

@query("op3_sentencepiece")
def op3_sentencepiece(spark, d):
    """Ids of every text, and the text decoded from them."""
    back = pieces.decode_requests(pieces.encode_requests(requests(spark, d)))
    return back.select(
        F.col("address_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("raw_input", 256).alias("decoded_sha256"),
    )


# --- classifiers ---------------------------------------------------------------------

def remainder(n: int):
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.encode(F.col("address_id").cast("string"), "UTF-8")) % n


def labels(spark: SparkSession, sf_dir: str, n: int, held_out: int) -> DataFrame:
    """Labels of the rows that may be learnt from."""
    rows = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "address_id")
    return rows.where(remainder(n) != held_out).select("address_id", "quality", "toxic")


def _predicted(scored: DataFrame, n: int, held_out: int, least: float) -> DataFrame:
    return scored.select(
        F.col("address_id").alias("doc_id"), (remainder(n) == held_out).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op4_toxicity")
def op4_toxicity(spark, d):
    docs = requests(spark, d)
    model = toxicity.train(docs, labels(spark, d, 3, 1))
    return _predicted(toxicity.score_requests(docs, model), 3, 1, toxicity.TOXIC_FROM)


@query("op10_quality_classifier")
def op10_quality_classifier(spark, d):
    docs = requests(spark, d)
    model = quality.train(docs, labels(spark, d, 5, 0))
    return _predicted(quality.score_requests(docs, model), 5, 0, quality.GOOD_FROM)


# --- personal data -------------------------------------------------------------------

@query("op9_personal_data")
def op9_personal_data(spark, d):
    found = pii.find_entities(requests(spark, d))
    return found.select(
        F.col("address_id").alias("doc_id"),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.span_text(pii.base_spans()), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


# --- web archives --------------------------------------------------------------------

@query("op1_warc_zip", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (
  SELECT payload_digest, max(page_id) AS head FROM p
  WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest AND payload_bytes >= 1000""")
def op1_warc_zip(spark, d):
    pages = table(spark, d, "pages")
    log = pages.select(
        F.col("page_id").alias("address_id"), F.col("url").alias("raw_input"),
        F.col("html").alias("output_json"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    kind = pages.schema["page_id"].dataType
    return warc.archive_round_trip(spark, log).select(
        F.col("address_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


# --- licences ------------------------------------------------------------------------

@query("op7_licence_scan")
def op7_licence_scan(spark, d):
    """Documents as files of their source and language; short ones that hold little but a
    licence line are the licence files of that folder.
    """
    short = (F.char_length("text") < 120) & F.col("text").rlike(licences.LICENCE_LINE)
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")),
        F.concat(F.when(short, "LICENSE-").otherwise("text-"), F.col("doc_id").cast("string")),
    )
    files = table(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content"))
    found = licences.scan_licences(files)
    number = F.regexp_extract("path", "-(-?[0-9]+)$", 1).cast("long")
    return found.select(
        number.alias("doc_id"), "path", "licence",
        F.col("inherited_from").isNotNull().alias("inherited"), "inherited_from",
    )


# --- conversations: trie and repair --------------------------------------------------

def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


BORROWED = 6  # a conversation takes fewer first turns than this from another


def _taken(column: str):
    return F.crc32(F.col(column).cast("string")) % BORROWED


def _shared_beginnings(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt as evidence: the first turns of another, then their own rest."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.row_number().over(
            W.partitionBy("conv_id").orderBy(
                F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
            )
        ).alias("pos"),
        F.col("role").alias("type"), F.col("text").alias("value"),
    )
    own = rows.where(F.col("pos") > _taken("conv_id")).select(
        F.col("conv_id").alias("address_id"), F.col("pos").alias("ev_pos"), "type", "value"
    )
    heads = turns.where(F.col("conv_id").isNotNull()).select("conv_id").distinct().select(
        F.col("conv_id").alias("address_id"),
        (F.col("conv_id") - F.col("conv_id") % 100).alias("conv_id"),
        F.explode(F.array(*[F.lit(i) for i in range(1, BORROWED)])).alias("ev_pos"),
    ).where(F.col("ev_pos") <= _taken("address_id"))
    given = rows.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < BORROWED)).withColumnRenamed("pos", "ev_pos")
    return own.unionByName(heads.join(given, ["conv_id", "ev_pos"]).select(*own.columns))


@query("op11_conversation_trie", conversation_sql.TRIE)
def op11_conversation_trie(spark, d):
    turns = _turns(spark, d)
    kind = turns.schema["conv_id"].dataType
    trie = evidence_trie.build_trie(
        _shared_beginnings(turns), turns.select(F.col("conv_id").alias("address_id"))
    )
    ends = ordered.ordered_sha256(
        trie.ends.withColumn("id", F.col("address_id").cast("string")), "name", "address_id", "id"
    )
    return trie.nodes.join(ends, "name", "left").select(
        F.col("address_id").cast(kind).alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.col("parent_address_id").cast(kind).alias("parent_conv_id"),
        F.col("n_addresses").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved_chars").alias("saved_tokens"), ordered.sha256_or_empty().alias("ends_sha256"),
    )


def _damaged(turns: DataFrame) -> DataFrame:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20).alias("kind"),
    ).where(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


@query("op12_conversation_repair", conversation_sql.REPAIR)
def op12_conversation_repair(spark, d):
    turns = _turns(spark, d)
    marked, edits, repaired = repair.repair_conversations(_damaged(turns))
    audits = ordered.ordered_text(edits, "conv_id", "step", "edit").withColumnRenamed("joined", "audit")
    lines = repaired.select("conv_id", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    bodies = ordered.ordered_sha256(lines, "conv_id", "step", "line", "\n")
    costs = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    # One row a conversation from each table; united and grouped, so a null id is a group too.
    parts = [turns.select("conv_id").distinct(), repair.count_faults(marked), costs, audits, bodies]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in (*FAULTS, "cost")]
    return whole.groupBy("conv_id").agg(
        *numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(ordered.EMPTY_SHA256)).alias("repaired_sha256"),
    )


# --- sharding ------------------------------------------------------------------------

SHARDS = 40


@query("op13_sharding")
def op13_sharding(spark, d):
    kept = sharding.shard_requests(requests(spark, d), SHARDS)
    size = F.coalesce(F.octet_length("raw_input"), F.lit(0)).cast("long") + sharding.ROW_BYTES
    return with_doc_id(kept).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("raw_input", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
