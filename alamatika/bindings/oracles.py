"""Reference SQL (DuckDB) for the registered queries.

Each oracle is a final SELECT over shared common table expressions; those a SELECT needs
are found by name. The SQL follows the semantics entity by entity and evidence by
evidence, not the way the Spark plans compute them.
"""

from __future__ import annotations

import re

ADMIN = (
    "'kabupaten','kab.','kab','kota','kecamatan','kec.','kec','kelurahan','kel.','kel',"
    "'provinsi','prov.','prov','administrasi','kepulauan'"
)
CODE = r"\b(\d{5})\b"
NULL_TS = "CAST(NULL AS TIMESTAMP)"


def letters(k: str) -> str:
    return f"translate(lpad(CAST({k} AS VARCHAR), 9, '0'), '0123456789', 'abcdefghij')"


def kept(e: str) -> str:
    split = f"regexp_split_to_array(lower(replace({e}, '\\n', ' ')), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+')"
    return f"array_to_string(list_filter({split}, lambda x: x <> '' AND x NOT IN ({ADMIN})), ' ')"


def norm_kept(k: str) -> str:
    letters_ = (
        f"trim(regexp_replace(regexp_replace({k}, '[^a-zA-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    )
    codes = f"array_to_string(regexp_extract_all({k}, '{CODE}', 1), ' ')"
    return f"concat_ws(' ', nullif({letters_}, ''), nullif({codes}, ''))"


def strip(e: str) -> str:
    out = f"regexp_replace({e}, '(?is)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '(?is)<script\\b[^>]*>.*?(</script\\s*>|\\z)', '', 'g')"
    out = f"regexp_replace({out}, '(?is)<style\\b[^>]*>.*?(</style\\s*>|\\z)', '', 'g')"
    return f"regexp_replace({out}, '(?s)<[A-Za-z/!?][^>]*>', '', 'g')"


def request_error(e: str) -> str:
    return (
        f"CASE WHEN {e} IS NULL OR {e} = '' THEN 'address is required' "
        f"WHEN strlen({e}) > 1000 THEN 'address exceeds maximum length of 1000 characters' END"
    )


def joined(items: str) -> str:
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


def postal(k: str, modulus: str) -> str:
    return f"lpad(CAST(10000 + {k} % {modulus} AS VARCHAR), 5, '0')"


_CTES: dict[str, str] = {}


def _cte(name: str, body: str) -> None:
    _CTES[name] = body


_cte("nat", f"""
SELECT n_nationkey AS n, n_regionkey AS r, {letters('n_nationkey')} AS ln,
  lpad(CAST(n_regionkey + 11 AS VARCHAR), 2, '0') AS pk,
  lpad(CAST(n_regionkey + 11 AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ck,
  lpad(CAST(n_regionkey + 11 AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_nationkey + 50 AS VARCHAR), 2, '0') AS tk
FROM nation""")
_cte("upper_regions", f"""
SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, lpad(CAST(r_regionkey + 11 AS VARCHAR), 2, '0') AS kode,
  'Prov. ' || r_name AS name, 2 AS level_id, CAST(NULL AS VARCHAR) AS postal_code, {NULL_TS} AS deleted_at
FROM region
UNION ALL SELECT n * 2 + 100, ck, 'Kota Nation ' || ln, 3, NULL,
  CASE WHEN n = 13 THEN TIMESTAMP '2025-01-01 00:00:00' END FROM nat
UNION ALL SELECT n * 2 + 101, tk, 'Kabupaten Nation ' || ln, 3, NULL, NULL FROM nat WHERE n % 5 = 0""")
_cte("lower_regions", f"""
SELECT DISTINCT CAST(c_nationkey * 100 + (ascii(c_mktsegment) - 55) + 1000 AS BIGINT) AS id,
  ck || '.' || lpad(CAST(ascii(c_mktsegment) - 55 AS VARCHAR), 2, '0') AS kode,
  'Kec. ' || c_mktsegment AS name, 4 AS level_id, CAST(NULL AS VARCHAR) AS postal_code,
  CASE WHEN (c_nationkey * 7 + ascii(c_mktsegment) - 55) % 11 = 0
       THEN TIMESTAMP '2025-01-01 00:00:00' END AS deleted_at
FROM customer JOIN nat ON c_nationkey = n
UNION ALL
SELECT c_custkey + 1000000,
  ck || '.' || lpad(CAST(ascii(c_mktsegment) - 55 AS VARCHAR), 2, '0') || '.'
     || lpad(CAST(c_custkey AS VARCHAR), 9, '0'),
  'Kel. ' || {letters('c_custkey')}, 5, {postal('c_custkey', '@MOD@')}, NULL
FROM customer JOIN nat ON c_nationkey = n""")
_cte("all_regions", """
SELECT 1 AS source_id, * FROM upper_regions UNION ALL SELECT 1, * FROM lower_regions
UNION ALL SELECT 2, id + 1000000000000, kode, name, level_id, postal_code, deleted_at FROM upper_regions""")
_cte("kept_regions", f"SELECT *, {kept('name')} AS kept_name FROM all_regions")
_cte("regions", f"""
SELECT id, CAST(source_id AS BIGINT) AS source_id, kode, name, {norm_kept('kept_name')} AS norm_name,
  level_id, postal_code, deleted_at FROM kept_regions""")
_cte("live", "SELECT * FROM regions WHERE deleted_at IS NULL")
_cte("places", """
SELECT *, r_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nat ON c_nationkey = n JOIN region ON r = r_regionkey""")
_cte("requests", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS address_id,
  CASE o_orderkey % 7
  WHEN 0 THEN 'Jl. Melati No.' || o_orderkey || ', Kel. ' || {letters('c_custkey')} || ', Kec. ' || c_mktsegment
    || ', Kota Nation ' || ln || ', Prov. ' || r_name || ' ' || {postal('c_custkey', '@MOD@')}
  WHEN 1 THEN 'Gang Mawar ' || o_orderkey || '\\nKel. ' || {letters('c_custkey')} || '\\nKec. ' || c_mktsegment
    || ' Kec. ' || c_mktsegment || '\\nKabupaten Nation ' || ln
  WHEN 2 THEN 'JL. KENANGA NO.' || o_orderkey || ' ' || upper({letters('c_custkey')}) || ', ' || c_mktsegment
    || ' ' || lpad(CAST(10007 + c_custkey % @MOD@ AS VARCHAR), 5, '0')
  WHEN 3 THEN 'Jalan Anggrek RT.005 RW.002' || chr(9) || 'Nation ' || ln || '  Kota'
  WHEN 4 THEN 'Gedung Sate Lt. 3 ' || {postal('c_custkey', '@MOD@')}
  WHEN 5 THEN CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'tanpa lokasi' END
  ELSE '<script>alert(''x'')</script><b>Kel. ' || {letters('c_custkey')} || '</b> &amp; Kec. ' || c_mktsegment
    || ', Prov. ' || r_name || ' ' || {postal('c_custkey', '@MOD@')} END AS address,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'bps' WHEN o_orderpriority = '5-LOW' THEN ''
    WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'tidak-ada' ELSE 'kemendagri' END AS source_code
FROM places""")
_cte("registry", "SELECT * FROM (VALUES ('kemendagri', 1, '2025'), ('bps', 2, '2024')) t(code, sid, version)")
_cte("routed", f"""
SELECT address_id, address, coalesce(nullif(source_code, ''), 'kemendagri') AS source_code,
  CAST(sid AS BIGINT) AS source_id, version AS source_version,
  coalesce({request_error('address')}, CASE WHEN sid IS NULL THEN 'unknown location source' END) AS reject_reason
FROM requests LEFT JOIN registry ON code = coalesce(nullif(source_code, ''), 'kemendagri')""")
_cte("clean", f"SELECT *, {strip('address')} AS stripped FROM routed WHERE reject_reason IS NULL")
_cte("kept_text", f"SELECT *, {kept('stripped')} AS k FROM clean")
_cte("addresses", f"""
SELECT address_id, address AS raw_input, source_code, source_id, source_version,
  {norm_kept('k')} AS normalized FROM kept_text""")
_cte("words", """
SELECT address_id, source_id, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS w
FROM addresses""")
_cte("dict", """
SELECT source_id, norm_name AS phrase, id AS entity_id, level_id,
  CASE level_id WHEN 2 THEN 'PROVINCE' WHEN 3 THEN 'CITY' WHEN 4 THEN 'DISTRICT' ELSE 'SUBDISTRICT' END AS level,
  kode, name, coalesce(postal_code, '') AS postal_code
FROM live WHERE level_id BETWEEN 2 AND 5 AND norm_name <> ''""")
_cte("grams", """
SELECT address_id, source_id, s.i AS start, e.j AS fin, array_to_string(w[s.i + 1 : e.j], ' ') AS phrase
FROM words, unnest(range(len(w))) AS s(i),
  unnest(range(s.i + 1, least(s.i + (SELECT max(len(string_split(phrase, ' '))) FROM dict), len(w)) + 1)) AS e(j)""")
_cte("hits", """
SELECT g.* FROM grams g
WHERE EXISTS (SELECT 1 FROM dict d WHERE d.source_id = g.source_id AND d.phrase = g.phrase)""")
_cte("longest", """
SELECT address_id, source_id, start, max(fin) AS fin, arg_max(phrase, fin) AS phrase
FROM hits GROUP BY ALL""")
_cte("walk", """
SELECT address_id, source_id, start, fin, phrase FROM (
  SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY start) AS rn FROM longest) WHERE rn = 1
UNION ALL
SELECT address_id, source_id, start, fin, phrase FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.address_id ORDER BY l.start) AS rn
  FROM walk w JOIN longest l ON l.address_id = w.address_id AND l.start >= w.fin) WHERE rn = 1""")
_cte("word_ent", """
SELECT DISTINCT address_id, s.source_id, s.phrase, unnest(string_split(s.phrase, ' ')) AS word,
  entity_id, level, kode, name, postal_code
FROM walk s JOIN dict d ON d.source_id = s.source_id AND d.phrase = s.phrase""")
_cte("raw_words", """
SELECT address_id, source_id, unnest(w) AS value, generate_subscripts(w, 1) AS word_no FROM words""")
_cte("evidence", f"""
SELECT address_id, source_id, row_number() OVER (PARTITION BY address_id ORDER BY word_no) - 1 AS ev_pos, type, value
FROM (
  SELECT address_id, source_id, 0 AS word_no, 'postal_code' AS type, regexp_extract(normalized, '{CODE}', 1) AS value
  FROM addresses WHERE regexp_matches(normalized, '{CODE}')
  UNION ALL
  SELECT address_id, source_id, min(word_no), 'place_name', value FROM raw_words
  WHERE value NOT IN ('jl', 'jalan', 'gg', 'gang') AND NOT regexp_matches(value, '{CODE}')
  GROUP BY address_id, source_id, value)""")
_cte("res_postal", """
SELECT e.*, d.entity_id, d.level, d.kode, d.name, d.postal_code FROM evidence e JOIN dict d
ON d.source_id = e.source_id AND d.level = 'SUBDISTRICT' AND d.postal_code = e.value
WHERE e.type = 'postal_code'""")
_cte("res_place", """
SELECT DISTINCT e.*, w.entity_id, w.level, w.kode, w.name, w.postal_code FROM evidence e
JOIN word_ent w ON w.address_id = e.address_id AND w.word = e.value WHERE e.type = 'place_name'""")
_cte("resolved", "SELECT * FROM res_postal UNION ALL SELECT * FROM res_place")
_cte("roots", """
SELECT DISTINCT address_id, source_id, entity_id, level, kode, name, postal_code FROM res_place""")
_cte("hierarchy", """
SELECT s.source_id, p.id AS province_id, c.id AS city_id, d.id AS district_id, s.id AS subdistrict_id
FROM live s
JOIN live p ON p.source_id = s.source_id AND p.kode = split_part(s.kode, '.', 1) AND p.level_id IN (2, 3, 4)
JOIN live c ON c.source_id = s.source_id AND c.level_id IN (2, 3, 4)
  AND c.kode = split_part(s.kode, '.', 1) || '.' || split_part(s.kode, '.', 2)
JOIN live d ON d.source_id = s.source_id AND d.level_id IN (2, 3, 4)
  AND d.kode = split_part(s.kode, '.', 1) || '.' || split_part(s.kode, '.', 2) || '.' || split_part(s.kode, '.', 3)
WHERE s.level_id = 5 AND len(string_split(s.kode, '.')) = 4""")
_cte("up_city", "SELECT city_id, max(province_id) AS province_id FROM hierarchy GROUP BY city_id")
_cte("up_district", "SELECT district_id, max(city_id) AS city_id FROM hierarchy GROUP BY district_id")
_cte("up_sub", "SELECT subdistrict_id, max(district_id) AS district_id FROM hierarchy GROUP BY subdistrict_id")
_cte("cand", """
SELECT r.address_id, sha256(r.address_id || ':' || r.entity_id) AS cand_id, r.source_id, r.entity_id, r.level, r.kode,
  CASE WHEN level = 'SUBDISTRICT' THEN r.entity_id END AS s_id,
  CASE WHEN level = 'DISTRICT' THEN r.entity_id ELSE us.district_id END AS d_id,
  CASE WHEN level = 'CITY' THEN r.entity_id ELSE ud.city_id END AS c_id,
  CASE WHEN level = 'PROVINCE' THEN r.entity_id ELSE uc.province_id END AS p_id,
  CASE WHEN level = 'SUBDISTRICT' THEN nullif(r.postal_code, '') END AS code
FROM roots r
LEFT JOIN up_sub us ON level = 'SUBDISTRICT' AND us.subdistrict_id = r.entity_id
LEFT JOIN up_district ud ON ud.district_id = CASE WHEN level = 'DISTRICT' THEN r.entity_id ELSE us.district_id END
LEFT JOIN up_city uc ON uc.city_id = CASE WHEN level = 'CITY' THEN r.entity_id ELSE ud.city_id END""")
_cte("links", """
SELECT address_id, cand_id, 'PROVINCE' AS level, p_id AS entity_id FROM cand WHERE p_id IS NOT NULL
UNION ALL SELECT address_id, cand_id, 'CITY', c_id FROM cand WHERE c_id IS NOT NULL
UNION ALL SELECT address_id, cand_id, 'DISTRICT', d_id FROM cand WHERE d_id IS NOT NULL
UNION ALL SELECT address_id, cand_id, 'SUBDISTRICT', s_id FROM cand WHERE s_id IS NOT NULL""")
_cte("matched", """
SELECT l.address_id, l.cand_id, l.level, l.entity_id, r.ev_pos, r.type, r.value, r.name
FROM links l JOIN resolved r ON r.address_id = l.address_id AND r.entity_id = l.entity_id AND r.level = l.level""")
_cte("per_entity", """
SELECT address_id, cand_id, level, count(*) AS n, max(CASE WHEN type = 'postal_code' THEN value END) AS pv
FROM matched GROUP BY ALL""")
_cte("facts", """
SELECT address_id, cand_id, bool_or(level = 'PROVINCE') AS mp, bool_or(level = 'CITY') AS mc,
  bool_or(level = 'DISTRICT') AS md, bool_or(level = 'SUBDISTRICT') AS ms, max(pv) AS pv,
  least(CAST(0.4 AS DOUBLE), sum(CASE WHEN n < 2 THEN CAST(0 AS DOUBLE) WHEN level = 'PROVINCE' THEN CAST(0.2 AS DOUBLE)
    WHEN level = 'CITY' THEN CAST(0.15 AS DOUBLE) WHEN level = 'DISTRICT' THEN CAST(0.1 AS DOUBLE)
    ELSE CAST(0.05 AS DOUBLE) END)) AS bonus
FROM per_entity GROUP BY ALL""")
_cte("scored", """
SELECT c.*, mp, mc, md, ms, pv, bonus,
  round(least(CAST(1 AS DOUBLE), CAST(0.1 AS DOUBLE)
    + CASE WHEN c_id IS NOT NULL THEN CAST(0.15 AS DOUBLE) ELSE 0 END
    + CASE WHEN code IS NOT NULL THEN CAST(0.05 AS DOUBLE) ELSE 0 END
    + CASE WHEN code = pv THEN CAST(0.2 AS DOUBLE) ELSE 0 END
    + CASE WHEN mp THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN mc THEN CAST(0.12 AS DOUBLE) ELSE 0 END
    + CASE WHEN md THEN CAST(0.08 AS DOUBLE) ELSE 0 END + CASE WHEN ms THEN CAST(0.05 AS DOUBLE) ELSE 0 END
    + round(bonus * 10000) / 10000) * 10000) / 10000 AS confidence,
  CAST(p_id IS NOT NULL AS INT) + CAST(c_id IS NOT NULL AS INT) + CAST(d_id IS NOT NULL AS INT)
    + CAST(s_id IS NOT NULL AS INT) AS levels
FROM cand c JOIN facts USING (address_id, cand_id)""")
_cte("judged", f"""
SELECT *,
  CASE WHEN levels > 1 AND c_id IS NOT NULL AND p_id IS NULL THEN 'orphan_city:city resolved without province' ELSE '' END AS conflicts,
  CASE WHEN levels > 1 AND c_id IS NOT NULL AND p_id IS NULL THEN 'CONFLICT'
    WHEN p_id IS NULL OR c_id IS NULL OR d_id IS NULL THEN 'INCOMPLETE' ELSE 'VALID' END AS status,
  {joined("CASE WHEN p_id IS NOT NULL THEN 'province' END, CASE WHEN c_id IS NOT NULL THEN 'city' END, CASE WHEN d_id IS NOT NULL THEN 'district' END, CASE WHEN s_id IS NOT NULL THEN 'sub_district' END, CASE WHEN code IS NOT NULL THEN 'postal_code' END")} AS matched,
  {joined("CASE WHEN p_id IS NULL THEN 'province' END, CASE WHEN c_id IS NULL THEN 'city' END, CASE WHEN d_id IS NULL THEN 'district' END, CASE WHEN s_id IS NULL THEN 'sub_district' END")} AS missing,
  {joined("'exact_match', CASE WHEN mp THEN 'match_province' END, CASE WHEN mc THEN 'match_city' END, CASE WHEN md THEN 'match_district' END, CASE WHEN ms THEN 'match_subdistrict' END, CASE WHEN code = pv THEN 'match_postal_code_exact' END")} AS reasons
FROM scored""")
_cte("unused", """
SELECT c.address_id, c.cand_id, coalesce(string_agg(e.value, ',' ORDER BY e.ev_pos), '') AS unused
FROM cand c LEFT JOIN (
  SELECT e.address_id, x.cand_id, e.ev_pos, e.value FROM evidence e JOIN cand x USING (address_id)
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.address_id = e.address_id AND m.cand_id = x.cand_id AND m.value = e.value)
) e ON e.address_id = c.address_id AND e.cand_id = c.cand_id GROUP BY ALL""")
_cte("ranked", """
SELECT j.*, row_number() OVER w AS rank, lead(confidence) OVER w AS next_confidence
FROM judged j
WINDOW w AS (PARTITION BY address_id ORDER BY confidence DESC, levels DESC, CAST(conflicts <> '' AS INT), kode, cand_id)""")
_cte("named", """
SELECT r.*, coalesce(p.name, '') AS pn, coalesce(c.name, '') AS cn, coalesce(d.name, '') AS dn, coalesce(s.name, '') AS sn,
  coalesce(code, '') AS pc
FROM ranked r LEFT JOIN live p ON p.id = p_id LEFT JOIN live c ON c.id = c_id
LEFT JOIN live d ON d.id = d_id LEFT JOIN live s ON s.id = s_id""")
_cte("rev", """
SELECT x.source_id, x.postal_code, x.kode, x.name AS sub_district,
  CASE WHEN len(string_split(x.kode, '.')) = 4 THEN coalesce(d.name, '') ELSE '' END AS district,
  CASE WHEN len(string_split(x.kode, '.')) IN (3, 4) THEN coalesce(c.name, '') ELSE '' END AS city,
  CASE WHEN len(string_split(x.kode, '.')) IN (2, 3, 4) THEN coalesce(p.name, '') ELSE '' END AS province
FROM live x
LEFT JOIN live d ON d.source_id = x.source_id AND d.kode = array_to_string(string_split(x.kode, '.')[1:3], '.')
LEFT JOIN live c ON c.source_id = x.source_id AND c.kode = array_to_string(string_split(x.kode, '.')[1:2], '.')
LEFT JOIN live p ON p.source_id = x.source_id AND p.kode = split_part(x.kode, '.', 1)
WHERE coalesce(x.postal_code, '') <> ''""")
_cte("guess_groups", """
SELECT source_id, postal_code, district, count(*) AS n, min(kode) AS kode FROM rev GROUP BY ALL""")
_cte("guesses", """
SELECT r.* FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, postal_code ORDER BY n DESC, district) AS rn FROM guess_groups) g
JOIN rev r ON r.source_id = g.source_id AND r.postal_code = g.postal_code AND r.kode = g.kode WHERE rn = 1""")
_cte("postal_in", f"SELECT *, regexp_extract(normalized, '{CODE}', 1) AS input_code FROM addresses")


def fmt(s: str, d: str, c: str, p: str, z: str) -> str:
    return (
        f"concat_ws(', ', nullif({s}, ''), nullif({d}, ''), nullif({c}, ''), nullif({p}, ''))"
        f" || CASE WHEN {z} <> '' THEN ' ' || {z} ELSE '' END"
    )


_cte("winner", "SELECT * FROM named WHERE rank = 1")
_cte("picked", """
SELECT a.*, w.cand_id, w.kode AS w_kode,
  CASE WHEN w.cand_id IS NULL THEN 'UNKNOWN'
    WHEN w.status = 'VALID' AND abs(w.confidence - w.next_confidence) < CAST(0.1 AS DOUBLE) THEN 'AMBIGUOUS'
    ELSE w.status END AS status,
  coalesce(w.confidence, CAST(0 AS DOUBLE)) AS confidence,
  coalesce(w.cand_id IS NOT NULL AND input_code <> '' AND w.pc = '' AND w.sn = '', FALSE) AS looked_up,
  w.cand_id IS NULL AND g.kode IS NOT NULL AS inferred,
  CASE WHEN w.cand_id IS NULL THEN coalesce(g.postal_code, '')
    WHEN input_code <> '' AND w.pc = '' AND w.sn = '' THEN input_code ELSE w.pc END AS postal_code,
  coalesce(w.sn, g.sub_district, '') AS sub_district, coalesce(w.dn, g.district, '') AS district,
  coalesce(w.cn, g.city, '') AS city, coalesce(w.pn, g.province, '') AS province,
  coalesce(w.matched, '') AS matched, coalesce(w.missing, '') AS missing, w.conflicts, coalesce(w.reasons, '') AS reasons
FROM postal_in a LEFT JOIN winner w ON w.address_id = a.address_id
LEFT JOIN guesses g ON w.cand_id IS NULL AND g.source_id = a.source_id AND g.postal_code = input_code""")
_cte("listed", f"""
SELECT n.address_id, count(*) AS candidate_count,
  string_agg(n.cand_id || '|' || n.confidence || '|' || {fmt('n.sn', 'n.dn', 'n.cn', 'n.pn', 'n.pc')} || '|'
    || n.reasons || CASE WHEN n.rank = 1 AND p.looked_up THEN ',postal_code_lookup' ELSE '' END,
    ';' ORDER BY n.rank) AS candidates
FROM named n JOIN picked p ON p.address_id = n.address_id WHERE n.p_id IS NOT NULL GROUP BY n.address_id""")
_cte("answers", f"""
SELECT p.address_id, p.status, p.confidence, p.raw_input, p.normalized AS normalized_input,
  {fmt('p.sub_district', 'p.district', 'p.city', 'p.province', 'p.postal_code')} AS formatted_address,
  p.postal_code, p.sub_district, p.district, p.city, p.province, p.matched, p.missing, p.conflicts,
  coalesce(u.unused, '') AS ambiguous,
  CASE WHEN p.looked_up THEN p.reasons || ',postal_code_lookup' WHEN p.inferred THEN 'postal_code_inferred'
    ELSE p.reasons END AS strategy,
  CAST(coalesce(l.candidate_count, 0) AS BIGINT) AS candidate_count, coalesce(l.candidates, '') AS candidates,
  p.source_code AS location_source, p.source_version AS location_version
FROM picked p LEFT JOIN unused u ON u.address_id = p.address_id AND u.cand_id = p.cand_id
LEFT JOIN listed l ON l.address_id = p.address_id""")


def sql(final: str, modulus: int = 3000, extra: dict[str, str] | None = None) -> str:
    """A statement with the common table expressions ``final`` needs, in order."""
    known = {**_CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(final)
    ctes = ",\n".join(f"{n} AS ({b})" for n, b in known.items() if n in needed)
    text = f"WITH RECURSIVE {ctes}\n{final}" if ctes else final
    return text.replace("@MOD@", str(modulus))
