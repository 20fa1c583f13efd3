"""DuckDB SQL for the rows of the queries in queries.py; queries that SQL can't express have none."""

from __future__ import annotations

from loomwork.operators.canon import ALIASES, CANONICALS, REFERENCE_WORDS
from loomwork.operators.tags import STOP_WORDS
from loomwork.queries import NAMES, RING

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MONEY = r"[,\s$€£¥₹]"


def r3(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"


def num(x: str) -> str:
    s = f"regexp_replace({x}, '{MONEY}', '', 'g')"
    return f"CASE WHEN regexp_matches({s}, '{NUMBER}') THEN try_cast({s} AS DOUBLE) END"


PART = """p AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand END AS brand,
 CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE '$' || printf('%.2f', p_retailprice) END AS price,
 CASE WHEN p_partkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS active,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE strftime(DATE '2020-01-01' + (p_partkey % 900)::INTEGER, '%Y-%m-%d') END AS made_on,
 (p_partkey % 80) || '.5, -' || (p_partkey % 170) || '.25' AS place FROM part)"""
_COLS = ("name", "brand", "price", "active", "made_on", "place")
CELLS = PART + ", raw AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS col, p_partkey AS seq, {c} AS val FROM p" for i, c in enumerate(_COLS)) + ")"
DATES = "['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y', '%b %d, %Y', '%b %d %Y', '%d-%m-%Y', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S']"
IS_DATE = f"length(trim(val)) >= 6 AND NOT regexp_matches(trim(val), '{NUMBER}') AND try_strptime(trim(val), {DATES}) IS NOT NULL"
GEO = r"^\s*(-?[0-9]{1,3}\.[0-9]+)\s*[, ]\s*(-?[0-9]{1,3}\.[0-9]+)\s*$"
MEASURES = (
    CELLS
    + f""", s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY seq) AS rn FROM raw WHERE trim(val) <> '') WHERE rn <= 1500),
 m AS (SELECT col, count(*) AS populated, count(DISTINCT val) AS cardinality, avg(length(val)) AS avg_len,
 avg(len(list_filter(string_split_regex(trim(val), '\\s+'), lambda w: w <> ''))) AS avg_words,
 avg(CASE WHEN ({num('val')}) IS NOT NULL THEN 1 ELSE 0 END) AS numeric_share,
 avg(CASE WHEN lower(val) IN ('true', 'false', 'yes', 'no') THEN 1 ELSE 0 END) AS boolean_share,
 avg(CASE WHEN {IS_DATE} THEN 1 ELSE 0 END) AS date_share,
 avg(CASE WHEN regexp_matches(val, '{GEO}') AND try_cast(regexp_extract(val, '{GEO}', 1) AS DOUBLE) BETWEEN -90 AND 90
  AND try_cast(regexp_extract(val, '{GEO}', 2) AS DOUBLE) BETWEEN -180 AND 180 THEN 1 ELSE 0 END) AS geo_share
 FROM s GROUP BY col)"""
)
_SHARES = ("avg_len", "avg_words", "numeric_share", "boolean_share", "date_share", "geo_share")

O: dict[str, str] = {}
O["profile_columns"] = f"WITH {MEASURES} SELECT col, populated, cardinality, " + ", ".join(f"floor({c} * 10000 + 0.5) / 10000 AS {c}" for c in _SHARES) + " FROM m"
O["classify_columns"] = f"""WITH {MEASURES},
 a AS (SELECT *, cardinality / populated AS ratio, CASE WHEN geo_share >= 0.7 THEN geo_share ELSE 0 END AS geo,
  CASE WHEN cardinality <= 3 THEN boolean_share ELSE 0 END AS bool,
  CASE WHEN numeric_share < 0.5 AND avg_words <= 3 AND avg_len >= 6 THEN date_share ELSE 0 END AS dat,
  CASE WHEN avg_words >= 12 THEN least(1.0, avg_words / 25) ELSE 0 END AS txt FROM m),
 b AS (SELECT *, numeric_share < 0.5 AND txt = 0 AND geo = 0 AS stringy FROM a),
 e AS (SELECT *, CASE WHEN stringy AND cardinality <= 50 AND ratio <= 0.6 THEN 0.8 ELSE 0 END AS enu FROM b),
 k AS (SELECT col, unnest([{{'k': 'geo_point', 's': geo::DOUBLE, 'i': 0}}, {{'k': 'numeric', 's': numeric_share::DOUBLE, 'i': 1}}, {{'k': 'boolean', 's': bool::DOUBLE, 'i': 2}},
  {{'k': 'date', 's': dat::DOUBLE, 'i': 3}}, {{'k': 'free_text', 's': txt::DOUBLE, 'i': 4}}, {{'k': 'enum', 's': enu::DOUBLE, 'i': 5}},
  {{'k': 'identifier', 's': CASE WHEN stringy AND enu = 0 THEN 0.7 ELSE 0 END::DOUBLE, 'i': 6}}]) AS x FROM e),
 r AS (SELECT col, x.k AS kind, x.s AS s, row_number() OVER (PARTITION BY col ORDER BY x.s DESC, x.i) AS n FROM k)
 SELECT f.col, f.kind, {r3('f.s - g.s')} AS gap, f.s - g.s < 0.25 AS escalated FROM r f JOIN r g ON f.col = g.col AND f.n = 1 AND g.n = 2"""
O["fill_rate"] = f"WITH {CELLS} SELECT col, count(*) AS n, count(CASE WHEN trim(val) <> '' THEN 1 END) AS filled, {r3("count(CASE WHEN trim(val) <> '' THEN 1 END) / count(*)")} AS fill_rate FROM raw GROUP BY col"
O["quality_counts"] = f"""WITH {PART} SELECT count(CASE WHEN ({num('price')}) IS NOT NULL AND regexp_replace(price, '{MONEY}', '', 'g') <> price THEN 1 END) AS coerced,
 count(CASE WHEN trim(price) <> '' AND ({num('price')}) IS NULL THEN 1 END) AS quarantined FROM p"""
O["voted_types"] = f"""WITH {CELLS}, v AS (SELECT col, trim(val) AS val FROM raw WHERE trim(val) <> ''),
 m AS (SELECT col, count(*) AS n, count(DISTINCT val) AS distinct_values, avg(length(val)) AS l,
  avg(CASE WHEN lower(val) IN ('true','false','yes','no','0','1','t','f','y','n') THEN 1 ELSE 0 END) AS b,
  avg(CASE WHEN regexp_matches(val, '^[+-]?[0-9]+$') THEN 1 ELSE 0 END) AS i, avg(CASE WHEN ({num('val')}) IS NOT NULL THEN 1 ELSE 0 END) AS f,
  avg(CASE WHEN {IS_DATE} THEN 1 ELSE 0 END) AS d, avg(CASE WHEN regexp_matches(val, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 1 ELSE 0 END) AS e FROM v GROUP BY col)
 SELECT col, n, distinct_values, floor(l * 10 + 0.5) / 10 AS avg_len, CASE WHEN b >= 0.9 AND distinct_values <= 3 THEN 'boolean' WHEN i >= 0.9 THEN 'integer' WHEN f >= 0.9 THEN 'float'
  WHEN d >= 0.9 THEN 'date' WHEN e >= 0.9 THEN 'email' WHEN l >= 25 THEN 'free_text' WHEN distinct_values <= 25 AND distinct_values / n <= 0.3 THEN 'categorical' ELSE 'keyword' END AS type FROM m"""
O["type_fit"] = f"WITH {PART} SELECT p_partkey, CASE WHEN ({num('price')}) IS NOT NULL THEN price END AS price, made_on FROM p"

_names = ", ".join(f"('{f}', '{n}', '{k}')" for f, n, k in NAMES)
_aliases = ", ".join(
    f"('{c}', {i}, '{a}', {'NULL' if CANONICALS[c][1] is None else sorted(CANONICALS[c][1])})" for i, c in enumerate(CANONICALS) for a in sorted(ALIASES[c])
)
NAMED = f"""n0(file, name, kind) AS (VALUES {_names}), al(canonical, priority, alias, kinds) AS (VALUES {_aliases}),
 n1 AS (SELECT *, list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')) AS w FROM n0),
 h AS (SELECT name, kind, arg_min(canonical, priority) AS c FROM (SELECT n1.name, n1.kind, unnest(w) AS t FROM n1) x JOIN al ON al.alias = x.t
  WHERE al.kinds IS NULL OR list_contains(al.kinds, x.kind) GROUP BY name, kind),
 named AS (SELECT file, n1.name, n1.kind, kind IN ('identifier', 'numeric') AND list_has_any(w, {sorted(REFERENCE_WORDS)}) AS ref,
  CASE WHEN kind IN ('identifier', 'numeric') AND list_has_any(w, {sorted(REFERENCE_WORDS)}) THEN 'identifier'
   ELSE coalesce(c, CASE WHEN len(w) > 0 THEN array_to_string(w, '_') ELSE lower(n1.name) END) END AS canonical, c FROM n1 LEFT JOIN h USING (name, kind))"""
O["canonical_names"] = f"WITH {NAMED} SELECT name, kind, canonical, CASE WHEN ref OR c IS NOT NULL THEN 'alias' ELSE 'identity' END AS method FROM named"
O["merge_groups"] = f"WITH {NAMED} SELECT canonical, count(*)::INTEGER AS n_columns, array_to_string(list_sort(list(name)), ';') AS columns, count(*) > 1 AS unified FROM named GROUP BY canonical"
O["registry"] = f"WITH {NAMED} SELECT canonical, count(DISTINCT file) AS n_files, count(DISTINCT (file, name)) AS n_columns, count(DISTINCT file) > 1 AS unified FROM named GROUP BY canonical"

O["clean_numeric"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE printf('%.2f', o_totalprice)::DOUBLE END AS amount FROM orders"
O["clean_bool"] = "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS flag FROM orders"
O["clean_date"] = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 9 THEN 'some day' WHEN 8 THEN NULL
 WHEN 5 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END
 ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""

SLOTS = """s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN '+1-555-' || lpad((c_custkey * 7 + 1)::VARCHAR, 6, '0') END AS phone_home,
 CASE WHEN c_custkey % 2 = 0 THEN '+1-555-' || lpad((c_custkey * 7 + 1)::VARCHAR, 6, '0') WHEN c_custkey % 5 = 0 THEN '+2-555-' || lpad((c_custkey * 7 + 2)::VARCHAR, 6, '0') END AS phone_work,
 CASE WHEN c_custkey % 4 = 1 THEN '+3-555-' || lpad((c_custkey * 7 + 3)::VARCHAR, 6, '0') END AS phone_mobile,
 c_mktsegment AS interest_1, CASE WHEN c_custkey % 2 = 1 THEN 'golf' END AS interest_2,
 CASE WHEN c_custkey % 50 = 0 THEN 'N' || c_nationkey END AS country, CASE WHEN c_custkey % 50 <> 0 THEN 'N' || c_nationkey END AS cntry FROM customer)"""


def _shared(name: str, cols: str) -> str:
    f = f"list_filter([{cols}], lambda x: x IS NOT NULL)"
    return f"count(CASE WHEN len({f}) >= 2 THEN 1 END) AS {name}__shared, count(CASE WHEN len(list_distinct({f})) >= 2 THEN 1 END) AS {name}__differ"


O["cooccupancy"] = f"WITH {SLOTS} SELECT count(*) AS n, {_shared('phone', 'phone_home, phone_work, phone_mobile')}, {_shared('interests', 'interest_1, interest_2')}, {_shared('country', 'country, cntry')} FROM s"
O["consolidate_scalar"] = f"WITH {SLOTS} SELECT c_custkey, coalesce(country, cntry) AS country FROM s"
O["consolidate_positional"] = f"WITH {SLOTS} SELECT c_custkey, CASE WHEN interest_2 IS NULL OR interest_2 = interest_1 THEN interest_1 ELSE interest_1 || ';' || interest_2 END AS interests FROM s"
O["consolidate_tagged"] = f"""WITH {SLOTS} SELECT c_custkey, concat_ws(';', 'home=' || phone_home, CASE WHEN phone_work IS DISTINCT FROM phone_home THEN 'work=' || phone_work END,
 CASE WHEN phone_mobile IS DISTINCT FROM phone_home AND phone_mobile IS DISTINCT FROM phone_work THEN 'mobile=' || phone_mobile END) AS phones FROM s"""
O["split_multi"] = """SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN split_part(p_name, ' ', 1) || '/' || p_type
 ELSE split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) || '/' || p_type END AS parts FROM part"""

O["dsl_strings"] = """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, NULL::VARCHAR AS ninth,
 substring(p_name, 2, 3) AS cut, trim(p_brand, 'B#nd') AS stripped, replace(p_name, ' ', '-') AS swapped, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS masked,
 nullif(regexp_extract(p_name, '[aeiou]+'), '') AS found, regexp_replace(p_brand, '[^0-9]', '', 'g') AS numbers, length(p_name)::VARCHAR AS size,
 p_brand || '/' || p_type AS joined, 'none' AS filled, p_type AS "any", NULL::VARCHAR AS lost, p_name AS trimmed FROM part"""


def shown(x: str) -> str:
    return f"CASE WHEN ({x}) = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END"


O["dsl_numbers"] = f"""WITH t AS (SELECT o_orderkey, printf('%.2f', o_totalprice)::DOUBLE AS x, (o_orderkey % 7)::DOUBLE AS n FROM orders)
 SELECT o_orderkey, {shown('x')} AS number, {shown('floor(x + 0.5)')} AS rounded, {shown('floor(x * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE')} AS dimes, {shown('n + 10')} AS more,
 {shown('n - 2.5')} AS less, {shown('n * 2')} AS twice, CASE WHEN n = 0 THEN NULL ELSE {shown('12.0::DOUBLE / n')} END AS share, NULL::VARCHAR AS "none" FROM t"""
_t = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"
O["dsl_logic"] = f"""SELECT p_partkey, {_t("p_type = 'ECONOMY'")} AS same, {_t('p_size > 25')} AS big, {_t('p_size <= 10')} AS upto, {_t("p_name > 'm'")} AS after, {_t("contains(p_name, 'ring')")} AS has,
 {_t("p_size > 10 AND contains(p_name, 'r')")} AS "both", {_t('p_size > 45 OR p_size < 5')} AS either, {_t('NOT p_size > 25')} AS negated,
 CASE WHEN p_size >= 25 THEN 'L' || p_size ELSE 'S' END AS chosen FROM part"""

O["filter_cmp"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000"
O["filter_range"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20"
O["filter_text_numbers"] = "SELECT l_orderkey, l_linenumber, printf('%.2f', l_quantity) AS quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20"
O["filter_date"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-12-31'"
O["filter_exact"] = "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'"
O["filter_any_member"] = "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1"
_words = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
O["keyword_all_terms"] = f"SELECT doc_id FROM documents WHERE contains({_words}, 'the') AND contains({_words}, 'and') AND contains({_words}, 'thing')"
O["keyword_tf"] = """SELECT doc_id, score FROM (SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7 + (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::BIGINT AS score
 FROM documents) WHERE score > 0"""
PLACES = "g AS (SELECT n_nationkey, n_name, (n_nationkey * 7 % 140 - 70) AS a, (n_nationkey * 31 % 300 - 150) AS b FROM nation), xy AS (SELECT *, (a || '.5')::DOUBLE AS lat, (b || '.25')::DOUBLE AS lng FROM g)"
O["geo_parse_bbox"] = f"WITH {PLACES} SELECT n_nationkey, lat, lng FROM xy WHERE lat BETWEEN -40 AND 60 AND lng BETWEEN -100 AND 100"
_edges = [f"(({a[1]} > lng) <> ({b[1]} > lng) AND lat < (lng - {a[1]}) * ({b[0] - a[0]} / {b[1] - a[1]}::DOUBLE) + {a[0]})" for a, b in zip(RING, [RING[-1], *RING[:-1]]) if a[1] != b[1]]
O["geo_polygon"] = f"WITH {PLACES} SELECT n_nationkey, ({' + '.join(f'{e}::INTEGER' for e in _edges)}) % 2 = 1 AS inside FROM xy"
O["geo_points"] = f"WITH {PLACES} SELECT n_nationkey AS seq, lat, lng, n_name AS label FROM xy"
O["norm_key"] = """SELECT c_custkey AS id, replace(lower(c_name), ' ', '') || '@x.com' AS email_key, '1' || c_custkey || '55501' AS phone_key,
 trim(regexp_replace(regexp_replace(lower(c_mktsegment || ',  Inc. ' || c_name), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS company_key FROM customer"""


O["entity_merge"] = """WITH a AS (SELECT o_custkey, o_orderstatus AS v, min(o_orderkey) AS f FROM orders GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY ALL),
 x AS (SELECT o_custkey, string_agg(v, ',' ORDER BY f) AS statuses FROM a GROUP BY o_custkey), y AS (SELECT o_custkey, string_agg(v, ',' ORDER BY f) AS priorities FROM b GROUP BY o_custkey),
 n AS (SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY o_custkey) SELECT o_custkey::VARCHAR AS customer, n_rows, statuses, priorities FROM n JOIN x USING (o_custkey) JOIN y USING (o_custkey)"""
O["entity_conflicts"] = "SELECT count(CASE WHEN b > 1 THEN 1 END) AS p_brand, count(CASE WHEN t > 1 THEN 1 END) AS p_type FROM (SELECT p_name, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS t FROM part GROUP BY p_name)"
O["entity_counters"] = "SELECT count(*) AS raw_records, count(DISTINCT p_name) AS entities, count(*) - count(DISTINCT p_name) AS merged FROM part"
O["entity_sources"] = """WITH r AS (SELECT 0 AS f, s_suppkey AS k, 'n' || s_nationkey AS nation FROM supplier UNION ALL SELECT 1, c_custkey, 'N' || c_nationkey FROM customer),
 v AS (SELECT lower(nation) AS key, nation, min((f, k)) AS fst FROM r GROUP BY ALL), s AS (SELECT lower(nation) AS key, f, min(k) AS fst FROM r GROUP BY ALL),
 n AS (SELECT lower(nation) AS key, count(*) AS n_rows FROM r GROUP BY ALL), a AS (SELECT key, string_agg(nation, ',' ORDER BY fst) AS spellings FROM v GROUP BY key),
 b AS (SELECT key, string_agg(CASE f WHEN 0 THEN 'suppliers' ELSE 'customers' END, ',' ORDER BY f) AS files FROM s GROUP BY key)
 SELECT key AS nation_key, n_rows, spellings, files FROM n JOIN a USING (key) JOIN b USING (key)"""
O["tagged_merge"] = """WITH f AS (SELECT c_nationkey, c_custkey % 4 AS m, min(c_custkey) AS fst FROM customer GROUP BY ALL),
 i AS (SELECT c_nationkey, fst, CASE WHEN m < 2 THEN 'home=p' || m ELSE 'other=P' || m END AS x FROM f)
 SELECT c_nationkey::VARCHAR AS nation, string_agg(x, ';' ORDER BY fst) AS phones FROM i GROUP BY c_nationkey"""
O["exact_dup_docs"] = f"SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY {_words} HAVING count(*) > 1"
O["enrich_left"] = "SELECT c_custkey, c_nationkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"
O["enrich_fill_only"] = """SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'KNOWN' ELSE n.n_name END AS n_name, c_custkey % 2 <> 0 AND n.n_name IS NOT NULL AS gained
 FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey"""
O["enrich_chain"] = "SELECT s_suppkey, s_nationkey, n_name, n_regionkey, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"


def _key_stats(field: str, kind: str, a: str, b: str) -> str:
    """a, b: the normalised keys in customer and supplier."""
    return f"""SELECT '{field}' AS field, '{kind}' AS kind, (SELECT {r3(f"count(DISTINCT nullif({a}, '')) / count(nullif({a}, ''))")} FROM customer) AS uniqueness,
 (SELECT count(nullif({a}, '')) FROM customer) AS fill_a, (SELECT count(nullif({b}, '')) FROM supplier) AS fill_b"""


_k = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g')"
O["join_key_candidates"] = " UNION ALL ".join(
    [
        _key_stats("name", "identifier", _k("c_name"), _k("s_name")),
        _key_stats("nation", "enum", _k("c_nationkey::VARCHAR"), _k("s_nationkey::VARCHAR")),
        _key_stats("amount", "numeric", _k("floor(c_acctbal)::BIGINT::VARCHAR"), _k("floor(s_acctbal)::BIGINT::VARCHAR")),
    ]
)


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a row of the table folded over a's characters."""
    inner = (
        f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN ch = substring({b}, j, 1) THEN dp[j] + 1 ELSE greatest(dp[j + 1], acc[j]) END), [0::BIGINT])"
    )
    return f"list_last(list_reduce(string_split({a}, ''), lambda dp, ch: {inner}, list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)))"


_SORT = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_SIDES = f"""pa AS (SELECT p_partkey AS seq, p_name AS k, {_SORT.format('p_name')} AS s FROM part WHERE p_partkey % 2 = 0),
 pb0 AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE substring(p_name, 1, 2) || substring(p_name, 4, 100) END AS k FROM part WHERE p_partkey % 2 = 1),
 pb AS (SELECT seq, k, {_SORT.format('k')} AS s FROM pb0),
 ka AS (SELECT DISTINCT k, s FROM pa), kb AS (SELECT k, s, min(seq) AS b_seq FROM pb GROUP BY k, s),
 kp AS (SELECT ka.k AS ak, ka.s AS "as", kb.k AS bk, kb.s AS bs, b_seq FROM ka JOIN kb ON ka.k[1] = kb.k[1]),
 sc AS (SELECT ak, bk, b_seq, CASE WHEN ak = bk THEN 1.0::DOUBLE ELSE 2.0 * greatest({lcs('ak', 'bk')}, {lcs('"as"', 'bs')}) / (length(ak) + length(bk)) END AS sim FROM kp),
 best AS (SELECT ak, sim, b_seq FROM (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY sim DESC, b_seq) AS rn FROM sc WHERE sim >= 0.9) WHERE rn = 1),
 pairs AS (SELECT pa.seq AS a_seq, b_seq, sim FROM pa JOIN best ON best.ak = pa.k)"""
O["fuzzy_match"] = f"WITH {_SIDES} SELECT a_seq, b_seq, round(sim, 6) AS sim FROM pairs"
O["match_report"] = f"""WITH {_SIDES} SELECT (SELECT count(*) FROM pa)::INTEGER AS rows_a, (SELECT count(*) FROM pb)::INTEGER AS rows_b, (SELECT count(*) FROM pa) AS keyed_a, count(*) AS matched,
 count(CASE WHEN sim >= 1.0 THEN 1 END) AS exact, (SELECT count(*) FROM pa) - count(*) AS unmatched_a, (SELECT count(*) FROM pb) - count(DISTINCT b_seq) AS unmatched_b FROM pairs"""
O["link_clusters"] = f"""WITH RECURSIVE nm AS (SELECT p_name, min(p_partkey) AS pk FROM part GROUP BY p_name),
 rw AS (SELECT pk AS seq, 'a' AS source, p_name AS k FROM nm UNION ALL SELECT pk + 10000000, 'b', CASE WHEN pk % 3 = 0 THEN p_name ELSE substring(p_name, 1, 2) || substring(p_name, 4, 100) END FROM nm),
 ks AS (SELECT k, {_SORT.format('k')} AS s, min(seq) AS f FROM rw GROUP BY k),
 kp AS (SELECT x.k AS ak, x.s AS "as", x.f AS a, y.k AS bk, y.s AS bs, y.f AS b FROM ks x JOIN ks y ON x.k[1] = y.k[1] AND x.f < y.f),
 ed AS (SELECT a, b FROM kp WHERE 2.0 * greatest({lcs('ak', 'bk')}, {lcs('"as"', 'bs')}) / (length(ak) + length(bk)) >= 0.85),
 un AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
 reach AS (SELECT f AS node, f AS root FROM ks UNION SELECT un.b, reach.root FROM reach JOIN un ON un.a = reach.node),
 lb AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
 al AS (SELECT rw.seq, rw.source, rw.k, lb.root FROM rw JOIN ks USING (k) JOIN lb ON lb.node = ks.f),
 sz AS (SELECT root, count(*) AS size, count(DISTINCT source) AS n_sources, row_number() OVER (ORDER BY root) AS n FROM al GROUP BY root)
 SELECT seq, source, k, printf('E-%04d', n) AS entity_id, size, n_sources FROM al JOIN sz USING (root)"""

O["facet_counts"] = "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL"
O["facet_low_card"] = """WITH c AS (SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY ALL
 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*), min(c_custkey) FROM customer GROUP BY ALL UNION ALL SELECT 'c_name', c_name, count(*), min(c_custkey) FROM customer GROUP BY ALL),
 d AS (SELECT field, count(*) AS distinct_values FROM c GROUP BY field),
 r AS (SELECT c.field, value, n, row_number() OVER (PARTITION BY c.field ORDER BY n DESC, f)::INTEGER AS rank FROM c JOIN d USING (field) WHERE distinct_values <= 40)
 SELECT d.field, distinct_values, value, n, rank FROM d LEFT JOIN r USING (field)"""
O["facet_most_common"] = """WITH c AS (SELECT 'event_type' AS field, event_type AS value, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), min(event_id) FROM events GROUP BY ALL)
 SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, f)::INTEGER AS rank FROM c) WHERE rank <= 5"""
_stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
TAGS = f"""w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z][A-Za-z0-9''\\-]{{2,}}'), lambda x: trim(x, '''-')), lambda x: length(x) >= 3 AND x NOT IN ({_stop})) AS w FROM documents),
 u AS (SELECT doc_id, unnest(w) AS keyword, 1 AS n FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS keyword, 2 FROM w),
 k AS (SELECT doc_id, keyword, sum(n)::BIGINT AS weight FROM u GROUP BY ALL),
 tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, keyword)::INTEGER AS rank FROM k) WHERE rank <= 8)"""
O["doc_tags"] = f"WITH {TAGS} SELECT doc_id, keyword, weight, rank FROM tg"
O["top_tags"] = f"WITH {TAGS} SELECT keyword, n FROM (SELECT keyword, count(*) AS n, min((doc_id, rank)) AS f FROM tg GROUP BY keyword) ORDER BY n DESC, f LIMIT 40"
O["tag_filter"] = f"""WITH {TAGS}, l AS (SELECT doc_id, list(keyword ORDER BY rank) AS tags FROM tg GROUP BY doc_id),
 h AS (SELECT doc_id, tags, list_filter(tags, lambda t: contains(t, 'thing') OR contains('thing', t))[1] AS hit FROM l WHERE len(list_filter(tags, lambda t: contains(t, 'thing'))) > 0)
 SELECT doc_id, array_to_string(list_concat([hit], list_filter(tags, lambda t: t <> hit))[1:5], ';') AS tags FROM h"""
O["segment_counts"] = """SELECT 'rich' AS segment, count(*) AS n FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'builders', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT 'rich builders', count(*) FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"""
O["field_counts"] = f"WITH {SLOTS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n FROM s" for c in ("phone_home", "phone_work", "phone_mobile", "interest_2", "country"))


def _skew(field: str, tab: str) -> str:
    return f"""SELECT '{field}' AS field, count(*) AS cardinality, sum(n)::BIGINT AS populated, {r3('max(n) / sum(n)')} AS top1_share,
 {r3('CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0 END')} AS entropy,
 count(*) / sum(n) AS ratio FROM (SELECT {field}, count(*) AS n FROM {tab} GROUP BY {field})"""


O["skew_metrics"] = f"SELECT cardinality, populated, top1_share, entropy FROM ({_skew('p_brand', 'part')})"
_all = " UNION ALL ".join(_skew(f, t) for f, t in (("p_brand", "part"), ("p_name", "part"), ("c_nationkey", "customer"), ("o_orderstatus", "orders"), ("c_name", "customer")))
O["partition_verdict"] = f"""SELECT field, cardinality, populated, top1_share, entropy, floor(ratio * 10000 + 0.5) / 10000 AS distinct_ratio,
 CASE WHEN cardinality < 8 OR ratio > 0.5 THEN 'FACET_ONLY' WHEN top1_share > 0.6 THEN 'PARTITION_KEY_SKEWED' ELSE 'PARTITION_KEY' END AS verdict FROM ({_all})"""
O["page_offset"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50"
_dot = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_q = "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)"
O["vector_topk"] = f"WITH {_q} SELECT vec_id, label, {r3('s')} AS score FROM (SELECT vec_id, label, {_dot} AS s FROM embeddings e, q ORDER BY s DESC, vec_id LIMIT 10)"
O["semantic_filtered"] = f"WITH {_q} SELECT vec_id, label, {r3('s')} AS score FROM (SELECT vec_id, label, {_dot} AS s FROM embeddings e, q WHERE label = 1 ORDER BY s DESC, vec_id LIMIT 10)"
O["semantic_gated"] = f"WITH {_q}, x AS (SELECT vec_id, {_dot} AS s FROM embeddings e, q) SELECT vec_id, {r3('s')} AS score FROM x WHERE (SELECT max(s) FROM x) >= 0.15 AND s > 0.3"
O["hybrid_rrf"] = f"""WITH {_q}, a AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, {_dot} AS s FROM embeddings e, q ORDER BY s DESC, vec_id LIMIT 50)),
 b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM (SELECT vec_id FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 50)),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM u GROUP BY vec_id ORDER BY s DESC, vec_id LIMIT 10)"""
O["cosine_pairs"] = "SELECT b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0"
O["union_files"] = """SELECT 'customer' AS source, c_custkey AS row_no, c_name AS full_name, c_mktsegment AS segment, NULL::VARCHAR AS country FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_nationkey::VARCHAR FROM supplier"""
O["json_props"] = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL::DOUBLE AS nowhere FROM events"
O["precision_mrr"] = f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS v, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT q, sum(CASE WHEN hit THEN 1 ELSE 0 END) / 10.0::DOUBLE AS p, min(CASE WHEN hit THEN r END) AS f FROM s WHERE r <= 10 GROUP BY q)
 SELECT {r3('avg(p)')} AS precision_at_k, {r3('avg(coalesce(1.0::DOUBLE / f, 0))')} AS mrr FROM p"""
O["accuracy_verdicts"] = """SELECT CASE WHEN length(text) >= 1000 AND quality = 1 THEN 'correct' WHEN length(text) >= 1000 THEN 'fp' WHEN quality = 1 THEN 'miss' ELSE 'none' END AS verdict, count(*) AS n
 FROM labels JOIN documents USING (doc_id) GROUP BY ALL"""
O["conversation_merge"] = """WITH r AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL), a AS (SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM r GROUP BY conv_id),
 b AS (SELECT conv_id, string_agg(length(text)::VARCHAR, ',' ORDER BY turn, length(text)) AS sizes FROM conversations GROUP BY conv_id) SELECT conv_id, roles, sizes FROM a JOIN b USING (conv_id)"""
O["sentence_summary"] = """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
 u AS (SELECT doc_id, len(l) AS n, i, l[i] AS sentence FROM s, unnest(range(1, len(l) + 1)) t(i)),
 w AS (SELECT doc_id, n, i, word, count(*) AS c FROM (SELECT doc_id, n, i, unnest(regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}_]{2,}')) AS word FROM u) GROUP BY ALL),
 k AS (SELECT doc_id, word, count(*) AS k FROM w GROUP BY ALL),
 v AS (SELECT doc_id, i, word, c * (ln((1 + n) / (1 + k)) + 1) AS v FROM w JOIN k USING (doc_id, word)),
 x AS (SELECT doc_id, i, word, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, i)) AS x FROM v),
 t AS (SELECT doc_id, word, sum(x) AS t FROM x GROUP BY ALL),
 r AS (SELECT doc_id, i, sum(x * t) AS score FROM x JOIN t USING (doc_id, word) GROUP BY ALL),
 b AS (SELECT u.doc_id, arg_min(sentence, (-round(coalesce(score, 0), 9), u.i)) AS summary FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.i = u.i GROUP BY u.doc_id)
 SELECT doc_id, summary FROM documents LEFT JOIN b USING (doc_id)"""
O["bulk_ndjson"] = """SELECT '{"index":{"_index":"col_nation","_id":"' || n_nationkey || '"}}' || chr(10) || '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation"""
O["display_names"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'Ann Lee' ELSE 'Lee' END AS name FROM customer"
O["flagship"] = """WITH e AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS s FROM orders GROUP BY o_custkey)
 SELECT c_mktsegment, count(*) AS entities, sum(n)::BIGINT AS n_orders, count(CASE WHEN s > 1 THEN 1 END) AS disputed, count(DISTINCT n_name) AS nations
 FROM e LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment"""

ORACLE_SQL = O
