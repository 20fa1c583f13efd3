"""More of the catalogue: queries that go through files, datasets and collections, each beside the SQL for its rows."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import columns, filters
from loomwork.operators import canon, extract, facets, match, profile, shapes, tags, vectors
from loomwork.oracles import SLOTS, TAGS, O, r3
from loomwork.plans import linkage
from loomwork.plans.collection import Collection
from loomwork.plans.dataset import Dataset
from loomwork.queries import INTERESTS, PHONES, _customer_shapes, _parts_as_text, _perturbed, _slots, table
from loomwork.sources import files, sinks
from loomwork.sources.files import ROW
from loomwork.sources.folders import new_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with SQL for its rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def values(rows, names: str) -> str:
    """SQL for fixed rows."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


# ---- sources


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, c_name || ', \"' || c_custkey || '\"' AS quoted FROM customer")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file with a delimiter that is sniffed, quoted cells that hold it, and blank cells."""
    c = table(spark, d, "customer")
    blank = F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("segment")
    quoted = F.concat("c_name", F.lit(', "'), F.col("c_custkey").cast("string"), F.lit('"')).alias("quoted")
    path = new_folder(spark, "csv")
    c.select("c_custkey", "c_name", blank, quoted).coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return files.read_csv(spark, path).drop(ROW)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def csv_lines(spark, d):
    """The same without line feeds in cells, so that large files are split."""
    path = new_folder(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).option("sep", "\t").csv(path)
    return files.read_csv(spark, path, multi_line=False).drop(ROW)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, NULL::VARCHAR AS missing FROM nation")
def json_rows(spark, d):
    path = new_folder(spark, "json")
    sinks.export(table(spark, d, "nation"), path)
    return files.read_json(spark, path, "n_nationkey long, n_name string, missing string").drop(ROW)


@query("SELECT * FROM nation")
def exported_csv(spark, d):
    path = new_folder(spark, "export")
    n = table(spark, d, "nation")
    sinks.export(n, path, "csv")
    return spark.read.schema(n.schema).option("header", True).csv(path)


@query("SELECT r_name, NULL::VARCHAR AS blank FROM region")
def rows_at_hand(spark, d):
    rows = [{"r_name": r["r_name"], "blank": " ", "other": "x"} for r in table(spark, d, "region").collect()]  # five rows
    return files.from_rows(spark, ["r_name", "blank"], rows).drop(ROW)


@query("SELECT folder || lower(replace(r_name, ' ', '_')) || '.csv' AS name FROM region, (VALUES (''), ('samples/'), ('collections/')) f(folder)")
def sample_catalogue(spark, d):
    """CSV files under a root and its known folders; others are left out. The root is a folder of the driver."""
    import tempfile

    with tempfile.TemporaryDirectory() as root:
        for folder in (".", "samples", "collections", "elsewhere"):
            (Path(root) / folder).mkdir(exist_ok=True)
            for r in table(spark, d, "region").collect():
                (Path(root) / folder / f"{r['r_name'].lower().replace(' ', '_')}.csv").touch()
            (Path(root) / folder / "notes.txt").touch()
        return spark.createDataFrame([(x,) for x in files.samples(root)], "name string")


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS allowed FROM nation")
def confined_paths(spark, d):
    """A file inside the root, one outside, and one that is not there."""
    import tempfile

    out = []
    with tempfile.TemporaryDirectory() as top:
        root = Path(top) / "root"
        root.mkdir()
        for r in table(spark, d, "nation").collect():
            name = f"{r['n_name']}.csv"
            (root / name).touch()
            (Path(top) / name).touch()
            asked = [name, f"../{name}", f"x{name}"][r["n_nationkey"] % 3]
            try:
                files.confined(str(root), asked)
                out.append((r["n_nationkey"], True))
            except ValueError:
                out.append((r["n_nationkey"], False))
    return spark.createDataFrame(out, "n_nationkey int, allowed boolean")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5000")
def first_rows(spark, d):
    return files.first_rows(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey")


@query("SELECT greatest(least(50, count(*)), round(count(*) * 0.05))::BIGINT AS n, true AS all_known FROM orders")
def random_sample(spark, d):
    """The size of a uniform sample, and that its rows are different rows of the table."""
    orders = table(spark, d, "orders")
    own = files.random_rows(orders).select("o_orderkey")
    known = own.join(orders.select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left")
    return known.agg(F.count("*").alias("n"), ((F.count("k") == F.count("*")) & (F.count_distinct("k") == F.count("*"))).alias("all_known"))


# ---- profiles and names

_KINDS = f"SELECT kind, count(*) AS n FROM ({O['classify_columns']}) GROUP BY kind"


def _part_dataset(spark, d) -> Dataset:
    df = _parts_as_text(spark, d).withColumnRenamed("p_partkey", ROW)
    return Dataset.load(df)


@query(_KINDS)
def kind_counts(spark, d):
    return spark.createDataFrame(list(_part_dataset(spark, d).kind_counts().items()), "kind string, n long")


@query(values([("Unnamed: 0", "numeric", False, "row index"), ("total", "numeric", True, ""), ("none", "empty", False, "no values")], "name, kind, searchable, note"))
def row_index_rule(spark, d):
    """A running number without a name is a row index and no field."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_orderkey").cast("string").alias("Unnamed: 0"), F.format_string("%.2f", "o_totalprice").alias("total"), F.lit(" ").alias("none"))
    return spark.createDataFrame([(p.name, p.kind, p.searchable, p.note) for p in profile.profile(o, [ROW])], "name string, kind string, searchable boolean, note string")


@query(values([("p_brand", "maker", "override"), ("p_name", "full_name", "alias"), ("p_size", "p_size", "identity"), ("p_type", "p_type", "identity")], "name, canonical, method"))
def overridden_names(spark, d):
    """Names fixed by a user come first; one that is taken back counts no more."""
    own = canon.Mapping()
    own.override("p_brand", own.add("Maker!", "keyword"))
    own.override("p_type", "kind")
    own.override("p_type", None)
    own.override("p_size", own.add("size_class", "long"))
    own.remove("size_class")
    kinds = {"p_brand": "enum", "p_name": "identifier", "p_size": "numeric", "p_type": "enum"}
    return spark.createDataFrame([(c, *own.resolve(c, k)) for c, k in kinds.items()], "name string, canonical string, method string")


@query(values([("Maker", "keyword", False), ("Tags Seen", "text", True), ("Odd", "keyword", False)], "name, type, multiple"))
def custom_fields(spark, d):
    own = canon.Mapping()
    asked = [("Maker", "keyword", False), ("Tags Seen", "text", True), ("Odd", "nothing", False)]
    rows = [(name, *own.custom[own.add(name, kind, many)]) for name, kind, many in asked]
    return spark.createDataFrame(rows, "name string, type string, multiple boolean")


def letters(texts):
    """An embedder for tests that SQL can follow: unit vectors of the counts of a to z."""
    out = []
    for t in texts:
        v = [float(t.lower().count(chr(97 + k))) for k in range(26)]
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


_ASKED = [("emial", "identifier"), ("contry", "enum"), ("compnay", "enum"), ("zzq", "enum"), ("ratting", "numeric"), ("descrption", "free_text")]
_LETTERS = "list_transform(range(0, 26), lambda k: (length({0}) - length(replace({0}, chr((97 + k)::INTEGER), '')))::DOUBLE)"
_phrases = [(c, i, p, sorted(canon.CANONICALS[c][1]) if canon.CANONICALS[c][1] else None) for i, c in enumerate(canon.CANONICALS) for p in [c.replace("_", " "), *sorted(a for a in canon.ALIASES[c] if len(a) >= canon.ALIAS_LENGTH)]]
_SEMANTIC = f"""WITH q(name, kind) AS (VALUES {', '.join(f"('{n}', '{k}')" for n, k in _ASKED)}),
 p(canonical, priority, phrase, kinds) AS (VALUES {', '.join(f"('{c}', {i}, '{p}', {'NULL' if k is None else k})" for c, i, p, k in _phrases)}),
 v AS (SELECT name, kind, {_LETTERS.format('name')} AS x FROM q), w AS (SELECT canonical, priority, kinds, {_LETTERS.format('phrase')} AS y FROM p),
 s AS (SELECT name, kind, canonical, priority, max(list_dot_product(x, y) / greatest(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 1e-300)) AS score
  FROM v, w WHERE kinds IS NULL OR list_contains(kinds, kind) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, priority) AS rank FROM s)"""


@query(_SEMANTIC + " SELECT name, rank::INTEGER AS rank, canonical, round(score, 6) AS score FROM r WHERE rank <= 3")
def semantic_ranks(spark, d):
    """The closest canonical fields of names that no alias fits, by an embedder."""
    rows = [(n, r, c, round(s, 6)) for n, k in _ASKED for r, (c, s) in enumerate(sorted(canon.ranked(n, k, letters), key=lambda x: -round(x[1], 9))[:3], 1)]
    return spark.createDataFrame(rows, "name string, rank int, canonical string, score double")


@query(
    _SEMANTIC
    + """ SELECT a.name, CASE WHEN a.score >= 0.5 AND a.score - b.score >= 0.05 THEN a.canonical ELSE a.name END AS canonical,
 CASE WHEN a.score >= 0.5 AND a.score - b.score >= 0.05 THEN 'semantic' ELSE 'identity' END AS method FROM r a JOIN r b ON a.name = b.name AND a.rank = 1 AND b.rank = 2"""
)
def semantic_names(spark, d):
    return spark.createDataFrame([(n, *canon.canonical(n, k, letters)) for n, k in _ASKED], "name string, canonical string, method string")


# ---- shapes


@query(f"WITH {SLOTS} SELECT c_custkey, coalesce(phone_home, phone_work, phone_mobile) AS phone, interest_1 AS interests, coalesce(country, cntry) AS country FROM s")
def scalar_documents(spark, d):
    """The first value of each field's columns."""
    own = shapes.plan(_slots(spark, d), [(c, "identifier", f"{c}_") for c in PHONES])
    groups = {"phone": PHONES, "interests": INTERESTS, "country": ["country", "cntry"]}
    single = [shapes.Shape(c, "scalar", "single", own[0].kind, tuple(names), (None,) * len(names)) for c, names in groups.items()]
    return shapes.consolidated(_slots(spark, d), single, ["c_custkey"])


def _slot_rule(canonical: str, style: str, kind: str, names: list[str], stem: bool) -> str:
    """SQL of the rule by which columns become one field: lists where slots are filled together and differ."""
    held = f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)"
    both, differ = f"count(CASE WHEN len({held}) >= 2 THEN 1 END)", f"count(CASE WHEN len(list_distinct({held})) >= 2 THEN 1 END)"
    array = f"{both} / count(*) >= 0.02 AND {differ} / greatest({both}, 1) >= 0.5 AND ({stem} OR {both} / count(*) >= 0.5)"
    return f"SELECT '{canonical}' AS canonical, CASE WHEN {array} THEN 'array' ELSE 'scalar' END AS cardinality, '{style}' AS style, '{kind}' AS kind, '{';'.join(names)}' AS sources, {r3(f'{both} / count(*)')} AS shared FROM s"


@query(f"WITH {SLOTS} {_slot_rule('phone', 'semantic', 'identifier', PHONES, True)} UNION ALL {_slot_rule('interests', 'positional', 'enum', INTERESTS, True)} "
       f"UNION ALL {_slot_rule('country', 'semantic', 'enum', ['country', 'cntry'], True)}")  # fmt: skip
def shape_plan(spark, d):
    rows = [(s.canonical, s.cardinality, s.style, s.kind, ";".join(s.sources), round(s.shared, 3)) for s in _customer_shapes(spark, d)]
    return spark.createDataFrame(rows, "canonical string, cardinality string, style string, kind string, sources string, shared double")


def _contact_shapes(spark, d):
    """The customers' shapes where home and work numbers differ, so that phones are a list with labels."""
    df = _slots(spark, d).withColumn("phone_work", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+9-"), F.col("c_custkey").cast("string"))))
    return shapes.plan(df, [*[(c, "identifier", "phone") for c in PHONES], *[(c, "enum", "interests") for c in INTERESTS], ("country", "enum", "country"), ("cntry", "enum", "country")])


@query(values([("phone", '{"properties": {"type": {"type": "keyword"}, "value": {"type": "keyword"}}}'), ("interests", '{"type": "keyword"}'), ("country", '{"type": "keyword"}')], "field, mapping"))
def flat_mapping(spark, d):
    found = sinks.mapping(_contact_shapes(spark, d))["mappings"]["properties"]
    return spark.createDataFrame([(c, json.dumps(m)) for c, m in found.items()], "field string, mapping string")


_TAGGED = '{"type": "nested", "properties": {"type": {"type": "keyword"}, "value": {"type": "keyword"}}}'


@query(values([("phone", _TAGGED), ("interests", _TAGGED), ("country", '{"type": "keyword"}'), ("_source_file", '{"type": "keyword"}'), ("_tags", '{"type": "keyword"}'),
               ("v", '{"type": "knn_vector", "dimension": 8, "method": {"name": "hnsw", "engine": "lucene", "space_type": "cosinesimil"}}')], "field, mapping"))
def collection_mapping(spark, d):
    own = {s.canonical: (s.os_type, s.cardinality) for s in _contact_shapes(spark, d)}
    found = sinks.collection_mapping(own)["mappings"]["properties"] | sinks.vector_mapping("v", 8)
    return spark.createDataFrame([(c, json.dumps(m)) for c, m in found.items()], "field string, mapping string")


_FIELD = '{"type": "string"}'
_OBJECT = '{"type": "object", "properties": {"type": {"type": "string"}, "value": {"type": "string"}}}'


@query(values([("phone", f'{{"type": "array", "items": {_OBJECT}}}'), ("interests", f'{{"type": "array", "items": {_FIELD}}}'), ("country", _FIELD),
               ("other", '{"type": "number"}'), ("day", '{"type": "string", "format": "date"}'), ("n", '{"type": "integer"}'), ("yes", '{"type": "boolean"}'),
               ("v", '{"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 4, "description": "4-dim embedding vector"}')], "field, schema"))
def json_schema(spark, d):
    """JSON Schema of the customers' mapping and a field of each other type."""
    own = _contact_shapes(spark, d)
    found = sinks.mapping(own)
    found["mappings"]["properties"] |= {"other": {"type": "double"}, "day": {"type": "date"}, "n": {"type": "long"}, "yes": {"type": "boolean"}, **sinks.vector_mapping("v", 4)}
    whole = sinks.json_schema(found, frozenset(s.canonical for s in own if s.cardinality == "array"), "customer")
    assert whole["type"] == "object" and whole["title"] == "customer" and whole["additionalProperties"] is False
    return spark.createDataFrame([(c, json.dumps(s)) for c, s in whole["properties"].items()], "field string, schema string")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'note ' || doc_id ELSE text END AS description FROM documents")
def text_merge(spark, d):
    """Two columns of free text are one text field: the first that is filled."""
    df = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("note "), F.col("doc_id").cast("string"))).alias("notes_1"), F.col("text").alias("notes_2"))
    own = shapes.plan(df, [("notes_1", "free_text", "description"), ("notes_2", "free_text", "description")])
    return shapes.consolidated(df, own, ["doc_id"])


@query(values([("free_text,free_text", "free_text"), ("free_text,enum,identifier", "enum"), ("numeric", "numeric"), ("identifier,free_text", "identifier")], "kinds, kind"))
def group_kinds(spark, d):
    asked = ["free_text,free_text", "free_text,enum,identifier", "numeric", "identifier,free_text"]
    return spark.createDataFrame([(x, shapes.group_kind(x.split(","))) for x in asked], "kinds string, kind string")


@query(f"WITH {SLOTS} SELECT c_custkey, concat_ws(' ', interest_1, CASE WHEN interest_2 IS DISTINCT FROM interest_1 THEN interest_2 END) AS interests, coalesce(phone_home, '') AS phone FROM s")
def flat_text(spark, d):
    own = shapes.positional([F.col(c) for c in INTERESTS], "enum")
    return _slots(spark, d).select("c_custkey", columns.as_text(own, True).alias("interests"), columns.as_text(F.col("phone_home")).alias("phone"))


@query(f"WITH {SLOTS}, m AS (SELECT interest_1 AS value FROM s UNION ALL SELECT interest_2 FROM s WHERE interest_2 IS NOT NULL) SELECT 'interests' AS field, value, count(*) AS n FROM m GROUP BY value "
       "UNION ALL SELECT 'country', coalesce(country, cntry), count(*) FROM s GROUP BY ALL")  # fmt: skip
def facet_members(spark, d):
    """Each member of a list counts."""
    own = _slots(spark, d).select("c_custkey", shapes.positional([F.col(c) for c in INTERESTS], "enum").alias("interests"), shapes.first_value([F.col("country"), F.col("cntry")], "enum").alias("country"))
    return facets.counts(own, ["interests", "country"], "c_custkey", ["interests"]).select("field", "value", "n")


@query(values([("dataset", 0, "full_name"), ("dataset", 1, "company"), ("dataset", 2, "amount"), ("dataset", 3, "date"), ("dataset", 4, "active"), ("dataset", 5, "place"), ("collection", 0, "_source_file"), ("collection", 1, "name"),
               ("collection", 2, "amount"), ("match", 0, "full_name"), ("match", 1, "amount")], "view, position, field"))
def display_columns(spark, d):
    """The fields that lists show, of a dataset, of a collection and of a match."""
    own = {s.canonical: s for s in _part_dataset(spark, d).shapes}
    shown = {
        "dataset": facets.dataset_columns(list(own.values())),
        "collection": facets.collection_columns([c for c in own if c in ("amount",)]),
        "match": match.displayed([c for c in own if c in ("full_name", "amount", "active")]),
    }
    rows = [(view, i, c) for view, names in shown.items() for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "view string, position int, field string")


# ---- filters


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = 17")
def numeric_equality(spark, d):
    return table(spark, d, "lineitem").where(filters.scanned(F.col("l_quantity"), " 17.0 ", "num")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT 'equals' AS test, count(*) AS n FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'any order', count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-06-30'
 UNION ALL SELECT 'number as text', count(*) FROM orders WHERE o_custkey = 12 UNION ALL SELECT 'text', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def strict_grammar(spark, d):
    """The stricter filter grammar: = as an operator, date bounds in either order, numbers equal as numbers."""
    o = table(spark, d, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")).alias("cust"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")
    plain = F.trim("cust")
    tests = {
        "equals": filters.matches(plain, "= 7", "num", strict=True),
        "any order": filters.matches(F.col("day"), "1996-06-30..1996-01-01", "date", strict=True),
        "number as text": filters.matches(plain, "12", strict=True),
        "text": filters.matches(F.col("o_orderstatus"), "=f", strict=True),
    }
    return facets.segments(o, tests).withColumnRenamed("segment", "test")


@query(values([("filtered", '{"size": 12, "query": {"bool": {"must": [{"multi_match": {"query": "open plan", "fields": ["name", "notes"]}}], "filter": [{"range": {"amount": {"gt": 150.0}}}, {"range": {"city": {"gte": "Bos", "lte": "n"}}}, '
                '{"term": {"age": "10-20"}}, {"term": {"_tags": "garden"}}, {"term": {"_source_file": "a"}}]}}}'), ("all", '{"match_all": {}}'),
               ("dates", '{"bool": {"filter": [{"range": {"day": {"gte": "2024-01-01", "lte": "2024-02-01"}}}]}}')], "name, query"))
def dsl_render(spark, d):
    """Queries for display. A value with "to" inside reads as a range there, whatever its field."""
    own = {
        "filtered": filters.query_json("open plan", [("amount", ">150"), ("city", "Boston"), ("age", "10-20")], ["name", "notes"], ("_tags", "garden"), ("_source_file", "a"), 12),
        "all": filters.query_json(" ", [], ["name"]),
        "dates": filters.query_json(None, [("day", "2024-01-01..2024-02-01")], []),
    }
    return spark.createDataFrame(list(own.items()), "name string, query string")


# ---- collections


def _crm(spark, d) -> Collection:
    """Customers and leads by name; a third of the customers are leads, half of these with another country."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    a = c.select(k.alias(ROW), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"), F.concat(F.lit("N"), nation).alias("Country"), F.format_string("%.2f", "c_acctbal").alias("Balance"))
    b = c.where(k % 3 == 0).select(
        k.alias(ROW), F.lower("c_name").alias("Full Name"), F.concat(F.when(k % 2 == 0, "N").otherwise("M"), nation).alias("Nation"), F.when(k % 4 == 0, "gold").otherwise("plain").alias("Tier")
    )
    return Collection("crm", key="full_name").add("in/customers.csv", a).add("in/leads.csv", b)


CRM = """a AS (SELECT c_custkey AS k, replace(lower(c_name), '#', '') AS key, c_mktsegment AS segment, c_acctbal, c_nationkey, c_custkey % 3 = 0 AS lead,
 c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AS moved FROM customer)"""


@query(f"WITH {CRM} SELECT key, segment, CASE WHEN lead THEN 2 ELSE 1 END::BIGINT AS n_rows FROM a WHERE c_acctbal > 5000 AND segment = 'BUILDING' ORDER BY k LIMIT 20 OFFSET 20")
def search_conjunction(spark, d):
    """Two filters at once, the second page."""
    found = _crm(spark, d).search(where=[("amount", "> 5000"), ("segment", " building")], page=2, size=20)
    return found.select(F.col("_key").alias("key"), F.array_join("segment", ",").alias("segment"), F.col("_rows").alias("n_rows"))


@query(f"WITH {CRM} SELECT key, CASE WHEN moved THEN 'N' || c_nationkey || ',M' || c_nationkey ELSE 'N' || c_nationkey END AS countries FROM a WHERE lead ORDER BY k LIMIT 30")
def search_sources(spark, d):
    """Entities that one file has."""
    return _crm(spark, d).search(sources=["leads.csv"]).select(F.col("_key").alias("key"), F.array_join("country", ",").alias("countries"))


@query(f"WITH {CRM} SELECT 'all' AS search, count(*) AS total FROM a UNION ALL SELECT 'rich', count(*) FROM a WHERE c_acctbal > 5000 UNION ALL SELECT 'moved to M3', count(*) FROM a WHERE moved AND c_nationkey = 3 "
       "UNION ALL SELECT 'golden builders', count(*) FROM a WHERE lead AND k % 4 = 0 AND segment = 'BUILDING' UNION ALL SELECT 'nowhere', 0")  # fmt: skip
def total_hits(spark, d):
    """Hits before paging, of several searches."""
    c = _crm(spark, d)
    asked = {"all": {}, "rich": {"where": [("amount", ">5000")]}, "moved to M3": {"where": [("country", "m3")]}, "golden builders": {"query": "GOLD, building"}, "nowhere": {"where": [("nowhere", "x")]}}
    out = None
    for name, tests in asked.items():
        own = c.total(**tests).select(F.lit(name).alias("search"), "total")
        out = own if out is None else out.unionByName(own)
    return out


@query(values([(0, "country", "keyword", "scalar", 2, False), (1, "full_name", "keyword", "scalar", 2, False), (2, "amount", "double", "scalar", 1, False), (3, "segment", "keyword", "scalar", 1, False),
               (4, "tier", "keyword", "scalar", 1, False)], "position, field, type, cardinality, n_files, conflict"))
def collection_detail(spark, d):
    rows = [(i, *r) for i, r in enumerate(_crm(spark, d).roll_up())]
    return spark.createDataFrame(rows, "position int, field string, type string, cardinality string, n_files int, conflict boolean")


@query(f"WITH {CRM}, r AS (SELECT 'n' || c_nationkey AS key FROM a UNION ALL SELECT CASE WHEN moved THEN 'm' ELSE 'n' END || c_nationkey FROM a WHERE lead) "
       "SELECT count(*)::BIGINT AS raw_records, count(DISTINCT key) AS entities, count(*) - count(DISTINCT key) AS merged FROM r")  # fmt: skip
def rekeyed(spark, d):
    """The same files merged by another field."""
    return _crm(spark, d).rekey("country").detail()


@query(values([("customers.csv", False), ("leads", False), ("others.csv", True)], "name, taken"))
def duplicate_files(spark, d):
    """A file of a name that the collection has is refused."""
    out = []
    for name in ("customers.csv", "leads", "others.csv"):
        try:
            _crm(spark, d).add(f"elsewhere/{name}", table(spark, d, "region"))
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, taken boolean")


def _zones(spark, d) -> Collection:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return Collection("zones", key="country").add("nations", n.select(F.col("n_nationkey").alias(ROW), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("Country"), F.col("r_name").alias("Zone")))


@query(f"WITH {CRM} SELECT key, CASE WHEN NOT moved THEN r_name END AS zone FROM a JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def enrich_from_collection(spark, d):
    """A field that another collection's entities have, by their key."""
    c = _crm(spark, d).enrich("zones", _zones(spark, d), "country")
    return c.entities().select(F.col("_key").alias("key"), F.array_join("zone", ",").alias("zone"))


@query(values([("with", True), ("without", False)], "plan, has_zone"))
def removed_enrichment(spark, d):
    c = _crm(spark, d).enrich("zones", _zones(spark, d), "country")
    rows = [("with", "zone" in c.entities().columns), ("without", "zone" in c.remove_enrichment("zones").entities().columns)]
    return spark.createDataFrame(rows, "plan string, has_zone boolean")


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS raw_records, count(*) AS entities, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS merged, "
       "(SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS builders FROM customer")  # fmt: skip
def restored_collection(spark, d):
    """A collection saved as a spec and built anew from it gives the same entities and segments."""
    c = _crm(spark, d).segment("builders", [("segment", "building")])
    text = json.dumps(c.spec())
    again = Collection.restored(json.loads(text), dict(c.files).__getitem__)
    return again.detail().crossJoin(again.segment_counts().select(F.col("n").alias("builders")))  # one row each


@query("SELECT n_nationkey, 'col_' || lower(n_name) || '_set_' || n_nationkey AS table_name FROM nation")
def index_names(spark, d):
    rows = [(r["n_nationkey"], sinks.table_name(f" {r['n_name']} – Set {r['n_nationkey']}!! ")) for r in table(spark, d, "nation").collect()]
    return spark.createDataFrame(rows, "n_nationkey int, table_name string")


@query("SELECT 'col_lw_nation' AS name, count(*) AS n_rows, true AS listed, false AS orphan FROM nation UNION ALL SELECT 'col_lw_region', count(*), true, true FROM region "
       "UNION ALL SELECT 'kt_lw_single', 2 * count(*), true, true FROM region")  # fmt: skip
def index_tables(spark, d):
    """Tables in place of indexes: written, replaced, listed, swept as orphans and deleted."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    made = {"col_lw_nation": n, "col_lw_region": n, "kt_lw_single": r.unionByName(r)}
    rows = {name: sinks.write_index(df, name, new_folder(spark, name)) for name, df in made.items()}
    sinks.delete_index(spark, "col_lw_region")
    rows["col_lw_region"] = sinks.write_index(r, "col_lw_region", new_folder(spark, "again"))
    listed = set(sinks.list_indexes(spark, "col_lw_*")) | set(sinks.list_indexes(spark, "kt_lw_*"))
    orphans = set(sinks.orphans(spark, ["col_lw_nation"])) & set(made)
    for name in made:
        sinks.delete_index(spark, name)
    return spark.createDataFrame([(x, rows[x], x in listed, x in orphans) for x in made], "name string, n_rows long, listed boolean, orphan boolean")


def _texts(spark, d) -> Collection:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias(ROW), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("Id"), F.col("text").alias("Text"))
    return Collection("texts", key="identifier").add("documents", docs)


TAG = "que"
_LISTS = f"WITH {TAGS}, l AS (SELECT doc_id, list(keyword ORDER BY rank) AS tags FROM tg GROUP BY doc_id)"


@query(f"{_LISTS} SELECT 'doc ' || doc_id AS key, array_to_string(tags, ';') AS tags FROM l WHERE list_contains(tags, '{TAG}')")
def search_tag(spark, d):
    """Entities with a tag, with all their tags."""
    return _texts(spark, d).matching(tag=TAG).select(F.col("_key").alias("key"), F.array_join("_tags", ";").alias("tags"))


@query(f"{_LISTS} SELECT 'doc ' || documents.doc_id AS key, array_to_string(tags, ';') AS tags FROM documents LEFT JOIN l USING (doc_id)")
def reindexed_tags(spark, d):
    """The table that a collection is written to, read back."""
    c = _texts(spark, d)
    name = sinks.table_name("lw texts")
    sinks.delete_index(spark, name)
    sinks.write_index(c.tagged(), name, path := new_folder(spark, "texts"))
    sinks.delete_index(spark, name)
    return spark.read.parquet(path).select(F.col("_key").alias("key"), F.array_join("_tags", ";").alias("tags"))


@query(values([("description",)], "field"))
def text_fields(spark, d):
    return spark.createDataFrame([(c,) for c in _texts(spark, d).text_fields()], "field string")


def _document_set(spark, d) -> Dataset:
    return Dataset.load(table(spark, d, "documents").select(F.col("doc_id").alias(ROW), F.col("source").alias("Origin"), F.col("text").alias("Text")))


@query(f"WITH {TAGS} SELECT keyword, n FROM (SELECT keyword, count(*) AS n, min((doc_id, rank)) AS f FROM tg GROUP BY keyword) ORDER BY n DESC, f LIMIT 25")
def dataset_tags(spark, d):
    return tags.top_tags(_document_set(spark, d).keywords("description"), "_seq", 25)


@query(f"""WITH {TAGS}, b AS (SELECT doc_id, string_agg(keyword, ' ' ORDER BY keyword) AS blob FROM tg GROUP BY doc_id)
 SELECT 'all' AS mode, count(*) AS total FROM documents WHERE contains(lower(concat_ws(' ', source, text)), 'the by') UNION ALL SELECT 'keyword', count(*) FROM b WHERE contains(blob, 'tion')
 UNION ALL SELECT 'tag', count(*) FROM tg WHERE keyword = '{TAG}' UNION ALL SELECT 'filtered', count(*) FROM documents WHERE contains(lower(concat_ws(' ', source, text)), 'the by') AND source = 'src1'""")
def dataset_keyword(spark, d):
    """The whole query as a part of the text, or of the extracted keywords; a tag; a filter besides."""
    s = _document_set(spark, d)
    field = next(x.canonical for x in s.shapes if "Origin" in x.sources)
    asked = {"all": s.total("The by"), "keyword": s.total("TION", mode="keyword"), "tag": s.total(tag=("description", TAG)), "filtered": s.total("the by", [(field, "SRC1")])}
    out = None
    for name, df in asked.items():
        own = df.select(F.lit(name).alias("mode"), "total")
        out = own if out is None else out.unionByName(own)
    return out


# ---- linking


def _pair(spark, d) -> tuple[Dataset, Dataset]:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias(ROW), F.col("c_name").alias("Name"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("Country"), F.col("c_mktsegment").alias("Segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias(ROW), F.col("s_name").alias("Full Name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("Nation"))
    return Dataset.load(c), Dataset.load(s)


@query("""WITH u AS (SELECT 'full_name' AS field, count(DISTINCT c_name) / count(*) AS a, (SELECT count(DISTINCT s_name) / count(*) FROM supplier) AS b FROM customer
 UNION ALL SELECT 'country', count(DISTINCT c_nationkey) / count(*), (SELECT count(DISTINCT s_nationkey) / count(*) FROM supplier) FROM customer)
 SELECT field, round((floor(a * 1000 + 0.5) / 1000 + floor(b * 1000 + 0.5) / 1000) / 2, 6) AS uniqueness FROM u""")
def link_keys(spark, d):
    """Fields that both datasets have, by their mean uniqueness."""
    return linkage.link_keys(_pair(spark, d)).select("field", F.round("uniqueness", 6).alias("uniqueness"))


@query(values([("full_name", "identifier"), ("country", "enum")], "field, kind"))
def shared_fields(spark, d):
    return spark.createDataFrame([(f, k) for f, k in linkage.shared(_pair(spark, d))], "field string, kind string")


@query(f"WITH RECURSIVE {O['link_clusters'].split('WITH RECURSIVE', 1)[1].rsplit('SELECT', 1)[0]}"
       "SELECT printf('E-%04d', n) AS entity_id, arg_min(k, seq) AS key, string_agg(DISTINCT source, ' ' ORDER BY source) AS sources, any_value(size)::VARCHAR AS size FROM al JOIN sz USING (root) GROUP BY n")  # fmt: skip
def unified_entities(spark, d):
    """Linked records flattened to a table of texts."""
    match.checkpoint_folder(spark)
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    tables = [
        ("a", match.keyed(names, F.col("p_name"), "full_name", "p_partkey")),
        ("b", match.keyed(names.withColumn("seq2", F.col("p_partkey") + 10_000_000), _perturbed(F.col("p_name")), "full_name", "seq2")),
    ]
    return linkage.flattened(match.linked(match.union_rows(tables), 0.85))


# ---- vectors and models


@query("SELECT count(*) AS n, count(DISTINCT p_name) AS different, 1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS largest_norm FROM part")
def hashed_vectors(spark, d):
    """Vectors of an embedder: one for each text, of unit length, equal for equal texts."""
    own = vectors.embedded(table(spark, d, "part").select("p_name"), "p_name", lambda: vectors.HashEmbedder(32), "v")
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 5)
    return own.agg(F.count("v").alias("n"), F.count_distinct("v").alias("different"), F.min(norm).alias("least_norm"), F.max(norm).alias("largest_norm"))


@query("SELECT 'neural' AS way, count(*) AS n, 1.0::DOUBLE AS least_norm FROM part UNION ALL SELECT 'lsa', count(*), 1.0::DOUBLE FROM part")
def vectors_or_lsa(spark, d):
    """The embedder's vectors where there is one, else those of a truncated SVD."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("text"))
    out = None
    for way, make in (("neural", lambda: vectors.HashEmbedder(16)), ("lsa", vectors.NoEmbedder)):
        v = vectors.vectors_or_lsa(p, "seq", "text", make, 4).withColumn("v", F.col("v").cast("array<double>"))
        norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 4)
        own = v.agg(F.count("v").alias("n"), F.min(norm).alias("least_norm")).select(F.lit(way).alias("way"), "n", "least_norm")
        out = own if out is None else out.unionByName(own)
    return out


class FirstWords:
    """A model client for tests: answers from the text itself, badly for every text that starts with a vowel."""

    def complete(self, prompt: str) -> str:
        text = prompt.split("\nText:\n", 1)[1]
        if re.match("[aeiou]", text, re.I):
            return "no JSON at all"
        words = text.split()
        return json.dumps({"mood": words[0], "stars": str(len(words)), "calm": "true" if len(words) % 2 else "false", "share": len(words) / 4, "nothing": None})


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query(f"""SELECT conv_id, turn, CASE WHEN ok THEN regexp_extract(text, '^\\s*(\\S+)', 1) END AS mood, CASE WHEN ok THEN n END AS stars, CASE WHEN ok THEN n % 2 = 1 END AS calm,
 CASE WHEN ok THEN n / 4 END AS share, NULL::VARCHAR AS nothing FROM (SELECT *, {_WORDS}::BIGINT AS n, trim(text) <> '' AND NOT regexp_matches(text, '^[aeiouAEIOU]') AS ok FROM conversations)""")
def llm_extraction(spark, d):
    """Attributes of each type from a model's JSON; one call for each distinct text, and a bad answer gives none."""
    own = [extract.Attribute("mood"), extract.Attribute("stars", "long"), extract.Attribute("calm", "boolean"), extract.Attribute("share", "double"), extract.Attribute("nothing")]
    out = extract.extract(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", own, FirstWords)
    return out.select("conv_id", "turn", *[a.name for a in own])


@query("SELECT count(DISTINCT text) AS total, count(DISTINCT CASE WHEN NOT regexp_matches(text, '^[aeiouAEIOU]') THEN text END) AS done FROM documents")
def extraction_progress(spark, d):
    return _texts(spark, d).extract([extract.Attribute("mood")], FirstWords).progress()


# ---- plans of partitions, summaries


@query("""WITH RECURSIVE h AS (SELECT c_nationkey::VARCHAR AS value, count(*) AS n FROM customer GROUP BY ALL),
 o AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS k FROM h),
 z AS (SELECT greatest(2, least(8, count(*), CASE WHEN round_even(sum(n) / 5000, 0) = 0 THEN 2 ELSE round_even(sum(n) / 5000, 0) END))::INTEGER AS b FROM h),
 deal AS (SELECT 0::BIGINT AS k, list_transform(range(0, b), lambda i: 0::BIGINT) AS load, list_transform(range(0, b), lambda i: 0::BIGINT) AS held FROM z
  UNION ALL SELECT o.k, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + o.n ELSE x END),
   list_transform(held, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + 1 ELSE x END) FROM deal JOIN o ON o.k = deal.k + 1),
 e AS (SELECT * FROM deal ORDER BY k DESC LIMIT 1), r AS (SELECT unnest(range(0, len(load))) AS bucket, unnest(load) AS rows, unnest(held) AS n_values FROM e)
 SELECT bucket::INTEGER AS bucket, rows, n_values, floor((SELECT max(rows) / min(rows) FROM r) * 100 + 0.5) / 100 AS balance_ratio FROM r""")
def bin_pack(spark, d):
    from loomwork.operators import partitions

    return partitions.balance(partitions.buckets(table(spark, d, "customer"), "c_nationkey"))
