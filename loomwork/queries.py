"""The catalogue of queries: each applies operators to whole tables. SQL for the same rows stands in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import columns, dsl, filters, geo
from loomwork.functions.similarity import dot
from loomwork.operators import canon, enrich, entities, extract, facets, match, partitions, profile, shapes, tags, vectors
from loomwork.sources import sinks

#: Names for the dictionary queries: (file, name, kind).
NAMES = [
    ("a", "Email Address", "identifier"), ("a", "First Name", "enum"), ("a", "lastName", "enum"), ("a", "Company", "enum"),
    ("a", "Annual Revenue", "numeric"), ("a", "createdAt", "date"), ("b", "e-mail", "identifier"), ("b", "account_ref", "identifier"),
    ("b", "Title", "enum"), ("b", "notes_1", "free_text"), ("b", "zip", "identifier"), ("b", "geo", "geo_point"), ("b", "qty", "numeric"),
    ("c", "work_email", "identifier"), ("c", "mobile_phone", "identifier"), ("c", "Nation", "enum"), ("c", "x_17", "enum"), ("c", "Point", "geo_point"),
]
#: A ring around the north-east of the derived coordinates.
RING = [(10.0, -50.0), (40.0, -60.0), (60.0, 20.0), (30.0, 70.0), (5.0, 10.0)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _money(c: str):
    return F.format_string("%.2f", F.col(c))


def _parts_as_text(spark, d) -> DataFrame:
    """part with cells as text: blanks, currency signs, yes and no, dates and points made from the key."""
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(k, F.lit(900)).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.when(k % 10 == 0, "").otherwise(F.col("p_brand")).alias("brand"),
        F.when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit("$"), _money("p_retailprice"))).alias("price"),
        F.when(k % 3 == 0, "Yes").otherwise("no").alias("active"),
        F.when(k % 11 == 0, None).otherwise(day).alias("made_on"),
        F.concat(F.pmod(k, F.lit(80)).cast("string"), F.lit(".5, -"), F.pmod(k, F.lit(170)).cast("string"), F.lit(".25")).alias("place"),
    )


PART_TEXTS = ["name", "brand", "price", "active", "made_on", "place"]


def profile_columns(spark, d):
    m = profile.measures(profile.cells(_parts_as_text(spark, d), ["p_partkey"], PART_TEXTS))
    shares = [columns.half_up(F.col(c), 4).alias(c) for c in ("avg_len", "avg_words", "numeric_share", "boolean_share", "date_share", "geo_share")]
    return m.select("col", "populated", "cardinality", *shares)


def classify_columns(spark, d):
    s = profile.decided(profile.scored(profile.measures(profile.cells(_parts_as_text(spark, d), ["p_partkey"], PART_TEXTS))))
    return s.select("col", "kind", columns.round3(F.col("gap")).alias("gap"), "escalated")


def fill_rate(spark, d):
    return profile.fill(profile.cells(_parts_as_text(spark, d), ["p_partkey"], PART_TEXTS)).select("col", "n", "filled", "fill_rate")


def quality_counts(spark, d):
    return profile.quality_counts(_parts_as_text(spark, d), ["price"])


def voted_types(spark, d):
    return profile.voted_types(profile.cells(_parts_as_text(spark, d), ["p_partkey"], PART_TEXTS))


def type_fit(spark, d):
    df = _parts_as_text(spark, d)
    return df.select("p_partkey", profile.fitting(F.col("price"), "float").alias("price"), profile.fitting(F.col("made_on"), "date").alias("made_on"))


def _names(spark) -> DataFrame:
    return spark.createDataFrame(NAMES, "file string, name string, kind string")


def canonical_names(spark, d):
    return canon.canonical_names(_names(spark).select("name", "kind"))


def merge_groups(spark, d):
    named = canon.canonical_names(_names(spark).select("name", "kind"))
    return canon.merge_groups(named).select("canonical", "n_columns", F.array_join("columns", ";").alias("columns"), "unified")


def registry(spark, d):
    own = _names(spark)
    named = own.join(canon.canonical_names(own.select("name", "kind")), ["name", "kind"])
    return canon.registry(named)


def clean_numeric(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("€ "), _money("o_totalprice")))
    return table(spark, d, "orders").select("o_orderkey", columns.cleaned(raw, "numeric").alias("amount"))


def clean_bool(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "yes").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", columns.cleaned(raw, "boolean").alias("flag"))


def clean_date(spark, d):
    """Each known form of a date, a day before the month where that can't be told from a month, blanks and other text."""
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "d/M/yyyy", "MMM d yyyy", "dd-MM-yyyy"]
    raw = F.when(k == 8, " ").when(k == 9, " some day ")
    for i, form in enumerate(forms):
        text = F.date_format(t, form)
        raw = raw.when(k == i, F.concat(text, F.lit("T10:00:00Z")) if i == 0 else F.concat(F.lit(" "), text))
    return table(spark, d, "orders").select("o_orderkey", columns.cleaned(raw, "date").alias("day"))


def _slots(spark, d) -> DataFrame:
    """customer with phone slots, two of them often filled, and interests."""
    k = F.col("c_custkey")
    number = lambda n: F.concat(F.lit(f"+{n}-555-"), F.lpad((k * 7 + n).cast("string"), 6, "0"))
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 3 != 0, number(1)).alias("phone_home"),
        F.when(k % 2 == 0, number(1)).when(k % 5 == 0, number(2)).alias("phone_work"),
        F.when(k % 4 == 1, number(3)).alias("phone_mobile"),
        F.col("c_mktsegment").alias("interest_1"),
        F.when(k % 2 == 1, F.lit("golf")).alias("interest_2"),
        F.when(k % 50 == 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("country"),
        F.when(k % 50 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("cntry"),
    )


PHONES, INTERESTS = ["phone_home", "phone_work", "phone_mobile"], ["interest_1", "interest_2"]


def cooccupancy(spark, d):
    return shapes.slot_counts(_slots(spark, d), {"phone": PHONES, "interests": INTERESTS, "country": ["country", "cntry"]})


def consolidate_scalar(spark, d):
    return _slots(spark, d).select("c_custkey", shapes.first_value([F.col("country"), F.col("cntry")], "enum").alias("country"))


def consolidate_positional(spark, d):
    own = shapes.positional([F.col(c) for c in INTERESTS], "enum")
    return _slots(spark, d).select("c_custkey", F.array_join(own, ";").alias("interests"))


def consolidate_tagged(spark, d):
    labels, _, _ = shapes.qualifiers(PHONES)
    own = shapes.labelled([F.col(c) for c in PHONES], labels, "identifier")
    return _slots(spark, d).select("c_custkey", F.array_join(F.transform(own, lambda x: F.concat_ws("=", x["type"], x["value"])), ";").alias("phones"))


def split_multi(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit("|"), F.col("p_type"), F.lit(","), F.split("p_name", " ")[0])
    return table(spark, d, "part").select("p_partkey", F.array_join(columns.split_values(raw), "/").alias("parts"))


def dsl_strings(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.lit("  ").alias("blank"), F.concat(F.lit(" \t"), "p_name", F.lit(" ")).alias("padded"))
    own = {
        "up": "upper(p_name)",
        "low": "lower(p_brand)",
        "first": 'split(p_name, " ", 0)',
        "second": 'split(p_name, " ", 1)',
        "ninth": 'split(p_name, " ", 9)',
        "cut": "substring(p_name, 1, 4)",
        "stripped": 'strip(p_brand, "B#nd")',
        "swapped": 'replace(p_name, " ", "-")',
        "masked": 'regex_replace(p_brand, "[0-9]+", "N")',
        "found": 'regex_extract(p_name, "[aeiou]+")',
        "numbers": "digits(p_brand)",
        "size": "length(p_name)",
        "joined": 'concat(p_brand, "/", nowhere, p_type)',
        "filled": 'default(blank, "none")',
        "any": "coalesce(blank, nowhere, p_type)",
        "lost": "replace(p_name)",
        "trimmed": "trim(padded)",
    }
    return dsl.transformed(df, own).select("p_partkey", *own)


def dsl_numbers(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("$"), _money("o_totalprice")).alias("total"), F.pmod("o_orderkey", F.lit(7)).cast("string").alias("n"))
    own = {
        "number": "to_number(total)",
        "rounded": "round(total)",
        "dimes": "round(total, 1)",
        "more": "add(n, 10)",
        "less": "sub(n, 2.5)",
        "twice": "mul(n, 2)",
        "share": "div(12, n)",
        "none": 'add(n, "x")',
    }
    return dsl.transformed(df, own).select("o_orderkey", *own)


def dsl_logic(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.col("p_size").cast("string").alias("p_size"))
    own = {
        "same": 'eq(p_type, " ECONOMY ")',
        "big": "gt(p_size, 25)",
        "upto": "lte(p_size, 10)",
        "after": 'gt(p_name, "m")',
        "has": 'contains(p_name, "RING")',
        "both": 'and(gt(p_size, 10), contains(p_name, "r"))',
        "either": "or(gt(p_size, 45), lt(p_size, 5))",
        "negated": "not(gt(p_size, 25))",
        "chosen": 'if(gte(p_size, 25), concat("L", p_size), "S")',
    }
    return dsl.transformed(df, own).select("p_partkey", *own)


def _filtered(df, c, value, kind, keys):
    return df.where(filters.matches(F.col(c), value, kind)).select(*keys)


def filter_cmp(spark, d):
    df = table(spark, d, "orders").where(filters.scanned(F.col("o_totalprice"), ">= 250000", "num"))
    return df.select("o_orderkey", "o_totalprice")


def filter_range(spark, d):
    df = table(spark, d, "lineitem").where(filters.scanned(F.col("l_quantity"), "20-10", "num"))
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


def filter_text_numbers(spark, d):
    """The same range over numbers that are text."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _money("l_quantity").alias("quantity"))
    return _filtered(df, "quantity", "20-10", "num", ["l_orderkey", "l_linenumber", "quantity"])


def filter_date(spark, d):
    df = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _filtered(df, "day", "1996-01-01..1996-12-31", "date", ["o_orderkey", "day"])


def filter_exact(spark, d):
    return _filtered(table(spark, d, "customer"), "c_mktsegment", " building", None, ["c_custkey", "c_mktsegment"])


def filter_any_member(spark, d):
    df = _slots(spark, d).withColumn("interests", shapes.positional([F.col(c) for c in INTERESTS], "enum"))
    return df.where(filters.matches(F.col("interests"), "Golf", None, True)).select("c_custkey")


def keyword_all_terms(spark, d):
    return table(spark, d, "documents").where(filters.all_terms(F.col("text"), "The and, THING")).select("doc_id")


def keyword_tf(spark, d):
    own = table(spark, d, "documents").select("doc_id", filters.term_score(F.col("text"), "license the").cast("long").alias("score"))
    return own.where("score > 0")


def _places(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    lat, lng = (k * 7 % 140 - 70), (k * 31 % 300 - 150)
    text = F.concat(lat.cast("string"), F.lit(".5, "), lng.cast("string"), F.lit(".25"))
    return table(spark, d, "nation").select("n_nationkey", text.alias("place"))


def geo_parse_bbox(spark, d):
    p = geo.point(F.col("place"))
    return _places(spark, d).where(geo.in_box(p, -40, -100, 60, 100)).select("n_nationkey", p["lat"].alias("lat"), p["lng"].alias("lng"))


def geo_polygon(spark, d):
    return _places(spark, d).select("n_nationkey", geo.matches(F.array("place"), None, RING).alias("inside"))


def geo_points(spark, d):
    own = _places(spark, d).join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return facets.points(own, F.col("place"), [F.col("n_name")], "n_nationkey")


def norm_key(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        columns.key_of(F.concat(F.lit(" "), F.col("c_name"), F.lit("@X .com ")), "email").alias("email_key"),
        columns.key_of(F.concat(F.lit("+1 ("), F.col("c_custkey").cast("string"), F.lit(") 555-01")), "phone").alias("phone_key"),
        columns.key_of(F.concat(F.col("c_mktsegment"), F.lit(",  Inc. "), F.col("c_name")), "company").alias("company_key"),
    )
    return c


def entity_merge(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.lit(0).alias("_file"), F.lit("orders").alias("_source"), F.col("o_custkey").cast("string").alias("customer"), "o_orderstatus", "o_orderpriority")
    e = entities.merge(rows, "customer", "customer", ["o_orderstatus", "o_orderpriority"])
    return e.select(F.col("_key").alias("customer"), F.col("_rows").alias("n_rows"), F.array_join("o_orderstatus", ",").alias("statuses"), F.array_join("o_orderpriority", ",").alias("priorities"))


def _part_entities(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), F.lit(0).alias("_file"), F.lit("part").alias("_source"), "p_name", "p_brand", "p_type")
    return entities.merge(rows, "p_name", "name", ["p_brand", "p_type"])


def entity_conflicts(spark, d):
    return entities.conflicts(_part_entities(spark, d), ["p_brand", "p_type"])


def entity_counters(spark, d):
    return entities.counters(_part_entities(spark, d))


def entity_sources(spark, d):
    """customers and suppliers of a nation in one set of entities, keyed by nation; files in order of arrival."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("_row"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_row"), F.concat(F.lit("n "), F.col("s_nationkey").cast("string")).alias("nation"))
    s = s.withColumn("nation", F.replace("nation", F.lit(" "), F.lit("")))
    rows = entities.union_files([("suppliers", s), ("customers", c)], ["_row"])
    e = entities.merge(rows, "nation", "nation", ["nation"])
    return e.select(F.col("_key").alias("nation_key"), F.col("_rows").alias("n_rows"), F.array_join("nation", ",").alias("spellings"), F.array_join("_source_file", ",").alias("files"))


def tagged_merge(spark, d):
    """Phones of customers merged by nation: a labelled number takes the place of the same number without a label."""
    own = _slots(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    plain = own.select(F.col("c_custkey").alias("_row"), F.lit(0).alias("_file"), F.lit("a").alias("_source"), F.col("c_nationkey").cast("string").alias("nation"), F.array(F.struct(F.lit("other").alias("type"), F.concat(F.lit("P"), (F.col("c_custkey") % 4).cast("string")).alias("value"))).alias("phones"))
    named = own.where("c_custkey % 4 < 2").select(F.col("c_custkey").alias("_row"), F.lit(1).alias("_file"), F.lit("b").alias("_source"), F.col("c_nationkey").cast("string").alias("nation"), F.array(F.struct(F.lit("home").alias("type"), F.concat(F.lit("p"), (F.col("c_custkey") % 4).cast("string")).alias("value"))).alias("phones"))
    e = entities.merge(plain.unionByName(named), "nation", "nation", [], ["phones"])
    shown = F.array_join(F.transform("phones", lambda x: F.concat_ws("=", x["type"], x["value"])), ";")
    return e.select(F.col("_key").alias("nation"), shown.alias("phones"))


def exact_dup_docs(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.sha2(columns.words_of_text(F.col("text")), 256).alias("k"))
    return own.groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1").select("first_doc", "copies")


def _nations(spark, d, fields):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return enrich.reference(n, F.col("n_nationkey"), "identifier", fields, ["n_nationkey"])


def enrich_left(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return enrich.enrich(c, F.col("c_nationkey"), "identifier", _nations(spark, d, ["n_name", "r_name"]), ["n_name", "r_name"]).drop("_gained")


def enrich_fill_only(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "KNOWN").alias("n_name"))
    out = enrich.enrich(c, F.col("c_nationkey"), "identifier", _nations(spark, d, ["n_name"]), ["n_name"])
    return out.select("c_custkey", "c_nationkey", "n_name", F.col("_gained").alias("gained"))


def enrich_chain(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = enrich.reference(table(spark, d, "nation"), F.col("n_nationkey"), "identifier", ["n_name", "n_regionkey"], ["n_nationkey"])
    r = enrich.reference(table(spark, d, "region"), F.col("r_regionkey"), "identifier", ["r_name"], ["r_regionkey"])
    return enrich.chain(s, [(F.col("s_nationkey"), "identifier", n, ["n_name", "n_regionkey"]), (F.col("n_regionkey"), "identifier", r, ["r_name"])])


def join_key_candidates(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.floor("c_acctbal").cast("string").alias("amount"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), F.floor("s_acctbal").cast("string").alias("amount"))
    return match.join_keys(c, s, [("name", "identifier"), ("nation", "enum"), ("amount", "numeric")])


def _perturbed(c):
    """A name with its third character gone, for two of three rows."""
    k = F.col("p_partkey")
    return F.when(k % 3 == 0, c).otherwise(F.concat(F.substring(c, 1, 2), F.substring(c, 4, 100)))


def _match_sides(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_name")
    a = match.keyed(p.where("p_partkey % 2 = 0"), key, "full_name", "p_partkey")
    b = match.keyed(p.where("p_partkey % 2 = 1"), _perturbed(key), "full_name", "p_partkey")
    return a, b


def fuzzy_match(spark, d):
    a, b = _match_sides(spark, d)
    return match.best_matches(a, b, 0.9).select("a_seq", "b_seq", F.round("sim", 6).alias("sim"))


def match_report(spark, d):
    a, b = _match_sides(spark, d)
    p = table(spark, d, "part")
    return match.report(a, p.where("p_partkey % 2 = 1").count(), match.best_matches(a, b, 0.9), p.where("p_partkey % 2 = 0").count())


def link_clusters(spark, d):
    match.checkpoint_folder(spark)
    p = table(spark, d, "part")
    names = p.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    tables = [
        ("a", match.keyed(names, F.col("p_name"), "full_name", "p_partkey")),
        ("b", match.keyed(names.withColumn("seq2", F.col("p_partkey") + 10_000_000), _perturbed(F.col("p_name")), "full_name", "seq2")),
    ]
    return match.linked(match.union_rows(tables), 0.85).select("seq", "source", "k", "entity_id", "size", "n_sources")


def facet_counts(spark, d):
    return facets.counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey").select("field", "value", "n")


def facet_low_card(spark, d):
    counted = facets.counts(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey", "c_name"], "c_custkey")
    return facets.facets(counted)


def facet_most_common(spark, d):
    return facets.most_common(facets.counts(table(spark, d, "events"), ["event_type", "user_id"], "event_id"), 5)


def doc_tags(spark, d):
    return tags.keywords(table(spark, d, "documents"), "doc_id", F.col("text"))


def top_tags(spark, d):
    return tags.top_tags(tags.keywords(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id")


def tag_filter(spark, d):
    lists = tags.tag_lists(tags.keywords(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id")
    shown = F.array_join(tags.highlighted(F.col("tags"), "thing"), ";")
    return lists.where(F.exists("tags", lambda t: F.contains(t, F.lit("thing")))).select("doc_id", shown.alias("tags"))


def segment_counts(spark, d):
    c = table(spark, d, "customer")
    rich = filters.matches(F.col("c_acctbal"), "> 5000", "num")
    builder = filters.matches(F.col("c_mktsegment"), "building")
    return facets.segments(c, {"rich": rich, "builders": builder, "rich builders": rich & builder})


def field_counts(spark, d):
    return facets.filled(_slots(spark, d), [*PHONES, "interest_2", "country"])


def skew_metrics(spark, d):
    return partitions.skew(partitions.histogram(table(spark, d, "part"), "p_brand"))


def partition_verdict(spark, d):
    out = None
    for name, t in (("p_brand", "part"), ("p_name", "part"), ("c_nationkey", "customer"), ("o_orderstatus", "orders"), ("c_name", "customer")):
        own = partitions.verdict(partitions.histogram(table(spark, d, t), name), name)
        out = own if out is None else out.unionByName(own)
    return out


def page_offset(spark, d):
    return facets.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 25)


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, F.col("embedding"), _query_vector(spark, d), "vec_id", 10).select("vec_id", "label", "score")


def semantic_filtered(spark, d):
    e = table(spark, d, "embeddings").where("label = 1")
    return vectors.top_k(e, F.col("embedding"), _query_vector(spark, d), "vec_id", 10).select("vec_id", "label", "score")


def semantic_gated(spark, d):
    ranked = vectors.scored(table(spark, d, "embeddings"), F.col("embedding"), _query_vector(spark, d))
    return vectors.gated(ranked, 0.15, 0.3).select("vec_id", columns.round3(F.col("score")).alias("score"))


def hybrid_rrf(spark, d):
    """Keyword and vector ranks of vectors, fused; labels stand in for text."""
    e = table(spark, d, "embeddings")
    a = vectors.scored(e, F.col("embedding"), _query_vector(spark, d)).orderBy(F.desc("score"), "vec_id").limit(50)
    b = e.where("label = 1").orderBy("vec_id").limit(50)
    rank = lambda df, *by: df.withColumn("rank", F.row_number().over(_window(*by)))
    return vectors.fused([rank(a, F.desc("score"), "vec_id"), rank(b, "vec_id")], "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _window(*by):
    from pyspark.sql import Window

    return Window.orderBy(*by)  # over lists of at most 50 rows


def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    p = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("x")).join(b.select("vec_id", F.col("embedding").alias("y")), "vec_id")
    return p.select("vec_id", F.round(dot(F.col("x"), F.col("y")), 5).alias("cosine"))


def union_files(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("_row"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_row"), F.col("s_name").alias("full_name"), F.col("s_nationkey").cast("string").alias("country"))
    return entities.union_files([("customer", c), ("supplier", s)], ["_row"]).select(F.col("_source").alias("source"), F.col("_row").alias("row_no"), "full_name", "segment", "country")


def json_props(spark, d):
    own = extract.coerced(F.col("props"), extract.Attribute("k", "long"))
    missing = extract.coerced(F.col("props"), extract.Attribute("nowhere", "double"))
    return table(spark, d, "events").select("event_id", own.alias("k"), missing.alias("nowhere"))


def precision_mrr(spark, d):
    """Neighbours with the query's label, for all vectors whose id is divisible by 20."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("v"), "label")
    q = e.where("seq % 20 = 0").select(F.col("seq").alias("q"), "v")
    near = vectors.nearest_labels(e, q, 10)
    own = e.select(F.col("seq").alias("q"), F.col("label").alias("want"))
    hits = near.join(e.select("seq", "label"), "seq").join(own, "q").select("q", "rank", (F.col("label") == F.col("want")).alias("hit"))
    return vectors.precision_mrr(hits, 10)


def accuracy_verdicts(spark, d):
    """Length as a guess of quality against the labels: correct, fp, miss or right to say no."""
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    said = F.length("text") >= 1000
    v = F.when(said & (F.col("quality") == 1), "correct").when(said, "fp").when(F.col("quality") == 1, "miss").otherwise("none")
    return x.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


def conversation_merge(spark, d):
    rows = table(spark, d, "conversations")
    own = rows.groupBy("conv_id").agg(entities.distinct_in_order(F.col("turn"), F.col("role")).alias("roles"), entities.ordered(F.col("turn"), F.length("text")).alias("sizes"))
    return own.select("conv_id", F.array_join("roles", ",").alias("roles"), F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


def sentence_summary(spark, d):
    return extract.summary(table(spark, d, "documents"), "doc_id", "text")


def bulk_ndjson(spark, d):
    return sinks.bulk_lines(table(spark, d, "nation"), "col_nation", F.col("n_nationkey"))


def _customer_shapes(spark, d):
    return shapes.plan(_slots(spark, d), [*[(c, "identifier", "phone") for c in PHONES], *[(c, "enum", "interests") for c in INTERESTS], ("country", "enum", "country"), ("cntry", "enum", "country")])


def display_names(spark, d):
    c = F.col("c_custkey")
    full, first, last = F.when(c % 3 == 0, F.col("c_name")), F.when(c % 2 == 0, F.lit(" Ann ")), F.lit("Lee")
    return table(spark, d, "customer").select("c_custkey", facets.row_name(full, first, last).alias("name"))


def flagship(spark, d):
    """Orders merged by customer with conflicts kept, enriched by customer and nation, faceted by segment."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.lit(0).alias("_file"), F.lit("orders").alias("_source"), F.col("o_custkey").cast("string").alias("customer"), "o_orderstatus", "o_orderpriority")
    e = entities.merge(rows, "customer", "customer", ["o_orderstatus", "o_orderpriority"])
    c = table(spark, d, "customer")
    ref = enrich.reference(c, F.col("c_custkey"), "customer", ["c_mktsegment", "c_nationkey"], ["c_custkey"])
    n = enrich.reference(table(spark, d, "nation"), F.col("n_nationkey"), "identifier", ["n_name"], ["n_nationkey"])
    own = enrich.chain(e, [(F.col("_key"), "customer", ref, ["c_mktsegment", "c_nationkey"]), (F.col("c_nationkey"), "identifier", n, ["n_name"])])
    disputed = F.count_if(F.size("o_orderstatus") > 1)
    return own.groupBy("c_mktsegment").agg(F.count("*").alias("entities"), F.sum("_rows").alias("n_orders"), disputed.alias("disputed"), F.count_distinct("n_name").alias("nations"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, profile_columns, classify_columns, fill_rate, quality_counts, voted_types, type_fit, canonical_names, merge_groups, registry,
        clean_numeric, clean_bool, clean_date, cooccupancy, consolidate_scalar, consolidate_positional, consolidate_tagged, split_multi,
        dsl_strings, dsl_numbers, dsl_logic, filter_cmp, filter_range, filter_text_numbers, filter_date, filter_exact, filter_any_member, keyword_all_terms,
        keyword_tf, geo_parse_bbox, geo_polygon, geo_points, norm_key, entity_merge, entity_conflicts, entity_counters,
        entity_sources, tagged_merge, exact_dup_docs, enrich_left, enrich_fill_only, enrich_chain, join_key_candidates, fuzzy_match,
        match_report, link_clusters, facet_counts, facet_low_card, facet_most_common, doc_tags, top_tags, tag_filter, segment_counts,
        field_counts, skew_metrics, partition_verdict, page_offset, vector_topk, semantic_filtered, semantic_gated, hybrid_rrf,
        cosine_pairs, union_files, json_props, precision_mrr, accuracy_verdicts, conversation_merge, sentence_summary, 
        bulk_ndjson, display_names,
    )
}
