import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import filters
from loomwork.operators import canon, enrich, entities, extract, facets, match, partitions, profile, shapes, tags, vectors
from loomwork.sources import files, sinks


def table(spark, headers, rows):
    return files.from_rows(spark, headers, [dict(zip(headers, r)) for r in rows])


# ---- profiling


def test_kinds_and_escalation(spark):
    n = 60
    rows = [
        (f"${i},{100 + i}.5", "Yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", "red" if i % 3 else "blue", f"id-{i}", " ".join(["word"] * 20), f"{i % 80}.5, -{i}.25", None, str(i), "12,34")
        for i in range(n)
    ]
    names = ["amount", "flag", "day", "colour", "code", "notes", "place", "nothing", "Unnamed: 0", "pair"]
    found = {p.name: p for p in profile.profile(table(spark, names, rows), [files.ROW])}
    assert {k: p.kind for k, p in found.items()} == {
        "amount": "numeric", "flag": "boolean", "day": "date", "colour": "enum", "code": "identifier", "notes": "free_text",
        "place": "geo_point", "nothing": "empty", "Unnamed: 0": "numeric", "pair": "numeric",
    }
    assert found["flag"].escalated and found["flag"].margin == 0.2
    assert not found["Unnamed: 0"].searchable and found["nothing"].fill_rate == 0 and not found["nothing"].searchable
    assert found["colour"].cardinality == 2 and not found["colour"].escalated


def test_only_the_first_cells_count(spark):
    rows = [("1",)] * 4 + [("x",)] * 6
    m = profile.measures(profile.cells(table(spark, ["v"], rows), [files.ROW]), 4).first()
    assert m["populated"] == 4 and m["numeric_share"] == 1


def test_quality_counts(spark):
    df = table(spark, ["v"], [("$5",), ("7",), ("x",), (None,), ("1,000",)])
    assert tuple(profile.quality_counts(df, ["v"]).first()) == (2, 1)


# ---- names


@pytest.mark.parametrize(
    "name, kind, expected",
    [
        ("First Name", "enum", ("first_name", "alias")),
        ("lastName", "enum", ("last_name", "alias")),
        ("Company Name", "enum", ("company", "alias")),
        ("account_ref", "identifier", ("identifier", "alias")),
        ("amt_2", "numeric", ("amount", "alias")),
        ("amt", "enum", ("amt", "identity")),
        ("position", "geo_point", ("location", "alias")),
        ("position", "enum", ("job_title", "alias")),
        ("signup", "identifier", ("signup", "identity")),
        ("123", "enum", ("123", "identity")),
    ],
)
def test_canonical(name, kind, expected):
    assert canon.canonical(name, kind) == expected


def test_canonical_join_agrees(spark):
    pairs = [(n, k) for n in ("E-mail", "fname", "Total Price", "geoPoint", "ref", "x1", "Country/Region", "note") for k in ("enum", "numeric", "identifier", "free_text", "geo_point", "date")]
    out = canon.canonical_names(spark.createDataFrame(pairs, "name string, kind string")).collect()
    assert {(x.name, x.kind): (x.canonical, x.method) for x in out} == {p: canon.canonical(*p) for p in pairs}


def test_embedding_match_needs_score_and_lead():
    near = {"handset": [1.0, 0.0], "phone": [0.9, 0.1], "mobile": [0.8, 0.2]}
    embed = lambda texts: [near.get(t, [0.0, 1.0]) for t in texts]
    assert canon.canonical("handset", "identifier", embed) == ("phone", "semantic")
    flat = lambda texts: [[1.0, 0.0] for _ in texts]
    assert canon.canonical("handset", "identifier", flat) == ("handset", "identity")


def test_mapping_and_registry(spark):
    m = canon.Mapping()
    m.override("x", "company")
    assert m.add("Deal Size!", "double") == "deal_size" and m.add("odd", "nothing") == "odd" and m.custom["odd"] == ("keyword", False)
    m.override("y", "deal_size")
    m.remove("deal_size")
    assert m.overrides == {"x": "company"} and m.resolve("x", "enum") == ("company", "override")
    named = spark.createDataFrame([("a", "e", "email"), ("b", "mail", "email"), ("a", "z", "zip")], "file string, name string, canonical string")
    assert [tuple(x) for x in canon.registry(named).collect()] == [("email", 2, 2, True), ("zip", 1, 1, False)]


# ---- shapes


def test_qualifiers():
    assert shapes.qualifiers(["phone_home", "phone_work"]) == (("home", "work"), "semantic", True)
    assert shapes.qualifiers(["Interest 1", "Interest 2"])[1:] == ("positional", True)
    assert shapes.qualifiers(["x"]) == ((None,), "single", False)
    assert shapes.qualifiers(["Mobile", "Work Phone", "Home Phone"])[0] == ("Mobil", "Work Phon", "Home Phon")
    assert shapes.qualifiers(["a", "b"])[2] is False


def test_slots_become_lists(spark):
    names = ["phone_home", "phone_work", "tag 1", "tag 2", "country", "cntry"]
    rows = [("1", "2", "x", "x", "NO", None), ("3", "3", "x", "y", None, "SE"), (None, "4", None, "z", "DK", None)]
    df = table(spark, names, rows)
    named = [("phone_home", "identifier", "phone"), ("phone_work", "identifier", "phone"), ("tag 1", "enum", "tag"), ("tag 2", "enum", "tag"), ("country", "enum", "country"), ("cntry", "enum", "country")]
    plan = {s.canonical: s for s in shapes.plan(df, named)}
    assert (plan["phone"].cardinality, plan["phone"].style) == ("array", "semantic")
    assert (plan["tag"].cardinality, plan["tag"].style) == ("array", "positional")
    assert plan["country"].cardinality == "scalar"
    out = shapes.consolidated(df, list(plan.values()), [files.ROW]).orderBy(files.ROW).collect()
    assert [[tuple(i) for i in x.phone] for x in out] == [[("home", "1"), ("work", "2")], [("home", "3")], [("work", "4")]]
    assert [x.tag for x in out] == [["x"], ["x", "y"], ["z"]] and [x.country for x in out] == ["NO", "SE", "DK"]


# ---- entities


def merge(spark, rows, scalars=("company",), lists=(), key="email"):
    return entities.merge(rows, key, key, list(scalars), list(lists))


def test_conflicts_are_kept_in_order(spark):
    rows = [(0, 0, "a", "A@x.com", "Acme"), (0, 1, "a", "a@x.com ", "Acme"), (1, 0, "b", "a@x.com", "Acme Corp"), (1, 1, "b", None, "Lone"), (1, 2, "b", " ", "Lone")]
    df = spark.createDataFrame(rows, "_file int, _row int, _source string, email string, company string")
    e = merge(spark, df, ("company", "email"))
    out = {x._key: x for x in e.where("_key is not null").collect()}
    assert out["a@x.com"].company == ["Acme", "Acme Corp"] and out["a@x.com"]._source_file == ["a", "b"] and out["a@x.com"]._rows == 3
    assert out["a@x.com"].email == ["A@x.com", "a@x.com ", "a@x.com"]
    assert e.count() == 3 and tuple(entities.counters(e).first()) == (5, 3, 2)
    assert entities.conflicts(e, ["company"]).first()["company"] == 1


def test_labels_win_over_other(spark):
    tag = "array<struct<type:string,value:string>>"
    rows = [(0, 0, "a", "k", [("other", "+1"), ("other", "+3")]), (0, 1, "a", "k", [("home", "+1 "), ("work", "+2")]), (0, 2, "a", "k", [("cell", "+1")])]
    df = spark.createDataFrame(rows, f"_file int, _row int, _source string, email string, phone {tag}")
    out = merge(spark, df, (), ("phone",)).first()
    assert [tuple(x) for x in out.phone] == [("home", "+1 "), ("other", "+3"), ("work", "+2")]


def test_hot_key_moves_its_distinct_values_only(spark):
    df = spark.range(5000).select(F.lit(0).alias("_file"), F.col("id").alias("_row"), F.lit("a").alias("_source"), F.lit("k").alias("email"), (F.col("id") % 3).cast("string").alias("company"))
    out = merge(spark, df).collect()
    assert len(out) == 1 and out[0].company == ["0", "1", "2"] and out[0]._rows == 5000


# ---- enrichment


def test_enrichment_fills_nulls_from_the_first_row(spark):
    left = spark.createDataFrame([(1, "London", None), (2, "Paris", "own"), (3, "Rome", None), (4, None, None)], "i int, city string, note string")
    ref = spark.createDataFrame([(0, " london!", "one", 1), (1, "London", "two", 2), (2, "Paris", "three", 3)], "_row int, town string, note string, pop int")
    found = enrich.reference(ref, F.col("town"), "city", ["note", "pop"], ["_row"])
    out = {x.i: x for x in enrich.enrich(left, F.col("city"), "city", found, ["note", "pop"]).collect()}
    assert [(out[i].note, out[i].pop, out[i]._gained) for i in (1, 2, 3, 4)] == [("one", 1, True), ("own", 3, True), (None, None, False), (None, None, False)]


# ---- matching


def keyed(spark, rows, start=0):
    return match.keyed(spark.createDataFrame([(i + start, k) for i, k in enumerate(rows)], "seq int, k string"), F.col("k"), "full_name", "seq")


def test_best_matches(spark):
    a = keyed(spark, ["harborview bank", "small ring", "acme", "", "beta llc"])
    b = keyed(spark, ["harborview bnk", "ring small", "acme", "acme", "gamma", "harborvew bank"])
    pairs = {x.a_seq: (x.b_seq, round(x.sim, 3)) for x in match.best_matches(a, b).collect()}
    assert pairs == {0: (0, 0.966), 2: (2, 1.0)}
    assert tuple(match.report(a, 6, match.best_matches(a, b), 5).first()) == (5, 6, 4, 2, 1, 2, 4)
    assert [x.a_seq for x in match.shown(match.best_matches(a, b)).collect()] == [0, 2]
    assert match.best_matches(a, b.limit(0)).count() == 0


def test_linking_is_transitive(spark):
    match.checkpoint_folder(spark)
    names = ["abcdefghij", "abcdefghix", "abcdefghxx", "abcdefgxxx", "other", "other"]
    rows = match.union_rows([("a", keyed(spark, names)), ("b", keyed(spark, ["abcdefghij", "zz"], 100))])
    out = match.linked(rows, 0.9)
    got = {x.seq: (x.entity_id, x.size, x.n_sources) for x in out.collect()}
    assert {got[i] for i in (0, 1, 2, 3, 100)} == {("E-0001", 5, 2)}
    assert got[4] == got[5] == ("E-0002", 2, 1) and got[101] == ("E-0003", 1, 1)
    assert [tuple(x) for x in match.clusters(out).collect()][0][0] == "E-0001"


def test_join_keys(spark):
    a = spark.createDataFrame([("a@x", "NO", "1"), ("b@x", "NO", "2")], "email string, country string, amount string")
    out = match.join_keys(a, a, [("amount", "numeric"), ("country", "enum"), ("email", "identifier")]).collect()
    assert [(x.field, x.uniqueness) for x in out] == [("email", 1.0), ("country", 0.5), ("amount", 1.0)]


# ---- facets, tags, partitions, vectors


def test_facets_keep_first_seen_order(spark):
    df = spark.createDataFrame([(0, "b", ["x", "y"]), (1, "a", ["x"]), (2, None, None)], "i int, f string, l array<string>")
    out = facets.facets(facets.counts(df, ["f", "l"], "i", ["l"]), 2).orderBy("field", "rank").collect()
    assert [(x.field, x.value, x.n) for x in out] == [("f", "b", 1), ("f", "a", 1), ("l", "x", 2), ("l", "y", 1)]
    wide = facets.facets(facets.counts(df, ["f", "l"], "i", ["l"]), 1).collect()
    assert all(x.value is None and x.distinct_values == 2 for x in wide)
    assert [x.i for x in facets.page(df, ["i"], 2, 2).collect()] == [2] and facets.page(df, ["i"], 0, 0).count() == 1


def test_keywords(spark):
    df = spark.createDataFrame([(1, "The open-plan kitchen; an open-plan 'kitchen' and a garden"), (2, None)], "i int, t string")
    out = tags.keywords(df, "i", F.col("t"))
    got = [(x.keyword, x.weight) for x in out.orderBy("rank").collect()]
    assert got == [("open-plan kitchen", 4), ("kitchen", 2), ("kitchen garden", 2), ("kitchen open-plan", 2), ("open-plan", 2), ("garden", 1)]
    lists = tags.tag_lists(out, "i").select(tags.highlighted(F.col("tags"), "garden", 2).alias("t")).first()
    assert lists.t == ["kitchen garden", "open-plan kitchen"]


def test_partition_plan(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 29)).alias("f"), F.col("id").cast("string").alias("u"))
    v = partitions.verdict(partitions.histogram(df, "f"), "f").first()
    assert v.verdict == "PARTITION_KEY" and v.cardinality == 30
    assert partitions.verdict(partitions.histogram(df, "u"), "u").first().verdict == "FACET_ONLY"
    assert partitions.deal([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    rows = partitions.balance(partitions.buckets(df, "f")).collect()
    assert sum(x.rows for x in rows) == 4000 and len(rows) == 2


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, []), (4, None)], "i int, v array<float>")
    assert [(x.i, x.score) for x in vectors.top_k(df, F.col("v"), [1.0, 0.0], "i", 2).collect()] == [(0, 1.0), (1, 0.6)]
    assert vectors.gated(vectors.scored(df, F.col("v"), [-1.0, 0.0])).count() == 0
    own = vectors.embedded(spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "a")], "i int, t string"), "t", lambda: vectors.HashEmbedder(8))
    got = {x.i: x.vector for x in own.collect()}
    assert got[1] == got[4] and len(got[1]) == 8 and got[2] is None and got[3] is None


def test_lsa_and_fusion(spark):
    docs = spark.createDataFrame([(0, "red apple tree"), (1, "green apple tree"), (2, "blue car road"), (3, "fast car road")], "i long, t string")
    v = {x.seq: x.v for x in vectors.lsa(docs, "i", "t", 2).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert dot(0, 1) > 0.9 and dot(2, 3) > 0.9 and abs(dot(0, 2)) < 0.1
    a, b = (spark.createDataFrame(r, "k int, rank int") for r in ([(1, 1), (2, 2)], [(2, 1)]))
    assert [x.k for x in vectors.fused([a, b], "k").collect()] == [2, 1]


def test_extraction(spark):
    class Model:
        def complete(self, prompt):
            if "fail" in prompt:
                raise OSError
            return json.dumps({"mood": "good", "stars": 4.7, "ok": True, "none": "null"})

    df = spark.createDataFrame([(1, "x", "old"), (2, "fail", "old"), (3, None, "old")], "i int, t string, mood string")
    specs = [extract.Attribute("mood"), extract.Attribute("stars", "long"), extract.Attribute("ok", "boolean"), extract.Attribute("none")]
    out = {x.i: x for x in extract.extract(df, "t", specs, Model).collect()}
    assert (out[1].mood, out[1].stars, out[1].ok, out[1].none) == ("good", 4, True, None)
    assert out[2].mood is None and out[3].stars is None
    assert extract.best_sentence("Cats like milk. Dogs run. Cats like warm milk.") in ("Cats like milk.", "Cats like warm milk.")
    assert extract.best_sentence("") is None


# ---- sources and sinks


@pytest.mark.parametrize("line, mark", [("a,b", ","), ("a\tb", "\t"), ("a;b;c,d", ";"), ("a|b", "|"), ('"x;y;z",b', ","), ("single", ",")])
def test_sniff(line, mark):
    assert files.sniff(line) == mark


def test_csv(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('\n"Name, full";Note\n "Ann";"said ""hi""\nthere"\n\nBob;  \n')
    df = files.read_csv(spark, str(p))
    rows = df.orderBy(files.ROW).collect()
    assert df.columns == ["Name, full", "Note", files.ROW] and rows[0]["Note"] == 'said "hi"\nthere' and rows[1]["Note"] is None
    assert files.samples(str(tmp_path)) == ["in.csv"] and files.confined(str(tmp_path), "in.csv") == p.resolve()
    with pytest.raises(ValueError):
        files.confined(str(tmp_path), "../x.csv")
    assert files.random_rows(df, 0.5, 1).count() == 1 and files.first_rows(df, [files.ROW], 1).count() == 1


def test_schemas_and_bulk(spark):
    own = [shapes.Shape("phone", "array", "semantic", "identifier", ("a", "b"), ("x", "y")), shapes.Shape("day", "scalar", "single", "date", ("d",), (None,))]
    m = sinks.mapping(own)["mappings"]["properties"]
    assert m == {"phone": {"properties": {"type": {"type": "keyword"}, "value": {"type": "keyword"}}}, "day": {"type": "date"}}
    s = sinks.json_schema(sinks.mapping(own), frozenset({"phone"}), "t")
    assert s["properties"]["phone"]["type"] == "array" and s["properties"]["phone"]["items"]["type"] == "object"
    assert s["properties"]["day"] == {"type": "string", "format": "date"} and s["additionalProperties"] is False
    assert sinks.json_schema({"mappings": {"properties": sinks.vector_mapping("v", 3)}}, frozenset(), "t")["properties"]["v"]["maxItems"] == 3
    assert sinks.table_name("My  Big-Set!") == "col_my_big_set"
    line = sinks.bulk_lines(spark.createDataFrame([(1, None)], "i int, t string"), "x", F.col("i")).first().value
    assert [json.loads(x) for x in line.split("\n")] == [{"index": {"_index": "x", "_id": "1"}}, {"i": 1}]


def test_tables_as_indexes(spark):
    assert sinks.write_index(spark.range(3), "col_test_one") == 3
    sinks.write_index(spark.range(1), "kt_test_two")
    assert sinks.orphans(spark, ["col_test_one"]) == ["kt_test_two"]
    assert sinks.delete_orphans(spark, []) == ["col_test_one", "kt_test_two"] and sinks.list_indexes(spark, "*test*") == []


def test_plans_of_hot_spots(spark, tmp_path):
    """Profiles rank before the shuffle, page and top-k queries keep k rows a task, filters reach the scan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = table(spark, ["v"], [("1",)])
    assert "WindowGroupLimit" in plan(profile.measures(profile.cells(df, [files.ROW])))
    assert "TakeOrderedAndProject" in plan(facets.page(spark.range(100).repartition(3), ["id"], 2, 5))
    spark.range(10).selectExpr("id", "id * 1.5D AS x", "id AS y").write.mode("overwrite").parquet(str(tmp_path / "t"))
    scan = plan(spark.read.parquet(str(tmp_path / "t")).where(filters.scanned(F.col("x"), "3-9", "num")).select("id"))
    assert "GreaterThanOrEqual(x,3.0)" in scan and "ReadSchema: struct<id:bigint,x:double>" in scan
    v = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "i int, v array<float>")
    assert "TakeOrderedAndProject" in plan(vectors.top_k(v, F.col("v"), [1.0], "i", 2))
