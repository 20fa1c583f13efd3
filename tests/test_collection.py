import pytest
from pyspark.sql import functions as F

from loomwork.plans.collection import Collection
from loomwork.plans import linkage
from loomwork.plans.dataset import Dataset
from loomwork.sources.files import from_rows
from loomwork.streaming import ingest


def table(spark, headers, rows):
    return from_rows(spark, headers, [dict(zip(headers, r)) for r in rows])


def two_files(spark):
    a = table(spark, ["Email", "Phone", "Company"], [("a@x.com", "+1-111-0000", "Acme"), ("b@x.com", None, "Beta")])
    b = table(spark, ["mail", "phone_home", "phone_work", "Org"], [("A@X.com", "+1-111-0000", "+1-222-0000", "Acme Corp"), (None, "+1-3", "+1-4", "Lone")])
    return Collection("crm").add("a.csv", a).add("dir/b.csv", b)


def test_files_merge_into_entities(spark):
    c = two_files(spark)
    assert c.schema()["phone"]["cardinality"] == "array" and c.schema()["company"]["sources"] == ["a", "b"]
    out = {x._key: x for x in c.merged().collect()}
    assert [tuple(p) for p in out["a@x.com"].phone] == [("home", "+1-111-0000"), ("work", "+1-222-0000")]
    assert out["a@x.com"].company == ["Acme", "Acme Corp"] and out["a@x.com"]._source_file == ["a", "b"]
    assert tuple(c.detail().first()) == (4, 3, 1)
    assert c.conflicts().first()["company"] == 1
    with pytest.raises(ValueError):
        c.add("b.csv", table(spark, ["x"], []))


def test_search_filters_sources_and_paging(spark):
    c = two_files(spark)
    assert [x._key for x in c.search("corp acme").collect()] == ["a@x.com"]
    assert [x._key for x in c.search(where=[("company", "beta")]).collect()] == ["b@x.com"]
    assert c.search(where=[("phone", "+1-222-0000")]).count() == 1 and c.search(where=[("nowhere", "x")]).count() == 0
    assert c.search(sources=["b.csv"]).count() == 2 and c.search(page=2, size=2).count() == 1


def test_key_change_override_and_custom_lists(spark):
    a = table(spark, ["email", "firm", "likes", "size"], [("a@x", "Acme", "golf; wine", "100"), ("b@x", "ACME", "wine|cooking", "200")])
    c = Collection("x").add("a", a)
    assert c.detail().first()["entities"] == 2
    c.rekey("company")
    assert tuple(c.detail().first()) == (2, 1, 1)
    c.rekey("email").add_canonical("hobby", "keyword", True).override("likes", "hobby").add_canonical("deal_size", "double").override("size", "deal_size")
    assert c.search(where=[("hobby", "wine")]).count() == 2 and c.search(where=[("hobby", "cooking")]).count() == 1
    assert c.search(where=[("deal_size", ">150")]).count() == 1
    c.remove_canonical("hobby")
    assert "hobby" not in c.schema()


def test_transform_enrich_geo_and_segments(spark):
    a = table(spark, ["email", "town"], [("a@x", "London"), ("b@x", "New York"), ("c@x", "Nowhere")])
    ref = table(spark, ["city", "coordinates"], [("london", "51.5074,-0.1278"), ("New York", "40.7128,-74.0060"), ("London", "0.5,0.5"), ("Paris", "48.85,2.35"), ("Rome", "41.90,12.49")])
    c = Collection("geo").add("a", a).transform("Shout", "upper(town)").enrich("cities", ref, "city")
    assert c.search(box=(50, -1, 52, 1)).select("_key").first()[0] == "a@x" and c.search(box=(50, -1, 52, 1)).count() == 1
    east = [(38.0, -80.0), (38.0, -70.0), (45.0, -70.0), (45.0, -80.0)]
    assert [x._key for x in c.search(ring=east).collect()] == ["b@x"]
    assert c.search(where=[("shout", "LONDON")]).count() == 1
    c.segment("brits", [("city", "london")]).segment("all", [])
    assert {x.segment: x.n for x in c.segment_counts().collect()} == {"brits": 1, "all": 3}
    other = Collection("other").add("o", table(spark, ["email", "city"], [("z@x", "New York")])).enrich("geo", c, "city")
    assert other.entities().columns and other.entities().count() == 1
    with pytest.raises(ValueError):
        c.enrich("self", c, "city")
    c.remove_enrichment("cities").remove_segment("all").transform("Shout", "")
    assert "location" not in c.entities().columns and "shout" not in c.schema()


def test_reindex_and_view(spark):
    text = "a long note about a garden with many flowers and a pond and a big old tree beside it"
    c = Collection("Notes Set").add("a", table(spark, ["email", "notes"], [("a@x", text), ("b@x", text + " garden")]))
    assert c.reindex() == 2 and spark.table(c.index_name()).where(F.array_contains("_tags", "garden")).count() >= 1
    assert c.index_mapping()["mappings"]["properties"]["_tags"] == {"type": "keyword"} and c.spec()["files"] == ["a"]
    c.register("notes")
    assert spark.sql("SELECT count(*) FROM notes").first()[0] == 2
    assert c.facets().count() >= 1 and c.keywords().count() > 0
    spark.sql(f"DROP TABLE {c.index_name()}")


def test_dataset(spark):
    rows = [(f"n{i}", str(i * 10), f"2024-01-{i + 1:02d}", "x" if i % 2 else "y") for i in range(20)]
    d = Dataset.load(table(spark, ["name", "price", "created", "group"], rows))
    assert d.names["price"] == ("amount", "alias") and d.escalations == 0
    assert d.search(where=[("amount", "50-70")]).count() == 3 and d.search("n19").count() == 1
    assert d.search(where=[("date", "2024-01-01..2024-01-03")]).count() == 3
    assert {(x.field, x.value, x.n) for x in d.facets().where("field = 'group'").collect()} == {("group", "x", 10), ("group", "y", 10)}
    assert tuple(d.quality().first()) == (0, 0) and d.json_schema("t")["properties"]["amount"] == {"type": "number"}
    assert '"range"' in d.query_json("q", [("amount", ">5")])


def test_matching_and_linking_datasets(spark):
    a = Dataset.load(table(spark, ["company", "city"], [(f"harborview bank {i}{i}", "Oslo") for i in range(5)] + [("lone", "Bergen")]))
    b = Dataset.load(table(spark, ["organization", "town"], [(f"harborview bnk {i}{i}", "oslo") for i in range(5)] + [("other", "Rome")]))
    m = linkage.pair_up(a, b)
    assert m.key == "company" and m.report.first()["matched"] == 5
    row = m.shown.where("a_seq = 0").first()
    assert row.a.company == "harborview bank 00" and row.b.city == "oslo"
    assert linkage.link_keys([a, b]).first()["field"] == "company"
    out = linkage.link([("a", a), ("b", b)], "company", 0.95)
    assert out.where("n_sources = 2").count() == 10 and linkage.flattened(out).count() == 7


def test_saved_spec(spark, tmp_path):
    from loomwork.sources import sinks

    c = two_files(spark).segment("s", [("company", "beta")]).transform("up", "upper(Company)")
    sinks.save_spec(c.spec(), str(tmp_path / "spec.json"))
    tables = dict(c.files)
    again = Collection.restored(sinks.load_spec(str(tmp_path / "spec.json")), tables.get)
    assert again.spec() == c.spec() and again.detail().first() == c.detail().first()


def test_stream_merges_batches_once(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "i long, email string, company string"
    spark.createDataFrame([(0, "A@x", "Acme"), (1, "b@x", "Beta")], schema).write.parquet(str(source / "1"))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
    run = lambda: ingest.start(stream(), folder, "email", "email", ["company"], "i").awaitTermination()
    run()
    spark.createDataFrame([(2, "a@X", "Acme Corp"), (3, "a@x", "Acme")], schema).write.parquet(str(source / "2"))
    run()
    out = {x._key: x.company for x in ingest.entities(ingest.latest(spark, folder, 9), ["company"]).collect()}
    assert out == {"a@x": ["Acme", "Acme Corp"], "b@x": ["Beta"]}
