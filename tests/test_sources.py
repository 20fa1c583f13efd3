import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.operators import facets, partitions, shapes, vectors
from loomwork.sources import files, sinks


def test_ranked_rows_do_not_depend_on_how_files_are_split(spark, tmp_path):
    for name, first in (("b", 500), ("a", 0), ("c", 900)):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        rows = "\n".join(f"{first + i},{'x' * (i % 40)}" for i in range(400 if name != "a" else 500))
        (folder / f"{name}.csv").write_text("n,t\n" + rows + "\n")
    found = []
    for size in ("134217728", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = files.read_csv(spark, str(tmp_path / "in"), multi_line=False, ranked=True)
        found.append([(x._row, int(x.n), x.t) for x in df.orderBy("_row").collect()])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and [x[0] for x in found[0]] == list(range(1300)) and [x[1] for x in found[0]] == list(range(1300))
    assert found[0][0][2] is None and found[0][3][2] == "xxx"


def test_excel_through_pandas(spark, monkeypatch):
    sheet = pd.DataFrame({"Name": ["Ann", None, " "], "Size": ["1", "2", None]}, dtype=object)
    monkeypatch.setattr(pd, "read_excel", lambda path, sheet_name, dtype: sheet if (path, sheet_name) == ("x.xlsx", "S") else None)
    out = files.read_excel(spark, "x.xlsx", "S").orderBy("_row").collect()
    assert [tuple(x) for x in out] == [("Ann", "1", 0), (None, "2", 1), (None, None, 2)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "t": " "}\n{"t": "x", "more": 2}\n')
    out = files.read_json(spark, str(tmp_path / "a.json"), "n long, t string").orderBy("_row").collect()
    assert [(x.n, x.t) for x in out] == [("1", None), (None, "x")]


def test_tables_over_jdbc(spark):
    options = {"url": "jdbc:derby:memory:loomwork;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "people"}
    try:
        spark._jvm.java.lang.Class.forName(options["driver"])
    except Exception:
        pytest.skip("no embedded database in this Spark")
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    rows.write.format("jdbc").options(**options).mode("overwrite").save()
    assert files.read_jdbc(spark, options).count() == 20
    new = files.read_jdbc(spark, options, since=("id", "16"))
    assert sorted(x[0] for x in new.collect()) == [17, 18, 19]


def test_exports_and_bulk_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", ["x", "y"], None), (2, 'b"q', [], {"k": "v"})], "id long, t string, l array<string>, m map<string,string>")
    sinks.export(d, str(tmp_path / "csv"), "csv")
    back = {x.id: x for x in spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).collect()}
    assert json.loads(back["1"].l) == ["x", "y"] and back["1"].m is None and back["2"].t == 'b"q'
    sinks.export(d, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_bulk(d, "col_x", F.col("id"), str(tmp_path / "bulk"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "bulk")).collect()]
    assert len(lines) == 4 and sorted(json.loads(x)["index"]["_id"] for x in lines if '"index"' in x) == ["1", "2"]


def test_bucketed_table_reads_one_bucket(spark, tmp_path):
    d = spark.createDataFrame([(i, f"v{i % 9}") for i in range(900)], "id long, v string")
    partitions.write_bucketed(d, "v", str(tmp_path / "t"))
    plan = {x.value: x.bucket for x in partitions.buckets(d, "v").collect()}
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 900 and all(plan[x.v] == x.bucket for x in back.select("v", "bucket").distinct().collect())


def test_columns_to_show():
    own = [shapes.Shape(c, "scalar", "single", k, (c,), (None,)) for c, k in (("zeta", "enum"), ("email", "identifier"), ("notes", "free_text"), ("company", "enum"), ("alpha", "numeric"))]
    assert facets.dataset_columns(own) == ["company", "email", "alpha", "zeta"] and facets.dataset_columns(own, 3) == ["company", "email", "alpha"]
    assert facets.collection_columns(["zeta", "date", "email"]) == ["_source_file", "name", "email", "date", "zeta"]


def test_vectors_of_an_embedder_or_lsa(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["red house", "red house", "blue tree", "old blue tree"])], "seq long, text string")
    neural = {x.seq: x.v for x in vectors.vectors_or_lsa(d, "seq", "text", lambda: vectors.HashEmbedder(8)).collect()}
    assert neural[0] == neural[1] != neural[2] and len(neural[3]) == 8
    lsa = {x.seq: x.v for x in vectors.vectors_or_lsa(d, "seq", "text", vectors.NoEmbedder, 2).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(lsa[a], lsa[b]))
    assert dot(0, 1) > 0.999 and dot(2, 3) > 0.8 and abs(dot(0, 2)) < 0.2
