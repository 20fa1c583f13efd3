"""The queries that go through files, datasets and collections against DuckDB, and the parts of the plans that scale."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork import collection_queries
from loomwork.functions.similarity import in_common, letter_bits, ratio
from loomwork.operators import match, tags, vectors
from loomwork.plans.collection import Collection
from loomwork.sources import files

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(collection_queries.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = collection_queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(collection_queries.ORACLE_SQL[name])
    at = [c[0] for c in found.description]
    assert names == sorted(at)
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def test_characters_in_common_are_never_too_few(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aabbcçdeé 0159XYZ😀漢") for _ in range(r.randint(0, 40)))
    rows = [(word(), word()) for _ in range(400)] + [("", "x"), ("aaaaaaaaaa", "aaaaaaa")]
    d = spark.createDataFrame(rows, "a string, b string").withColumns({"x": letter_bits(F.col("a")), "y": letter_bits(F.col("b"))})
    for row in d.withColumn("n", in_common(F.col("x"), F.col("y"))).collect():
        both = (Counter(row.a) & Counter(row.b)).total()
        assert both <= row.n <= min(len(row.a), len(row.b))


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_near_pairs_lose_no_match(spark, threshold, monkeypatch):
    monkeypatch.setattr(match, "KEYS_A_PART", 5)  # a grid of many parts
    r = random.Random(9)
    base = ["".join(r.choice("abcdefg ") for _ in range(r.randint(2, 25))).strip() or "x" for _ in range(30)]
    near = lambda: (lambda w, k: w[:k] + r.choice(["", "q", "z"]) + w[k + r.randint(0, 1) :])(r.choice(base), r.randint(1, 6))
    keys = [[*dict.fromkeys(near() for _ in range(70))] for _ in range(2)]
    frame = lambda own: match.keyed(spark.createDataFrame(list(enumerate(own)), "seq long, key string"), F.col("key"), "other", "seq")
    a, b = map(frame, keys)
    ka, kb = ({x.seq: (x.k, x.s) for x in df.collect()} for df in (a, b))
    sim = lambda x, y: 1.0 if x[0] == y[0] else max(ratio(x[0], y[0]), ratio(x[1], y[1]))
    want = {}
    for i, x in ka.items():
        scores = [(sim(x, y), -j) for j, y in kb.items() if x[0][0] == y[0][0]]
        if scores and max(scores)[0] >= threshold:
            want[i] = (-max(scores)[1], round(max(scores)[0], 9))
    got = {x.a_seq: (x.b_seq, round(x.sim, 9)) for x in match.best_matches(a, b, threshold).collect()}
    assert got == want


def test_keywords_are_counted_in_the_row(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Garden", "pond", "the", "old-tree", "it", "house's", "a1b"]) for _ in range(r.randint(0, 60)))) for i in range(40)] + [(99, None), (98, "")]
    out = {}
    for x in tags.keywords(spark.createDataFrame(rows, "i long, t string"), "i", F.col("t")).collect():
        out.setdefault(x.i, []).append((x["rank"], x.keyword, x.weight))
    for i, t in rows:
        w = [x for x in (t or "").lower().split() if x not in ("the", "it")]
        n = Counter(w)
        for a, b in zip(w, w[1:]):
            n[f"{a} {b}"] += 2
        want = sorted(n.items(), key=lambda x: (-x[1], x[0]))[: tags.TOP]
        assert sorted(out.get(i, [])) == [(k, w, c) for k, (w, c) in enumerate(want, 1)]


def test_nearest_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, [round(r.uniform(-1, 1), 2) for _ in range(4)]) for i in range(90)] + [(90 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(9)] + [(200, None), (201, [])]
    d = spark.createDataFrame(rows, "seq long, v array<double>")
    q = d.where("seq % 10 = 0").select(F.col("seq").alias("q"), "v")
    want = {}
    for i, v in rows:
        if i % 10 == 0 and v:
            own = sorted((-round(math.fsum(a * b for a, b in zip(v, w)), 12), j) for j, w in rows if w and j != i)
            want[i] = [j for _, j in own[:5]]
    for size in (4096, 7):
        monkeypatch.setattr(vectors, "ROWS_A_BLOCK", size)
        monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 3 if size == 7 else 1024)
        got = {}
        for x in vectors.nearest_labels(d, q, 5).orderBy("q", "rank").collect():
            got.setdefault(x.q, []).append(x.seq)
        assert got == want


def test_tags_totals_and_pages_of_a_collection(spark):
    text = "a long note about a garden with many flowers and a pond and a big old tree beside it near the {} house"
    rows = [{"email": f"u{i}@x", "notes": text.format("red house red" if i % 2 else "blue")} for i in range(7)]
    c = Collection("n").add("a", files.from_rows(spark, ["email", "notes"], rows))
    assert c.total(tag="red house").first()[0] == 3 and c.search(tag="red house", size=2, page=2).count() == 1
    assert c.total("garden").first()[0] == 7 and c.total(tag="nothing").first()[0] == 0
    assert c.roll_up() == [("description", "text", "scalar", 1, False), ("email", "keyword", "scalar", 1, False)]


def test_a_folder_must_be_given_on_a_cluster(spark):
    from loomwork.sources import folders

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        folders.shared_folder(Session())
