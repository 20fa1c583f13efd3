import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import columns, dsl, filters, geo
from loomwork.functions.similarity import common_length, ratio, similarity, sorted_words


def values(spark, rows, expr, schema="v string"):
    """The expression's value for each row, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [x[0] for x in df.orderBy("i").select(expr).collect()]


def test_numbers(spark):
    rows = ["$1,200.50", "€ 5", "-3", "1e3", "n/a", "", None, "1d", "Infinity", "12 34", "0x10"]
    assert values(spark, rows, columns.number(F.col("v"))) == [1200.5, 5.0, -3.0, 1000.0, None, None, None, None, None, 1234.0, None]
    assert values(spark, ["2.5", "-2.5", "2.4"], columns.half_up(columns.number(F.col("v")))) == [3.0, -2.0, 2.0]


def test_dates(spark):
    rows = ["2024-02-03", "2024/02/03", "02/03/2024", "2/3/2024", "13/1/2024", "Feb 3, 2024", "Feb 3 2024", "03-02-2024", "2024-02-03T10:11:12Z", "2024-02-30", "soon"]
    day = "2024-02-03"
    assert values(spark, rows, columns.iso_date(F.col("v"))) == [day, day, day, day, "2024-01-13", day, day, day, day, "2024-02-30", "soon"]
    assert values(spark, [*rows, "20240203", "12"], columns.is_date(F.col("v"))) == [True] * 9 + [False, False, False, False]


def test_blank_and_trim(spark):
    rows = ["", "  ", " \t", " a ", None]
    assert values(spark, rows, columns.blank_to_null(F.col("v"))) == [None, None, None, " a ", None]
    assert values(spark, rows, columns.trimmed(F.col("v"))) == ["", "", "", "a", None]


def test_keys(spark):
    k = lambda c, v: values(spark, [v], columns.key_of(F.col("v"), c))[0]
    assert k("email", " A b@X.com ") == "ab@x.com"
    assert k("phone", "+1 (555) 12-34") == "15551234"
    assert k("company", " Acme,   Inc. ") == "acme inc" and k("company", None) == ""


def test_split_values(spark):
    got = values(spark, ["golf; wine; travel", "wine|cooking", " , ", None, "a/b\na"], columns.split_values(F.col("v")))
    assert got == [["golf", "wine", "travel"], ["wine", "cooking"], [], None, ["a", "b"]]


@pytest.mark.parametrize(
    "expression, row, expected",
    [
        ('to_number(strip(raw,"$,"))', "$1,200.50", "1200.5"),
        ('mul(to_number(strip(raw,"$,")), 3)', "$1,200.50", "3601.5"),
        ("round(raw, 0)", "$1,200.50", "1201"),
        ('split(raw,"/",1)', "a/hot.csv", "hot.csv"),
        ('split(raw,".",0)', "a.b", "a"),
        ('split(raw,"/",9)', "a/b", None),
        ("split(raw)", "a,b", None),
        ("digits(raw)", "+1 555-123-4567", "15551234567"),
        ('regex_extract(raw,"[A-Z]+")', "xx REF 9", "REF"),
        ('regex_extract(raw,"[0-9]+")', "none", None),
        ('regex_replace(raw,"(a)(b)","$2$1")', "xab", "xba"),
        ("substring(raw,1,3)", "hello", "el"),
        ("substring(raw,3,1)", "hello", ""),
        ("substring(raw,-2)", "hello", "hello"),
        ("length(nowhere)", "x", "0"),
        ('concat(raw,"-",nowhere,"\\"q\\"")', "x", 'x-"q"'),
        ('default(nowhere,"d")', "x", "d"),
        ("coalesce(nowhere, raw)", "x", "x"),
        ("div(raw, 0)", "4", None),
        ("add(raw, nowhere)", "4", None),
        ("eq(nowhere, nothing)", "x", "true"),
        ('eq(raw, "x")', " x ", "true"),
        ("gt(raw, 9)", "10", "true"),
        ('gt(raw, "9")', "a", "true"),
        ("lt(nowhere, raw)", "a", "true"),
        ('contains(raw,"ELL")', "hello", "true"),
        ("not(raw)", "0", "true"),
        ('and(raw, "false")', "x", "false"),
        ("or(nowhere, raw)", "x", "true"),
        ('if(gt(raw,5),"big","small")', "7", "big"),
        ("replace(raw)", "abc", None),
        ('replace(raw,"b","$")', "abc", "a$c"),
        ("upper(raw)", None, None),
        ("-2.50", "x", "-2.50"),
    ],
)
def test_transform_language(spark, expression, row, expected):
    assert values(spark, [row], dsl.compiled(expression, {"raw": F.col("v")})) == [expected]


@pytest.mark.parametrize("bad", ["exec(city)", "System.exit(0)", "upper(city", "", "upper(a,)", '"open', "a b", "1 +"])
def test_bad_expressions_do_not_compile(bad):
    with pytest.raises(dsl.BadExpression):
        dsl.parse(bad)


def test_transforms_read_the_original_row(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    out = dsl.transformed(df, {"x": "upper(y)", "New Field!": "concat(x, y)", "gone": " "})
    assert out.columns == ["y", "x", "new_field"] and tuple(out.first()) == ("b", "B", "ab")


@pytest.mark.parametrize(
    "value, kind, rows, expected",
    [
        (">150", "num", ["200", "150", "x"], [True, False, False]),
        ("<= abc", "num", ["1"], [False]),
        ("20-10", "num", ["10", "15", "21"], [True, True, False]),
        ("10..20", "num", ["20"], [True]),
        ("5", "num", ["5.0", "6"], [True, False]),
        ("red", "num", ["RED ", "1"], [True, False]),
        (">= 2024-01-01", "date", ["2024-01-01", "2023-12-31"], [True, False]),
        ("2024-01-01 to 2024-02-01", "date", ["2024-01-15", "2024-03-01"], [True, False]),
        ("2024-02-01..2024-01-01", "date", ["2024-01-15"], [False]),
        (" Acme ", None, ["acme", "acme corp", None], [True, False, False]),
    ],
)
def test_filters(spark, value, kind, rows, expected):
    assert values(spark, rows, filters.matches(F.col("v"), value, kind)) == expected


def test_strict_filters(spark):
    ask = lambda rows, v, kind=None: values(spark, rows, filters.matches(F.col("v"), v, kind, strict=True))
    assert ask(["5.0", "5", "x"], "=5") == [True, True, False]
    assert ask(["2024-01-15"], "2024-02-01..2024-01-01", "date") == [True]
    assert ask(["5.0", "x"], "5") == [True, False] and ask(["a"], "= A") == [True]


def test_filter_takes_any_member(spark):
    got = values(spark, [(["golf", "wine"],), ([],), (None,)], filters.matches(F.col("v"), "Wine", None, True), "v array<string>")
    assert got == [True, False, False]


def test_keyword_search_ignores_order_and_marks(spark):
    rows = ["an open-plan kitchen", "open garage", None]
    assert values(spark, rows, filters.all_terms(F.col("v"), "kitchen open plan")) == [True, False, False]
    assert values(spark, rows, filters.all_terms(F.col("v"), " !")) == [True, True, True]
    assert values(spark, ["the other the", "x"], filters.term_score(F.col("v"), "the")) == [3.0, 0.0]


def test_query_json():
    assert json.loads(filters.query_json("", [], [])) == {"match_all": {}}
    body = json.loads(filters.query_json("q", [("a", ">5"), ("b", "Boston"), ("a", "<= x")], ["t"], ("_tags", "z"), ("_source_file", ""), 3))
    assert body["size"] == 3 and body["query"]["bool"]["must"] == [{"multi_match": {"query": "q", "fields": ["t"]}}]
    assert body["query"]["bool"]["filter"] == [{"range": {"a": {"lte": "x"}}}, {"range": {"b": {"gte": "Bos", "lte": "n"}}}, {"term": {"_tags": "z"}}]


CITIES = ["51.5074,-0.1278", "40.7128 -74.0060", "48.8566, 2.3522", "12,34", "95.0,10.0", None]
EAST = [(38.0, -80.0), (38.0, -70.0), (45.0, -70.0), (45.0, -80.0)]


def test_geo(spark):
    assert values(spark, CITIES, geo.is_point(F.col("v"))) == [True, True, True, False, False, False]
    p = geo.point(F.col("v"))
    assert values(spark, CITIES, geo.in_box(p, 50, -1, 52, 1)) == [True] + [False] * 5
    assert values(spark, CITIES, geo.in_polygon(p, EAST)) == [False, True] + [False] * 4
    assert values(spark, CITIES[:2], geo.in_polygon(p, EAST[:2])) == [False, False]
    both = [(["1.0,1.0", "40.7,-74.0"],), (["1.0,1.0"],)]
    assert values(spark, both, geo.matches(F.col("v"), None, EAST), "v array<string>") == [True, False]
    concave = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    assert values(spark, ["2.0,2.0", "5.0,8.0", "8.5,7.0"], geo.in_polygon(p, concave)) == [True, False, True]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity(spark):
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert common_length(a, b) == brute_lcs(a, b)
        exact = ratio(a, b)
        assert ratio(a, b, 0.8) == exact or exact < 0.8
    rows = [("kitten", "sitting"), ("john smith", "smith john"), ("same", "same"), ("abc", "xyz")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"s": sorted_words(F.col("a")), "t": sorted_words(F.col("b"))})
    got = [x[0] for x in df.select(similarity()("a", "b", "s", "t")).collect()]
    assert got == [8 / 13, 1.0, 1.0, 0.0]
