"""Mixing to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed for each cell (source, language, topic). A factor for each level of each dimension is raked until
the weighted token shares have the target marginals; a cell's weight is the product of its three factors. Documents
are kept with probability weight / largest weight, so the expected token shares are exactly the raked ones.

Where that would keep less than LEAST_KEPT of the tokens (a rare level has a large weight and would decide how much of
all else goes), probabilities are raked with the bound 1 instead, towards that kept share: levels too small for their
target are kept whole, and the others take up what is left in the proportions of their targets.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import discard, restored, shielded, stage

DIMENSIONS = ("source", "language", "topic")
#: Target share of a level: its share of tokens to this power, normalised (1 keeps the shares, 0 makes levels equal).
POWERS = {"source": 0.7, "language": 0.8, "topic": 0.9}
SWEEPS, TOLERANCE = 40, 1e-11
#: A share further than this from its target is reported: the targets contradict each other, or need more sweeps.
STRAYED = 1e-4
#: The least expected share of all tokens that is kept.
LEAST_KEPT = 0.4
SEED = "mix"
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: A coarse topic told from the form of a text, in SQL that Spark and DuckDB share. Another column may be passed instead.
TOPIC_SQL = """CASE WHEN text IS NULL OR text = '' THEN 'empty'
 WHEN text LIKE '%icens%' OR text LIKE '%ights reserved%' THEN 'legal'
 WHEN text LIKE '%@%' THEN 'contact'
 WHEN text LIKE '% | %' THEN 'tabular'
 WHEN length(text) >= 20000 THEN 'book'
 WHEN length(text) >= 2000 THEN 'article'
 ELSE 'note' END"""


def uniform(seed: str = SEED) -> Column:
    """A number in [0, 1) from doc_id; the same for the same id, whatever the partitions."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed(docs: DataFrame, language: str = "lang", topic: Column | None = None) -> DataFrame:
    """docs with _source, _language, _topic (nulls are a level of their own) and _tokens (words; at least 1)."""
    level = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.withColumns(
        {
            "_source": level(F.col("source")),
            "_language": level(F.col(language)),
            "_topic": level(F.expr(TOPIC_SQL) if topic is None else topic),
            "_tokens": F.greatest(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long"),
        }
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(level, target) of a dimension: token shares to the given power, normalised."""
    t = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("t").alias("all")))).select(  # one row
        F.col(dimension), (F.col("t") / F.col("all")).alias("target")
    )


#: Level tables are written in one file for so many cells.
CELLS_A_FILE = 1_000_000


#: Up to so many cells are raked as arrays in one row; more as tables, a small job for each step.
CELLS_IN_A_ROW = 20_000


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, in_a_row: int = CELLS_IN_A_ROW
) -> DataFrame:
    """cells (source, language, topic, tokens) with ``weight``: the product of the factors that meet the targets.

    targets: for each dimension (level, target). Levels that no cell has get factor 0; so do cells without a target.
    Where targets contradict each other (a level that lies wholly inside a smaller one) raking ends after ``sweeps``, and
    the last dimension's targets are the ones that hold; ``calibrated`` warns of it.
    """
    n = cells.count()
    factors = (_factors_in_a_row if n <= in_a_row else _factors_in_tables)(cells, targets, sweeps, tolerance, n)
    out = cells
    for d in DIMENSIONS:
        out = out.join(factors[d].select(d, d[0]), d)
    return out.select(*DIMENSIONS, "tokens", (F.col("s") * F.col("l") * F.col("t")).alias("weight"))


def _factors_in_a_row(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float, n: int) -> dict[str, DataFrame]:
    """The factors by higher-order functions over one row: for each dimension the cells of each of its levels."""
    level = lambda d: f"{d[0]}_at"
    own, row = cells, None
    for d in DIMENSIONS:  # levels in order, numbered from 1
        whole = targets[d].agg(F.array_sort(F.collect_list(F.struct(F.col(d).alias("name"), F.col("target").cast("double").alias("target")))).alias("levels"))
        numbers = whole.select(F.posexplode("levels").alias("at", "level")).select((F.col("at") + 1).alias(level(d)), F.col("level.name").alias(d))
        own = own.join(numbers, d)
        row = whole.select(F.col("levels").alias(f"{d}_levels")) if row is None else row.crossJoin(whole.select(F.col("levels").alias(f"{d}_levels")))  # one row each
    own = stage(own.select(*map(level, DIMENSIONS), F.col("tokens").cast("double").alias("n")).coalesce(1), "numbered")
    for d in DIMENSIONS:
        a, b = (level(x) for x in DIMENSIONS if x != d)
        lists = own.groupBy(F.col(level(d)).alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "n"))).alias("own"))
        both = lists.agg(F.map_from_entries(F.collect_list(F.struct("at", "own"))).alias("lists"))
        row = row.crossJoin(both.withColumnRenamed("lists", f"{d}_lists"))  # one row each
    for d in DIMENSIONS:
        cells_of = F.transform(f"{d}_levels", lambda x, i: F.coalesce(F.try_element_at(F.col(f"{d}_lists"), i + 1), F.array().cast("array<struct<a:int,b:int,n:double>>")))  # noqa: B023
        row = row.withColumn(f"{d}_cells", cells_of)
    row = stage(row.select(*[f"{d}_{x}" for d in DIMENSIONS for x in ("levels", "cells")]), "row")

    def stepped(state, k):
        def new(d: str):
            a, b = (state[x[0]] for x in DIMENSIONS if x != d)
            summed = lambda own: F.aggregate(own, F.lit(0.0), lambda s, c: s + c["n"] * F.element_at(a, c["a"]) * F.element_at(b, c["b"]))
            return F.transform(f"{d}_levels", lambda x, i: F.coalesce(F.try_divide(x["target"], summed(F.element_at(F.col(f"{d}_cells"), i + 1))), F.lit(0.0)))

        return F.struct(*[F.when(k % 3 == j, new(d)).otherwise(state[d[0]]).alias(d[0]) for j, d in enumerate(DIMENSIONS)])

    start = F.struct(*[F.transform(f"{d}_levels", lambda x: F.lit(1.0)).alias(d[0]) for d in DIMENSIONS])
    done = row.withColumn("state", F.aggregate(F.sequence(F.lit(0), F.lit(3 * sweeps - 1)), start, stepped))
    done = stage(done.select("state", *[f"{d}_levels" for d in DIMENSIONS]), "factors")
    zipped = lambda d: F.explode(F.arrays_zip(F.transform(f"{d}_levels", lambda x: x["name"]).alias("name"), F.col(f"state.{d[0]}").alias("factor")))
    return {d: done.select(zipped(d).alias("x")).select(F.col("x.name").alias(d), F.col("x.factor").alias(d[0])) for d in DIMENSIONS}


def _factors_in_tables(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float, n: int) -> dict[str, DataFrame]:
    """The factors by sums over the cells weighted by the other two factors. Each step writes its level table, so plans stay
    small; level tables are small next to the cells, and Spark decides by their size whether to broadcast them."""
    files = max(1, -(-n // CELLS_A_FILE))
    cells = cells.coalesce(files)
    factors = {d: stage(t.select(d, "target", F.lit(1.0).alias(d[0])).coalesce(files), f"f-{d}") for d, t in targets.items()}
    for _ in range(sweeps):
        for d in DIMENSIONS:
            a, b = (x for x in DIMENSIONS if x != d)
            weighed = cells.join(factors[a].select(a, a[0]), a).join(factors[b].select(b, b[0]), b)
            sums = weighed.groupBy(d).agg(F.sum(F.col("tokens") * F.col(a[0]) * F.col(b[0])).alias("sum"))
            old = factors[d]
            new = old.select(d, "target", F.col(d[0]).alias("before")).join(sums, d, "left")
            new = new.select(d, "target", F.coalesce(F.try_divide("target", "sum"), F.lit(0.0)).alias(d[0]), "before")
            factors[d] = stage(new.coalesce(files), f"f-{d}")
            discard(old)
        moved = factors["source"].agg(F.max(F.abs(F.try_divide("s", "before") - 1))).first()[0]
        if moved is None or moved < tolerance:
            break
    return factors


def strayed(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a level's weighted share and its target."""
    worst = None
    for d in DIMENSIONS:
        sums = raked.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("sum"))
        all_ = sums.agg(F.sum("sum").alias("all"))
        own = targets[d].join(sums, d).crossJoin(F.broadcast(all_))  # one row
        own = own.agg(F.max(F.abs(F.try_divide("sum", "all") - F.col("target"))).alias("off"))
        worst = own if worst is None else worst.unionByName(own)
    return worst.agg(F.max("off")).first()[0] or 0.0


def goals(cells: DataFrame, targets: DataFrame, dimension: str, kept: float) -> DataFrame:
    """(level, goal): tokens to keep of each level, ``kept`` in all: shares of the targets, but no more than a level has."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("n")).join(targets, dimension)
    own = stage(own.select(dimension, "n", F.coalesce(F.col("target").cast("double"), F.lit(0.0)).alias("target")), "levels")
    scale = 0.0
    while True:  # levels only ever become full, so this ends
        full = F.col("target") * F.lit(scale) >= F.col("n")
        r = own.agg(F.sum(F.when(full, F.col("n"))).alias("n"), F.sum(F.when(~full, F.col("target"))).alias("target")).first()
        if not r["target"]:
            break
        new = (kept - (r["n"] or 0.0)) / r["target"]
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return own.select(dimension, F.least(F.col("target") * F.lit(scale), F.col("n")).alias("goal"))


def bounded(cells: DataFrame, targets: dict[str, DataFrame], kept: float, sweeps: int = SWEEPS, tolerance: float = 1e-9) -> DataFrame:
    """cells (with ``start``) and ``probability``: least(1, start times three factors), raked to the goals for ``kept`` tokens.

    A step finds each level's factor exactly: tokens kept are a concave function of it, the lowest of the lines on which
    the k cells with the largest products are full, so the factor is the largest root of these lines.
    """
    factors = {d: stage(goals(cells, targets[d], d, kept).withColumn(d[0], F.lit(1.0)), f"b-{d}") for d in DIMENSIONS}
    for _ in range(sweeps):
        for d in DIMENSIONS:
            a, b = (x for x in DIMENSIONS if x != d)
            own = cells.join(factors[a].select(a, a[0]), a).join(factors[b].select(b, b[0]), b)
            own = own.withColumn("o", F.col("start") * F.col(a[0]) * F.col(b[0])).join(factors[d].select(d, "goal"), d)
            down = Window.partitionBy(d).orderBy(F.desc("o"), F.asc(a), F.asc(b)).rowsBetween(Window.unboundedPreceding, -1)
            up = Window.partitionBy(d).orderBy(F.asc("o"), F.desc(a), F.desc(b)).rowsBetween(Window.unboundedPreceding, 0)
            full = F.coalesce(F.sum("tokens").over(down), F.lit(0))
            root = F.try_divide(F.col("goal") - full, F.sum(F.col("tokens") * F.col("o")).over(up))
            found = own.select(d, root.alias("root")).groupBy(d).agg(F.max("root").alias("root"))
            old = factors[d]
            new = old.select(d, "goal", F.col(d[0]).alias("before")).join(found, d, "left")
            factors[d] = stage(new.select(d, "goal", F.greatest(F.coalesce("root", F.lit(0.0)), F.lit(0.0)).alias(d[0]), "before"), f"b-{d}")
            discard(old)
        moved = [factors[d].agg(F.max(F.abs(F.try_divide(d[0], "before") - 1))).first()[0] for d in DIMENSIONS]
        if all(x is None or x < tolerance for x in moved):
            break
    out = cells
    for d in DIMENSIONS:
        out = out.join(factors[d].select(d, d[0]), d)
    p = F.least(F.lit(1.0), F.col("start") * F.col("s") * F.col("l") * F.col("t"))
    return out.select(*DIMENSIONS, "tokens", "weight", p.alias("probability"))


def calibrated(keyed_docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """For each cell: weight (raked share over own share) and probability, from whole docs.

    The probability is weight over the largest, or the bounded one where that would keep less than LEAST_KEPT.
    """
    cells = stage(
        keyed_docs.groupBy(F.col("_source").alias("source"), F.col("_language").alias("language"), F.col("_topic").alias("topic")).agg(
            F.sum("_tokens").alias("tokens")
        ),
        "cells",
    )
    powers = powers or POWERS
    targets = targets or {d: tempered(cells, d, powers[d]) for d in DIMENSIONS}
    raked = stage(rake(cells, targets), "raked")
    if (off := strayed(raked, targets)) > STRAYED:
        warnings.warn(f"raking ended after {SWEEPS} sweeps with shares that are up to {off:.2g} off their targets", RuntimeWarning, stacklevel=2)
    tokens = F.col("tokens").cast("double")
    top = raked.agg(F.max("weight").alias("top"), F.sum(tokens).alias("all"), F.sum(tokens * F.col("weight")).alias("mass"))
    found = top.first()
    if found["top"] and found["mass"] < LEAST_KEPT * found["top"] * found["all"]:
        kept = LEAST_KEPT * found["all"]
        own = stage(raked.withColumn("start", F.col("weight") * F.lit(kept / found["mass"])), "start")
        raked = stage(bounded(own, targets, kept), "bounded")
    else:
        raked = raked.crossJoin(F.broadcast(top.select("top"))).withColumn("probability", F.col("weight") / F.col("top"))  # one row
    return raked.crossJoin(F.broadcast(top.select("all"))).select(  # one row
        *DIMENSIONS,
        F.round(F.col("weight") * F.col("all"), 6).alias("weight"),
        F.round(F.col("probability"), 9).alias("probability"),
    )


def _with_probability(docs: DataFrame, language: str, topic: Column | None, powers, targets) -> DataFrame:
    own = keyed(docs, language, topic)
    cells = stage(calibrated(own, powers, targets), "calibrated")
    at = [F.col(f"_{d}") == F.col(f"_c_{d}") for d in DIMENSIONS]
    named = cells.select(*[F.col(d).alias(f"_c_{d}") for d in DIMENSIONS], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    return own.join(named, at, "left")


def mixture(docs: DataFrame, language: str = "lang", topic: Column | None = None, powers=None, targets=None) -> DataFrame:
    """Per row of docs: doc_id, source, language, topic, tokens, weight, probability, sampled.

    Null keys are a level ``(none)``; a null or empty text counts as one token. Rows that repeat a doc_id are drawn
    alike. An empty table gives an empty result. Needs the columns doc_id, text, source and the language's.
    """
    rows = docs.select("doc_id", "text", "source", F.col(language).alias("_lang"))
    own = _with_probability(rows, "_lang", topic, powers, targets)
    return own.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_language").alias("language"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.col("_weight").alias("weight"),
        F.col("_probability").alias("probability"),
        (uniform() < F.col("_probability")).alias("sampled"),
    )


def sample(docs: DataFrame, language: str = "lang", topic: Column | None = None, powers=None, targets=None) -> DataFrame:
    """The sampled rows of docs, with their columns, whatever their names.

    Null keys are a level of their own, and a null or empty text counts as one token. Rows that repeat a doc_id are drawn
    alike, and those without one, too. An empty table gives an empty one.
    """
    own = shielded(docs, list(dict.fromkeys(["doc_id", "text", "source", language])))
    own = _with_probability(own, language, topic, powers, targets)
    return restored(own.where(uniform() < F.col("_probability")), docs.columns)


def oracle_sql(table: str = "documents", sweeps: int = SWEEPS) -> str:
    """DuckDB SQL for ``mixture`` over a table: the same raking, one CTE for each step."""
    ctes = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS language,
 coalesce({TOPIC_SQL}, '{NONE}') AS topic, greatest(coalesce(len(regexp_extract_all(text, '{WORD}')), 0), 1)::BIGINT AS tokens FROM {table})""",
        "c AS MATERIALIZED (SELECT source, language, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        ctes.append(
            f"{x}_0 AS MATERIALIZED (SELECT {x}, t / sum(t) OVER () AS target, 1.0::DOUBLE AS f FROM "
            f"(SELECT {x}, pow(sum(tokens), {POWERS[x]}) AS t FROM c GROUP BY {x}))"
        )
    now = dict.fromkeys(DIMENSIONS, 0)
    for k in range(1, sweeps + 1):
        for x in DIMENSIONS:
            a, b = (f"{y}_{now[y]}" for y in DIMENSIONS if y != x)
            ka, kb = (y for y in DIMENSIONS if y != x)
            ctes.append(
                f"{x}_{k} AS MATERIALIZED (SELECT o.{x}, o.target, o.target / s.now AS f FROM {x}_0 o JOIN (SELECT c.{x}, "
                f"sum(c.tokens * a.f * b.f) AS now FROM c JOIN {a} a ON a.{ka} = c.{ka} JOIN {b} b ON b.{kb} = c.{kb} GROUP BY c.{x}) s ON s.{x} = o.{x})"
            )
            now[x] = k
    joins = " ".join(f"JOIN {x}_{sweeps} f_{x} ON f_{x}.{x} = c.{x}" for x in DIMENSIONS)
    ctes.append(f"w AS MATERIALIZED (SELECT c.*, f_source.f * f_language.f * f_topic.f AS w FROM c {joins})")
    ctes.append(
        "p AS (SELECT source, language, topic, round(w * sum(tokens) OVER (), 6) AS weight, round(w / max(w) OVER (), 9) AS probability FROM w)"
    )
    u = f"CAST('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS UBIGINT) / 4294967296.0"
    return f"WITH {', '.join(ctes)} SELECT doc_id, d.source, d.language, d.topic, d.tokens, weight, probability, {u} < probability AS sampled FROM d JOIN p USING (source, language, topic)"
