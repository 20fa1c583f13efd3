"""Fuzzy record linkage between two tables, and linking of any number of them into clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import key_of, round3
from loomwork.functions.similarity import in_common, letter_bits, reachable, similarity, sorted_words
from loomwork.sources.folders import shared_folder

THRESHOLD, PAIRS, SHOWN = 0.85, 500, 25
#: Fields shown of a match, in this order, at most four.
DISPLAY = ("full_name", "first_name", "last_name", "company", "email", "phone", "city", "country", "job_title", "amount")


def displayed(fields: Sequence[str]) -> list[str]:
    return [c for c in DISPLAY if c in fields][:4]


def keyed(df: DataFrame, key: Column, canonical: str, seq: str) -> DataFrame:
    """(seq, k, s, block): rows with a key, the key, its sorted words and its first character."""
    own = df.select(F.col(seq).alias("seq"), key_of(key.cast("string"), canonical).alias("k")).where("k <> ''")
    return own.withColumns({"s": sorted_words(F.col("k")), "block": F.substring("k", 1, 1)})


#: Keys of either side in a task of the join: hot blocks are cut into a grid of parts of about so many.
KEYS_A_PART = 4096


def near_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows (k, s, block, and whatever else, under a_ and b_) whose similarity could reach the threshold.

    An equi-join on the first character and the length, in steps of the largest ratio of lengths that the threshold allows,
    so similar keys lie in one step or two next to each other. How many parts a step is cut into follows from its keys.
    Pairs are dropped by their lengths and by the characters that they can have in common before any is compared; both
    bounds are exact, so no match is lost.
    """
    step = math.log((2.0 - threshold) / threshold) if 0 < threshold < 2 else math.inf
    at = F.floor(F.log(F.length("k")) / max(step, 1e-6)).cast("long") if step < math.inf else F.lit(0).cast("long")
    own = lambda df: df.withColumns({"at": at, "bits": letter_bits(F.col("k"))})
    a, b = own(left), own(right)
    a = a.withColumn("at", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)))
    parts = lambda df, out: df.groupBy("block", "at").agg(F.ceil(F.count("*") / F.lit(KEYS_A_PART)).alias(out))
    grid = parts(a, "_a_parts").join(parts(b, "_b_parts"), ["block", "at"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("k"), F.col(n))
    named = lambda df, side: df.select("block", "at", "_a", "_b", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("block", "at", "_a", "_b", "_a_parts", "_b_parts")])
    x = named(a.join(grid, ["block", "at"]).withColumn("_a", mine("_a_parts")).withColumn("_b", every("_b_parts")), "a")
    y = named(b.join(grid, ["block", "at"]).withColumn("_b", mine("_b_parts")).withColumn("_a", every("_a_parts")), "b")
    la, lb = F.length("a_k"), F.length("b_k")
    enough = 2.0 * in_common(F.col("a_bits"), F.col("b_bits")) >= F.lit(threshold) * (la + lb) - 1e-9
    return x.join(y, ["block", "at", "_a", "_b"]).where(reachable(la, lb, threshold) & enough).drop("block", "at", "_a", "_b", "a_bits", "b_bits")


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs with their similarity, those that reach the threshold."""
    return pairs.withColumn("sim", similarity(threshold)("a_k", "b_k", "a_s", "b_s")).where(F.col("sim") >= threshold)


def best_matches(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a_seq, b_seq, sim): for each row of a the most similar row of b that starts with the same character.

    Ties go to the first of b. Both sides are reduced to distinct keys first, so copies of a key are compared once, and
    equal keys need no comparison at all; see ``near_pairs`` for the others.
    """
    ak = a.groupBy("k", "s", "block").agg(F.min("seq").alias("first"))
    bk = b.groupBy("k", "s", "block").agg(F.min("seq").alias("seq"))
    exact = ak.join(bk.select("k", F.col("seq").alias("b_seq")), "k").select("k", "b_seq", F.lit(1.0).alias("sim"))
    rest = ak.join(bk.select("k"), "k", "left_anti").drop("first")
    best = _scored(near_pairs(rest, bk, threshold), threshold).groupBy("a_k").agg(F.max(F.struct("sim", (-F.col("b_seq")).alias("n"))).alias("m"))
    fuzzy = best.select(F.col("a_k").alias("k"), (-F.col("m.n")).alias("b_seq"), F.col("m.sim").alias("sim"))
    return a.select(F.col("seq").alias("a_seq"), "k").join(exact.unionByName(fuzzy), "k").select("a_seq", "b_seq", "sim")


def report(a: DataFrame, b_rows: int, pairs: DataFrame, a_rows: int) -> DataFrame:
    """One row: rows, keyed rows of a, matched, exact, unmatched on either side."""
    n = a.agg(F.count("*").alias("keyed_a"))
    m = pairs.agg(F.count("*").alias("matched"), F.count_if(F.col("sim") >= 1.0).alias("exact"), F.count_distinct("b_seq").alias("bs"))
    one = n.crossJoin(m)  # a row each
    return one.select(
        F.lit(a_rows).alias("rows_a"), F.lit(b_rows).alias("rows_b"), "keyed_a", "matched", "exact",
        (F.col("keyed_a") - F.col("matched")).alias("unmatched_a"), (F.lit(b_rows) - F.col("bs")).alias("unmatched_b"),
    )


def shown(pairs: DataFrame, kept: int = PAIRS, top: int = SHOWN) -> DataFrame:
    """The report's list: of the first pairs in a's order the inexact ones first, then by similarity."""
    first = pairs.orderBy("a_seq").limit(kept)
    return first.orderBy(F.col("sim") >= 1.0, F.desc("sim"), "a_seq").limit(top).withColumn("sim", round3(F.col("sim")))


def join_keys(a: DataFrame, b: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(field, kind, uniqueness, fill_a, fill_b) of shared fields (name, kind), the best key first."""

    def one(df: DataFrame, tag: str) -> DataFrame:
        aggs = []
        for name, _ in fields:
            k = key_of(F.col(f"`{name}`").cast("string"), name)
            filled = F.when(k != "", k)
            aggs += [F.count(filled).alias(f"{name}__n"), F.count_distinct(filled).alias(f"{name}__d")]
        row = df.agg(*aggs)
        stack = ", ".join(f"'{n}', `{n}__n`, `{n}__d`" for n, _ in fields)
        return row.select(F.expr(f"stack({len(fields)}, {stack}) as (field, fill_{tag}, d_{tag})"))

    kinds = F.create_map(*[F.lit(x) for pair in fields for x in pair])
    both = one(a, "a").join(one(b, "b"), "field")
    out = both.select(
        "field",
        F.try_element_at(kinds, "field").alias("kind"),
        round3(F.coalesce(F.try_divide("d_a", "fill_a"), F.lit(0.0))).alias("uniqueness"),
        "fill_a",
        "fill_b",
    )
    return out.orderBy(F.col("kind") == "numeric", F.col("kind") == "date", F.desc("uniqueness"), F.desc("fill_a"), "field")


def similar_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): first rows of different similar keys of one table (seq, k, s, block). Copies of a key stand for one."""
    own = rows.groupBy("k", "s", "block").agg(F.min("seq").alias("seq"))
    near = near_pairs(own, own, threshold).where(F.col("a_seq") < F.col("b_seq"))
    return _scored(near, threshold).select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches.

    Rounds of taking the smallest label among neighbours and then that label's own (pointer jumping); each round is
    checkpointed to the shared folder, and labels stop changing after about log(diameter) rounds.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct().checkpoint()
    label = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).checkpoint()
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        low = label.join(near, "u").select("u", F.least("l", "nl").alias("l"), F.col("l").alias("old"))
        jump = low.join(low.select(F.col("u").alias("l"), F.col("l").alias("j")), "l", "left")
        new = jump.select("u", F.least("l", F.coalesce("j", "l")).alias("l"), "old").checkpoint()
        moved = new.where("l <> old").limit(1).count()
        label = new.select("u", "l")
        if not moved:
            return label.select(F.col("u").alias("node"), F.col("l").alias("root"))


def linked(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row (seq, source, k, s, block) with its entity id, the entity's size and number of sources.

    Rows of one key are one entity, and entities of similar keys join. Ids E-0001, E-0002, ... follow the smallest row.
    """
    keys = rows.groupBy("k").agg(F.min("seq").alias("first"))
    roots = components(similar_pairs(rows, threshold))
    named = keys.join(roots, keys["first"] == roots["node"], "left").select("k", F.coalesce("root", "first").alias("root"))
    own = rows.join(named, "k")
    sizes = own.groupBy("root").agg(F.count("*").alias("size"), F.count_distinct("source").alias("n_sources"))
    ids = numbered(sizes, "root").select("root", "size", "n_sources", F.format_string("E-%04d", "n").alias("entity_id"))
    return own.join(ids, "root").select("seq", "source", "k", "entity_id", "size", "n_sources")


def numbered(df: DataFrame, by: str, out: str = "n") -> DataFrame:
    """df with ranks from 1 in the order of a unique column, without bringing the rows to one task.

    Rows are dealt by ranges; the counts of the partitions before, one number a partition, come from the driver.
    """
    ranged = df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()).checkpoint()
    before, bases = 0, []
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        bases.append((r["_part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")


def clusters(rows: DataFrame, top: int = 40) -> DataFrame:
    """Entities of ``linked``: those of many sources first, then large ones."""
    own = rows.select("entity_id", "size", "n_sources").distinct()
    return own.orderBy(F.desc("n_sources"), F.desc("size"), "entity_id").limit(top)


def union_rows(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Keyed tables as one, with their source; seq must be unique over all."""
    out = None
    for source, df in tables:
        own = df.withColumn("source", F.lit(source))
        out = own if out is None else out.unionByName(own)
    return out


def checkpoint_folder(spark) -> None:
    """Have the session checkpoint to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
