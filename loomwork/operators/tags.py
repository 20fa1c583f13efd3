"""Keywords of free text: weighted words and word pairs, and tag lists made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import let

TOP = 8
WORD = r"[A-Za-z][A-Za-z0-9'\-]{2,}"
#: Words that are no keywords.
STOP_WORDS = (
    "the and for with from that this they them their will would about into onto than then have has had needs wants asked "
    "prefers main more less very also but not are was were"
).split()


def words(text: Column) -> Column:
    """Lower-case words of three characters or more that are no stop words, in order."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.btrim(w, F.lit("'-")))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


def pairs(own: Column) -> Column:
    """Neighbouring words as word pairs."""
    return F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def counted(items: Column) -> Column:
    """The different items of a list in order, as a list of {item, n}: the runs of the sorted list."""

    def runs(s: Column) -> Column:
        first = lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1))
        ends = lambda x: F.concat(F.slice(x, 2, F.size(x)), F.array(F.size(s) + 1))
        whole = lambda x: F.zip_with(x, ends(x), lambda a, z: F.struct(F.element_at(s, a).alias("item"), (z - a).alias("n")))
        return F.when(F.size(s) > 0, let(F.filter(F.sequence(F.lit(1), F.size(s)), first), whole))

    return let(F.sort_array(items), runs)


def keywords(df: DataFrame, key: str, text: Column, top: int = TOP) -> DataFrame:
    """(key, keyword, weight, rank): words weigh 1 and pairs 2 each time they stand; equal weights in alphabetical order.

    Each row is counted by itself, so nothing is shuffled and a text's other words go nowhere; key tells rows apart.
    """
    items = let(words(text), lambda w: F.concat(w, pairs(w)))  # only pairs hold a space
    weight = lambda x: x["n"] * F.when(F.contains(x["item"], F.lit(" ")), 2).otherwise(1)
    weighed = F.transform(counted(items), lambda x: F.struct((-weight(x)).alias("w"), x["item"].alias("keyword")))
    out = df.select(F.col(key).alias(key), F.posexplode(F.slice(F.sort_array(weighed), 1, top)).alias("_at", "_x"))
    return out.select(key, F.col("_x.keyword").alias("keyword"), (-F.col("_x.w")).cast("long").alias("weight"), (F.col("_at") + 1).alias("rank"))


def tag_lists(ranked: DataFrame, key: str) -> DataFrame:
    """(key, tags): the keywords of each row as a list."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    return ranked.groupBy(key).agg(F.transform(rows, lambda r: r["keyword"]).alias("tags"))


def top_tags(ranked: DataFrame, key: str, most: int = 40) -> DataFrame:
    """(keyword, n): in how many rows a keyword is one of the top; ties in order of first sight."""
    counted = ranked.groupBy("keyword").agg(F.count("*").alias("n"), F.min(F.struct(key, "rank")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(most).select("keyword", "n")


def with_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def highlighted(tags: Column, wanted: str, shown: int = 5) -> Column:
    """The first tags, with the first that contains the wanted text or lies in it moved to the front."""
    hit = F.try_element_at(F.filter(tags, lambda t: F.contains(t, F.lit(wanted)) | F.contains(F.lit(wanted), t)), F.lit(1))
    moved = F.concat(F.array(hit), F.filter(tags, lambda t: t != hit))
    return F.slice(F.when(hit.isNotNull(), moved).otherwise(tags), 1, shown)
