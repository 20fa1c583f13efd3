"""Semantic search by precomputed or plugged-in embeddings, rank fusion, and measures of ranked results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import round3
from loomwork.functions.similarity import dot


class NoEmbedder:
    """The default: no embeddings, so names match by alias and searches by keyword."""

    dimension = 0

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[] for _ in texts]


class HashEmbedder:
    """Vectors from a hash of the text, of unit length: repeatable, without meaning. For tests."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        import hashlib

        import numpy as np

        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(self.dimension)
            out.append((v / np.linalg.norm(v)).astype("float32").tolist())
        return out


def embedded(df: DataFrame, text: str, make: Callable[[], object], out: str = "vector") -> DataFrame:
    """df with a vector for each text that isn't blank. Texts go to the embedder in Arrow batches, each once a batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            own = [t for t in s.dropna().unique() if t.strip()]
            found = dict(zip(own, model.embed(own)))
            yield s.map(lambda t: found.get(t))

    return df.withColumn(out, run(F.col(text)))


def scored(df: DataFrame, vector: Column, query: Sequence[float]) -> DataFrame:
    """Rows that have a vector, with their cosine to the query (vectors of unit length)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.where(vector.isNotNull() & (F.size(vector) > 0)).withColumn("score", dot(vector, q))


def top_k(df: DataFrame, vector: Column, query: Sequence[float], seq: str, k: int = 10) -> DataFrame:
    """The k nearest rows; ties in order of seq. Each task keeps k rows, so nothing else is shuffled."""
    return scored(df, vector, query).orderBy(F.desc("score"), seq).limit(k).withColumn("score", round3(F.col("score")))


def gated(ranked: DataFrame, least_best: float = 0.15, least: float = 1e-6) -> DataFrame:
    """Nothing if the best score is under least_best; else the rows above ``least``."""
    best = ranked.agg(F.max("score").alias("_best"))
    return ranked.crossJoin(F.broadcast(best)).where((F.col("_best") >= least_best) & (F.col("score") > least)).drop("_best")  # one row


#: Rows and queries that are compared in one task.
ROWS_A_BLOCK, QUERIES_A_BLOCK = 4096, 1024


def nearest_labels(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, seq, score, rank): the k nearest rows of df (seq, v) for each query (q, v); equal scores in order of seq.

    Queries are a stated set that is compared with all rows: both are dealt into blocks, as many as their rows ask for, and
    every two blocks meet in a task, which keeps k rows a query. Vectors of different length don't compare, and nulls
    nor empty ones. Scores are told apart by twelve digits.
    """
    import numpy as np

    blocks = lambda x, size: max(1, -(-x.count() // size))
    rows, columns = blocks(df, ROWS_A_BLOCK), blocks(queries, QUERIES_A_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filled = lambda x: x.where("v is not null and size(v) > 0").withColumn("v", F.col("v").cast("array<double>"))
    left = filled(df).select("seq", "v", F.pmod(F.xxhash64("seq"), F.lit(rows)).cast("int").alias("i"), every(columns).alias("j"))
    right = filled(queries).select("q", "v", every(rows).alias("i"), F.pmod(F.xxhash64("q"), F.lit(columns)).cast("int").alias("j"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n in sorted(set(map(len, b["v"]))):
            x, y = a[a["v"].map(len) == n], b[b["v"].map(len) == n]
            if len(x) and len(y):
                seq, score = x["seq"].to_numpy(), np.round(np.stack(y["v"].to_numpy()) @ np.stack(x["v"].to_numpy()).T, 12)
                for q, s in zip(y["q"], score):
                    own = np.flatnonzero(seq != q)
                    own = own[np.lexsort((seq[own], -s[own]))[:k]] if len(own) <= 4 * k else _best(own, seq, s, k)
                    out.append(pd.DataFrame({"q": q, "seq": seq[own], "score": s[own]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "seq": [], "score": []})

    kinds = f"q {queries.schema['q'].dataType.simpleString()}, seq {df.schema['seq'].dataType.simpleString()}, score double"
    kept = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(nearest, kinds)
    whole = Window.partitionBy("q").orderBy(F.desc("score"), "seq")
    return kept.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("q", "seq", "score", "rank")


def _best(own, seq, score, k: int):
    """The k of ``own`` with the largest scores, equal ones in order of seq."""
    import numpy as np

    least = np.partition(score[own], len(own) - k)[len(own) - k]
    near = own[score[own] >= least]
    return near[np.lexsort((seq[near], -score[near]))[:k]]


def precision_mrr(ranked: DataFrame, k: int) -> DataFrame:
    """One row: mean precision at k and mean reciprocal rank, from (q, rank, hit)."""
    per = ranked.groupBy("q").agg((F.sum(F.when(F.col("rank") <= k, F.col("hit").cast("int")).otherwise(0)) / float(k)).alias("p"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return per.agg(round3(F.avg("p")).alias("precision_at_k"), round3(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"))


def fused(lists: Sequence[DataFrame], key: str, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion of lists with (key, rank): keyword and vector results in one order."""
    rows = None
    for df in lists:
        own = df.select(key, (1.0 / (F.lit(k) + F.col("rank"))).alias("s"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), key).limit(top)


def vectors_or_lsa(df: DataFrame, seq: str, text: str, make: Callable[[], object] | None = None, dimensions: int = 64) -> DataFrame:
    """(seq, v): vectors of the embedder if there is one that has dimensions, else by ``lsa``."""
    if make is not None and make().dimension:
        return embedded(df, text, make, "v").select(F.col(seq).alias("seq"), "v")
    return lsa(df, seq, text, dimensions)


def lsa(df: DataFrame, seq: str, text: str, dimensions: int = 64, vocabulary: int = 6000):
    """Unit vectors by TF-IDF and a truncated SVD (MLlib), for when no embedder is there. Not reproducible to the bit."""
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    base = df.select(F.col(seq).alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = StopWordsRemover(inputCol="w", outputCol="t").transform(RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+").transform(base))
    base = CountVectorizer(inputCol="t", outputCol="c", vocabSize=vocabulary).fit(base).transform(base)
    base = Normalizer(inputCol="i", outputCol="x").transform(IDF(inputCol="c", outputCol="i").fit(base).transform(base))
    rows = base.select("seq", "x").rdd.map(lambda r: IndexedRow(r["seq"], Vectors.fromML(r["x"])))
    matrix = IndexedRowMatrix(rows)
    found = matrix.computeSVD(min(dimensions, matrix.numCols()), computeU=True)
    scale = [float(x) for x in found.s]
    own = found.U.rows.map(lambda r: (r.index, [float(a) * b for a, b in zip(r.vector, scale)]))
    out = df.sparkSession.createDataFrame(own, "seq long, v array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("seq", F.when(norm > 0, F.transform("v", lambda x: x / norm)).alias("v"))
