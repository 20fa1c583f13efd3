"""Attributes from free text by a language model behind a small interface; one call for each distinct text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("keyword", "boolean", "long", "double")


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "keyword"
    values: tuple[str, ...] = ()


class NoModel:
    """The default client: answers nothing."""

    def complete(self, prompt: str) -> str:
        return "{}"


def prompt(attributes: Sequence[Attribute], text: str) -> str:
    lines = [f"- {a.name} ({a.type}{', one of ' + ', '.join(a.values) if a.values else ''})" for a in attributes]
    return "Give a JSON object with these fields, null where the text does not tell:\n" + "\n".join(lines) + "\n\nText:\n" + text


def coerced(reply: Column, a: Attribute) -> Column:
    """A field of a JSON reply as its type; null where it is missing, null or of another form."""
    raw = F.get_json_object(reply, f"$.{a.name}")
    own = F.when((F.trim(raw) != "") & (F.lower(raw) != "null"), F.trim(raw))
    if a.type == "boolean":
        return F.when(own == "true", True).when(own == "false", False)
    if a.type == "long":
        return F.coalesce(own.try_cast("long"), own.try_cast("double").try_cast("long"))
    if a.type == "double":
        return own.try_cast("double")
    return own


def extract(df: DataFrame, text: str, attributes: Sequence[Attribute], client: Callable[[], object] = NoModel) -> DataFrame:
    """df with a column for each attribute. Replies are made once for each distinct text; a failed call gives none."""
    specs = tuple(attributes)

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = client()

        def one(t: str) -> str:
            try:
                reply = model.complete(prompt(specs, t))
                return reply if isinstance(json.loads(reply), dict) else "{}"
            except Exception:  # a model's failure is a missing value, not a failed job
                return "{}"

        for s in batches:
            yield s.map(one)

    texts = df.select(F.col(text).alias("_text")).where(F.trim("_text") != "").distinct().withColumn("_reply", ask("_text"))
    joined = df.join(texts, df[text] == texts["_text"], "left")
    taken = {a.name for a in specs}
    kept = [df[c] for c in df.columns if c not in taken]
    return joined.select(*kept, *[coerced(F.col("_reply"), a).alias(a.name) for a in specs])


def summary(df: DataFrame, seq: str, text: str) -> DataFrame:
    """(seq, summary): the sentence of each text that is closest to all its sentences by TF-IDF cosine.

    Sentences are scored inside each row (a text's own sentences are the whole corpus of its weights), one Arrow batch
    at a time; nothing is shuffled. The first of equal sentences wins; blank texts have no summary.
    """

    @F.pandas_udf("string")
    def pick(s: pd.Series) -> pd.Series:
        return s.map(best_sentence)

    return df.select(F.col(seq).alias(seq), pick(F.coalesce(F.col(text), F.lit(""))).alias("summary"))


def best_sentence(text: str) -> str | None:
    import math
    import re
    from collections import Counter

    sentences = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    if len(sentences) < 2:
        return sentences[0] if sentences else None
    counts = [Counter(re.findall(r"\b\w\w+\b", x.lower())) for x in sentences]
    seen = Counter(w for c in counts for w in c)
    n = len(sentences)
    weight = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
    total: Counter = Counter()
    rows = []
    for c in counts:
        v = {w: k * weight[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        rows.append({w: x / norm for w, x in v.items()})
        total.update(rows[-1])
    scores = [sum(x * total[w] for w, x in r.items()) for r in rows]  # row sums of the cosine matrix
    return sentences[max(range(n), key=lambda i: (round(scores[i], 9), -i))]
