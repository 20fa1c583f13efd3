"""Column names to canonical fields: manual override, alias dictionary, optional embedding, else the name itself."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEXT = frozenset({"enum", "identifier", "free_text"})
#: Canonical fields in order of precedence, their aliases, and the kinds they take (None: any).
CANONICALS: dict[str, tuple[list[str], frozenset | None]] = {
    "amount": (
        [
            "price", "cost", "amt", "amount", "value", "total", "subtotal", "fee", "charge", "salary", "revenue", "spend", "balance",
            "budget", "mrr", "arr", "payment", "paid",
        ],
        frozenset({"numeric"}),
    ),
    "quantity": (["qty", "quantity", "count", "units", "unit", "stock", "inventory"], frozenset({"numeric"})),
    "rating": (["rating", "score", "points", "point", "stars", "star", "rank", "grade"], frozenset({"numeric"})),
    "age": (["age", "years"], frozenset({"numeric"})),
    "email": (["email", "emails", "mail", "e"], _TEXT),
    "phone": (["phone", "tel", "telephone", "mobile", "cell", "fax", "msisdn", "number"], _TEXT),
    "first_name": (["firstname", "fname", "givenname", "given", "forename", "first"], _TEXT),
    "last_name": (["lastname", "lname", "surname", "familyname", "family", "last"], _TEXT),
    "company": (
        [
            "company", "organization", "organisation", "org", "employer", "business", "vendor", "supplier", "winery", "brand", "account",
            "firm",
        ],
        _TEXT,
    ),
    "full_name": (["name", "fullname", "person", "taster"], _TEXT),
    "job_title": (["jobtitle", "title", "role", "position", "designation", "occupation"], _TEXT),
    "country": (["country", "cntry", "ctry", "nation", "countrycode"], _TEXT),
    "region": (["region", "state", "province", "county", "territory", "area"], _TEXT),
    "interests": (["interest", "interests", "hobby", "hobbies", "topic", "topics"], frozenset({"enum", "identifier"})),
    "location": (["location", "coordinates", "coords", "latlng", "latlong", "geo", "geopoint", "position", "point"], frozenset({"geo_point"})),
    "city": (["city", "town", "municipality"], _TEXT),
    "address": (["address", "addr", "street"], None),
    "postal_code": (["zip", "zipcode", "postal", "postcode", "postalcode"], _TEXT),
    "date": (
        [
            "date", "datetime", "timestamp", "created", "updated", "modified", "day", "time", "on", "at", "signup", "optin", "dob",
            "birthday", "birthdate", "contacted", "connected", "signed", "joined", "pledged", "dispatched", "opened", "acquired",
            "released", "expires", "expiry",
        ],
        frozenset({"date", "numeric"}),
    ),
    "url": (["url", "link", "website", "site", "web", "homepage", "handle"], _TEXT),
    "identifier": (["id", "identifier", "uuid", "guid", "key", "ref", "reference", "sku", "code"], frozenset({"identifier", "numeric"})),
    "gender": (["gender", "sex"], frozenset({"enum"})),
    "currency": (["currency", "ccy"], frozenset({"enum", "identifier"})),
    "description": (
        [
            "description", "desc", "notes", "note", "comment", "comments", "summary", "bio", "review", "text", "details", "detail",
            "remarks", "about", "content",
        ],
        _TEXT,
    ),
}
ALIASES = {name: frozenset(words) for name, (words, _) in CANONICALS.items()}
REFERENCE_WORDS = frozenset({"ref", "reference", "uuid", "guid"})
#: Embedding matches: least score, least lead over the second, and the length of aliases that are compared.
LEAST_SCORE, LEAST_LEAD, ALIAS_LENGTH = 0.5, 0.05, 3
CUSTOM_TYPES = ("keyword", "text", "long", "double", "date", "boolean")
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def tokens(name: str) -> list[str]:
    """Lower-case words of a column name; camel case parts, pure numbers dropped."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()
    return [t for t in re.split(r"[^a-z0-9]+", spaced) if t and not t.isdigit()]


def takes(canonical: str, kind: str) -> bool:
    kinds = CANONICALS[canonical][1]
    return kinds is None or kind in kinds


def ranked(name: str, kind: str, embed: Embed) -> list[tuple[str, float]]:
    """Canonicals that take the kind, by the best dot product of the name with the canonical's phrase or an alias."""
    names = [c for c in CANONICALS if takes(c, kind)]
    phrases = [[c.replace("_", " "), *sorted(a for a in ALIASES[c] if len(a) >= ALIAS_LENGTH)] for c in names]
    vectors = iter(embed([" ".join(tokens(name)) or name, *[p for group in phrases for p in group]]))
    own = next(vectors)
    dot = lambda v: sum(x * y for x, y in zip(own, v))
    scores = [(c, max(dot(next(vectors)) for _ in group)) for c, group in zip(names, phrases)]
    return sorted(scores, key=lambda x: -x[1])


def canonical(name: str, kind: str, embed: Embed | None = None) -> tuple[str, str]:
    """(canonical, method): method is alias, semantic or identity."""
    words = tokens(name)
    if kind in ("identifier", "numeric") and REFERENCE_WORDS.intersection(words):
        return "identifier", "alias"
    for c in CANONICALS:
        if takes(c, kind) and ALIASES[c].intersection(words):
            return c, "alias"
    if embed is not None and (scores := ranked(name, kind, embed)):
        second = scores[1][1] if len(scores) > 1 else 0.0
        if scores[0][1] >= LEAST_SCORE and scores[0][1] - second >= LEAST_LEAD:
            return scores[0][0], "semantic"
    return "_".join(words) or name.lower(), "identity"


@dataclass
class Mapping:
    """What a user has fixed: columns to canonicals, and canonicals of their own with a type and whether they hold lists."""

    overrides: dict[str, str] = field(default_factory=dict)
    custom: dict[str, tuple[str, bool]] = field(default_factory=dict)

    def override(self, column: str, name: str | None) -> None:
        if name:
            self.overrides[column] = name
        else:
            self.overrides.pop(column, None)

    def add(self, name: str, type_: str = "keyword", multiple: bool = False) -> str:
        own = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
        self.custom[own] = (type_ if type_ in CUSTOM_TYPES else "keyword", multiple)
        return own

    def remove(self, name: str) -> None:
        self.custom.pop(name, None)
        self.overrides = {c: n for c, n in self.overrides.items() if n != name}

    def resolve(self, column: str, kind: str, embed: Embed | None = None) -> tuple[str, str]:
        if column in self.overrides:
            return self.overrides[column], "override"
        return canonical(column, kind, embed)


def alias_table(spark) -> DataFrame:
    """(canonical, priority, alias, kinds) for matching names inside Spark; a fixed few hundred rows."""
    rows = [
        (c, i, a, sorted(CANONICALS[c][1]) if CANONICALS[c][1] is not None else None)
        for i, c in enumerate(CANONICALS)
        for a in sorted(ALIASES[c])
    ]
    return spark.createDataFrame(rows, "canonical string, priority int, alias string, kinds array<string>")


def canonical_names(columns: DataFrame) -> DataFrame:
    """(name, kind, canonical, method) for a table of (name, kind): the same rules as ``canonical`` as a join."""
    spaced = F.lower(F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1 $2"))
    words = F.filter(F.split(spaced, r"[^a-z0-9]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))
    own = columns.withColumn("words", words)
    table = F.broadcast(alias_table(columns.sparkSession))
    hits = own.select("name", "kind", F.explode("words").alias("alias")).join(table, "alias")
    hits = hits.where("kinds is null or array_contains(kinds, kind)").groupBy("name", "kind").agg(F.min(F.struct("priority", "canonical")).alias("hit"))
    reference = F.col("kind").isin("identifier", "numeric") & F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(REFERENCE_WORDS)]))
    identity = F.when(F.size("words") > 0, F.array_join("words", "_")).otherwise(F.lower("name"))
    return own.join(hits, ["name", "kind"], "left").select(
        "name",
        "kind",
        F.when(reference, "identifier").otherwise(F.coalesce("hit.canonical", identity)).alias("canonical"),
        F.when(reference | F.col("hit").isNotNull(), "alias").otherwise("identity").alias("method"),
    )


def merge_groups(named: DataFrame) -> DataFrame:
    """(canonical, n_columns, columns, unified): columns that share a canonical, unified and larger groups first."""
    groups = named.groupBy("canonical").agg(F.array_sort(F.collect_list("name")).alias("columns"))
    out = groups.select("canonical", F.size("columns").alias("n_columns"), "columns", (F.size("columns") > 1).alias("unified"))
    return out.orderBy(F.desc("unified"), F.desc("n_columns"), "canonical")


def registry(named: DataFrame) -> DataFrame:
    """(canonical, n_files, n_columns, unified) over (file, name, canonical) of all files."""
    groups = named.groupBy("canonical").agg(F.count_distinct("file").alias("n_files"), F.count_distinct("file", "name").alias("n_columns"))
    out = groups.withColumn("unified", F.col("n_files") > 1)
    return out.orderBy(F.desc("unified"), F.desc("n_files"), F.desc("n_columns"), "canonical")
