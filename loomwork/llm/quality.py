"""Quality rules: repetition and length rules, and perplexity bands of a modified Kneser-Ney n-gram model.

The model has the characters themselves (code points; digits count as one) and order 4, with models of its own for each
language. What it holds grows with the corpus. Documents fall into two folds by a hash of their text, so that copies fall
together; each fold is scored by the models of the other, so no document is measured by itself. A model learns from all
documents of its language whose perplexity by a model of order 1 lies within that one's band: a kind of text whose
characters are unlike all others' can't teach the model to expect it, however many such texts there are.

Counts, discounts, continuation counts and interpolated probabilities are DataFrame aggregations and joins over all
texts. The result is stored as sorted hash arrays in chunks; a scoring task keeps a bounded number of chunks at hand and
finds n-grams by bisection, whatever the size of the models.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import NARROW_ROWS, TEXT_ROWS, new_folder, stage
from loomwork.llm.files import Output, reader

ORDER, BITS = 4, 16
MASKS = [(1 << BITS * k) - 1 for k in range(ORDER + 1)]
#: N-grams that a counting task holds before it sums them up, and characters of a text that are handled at a time.
HELD, SLICE = 1 << 22, 1 << 20
#: N-grams in a chunk of the stored model (6 MB), and chunks that a scoring task has at hand.
CHUNK, CHUNKS = 1 << 19, 24
#: Slots of found n-grams that a scoring task remembers for a model, and the models it remembers some for.
SLOTS, AT_HAND = 1 << 19, 6
#: Base rules: least words, and the largest share (per cent) of words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: A band is the median of log perplexity, plus and minus WIDTH and so many scaled median deviations. As a mean over
#: characters strays with the root of their number, deviations are taken times, and bands over, that root.
DEVIATIONS, WIDTH = 6.0, 0.1
#: The same of the perplexity by order 1, which tells the texts that a model learns from.
USUAL_DEVIATIONS, USUAL_WIDTH = 4.0, 0.02
#: A model's own spread counts as much as that of all models together when it has so many documents; with fewer of them
#: the band is wider, too, since their median is less sure.
SHRINK = 50
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_table: list[np.ndarray] = []


def characters() -> np.ndarray:
    """The 16-bit number of every code point: itself, 0 for the start of a text. Digits are one character; code points
    beyond 16 bits go by their upper bits, in the numbers of surrogates."""
    if not _table:
        table = np.arange(0x110000, dtype=np.uint32)
        table[0x10000:] = 0xD800 + (table[0x10000:] >> 10)
        table[0], table[48:58] = 0xFFFF, 48
        _table.append(table.astype(np.uint64))
    return _table[0]


def grams(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-gram of each character with what precedes it, packed 16 bits a character, for slices of the text."""
    for at in range(0, len(text), SLICE):
        before = min(at, order - 1)
        c = characters()[np.frombuffer(text[at - before : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        out = c.copy()
        for k in range(1, order):
            out[k:] |= c[:-k] << np.uint64(BITS * k)
        yield out[before:]


def hashed(keys: np.ndarray, tag) -> np.ndarray:
    """64-bit hashes of packed n-grams. tag: twice the order, one more for a context's weight."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) ^ (np.asarray(tag, np.uint64) * _MIX)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: a 64-bit mixer
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def language(lang: str = "lang") -> Column:
    """The primary subtag of a language tag (en of en-US or en_US), two or three letters, lower-cased; all else is ``und``."""
    code = F.regexp_extract(F.lower(F.col(lang).cast("string")), "^([a-z]{2,3})(?:[-_][a-z0-9]{1,8})*$", 1)
    return F.when(code != "", code).otherwise(F.lit("und"))


def model_of(code: Column, fold: Column) -> Column:
    """The number of a language's model for a fold: the bytes of its code, then the fold."""
    byte = lambda k: F.ascii(F.substring(code, k, 1)).cast("int")
    return byte(1) * (1 << 17) + byte(2) * (1 << 9) + byte(3) * 2 + fold


def fold(text: str = "text") -> Column:
    """0 or 1, by a hash of the text."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_grams(docs: DataFrame, order: int = ORDER, usual: Callable[[], Callable] | None = None) -> DataFrame:
    """(m, g, c): counts of all n-grams of the highest order in docs (m, text, and whatever ``usual`` looks at); tasks sum
    up before anything is shuffled. usual makes a function of a batch that says which of its rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        held, chosen = 0, usual() if usual else None

        def settled() -> Iterator[pa.RecordBatch]:
            for m, parts in waiting.items():
                own = np.sort(np.concatenate(parts))
                edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                n = np.diff(np.append(edges, len(own)))
                keys = own[edges].view(np.int64)
                for at in range(0, len(keys), NARROW_ROWS):
                    part = keys[at : at + NARROW_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), m, np.int32)), pa.array(part), pa.array(n[at : at + NARROW_ROWS])], ["m", "g", "c"]
                    )
            waiting.clear()

        for b in batches:
            if chosen:
                b = b.filter(pa.array(chosen(b), pa.bool_()))
            for m, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for own in grams(text or "", order):
                    waiting.setdefault(m, []).append(own)
                    held += len(own)
                    if held >= HELD:
                        yield from settled()
                        held = 0
        yield from settled()

    counted = stage(docs.mapInArrow(run, "m int, g long, c long"), "grams", TEXT_ROWS)
    return counted.groupBy("m", "g").agg(F.sum("c").alias("c"))


def probabilities(counts: DataFrame, order: int = ORDER) -> list[tuple[int, DataFrame, DataFrame]]:
    """For each order, lowest first: (order, (m, g, p), (m, h, w)) with interpolated modified Kneser-Ney estimates.

    Orders below the highest use continuation counts: the number of different characters before an n-gram.
    """
    by_order = {order: stage(counts, "counts")}
    for k in range(order - 1, 0, -1):
        above = by_order[k + 1]
        g = F.col("g").bitwiseAND(F.lit(MASKS[k])).alias("g")
        by_order[k] = stage(above.groupBy("m", g).agg(F.count("*").alias("c")), "counts")
    out, lower = [], None
    for k in range(1, order + 1):
        own = by_order[k]
        n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
        found = own.groupBy("m").agg(*n)
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        discount = lambda i: F.least(
            F.greatest(F.coalesce(i - (i + 1) * y * F.try_divide(f"n{i + 1}", F.col(f"n{i}")), F.lit(0.5)), F.lit(0.0)), F.lit(float(i))
        )
        discounts = found.select("m", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        # a row for each model; a context has at most 65,536 n-grams, so its sums are windows over one dealing
        rows = own.join(F.broadcast(discounts), "m").withColumn("h", F.shiftrightunsigned("g", BITS))
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = Window.partitionBy("m", "h")
        rows = rows.select("m", "g", "h", "c", "d", F.sum("c").over(context).alias("total"), F.sum("d").over(context).alias("taken"))
        rows = stage(rows.withColumn("w", F.col("taken") / F.col("total")), "contexts")
        contexts = rows.groupBy("m", "h").agg(F.max("w").alias("w"))
        if lower is None:
            below = F.lit(1.0 / (1 << BITS))
        else:
            rows = rows.withColumn("s", F.col("g").bitwiseAND(F.lit(MASKS[k - 1]))).join(
                lower.select("m", F.col("g").alias("s"), F.col("p").alias("q")), ["m", "s"]
            )
            below = F.col("q")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("w") * below
        lower = stage(rows.select("m", "g", p.alias("p")), "probabilities")
        out.append((k, lower, contexts))
    return out


def write_model(levels: list[tuple[int, DataFrame, DataFrame]], folder: str, chunk: int = CHUNK) -> dict[int, list[tuple[int, str, int, int]]]:
    """Writes the logarithms as chunks of sorted hashes with their values, each of one model.

    Returns each model's chunks (first hash, file, place, n-grams) in order: one for half a million n-grams.
    """
    all_rows = None
    for k, p, w in levels:
        own = p.select("m", "g", F.lit(2 * k).alias("tag"), F.log("p").cast("float").alias("v")).unionByName(
            w.select("m", F.col("h").alias("g"), F.lit(2 * k + 1).alias("tag"), F.log(F.greatest("w", F.lit(1e-12))).cast("float").alias("v"))
        )
        all_rows = own if all_rows is None else all_rows.unionByName(own)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashed(b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), b.column(3)], ["m", "h", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, model, held, n = None, None, [], 0

        def close(rows: int) -> pa.RecordBatch:
            nonlocal out, held, n
            out = out or Output(folder, "model", ".hashes")
            h, v = (np.concatenate(x) for x in zip(*held))
            held, n = ([(h[rows:], v[rows:])], len(h) - rows) if rows < len(h) else ([], 0)
            at = out.write(h[:rows].astype("<u8").tobytes() + v[:rows].astype("<f4").tobytes())
            first = int(h[0]) - (1 << 63)
            return pa.RecordBatch.from_pylist([{"m": model, "first": first, "name": out.name, "at": at, "n": rows}], schema=_CHUNKS)

        for b in batches:
            ms, h, v = (b.column(k).to_numpy() for k in range(3))
            h = h.view(np.uint64) ^ np.uint64(1 << 63)
            edges = np.flatnonzero(np.concatenate(([True], ms[1:] != ms[:-1]))).tolist() if len(ms) else []
            for a, z in zip(edges, [*edges[1:], len(ms)]):
                if n and ms[a] != model:
                    yield close(n)
                model = int(ms[a])
                held.append((h[a:z], v[a:z]))
                n += z - a
                while n >= chunk:
                    yield close(chunk)
        if n:
            yield close(n)
        if out:
            out.close()

    rows = all_rows.mapInArrow(hashes, "m int, h long, v float").repartitionByRange("m", "h").sortWithinPartitions("m", "h")
    written = stage(rows.mapInArrow(run, "m int, first long, name string, at long, n long"), "model", NARROW_ROWS)
    found: dict[int, list[tuple[int, str, int, int]]] = {}
    for r in written.orderBy("m", "first").collect():
        found.setdefault(r["m"], []).append((r["first"] + (1 << 63), r["name"], r["at"], r["n"]))
    return found


_CHUNKS = pa.schema([("m", pa.int32()), ("first", pa.int64()), ("name", pa.string()), ("at", pa.int64()), ("n", pa.int64())])


class Model:
    """The stored models: a bounded number of chunks at hand, and log probabilities that have been looked up before."""

    def __init__(self, folder: str, chunks: dict[int, list[tuple[int, str, int, int]]], order: int = ORDER):
        self.folder, self.chunks, self.order = folder, chunks, order
        self.firsts = {m: np.array([c[0] for c in own], np.uint64) for m, own in chunks.items()}
        self.loaded: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.known: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def chunk(self, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.loaded.pop((m, k), None)
        if found is None:
            if len(self.loaded) >= CHUNKS:
                self.loaded.popitem(last=False)
            _, name, at, n = self.chunks[m][k]
            with reader(self.folder, name) as f:
                data = f.read_at(12 * n, at)
            found = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n, 8 * n)
        self.loaded[m, k] = found
        return found

    def get(self, keys: np.ndarray, tag: int, m: int) -> np.ndarray:
        """Values of packed n-grams; NaN where the model has none."""
        out = np.full(len(keys), np.nan)
        if m not in self.chunks or not len(keys):
            return out
        want = hashed(keys, tag)
        order = np.argsort(want)
        want = want[order]
        bounds = np.append(np.searchsorted(want, self.firsts[m]), len(want))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            a, z = bounds[k], bounds[k + 1]
            hashes, values = self.chunk(m, k)
            at = np.minimum(np.searchsorted(hashes, want[a:z]), len(hashes) - 1)
            hit = hashes[at] == want[a:z]
            out[order[a:z][hit]] = values[at[hit]]
        return out

    def log_p(self, g: np.ndarray, m: int) -> np.ndarray:
        """Log probability of the last character of each n-gram; unseen ones take the weights of their contexts."""
        g = g.astype(np.uint64)
        out, left, weight = np.full(len(g), np.nan), np.arange(len(g)), np.zeros(len(g))
        for k in range(self.order, 0, -1):
            own = g[left] & np.uint64(MASKS[k])
            p = self.get(own, 2 * k, m)
            hit = ~np.isnan(p)
            out[left[hit]] = p[hit] + weight[left[hit]]
            left, own = left[~hit], own[~hit]
            w = self.get(own >> np.uint64(BITS), 2 * k + 1, m)
            weight[left] += np.where(np.isnan(w), 0, w)
        out[left] = weight[left] - np.log(1 << BITS)
        return out

    def looked_up(self, g: np.ndarray, m: int) -> np.ndarray:
        """``log_p`` of n-grams that may repeat, by a table of slots that holds those found before."""
        own = self.known.pop(m, None)
        if own is None:
            if len(self.known) >= AT_HAND:
                self.known.popitem(last=False)
            own = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)
        self.known[m] = own
        keys, values = own
        with np.errstate(over="ignore"):
            slot = (g * _MIX) >> np.uint64(64 - SLOTS.bit_length() + 1)
        p = values.take(slot, mode="clip")
        missing = np.flatnonzero(keys.take(slot, mode="clip") != g)
        if len(missing):
            new, place = np.unique(g[missing], return_inverse=True)
            found = self.log_p(new, m).astype(np.float32)
            p[missing] = found[place]
            at = slot[missing]
            keys[at] = g[missing]
            values[at] = found[place]
        return p

    def mean_log_p(self, texts: list[str], ms: list[int]) -> list[float | None]:
        """The mean log probability of each text's characters by its model; None without any."""
        out: list[float | None] = [None] * len(texts)
        for m in set(ms):
            which = [i for i, x in enumerate(ms) if x == m and texts[i]]
            waiting: list[tuple[int, np.ndarray]] = []
            sums, held = Counter(), 0

            def settle() -> None:
                p = self.looked_up(np.concatenate([x for _, x in waiting]), m).astype(np.float64)
                ends = np.cumsum([len(x) for _, x in waiting])
                for (i, x), s in zip(waiting, np.add.reduceat(p, ends - [len(x) for _, x in waiting])):
                    sums[i] += float(s)
                waiting.clear()

            for i in which:
                for own in grams(texts[i], self.order):
                    waiting.append((i, own))
                    held += len(own)
                    if held >= SLICE:
                        settle()
                        held = 0
            if waiting:
                settle()
            for i in which:
                out[i] = sums[i] / len(texts[i])
        return out


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that the text has twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice).tolist()
    seen = Counter(tuple(words[i : i + width]) for i in at)  # hashes only propose; the words decide
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = Counter(x for x in raw.split(b"\n") if x.strip(SPACES))
    return (
        len(words),
        len(text) - sum(raw.count(SPACES[i : i + 1]) for i in range(len(SPACES))),
        sum(map(text.count, SYMBOLS)),
        sum(lines.values()) - len(lines),
        repeated_words(words),
    )


def usual_texts(rows: DataFrame, folder: str) -> Callable[[], Callable]:
    """What tells, for batches of (m, text, lang), the texts whose perplexity by order 1 is within their language's band."""
    whole = rows.select(model_of(F.col("lang"), F.lit(0)).alias("m"), "text", "lang")
    letters = write_model(probabilities(count_grams(whole.select("m", "text"), 1), 1), folder)

    def scores(model: Model, texts: list, langs: list) -> list[float | None]:
        number = {x: sum(ord(c) << at for c, at in zip(x, (17, 9, 1))) for x in set(langs)}
        return [None if x is None else -x for x in model.mean_log_p([t or "" for t in texts], [number[x] for x in langs])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, letters, 1)
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            sizes = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(scores(model, texts, langs), pa.float64()), sizes], ["lang", "log_perplexity", "n_chars"])

    seen = stage(whole.mapInArrow(run, "lang string, log_perplexity double, n_chars long"), "letters", TEXT_ROWS)
    limits = bands(seen.withColumns({"fold": F.lit(0), "base_failed": F.lit(False)})).collect()  # a row for each language
    bounds = {r["lang"]: (r["middle"], r["spread"]) for r in limits}

    def make() -> Callable:
        model = Model(folder, letters, 1)

        def inside(b: pa.RecordBatch) -> list[bool]:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for t, lang, x in zip(texts, langs, scores(model, texts, langs)):
                middle, spread = bounds.get(lang, (0.0, 0.0))
                out.append(x is not None and abs(x - middle) <= USUAL_WIDTH + USUAL_DEVIATIONS * spread / len(t) ** 0.5)
            return out

        return inside

    return make


_SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, fold int, log_perplexity double, n_chars long"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts, its language, fold and log perplexity (null without text) by the other fold's model."""
    folder = new_folder(docs.sparkSession, "model")
    rows = docs.select("doc_id", language().alias("lang"), fold().alias("fold"), "text")
    usual = usual_texts(rows, folder)
    own = rows.select(model_of(F.col("lang"), F.col("fold")).alias("m"), "text", "lang")
    chunks = write_model(probabilities(count_grams(own, ORDER, usual)), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, chunks)
        for b in batches:
            texts = b.column(4).to_pylist()
            counts = list(zip(*map(base, texts)))
            scores = [None if x is None else -x for x in model.mean_log_p([t or "" for t in texts], b.column(3).to_pylist())]
            cols = [pa.array(c, pa.int64()) for c in counts] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *cols, b.column(1), b.column(2), pa.array(scores, pa.float64()), pa.array([len(t or "") for t in texts], pa.int64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lang", "fold", "log_perplexity", "n_chars"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    other = model_of(F.col("lang"), 1 - F.col("fold")).alias("m")
    return stage(rows.select("doc_id", "lang", "fold", other, "text").mapInArrow(run, f"doc_id {kind}, {_SCORES}"), "measured", TEXT_ROWS)


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, fold, middle, spread, docs) from the documents that the base rules pass: the median of log perplexity and
    the scaled median of its deviations times the root of the text's length, drawn towards that of all models together.

    Both are medians over buckets (of a thousandth, and of a thousandth of a logarithm) with counts, so they are exact
    over buckets, and what meets in a task is bounded by the number of buckets.
    """
    good = rows.where(~F.col("base_failed")).where("log_perplexity is not null")
    bucket = F.round(F.col("log_perplexity") * 1000).cast("long").alias("b")
    counted = good.groupBy("lang", "fold", bucket).agg(F.count("*").alias("n"))
    middle = counted.groupBy("lang", "fold").agg((F.expr("percentile(b, 0.5, n)") / 1000).alias("middle"), F.sum("n").alias("docs"))
    near = good.join(F.broadcast(middle), ["lang", "fold"])  # two rows for each language
    apart = F.greatest(F.abs(F.col("log_perplexity") - F.col("middle")) * F.sqrt("n_chars"), F.lit(1e-6))
    spread = near.groupBy("lang", "fold", "middle", "docs", F.round(F.log(apart) * 1000).cast("long").alias("b")).agg(F.count("*").alias("n"))
    spread = stage(spread, "spread")
    scaled = lambda: F.exp(F.expr("percentile(b, 0.5, n)") / 1000) * 1.4826
    own = spread.groupBy("lang", "fold", "middle", "docs").agg(scaled().alias("own"))
    pooled = spread.groupBy("b").agg(F.sum("n").alias("n")).agg(scaled().alias("pooled"))
    drawn = (F.col("own") * F.col("docs") + F.col("pooled") * SHRINK) / (F.col("docs") + SHRINK)
    wider = F.sqrt(1 + F.lit(float(SHRINK)) / F.col("docs"))
    return own.crossJoin(F.broadcast(pooled)).select("lang", "fold", "middle", (drawn * wider).alias("spread"), "docs")  # one row


def rated(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    language, log perplexity and band behind the verdict.

    Null and empty texts have zero counts and fail. Every language has bands, however few its documents are: a tag's
    primary subtag is its language, and tags that are none count as ``und``. A document that is alone in its language
    and fold makes the band itself and stays inside. Texts of any length are read whole. Every row, repeated ones too,
    gives one row.
    """
    rows = measured(docs).withColumn("base_failed", failed())
    limits = F.broadcast(bands(rows))  # at most 2 * (26**2 + 26**3 + 1) rows
    reach = F.lit(WIDTH) + DEVIATIONS * F.col("spread") / F.sqrt(F.greatest("n_chars", F.lit(1)))
    own = rows.join(limits, ["lang", "fold"], "left").withColumns({"low": F.col("middle") - reach, "high": F.col("middle") + reach})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return own.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "low", "high",
    )
