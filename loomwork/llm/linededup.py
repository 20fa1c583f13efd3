"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, distributed union-find.

Lines are compared in lower case with white space collapsed. Equal lines meet by their hash; different lines become
candidates where a band of their signatures is equal, and link if the exact Jaccard similarity of their sets of
8-character shingles is at least 0.8. One line of each component stays: the first by (doc_id, line number).

With 12 bands of 4 values a pair at similarity 0.8 becomes a candidate with probability 0.998, at 0.9 with over 0.99999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import NARROW_ROWS, PLAIN, TEXT_ROWS, discard, restored, shielded, stage
from loomwork.llm.components import Joined, connected_components

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 12, 4, 0.8
#: Bands with up to so many different lines give all their pairs; larger ones are searched with the lines at hand.
SHORT_RUN = 12
#: Lines of a large band that one task compares; longer bands are cut into blocks (see ``_searched_in_blocks``), each with
#: some lines of the band in common.
BLOCK, SHARED = 512, 4
#: Line hashes whose bands a task has already given, remembered up to this many.
SEEN = 200_000
#: Most bits of the filter of lines that are candidates.
FILTER_BITS = 1 << 27
#: Shingles handled at once, to stay in cache.
CHUNK = 1 << 16
#: A null doc_id counts as one before all others.
NO_ID = -(1 << 63)
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: White space of one byte in Latin-1 and other white space, without spaces and line feeds.
_NARROW = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE = "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """normal() of each line; those without a word are empty. Texts with single spaces only are lowered as a whole."""
    text = text.lower()
    lines = text.split("\n")
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return [" ".join(x.split()) for x in lines]
    for space in _NARROW if text.isascii() else _NARROW + _WIDE:
        if space in text:
            return [" ".join(x.split()) for x in lines]
    return lines


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def packed(line: str) -> np.ndarray | None:
    """The shingles of a line whose characters are one byte each in Latin-1, as the 64-bit number of their eight bytes.

    Exact, and repeats are kept; None for other lines and for lines shorter than a shingle.
    """
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return np.ndarray(len(raw) - SHINGLE + 1, "<u8", raw, 0, (1,)) if len(raw) >= SHINGLE else None


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers, ascending."""
    out = np.sort(numbers)
    fresh = out[1:] != out[:-1]
    return out if fresh.all() else out[np.concatenate(([True], fresh))]


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def similarity_of_distinct(a: np.ndarray, b: np.ndarray) -> float:
    """The same of two arrays by ``distinct``."""
    every = np.concatenate((a, b))
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both / (len(every) - both)


def signatures(lines: list[str]) -> np.ndarray:
    """MinHash signatures, a row for each (not empty) line."""
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    at = 0
    while at < len(lines):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
        points = np.frombuffer("".join(padded[at:to]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(points) - SHINGLE + 1
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                h *= _MIX
                h += points[k : k + n]
            h ^= h >> np.uint64(29)
            h *= _MIX
        x = (h >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(sizes[at:to])
        inside = np.ones(len(points), bool)
        for k in range(1, SHINGLE):
            inside[ends - k] = False
        x = x[inside[:n]]
        counts = sizes[at:to] - SHINGLE + 1
        starts = np.cumsum(counts) - counts
        buffer = np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.multiply(x, _MUL[k], out=buffer)
            np.add(buffer, _ADD[k], out=buffer)
            out[at:to, k] = np.minimum.reduceat(buffer, starts)
        at = to
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.empty((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(signature), np.uint64(b + 1) * _MIX, np.uint64)
            for r in range(ROWS):
                h = (h ^ signature[:, b * ROWS + r]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
            out[:, b] = h
    return out.view(np.int64)


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc, line, h, bands) of every line with a word. bands is null where the task has given them for that line before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            doc, number, hashes, at, new = [], [], [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, line in enumerate(normal_lines(t or "")):
                    if line:
                        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)
                        doc.append(doc_id)
                        number.append(k)
                        hashes.append(h)
                        if h not in seen:
                            seen.add(h)
                            at.append(len(hashes) - 1)
                            new.append(line)
            if len(seen) > SEEN:
                seen.clear()
            own = np.full(len(hashes), -1, np.int64)
            own[at] = np.arange(len(at))
            keys = bands(signatures(new)) if new else np.zeros((0, BANDS), np.int64)
            ends = np.concatenate(([0], np.cumsum(own >= 0) * BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(hashes, pa.int64()), lists], ["doc", "line", "h", "bands"]
            )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(run, "doc long, line int, h long, bands array<long>"), "lines", TEXT_ROWS, PLAIN)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash over a column h, as bytes: 16 bits a row, 16 MB at most whatever the number of rows.

    Built by Spark's bitmap aggregates; at most 4096 rows of 4 kB come to the driver. A filter too small for its rows
    lets more lines through to the join that decides.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * hashes.count()).bit_length()))
    at = F.pmod("h", F.lit(bits)) + 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():  # one job, not one a partition
        out[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return out.reshape(-1)


def texts_of(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(h, line) of the lines whose hash the bitmap has; each task gives a line once as far as it remembers."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # of a fixed size
    bits = len(wanted) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = shared.value.tobytes()
        for b in batches:
            hashes, lines = [], []
            for t in b.column(0).to_pylist():
                for line in normal_lines(t or ""):
                    if line:
                        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)
                        at = h % bits
                        if known[at >> 3] >> (at & 7) & 1 and h not in seen:
                            seen.add(h)
                            hashes.append(h)
                            lines.append(line)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(lines, pa.string())], ["h", "text"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, text string")


def _candidates(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Reads (key, h) in order of the key. Pairs (a, b) of short runs; (a, null, key) for each line of a long run, which may
    repeat in runs of over ``most`` lines."""

    def made(keys: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((h, keys))
        keys, h = keys[order], h[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (h[1:] != h[:-1])))
        keys, h = keys[fresh], h[fresh]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        size = np.repeat(sizes, sizes)
        long = size > SHORT_RUN
        short = (size > 1) & ~long
        lk, lh, keys, h = keys[long], h[long], keys[short], h[short]
        a, b = [], []
        for k in range(1, SHORT_RUN):
            same = np.flatnonzero(keys[k:] == keys[:-k])
            if not len(same):
                break
            a.append(h[same])
            b.append(h[same + k])
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])], 1), axis=0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[:, 0], lh])),
                pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(lh), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(lk)]),
            ],
            ["a", "b", "key"],
        )

    def beyond(keys: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.nulls(len(h), pa.int64()), pa.array(keys)], ["a", "b", "key"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the run that is open; repeats of a line in it are dropped as they come
    long = None  # the key of a run that is given row by row, since it is too long to hold
    for batch in batches:
        keys, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if long is not None:
            n = int(np.searchsorted(keys, long, "right"))
            yield beyond(keys[:n], h[:n])
            keys, h = keys[n:], h[n:]
        if not len(keys):
            continue
        long = None
        if held:
            keys, h = np.concatenate([held[0][0], keys]), np.concatenate([held[0][1], h])
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield made(keys[:cut], h[:cut])
        h = np.unique(h[cut:])
        held = [(np.full(len(h), keys[-1]), h)]
        if len(h) > most:
            yield beyond(*held[0])
            long, held = keys[-1], []
    if held:
        yield made(*held[0])


class _Lines:
    """Shingle sets of lines as numbered shingles, to compare one line with many at once."""

    def __init__(self, texts: list[str]):
        arrays = [packed(t) for t in texts]
        if any(x is None for x in arrays):
            number: dict[str, int] = {}
            self.sets = [np.fromiter({number.setdefault(s, len(number)) for s in shingles(t)}, np.int64) for t in texts]
            total = len(number)
        else:
            arrays = [distinct(x) for x in arrays]
            known, place = np.unique(np.concatenate(arrays), return_inverse=True)
            self.sets = np.split(place, np.cumsum([len(x) for x in arrays])[:-1])
            total = len(known)
        self.sizes = np.array([len(s) for s in self.sets])
        self.mark = np.zeros(total, bool)
        flat, starts = self.flat(np.arange(len(texts)))
        seen = np.bincount(flat)[flat]
        #: How many of a line's shingles others have too, and how widely its shingles are shared.
        self.common = np.add.reduceat((seen > 1).astype(np.int64), starts)
        self.centrality = np.add.reduceat(seen, starts) / self.sizes

    def flat(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[which]
        return np.concatenate([self.sets[k] for k in which]), np.cumsum(sizes) - sizes

    def by_centre(self) -> np.ndarray:
        """The lines, those first whose shingles most others have: such a line is similar to most of its group."""
        return np.argsort(-self.centrality, kind="stable")

    def near(self, k: int, which: np.ndarray, flat: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which lines are similar to line k. No two lines have more in common than either shares with any."""
        total = self.sizes[which] + self.sizes[k]
        most = np.minimum(self.common[which], self.common[k])
        if not (most >= SIMILARITY * (total - most) - 1e-9).any():
            return np.zeros(len(which), bool)
        self.mark[self.sets[k]] = True
        both = np.add.reduceat(self.mark[flat[0]].astype(np.int32), flat[1])
        self.mark[self.sets[k]] = False
        return both >= SIMILARITY * (total - both) - 1e-9


def search(texts: list[str], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected, without listing all pairs: from each line reached, only lines not yet reached
    are compared, central lines first. With sides only lines of different sides are."""
    if not texts:
        return []
    lines = _Lines(texts)
    out = []
    order = lines.by_centre()
    groups = [order] if side is None else [order[side[order] == 0], order[side[order] == 1]]
    other = (lambda s: 0) if side is None else (lambda s: 1 - s)
    flats = [lines.flat(g) if len(g) else None for g in groups]
    while len(groups[0]) and len(groups[-1]):
        queue = [(0, int(groups[0][0]))]
        groups[0] = groups[0][1:]
        flats[0] = lines.flat(groups[0]) if len(groups[0]) else None
        while queue:
            s, k = queue.pop()
            o = other(s)
            if not len(groups[o]):
                continue
            near = lines.near(k, groups[o], flats[o])
            if near.any():
                found = groups[o][near]
                groups[o] = groups[o][~near]
                flats[o] = lines.flat(groups[o]) if len(groups[o]) else None
                out += [(k, int(x)) for x in found]
                queue += [(o, int(x)) for x in found[::-1]]
    return out


def _search_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (key, i, j, side, h, text) in order of (key, i, j). A group's lines are compared with each other, or if they
    have sides (0 and 1) with those of the other side."""
    group: tuple | None = None
    held: tuple[list, list, list] = ([], [], [])

    def found() -> pa.RecordBatch:
        sides, h, texts = held
        pairs = search(texts, np.array(sides) if sides[0] is not None else None)
        return pa.RecordBatch.from_arrays([pa.array([h[x] for x, _ in pairs], pa.int64()), pa.array([h[y] for _, y in pairs], pa.int64())], ["a", "b"])

    for b in batches:
        for key, i, j, side, h, text in zip(*(b.column(k).to_pylist() for k in range(6))):
            if (key, i, j) != group:
                if group is not None:
                    yield found()
                group, held = (key, i, j), ([], [], [])
            held[0].append(side)
            held[1].append(h)
            held[2].append(text)
    if group is not None:
        yield found()


def _searched(dealt: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): the links inside the groups of dealt (key, i, j, side, h); own has the lines' texts."""
    order = ["key", "i", "j"]
    ready = dealt.join(own, "h").select(*order, "side", "h", "text").repartition(*order).sortWithinPartitions(*order)
    return stage(ready.mapInArrow(_search_groups, "a long, b long"), "searched", 500, PLAIN)


def _searched_in_blocks(huge: DataFrame, own: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """(a, b): links that connect what is connected by the known links and in each band of huge (key, h, n).

    A band is cut into blocks by the hash of its lines, and each block is searched together with a few lines that all
    blocks of the band have, so that a band of similar lines becomes one component, block by block. Only lines that are
    then outside their band's largest component are held against the whole band, in a grid of blocks.
    """
    zero, blocks = F.lit(0).cast("long"), lambda n: F.ceil(n / F.lit(block)).cast("long")
    cut = stage(huge.withColumns({"i": F.pmod(F.xxhash64("h"), blocks(F.col("n"))), "blocks": blocks(F.col("n"))}), "cut", codec=PLAIN)
    some = cut.groupBy("key", "blocks").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("h", "key"), F.col("n")) < 8 * SHARED, F.col("h")))), 1, SHARED).alias("hs"))
    some = some.select("key", "blocks", F.explode("hs").alias("h"))
    some = some.select("key", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i"), "h")
    dealt = cut.select("key", "i", "h").unionByName(some).distinct().select("key", "i", F.lit(-1).cast("long").alias("j"), F.lit(None).cast("int").alias("side"), "h")
    inside = _searched(dealt, own)

    roots = connected_components(known.unionByName(inside))
    reached = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars in place of all links so far
    placed = cut.join(roots, cut.h == roots.node, "left").select("key", "h", "n", F.coalesce("root", "h").alias("root"))
    placed = stage(placed, "placed", codec=PLAIN)
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    rest = stage(placed.join(largest, "key").where("root <> largest").select("key", "h"), "rest", codec=PLAIN)
    if rest.isEmpty():
        return reached
    parts = rest.groupBy("key").agg(blocks(F.count("*")).alias("rows"))
    columns = blocks(F.col("n"))
    grid = placed.join(parts, "key")
    left = rest.join(placed.select("key", "h", "n"), ["key", "h"]).join(parts, "key")
    left = left.withColumn("j", F.explode(F.sequence(zero, columns - 1))).select("key", F.pmod(F.xxhash64("h"), F.col("rows")).alias("i"), "j", F.lit(0).alias("side"), "h")
    right = grid.withColumn("i", F.explode(F.sequence(zero, F.col("rows") - 1))).select("key", "i", F.pmod(F.xxhash64("h"), columns).alias("j"), F.lit(1).alias("side"), "h")
    return reached.unionByName(_searched(left.unionByName(right), own))


def links(docs: DataFrame, lines: DataFrame, text: str, block: int = BLOCK) -> DataFrame:
    """(a, b) hashes of different lines of one component; enough of them to connect all that are connected."""
    keyed = lines.where("size(bands) > 0").select(F.explode("bands").alias("key"), "h").repartition("key").sortWithinPartitions("key")  # one number to sort by
    found = stage(keyed.mapInArrow(_candidates, "a long, b long, key long"), "candidates", NARROW_ROWS, PLAIN)
    pairs = found.where("b is not null").select("a", "b").distinct()
    large = stage(found.where("b is null").select("key", F.col("a").alias("h")).distinct(), "large", codec=PLAIN)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(large.select("h")).distinct()
    wanted = stage(wanted, "wanted", codec=PLAIN)
    with_text = stage(texts_of(docs, text, bitmap(wanted)).join(wanted, "h", "left_semi"), "texts", TEXT_ROWS)
    own = stage(with_text.groupBy("h").agg(F.min("text").alias("text")), "texts")
    discard(with_text)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for b in batches:
            a, z = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = zip(a, z, b.column(2).to_pylist(), b.column(3).to_pylist())
            good, last, plain, other = [], None, None, None
            for x, y, s, t in rows:  # rows of one line follow each other
                if joined.find(x) == joined.find(y):
                    continue  # connected by links that are found already
                if t != last:
                    last, plain, other = t, packed(t), None
                    plain = plain if plain is None else distinct(plain)
                own = None if plain is None else packed(s)
                if own is not None:
                    near = similarity_of_distinct(distinct(own), plain)
                else:
                    other = other or shingles(t)
                    near = similarity(shingles(s), other)
                if near >= SIMILARITY:
                    good.append((x, y))
                    joined.join(x, y)
            if len(joined.parent) > SEEN:
                joined.parent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([y for _, y in good], pa.int64())], ["a", "b"])

    left = pairs.join(own.select(F.col("h").alias("a"), F.col("text").alias("s")), "a")
    both = left.join(own.select(F.col("h").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t").sortWithinPartitions("b")
    verified = stage(both.mapInArrow(verify, "a long, b long"), "similar", 2000, PLAIN)

    counts = large.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    counts = stage(counts, "counts", codec=PLAIN)
    if counts.isEmpty():
        return verified.unionByName(_searched(large.select("key", long.alias("i"), long.alias("j"), none.alias("side"), "h"), own))
    usual = large.join(counts, "key", "left_anti").select("key", long.alias("i"), long.alias("j"), none.alias("side"), "h")
    found = verified.unionByName(_searched(usual, own))
    return _searched_in_blocks(large.join(counts, "key"), own, found, block)


def line_components(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per line with a word: doc_id, line_no (from 0), component_doc, component_line (the line that stays), kept.

    Lines without a word are no duplicates of anything and have no row. Null and empty texts have no lines. Rows that
    repeat a doc_id are treated alike, since their lines can't be told apart: (doc_id, line_no) names them both. Null
    doc_ids count as one id before all others. A line's 64-bit hash stands for the line.
    """
    raw = lines_of(docs, text)
    lines = stage(raw.select("doc", "line", "h"), "lines", codec=PLAIN)
    roots = connected_components(links(docs, raw, text, block))
    discard(raw)
    firsts = lines.groupBy("h").agg(F.min(F.struct("doc", "line")).alias("first"))
    grouped = firsts.join(roots, firsts.h == roots.node, "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    named = grouped.join(least, "root").select("h", "stays")
    shown = lambda c: F.when(c != NO_ID, c)
    return lines.join(named, "h").select(
        shown(F.col("doc")).alias("doc_id"),
        F.col("line").alias("line_no"),
        shown(F.col("stays.doc")).alias("component_doc"),
        F.col("stays.line").alias("component_line"),
        ((F.col("doc") == F.col("stays.doc")) & (F.col("line") == F.col("stays.line"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with each text reduced to the lines that stay; lines without a word stay. All rows and columns remain."""
    gone = line_components(docs, text, block).where("not kept")
    lists = gone.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    own = shielded(docs, list(dict.fromkeys(["doc_id", text])))
    own = own.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(lists, "_doc", "left")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_gone", i))
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    return restored(own.withColumn(f"_own_{docs.columns.index(text)}", kept), docs.columns)
