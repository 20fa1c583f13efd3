"""SimHash near-duplicates found by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most four bits. Bits 0-30 and 31-61 form two halves, so a
linked pair differs in at most two bits of one half. The anchors of a half are the 2**26 words of the Hamming
(31, 26) code, whose balls of radius 1 cover the whole space. Each side of a pair shares its half's threshold:
some z lies within one bit of both, and the anchor covering z lies within 1 (covering radius) + 1 (threshold a
side) = 2 bits of both. So each fingerprint goes to every anchor within two bits, 1 or 16 a half, and linked
fingerprints always meet at an anchor, where all 64 bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import NARROW_ROWS, PLAIN, TEXT_ROWS, hex64, restored, stage
from loomwork.llm.components import connected_components, spanning_forest

WORDS = 4
SEED = 42
THRESHOLD = 4
HALF = 31
#: An anchor's fingerprints are compared in blocks of so many; more blocks are paired off in tasks of their own.
BLOCK = 1 << 16
#: Runs up to this length are compared by shifting the whole batch; longer ones by a search from pivots.
SHORT_RUN = 8


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    to = (ends[words - 1 :] if len(w) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), to)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: Column | None = None) -> DataFrame:
    """(doc_id, fp, and key where one is given) of every row; a null or empty text has fingerprint 0. Extra columns are
    ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    more = [] if key is None else [key.alias("key")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + (", key long" if more else ""))


def _masks() -> np.ndarray:
    """For each syndrome the flips of up to two bits that lead to a code word, 16 of them; -1 where there are fewer."""
    out = np.full((32, 16), -1, np.int64)
    out[0, 0] = 0
    for s in range(1, 32):
        flips = [1 << (s - 1)]
        flips += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out[s, : len(flips)] = flips
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (half in bit 31) and the position in ``fps`` of the fingerprint that goes there."""
    masks, keys, rows = _masks(), [], []
    bits = fps.view(np.uint64)
    for half in range(2):
        x = ((bits >> np.uint64(HALF * half)) & np.uint64((1 << HALF) - 1)).astype(np.int64)
        syndrome = np.zeros(len(x), np.int64)
        for k in range(5):
            mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
            syndrome |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
        m = masks[syndrome]
        there = m >= 0
        keys.append(((x[:, None] ^ m) | half << HALF)[there])
        rows.append(np.nonzero(there)[0])
    return np.concatenate(keys), np.concatenate(rows)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD


def search(fps: np.ndarray, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``fps`` (or between fps and others) without listing all pairs.

    From each fingerprint reached, only those not yet reached are compared, so a dense group costs about its size.
    """
    if others is not None:
        return _search_between(fps, others)
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = linked(left, u)
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(u), int(v)) for v in found]
                queue += list(found)
    return out


def _search_between(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    out, left = [], (a, b)
    while len(left[0]) and len(left[1]):
        queue, left = [(0, left[0][0])], (left[0][1:], left[1])
        while queue:
            side, u = queue.pop()
            other = left[1 - side]
            near = linked(other, u) if len(other) else np.zeros(0, bool)
            if near.any():
                found, rest = other[near], other[~near]
                left = (left[0], rest) if side == 0 else (rest, left[1])
                out += [(int(u), int(v)) for v in found]
                queue += [(1 - side, v) for v in found]
    return out


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), ("block", pa.int32())])


def _out(a, b, anchor=None, block=None) -> pa.RecordBatch:
    n = len(a)
    empty = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a, pa.int64()),
            empty(pa.int64()) if b is None else pa.array(b, pa.int64()),
            empty(pa.int64()) if anchor is None else pa.array(anchor, pa.int64()),
            empty(pa.int32()) if block is None else pa.array(block, pa.int32()),
        ],
        schema=_EDGE,
    )


def _compare(block_rows: int):
    """Reads (anchor, fp) in order of the anchor. Gives links, and what lies beyond the first block of an anchor."""

    def pairs_of(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        out = []
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.append(starts, len(keys)))
        for s, n in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
            out += search(fps[s : s + n])
        short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
        keys, fps = keys[short], fps[short]
        for k in range(1, SHORT_RUN):
            same = np.flatnonzero(keys[k:] == keys[:-k])
            if not len(same):
                break
            near = same[linked(fps[same], fps[same + k])]
            out += list(zip(fps[near].tolist(), fps[near + k].tolist()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: list[tuple[int, int]] = []
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        block, held_over = 0, None  # the number of blocks of the anchor that is open, and that anchor
        def over(keys, fps, number):
            return _out(fps, None, keys, np.full(len(keys), number, np.int32))

        for b in batches:
            keys = np.concatenate((held_k, b.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((held_f, b.column(1).to_numpy(zero_copy_only=False)))
            if not len(keys):
                continue
            if held_over != keys[0]:  # that anchor ended with its last whole block
                held_over = None
            cut = int(np.searchsorted(keys, keys[-1]))  # what comes before the last anchor is complete
            if cut:
                if held_over is not None:
                    end = int(np.searchsorted(keys, keys[0], "right"))
                    yield over(keys[:end], fps[:end], block)
                forest += pairs_of(keys[:cut], fps[:cut])
                held_over = None
            keys, fps = keys[cut:], fps[cut:]
            while len(keys) >= block_rows:
                if held_over is None:
                    held_over, block = keys[0], 0
                forest += search(fps[:block_rows])
                yield over(keys[:block_rows], fps[:block_rows], block)
                block += 1
                keys, fps = keys[block_rows:], fps[block_rows:]
            held_k, held_f = keys, fps
            if len(forest) > 200_000:
                forest = spanning_forest(forest)
                if len(forest) > 100_000:
                    yield _out(*map(list, zip(*forest)))
                    forest = []
        if len(held_k):
            if held_over == held_k[0]:
                yield over(held_k, held_f, block)
            forest += pairs_of(held_k, held_f)
        if forest := spanning_forest(forest):
            yield _out(*map(list, zip(*forest)))

    return run


def _compare_blocks(pdf):
    """One pair of blocks of one anchor, at most two blocks of rows."""
    import pandas as pd

    first = pdf["block"] == pdf["i"]
    found = search(pdf.loc[first, "a"].to_numpy(), pdf.loc[~first, "a"].to_numpy())
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def links(fps: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are connected (column fp, no repeats)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            keys, rows = anchors(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], ["anchor", "fp"])

    dealt = fps.select("fp").mapInArrow(expand, "anchor long, fp long").repartition("anchor")
    found = stage(
        dealt.sortWithinPartitions("anchor", "fp").mapInArrow(_compare(block_rows), "a long, b long, anchor long, block int"),
        "links",
        NARROW_ROWS,
        PLAIN,
    )
    inside = found.where("anchor is null").select("a", "b")
    over = found.where("anchor is not null")
    blocks = over.groupBy("anchor").agg(F.max("block").alias("last")).where("last > 0")
    if blocks.isEmpty():
        return inside
    paired = over.join(blocks, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).where("other <> block")
    paired = paired.select("anchor", "a", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    between = paired.groupBy("anchor", "i", "j").applyInPandas(_compare_blocks, "a long, b long")
    return inside.unionByName(between)


def _rooted(own: DataFrame, block_rows: int) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints of own (doc_id, fp): the least doc_id, and the component."""
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", codec=PLAIN)
    roots = connected_components(links(distinct, block_rows))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", block_rows: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of <= 4 bits.

    Every input row gives one row. Null or empty texts have fingerprint zero and link like any other; exact
    copies share a fingerprint and so a component; a null doc_id is kept and never names a component unless
    its component has no other. An empty table gives an empty result.
    """
    own = stage(fingerprints(docs, text), "fingerprints", TEXT_ROWS, PLAIN)
    grouped = _rooted(own, block_rows)
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp", "left").select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; it tells rows of one doc_id apart, whatever they hold."""
    plain = lambda f: isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if plain(f) else F.col(f"`{f.name}`") for f in docs.schema.fields])


#: Rows that repeat a doc_id and all else are counted down to one in so many parts first.
PARTS = 16


def keep_one(docs: DataFrame, text: str = "text", block_rows: int = BLOCK) -> DataFrame:
    """One row of docs of each component of near-duplicates: the least by (doc_id, hash of the whole row).

    Different texts under one doc_id are different documents: each counts in its own component. Rows that are equal in
    all columns count as one. Rows without a doc_id are all kept, since none can be told apart, and stand for no other.
    Null and empty texts are near-duplicates of each other. An empty table gives an empty result.
    """
    key = row_key(docs)
    own = stage(fingerprints(docs, text, key).where("doc_id is not null"), "fingerprints", TEXT_ROWS, PLAIN)
    rows = own.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "key", "n")).alias("x"))  # a row for each fingerprint, however hot
    chosen = firsts.join(_rooted(own, block_rows).select("fp", "root"), "fp").groupBy("root").agg(F.min("x").alias("x"))
    heads = stage(chosen.select(F.col("x.doc_id").alias("_id"), F.col("x.key").alias("_key"), F.col("x.n").alias("_n")), "heads", codec=PLAIN)

    shown = docs.select(*[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("_id"), key.alias("_key"))
    found = shown.join(heads.where("_n = 1"), ["_id", "_key"], "left_semi").unionByName(shown.where("_id is null"))
    again = heads.where("_n > 1")
    if not again.isEmpty():
        salted = shown.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
        parts = again.select("_id", "_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part"))
        equal = salted.join(parts, ["_id", "_key", "_part"], "left_semi")
        for by in (["_id", "_key", "_part"], ["_id", "_key"]):
            order = Window.partitionBy(*by).orderBy(*by)  # equal rows: any of them is the one
            equal = equal.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        found = found.unionByName(equal.drop("_part"))
    return restored(found, docs.columns)
