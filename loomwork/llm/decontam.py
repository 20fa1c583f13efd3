"""Benchmark decontamination: one Aho-Corasick automaton over the 13-word windows of normalised benchmark items.

Windows are made and grouped by Spark and written to the shared folder in blocks of bounded size. A scanning task has the
automaton of one block in memory: it is built once where there is one block; else the task takes its texts some tens of
megabytes at a time and holds them against one block after the other, so texts are read once and memory doesn't grow
with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import NARROW_ROWS, TEXT_ROWS, new_folder, stage
from loomwork.llm.files import Output, reader
from loomwork.llm.words import WordAutomaton, offsets, words_of

WINDOW = 13
#: Windows of one automaton, about (some 200 MB), and the bytes of text that are held against one block after the other.
WINDOWS_PER_AUTOMATON, HELD_BYTES = 200_000, 1 << 25


def windows(text: bytes | None, width: int = WINDOW) -> set[tuple[bytes, ...]]:
    """The windows of one item; an item of fewer words, but not none, is one window."""
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def write_windows(benchmark: DataFrame, folder: str, text: str, width: int = WINDOW, most: int = WINDOWS_PER_AUTOMATON) -> list[str]:
    """Writes the windows with the ids of their items in blocks of about ``most`` windows; the names of the files.

    Windows are told apart and their items gathered by Spark. Items without an id have windows, too, but no name.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(b" ".join(w), i) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) for w in windows(t, width)]
            for at in range(0, len(found), NARROW_ROWS):
                part = found[at : at + NARROW_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([i for _, i in part], pa.string())], ["w", "i"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = sink = block = None

        def close() -> pa.RecordBatch:
            writer.close()
            out.write(sink.getvalue().to_pybytes())
            out.close()
            return pa.RecordBatch.from_pydict({"name": [out.name]})

        for b in batches:
            blocks = b.column(0).to_pylist()
            at = 0
            while at < len(blocks):
                to = at
                while to < len(blocks) and blocks[to] == blocks[at]:
                    to += 1
                if block != blocks[at]:
                    if out:
                        yield close()
                    block, out, sink = blocks[at], Output(folder, "windows", ".arrow"), pa.BufferOutputStream()
                    writer = pa.ipc.new_stream(sink, _WINDOWS)
                own = [c.slice(at, to - at).cast(f.type) for c, f in zip(b.columns[1:], _WINDOWS)]
                writer.write_batch(pa.RecordBatch.from_arrays(own, schema=_WINDOWS))
                at = to
        if out:
            yield close()

    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col(text).alias("t"))
    found = stage(rows.mapInArrow(expand, "w binary, i string").groupBy("w").agg(F.collect_set("i").alias("items")), "windows")
    blocks = max(1, -(-found.count() // most))
    dealt = found.select(F.pmod(F.xxhash64("w"), F.lit(blocks)).alias("block"), "w", "items")
    dealt = dealt.repartition(min(blocks, 20_000), "block").sortWithinPartitions("block")
    return [r["name"] for r in stage(dealt.mapInArrow(run, "name string"), "blocks", 2000).collect()]


_WINDOWS = pa.schema([("w", pa.binary()), ("items", pa.list_(pa.string()))])
_built: dict[tuple[str, str], WordAutomaton] = {}


def automaton_of(folder: str, name: str) -> WordAutomaton:
    """The automaton of a block; a process has one at a time."""
    if (folder, name) not in _built:
        _built.clear()
        with reader(folder, name) as f:
            own = pa.ipc.open_stream(f.read()).read_all()
        phrases = {tuple(w.split(b" ")): tuple(items) for w, items in zip(own.column(0).to_pylist(), own.column(1).to_pylist())}
        _built[folder, name] = WordAutomaton(phrases)
    return _built[folder, name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_HITS = "n_words long, hits array<struct<a:int,z:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, most: int = WINDOWS_PER_AUTOMATON, held: int = HELD_BYTES) -> DataFrame:
    """docs with n_words, hits (merged spans of words inside any occurring window) and items (sorted ids).

    Texts are scanned whole. Null and empty texts have no words and no hits; null and empty items match nothing; repeated
    items count once by id; an item without an id hits words but is not named; every input row stays. Columns of docs
    named n_words, hits or items would clash with the result and raise.
    """
    clash = {"n_words", "hits", "items"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the result's own")
    folder = new_folder(docs.sparkSession, "windows")
    names = write_windows(benchmark, folder, text, width, most)
    at = docs.columns.index(text)

    def scanned(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [b.column(at).cast(pa.binary()).to_pylist() for b in waiting]
        spans: list[list] = [[[] for _ in own] for own in texts]
        items: list[list] = [[set() for _ in own] for own in texts]
        counts: list[list[int]] = [[0] * len(own) if names else [len(words_of(t)) for t in own] for own in texts]
        for name in names:
            automaton = automaton_of(folder, name)
            for k, own in enumerate(texts):
                for i, t in enumerate(own):
                    w = words_of(t)
                    counts[k][i] = len(w)
                    found = automaton.find(w)
                    if found:
                        spans[k][i] = merged(spans[k][i] + [(a, z) for a, z, _ in found])
                        items[k][i].update(*(x for _, _, x in found))
        for b, n, hits, named in zip(waiting, counts, spans, items):
            own = [
                pa.array(n, pa.int64()),
                pa.array([[{"a": a, "z": z} for a, z in x] for x in hits], _SPANS),
                pa.array([sorted(x) for x in named], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "n_words", "hits", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            waiting.append(b)
            size += b.column(at).nbytes
            if len(names) < 2 or size >= held:
                yield from scanned(waiting)
                waiting, size = [], 0
        if waiting:
            yield from scanned(waiting)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, {_HITS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, most: int = WINDOWS_PER_AUTOMATON) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans of the original text.

    A row is contaminated if n_hit > 0 and 20 * n_hit >= n_words. spans are code-point offsets of the hit passages. Null
    and empty texts have no words and are clean; every row, repeated ones too, gives one row; other columns are ignored;
    empty tables give no rows, or no hits. See ``scan`` for items.
    """
    found = scan(docs.select("doc_id", F.col(text).alias("text")), benchmark.select("item_id", F.col(text).alias("text")), "text", width, most)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            n_hit, where, digests = [], [], []
            for t, hits, items in rows:
                n_hit.append(sum(h["z"] - h["a"] for h in hits))
                where.append([{"start": a, "end": z} for a, z in offsets(t, [(h["a"], h["z"]) for h in hits])] if hits else [])
                digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            n_words = b.column(2)
            verdict = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    n_words,
                    pa.array(n_hit, pa.int64()),
                    pa.array(map(len, b.column(4).to_pylist()), pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(verdict, pa.bool_()),
                    pa.array(where, kind),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return stage(found.mapInArrow(spans, schema), "hits", TEXT_ROWS)


def clean_only(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    Null and empty texts are clean and stay, as do all of repeated rows that are clean. An empty benchmark removes nothing.
    """
    rest = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    found = scan(docs.select(*rest, F.col(text).alias("_text")), benchmark.select("item_id", F.col("text").alias("_text")), "_text")
    n_hit = F.aggregate("hits", F.lit(0), lambda s, h: s + h["z"] - h["a"])
    kept = found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words"))))
    return stage(kept.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)]), "clean", TEXT_ROWS)
