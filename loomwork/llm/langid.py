"""Language identification by compression: the language whose zstandard dictionary encodes a text in the fewest bytes.

A text is encoded in blocks, and the sizes of all its blocks are summed for each language. Any number of languages can be
learned: dictionaries lie in the shared folder, and a task holds the encoders of a bounded number of them at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import TEXT_ROWS, new_folder, stage
from loomwork.llm.files import Output, reader

#: The training sample's bound: so many documents a language, so many characters of each.
DOCS_PER_LANGUAGE = 48
CHARS_PER_DOC = 2048
#: Up to so many languages their counts go to every task, so that a frequent language's rows are thinned where they are.
FEW = 100_000
#: Encoders in memory at a time (about 1 MB each), and the bytes of text that are held against one group after the other.
AT_ONCE, HELD_BYTES = 256, 1 << 24
#: A prediction is rejected if the best encoding is not smaller than the second best by this share of it.
MARGIN = 0.01
LEVEL = 6
UNKNOWN = "und"
#: Encoded before each text, so that zstandard never stores a short text raw; it costs the same in each language.
BALLAST = b"\n" * 256
#: Bytes that are encoded at a time, each block against the fresh dictionary: later text of a document would match the
#: document itself, equally well in every language, and the margin would fade with its length.
BLOCK = 1 << 13
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower case, with one space for each run of what is no letter."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out() -> Column:
    """True for documents whose crc32 of the id as text leaves remainder 2 by 4; nothing is learned from them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def write_dictionaries(docs: DataFrame, folder: str, text: str = "text") -> list[tuple[str, str]]:
    """(language, file of its dictionary) from labelled documents that are not held out, the most frequent language first.

    The sample is bounded (see the constants) and chosen by a hash of doc_id, so it does not depend on partitions; nothing
    of it comes to the driver but the languages' names. Rows without text, lang or doc_id are not learned from; no
    labelled row gives no language.
    """
    own = docs.where("lang is not null and doc_id is not null").where(~held_out()).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.substring(text, 1, CHARS_PER_DOC).alias("_text"))
    counts = stage(own.groupBy("lang").agg(F.count("*").alias("_count")), "counts")
    if counts.count() <= FEW:
        counts = F.broadcast(counts)
    scale = 1_000_000_000
    share = F.least(F.lit(scale), F.floor(F.lit(scale * 4 * DOCS_PER_LANGUAGE) / F.col("_count")) + 1)
    key = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    near = own.where("_text is not null").withColumn("_key", key).join(counts, "lang").where(F.col("_key") < share)
    order = Window.partitionBy("lang").orderBy("_key", "doc_id", "_text")
    rows = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DOCS_PER_LANGUAGE)
    texts = rows.groupBy("lang").agg(F.max("_count").alias("count"), F.array_sort(F.collect_list(F.struct("_n", "_text"))).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = []
            for x in b.column(2).to_pylist():
                out = Output(folder, "language", ".dict")
                out.write(b" ".join(normal(t) for t in x))
                out.close()
                names.append(out.name)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string())], ["lang", "count", "name"])

    plain = texts.select("lang", "count", F.transform("texts", lambda x: x["_text"]).alias("texts"))
    found = stage(plain.mapInArrow(run, "lang string, count long, name string"), "dictionaries", TEXT_ROWS)
    return [(r["lang"], r["name"]) for r in found.orderBy(F.desc("count"), "lang").collect()]


def contents(folder: str, names: Iterable[tuple[str, str]]) -> list[tuple[str, bytes]]:
    out = []
    for lang, name in names:
        with reader(folder, name) as f:
            out.append((lang, f.read()))
    return out


def train(docs: DataFrame, text: str = "text") -> list[tuple[str, bytes]]:
    """The languages and their dictionaries themselves; see ``write_dictionaries``."""
    folder = new_folder(docs.sparkSession, "languages")
    return contents(folder, write_dictionaries(docs, folder, text))


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.encoders = []
        for lang, data in dictionaries:
            content = zstandard.ZstdCompressionDict(data or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.encoders.append((lang, zstandard.ZstdCompressor(dict_data=content, compression_params=params)))

    def sizes(self, text: str) -> list[int]:
        """The bytes of a text by each encoder."""
        data = normal(text)
        blocks = [BALLAST + data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for _, e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): ``und`` and 0 for a text without letters; ties go to the more frequent language."""
        if not has_letter(text) or not self.encoders:
            return UNKNOWN, 0.0
        best = Best()
        best.see(0, self.sizes(text))
        return best.told([lang for lang, _ in self.encoders])


class Best:
    """The smallest and the second smallest of the sizes seen, and the language of the smallest."""

    def __init__(self):
        self.first: tuple[int, int] | None = None
        self.second: int | None = None

    def see(self, start: int, sizes: list[int]) -> None:
        """Sizes of the languages from number ``start`` on."""
        for k, size in enumerate(sizes, start):
            if self.first is None or size < self.first[0]:
                self.first, self.second = (size, k), self.first and self.first[0]
            elif self.second is None or size < self.second:
                self.second = size

    def told(self, langs: list[str]) -> tuple[str, float]:
        size, k = self.first
        return langs[k], 1.0 if self.second is None else 1.0 - size / self.second


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_kept: dict[str, Classifier] = {}


def predictions(folder: str, names: list[tuple[str, str]], texts: list[str | None], at_once: int = AT_ONCE) -> list[tuple[str, float]]:
    """(language, margin) of each text, by the dictionaries in the folder, a group of them at a time."""
    langs = [lang for lang, _ in names]
    if len(names) <= at_once:
        if folder not in _kept:  # a process keeps the encoders of one folder
            _kept.clear()
            _kept[folder] = Classifier(contents(folder, names))
        return [_kept[folder].predict(t) for t in texts]
    found = [Best() if has_letter(t) else None for t in texts]
    for start in range(0, len(names), at_once):
        own = Classifier(contents(folder, names[start : start + at_once]))
        for best, t in zip(found, texts):
            if best:
                best.see(start, own.sizes(t))
    return [best.told(langs) if best else (UNKNOWN, 0.0) for best in found]


def _groups(batches: Iterator[pa.RecordBatch], at: int, single: bool, held: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches one by one, or as many as hold so many bytes of text."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        waiting.append(b)
        size += b.column(at).nbytes
        if single or size >= held:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def classify(docs: DataFrame, text: str = "text", margin: float = MARGIN, at_once: int = AT_ONCE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (share of bytes saved against the second language), rejected.

    Trained on the table itself. A text that is null or has no letter is ``und`` with score 0 and rejected, as is any
    prediction whose score is under ``margin``. Whole texts are encoded; lang, source and doc_id play no part in a
    prediction. Every row, repeated ones too, gives one row.
    """
    folder = new_folder(docs.sparkSession, "languages")
    names = write_dictionaries(docs, folder, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, 2, len(names) <= at_once, HELD_BYTES):
            found = iter(predictions(folder, names, [t for b in own for t in b.column(2).to_pylist()], at_once))
            for b in own:
                told = [next(found) for _ in range(len(b))]
                langs, scores = [x for x, _ in told], [s for _, s in told]
                rejected = [x == UNKNOWN or s < margin for x, s in told]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return stage(rows.mapInArrow(run, schema), "languages", TEXT_ROWS)


def accepted(docs: DataFrame, text: str = "text", margin: float = MARGIN, at_once: int = AT_ONCE) -> DataFrame:
    """The rows of docs whose language is told with a sufficient margin, with all their columns, whatever their names.

    Null and empty texts and texts without a letter go; all of repeated rows stay or go alike. Where there is one language
    only its margin is 1; where there is none, nothing stays. An empty table gives an empty one.
    """
    folder = new_folder(docs.sparkSession, "languages")
    names = write_dictionaries(docs, folder, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, at, len(names) <= at_once, HELD_BYTES):
            found = iter(predictions(folder, names, [t for b in own for t in b.column(at).to_pylist()], at_once))
            for b in own:
                told = [next(found) for _ in range(len(b))]
                yield b.filter(pa.array([x != UNKNOWN and s >= margin for x, s in told], pa.bool_()))

    return stage(docs.mapInArrow(run, docs.schema), "accepted", TEXT_ROWS)
