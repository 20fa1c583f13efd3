"""Token ids in binary shards, compressed by a Re-Pair grammar that allows decoding from any document on.

A shard holds documents in ascending doc_id. Frequent pairs of adjacent symbols of one document are replaced by
nonterminals, round after round (many pairs a round, without overlap); a rule is the pair it stands for, and the
shard keeps each rule's expansion length. File, little-endian:

    8 bytes  LWREPAIR
    u32 x 4  version, first nonterminal, rules, bytes a symbol (2 or 4)
    u64 x 3  documents, symbols, ids
    i64[documents] doc_id; u8[documents] 1 where doc_id is null; u64[documents + 1] first symbol; u64[documents + 1] first id
    u32[rules] left, u32[rules] right, u64[rules] expansion length
    symbols
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import TEXT_ROWS, keep_freed_memory, new_folder, stage
from loomwork.llm.files import Output, reader

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: A shard is closed at so many ids (a longer document is whole in a shard of its own).
SHARD_IDS = 1 << 20
#: Pairs replaced in one round, and the least count of a replaced pair.
PAIRS_A_ROUND, LEAST = 5000, 12
#: Distinct parts of texts whose ids a worker remembers from task to task (some 110 MB).
MEMO = 600_000

_SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces that byte-level BPE never joins: white space as its pre-tokenizer parts it, and the runs between.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Byte-level BPE writes a byte as a printable character: itself, or for the others the next one from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_POINTS = ".,;:!?"
_BLANK = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MAGIC = b"LWREPAIR"
#: The table of a round's pairs has 2**_SLOTS slots, told by multiplication with an odd number.
_SLOTS, _ODD = 20, 0x9E3779B1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Parts(dict):
    """Parts of a text, between spaces, to the bytes of their ids; each is encoded when it is first asked for.

    A part without a line feed stands for itself with a space before it. None stands for a part that can't be encoded
    by itself: one with white space at its bounds.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.tails: dict[str, bytes] = {}
        self.feed = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def letters(self, lead: str, word: str) -> bytes:
        """Letters, or a space and letters, are one piece of the pre-tokenizer, so the model takes their bytes at once."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(lead + shown)]).tobytes()

    def __missing__(self, x: str) -> bytes | None:
        if x.isalpha():
            out = self.letters(_SHOWN[0x20], x)
        elif not x or x[-1] in _BLANK or (x[0] in _BLANK and (x[0] != "\n" or x[1] in _BLANK)):
            out = None
        elif x[-1] in _POINTS and (stem := x.rstrip(_POINTS)) and stem[-1] < "\u0250" and stem[-1].isalpha():
            tail = x[len(stem) :]  # punctuation after a letter is a piece by itself
            if tail not in self.tails:
                self.tails[tail] = self.encode(tail)
            out = self[stem] + self.tails[tail]
        elif x[0] == "\n" and x[1:].isalpha():
            out = self.feed + self.letters("", x[1:])
        else:
            out = self.encode(x if x[0] == "\n" else " " + x)
        self[x] = out
        return out


def _parts_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE that changes nothing in a text, so that its parts can be told by white space."""
    own = json.loads(tokenizer.to_str())
    pre = own["pre_tokenizer"] or {}
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    model = own["model"]
    marks = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return bool(level and own["normalizer"] is None and model.get("type") == "BPE" and not marks)


class Encoder:
    """The tokenizers library's ids of a text. Its parts between spaces are encoded once and remembered.

    The string of an added token in a text (``<|endoftext|>``) is ordinary text, or with ``library`` what the library's
    call makes of it by default: the added token.
    """

    def __init__(self, path: str, library: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = _parts_at_spaces(self.tokenizer)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added and library else None
        self.library = library
        self.tokenizer.encode_special_tokens = True
        self.known = _Parts(self.tokenizer) if self.plain else {}

    def ids(self, text: str, memo: int = MEMO) -> bytes:
        """Little-endian u32 ids.

        A space before a character that is no white space always starts a piece, and a line feed between two such
        characters is a piece by itself; most texts part there. Others are parted as the pre-tokenizer does it.
        """
        if not self.plain or (self.added and self.added.search(text)):
            return self.ids_of_whole(text)
        if len(self.known) > memo:
            self.known.clear()
        try:
            return b"".join(map(self.known.__getitem__, ("\n" + text).replace("\n", " \n").split(" ")[1:]))[4:]
        except TypeError:
            return self.ids_of_chunks(text)

    def ids_of_whole(self, text: str) -> bytes:
        """By one call of the library."""
        self.tokenizer.encode_special_tokens = not self.library
        try:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def ids_of_chunks(self, text: str) -> bytes:
        own: dict[str, bytes] = {}
        chunks = _CHUNK.findall(text)
        new = list(set(chunks))
        for chunk, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            own[chunk] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(own.__getitem__, chunks))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, library: bool = False) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if (path, library) not in _encoders:
        _encoders[path, library] = Encoder(path, library)
    return _encoders[path, library]


def replace_pairs(seq: np.ndarray, last: np.ndarray, first_new: int, most: int, least: int, since: int | None = None):
    """One round: the most frequent pairs, (left, right) rows, replaced where they don't overlap. last: ends a document.

    With ``since`` only pairs with a symbol from there on are looked at. Also says whether a frequent pair was left.
    A chosen pair has no occurrence after its round: one that overlaps with another replaced pair is gone with it.
    """
    none = np.zeros((0, 2), np.int64)
    if len(seq) < 2 or most <= 0:
        return seq, last, none, False
    wide = np.uint64 if first_new + most > 1 << 16 else np.uint32
    shift = wide(32 if wide is np.uint64 else 16)
    if since is None:
        where = None
        pairs = (seq[:-1].astype(wide) << shift) | seq[1:].astype(wide)
        inside = ~last[:-1]
        ordered = np.sort(pairs[inside])
    else:
        new = seq >= since
        where = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
        pairs = (seq[where].astype(wide) << shift) | seq[where + 1].astype(wide)
        ordered = np.sort(pairs)
    if not len(ordered):
        return seq, last, none, False
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(edges, len(ordered)))
    good = np.flatnonzero(counts >= least)
    if not len(good):
        return seq, last, none, False
    left_over = len(good) > most
    if left_over:
        good = good[np.lexsort((good, -counts[good]))[:most]]
    chosen = np.sort(ordered[edges[good]])
    if where is None:
        # a table of slots; of pairs that share a slot one is taken, and the others wait for the next round
        slot_of = lambda p: (p * wide(_ODD)) >> wide(8 * wide().itemsize - _SLOTS)
        slots = np.full(1 << _SLOTS, -1, np.int16 if len(chosen) < 1 << 15 else np.int32)
        slots[slot_of(chosen)] = np.arange(len(chosen))
        first = slots[slot_of(chosen)] == np.arange(len(chosen))
        if not first.all():
            chosen, left_over = chosen[first], True
            slots[slot_of(chosen)] = np.arange(len(chosen))
        rule = slots.take(slot_of(pairs), mode="clip")
        at = np.flatnonzero((rule >= 0) & inside)
        rule = rule.take(at)
        hit = np.flatnonzero(chosen.take(rule) == pairs.take(at))
        at, rule = at.take(hit), rule.take(hit)
    else:
        rule = np.minimum(np.searchsorted(chosen, pairs), len(chosen) - 1)
        hit = chosen[rule] == pairs
        at, rule = where[hit], rule[hit]
    left = (chosen >> shift).astype(np.int64)
    right = (chosen & ((wide(1) << shift) - wide(1))).astype(np.int64)
    # of neighbouring hits every other one, from the left
    start = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1))).astype(np.int32)
    run = np.repeat(start, np.diff(np.append(start, len(at))))
    take = np.flatnonzero((np.arange(len(at), dtype=np.int32) - run) & 1 == 0)
    at, rule = at.take(take), rule.take(take)
    used = np.bincount(rule, minlength=len(chosen)) > 0  # pairs that overlapped with others everywhere give no rule
    rule = (np.cumsum(used) - 1)[rule]
    left, right = left[used], right[used]
    out, keep = seq.copy(), np.ones(len(seq), bool)
    out[at] = first_new + rule.astype(np.int64)
    keep[at + 1] = False
    ends = last.copy()
    ends[at] = last.take(at + 1)
    kept = np.flatnonzero(keep)
    return out.take(kept), ends.take(kept), np.stack([left, right], 1), left_over


def compress(ids: np.ndarray, lengths: np.ndarray, first_new: int, rounds=None, most=PAIRS_A_ROUND, least=LEAST):
    """(symbols, symbols of each document, rules) of the ids of documents with the given lengths (none is 0).

    Rounds go on (to ``rounds``, if given) until no pair has the least count, or symbols of two bytes are used up. After
    a round that left no frequent pair, only pairs with one of its new symbols can be frequent.
    """
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    seq, rules, since = ids.astype(np.uint32), np.zeros((0, 2), np.int64), None
    for _ in itertools.count() if rounds is None else range(rounds):
        after = first_new + len(rules)
        room = min(most, (1 << 16) - after) if first_new < 1 << 16 else most
        seq, last, new, left_over = replace_pairs(seq, last, after, room, least, since)
        if not len(new):
            break
        since = None if left_over else after
        rules = np.concatenate([rules, new])
    ends = np.flatnonzero(last)
    return seq, np.diff(np.concatenate(([-1], ends))), rules


def expansion_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """How many ids each rule stands for; a rule refers to ids and earlier rules."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first_new] if a >= first_new else 1) + (out[b - first_new] if b >= first_new else 1))
    return np.array(out, np.int64)


def expansions(rules: np.ndarray, first_new: int) -> np.ndarray:
    """The ids of all rules, one after another: pairs are put in place of nonterminals until none is left."""
    seq = rules.reshape(-1)
    while (new := seq >= first_new).any():
        sizes = 1 + new.astype(np.int64)
        at = (np.cumsum(sizes) - sizes)[new]
        pairs = rules[seq[new] - first_new]
        seq = np.repeat(seq, sizes)
        seq[at], seq[at + 1] = pairs[:, 0], pairs[:, 1]
    return seq.astype(np.uint32)


def expand(symbols: np.ndarray, pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first_new: int) -> np.ndarray:
    """The ids that the symbols stand for. pool has the expansions of all rules one after another."""
    rule = symbols >= first_new
    if not rule.any():
        return symbols.astype(np.uint32)
    every = np.concatenate([np.arange(first_new, dtype=np.uint32), pool])  # ids stand for themselves
    own = symbols[rule].astype(np.int64) - first_new
    sizes, places = np.ones(len(symbols), np.int64), symbols.astype(np.int64)
    sizes[rule], places[rule] = lengths[own], first_new + starts[own]
    ends = np.cumsum(sizes)
    at = np.repeat(places - (ends - sizes), sizes)
    at += np.arange(len(at))
    return every.take(at)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int, least: int = LEAST) -> bytes:
    symbols, per_doc, rules = compress(ids, lengths, vocabulary, least=least)
    sizes = expansion_lengths(rules, vocabulary).astype("<u8")
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    firsts = lambda n: np.concatenate(([0], np.cumsum(n))).astype("<u8").tobytes()
    return b"".join(
        [
            MAGIC,
            np.array([1, vocabulary, len(rules), width], "<u4").tobytes(),
            np.array([len(doc_ids), len(symbols), len(ids)], "<u8").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            firsts(per_doc),
            firsts(lengths),
            rules[:, 0].astype("<u4").tobytes(),
            rules[:, 1].astype("<u4").tobytes(),
            sizes.tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        ]
    )


class Shard:
    """A shard opened for reads: the tables at once, the symbols of a document only when it is asked for."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(48, 0)
        if bytes(head[:8]) != MAGIC:
            raise ValueError("not a token shard")
        _, self.first_new, n_rules, self.width = np.frombuffer(head[8:24], "<u4").tolist()
        self.n_docs, self.n_symbols, self.n_ids = np.frombuffer(head[24:48], "<u8").tolist()
        at = 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            data = file.read_at(n * np.dtype(kind).itemsize, at)
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(data, kind)

        ids, missing = take("<i8", self.n_docs).tolist(), take("u1", self.n_docs).tolist()
        self.doc_ids = [None if m else x for x, m in zip(ids, missing)]
        self.first_symbol = take("<u8", self.n_docs + 1).astype(np.int64)
        self.first_id = take("<u8", self.n_docs + 1).astype(np.int64)
        rules = np.stack([take("<u4", n_rules), take("<u4", n_rules)], 1).astype(np.int64)
        self.lengths = take("<u8", n_rules).astype(np.int64)
        self.pool = expansions(rules, self.first_new)
        if not np.array_equal(expansion_lengths(rules, self.first_new), self.lengths) or len(self.pool) != self.lengths.sum():
            raise ValueError("the rules don't have their stated lengths")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = at

    def ids(self, k: int, to: int | None = None) -> np.ndarray:
        """The ids of document k, or of documents k to ``to``."""
        a, z = self.first_symbol[k], self.first_symbol[k + 1 if to is None else to]
        data = self.file.read_at(int(z - a) * self.width, self.at + int(a) * self.width)
        return expand(np.frombuffer(data, f"<u{self.width}"), self.pool, self.starts, self.lengths, self.first_new)

    def ids_at(self, k: int, a: int, z: int) -> np.ndarray:
        """Ids a to z of document k; expansion lengths tell which symbols are needed."""
        first = int(self.first_symbol[k])
        n = int(self.first_symbol[k + 1]) - first
        symbols = np.frombuffer(self.file.read_at(n * self.width, self.at + first * self.width), f"<u{self.width}")
        sizes = np.ones(n, np.int64)
        rule = symbols >= self.first_new
        sizes[rule] = self.lengths[symbols[rule].astype(np.int64) - self.first_new]
        ends = np.cumsum(sizes)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, z, "left")) + 1
        part = expand(symbols[i:j], self.pool, self.starts, self.lengths, self.first_new)
        skip = a - int(ends[i - 1] if i else 0)
        return part[skip : skip + max(0, z - a)]


def write(
    docs: DataFrame,
    folder: str,
    text: str = "text",
    tokenizer: str | None = None,
    shard_ids: int = SHARD_IDS,
    memo: int = MEMO,
    library: bool = False,
    least: int = LEAST,
) -> DataFrame:
    """Encode every text (null: empty), append END, write shards to the folder in ascending doc_id.

    Returns the manifest (part, shard, name, n_docs, n_ids); (part, shard) is the order of the documents.
    Null doc_ids come first; rows that repeat a doc_id are ordered by their text. Only files in the manifest count:
    a task that is repeated after a lost executor writes new ones.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        encoder = encoder_of(tokenizer or tokenizer_path(), library)
        vocabulary = encoder.tokenizer.get_vocab_size()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        data: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            out = Output(folder, f"tokens-{part:06d}-{number:06d}", ".repair")
            out.write(pack(doc_ids, np.array([len(x) // 4 for x in data], np.int64), ids, vocabulary, least))
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"part": part, "shard": number, "name": out.name, "n_docs": len(doc_ids), "n_ids": len(ids)}], schema=_MANIFEST
            )

        end = np.array([END], "<u4").tobytes()
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = encoder.ids(t or "", memo) + end
                if held and held + len(own) // 4 > shard_ids:
                    yield close()
                    doc_ids, data, held, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                data.append(own)
                held += len(own) // 4
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(dealt.mapInArrow(run, "part int, shard int, name string, n_docs long, n_ids long"), "manifest", TEXT_ROWS)


_MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: the ids of all shards before. Sums of parts (as many as write tasks) go to the driver."""
    from pyspark.sql import Window

    spark = manifest.sparkSession
    before, bases = 0, []
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r["part"], before))
        before += r["n"]
    parts = spark.createDataFrame(bases, "part int, part_base long")
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = manifest.withColumn("_in", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return inside.join(parts, "part").withColumn("base", F.col("part_base") + F.col("_in")).drop("_in", "part_base")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with reader(folder, name) as file:
                    shard = Shard(file)
                    ids = shard.ids(0, shard.n_docs).astype("<u4")
                bounds = shard.first_id.tolist()
                sums = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array([base + a for a in bounds[:-1]], pa.int64()),
                        pa.array(np.diff(shard.first_id), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = manifest.count()  # a few shards a task; a fixed number, since the rows are too small to tell their work
    shards = placed(manifest).select("name", "base").repartition(max(1, min(20_000, n // 3 + 1)), "name")
    return stage(shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"), "tokens")


def encoded(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str | None = None,
    shard_ids: int = SHARD_IDS,
    memo: int = MEMO,
    library: bool = False,
    least: int = LEAST,
) -> DataFrame:
    """Write docs as token shards in the shared folder and read every document back from them.

    The string of an added token in a text is ordinary text; with ``library`` it is the added token, as in the plain call
    of the library. Pairs of ids are replaced as long as one has the count ``least`` in its shard.

    One row per input row: doc_id, start (ids of all documents before), n_tokens (END included), ids_crc32.
    Null and empty texts are END alone. An empty table writes no shard and gives no row.
    """
    folder = new_folder(docs.sparkSession, "shards")
    return read(write(docs, folder, text, tokenizer, shard_ids, memo, library, least), folder)
