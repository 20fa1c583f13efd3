import hashlib
import math
import platform
import random
import subprocess
import sys
import warnings
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import linededup, mixing, quality, tokenbin, warc
from loomwork.llm.common import new_folder, stage

ROOT = Path(__file__).resolve().parents[2]


# ---- archives


def brute_archive(rows):
    own = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in own:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in own:
        revisit = len(b) >= 100 and b in first and i != first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return out


def pages_case():
    big, other = "<p>é" + "x" * 120, "<p>" + "y" * 97
    rows = [(i, f"http://h{i % 3}.example.com/p/{i}", big if i % 3 == 0 else f"<p>{i}" + "z" * 200) for i in range(40)]
    rows += [(50, "https://User@A.B.example.org:8080/x?q=1#f", other), (51, "no url\n", other), (52, None, None), (53, "http://e.com", "")]
    return rows + [(54, "http://e.com", ""), (None, "http://n.com", big), (60, "http://e.com/\t", "short")]


def key(x):
    return tuple((v is not None, v) for v in x)


def test_archives_round_trip(spark):
    rows = pages_case()
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = [tuple(x)[:5] for x in warc.archived(d).collect()]
    assert sorted(got, key=key) == sorted(brute_archive(rows), key=key)
    assert warc.archived(d.limit(0)).count() == 0


def test_repeated_rows_are_all_found(spark):
    rows = [(1, "http://a.com/x", "q" * 150)] * 3 + [(2, "http://a.com/x", "q" * 150)]
    got = [tuple(x)[:5] for x in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=key) == sorted(brute_archive(rows), key=key)


def test_two_level_index_finds_every_capture(spark):
    rows = pages_case()
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = new_folder(spark, "test")
    captures = warc.write_archives(d, folder)
    index = warc.write_index(captures, folder, block_lines=3)
    files = sorted((r["first_key"], r["first_page"], r["name"], r["at"]) for r in index.collect())
    opened = [warc.IndexFile(folder, name, at) for *_, name, at in files]
    lines = [line for f in opened for k in range(len(f.directory)) for line in f.block(k)]
    assert [tuple(x[:2]) for x in lines] == sorted(tuple(x[:2]) for x in lines) and len(lines) == len(rows)
    wanted = warc.url_key("http://h1.example.com/p/4")
    assert [x[1] for f in opened for x in f.find(wanted)] == [4]
    assert not [x for f in opened for x in f.find("com,example,nowhere)/")]
    asked = spark.createDataFrame([(warc.url_key("http://e.com"), 53), (warc.url_key("http://e.com"), 54)], "key string, page long")
    found = warc.read_records(warc.locate(asked, index, folder), folder).collect()
    assert sorted(x.page_id for x in found) == [53, 54]


def test_url_keys_sort_hosts_by_domain():
    assert warc.url_key("https://User@A.B.example.org:8080/x?q=1#f") == "org,example,b,a:8080)/x?q=1"
    assert warc.url_key("http://e.com") == "com,e)/" and warc.url_key(None) == "-"


# ---- quality


def brute_base(text):
    text = text or ""
    words, current = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [current] if current else []
            current = ""
        else:
            current += c
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n#é\x1c　|", max_size=120))
def test_base_counts(text):
    assert quality.base(text) == brute_base(text)


def numbered(text):
    """Characters as the model has them: digits alike, code points beyond 16 bits by their upper bits."""
    return [0, 0, 0] + [48 if x in "0123456789" else ord(x) if ord(x) < 1 << 16 else 0xD800 + (ord(x) >> 10) for x in text]


def brute_model(texts):
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""
    top = Counter()
    for t in texts:
        c = numbered(t)
        top.update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    counts = {4: top}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, context = {}, {}
    for k in range(1, 5):
        n = Counter(min(v, 5) for v in counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        discount[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] else 0.5 for i in (1, 2, 3)]
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, v in counts[k].items():
            context[k][g[:-1]][0] += v
            context[k][g[:-1]][1] += discount[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / 65536
        k = len(g)
        total, taken = context[k].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        v = counts[k].get(g, 0)
        return (v - discount[k][min(v, 3)] if v else 0) / total + taken / total * p(g[1:])

    return p


def test_model_is_kneser_ney(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("aeiklmnostЖ漢😀7") for _ in range(r.randint(1, 7))) for _ in range(25)) for _ in range(60)]
    d = spark.createDataFrame([(5, t) for t in texts] + [(9, "ENTIRELY ## other"), (9, None), (9, "")], "m int, text string").repartition(3)
    levels = quality.probabilities(quality.count_grams(d))
    p = brute_model(texts)
    pack = lambda g: sum(c << 16 * (3 - i) for i, c in enumerate(g))
    grams = [tuple(r.choice([0, 32, 97, 105, 120, 0x416, 0x6F22]) for _ in range(4)) for _ in range(60)]
    for t in texts[:5]:
        c = numbered(t)
        grams += [tuple(c[i : i + 4]) for i in range(len(c) - 3)]
    for chunk in (quality.CHUNK, 50):
        folder = new_folder(spark, "test")
        chunks = quality.write_model(levels, folder, chunk)
        assert set(chunks) == {5, 9} and (chunk > 50 or len(chunks[5]) > 2 * quality.CHUNKS)  # more than are kept at hand
        assert all(own == sorted(own) and max(n for *_, n in own) <= chunk for own in chunks.values())
        model = quality.Model(folder, chunks)
        got = model.log_p(np.array([pack(g) for g in grams], np.uint64), 5)
        assert np.allclose(got, [math.log(p(g)) for g in grams], atol=1e-4)
        own = [[tuple(numbered(t)[i : i + 4]) for i in range(len(t))] for t in texts]
        want = [sum(math.log(p(g)) for g in x) / len(x) for x in own]
        for _ in range(2):  # the second time from what is remembered
            assert np.allclose(model.mean_log_p([*texts, ""], [5] * 61)[:60], want, atol=1e-4)
    h = grams[-1][:3]
    assert abs(np.exp(model.log_p(np.array([pack((*h, w)) for w in range(1 << 16)], np.uint64), 5)).sum() - 1) < 1e-3
    assert model.mean_log_p(["", "x"], [5, 77])[0] is None and model.log_p(np.array([1], np.uint64), 77)[0] == -math.log(1 << 16)


def test_long_texts_are_scored_in_slices(spark, monkeypatch):
    text = "slices of a text, 12 of them; " * 40
    whole = np.concatenate(list(quality.grams(text)))
    monkeypatch.setattr(quality, "SLICE", 7)
    assert (np.concatenate(list(quality.grams(text))) == whole).all() and len(whole) == len(text)
    c = numbered(text)
    assert whole.tolist() == [sum(x << 16 * (3 - i) for i, x in enumerate(c[k : k + 4])) for k in range(len(text))]


def test_language_is_the_primary_subtag(spark):
    want = {"en": "en", "EN": "en", "en-US": "en", "zh-Hant": "zh", "pt_BR": "pt", "sr-Latn-RS": "sr", "deu": "deu", None: "und", "": "und", "x-own": "und", "english": "und", "en-": "und"}
    d = spark.createDataFrame([(x,) for x in want], "lang string")
    assert {x.lang: x.code for x in d.withColumn("code", quality.language()).collect()} == want


def test_quality_verdicts(spark):
    r = random.Random(8)
    line = lambda n: " ".join("".join(r.choice(["ta", "ko", "mi", "sen", "ul"]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, line(r.randint(30, 80)), "en") for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, line(10), "en"), (203, "same words here again now and then too " * 9, "en"), (204, "ZQ#9 " * 3 + "Wq!! " + " ".join(f"X{i}%V" for i in range(40)), "en")]
    d = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, lang string, kept int")
    out = {x.doc_id: x for x in quality.rated(d).collect()}
    for i, t, _ in rows:
        b = brute_base(t)
        x = out[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == b
        assert x.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (x.kept and x.base_failed)
    assert sum(out[i].kept for i in range(120)) >= 118
    assert not out[203].kept and not out[204].kept and out[204].base_failed is False
    assert quality.rated(d.limit(0)).count() == 0


def test_a_rare_language_has_bands_too(spark):
    r = random.Random(18)
    line = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, line(["ta", "ko", "mi", "sen", "ul"], 60), "en") for i in range(200)]
    rows += [(1000 + i, line(["ж", "ба", "но", "ли"], 200), "ru-RU") for i in range(24)]
    rows += [(2000 + i, " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(5)) for _ in range(200)), "ru") for i in range(2)]
    rows += [(3000, line(["x", "y"], 40), "tlh"), (3001, line(["q", "w"], 40), None)]
    out = {x.doc_id: x for x in quality.rated(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(x.low is not None for x in out.values())
    assert sum(out[1000 + i].kept for i in range(24)) >= 23 and not out[2000].kept and not out[2001].kept
    assert out[3000].kept and out[3001].kept and sum(out[i].kept for i in range(200)) >= 196


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) u(i)),
r AS (SELECT doc_id, g FROM k GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM k SEMI JOIN r USING (doc_id, g)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT,
  coalesce((SELECT sum(n - 1) FROM l WHERE l.doc_id = d.doc_id), 0)::BIGINT, coalesce(x.n, 0)::BIGINT
FROM d LEFT JOIN x USING (doc_id)
"""


def test_base_columns_of_quality_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.execute(QUALITY_SQL).fetchall())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(x) for x in quality.rated(spark.read.parquet(path)).select(*names).collect()) == want


# ---- lines


def lines_case():
    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    base = [" ".join(word() for _ in range(r.randint(6, 14))) for _ in range(30)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(r.randint(1, 6)):
            line = r.choice(base)
            if r.random() < 0.5:
                k = r.randrange(len(line))
                line = line[:k] + "#" + line[k + 1 :]
            own.append(r.choice([line, line.upper(), "  " + line.replace(" ", "  "), "", "short"]))
        rows.append((i, "\n".join(own)))
    hot = base[0] + " " + base[1]
    rows += [(100 + i, hot[:i] + "*" + hot[i + 1 :]) for i in range(len(hot))]
    return rows + [(300, None), (301, ""), (302, " \n\n"), (None, base[2])]


def brute_lines(rows):
    where = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            n = " ".join(line.lower().split())
            if n:
                where[n].append((-1 if i is None else i, k))
    names = list(where)
    sets = [{n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in names]
    label = list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-12 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    best = {}
    for n, x in zip(names, label):
        best[x] = min(([best[x]] if x in best else []) + where[n])
    return {at: best[x] for n, x in zip(names, label) for at in where[n]}


def test_lines_against_brute_force(spark):
    rows = lines_case()
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, line int").repartition(3)
    want = brute_lines(rows)
    id_of = lambda x: -1 if x is None else x
    for block in (linededup.BLOCK, 7):
        out = linededup.line_components(d, block=block).collect()
        got = {(id_of(x.doc_id), x.line_no): (id_of(x.component_doc), x.component_line) for x in out}
        assert got == want and len(out) == len(want)
        assert {k for k, v in want.items() if k == v} == {(id_of(x.doc_id), x.line_no) for x in out if x.kept}
    texts = {x.doc_id: x.text for x in linededup.deduplicated(d).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if want.get((id_of(i), k), (id_of(i), k)) == (id_of(i), k)]
        assert texts[i] == (None if t is None else "\n".join(kept))
    assert linededup.line_components(d.limit(0)).count() == 0


def test_freed_memory_serves_the_next_arrays():
    code = """
import resource
import numpy as np
from loomwork.llm import common
common.keep_freed_memory()
work = lambda: [np.ones(1 << 19, np.uint32) for _ in range(8)]
work()
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(20):
    work()
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    if platform.libc_ver()[0] != "glibc":
        pytest.skip("another C library")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(out.stdout) < 10_000  # of 81,920 pages


def test_line_bitmap_is_fetched_by_one_job(spark):
    hashes = [r.h for r in spark.range(500).selectExpr("xxhash64(id) AS h").collect()]
    d = spark.createDataFrame([(h,) for h in hashes], "h long")
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = linededup.bitmap(d)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(filled[(at := h % (len(filled) * 8)) >> 3] >> (at & 7) & 1 for h in hashes)
    assert int(np.bitwise_count(filled).sum()) <= 500
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) <= 4


def test_lines_lowered_as_a_whole_are_as_by_themselves():
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 10]
    texts = ["", " ", "\n", "A b\n\nC", "ΑΣ\nΣΑΣ ΑΣ.\nΣ", "İI ſ\nẞ", " A", "A ", "A\n B", "A \nB", "a  b", *(f"Ab{x}Cd\nE" for x in spaces), *(f"é{x}\nÉ" for x in spaces)]
    for t in texts:
        assert linededup.normal_lines(t) == [linededup.normal(x) for x in t.split("\n")]


def test_similarity_of_sorted_numbers():
    a, b = "abcabcabcabcabcabd", "xabcabcabcabcabcabc"
    x, y = (linededup.distinct(linededup.packed(t)) for t in (a, b))
    assert linededup.similarity_of_distinct(x, y) == linededup.similarity(linededup.shingles(a), linededup.shingles(b))


def test_signatures_estimate_similarity():
    a = "the quick brown fox jumps over the lazy dog and runs away into the woods"
    b = a.replace("lazy", "lamy")
    s = linededup.signatures([a, b, "zz"])
    share = (s[0] == s[1]).mean()
    assert abs(share - linededup.similarity(linededup.shingles(a), linededup.shingles(b))) < 0.2
    assert (linededup.signatures([b])[0] == s[1]).all()


# ---- mixing


def mixing_case(spark, n=3000):
    r = random.Random(12)
    rows = []
    for i in range(n):
        source = "big" if r.random() < 0.5 else f"s{r.randrange(4)}"
        rows.append((i, "w " * r.randint(1, 9) + r.choice(["", " | ", "a@b"]), source, r.choice(["en", "en", "de", None])))
    rows += [(n + i, "w w w", None, "en") for i in range(30)] + [(n + 30 + i, "" if i % 2 else None, "s1", "de") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mixture_meets_its_targets(spark):
    d = mixing_case(spark)
    out = mixing.mixture(d).toPandas()
    assert len(out) == 3040 and out.probability.between(0, 1).all() and out.probability.max() == 1
    w = out.tokens * out.weight
    for c, power in mixing.POWERS.items():
        t = out.groupby(c).tokens.sum() ** power
        got = w.groupby(out[c]).sum() / w.sum()
        assert np.allclose(got.sort_index(), (t / t.sum()).sort_index(), atol=1e-4)
    assert abs((out.tokens * out.sampled).sum() / (out.tokens * out.probability).sum() - 1) < 0.1
    again = mixing.mixture(d.repartition(7)).toPandas().set_index("doc_id").sampled
    assert (again.sort_index() == out.set_index("doc_id").sampled.sort_index()).all()
    kept = mixing.sample(d)
    assert kept.columns == d.columns and set(kept.toPandas().doc_id) == set(out[out.sampled].doc_id)


def test_mixture_takes_given_targets_and_runs_no_python(spark):
    d = mixing_case(spark, 500)
    cells = mixing.keyed(d).groupBy(*[F.col(f"_{x}").alias(x) for x in mixing.DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))
    targets = {x: mixing.tempered(cells, x, 0.0 if x == "source" else 1.0) for x in mixing.DIMENSIONS}
    out = mixing.mixture(d, targets=targets)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    p = out.toPandas()
    share = (p.tokens * p.weight).groupby(p.source).sum()
    assert np.allclose(share / share.sum(), 1 / len(share), atol=1e-3)
    assert mixing.mixture(d.limit(0)).count() == 0


def test_one_rare_document_does_not_decide_what_is_kept(spark):
    d = mixing_case(spark)
    rare = spark.createDataFrame([(9000, "w " * 50, "rare", "en")], "doc_id long, text string, source string, lang string")
    out = mixing.mixture(d.unionByName(rare)).toPandas().set_index("doc_id")
    assert len(out) == 3041 and out.probability.between(0, 1).all() and out.probability[9000] == 1
    kept = out.tokens * out.probability
    assert abs(kept.sum() / out.tokens.sum() - mixing.LEAST_KEPT) < 1e-4
    assert abs((out.tokens * out.sampled).sum() / kept.sum() - 1) < 0.1
    # levels that can have their share have it; those that are too small are whole, and the others keep their proportions
    for c, power in mixing.POWERS.items():
        n = out.groupby(c).tokens.sum()
        got, target = kept.groupby(out[c]).sum(), n**power
        free = got < n * (1 - 1e-6)
        ratio = (got / target)[free]
        assert free.any() and ratio.max() / ratio.min() < 1.01
        assert ((got / target)[~free] <= ratio.max() * 1.01).all()


def test_rows_and_tables_rake_alike(spark):
    d = mixing_case(spark, 400)
    cells = mixing.keyed(d).groupBy(*[F.col(f"_{x}").alias(x) for x in mixing.DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))
    cells = stage(cells, "cells")
    targets = {x: stage(mixing.tempered(cells, x, 0.5), "targets") for x in mixing.DIMENSIONS}
    targets["topic"] = targets["topic"].where("topic <> 'empty'").unionByName(spark.createDataFrame([("nowhere", 0.01)], "topic string, target double"))
    a, b = ({tuple(x[:4]): x.weight for x in mixing.rake(cells, targets, sweeps=6, in_a_row=n).collect()} for n in (10_000, 0))
    assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) <= 1e-9 * abs(b[k]) for k in a)


def test_targets_that_contradict_each_other_are_reported(spark):
    rows = [(i, "w w w", "only-de" if i % 2 else "s", "de" if i % 2 else "en") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    share = lambda c, a, b: spark.createDataFrame([(a, 0.9), (b, 0.1)], f"{c} string, target double")
    targets = {"source": share("source", "only-de", "s"), "language": share("language", "en", "de"), "topic": spark.createDataFrame([("note", 1.0)], "topic string, target double")}
    with pytest.warns(RuntimeWarning, match="off their targets"):
        assert mixing.mixture(d, targets=targets).count() == 40
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert mixing.mixture(mixing_case(spark, 200)).count() == 240


# ---- tokens


def reference_ids(text):
    return tokenbin.encoder_of(tokenbin.tokenizer_path()).tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab1' \t\n\r\x1c\x85\xa0é!?.,|s")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_library_s(text):
    got = np.frombuffer(tokenbin.encoder_of(tokenbin.tokenizer_path()).ids(text), "<u4").tolist()
    assert got == reference_ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=80), min_size=1, max_size=12))
def test_grammar_round_trip(docs):
    lengths = np.array([len(x) for x in docs])
    ids = np.concatenate([np.array(x) for x in docs]).astype(np.uint32)
    symbols, per_doc, rules = tokenbin.compress(ids, lengths, 10, rounds=6, most=5, least=2)
    assert per_doc.sum() == len(symbols) and len(per_doc) == len(docs)
    pool, sizes = tokenbin.expansions(rules, 10), tokenbin.expansion_lengths(rules, 10)
    ends = np.cumsum(per_doc)
    for k, doc in enumerate(docs):
        part = symbols[ends[k] - per_doc[k] : ends[k]]
        assert tokenbin.expand(part, pool, np.cumsum(sizes) - sizes, sizes, 10).tolist() == doc


def test_grammar_goes_on_until_no_pair_is_frequent():
    r = random.Random(3)
    doc = [r.randrange(9) for _ in range(700)]
    docs = [doc] * 200
    data = tokenbin.pack(list(range(200)), np.array([700] * 200), np.array(doc * 200), 10)
    shard = tokenbin.Shard(pa.BufferReader(data))
    assert shard.n_symbols == 200 and shard.lengths.max() == 700  # each copy is one symbol
    assert all(shard.ids(k).tolist() == docs[k] for k in (0, 99, 199)) and shard.ids_at(7, 20, 333).tolist() == doc[20:333]


def test_grammar_compresses_and_decodes_anywhere():
    r = random.Random(1)
    docs = [[r.choice([5, 6]) if r.random() < 0.1 else v for v in [1, 2, 3, 4] * r.randint(1, 60)] for _ in range(40)]
    ids = np.array(sum(docs, []), np.uint32)
    data = tokenbin.pack([None, *range(1, 40)], np.array([len(x) for x in docs]), ids, 10)
    shard = tokenbin.Shard(pa.BufferReader(data))
    assert shard.n_symbols < len(ids) / 2 and shard.doc_ids[0] is None
    for k in (0, 7, 39):
        assert shard.ids(k).tolist() == docs[k]
        for a, z in ((0, 1), (3, len(docs[k])), (len(docs[k]) - 1, len(docs[k]))):
            assert shard.ids_at(k, a, z).tolist() == docs[k][a:z]


def test_shards_round_trip(spark):
    r = random.Random(3)
    rows = [(i * 7 % 101, " ".join(r.choice(["alpha", "beta.", "gamma\nx", "  ", "été!", "12"]) for _ in range(r.randint(0, 40)))) for i in range(100)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|>")]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, start int").repartition(5)
    for shard_ids in (tokenbin.SHARD_IDS, 50):
        got = {x.doc_id: x for x in tokenbin.encoded(d, shard_ids=shard_ids).collect()}
        at = 0
        for i, t in sorted(rows):
            ids = reference_ids(t or "") + [2]
            assert (got[i].start, got[i].n_tokens) == (at, len(ids))
            assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
    assert got[502].n_tokens > 2
    assert tokenbin.encoded(d.limit(0)).count() == 0
    twice = tokenbin.encoded(d.unionByName(d)).agg(F.count("*"), F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert twice[0] == 2 * len(rows) and twice[1] == twice[2] == 2 * at


def fresh_ids(text, name=tokenbin.TOKENIZER):
    """By a tokenizer that nothing has been changed in."""
    import public_tokenizers
    from tokenizers import Tokenizer

    if name not in _fresh:
        _fresh[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _fresh[name].encode(text, add_special_tokens=False).ids


_fresh = {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", " ", "\n", "hello", "<|", "|>", " world"]), st.text(max_size=9)), max_size=8))
def test_ids_of_the_plain_call(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    got = tokenbin.encoder_of(tokenbin.tokenizer_path(), True).ids(text)
    assert np.frombuffer(got, "<u4").tolist() == fresh_ids(text)
    if "<|endoftext|>" not in text:
        assert got == tokenbin.encoder_of(tokenbin.tokenizer_path()).ids(text)


def test_ids_of_added_tokens_by_either_rule():
    text = "hello <|endoftext|> world"
    ids = lambda library: np.frombuffer(tokenbin.encoder_of(tokenbin.tokenizer_path(), library).ids(text), "<u4").tolist()
    assert ids(True) == fresh_ids(text) and 50256 in ids(True) and 50256 not in ids(False) and len(ids(False)) > len(ids(True))


def test_ids_of_a_tokenizer_of_another_kind():
    import public_tokenizers

    for text in ("Some Words,  here\nand there", "", "été <|endoftext|> x"):
        got = tokenbin.encoder_of(public_tokenizers.path("word_bpe_49k.json"), True).ids(text)
        assert np.frombuffer(got, "<u4").tolist() == fresh_ids(text, "word_bpe_49k.json")


def test_query_s_ids_are_the_plain_call_s(spark, tmp_path):
    from loomwork.llm.queries import op6_tokens

    rows = [(3, "a <|endoftext|> b"), (1, None), (2, "word " * 300_000), (9, "<|endoftext|><|endoftext|>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in op6_tokens(spark, str(tmp_path)).collect()}
    at = 0
    for i, t in sorted(rows):
        ids = fresh_ids(t or "") + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_grammar_of_repetitive_ids_is_small():
    period = list(range(12))
    data = tokenbin.pack([1], np.array([60_000]), np.array(period * 5000, np.uint32), 12, least=2)
    shard = tokenbin.Shard(pa.BufferReader(data))
    assert shard.n_symbols + len(shard.lengths) <= 60 and shard.ids(0).tolist() == period * 5000
    for symbols, _, rules in [tokenbin.compress(np.array([1, 1, 1, 2, 1, 1, 2, 2] * 900, np.uint32), np.array([7200]), 10, least=2)]:
        assert set(range(10, 10 + len(rules))) <= set(symbols.tolist()) | set(rules.reshape(-1).tolist())  # every rule is used


def test_very_long_texts(spark):
    """A text of some megabytes beside a null and an empty one: archives, lines and licences have it whole."""
    from loomwork.llm import licenses

    line = "a line of words that differs by its number only "
    text = "\n".join(f"{line}{k}" for k in range(60_000)) + "\nAll rights reserved, at the very end"
    rows = [(1, "http://a.com/1", text), (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/4", text)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(x)[:5] for x in warc.archived(pages).collect()]
    assert sorted(got, key=key) == sorted(brute_archive(rows), key=key)
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    found = {x.doc_id: x for x in licenses.scan(docs).collect()}
    assert found[1].n_base == 1 and found[1].last_word == found[1].n_words - 7 and found[2].n_words == 0
    lines = linededup.line_components(docs.where("doc_id < 4")).collect()
    assert len(lines) == 60_001 and {x.component_line for x in lines if x.line_no < 60_000} == {0}


def test_candidates_of_runs_of_any_length():
    r = random.Random(2)
    for _ in range(200):
        rows = []
        for key in range(r.randint(1, 6)):
            rows += [(key, r.randrange(40)) for _ in range(r.choice([1, 3, 10, 60]))]
        step = r.randint(1, len(rows))
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([h for _, h in part], pa.int64())], ["key", "h"]) for part in (rows[i : i + step] for i in range(0, len(rows), step))]
        out = [tuple(x.values()) for b in linededup._candidates(iter(batches), r.choice([15, 1 << 16])) for x in b.to_pylist()]
        groups = defaultdict(set)
        for k, h in rows:
            groups[k].add(h)
        small = {(a, b) for own in groups.values() if len(own) <= linededup.SHORT_RUN for a in own for b in own if a < b}
        large = {(h, k) for k, own in groups.items() if len(own) > linededup.SHORT_RUN for h in own}
        assert {(min(a, b), max(a, b)) for a, b, _ in out if b is not None} == small and {(a, k) for a, b, k in out if b is None} == large
