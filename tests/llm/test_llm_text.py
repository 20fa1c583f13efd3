import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from loomwork.llm import decontam, langid, licenses
from loomwork.llm.words import WordAutomaton, offsets, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_words(text):
    return WORD.findall(lowered(text))


def test_words_are_the_contract_s():
    for t in ["", None, "A-b c_d É9É x\u0085y", "Ünï  Ab1!2", "\x00\x7f{}`@[z"]:
        assert [w.decode() for w in words_of(None if t is None else t.encode())] == brute_words(t)


def test_offsets_are_of_code_points_in_the_original():
    text = "é One, twO — three\nÄ four"
    spans = offsets(text.encode(), [(1, 3), (4, 6)])
    assert [text[a:b] for a, b in spans] == ["One, twO", "three\nÄ"]


def brute_contamination(text, items):
    w = brute_words(text)
    hit, named = [False] * len(w), set()
    for item_id, t in items:
        x = brute_words(t)
        if not x:
            continue
        windows = [x[i : i + 13] for i in range(max(1, len(x) - 12))]
        for win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    named.add(str(item_id))
                    hit[i : i + len(win)] = [True] * len(win)
    n = sum(hit)
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(w), n, len(named), digest, n > 0 and 20 * n >= len(w)


def contamination_case():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(r.choice([3, 5, 13, 20, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (3, sentence(30))]
    docs = []
    for i in range(60):
        parts = [sentence(r.randint(0, 60))]
        if i % 3 == 0:
            parts.append(items[r.randrange(25)][1].upper().replace(" ", ",  "))
        parts.append(sentence(r.randint(0, 200)))
        docs.append((i, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (100, None)], items


@pytest.mark.parametrize("most", [10_000, 30])
def test_contamination_against_brute_force(spark, most):
    docs, items = contamination_case()
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, hits string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contaminated(d.select("doc_id", "text"), b, most=most).collect()
    got = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in out)
    assert got == sorted((i, *brute_contamination(t, items)) for i, t in docs)
    for x in out:
        text = dict(docs)[x.doc_id]
        assert sum(len(brute_words(text[s.start : s.end])) for s in x.spans) == x.n_hit
    clean = decontam.clean_only(d, b)
    assert clean.columns == d.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(i for i, t in docs if not brute_contamination(t, items)[-1])


def test_contamination_with_nothing_to_look_for(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.contaminated for x in decontam.contaminated(d, none).collect()] == [False]
    assert decontam.contaminated(d.limit(0), d.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_licence_expressions():
    assert licenses.postfix("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)") == [
        "mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or",
    ]
    assert licenses.evaluate("MIT or GPL-3.0-only") == (["gpl-3.0-only", "mit"], "permissive")
    assert licenses.evaluate("MIT AND GPL-3.0+")[1] == "copyleft"
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == (["gpl-2.0-only"], "permissive")
    assert licenses.evaluate("CC-BY-NC-4.0 OR Unheard-Of")[1] == "restricted"
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL", "MIT WITH (GPL)", "()"):
        with pytest.raises(licenses.BadExpression):
            licenses.evaluate(bad)


def brute_longest(line):
    """By trying every prefix."""
    tokens, at = [], 0
    while m := licenses._TOKEN.match(line, at):
        tokens.append(m[1] or m[2])
        at = m.end()
    for n in range(len(tokens), 0, -1):
        text = " ".join(tokens[:n]).replace("( ", "(").replace(" )", ")")
        try:
            return text, *licenses.evaluate(text)
        except licenses.BadExpression:
            continue
    return None


def test_licence_expressions_of_any_length():
    r = random.Random(7)
    for _ in range(3000):
        line = " ".join(r.choice("MIT GPL-2.0-only AND OR WITH ( ) ( ) MIT Isc".split()) for _ in range(r.randint(0, 14))) + r.choice(["", " */"])
        assert licenses.longest_expression(line) == brute_longest(line)
    names = [f"Licence-{i}" for i in range(3000)]
    text, found, _ = licenses.longest_expression(" OR ".join(names) + " */")
    assert text == " OR ".join(names) and found == sorted(x.lower() for x in names)
    text, found, terms = licenses.longest_expression("(" + " AND ".join(["MIT"] * 60) + " AND GPL-3.0-only) more words")
    assert text.endswith("GPL-3.0-only)") and found == ["gpl-3.0-only", "mit"] and terms == "copyleft"


def test_licence_scan_against_brute_force(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    texts = [
        "All rights reserved. ALL-RIGHTS  reserved!", "cc by cc by-sa", "the GNU General Public License, v2", "nothing here", None, "", "Ccby",
        "x // SPDX-License-Identifier: (MIT OR Apache-2.0) */\nLicensed under the Apache License, Version 2.0.",
        "reserved all rights", "general public general public license",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in licenses.scan(d).collect()}
    for i, t in enumerate(texts):
        w = brute_words(t)
        found = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = out[i]
        assert (x.n_words, x.n_base) == (len(w), len(found))
        assert x.first_word == min((k for k, _ in found), default=None) and x.last_word == max((k for k, _ in found), default=None)
        assert x.base_labels == ",".join(sorted({v for _, v in found}))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert out[7].expressions == ["(MIT OR Apache-2.0)"] and {"mit", "apache-2.0"} <= set(out[7].labels.split(",")) and out[7].terms == "permissive"
    assert licenses.scan(d.limit(0)).count() == 0


def language_docs(n=240):
    r = random.Random(4)
    parts = {"en": "the ing ly and tion er".split(), "de": "der ung und sch keit ü".split(), "xx": "qo zu ki wa ömp ta".split()}
    rows = []
    for i in range(n):
        lang = ["en", "de", "xx", "en"][i % 4]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60))), lang))
    return rows


def test_language_held_out_accuracy_and_rejections(spark):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 .. !!", "de"), (1003, "the and", None), (None, "der und die", "de")]
    rows = language_docs() + odd
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in langid.classify(d).collect()}
    import zlib

    tested = [r for r in language_docs() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[i].held_out for i, *_ in tested)
    assert sum(out[i].lang_pred == lang for i, _, lang in tested) >= 0.95 * len(tested)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(out[i].rejected and out[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= x.score <= 1 for x in out.values()) and len(out) == len(rows)
    kept = langid.accepted(d)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, x in out.items() if not x.rejected}


def test_language_of_long_texts_is_told_as_clearly(spark):
    rows = language_docs()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    classifier = langid.Classifier(langid.train(d))
    r = random.Random(5)
    for lang, parts in (("en", "the ing ly and tion er".split()), ("de", "der ung und sch keit ü".split())):
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(600_000)]
        long = " ".join(words)
        assert len(long) > 3_000_000
        told, margin = classifier.predict(long)
        short = classifier.predict(long[: langid.BLOCK // 2])[1]
        assert told == lang and margin >= langid.MARGIN and margin > 0.5 * short


def test_language_learns_nothing_from_held_out_or_other_columns(spark):
    rows = language_docs()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = d.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert langid.train(d) == langid.train(wrong.select("source", "lang", "text", "doc_id").repartition(5))
    assert langid.train(d.limit(0)) == [] and langid.classify(d.limit(0)).count() == 0
    none = langid.classify(d.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()
    assert [x.lang_pred for x in none] == ["und"] * 3


def scanned(text):
    return licenses.scan_text(text.encode(), WordAutomaton(licenses._phrases()))


def test_prose_is_no_licence_expression():
    for text in ("A license expression must be agreed by both sides.", "The license expression: must be agreed.", "SPDX license identifier MIT is short."):
        x = scanned(text)
        assert x["expressions"] == [] and x["terms"] in (None, "permissive") and not {"must", "is"} & set(x["labels"].split(","))
    x = scanned("License-Expression: MIT OR must\nspdx-license-identifier = 'LicenseRef-Own AND Gpl-2.0-or-later WITH Classpath-exception-2.0'")
    assert x["labels"] == "gpl-2.0-or-later,licenseref-own,mit" and len(x["expressions"]) == 2 and x["terms"] == "unknown"


def test_known_identifiers():
    good = "MIT MIT-0 Apache-2.0 BSD-3-Clause BSD-2-Clause-Patent GPL-3.0-or-later LGPL-2.1+ CC-BY-NC-SA-4.0 CC0-1.0 0BSD Zlib MPL-2.0 BSL-1.0 Artistic-1.0-Perl LicenseRef-x"
    assert all(map(licenses.known, good.split()))
    assert not any(map(licenses.known, "must the Foo-1.0 mitten gplx MIT-licensed a 2.0".split()))


def test_tags_without_number_in_one_line_or_many():
    n = 20_000
    for gap in (" ; ", "\n", " é; "):
        start = time.perf_counter()
        x = scanned(gap.join(["SPDX-License-Identifier: MIT AND ISC"] * n))
        assert len(x["expressions"]) == n and x["labels"] == "isc,mit" and time.perf_counter() - start < 20
    x = scanned("SPDX-License-Identifier: " + " OR ".join(f"LicenseRef-{i}" for i in range(40)))
    assert len(x["labels"].split(",")) == 40


BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) v(words, label)),
h AS (SELECT doc_id, k - 1 AS place, label FROM d, p, unnest(range(1, len(w) - len(words) + 2)) u(k) WHERE w[k:k + len(words) - 1] = words)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(place)::BIGINT AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN h USING (doc_id) GROUP BY ALL
"""


def test_base_columns_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.execute(BASE_SQL).fetchall())
    got = licenses.scan(spark.read.parquet(path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == want and any(x[2] for x in want)


def plain_prediction(text, dictionaries):
    """By a fresh compressor for each block and language, without precomputed dictionaries or groups."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")
    sizes = []
    for lang, own in dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
        total = 0
        for at in range(0, len(data), langid.BLOCK):
            d = zstandard.ZstdCompressionDict(own or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            total += len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(langid.BALLAST + data[at : at + langid.BLOCK]))
        sizes.append(total)
    best = sizes.index(min(sizes))
    rest = sizes[:best] + sizes[best + 1 :]
    return dictionaries[best][0], 1 - sizes[best] / min(rest) if rest else 1.0


def plain_dictionaries(rows):
    """The training sample chosen in plain Python: only its documents, their first characters, in the order of their ids' hashes."""
    own = [r for r in rows if r[0] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return Counter(r[2] for r in own)


@pytest.mark.parametrize("at_once", [langid.AT_ONCE, 2])
def test_language_against_plain_compression(spark, at_once, monkeypatch):
    monkeypatch.setattr(langid, "HELD_BYTES", 500)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "½ ² ３", "de"), (1003, "the and", None), (1004, "der und " * 4000, "de"), (1005, "Ünd ª", "de")]
    rows = language_docs(80) + odd
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    dictionaries = langid.train(d)
    counts = plain_dictionaries(rows)
    assert [x for x, _ in dictionaries] == sorted(counts, key=lambda x: (-counts[x], x))
    texts = dict((r[0], r[1]) for r in rows)
    for lang, own in dictionaries:  # every learned text is there, cut to its bound, and nothing else
        learned = [langid.normal(t[: langid.CHARS_PER_DOC]) for i, t, x in rows if x == lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
        assert all(t in own for t in learned) and len(own) == sum(map(len, learned)) + len(learned) - 1
    out = {x.doc_id: x for x in langid.classify(d, at_once=at_once).collect()}
    for i, t in texts.items():
        lang, score = plain_prediction(t, dictionaries)
        assert out[i].lang_pred == lang and abs(out[i].score - score) < 1e-12 and out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert out[i].rejected == (lang == "und" or score < langid.MARGIN)
    assert out[1002].lang_pred == "und" and out[1005].lang_pred != "und"
    assert {x.doc_id for x in langid.accepted(d, at_once=at_once).collect()} == {i for i, x in out.items() if not x.rejected}


def test_more_languages_than_are_held_at_once(spark):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(9):
        parts = ["".join(r.sample(letters, 3)) for _ in range(6)]
        rows += [(100 * k + i, " ".join("".join(r.choice(parts) for _ in range(2)) for _ in range(50)), f"l{k}") for i in range(24)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x.lang_pred for x in langid.classify(d, at_once=4).collect()}
    assert out == {x.doc_id: x.lang_pred for x in langid.classify(d).collect()} and len(set(out.values())) == 9


def test_items_without_an_id_and_clashing_columns(spark):
    b = spark.createDataFrame([(None, "secret words of an item"), (7, "other words of it")], "item_id long, text string")
    d = spark.createDataFrame([(1, "the secret words of an item stand here"), (2, "Other-words of it! secret words of an item")], "doc_id long, text string")
    got = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256) for x in decontam.contaminated(d, b).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (5, 0, sha("")), 2: (9, 1, sha("7"))}
    for name in ("hits", "N_words"):
        with pytest.raises(ValueError):
            decontam.scan(d.withColumn(name, F.lit(1)), b)


def test_very_long_text_against_a_benchmark_in_blocks(spark):
    r = random.Random(3)
    items = [(i, " ".join(f"x{r.randrange(900)}" for _ in range(30))) for i in range(40)]
    filler = " ".join(f"y{k}" for k in range(400_000))
    text = f"{filler} {items[3][1]} {filler} {items[9][1].upper()}"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (10_000, 50):
        x = decontam.contaminated(d, b, most=most).where("doc_id = 1").first()
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (800_060, 60, 2, False)
        assert [text[s.start : s.end].lower() for s in x.spans] == [items[3][1], items[9][1]]
