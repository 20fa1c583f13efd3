import random
import zlib

import numpy as np

from loomwork.llm import decontam, langid, mixing, simhash, tokenbin


def corpus(spark, folder):
    r = random.Random(21)
    parts = {"en": "the ing ly and tion er".split(), "de": "der ung und sch keit ü".split()}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3)))
    items = [(i, " ".join(word("en") + str(i) for _ in range(20))) for i in range(5)]
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        text = " ".join(word(lang) for _ in range(r.randint(60, 120)))
        if i % 20 == 5:
            text = rows[-1][1]  # an exact copy
        if i % 20 == 9:
            text = text[: len(text) // 2] + " " + items[i % 5][1] + " " + text[len(text) // 2 :]
        rows.append((i, text, lang, f"src{i % 4 if i % 2 else 0}", len(text)))
    rows += [(900, "123", "en", "src0", 3), (901, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark, tmp_path):
    import corpus_pipeline as p

    d = str(tmp_path / "sf")
    corpus(spark, d)
    assert [name for name, _ in p.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    benchmark = spark.read.parquet(f"{d}/benchmark.parquet")
    ids = lambda df: {x.doc_id for x in df.select("doc_id").collect()}
    found = {x.doc_id for x in langid.classify(docs).collect() if not x.rejected}
    now = docs
    for name, step in p.STAGES:
        before, now = now, step(spark, now, d)
        if name != "tokens":
            assert now.columns == docs.columns
        if name == "language":
            assert ids(now) == found and not {900, 901} & found
        if name == "near_duplicates":
            assert ids(now) == {x.component_id for x in simhash.near_duplicates(before).collect()}
            assert len(ids(now)) < before.count()
        if name == "decontamination":
            bad = {x.doc_id for x in decontam.contaminated(before, benchmark).collect() if x.contaminated}
            assert bad and ids(now) == ids(before) - bad
        if name == "mixture":
            assert ids(now) == {x.doc_id for x in mixing.mixture(before).collect() if x.sampled}
        if name == "tokens":
            at, encoder = 0, tokenbin.encoder_of(tokenbin.tokenizer_path())
            got = {x.doc_id: x for x in now.collect()}
            for x in before.orderBy("doc_id").collect():
                own = encoder.tokenizer.encode(x.text, add_special_tokens=False).ids + [2]
                assert (got[x.doc_id].start, got[x.doc_id].n_tokens, got[x.doc_id].ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
                at += len(own)
    whole = {tuple(x) for x in p.run(spark, d).collect()}
    assert whole == {tuple(x) for x in got.values()}


def test_entry_registers_the_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(e.oracle_sql()) <= set(names)
