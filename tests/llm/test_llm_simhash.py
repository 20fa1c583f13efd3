import random

import numpy as np
import pyarrow as pa
import xxhash

from loomwork.llm import simhash
from loomwork.llm.components import connected_components, spanning_forest


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    """The smallest id of each row's component over links of at most four bits."""
    out, left = [None] * len(ids), set(range(len(ids)))
    while left:
        group, queue = [], [left.pop()]
        while queue:
            i = queue.pop()
            group.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 4}
            left -= near
            queue += near
        best = min(ids[i] for i in group)
        for i in group:
            out[i] = best
    return out


def test_fingerprint_is_the_plain_one():
    r = random.Random(5)
    texts = ["", "  \t", "One", "a b c", "A B C D", "x " * 50]
    texts += [" ".join(r.choice("ab cd ef Gh éa ij kl".split()) for _ in range(r.randint(1, 60))) for _ in range(60)]
    for t in [None, *texts]:
        got = simhash.fingerprint(None if t is None else t.encode()) & (1 << 64) - 1
        assert got == brute_fingerprint(t)


def test_linked_fingerprints_share_an_anchor_within_two_bits():
    r = random.Random(7)
    a = np.array([r.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for x in a], np.uint64)
    ka, ra = simhash.anchors(a.view(np.int64))
    kb, rb = simhash.anchors(b.view(np.int64))
    of_a, of_b = [set() for _ in a], [set() for _ in b]
    for k, i in zip(ka.tolist(), ra.tolist()):
        of_a[i].add(k)
    for k, i in zip(kb.tolist(), rb.tolist()):
        of_b[i].add(k)
    assert all(x & y for x, y in zip(of_a, of_b))
    for i in range(50):
        for k in of_a[i]:
            half, word = k >> 31, k & (1 << 31) - 1
            assert ((int(a[i]) >> 31 * half & (1 << 31) - 1) ^ word).bit_count() <= 2


def make(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")


def test_links_connect_what_brute_force_connects_in_any_block_size(spark):
    r = random.Random(11)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for _ in range(150)}
    fps |= {r.getrandbits(64) for _ in range(100)} | {0}
    fps = sorted(fps)
    want = brute_components(fps, fps)
    for rows in (1 << 16, 20):
        edges = simhash.links(make(spark, fps), rows)
        low = (1 << 64) - 1
        pairs = [(x.a & low, x.b & low) for x in edges.collect()]
        assert all((x ^ y).bit_count() <= 4 for x, y in pairs)
        label = {f: f for f in fps}
        for x, y in spanning_forest(pairs):
            roots = {label[x], label[y]}
            low_root = min(roots)
            label = {k: low_root if v in roots else v for k, v in label.items()}
        assert [label[f] for f in fps] == want


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    base = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(300))
    texts = [base, base, base.upper()]
    for _ in range(30):
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(40)] + [None, "", " \n", "one"]
    rows = [(i * 3, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")  # fp clashes with the operator's own name
    got = {x.doc_id: x for x in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components([i for i, *_ in rows], fps)
    assert [got[i].component_id for i, *_ in rows] == want
    assert [got[i].fingerprint for i, *_ in rows] == [f"{f:016x}" for f in fps]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_edge_rows(spark):
    rows = [(1, "same text here now"), (1, "same text here now"), (None, "same text here now"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == 4 and {x.component_id for x in out} == {1, 2}
    kept = sorted((x.doc_id or -1) for x in simhash.keep_one(docs).collect())
    assert kept == [-1, 1, 2]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7), (None, 3)]
    out = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in [e for e in edges if None not in e and e[0] != e[1]]:
        x, y = label.get(a, a), label.get(b, b)
        label.setdefault(a, a), label.setdefault(b, b)
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert out == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, group, work):
    """What the work gives, and how many jobs it ran."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_take_one_task_and_many_take_rounds(spark):
    r = random.Random(2)
    pairs = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(400)] + [(1000 + i, 1001 + i) for i in range(90)]
    edges = spark.createDataFrame(pairs + pairs[:50], "a long, b long").repartition(3)
    work = lambda at_once: lambda: sorted(map(tuple, connected_components(edges, at_once=at_once).collect()))
    few, jobs = jobs_of(spark, "few", work(1 << 20))
    forest, _ = jobs_of(spark, "forest", work(500))  # few enough once each task has dropped what connects nothing new
    many, _ = jobs_of(spark, "many", work(0))
    assert few == forest == many
    assert jobs <= 6


def blocks_case(r, sizes):
    """(anchor, fingerprint) in order: for each anchor so many fingerprints, some of them linked."""
    keys, fps = [], []
    for k, n in enumerate(sizes):
        base = [r.getrandbits(63) for _ in range(max(1, n // 3))]
        own = set()
        while len(own) < n:
            own.add(r.choice(base) ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 5))))
        keys += [k] * n
        fps += sorted(own)
    return np.array(keys, np.int64), np.array(fps, np.int64)


def test_links_of_an_anchor_are_found_whatever_the_blocks_and_batches():
    """Anchors whose rows end exactly with a block, or within it, in batches of any size: all links are found."""
    r = random.Random(17)
    for trial in range(250):
        block = r.randint(2, 8)
        sizes = [r.choice([block, 2 * block, 3 * block, r.randint(1, 3 * block)]) for _ in range(r.randint(1, 6))]
        keys, fps = blocks_case(r, sizes)
        step = r.randint(1, len(keys))
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(fps[i : i + step])], ["anchor", "fp"]) for i in range(0, len(keys), step)]
        out = pa.Table.from_batches(simhash._compare(block)(iter(batches)), schema=simhash._EDGE).to_pylist()
        pairs = [(x["a"], x["b"]) for x in out if x["anchor"] is None]
        dealt = {}
        for x in out:
            if x["anchor"] is not None:
                dealt.setdefault(x["anchor"], {}).setdefault(x["block"], []).append(x["a"])
        for own in dealt.values():
            for i in own:
                for j in own:
                    if i < j:
                        pairs += simhash.search(np.array(own[i]), np.array(own[j]))
        for k in range(len(sizes)):
            own = fps[keys == k].tolist()
            want = brute_components(own, own)
            label = {f: f for f in own}
            for x, y in [p for p in pairs if p[0] in label and p[1] in label]:
                a, b = sorted((label[x], label[y]))
                label = {f: a if v == b else v for f, v in label.items()}
            assert [label[f] for f in own] == want, (trial, block, sizes, step)


def test_one_row_stays_of_each_group_whatever_the_ids(spark):
    """Texts that share an id, rows that are equal, columns that clash, maps: a defined row of each group stays."""
    a, b = "the first text has these words", "quite another text stands under the same number"
    rows = [(1, a, 5, {"k": "v"}), (1, a, 5, {"k": "v"}), (1, a, 6, None), (1, b, 5, None), (2, a, 5, None), (3, b, 1, None), (4, None, 0, None), (5, "", 0, None)]
    rows += [(7, "hot row of equal rows", 1, None)] * 300 + [(None, a, 9, None)] * 2
    d = spark.createDataFrame(rows, "doc_id int, text string, _key int, root map<string,string>").repartition(5)
    for blocks in (1 << 16, 2):
        kept = simhash.keep_one(d, block_rows=blocks)
        assert kept.columns == d.columns and kept.schema["root"] == d.schema["root"]
        got = sorted(((x.doc_id or 0, x.text or "") for x in kept.collect()))
        assert got == [(0, a), (0, a), (1, b), (1, a), (4, ""), (7, "hot row of equal rows")]
    again = simhash.keep_one(d.repartition(3)).where("text = 'the first text has these words' and doc_id is not null").collect()
    assert [tuple(x) for x in again] == [tuple(x) for x in kept.where("doc_id = 1").collect() if x.text == a]
    assert simhash.keep_one(d.limit(0)).count() == 0
