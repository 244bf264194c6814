"""The pipeline's near duplicates against all pairs of sets."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from notelake.llm import jaccard
from test_pipeline_operators import ODD, docs

SF = "/root/testdata/sf0.1"


def kept_by_pairs(rows):
    """The plain definition: a document stays if it has the least id of what is linked to it."""

    def shingles(text):
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    ids = defaultdict(list)
    for i, text in rows:
        ids[shingles(text)].append(i)
    sets = list(ids)
    group, where = list(range(len(sets))), defaultdict(list)

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
            where[x].append(k)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(j), root(k)))
                group[b] = a
    least = defaultdict(list)
    for k, s in enumerate(sets):
        least[root(k)] += ids[s]
    return {min(x) for x in least.values()}


def test_near_duplicates_equal_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, SF).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_pairs([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])


def test_large_group_of_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*words[: 7 * (i % 28)], f"x{i}", *words[7 * (i % 28) + 1 :]]) for i in range(400)]
    texts += [" ".join(f"{w}y{i}" if k % 12 == 0 else w for k, w in enumerate(words)) for i in range(200)]
    rows = [(i, t, "en", "a", 1, 1.0, "x", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), SF).collect()}
    assert got == kept_by_pairs([r[:2] for r in rows]) and len(got) == 201


def test_few_links_among_many_nodes_of_one_key(spark, monkeypatch):
    """Texts of one template that are linked in pairs only, in keys of many parts: every pair is found."""
    monkeypatch.setattr(jaccard, "BUCKET", 2)
    monkeypatch.setattr(jaccard, "PART_NODES", 4)
    words = [f"w{k}" for k in range(300)]

    def text(i):
        own = [f"{w}y{i // 2}" if k % 60 == i // 2 % 60 or k % 75 == 7 else w for k, w in enumerate(words)]
        return " ".join(own if i % 2 == 0 else [*own[:150], f"z{i}", *own[151:]])

    rows = [(i, text(i), "en", "a", 1, 1.0, "x", 1) for i in range(240)]
    want = kept_by_pairs([r[:2] for r in rows])
    got = {r["doc_id"] for r in jaccard.keep_one(docs(spark, rows)).select("doc_id").collect()}
    assert got == want and len(want) == 120


def test_odd_rows(spark):
    kept = [tuple(r)[:2] for r in jaccard.keep_one(docs(spark, ODD)).collect()]
    assert sorted((i for i, _ in kept), key=str) == [1, 3, 5, 6, None]
    assert jaccard.keep_one(docs(spark, [])).count() == 0
    only = [(None, "a b c d", None, None, 1, 1.0, "x", 1)] * 3
    assert jaccard.keep_one(docs(spark, only)).count() == 1


def test_one_id_with_two_texts(spark):
    rows = [(3, "one text of five words", 1), (3, "quite another text of seven words here", 2), (3, "one text of five words", 3), (4, "one text of five words", 4), (None, "a third text without an id", 5), (None, "a third text without an id", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __kept int")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([(3, rows[0][1]), (3, rows[1][1]), (None, rows[4][1])], key=str)


def test_fingerprint_is_that_of_the_set():
    found = jaccard.shingles("a b c d e f g a b c d e f g h i j k")
    bits = [sum(int(h) >> b & 1 for h in found) * 2 > len(found) for b in range(64)]
    # the bytes of a hash are little-endian here: any fixed order of bits will do, the same for all
    assert bin(jaccard.fingerprint_of(found) & (1 << 64) - 1).count("1") == sum(bits)


def test_joining_equals_pairs():
    rng = np.random.default_rng(4)
    base = np.arange(300)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(180, 300), replace=False), rng.integers(1000, 9000, rng.integers(0, 40))])) for _ in range(120)]
    nodes, roots = np.arange(120) * 3, np.arange(120) // 2
    u, v = jaccard.joining(nodes, roots, np.concatenate(sets), np.array([len(s) for s in sets]))
    near = lambda a, b: 5 * (i := len(np.intersect1d(a, b))) >= 4 * (len(a) + len(b) - i)
    assert all(near(sets[a // 3], sets[b // 3]) and roots[a // 3] != roots[b // 3] for a, b in zip(u, v))

    def groups(links):
        group = list(range(60))
        for a, b in links:
            x, y = group[a], group[b]
            group = [min(x, y) if g in (x, y) else g for g in group]
        return group

    want = groups([(roots[a], roots[b]) for a in range(120) for b in range(a) if near(sets[a], sets[b])])
    assert groups([(roots[a // 3], roots[b // 3]) for a, b in zip(u, v)]) == want and len(set(want)) > 1
