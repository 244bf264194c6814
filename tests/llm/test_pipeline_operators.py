"""Language ID, toxicity, SimHash components, packing and the pipeline against brute force and held-out labels."""

import bisect
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.llm import jaccard, langid, packing, simhash, toxicity
from notelake.llm.queries import QUERIES
from notelake.llm.units import UnitTable, split

SF = "/root/testdata/sf0.01"
#: Labelled toxic documents of that table in which the model finds no mark: three English ones without a marking word,
#: and fifteen in other languages, of which there are two to four each to learn from.
MISSED_HERE = 18


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, rank int")


ODD = [
    (1, None, None, "a", None, 1.0, "x", 1),
    (2, "", "en", "a", 0, None, None, 2),
    (3, "the cat sat on the mat and the dog sat too", "en", "a", 5, 1.0, "x", 3),
    (3, "the cat sat on the mat and the dog sat too", "en", "a", 5, 1.0, "x", 3),
    (4, "the cat sat on the mat and the dog sat too", "en", "b", 5, 1.0, "x", 4),
    (5, "1234 5678 !!", "en", "b", 5, 1.0, "x", 5),
    (None, "wörter über straßen und häuser " * 3000, "de", None, 5, 1.0, "x", 6),
    (None, "der hund und die katze", "de", None, 5, 1.0, "x", 7),
    (6, "der hund und die katze", "de", None, 5, 1.0, "x", 7),
]


def components_by_pairs(rows):
    """The plain definition: links between all pairs, spread until nothing changes."""

    def print_of(text):
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    fp = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fp ^ f) <= 2) for f in fp]
    while changed:
        changed = False
        for k in range(len(rows)):
            least = min(group[j] for j in near[k])
            if least != group[k]:
                group[k], changed = least, True
    ids = {}
    for k, g in enumerate(group):
        if rows[k][0] is not None:
            ids[g] = min(ids.get(g, rows[k][0]), rows[k][0])
    return sorted(((i, f"{p:016x}", ids.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=str)


def test_simhash_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_simhash"](spark, SF).collect()), key=str)
    assert got == components_by_pairs(rows)


def test_simhash_odd_rows(spark):
    got = simhash.components(docs(spark, ODD)).select("doc_id", simhash.hex_of("fp"), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == components_by_pairs([r[:2] for r in ODD])
    assert simhash.components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n,flips", [(3000, 3), (900, 1), (2, 0)])
def test_shards_lose_no_link(n, flips):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(1, n // 6), dtype=np.uint64)
    points = base[rng.integers(0, len(base), n)]
    for _ in range(flips):
        points ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    points = np.unique(points)
    root = simhash.link_shard(points, leaf=64)
    tree = simhash.VantageTree(points[::3], 16)
    homes = [set() for _ in points]
    for leaf, at in tree.route(points):
        for k in at:
            homes[k].add(leaf)
    parent = list(range(len(points)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(points)):
        for b in np.flatnonzero(np.bitwise_count(points[a + 1 :] ^ points[a]) <= 2) + a + 1:
            assert homes[a] & homes[b]
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    assert root.tolist() == [find(k) for k in range(len(points))]


def test_long_chain_is_one_component(spark):
    chain = [0]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << k))
    edges = [(max(a, b), min(a, b)) for a, b in zip(chain, chain[1:])]
    found = simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["u"] for r in found} == set(chain) - {0} and {r["v"] for r in found} == {0}


@cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def ids_by_units(table, texts):
    out = []
    for first, ids, ends in table.groups(pa.array(texts, pa.string())):
        assert first == len(out)
        out += [x.tolist() for x in np.split(ids, ends[:-1])]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 'sé1.,\n\t\r  \x1c\x85\0中")), max_size=24), min_size=1, max_size=9))
def test_units_encode_as_the_whole_texts(texts):
    flat, counts = split(pa.array(texts, pa.string()))
    assert ["".join(x) for x in np.split(np.array([*flat.to_pylist(), ""], object)[:-1], np.cumsum(counts)[:-1])] == texts
    assert ids_by_units(packing.unit_table(packing.default_vocabulary()), texts) == [whole_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'s", "<|endoftext", "|>", "  ", "b.", "é"]), max_size=9).map("".join), min_size=1, max_size=6))
def test_special_tokens_in_texts_are_the_tokenizers(texts):
    assert ids_by_units(packing.unit_table(packing.default_vocabulary()), texts) == [whole_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]


def test_special_token_within_a_document(spark):
    assert whole_tokenizer().encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    docs = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "plain")], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in packing.pieces(docs).collect()}[1] == [64, 50256, 65, 2]


def test_unit_table_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(UnitTable, "MOST_UNITS", 50)
    monkeypatch.setattr(UnitTable, "TOGETHER", 300)
    table = UnitTable(packing.unit_table(packing.default_vocabulary()).encode)
    rng = np.random.default_rng(3)
    for _ in range(20):
        texts = [" ".join(rng.choice(["of", "the,", "tree.", "x" * 60, *[f"w{rng.integers(500)}" for _ in range(20)]], 30)) for _ in range(12)] + ["", "  odd  text "]
        assert ids_by_units(table, texts) == [whole_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
        assert len(table.known) <= 50 and len(table.ids) == table.lengths.sum()


def check_packing(got, texts, capacity=1024):
    whole = whole_tokenizer()
    want = Counter()
    for i, t in texts:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % capacity + 1
        spans = [(0, head), *((s, capacity) for s in range(head, len(ids), capacity))]
        for k, (s, n) in enumerate(spans):
            want[(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    return len(by), -(-total // capacity)


def best_fit_decreasing(lengths, capacity=1024):
    gaps, used = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        if k < len(gaps):
            left = gaps.pop(k) - x
        else:
            left, used = capacity - x, used + 1
        bisect.insort(gaps, left)
    return used


def test_packing_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op6_packing"](spark, SF).collect()
    used, least = check_packing(got, [(r["doc_id"], r["text"]) for r in rows])
    assert used <= 1.01 * least and used <= best_fit_decreasing([r["length"] for r in got])


def test_packing_odd_rows(spark):
    check_packing(packing.pack_documents(docs(spark, ODD)).collect(), [r[:2] for r in ODD])
    assert packing.pack_documents(docs(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30)), st.just(40))
def test_plan_uses_every_piece_once(lengths, capacity):
    used = Counter()
    for items, times in packing.plan(lengths, capacity):
        assert sum(items) <= capacity and times > 0
        for x in items:
            used[x] += times
    assert used == Counter(lengths)


def test_language_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_language"](spark, SF).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.99
    assert not any(r["rejected"] for r in got if r["lang_pred"] == truth[r["doc_id"]])


def test_language_odd_rows(spark):
    model = langid.fit(docs(spark, ODD), None)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, ODD), model).collect() if r["doc_id"]}
    assert got[1] == got[2] == got[5] == "und" and got[6] == "de"
    assert langid.identify(docs(spark, []), model).count() == langid.keep_identified(docs(spark, []), model).count() == 0
    empty = langid.fit(docs(spark, []), langid.learn_rows())
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ODD), empty).collect()} == {"und"}
    assert langid.keep_identified(docs(spark, ODD), model).schema == docs(spark, ODD).schema


def test_many_languages(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(70):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(12)]
        rows += [(100 * k + j, " ".join(rng.choice(own, 60)), f"l{k}", "s", 1, 1.0, "x", 1) for j in range(12)]
    frame = docs(spark, rows)
    model = langid.fit(frame, F.col("doc_id") % 3 != 0)
    assert len(model.langs) == 70
    truth = {r[0]: r[2] for r in rows}
    got = [r for r in langid.identify(frame, model).collect() if r["doc_id"] % 3 == 0]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.95


def test_language_sample_of_repeated_ids(spark):
    """Rows of one id, with one text or with several, don't crowd out the others."""
    known = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300").collect()]
    rows = [(*r, "s", 1, 1.0, "x", 1) for r in [*known, *[(7, "the of and to in is it that", "en")] * 3000]]
    model = langid.fit(docs(spark, rows))
    right = [model.predict(t)[0] == g for _, t, g in known if t and g]
    assert np.mean(right) > 0.98


def test_toxicity_on_held_out_documents(spark):
    """All languages: there are enough toxic documents of each in this table."""
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op10_toxicity"](spark, sf).collect()
    assert len(got) == len(lang) and all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(lang[r["doc_id"]], truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    for some in (("en",), ("de", "es", "fr")):
        toxic = [p for g, t, p in held if g in some and t == 1]
        clean = [p for g, t, p in held if g in some and t == 0]
        assert len(toxic) > 40 and np.mean(toxic) >= 0.9
        assert len(clean) > 300 and np.mean(clean) <= 0.035


def test_toxicity_folds_and_spares():
    model = toxicity.ToxicModel({"idiot": 5.0, "clown": 4.0}, (-3.0, 2.0, 0.5))
    for text in ("an idiot", "an 1D10T!", "an іdiot", "an id​iot", "you ｉdiots"):
        assert model.score(text) > 0.3, text
        (start, end, _), = model.spans(toxicity.fold(text))
        assert end - start == 5
    for text in (None, "", "a clown fish", "aidiot", "plain text"):
        assert model.score(text) < 0.3, text
    assert model.score("clown clown fish") > 0.3


def test_toxicity_learns_short_words_as_a_whole(spark):
    model = toxicity.ToxicModel({"zog ": 5.0, "clown": 4.0}, (-3.0, 2.0, 0.5))
    assert model.spans("zog a zogs zog") == [(0, 3, 5.0), (11, 14, 5.0)]
    assert model.spans("the clown zog") == [(4, 9, 4.0), (10, 13, 5.0)]
    texts = [(k, f"he is a z\u043eg and item number {k % 7} of the zone" if k % 2 else f"she has item number {k % 7} of the zone") for k in range(400)]
    known = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, toxic int"))
    assert "zog " in known.terms and not any(t.startswith("zone") for t in known.terms)
    assert known.score("what a zog") > 0.3 > known.score("zogs in the zone")


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, ODD), labels)
    assert {r["score"] for r in toxicity.score_toxicity(docs(spark, ODD), model).collect()} == {0.0}
    assert toxicity.keep_clean(docs(spark, ODD), model).count() == len(ODD)
    # the same rows and toxic ones among them, by a lexicon that was learned
    real = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    word = max(real.terms, key=real.terms.get)
    insults = [(20, f"{word} " * 5, "en", "a", 1, 1.0, "x", 1), (None, f"you {word}! " * 3000, None, None, 1, 1.0, "x", 1), (20, f"{word} " * 5, "en", "a", 1, 1.0, "x", 1)]
    both = docs(spark, [*ODD, *insults])
    got = [(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(both, real).collect()]
    assert len(got) == len(ODD) + 3 and sum(s >= 0.3 for _, s in got) == 3 and all(0 <= s <= 1 for _, s in got)
    low = {s for i, s in got if i in (1, 2, 3, 4, 5, 6)}
    assert len(low) == 1 and min(s for _, s in got) in low
    assert by_text(toxicity.keep_clean(both, real)) == by_text(docs(spark, ODD))
    assert {r["doc_id"] for r in toxicity.toxic_spans(both, real).collect()} == {20, None}
    empty = docs(spark, [])
    assert toxicity.score_toxicity(empty, real).count() == toxicity.keep_clean(empty, real).count() == toxicity.toxic_spans(empty, real).count() == 0


def by_text(frame):
    return sorted(map(str, frame.collect()))


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from test_jaccard import kept_by_pairs

    kept = spark.read.parquet(f"{SF}/documents.parquet")
    names = kept.columns
    for name, stage in p.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), before.schema)
        assert kept.columns == names
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in kept.collect()}
            missed = [r["doc_id"] for r in kept.collect() if labels.get(r["doc_id"]) == 1]
            assert len(missed) <= MISSED_HERE < 30 < sum(labels.get(i) == 1 for i in gone)
            assert not any(labels.get(i) == 0 for i in gone)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in kept.collect()]
            assert len(ids) == len(set(ids)) and set(ids) == kept_by_pairs([(r["doc_id"], r["text"]) for r in before.collect()])
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    check_packing(p.STAGES[-1][1](spark, kept, SF).collect(), rows)
    check_packing(QUERIES["pipeline"](spark, SF).collect(), rows)


def test_pipeline_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named as the stages' own ones."""
    import corpus_pipeline as p

    names = ["node", "own_id", "name", "whose", "root", "fp", "length", "sequence_id", "__kept"]
    known = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    rows = [(i, t, g, "s", 1, *[k] * len(names)) for k, (i, t, g) in enumerate([*known, *[r[:3] for r in ODD], (3, "another text under the same id, of other words", "en")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for table in (frame, frame.limit(0)):
        kept = table
        for name, stage in p.STAGES[:-1]:
            before = kept.collect()
            kept = spark.createDataFrame(stage(spark, kept, SF).collect(), frame.schema)
            after = kept.collect()
            assert not Counter(after) - Counter(before)
            if name == "language":
                assert all(any(c.isalpha() for c in r["text"] or "") for r in after)
                assert len({r["doc_id"] for r in after} & {i for i, _, _ in known}) >= 0.9 * len(known) or not before
            elif name == "toxicity":
                labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
                gone = Counter(before) - Counter(after)
                assert all(r["doc_id"] in labels for r in gone)
            else:
                sets = lambda rows: [frozenset(jaccard.shingles(r["text"]).tolist()) for r in rows]
                near = lambda a, b: len(a & b) * 5 >= len(a | b) * 4
                stay = sets(after)
                assert len(set(stay)) == len(stay)  # no copies
                alike = sets(before)
                # a group that has one text only stays, and what goes has a near one that was there
                assert all(x in stay for x in alike if not any(near(x, y) for y in alike if y != x))
                assert all(x in stay or any(near(x, y) for y in alike if y != x) for x in alike)
        packed = p.STAGES[-1][1](spark, kept, SF).collect()
        check_packing(packed, [(r["doc_id"], r["text"]) for r in kept.collect()])
    assert not packed
