"""Top-k search, BPE, license scans, fingerprints, archives and quality against brute force, other libraries and labels."""

import hashlib
import io
import re
import zipfile
import zlib
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from notelake.llm import bpe, licenses, merkle, quality, topk, warc
from notelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fingerprint string, score string, n_words int, tree string"
ODD = [
    (1, None, None, "x", 1, None),
    (2, "", "f", "x", 1, None),
    (3, "same text here. MIT  License", "f", "x", 1, None),
    (3, "same text here. MIT  License", "f", "x", 1, None),
    (4, "same text here. MIT  License", "g", "x", 1, None),
    (None, "ohne Nummer; größe 中文 \U0001f600", "g", "x", 1, None),
    (9, "lang " * 60_000, "g", "x", 1, None),
    (10, "ab" * 30_000, "g", "x", 1, None),
    (11, "\n\n# a\n\n\n\nb. c\n  \t\r\n", "g", "x", 1, None),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def by_text(rows):
    return sorted(map(str, rows))


# --- top-k ---


def best_by_sorting(rows, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 100 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, a in queries.items():
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in good if i != q and len(v) == len(a))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_topk_of_all_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op1_topk"](spark, SF).collect())) == best_by_sorting(rows)


def test_topk_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k % 130, [float(x) for x in rng.integers(-3, 4, 5) / 2]) for k in range(400)]
    rows += [(200, None), (300, [1.0, None, 1.0, 1.0, 1.0]), (400, [float("nan")] * 5), (500, [float("inf")] * 5), (600, []), (None, [1.0] * 5), (700, [1.0, 2.0]), (701, [1.0, 2.0])]
    rows += [(800, [3e5, 1.0, -3e5, 2e5, 1e5]), (801, [3e5 + 1, 7.0, -2e5, 1.0, 5.0])]  # beyond 2^53, within 64 bits
    frame = spark.createDataFrame([(*r, 5, 1) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    assert sorted(map(tuple, topk.search(frame, F.col("vec_id") % 100 == 0).collect())) == best_by_sorting(rows)
    assert topk.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_branch_and_bound_in_many_blocks():
    rng = np.random.default_rng(1)
    for vectors, most in ((rng.integers(-500, 500, (3000, 64)) * rng.integers(1, 4, (3000, 1)), 1.0), (np.floor(1024 * rng.normal(0, 1, (6000, 64)) * np.geomspace(1, 0.02, 64)).astype(np.int64), 0.3)):
        ids = np.arange(len(vectors))
        queries, cells = ids[::100], np.ascontiguousarray(vectors[::100].T)
        s = topk.Search(queries, cells, 10, topk.seeded(queries, cells, {64: (ids[5::7], np.ascontiguousarray(vectors[5::7].T))}, 10))
        for at in range(0, len(ids), 700):
            s.add(ids[at : at + 700], np.ascontiguousarray(vectors[at : at + 700].T))
        assert sorted(zip(*map(list, s.rows()))) == sorted((q, i, int(x)) for q in queries.tolist() for x, i in sorted((-int(vectors[q] @ vectors[i]), i) for i in range(len(ids)) if i != q)[:10] for x in [-x])
        # most candidates fall before half of the dimensions on skewed vectors
        half = s.tested[len(s.tested) // 2] / s.tested[0]
        assert half < most


def test_blocks_that_are_too_short_are_skipped():
    rng = np.random.default_rng(3)
    vectors = np.floor(1024 * rng.normal(0, 1, (8000, 32)) * np.geomspace(1, 0.01, 8000)[:, None]).astype(np.int64)
    ids = np.arange(len(vectors))
    asked = ids[::100]
    for share in (0.01, 0.05):
        seeds = rng.permutation(len(vectors))[: int(share * len(vectors))]
        cells = np.ascontiguousarray(vectors[asked].T)
        s = topk.Search(asked, cells, 10, topk.seeded(asked, cells, {32: (seeds, np.ascontiguousarray(vectors[seeds].T))}, 10))
        for at in range(0, len(ids), 500):
            s.add(ids[at : at + 500], np.ascontiguousarray(vectors[at : at + 500].T))
        assert sorted(zip(*map(list, s.rows()))) == sorted((q, i, int(-x)) for q in asked.tolist() for x, i in sorted((-int(vectors[q] @ vectors[i]), i) for i in range(len(ids)) if i != q)[:10])
        assert s.tested[0] < 0.3 * len(asked) * len(ids)


def test_topk_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 7)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "SEEDS", 60)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 8) * (0.01 if k % 3 else 2.0)]) for k in range(3000)]
    rows += [(k, [0.0] * 8) for k in range(3000, 5000)]  # queries of one need, enough for several groups
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.search(frame, F.col("vec_id") % 100 == 0).collect())) == best_by_sorting(rows)


def test_share_of_candidates_with_few_seeds():
    """What is left after a block, on vectors whose mass lies in few dimensions, with seeds far below the table."""
    rng = np.random.default_rng(7)
    vectors = np.floor(1024 * rng.normal(0, 1, (20_000, 64)) * np.geomspace(1, 0.02, 64)).astype(np.int64)
    ids = np.arange(len(vectors))
    cells = np.ascontiguousarray(vectors[::200].T)
    for share, most in ((0.01, 0.25), (0.05, 0.15)):
        seeds = rng.permutation(len(vectors))[: int(share * len(vectors))]
        s = topk.Search(ids[::200], cells, 10, topk.seeded(ids[::200], cells, {64: (seeds, np.ascontiguousarray(vectors[seeds].T))}, 10))
        for at in range(0, len(ids), 2048):
            s.add(ids[at : at + 2048], np.ascontiguousarray(vectors[at : at + 2048].T))
        left = s.tested / (len(cells[0]) * len(ids))
        print("share of candidates by dimension block", share, np.round(left, 4))
        assert left[3] < most


def test_most_candidates_of_the_table_fall_early(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    cells = np.ascontiguousarray(np.array([[int(np.floor(1024 * float(x))) for x in r["embedding"]] for r in rows]).T)
    asked = np.flatnonzero(ids % 100 == 0)
    s = topk.Search(ids[asked], cells[:, asked], 10, topk.seeded(ids[asked], cells[:, asked], {len(cells): (ids, cells)}, 10))
    s.add(ids, cells)
    share = s.tested / s.tested[0]
    print("share of candidates by dimension block", np.round(share, 4))
    assert share[4] < 0.5 and share[6] < 0.05


# --- BPE ---


@cache
def tik():
    import tiktoken

    own = bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=own.ranks, special_tokens={})


def digests(text):
    ids = np.array(tik().encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_bpe"](spark, SF).collect()}
    assert got == {i: digests(t) for i, t in texts.items()}


def test_bpe_odd_documents(spark):
    encoded = bpe.encode(odd(spark))
    assert by_text((r["doc_id"], list(r["ids"])) for r in encoded.collect()) == by_text((r[0], tik().encode_ordinary(r[1] or "")) for r in ODD)
    assert by_text((r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(encoded).collect()) == by_text((r[0], (r[1] or "").encode()) for r in ODD)
    assert bpe.encode(odd(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from(list("theinaré '\n\t0中\x1c\x85\xa0")), max_size=150)))
def test_bpe_any_text(text):
    own = bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == tik().encode_ordinary(text) and own.decode(ids) == text.encode()


def test_both_merges_agree():
    own = bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())
    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"theranios\xc3\xa9"), rng.integers(2, 64)).tolist()) for _ in range(300)]
    assert own.merge_many(words, 64) == [own.merge_one(w) for w in words]


# --- licenses ---


def places(text):
    found = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    ws = [m.group() for m in found]
    hits = sorted((k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(ws)) if ws[k : k + len(p)] == p)
    starts = [k for k, _ in hits]
    return len(ws), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


LICENSED = [
    (1, "MIT-license mit license, MIT  License. the Apache\nLicense", "x"),
    (2, "GNU General Public license Licensed under the GNU General Publik License", "x"),
    (3, "Permission is hereby granted, fre of charge, to any person obtainin a copy", "x"),
    (4, "Released under teh MIT Licence. permit license mit licensee é MIT LICENSE", "x"),
    (5, "nothing of that kind", "x"),
    (6, "general public general public license", "x"),
]


def test_license_scan_with_notices_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "Nur für den INTERNEN Gebrauch, bitte"), (2, "nur für den internem gebrauch"), (3, "MIT License, released under the mit license"), (4, None)], "doc_id long, text string")
    own = {"Nur für den internen Gebrauch": "intern"}
    assert {r["doc_id"]: (r["n_base"], r["labels"]) for r in licenses.scan(docs, own).collect()} == {1: (0, "intern"), 2: (0, "intern"), 3: (2, "mit"), 4: (0, "")}
    found = {(r["doc_id"], r["notice"], r["edits"]) for r in licenses.spans(docs, own).filter("not base").collect()}
    assert found == {(1, "nur für den internen gebrauch", 0), (2, "nur für den internen gebrauch", 1)}
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="a notice needs a word"):
        licenses.scan(docs, {"--": "none"})


def test_licenses_of_all_documents(spark):
    for frame, got in ((spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op3_licenses"](spark, SF)), *((f, licenses.scan(f)) for f in (odd(spark), spark.createDataFrame(LICENSED, "doc_id long, text string, labels string")))):
        want = [(r["doc_id"], *places(r["text"])) for r in frame.collect()]
        rows = got.collect()
        assert by_text(tuple(r)[:6] for r in rows) == by_text(want)
        assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in rows)
        assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in rows)


def test_license_edits(spark):
    frame = spark.createDataFrame(LICENSED, "doc_id long, text string, labels string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(frame).collect()}
    assert labels[3] == "mit" and labels[5] == "" and "gpl" in labels[2]
    found = licenses.spans(frame).collect()
    fuzzy = [r for r in found if r["doc_id"] == 3]
    assert len(fuzzy) == 1 and fuzzy[0]["edits"] == 2 and fuzzy[0]["first_word"] == 0 and fuzzy[0]["matched"].startswith("permission is hereby granted fre of")
    assert licenses.spans(frame.limit(0)).count() == 0


def least_edits(phrase, joined, most):
    """The fewest edits, at most ``most``, of the phrase from any run of whole words: the table of edit distances from each word on."""
    found = []
    for start in [0, *(k + 1 for k, c in enumerate(joined) if c == " ")]:
        run = joined[start : start + len(phrase) + most]
        row = list(range(len(run) + 1))
        for i, c in enumerate(phrase, 1):
            last, row = row, [i] + [0] * len(run)
            for j, d in enumerate(run, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
            if min(row) > most:
                break
        else:
            found += [n for e, n in enumerate(row) if e and n <= most and joined[start + e : start + e + 1] in ("", " ")]
    return min(found, default=None)


def scanned(joined):
    out = {}
    for notice, start, end, edits in licenses.scanner().found(joined):
        assert (start == 0 or joined[start - 1] == " ") and joined[end : end + 1] in ("", " ")
        out[notice.phrase] = min(edits, out.get(notice.phrase, edits))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from("axz "), st.booleans()), max_size=3), st.integers(0, 5))
def test_seeds_miss_no_match(changes, lead):
    """A notice of one place is found wherever its edits are few enough, and only there."""
    phrase = "permission is hereby granted free of charge to any person obtaining a copy"
    text = phrase
    for at, c, drop in changes:
        text = text[:at] + ("" if drop else c) + text[at + 1 :]
    joined = " ".join(("w " * lead + text + " end").split())
    notice = next(n for n in licenses.scanner().notices if n.phrase == phrase)
    assert scanned(joined).get(phrase) == least_edits(phrase, joined, notice.edits)


_PIECES = st.sampled_from([
    "mit license", "apache license", "general public license", "released under the mit license", "licensed under the apache license version 2 0", "licensed under cc by sa 4 0",
    "gnu lesser general public license", " ", " ", "x", "0", "ab ", " the", "licens", "version 2 0",
])


@settings(max_examples=80, deadline=None)
@given(st.lists(_PIECES, min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 200), st.sampled_from(["", "x", " ", "0"]), st.booleans()), max_size=6))
@example(["x", "apache license"], [])
@example(["licensed under cc by sa 4 0", "version 2 0"], [])
@example(["ab ", "gnu lesser general public license"], [(3, "x", False), (30, " ", False)])
def test_license_notices_equal_edit_distances(pieces, edits):
    """All notices against the table of edit distances, with pieces glued to what stands beside them."""
    text = "".join(pieces)
    for at, new, delete in edits:
        text = text[: at % (len(text) + 1)] + new + text[at % (len(text) + 1) + delete :]
    joined = b" ".join(licenses.words(text)).decode("latin-1")
    want = {n.phrase: least_edits(n.phrase, joined, n.edits) for n in licenses.scanner().notices}
    assert scanned(joined) == {p: n for p, n in want.items() if n is not None}


# --- fingerprints ---


def test_fingerprints_of_all_documents(spark):
    """Rows with equal ids have equal texts here, so the order is given but for those, which are alike."""
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd(spark)):
        order = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
        got = merkle.with_edited(frame).collect()
        want = []
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            h = len(t) // 2
            want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()))
        assert by_text((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == by_text(want)


def test_fingerprint_of_edited_text_is_that_text_s(spark):
    rows = QUERIES["op4_fingerprints"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    edited = [(i, texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[order[(k + 1) % len(order)]][: len(texts[i]) // 2], 1) for k, i in enumerate(order)]
    again = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(spark.createDataFrame(edited, "doc_id long, text string, sections int")).collect()}
    assert {r["doc_id"]: r["edited_fingerprint"] for r in rows} == again
    by_print = {}
    for r in rows:
        by_print.setdefault(r["fingerprint"], set()).add(texts[r["doc_id"]])
    assert all(len(t) == 1 for t in by_print.values()) and len(by_print) == len(set(texts.values()))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)
    assert all((r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"]) for r in rows)


def test_edits_are_located(spark):
    old = "# one\nalpha. beta\ngamma\n\n# two\ndelta\nepsilon\n"
    new = old.replace("epsilon", "zeta")
    a, b = (spark.createDataFrame([(1, t), (2, old)], "doc_id long, text string") for t in (old, new))
    got = {r["doc_id"]: (r["equal"], [tuple(e) for e in r["edits"]]) for r in merkle.edits(a, b).collect()}
    assert got == {1: (False, [(1, 2)]), 2: (True, [])}


def test_order_in_many_buckets(spark):
    frame = spark.range(0, 3000).select((F.col("id") * 7 - 900).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(frame, ["text"]).collect()}
    assert got == {k * 7 - 900: str((k - 1) % 3000) for k in range(3000)}
    assert merkle.with_edited(frame.limit(0)).count() == 0
    assert merkle.with_next(frame.limit(1), ["text"]).collect()[0]["next_text"] is not None


# --- archives ---


def test_archives_equal_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = db.execute(ORACLES["op7_warc"]).fetchall()
    assert by_text(tuple(r[n] for n in names) for r in QUERIES["op7_warc"](spark, SF).collect()) == by_text(want)


def test_archives_give_back_what_they_got(spark):
    long = "ä" * 60
    rows = [(1, "u1", long, 0), (2, "u\r\n2", long, 0), (3, None, None, 0), (4, "u4", "", 0), (5, "u5", "short", 0), (6, "u6", "short", 0), (None, "u7", long, 0), (1, "u8", long, 0), (9, "u9", "x" * 300_000, 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.round_trip(spark, frame, with_payload=True).collect()
    assert by_text((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == by_text(
        (i, len((h or "").encode()), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h, _ in rows
    )
    assert by_text(bytes(r["payload"]) for r in got if r["record_type"] == "response") == by_text((h or "").encode() for i, _, h, _ in rows if i != 2)
    assert warc.round_trip(spark, frame.limit(0)).count() == 0


def test_reader_of_other_zip_files(tmp_path):
    local = fs.LocalFileSystem()
    for name, wide in (("a.zip", False), ("b.zip", True)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            with z.open("one.bin", "w", force_zip64=wide) as f:
                f.write(bytes(range(256)) * 10)
            z.writestr("two.txt", "hello")
            z.writestr(zipfile.ZipInfo("three.txt"), "x" * 100, zipfile.ZIP_DEFLATED)
            z.comment = b"PK note"
        r = warc.ArchiveReader(local.open_input_file(str(tmp_path / name)))
        assert set(r.members) == {"one.bin", "two.txt", "three.txt"}
        assert r.read("one.bin", 250, 10) == bytes(range(250, 256)) + bytes(range(4)) and r.read("two.txt") == b"hello"
        for bad in (lambda: r.read("three.txt"), lambda: r.read("two.txt", 3, 9)):
            with pytest.raises(ValueError):
                bad()
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:  # more entries than the plain end record can count
        for k in range(65_600):
            z.writestr(zipfile.ZipInfo(str(k)), b"")
    assert len(warc.ArchiveReader(local.open_input_file(str(many))).members) == 65_600
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(ValueError):
        warc.ArchiveReader(local.open_input_file(str(tmp_path / "bad.zip")))


class Hollow:
    """A file whose given stretches have bytes and whose rest is zeros."""

    def __init__(self, stretches, size):
        self.stretches, self.length, self.at = stretches, size, 0

    def size(self):
        return self.length

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = bytearray(min(n, self.length - self.at))
        for begin, data in self.stretches.items():
            low, high = max(begin, self.at), min(begin + len(data), self.at + len(out))
            if low < high:
                out[low - self.at : high - self.at] = data[low - begin : high - begin]
        self.at += len(out)
        return bytes(out)


def test_offsets_beyond_4_gib():
    """A ZIP64 archive of five GiB: the second member, the directory and a range lie beyond what 32 bits hold."""
    import struct

    big, name, other = 5 << 30, b"archive/data.warc.gz", b"indexes/index.cdxj"
    local = lambda n: struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, 0, 0)
    first, second = 0, len(local(name)) + big
    lines = b"offsets"
    start = second + len(local(other)) + len(lines)
    entry = lambda n, size, at: struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 28, 0, 0, 0, 0, 0xFFFFFFFF) + n + struct.pack("<HHQQQ", 1, 24, size, size, at)
    directory = entry(name, big, first) + entry(other, len(lines), second)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 2, 2, len(directory), start)
    tail = directory + end64 + struct.pack("<4sIQI", b"PK\6\7", 0, start + len(directory), 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    deep = len(local(name)) + (4 << 30) + 77
    file = Hollow({first: local(name), deep: b"deep bytes", second: local(other) + lines, start: tail}, start + len(tail))
    reader = warc.ArchiveReader(file)
    assert reader.members["archive/data.warc.gz"] == (0, big, 0) and reader.members["indexes/index.cdxj"] == (0, len(lines), second)
    assert reader.read("archive/data.warc.gz", (4 << 30) + 77, 10) == b"deep bytes" and reader.read("indexes/index.cdxj") == lines


def test_damaged_records_are_noticed():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload", b"pay1oad"))


# --- quality ---


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_quality"](spark, sf).collect()
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_odd_documents(spark):
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (None, 0), (9, None)], "doc_id long, quality int")
    for model in (quality.fit(odd(spark), labels), quality.fit(odd(spark), labels.limit(0)), quality.fit(odd(spark, []), labels)):
        got = quality.score_quality(odd(spark), model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(odd(spark, []), model).count() == 0


def test_pairs_learn_what_single_tables_can_not():
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_arrays(x, y, np.ones(len(x)))
    assert (1, 0) in model.pairs and np.mean((model.scores(x) > 0.5) == y) > 0.9
