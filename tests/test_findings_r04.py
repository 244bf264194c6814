"""What the fourth review found: each test failed before its finding was mended."""

import random

from pyspark.sql import functions as F

from notelake.functions import python as P
from notelake.functions import text as T
from notelake.operators import maintenance, parse, reports, search


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _notes(spark, rows):
    return spark.createDataFrame(rows, "filename string, content string").selectExpr("*", "cast(null as timestamp) as mtime")


_TAGGED = [("a.md", "---\ncreated: 2024-01-02\n---\n# H #Ship/R\n```tasks\n#no\n```\n- [ ] do #order/high\n- [x] done\n"), ("b.md", "#ship/r\n- [ ] no\n"), ("c.md", "```tasks\n#ship/r #order/high\n```\n- [ ] x")]


def test_notes_by_tags_read_a_text_once(spark):
    index = parse.build_index(_notes(spark, _TAGGED))
    found = search.search_notes(index, tags=["ship/R", "Order/high"]).select("filename")
    assert [r[0] for r in found.collect()] == ["a.md"]
    assert _plan(found).count("tag:\\s*") <= 2 and _plan(found).count("```dataview") < 20  # a body isn't made anew wherever a condition names it


def test_todos_by_tags_read_a_text_once(spark):
    index = parse.build_index(_notes(spark, _TAGGED))
    found = search.search_todos(index, tags=["order/HIGH"]).select("filename", "line_number")
    assert sorted(map(tuple, found.collect())) == [("a.md", 6), ("a.md", 7)]
    assert _plan(found).count("tag:\\s*") <= 2 and _plan(found).count("```dataview") < 20


def test_similar_names_meet_without_a_broadcast(spark):
    names = [f"a note on supplier {k:09}" for k in range(1200, 1260)] + ["köln", None, "", "𝄞x"]
    near = [f"a note on supplier {k:010}" for k in range(1200, 1260)] + ["KÖLN", "kölnn", None, "", "𝄞x"]
    of = lambda rows: spark.createDataFrame([(n,) for n in rows], "name string")
    found = reports.similar_names(of(names), of(near), 0.92)
    want = {(a, b) for a in names for b in near if a and b and a != b and P.jaro_winkler_text(a, b) >= 0.92}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert len(P.similar_name_keys(names[0], 0.98, frozenset({29}))) == 1 < len(P.similar_name_keys(names[0], 0.98))  # keys for lengths that there are


def test_similarities_of_many_equal_those_of_each():
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("aab1Ö𝄞") for _ in range(rng.randint(0, 12)))
    a, b = [text() for _ in range(20000)] + [None, None, "a"], [text() for _ in range(20000)] + [None, "a", None]
    assert P.jaro_winkler_texts(a, b).tolist() == [P.jaro_winkler_text(x, y) for x, y in zip(a, b, strict=True)]


def test_terms_of_saved_searches_come_from_one_pass(spark, monkeypatch):
    rows = [("a.md", "---\nstatus: O\nlist: [X, y, X]\nnone:\n---\n#Hot_1 #hot/x [[S_1]] [[s 1]]\n"), ("b.md", ""), ("a.md", "[[s 1]] 2024-01-02")]
    index = parse.build_index(_notes(spark, rows))
    terms = search.term_table(index)
    assert _plan(terms).count("LocalRelation") + _plan(terms).count("LogicalRDD") == 1
    want = {("tag", "", "hot "), ("tag", "", "hot"), ("tag", "", "hot/x"), ("link", "", "s 1"), ("link", "", "2024-01-02"), ("attr", "status", "o"), ("attr", "list", "x"), ("attr", "list", "y")}
    assert {tuple(r)[1:] for r in terms.collect()} == want and {r[0] for r in terms.collect()} == {"a.md"}
    asked = spark.createDataFrame([("q", 1, "link", None, "S 1"), ("q", 1, "attr", "LIST", "Y"), ("r", 1, "link", None, "s_1")], "query_id string, clause_id int, kind string, key string, value string")
    found = []
    for few in (0, 100):
        monkeypatch.setattr(search, "FEW_TERMS", few)
        found.append(sorted(tuple(r) for r in search.saved_search_matches(index, asked).collect()))
    assert found == [[("q", "a.md"), ("r", "a.md")]] * 2


def test_texts_are_cut_by_bytes(spark):
    texts = ["---\na: ä\n---\nÖ𝄞\nx\n", "---\r\na: ß\r\n---\r\nü\r\n", "Ä\n", "\n", "", None, "---\na: 1\n---\n", "---\na: 1\n---", "𝄞\r\nb\n\n"]
    rows = parse.split_front(_notes(spark, [(str(k), x) for k, x in enumerate(texts)])).select("filename", "front", "body", "front_lines", T.lines("body").alias("lines")).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == [
        ("a: ä", "Ö𝄞\nx", 3, ["Ö𝄞", "x"]), ("a: ß", "ü", 3, ["ü"]), (None, "Ä\n", 0, ["Ä"]), (None, "\n", 0, [""]), (None, "", 0, []), (None, "", 0, []), ("a: 1", "", 3, []), ("a: 1", "", 3, []), (None, "𝄞\r\nb\n\n", 0, ["𝄞", "b", ""]),
    ]
    assert "char_length" not in _plan(parse.split_front(_notes(spark, _TAGGED)))


def test_kept_indexes_shuffle_texts_not_parsed_notes(spark, tmp_path, monkeypatch):
    kept = maintenance.StoredIndex(spark, str(tmp_path / "i"), buckets=5, texts=True)
    written = []
    monkeypatch.setattr(maintenance.KeyedTable, "_sorted", lambda self, rows, own=maintenance.KeyedTable._sorted: written.append(rows) or own(self, rows))
    monkeypatch.setattr(maintenance, "stash", lambda rows, name, own=maintenance.stash: written.append(name) or own(rows, name))
    raw = _notes(spark, [(f"n{k}.md", f"---\ntype: t{k}\n---\nnote {k} #a/b [[x]]\n") for k in range(40)])
    kept.write(parse.build_index(raw))
    plan = _plan(written.pop())
    assert plan.count("Repartition") == 1 and plan.index("run(") < plan.index("Repartition")  # texts are dealt below the parser, not what it made
    fresh = raw.filter("filename in ('n1.md', 'n2.md')").withColumn("content", F.lit("now #new"))
    kept.refresh(parse.build_index(fresh), spark.createDataFrame([("n3.md",), ("none.md",)], "filename string"))
    assert "bucket-rows" not in written  # no copy of the folders' rows
    got = {r["filename"]: (r["tags"], r["title"]) for r in kept.read().notes.select("filename", "tags", "title").collect()}
    assert got == {f"n{k}.md": (["new"] if k in (1, 2) else ["a", "a/b"], f"n{k}") for k in range(40) if k != 3}
    kept.refresh(parse.build_index(raw.limit(0)), raw.select("filename"))  # folders without a row go
    assert kept.read().notes.count() == 0 and [p.name for p in (tmp_path / "i" / "parsed").glob("bucket=*")] == ["bucket=-1"]
