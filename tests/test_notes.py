"""Note parsing against literal notes, segments against a line-by-line model, and the other operators on small tables."""

import hashlib
import random
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.functions import python as P
from notelake.functions import text as T
from notelake.operators import ingest, maintenance, parse, reports, rewrite, search, vectors
from notelake.sources import files
from notelake.streaming import streams


def raw(spark, *notes):
    return spark.createDataFrame([(n, c, "1970-01-02") for n, c in notes], "filename string, content string, day string").selectExpr("filename", "content", "cast(day as timestamp) as mtime")


def test_frontmatter(spark):
    rows = {r["filename"]: r for r in parse.split_front(raw(spark, ("a", "---\na: 1\n---\nbody\n"), ("b", "--- \r\nx\r\n --- \r\nl1\r\nl2"), ("c", "---\nopen\n"), ("d", ""), ("e", None), ("f", "text\n"), ("g", "---\n---\n"))).collect()}
    assert (rows["a"]["front"], rows["a"]["body"], rows["a"]["front_lines"]) == ("a: 1", "body", 3)
    assert (rows["b"]["front"], rows["b"]["body"], rows["b"]["front_lines"]) == ("x", "l1\nl2", 3)
    assert [rows[k]["front"] for k in "cdef"] == [None] * 4 and rows["c"]["body"] == "---\nopen\n" and rows["f"]["body"] == "text\n"
    assert (rows["g"]["front"], rows["g"]["body"]) == ("", "")


NOTE = """---
title: A title
created: "[[2024-08-05]] 17:08"
updated: 2024-09-01 10:30
type: #meeting
labels: [KRAMFORS, b]
count: 5
open: true
gone:
ratio: 1.50
two words: x
people:
  - "[[Jörg Müller]]"
  - ann
---
# Head #top/sub
2024-01-02 and [[2024-01-03]] and [t](http://x.y/z)
- [ ] first priority: B due: 2024-03-04 #a/b tag: c9 [[L]]
- [X] second [[2024-05-06]]
- [x] third 2024-05-07
- [ ] fourth due: 20249999
  - [ ] nested
## Participants
- [[Jörg Müller]]
- bob

### Notes
- two words
"""


def test_note_with_everything(spark):
    x = parse.build_index(raw(spark, ("d/n.md", NOTE)))
    n = x.notes.collect()[0]
    assert n["title"] == "A title" and n["created"] == 1722877680 and n["updated"] == 1725186600
    assert n["links"] == ["http://x.y/z", "2024-01-02", "2024-01-03", "2024-03-04", "L", "2024-05-06", "2024-05-07", "Jörg Müller", "2024-08-05", "kramfors", "b"]
    assert n["tags"] == ["a", "a/b", "c9", "top", "top/sub"]
    todos = x.todos.orderBy("line_number").collect()
    assert [(t["closed"], t["priority"], t["due"], t["line_number"], t["tags"]) for t in todos] == [(False, "B", "20240304", 18, ["a/b", "c9"]), (True, None, None, 19, []), (True, None, None, 20, []), (False, None, "20249999", 21, [])]
    assert [t["updated"] for t in todos] == [1709510400, 1714953600, 1715040000, 1725186600]
    attributes = {}
    for r in x.attributes.orderBy("key", "ord").collect():
        attributes.setdefault(r["key"], []).append((r["value"], r["vtype"]))
    assert attributes["people"] == [("Joerg Mueller", "string"), ("ann", "string"), ("bob", "string")]
    assert attributes["count"] == [("5", "int")] and attributes["open"] == [("true", "bool")] and attributes["gone"] == [(None, "null")]
    assert attributes["ratio"] == [("1.50", "string")] and attributes["type"] == [("meeting", "string")] and "two words" not in attributes


def test_nested_yaml_and_bad_yaml():
    if P.yaml is None:
        pytest.skip("no YAML reader")
    assert P.read_front("a:\n  b: 1\nwhen: 12:30\nday: 2024-01-01\nl: [x, [y]]") == [("a", 0, '{"b": 1}', "object", False), ("when", 0, "12:30", "string", False), ("day", 0, "2024-01-01", "string", False), ("l", 0, "x", "string", True), ("l", 1, '["y"]', "array", True)]
    assert P.read_front("a: [b") == [] and P.read_front("list: []") == [("list", -1, None, "array", True)]
    assert P.read_front("title: 'it''s'\ntags: [a, \"b, c\"]") == [("title", 0, "it's", "string", False), ("tags", 0, "a", "string", True), ("tags", 1, "b, c", "string", True)]
    for bad in ('title: "unterminated', 'a: "x" y', "x: - a", "a: 'b' 'c'", "ok: 1\nno: [a", "ok: 1\n\tno: 2", "a: @b", "a: `b`", "a: %b"):
        assert P.read_front(bad) == [], bad


VALUES = ["", "plain", "two words", "12", "-3", "+4", "1.5", "007", "99999999999999999999", "true", "No", "null", "~", "'it''s'", "'q'", '"q"', '"a, b"', '"a\\n"', '"x" y', "'", '"', "[a, b]", "[a, 'b, c']", "[]", "[a,, b]", "[[x]]", "[a: b]", "[ ]",
    "{a: 1}", "- a", "-a", "a: b", "a:b", "a #c", "a#c", "# c", "#c", "&a", "*a", "!t", "|", ">", "%p", "@x", "`x", "? x", "?x", ": x", ":x", "2024-01-02 10:30", "http://x.y/z", "ä ö", "\u2028", "\x07", "a\tb", ", a", "]", "} x", "a ", "--- a", "..."]
LINES = ["  - a", "- b", "  - 'c'", "   - d", "  -", "  k: v", "", " ", "# comment", "...", "---", "word", "  more text", "\tx: y", "- - a", "- a: b", "  - \"x, y\"", "key with space: 1", "true: 1", "12: x", "a.b: c", "x-y: z", "'q': 1"]


@settings(max_examples=3000, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(VALUES)).map(lambda x: f"{x[0]}: {x[1]}"), st.sampled_from(LINES)), min_size=1, max_size=6).map("\n".join))
def test_plain_frontmatter_is_read_as_by_the_yaml_reader(front):
    flat = P._flat(front)
    assert flat is None or flat == P._nested(front)


def test_hash_prefixes_of_words():
    assert P.strip_hashes("type: #meeting  ##x a#b\n- #item\nkey:#v\nurl: http://x.y/#z") == "type: meeting #x a#b\n- #item\nkey:v\nurl: http://x.y/#z"


def test_frontmatter_of_long_texts(spark):
    rows = raw(spark, ("open", "---\n" + "a: 1\n" * 60_000), ("late", "---\n" + "a: 1\n" * 30_000 + "---\nbody\r\nmore\r\n"), ("body", "---\n---\n" + "x\n" * 60_000), ("dashes", " --- \n-- -\n ---x\n\u00a0---\u2003\nend\n\n"))
    got = {r["filename"]: r for r in parse.split_front(rows).collect()}
    assert got["open"]["front"] is None and got["late"]["front_lines"] == 30_002 and got["late"]["body"] == "body\nmore"
    assert len(got["body"]["body"]) == 119_999 and (got["dashes"]["front"], got["dashes"]["body"], got["dashes"]["front_lines"]) == ("-- -\n ---x", "end\n", 4)


def test_most_frontmatter_needs_no_yaml_reader():
    assert P._flat(NOTE.split("---\n")[1].replace("[[", "").replace("]]", "").replace("#meeting", "meeting").replace("two words: x\n", "")) is not None


def test_conditions_on_headers(spark):
    text = '{"meta":{"owner":"Ann","n":3,"deep":{"x":"Y"}},"empty":{},"none":[],"l":["A",2,true,null,["z"]],"x":null,"s":"Str","t":"ÄB","a b":1}'
    rows = spark.createDataFrame([(text,), (None,)], "j string").select(F.try_parse_json("j").alias("v"))
    cases = {
        ("meta", "ann"): True, ("meta", "3"): True, ("meta", "y"): False, ("meta.owner", "ANN"): True, ("meta.deep", "y"): True, ("meta.deep.x", "y"): True, ("l", "a"): True, ("l", "2"): True, ("l", "TRUE"): True, ("l", "z"): False, ("l[0]", "a"): True,
        ("s", "str"): True, ("S", "str"): False, ("t", "äb"): False, ("t", "Äb"): True, ("x", "null"): False, ("", "a"): False, ("a..b", "x"): False,
        ("meta", None): True, ("empty", None): False, ("none", None): False, ("l", None): True, ("x", None): True, ("s", None): True, ("gone", None): False, ("meta.deep", None): True, ("meta.gone", None): False, ("l[9]", None): False,
    }
    got = rows.select(*[F.coalesce(parse.has_attribute(F.col("v"), *case), F.lit(False)) for case in cases]).collect()
    assert dict(zip(cases, got[0])) == cases and not any(got[1])
    assert rows.select(parse.text_attribute(F.col("v"), "s"), parse.text_attribute(F.col("v"), "meta.n")).first() == ("Str", None)


def test_lines_are_not_shuffled(spark):
    x = parse.build_index(raw(spark, ("n.md", NOTE)))
    for table in (x.segments, x.todos, x.attributes, x.headers, search.search_todos(x, tags=["a"], links=["l"], attributes={"people": "bob"}, text="x", predicate=search.Or((search.Tag("b"), search.Attribute("gone"))))):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Window", "Exchange", "Join")), plan


def model_segments(body, name):
    """A stack over lines."""
    lines, out, stack, start, level, crumb, own, fence = body.split("\n"), [], [], 1, None, name, [], False

    def push():
        if "\n".join(own).strip():
            out.append((start, start + len(own) - 1, level, crumb, "\n".join(own)))

    for n, line in enumerate(lines, 1):
        if re.match(r"\s*```", line):
            fence = not fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.*)$", line)) and len(m[1]) <= 4:
            push()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            crumb = " > ".join([name, *(h for _, h in stack)])
            stack.append((len(m[1]), m[2]))
            start, level, own = n, len(m[1]), []
        own.append(line)
    push()
    return out


def test_segments_equal_the_model(spark):
    rng = random.Random(3)
    kinds = ["text", "", "# A", "## B", "### C", "#### D", "##### E", "```", "  ``` x", "#no", "- [ ] t", "## B2"]
    bodies = [(f"n{k}.md", "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 14))).rstrip("\n") + "x") for k in range(150)]
    got = {}
    for r in parse.segments(parse.parse(raw(spark, *bodies))).orderBy("start_line").collect():
        got.setdefault(r["filename"], []).append((r["start_line"], r["end_line"], r["heading_level"], r["breadcrumb"], r["text"]))
    for name, body in bodies:
        if not body.startswith("---"):
            assert got.get(name, []) == model_segments(body, name), body


def test_cascade_and_issue_segments(spark):
    x = parse.build_index(raw(spark, ("n.md", "# A #one\ntext\n## B [[L]]\ndeep #two\n"), ("jira/K-1.md", "# short\nfew words\n# long\n" + "word " * 20)))
    tags = {(r["segment_id"], r["tag"]) for r in x.segment_tags.collect()}
    assert tags == {("n.md#1", "one"), ("n.md#1", "two"), ("n.md#3", "one"), ("n.md#3", "two")}
    assert {r["segment_id"] for r in x.segments.collect()} == {"n.md#1", "n.md#3", "jira/K-1.md#3"}


def test_date_links_and_tags(spark):
    rows = spark.createDataFrame([("on 2024-01-02, [[see 2024-01-03]] [[2024-01-04]] 12024-01-05 [[2024-01-06", "#a/b/c x#no (#no) #ä_b #tag1 #a"), ("2024-01-02]] x", "#a//b")], "t string, g string")
    got = rows.select(T.link_dates("t"), T.with_parents(T.raw_tags("g"))).collect()
    assert got[0][0] == "on [[2024-01-02]], [[see 2024-01-03]] [[2024-01-04]] 12024-01-05 [[[[2024-01-06]]"
    assert got[0][1] == ["a", "a/b", "a/b/c", "ä_b", "tag"] and got[1][1] == ["a", "a/", "a//b"]


def test_jaro_winkler_keys_miss_nothing():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choice("abcd 12") for _ in range(rng.randint(1, 44)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            rng.choice((lambda: b.insert(k, rng.choice("abx")), lambda: b[:-1] and b.pop(k - 1), lambda: b.reverse() if rng.random() < 0.1 else None))()
        b = "".join(b)
        if b and P.jaro_winkler_text(a, b) >= 0.98:
            assert set(P.similar_name_keys(a, 0.98)) & set(P.similar_name_keys(b, 0.98)), (a, b)


def test_graph_and_backlinks(spark):
    x = parse.build_index(raw(spark, ("a.md", "[[b]] [[B]] [[gone]] [[a]]"), ("x/b.md", "[[a.md]] [[c d]]"), ("c_d.md", "")))
    assert {tuple(r) for r in reports.graph_edges(x).collect()} == {("a.md", "x/b.md"), ("c_d.md", "x/b.md")}
    assert {(r["target"], r["source"]) for r in reports.backlinks(x).collect()} == {("x/b.md", "a.md"), ("a.md", "x/b.md"), ("c_d.md", "x/b.md")}
    assert {tuple(r) for r in reports.ego_network(reports.graph_edges(x), "a.md", 2).collect()} == {("a.md", 0), ("x/b.md", 1), ("c_d.md", 2)}


def test_linker():
    assert rewrite.link_text("Ann Lee met ann_lee, [[Ann Lee]] and [ann lee](u) not Ann Lees or x-ann lee", ["ann_lee", "ann"]) == ("[[ann_lee]] met [[ann_lee]], [[Ann Lee]] and [ann lee](u) not [[ann]] Lees or x-ann lee", 3)
    assert rewrite.link_text("nothing", ["a b"]) == ("nothing", 0)


def linked(spark, rows, names):
    """Notes of ``link_entities``, and of the matcher on every note with every name."""
    notes = spark.createDataFrame(rows, "filename string, body string")
    got, met = ({(r["filename"], r["body"], r["n_links"]) for r in rewrite.link_entities(notes, spark.createDataFrame([(n,) for n in names], "name string"), most).collect()} for most in (100, 0))
    assert got == met  # by the automaton and on runs of words
    return got, {(f, *rewrite.link_text(b, names)) for f, b in rows if rewrite.link_text(b, names)[1]}


def test_linker_long_names(spark):
    names = ["one two three four five six seven", "One_two-three four five six eight nine", "one two"]
    rows = [("a", "on one two three four five six seven, again"), ("b", "one two three four five six Eight_nine"), ("c", "one two three four five six"), ("d", "two three")]
    got, want = linked(spark, rows, names)
    assert got == want and {f for f, _, _ in got} == {"a", "b", "c"} and all("[[one two three four five six seven]]" in b for f, b, _ in got if f == "a")


def test_linker_beside_other_characters(spark):
    rows = [("a", "in “Orchard” now"), ("b", "会议在Orchard举行"), ("c", "plan—Orchard Farm…"), ("d", "an Orchards"), ("e", "Café Nord, 😀Ann"), ("f", "xCafé Nord"), ("g", None)]
    got, want = linked(spark, rows[:-1], ["Orchard", "Orchard Farm", "Café Nord", "Ann", "会议"])
    assert got == want and {f for f, _, _ in got} == {"a", "b", "c", "e"}
    assert rewrite.link_entities(spark.createDataFrame(rows, "filename string, body string"), spark.createDataFrame([("Ann",)], "name string")).count() == 1


def test_rewrites(spark):
    rows = spark.createDataFrame([("f", "---\nupdated: old\n---\n- [ ] a\n- [ ] b ✅ x\n## Yournal\n- old"), ("g", "no front")], "filename string, content string")
    stamped = {r[0]: r[1] for r in rows.select("filename", rewrite.stamp_updated("content", "now")).collect()}
    assert stamped["f"].startswith("---\nupdated: now\n---\n") and stamped["g"] == "no front"
    done = rewrite.complete_todos(rows, spark.createDataFrame([("f", 4), ("f", 5), ("f", 6), ("h", 1)], "filename string, line_number int"), "2024-01-01").collect()
    assert len(done) == 1 and "- [x] a ✅ [[2024-01-01]]\n- [x] b ✅ x\n## Yournal" in done[0]["content"]
    entries = spark.createDataFrame([("f", 1, "- new"), ("f", 2, "- newer"), ("f", 3, "- old"), ("g", 1, "- e")], "filename string, ts int, line string")
    journal = {r["filename"]: r["content"] for r in rewrite.journal_append(rows, entries).collect()}
    assert journal["f"].endswith("## Yournal\n- newer\n\n- new\n\n- old") and journal["g"] == "no front\n\n## Yournal\n- e\n\n"


def test_journal_gathers_single_lines(spark, capsys):
    entries = spark.range(3000).selectExpr("'f' as filename", "id as ts", "concat('- ', id % 3) as line")
    rows = spark.createDataFrame([("f", "# f\n")], "filename string, content string")
    journal = rewrite.journal_append(rows, entries)
    assert journal.collect()[0]["content"].endswith("## Yournal\n- 2\n\n- 1\n\n- 0\n\n")
    journal.explain()
    assert "max(ts" in capsys.readouterr().out


def test_maintenance(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "filename string, mtime int")
    state = spark.createDataFrame([("a", 1), ("b", 1)], "filename string, mtime int")
    assert {r["filename"] for r in maintenance.changed(listing, state).collect()} == {"b", "c"}
    assert {tuple(r) for r in maintenance.upsert(state, spark.createDataFrame([("b", 9), ("b", 8)], state.schema)).collect()} == {("a", 1), ("b", 9), ("b", 8)}
    assert maintenance.clear(state).count() == 0


def test_a_change_rewrites_only_its_folders(spark, tmp_path):
    import os

    def there():
        return {(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, files in os.walk(tmp_path / "i") for f in files if f.startswith("part-")}

    kept = maintenance.StoredIndex(spark, str(tmp_path / "i"), buckets=16)
    notes = [(f"n{k}.md", f"#a\n- [ ] t{k} [[n{k + 1}]]") for k in range(40)]
    kept.write(parse.build_index(raw(spark, *notes)))
    before = there()
    kept.refresh(parse.build_index(raw(spark, ("n3.md", "#b"), ("new.md", "#c"))), spark.createDataFrame([("n5.md",)], "filename string"))
    after = there()
    changed = {d for d, f in set(before) ^ set(after)}
    assert 0 < len(changed) <= 3
    index = kept.read()
    assert {(r["filename"], r["tag"]) for r in index.note_tags.collect()} == {(f"n{k}.md", "a") for k in range(40) if k not in (3, 5)} | {("n3.md", "b"), ("new.md", "c")}
    assert index.todos.count() == 38 and not index.todos.filter("filename in ('n3.md', 'n5.md')").count()
    assert [r["filename"] for r in kept.table.of_keys(["n3.md", "none.md"]).collect()] == ["n3.md"]
    kept.refresh(parse.build_index(raw(spark, ("n3.md", "x"))), kept.read().notes.select("filename"))
    assert [r["filename"] for r in kept.read().notes.collect()] == ["n3.md"]


def test_vault_on_disk(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "ä+b.md").write_text("# x")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "no.txt").write_text("no")
    good, bad = files.read_vault(spark, str(tmp_path))
    assert [(r["filename"], r["content"]) for r in good.collect()] == [("sub dir/ä+b.md", "# x")]
    assert [r["filename"] for r in bad.collect()] == ["bad.md"]


def test_html_mail_and_word(spark, tmp_path):
    page = "<html><head><title>T</title></head><body><nav>no</nav><main><h2>H</h2><p>One <b>two</b><p>three <a href='u'>l</a><ul><li>i<li>j</ul><script>x</script></main></body>"
    assert P.html_to_markdown(page) == "## H\n\nOne **two**\n\nthree [l](u)\n\n- i\n- j"
    assert P.html_to_markdown(None) == "" and P.html_to_markdown("plain") == "plain"
    deep = "<div>" * 3000 + "<script>no</script><b>x</b> y" + "</div>" * 3000
    assert P.html_to_markdown(deep) == "**x** y"
    mail = b"From: A <a@b.c>\r\nTo: ann.lee@x.y, Bo <b@x.y>\r\nSubject: Hi \"x\"\r\nDate: Mon, 15 Jan 2024 10:30:00 +0100\r\nMessage-ID: <1@x>\r\nCc: Cy <c@y.z>, d.e@y.z\r\n\r\nbody\\_text **\r\n"
    bare = b"From: c.d@b.c\r\n\r\nx\r\n"
    rows = spark.createDataFrame([("in/a b.eml", bytearray(mail)), ("in/bare.eml", bytearray(bare))], "path string, content binary")
    note, plain = ingest.mails_to_notes(rows, F.lit("2024-02-01 08:00:00").cast("timestamp")).orderBy("path").collect()
    assert note["filename"] == "mail/2024/Jan/mail-2024-01-15-a_b.md" and note["subject"] == 'Hi "x"'
    head = ["created: 2024-01-15 10:30", "type: mail", 'source: "in/a b.eml"', 'title: "Hi \\"x\\""', 'from: "A"', "to:", '  - "[[ann_lee]]"', '  - "Bo"', 'mail_date: "2024-01-15T10:30:00+01:00"']
    block = ["**From:** A", "**To:** [[ann_lee]], Bo", "**Cc:** Cy, [[d_e]]", "**Date:** 2024-01-15T10:30:00+01:00", "**Message-ID:** 1@x", "---"]
    assert note["content"] == "---\n" + "\n".join(head) + '\n---\n\n\n# Hi "x"\n\n' + "\n\n".join(block) + "\n\nbody\\_text **"
    many = b"From: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\nhi\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nx\r\n--x--\r\n"
    assert ingest.mails_to_notes(spark.createDataFrame([("m.eml", bytearray(many))], "path string, content binary")).first()["content"].endswith("hi\n\n---\n\n## Attachments\n\n- **a.pdf** (application/pdf)\n")
    assert plain["filename"] == "mail/2024/Feb/mail-2024-02-01-bare.md" and plain["content"].startswith('---\ncreated: 2024-02-01 08:00\ntype: mail\nsource: "in/bare.eml"\ntitle: "(No Subject)"\nfrom: "[[c_d]]"\n---\n')
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p></w:body></w:document>')
    rows = spark.createDataFrame([("a", bytearray((tmp_path / "a.docx").read_bytes())), ("b", bytearray(b"no"))], "path string, content binary")
    got = {r["path"]: (r["title"], r["body"]) for r in ingest.docx_to_notes(rows).collect()}
    assert got["a"] == ("Head", "## Head\n\ntext") and got["b"][1] == ""


def test_mail_body_on_all_documents(spark, sf_dir):
    starts = ("Times New Roman", "Arial", "Calibri", "font-family:", "font-size:", "font-style:", "font-weight:", "color:", "background-color:", "mso-", "@")

    def lines(text):
        found = [x.removesuffix("\r") for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]
        return found[:-1] if found[-1] == "" else found

    def plain(text):
        kept = "\n".join(x for x in lines(text) if not x.strip().startswith(starts))
        for c in "*_[](){}#+-.!|\\":
            kept = kept.replace("\\" + c, c)
        return "\n".join(x.rstrip().rstrip("*") for x in lines(kept))

    odd = ["a\\_b \\* **\n{x}\n  Font-Size: 3\n font-size: 3\ny * z *", "<!-- a\n@page b\r\n\\\\*\n**", "span.x\nArial 3\n\n\n", "", "\n", "a\\|b \\\\ \\q** * \u3000\n"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()] + [(-1 - k, t) for k, t in enumerate(odd)]
    assert any(set("\\*@{}<") & set(t) for i, t in rows if i >= 0)
    got = {r["doc_id"]: r["cleaned"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", ingest.clean_mail_body(F.col("text")).alias("cleaned")).collect()}
    assert [(i, got[i], plain(t)) for i, t in rows if got[i] != plain(t)] == []


def test_needles_with_other_letters(spark):
    rows = spark.createDataFrame([("Die ÖKO Seite",), ("die öko seite",), (None,)], "s string")
    assert [r[0] for r in rows.select(T.like("s", "ÖkO")).collect()] == [True, False, None]
    assert [r[0] for r in rows.select(T.like("s", "die ö_O")).collect()] == [False, True, None]


def test_comment_headers_and_issues(spark):
    cases = {
        ("Stefan Harbeck", "2024-06-14T09:29:05.000+0000"): "### [[stefan harbeck]] writes on [[2024-06-14]] at 09:29:05+0000",
        ("ÄNNE", "2024-06-14T09:29:05Z"): "### [[änne]] writes on [[2024-06-14]] at 09:29:05Z",
        ("A", "2024-06-14T09:29:05.123-0700"): "### [[a]] writes on [[2024-06-14]] at 09:29:05-0700",
        ("A", "2024-06-14T09:29"): "### [[a]] writes on [[2024-06-14]] at 09:29",
        ("A", "yesterday"): "### [[a]] (yesterday)",
    }
    rows = spark.createDataFrame(list(cases), "a string, c string")
    assert {(r["a"], r["c"]): r["h"] for r in rows.select("a", "c", ingest.comment_header(F.col("a"), F.col("c")).alias("h")).collect()} == cases
    issue = '{"key":"P-1","fields":{"summary":"S","description":"","status":{"name":"Open"},"labels":[],"comment":{"comments":[]}}}'
    note = ingest.issues_to_notes(spark.createDataFrame([(issue,)], "j string").select(F.from_json("j", ingest.ISSUE).alias("i")).select("i.*")).first()
    assert tuple(note) == ("jira/P-1.md", '---\nkey: "P-1"\ntype: jira\nstatus: "Open"\n---\n\n# P-1 - S\n\n')


def test_deep_thread(spark):
    posts = [("t", str(k), str(k - 1) if k else None, "t1", "a", f"c{k}", 0) for k in range(40)]
    got = ingest.flatten_thread(spark.createDataFrame(posts, "thread string, id string, parent string, kind string, author string, text string, ord int")).orderBy("number").collect()
    assert [(r["number"], r["text"]) for r in got] == [(k + 1, f"c{k}") for k in range(40)]


def test_note_folders(spark, tmp_path):
    rows = spark.createDataFrame([("v/web/2024/Jan/web-2024-01-31-a.md", "x"), ("notes/b.md", "y")], "filename string, content string")
    ingest.write_notes(rows, str(tmp_path / "out"))
    assert sorted((r["filename"], r["type"], r["year"], r["mon"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("notes/b.md", "notes", None, None), ("v/web/2024/Jan/web-2024-01-31-a.md", "web", 2024, "Jan")]
    ingest.write_results(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_threads(spark):
    posts = [("t", "1", None, "t1", "a", "one", 0), ("t", "2", "1", "t1", "b", "[deleted]", 0), ("t", "3", "2", "t1", "c", "three", 0), ("t", "4", None, "t1", "d", "four", 1), ("t", "5", None, "more", "", "x", 2)]
    got = ingest.flatten_thread(spark.createDataFrame(posts, "thread string, id string, parent string, kind string, author string, text string, ord int")).orderBy("number").collect()
    assert [(r["number"], r["text"]) for r in got] == [(1, "one"), (3, "three"), (4, "four")]


def test_nested_threads(spark):
    import json

    node = lambda k, replies: {"kind": "t1", "data": {"author": "a", "body": f"c{k}", "score": k, "created_utc": 0, "replies": replies}}
    listing = lambda children: {"data": {"children": children}}
    deep = ""
    for k in range(40, 0, -1):
        deep = listing([node(k, deep)])
    note = P.thread_note(json.dumps([listing([{"data": {"title": "T"}}]), deep]))
    assert note[0] == 40 and note[1].startswith("# T\n\n\n## Comments\n\n### Comment 1 (by u/a)\n\n*Score: 1 | Posted: 1970-01-01 00:00 UTC*\n\nc1\n\n") and note[1].endswith("c40\n\n")
    wide = [node(1, listing([node(2, ""), {"kind": "more", "data": {"replies": listing([node(9, "")])}}])), {"kind": "t1", "data": {"body": "[deleted]", "replies": listing([{"kind": "t1", "data": {"body": "kept"}}])}}]
    note = P.thread_note(json.dumps([listing([]), listing(wide)]))
    assert note == (4, "\n## Comments\n\n### Comment 1 (by u/a)\n\n*Score: 1 | Posted: 1970-01-01 00:00 UTC*\n\nc1\n\n### Comment 2 (by u/a)\n\n*Score: 2 | Posted: 1970-01-01 00:00 UTC*\n\nc2\n\n### Comment 4 (by u/[deleted])\n\nkept\n\n")
    rows = spark.createDataFrame([(1, "[]"), (2, "no"), (3, None), (4, json.dumps([listing([{"data": {"title": "ä", "score": 3, "selftext": "s", "url": "u", "permalink": "p"}}])]))], "thread int, json string")
    got = {r["thread"]: (r["n_comments"], r["content"]) for r in ingest.threads_to_notes(rows).collect()}
    assert got[1] == got[2] == got[3] == (0, None) and got[4] == (0, "# ä\n\n**Score:** 3  \n\n## Original Post\n\ns\n\n---\n\n**Link:** [u](u)\n\n## Comments\n\n*No comments found.*\n\n")


def test_ego_network_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(14)], "source string, target string")
    got = reports.ego_network(edges, "n00", 10)
    assert {tuple(r) for r in got.collect()} == {(f"n{k:02}", k) for k in range(11)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert reports.ego_network(edges, "n13", 99).count() == 15 and reports.ego_network(edges, "gone", 3).collect() == [("gone", 0)]


def test_embeddings_of_failed_batches_are_null(spark):
    rows = spark.createDataFrame([("f", "old"), ("f", "new"), ("g", "old"), ("g", "bad")], "filename string, text string")
    known = spark.createDataFrame([("f", "old", [1.0]), ("g", "bad", None)], "filename string, text string, embedding array<double>")
    embed = lambda text: F.when(text != "bad", F.array(F.length(text).cast("double")))
    got = {(r["filename"], r["text"]): (r["embedding"], r["reused"]) for r in reports.reuse_embeddings(rows, known, embed).collect()}
    assert got == {("f", "old"): ([1.0], True), ("f", "new"): ([3.0], False), ("g", "old"): ([3.0], False), ("g", "bad"): (None, False)}


def test_cosine_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 2.0])], "id long, embedding array<float>")
    got = [(r["id"], round(r["score"], 4)) for r in reports.similar_to(rows, [1.0, 0.0], 10).collect()]
    assert got == [(1, 1.0), (5, 0.7071), (2, 0.0), (4, 0.0)]
    batch = vectors.similar(rows, rows.filter("id = 5").selectExpr("id as query_id", "embedding as vector"), 2).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 4)) for r in batch] == [(5, 1.0), (1, 0.7071)]


def test_watching_a_folder(spark, tmp_path):
    import os

    vault, home = tmp_path / "vault", tmp_path / "home"
    vault.mkdir()
    seen = []

    def run():
        seen.clear()
        streams.watch_folder(spark, str(vault), lambda rows, number: seen.extend((r["filename"], r["content"], r["deleted"]) for r in rows.collect()), str(home), once=True).awaitTermination()
        return sorted(seen)

    def put(name, text, when):
        (vault / name).parent.mkdir(exist_ok=True)
        (vault / name).write_text(text)
        os.utime(vault / name, (when, when))

    put("a.md", "one", 2000)
    put("no.txt", "no", 2000)
    for k in range(600):
        put(f"many/n{k}.md", str(k), 3000)
    assert len(run()) == 601 and ("a.md", "one", False) in seen
    put("sub dir/b.md", "late, and older than what was read", 1000)
    put("a.md", "two", 1500)
    (vault / "many" / "n7.md").unlink()
    # changed without a trace in the listing: opened only if files that didn't change are read
    put("many/n8.md", "X", 3000)
    assert run() == [("a.md", "two", False), ("many/n7.md", None, True), ("sub dir/b.md", "late, and older than what was read", False)]
    assert run() == []
    for k in range(4):
        put("a.md", f"round {k}", 5000 + k)
        assert run() == [("a.md", f"round {k}", False)]
    (vault / "a.md").unlink()
    (vault / "sub dir" / "b.md").unlink()
    (vault / "sub dir").rmdir()
    assert run() == [("a.md", None, True), ("sub dir/b.md", None, True)]
    assert run() == []
    # of all rounds, a listing is left and what the last one read, as it may have to be done again
    assert len([f for f in os.listdir(home / "listings") if f.startswith("listing-")]) <= 2 and len(os.listdir(home / "listings")) <= 5
    table = spark.createDataFrame([("a.md", 1), ("sub dir/b.md", 2)], "filename string, n int")
    gone = spark.createDataFrame([("a.md", True)], "filename string, deleted boolean")
    assert [r["filename"] for r in streams.apply_versions(table, gone, table.limit(0)).collect()] == ["sub dir/b.md"]


def test_a_round_that_failed_is_done_again(spark, tmp_path):
    vault, home = tmp_path / "vault", tmp_path / "home"
    vault.mkdir()
    (vault / "a.md").write_text("one")

    def fail(rows, number):
        raise RuntimeError("not now")

    with pytest.raises(Exception, match="not now"):
        streams.watch_folder(spark, str(vault), fail, str(home), once=True).awaitTermination()
    (vault / "b.md").write_text("two")
    seen = []
    for _ in range(2):
        streams.watch_folder(spark, str(vault), lambda rows, number: seen.extend(r["filename"] for r in rows.collect()), str(home), once=True).awaitTermination()
    assert sorted(seen) == ["a.md", "b.md"]


def test_late_versions_in_any_split_into_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"n{rng.randrange(12)}.md", rng.choice("abcdef"), f"2024-01-0{rng.randint(1, 5)} 00:00:00", rng.random() < 0.2) for _ in range(120)]
    frame = spark.createDataFrame(rows, "filename string, content string, day string, deleted boolean").selectExpr("filename", "if(deleted, null, content) as content", "cast(day as timestamp) as mtime", "deleted")
    answers = []
    for split in (1, 4):
        folder = tmp_path / f"in{split}"
        parts = [frame.filter(F.pmod(F.xxhash64("filename", "content", "mtime"), F.lit(split)) == k) for k in range(split)]
        for k, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = streams.run_once(streams.newest_versions(stream), str(tmp_path / f"out{split}"), "update")
        last = streams.latest_of_updates(out, "filename")
        answers.append(sorted(tuple(r) for r in last.select("filename", "content", "mtime", "deleted").collect()))
    want = {}
    for r in frame.collect():
        key = (r["mtime"], r["deleted"], hashlib.sha256((r["content"] or "").encode()).hexdigest())
        want[r["filename"]] = max(want.get(r["filename"], (key, r)), (key, r), key=lambda x: x[0])
    assert answers[0] == answers[1] == sorted((n, r["content"], r["mtime"], r["deleted"]) for n, (_, r) in want.items())


def test_presets():
    import datetime as dt

    day = dt.date(2024, 3, 6)  # a Wednesday
    text = lambda name: tuple(map(str, search.preset_range(name, day)))
    assert text("this week") == ("2024-03-04", "2024-03-10") and text("Last-Week") == ("2024-02-26", "2024-03-03")
    assert text("last month") == ("2024-02-01", "2024-02-29") and text("thisyear") == ("2024-01-01", "2024-12-31") and text("last_year")[1] == "2023-12-31"
    with pytest.raises(ValueError):
        search.preset_range("someday", day)


def test_sql_functions(spark):
    T.register(spark)
    assert tuple(spark.sql("SELECT nl_norm('A_b'), nl_tag_parents('a/b'), round(nl_cosine(array(1D, 0D), array(1D, 1D)), 4)").first()) == ("a b", ["a", "a/b"], 0.7071)
    assert spark.range(1).select(F.round(T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 4)).first()[0] == 0.0


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_pages_of_a_note_that_most_others_link_to(spark):
    hot = spark.range(100_000).select(F.lit("hot.md").alias("target"), F.format_string("s%06d", F.col("id").cast("int")).alias("source"))
    rest = spark.range(60_000).select(F.format_string("t%d.md", (F.col("id") % 20_000).cast("int")).alias("target"), F.format_string("s%06d", F.col("id").cast("int")).alias("source"))
    pages = reports.paged(hot.unionByName(rest).repartition(7), 1000).cache()
    assert pages.agg(F.max("n")).first()[0] == 1000 and pages.filter("target = 'hot.md'").count() == 100
    firsts = [(r["page"], r["sources"][0], r["sources"][-1], len(r["sources"])) for r in pages.filter("target = 'hot.md'").orderBy("page").collect()]
    assert firsts == [(k, f"s{k * 1000:06d}", f"s{k * 1000 + 999:06d}", 1000) for k in range(100)]
    assert pages.filter("target <> 'hot.md'").agg(F.sum("n"), F.max("page"), F.count("*")).first() == (60_000, 0, 20_000)
    # a page is never filled from the wrong place, however many ranges a target is spread over
    spread = reports.paged(hot.limit(0).unionByName(rest), 2)
    assert spread.filter("page = 0 and n <> 2 or page = 1 and n <> 1 or page > 1").isEmpty() and spread.count() == 40_000
    assert reports.paged(hot.limit(0), 5).isEmpty()


def test_texts_of_a_kept_index_are_found_by_trigrams(spark, tmp_path):
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "delta", "äpfel", "\U0001f600x", "a_b", "100%", "ab", "\n", "\r\n", "- [ ] call "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(120)] + [None, "", "ab", "---\ntitle: Ganz Neu\nplace: {at: Köln}\n---\n# X\r\nlast line\r\n# Y\nend"]
    raw = spark.createDataFrame([(f"n{k}.md", t, None) for k, t in enumerate(texts)], "filename string, content string, mtime timestamp")
    kept = maintenance.StoredIndex(spark, str(tmp_path / "i"), buckets=8, texts=True)
    kept.write(parse.build_index(raw))
    whole = kept.read()
    for needle in ("ALPHA be", "äpfel", "\U0001f600x", "ganz", "koeln", "Köln", "a%delta", "ab", "x_y", "last line", "line%# y", "absent word", "100\\%", "%"):
        part = kept.holding(needle)
        for search_one, key in ((search.search_notes, "filename"), (search.search_todos, "todo_id"), (search.search_segments, "segment_id")):
            found = lambda x: sorted(r[0] for r in search_one(x, text=needle).select(key).collect())  # noqa: B023, E731
            assert found(part) == found(whole), (needle, key)
    assert kept.candidates(["ab"]) is None and kept.candidates(["absent word"]).count() == 0
    assert kept.holding("last line").notes.count() == 1
    assert sorted(r[0] for r in search.search_notes(kept.holding("100%", like=False), body="100%").select("filename").collect()) == sorted(r[0] for r in search.search_notes(whole, body="100%").select("filename").collect())
    # few and many candidates are read in two ways
    some = whole.notes.select("filename").filter("filename like '%1%'")
    assert sorted(r["filename"] for r in kept.table.among(some, 3).collect()) == sorted(r["filename"] for r in kept.table.among(some).collect()) == sorted(r[0] for r in some.collect())
    # a refresh changes both tables
    kept.refresh(parse.build_index(raw.filter("filename = 'n0.md'").withColumn("content", F.lit("wholly new"))), raw.filter("filename = 'n123.md'").select("filename"))
    assert [r["filename"] for r in kept.holding("wholly new").notes.collect()] == ["n0.md"] and kept.candidates(["last line"]).count() == 0
    assert kept.grams.read().filter("filename = 'n0.md'").count() == 8


def test_keyed_table_may_be_empty(spark, tmp_path):
    none = spark.createDataFrame([], "filename string, content string")
    kept = maintenance.KeyedTable(spark, str(tmp_path / "table"), buckets=4)
    kept.write(none)
    assert kept.read().columns == ["filename", "content"] and kept.read().count() == 0
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], none.schema)
    kept.upsert(rows)
    assert sorted(map(tuple, kept.read().collect())) == [("a", "x"), ("a", "y"), ("b", "z")]
    kept.upsert(none, rows)
    assert kept.read().count() == 0 and kept.of_keys(["a"]).count() == 0
    kept.upsert(rows.limit(1))
    assert kept.read().count() == 1


def test_write_vault(spark, tmp_path):
    """Odd names and contents, repeated names, a second run over the same files, and names that lead elsewhere."""
    rows = spark.createDataFrame([("a.md", "1"), ("a.md", "2"), ("b c/ü+%20.md", "Köln\n"), ("d/100% x.md", "y"), ("e.md", None), ("f.md", ""), (None, "x")], "filename string, content string")
    for _ in range(2):
        assert files.write_vault(rows, f"file://{tmp_path}/vault") == 5
        got = {r["filename"]: r["content"] for r in files.read_vault(spark, f"file://{tmp_path}/vault")[0].collect()}
        assert got == {"a.md": "2", "b c/ü+%20.md": "Köln\n", "d/100% x.md": "y"}  # Spark leaves out files of no bytes
    seen = []
    home = tmp_path / "home"
    streams.watch_folder(spark, str(tmp_path / "vault"), lambda v, number: seen.extend(v.select("filename", "content").collect()), str(home), once=True).awaitTermination()
    assert {tuple(r) for r in seen} == {*got.items(), ("e.md", ""), ("f.md", "")}
    assert files.write_vault(rows.limit(0), f"file://{tmp_path}/none") == 0
    for name in ("../x.md", "/x.md", "a/./b.md", "a//b.md", "a/", ""):
        with pytest.raises(Exception, match="not a name below a folder"):
            files.write_vault(spark.createDataFrame([(name, "")], rows.schema), f"file://{tmp_path}/vault")
