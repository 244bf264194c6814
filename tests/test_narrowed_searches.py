"""Searches parse only the notes whose raw texts hold what is asked for, and find what they found before."""

import random

from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import parse, search
from notelake.operators.search import And, Attribute, Link, Or, Tag, Text

NOTES = [
    "---\nlabels: [Topic_X]\n---\nx", "---\n\"lab\\x65ls\": [\"t\\x6fpic x\"]\n---\nx", "---\nla[[bels: [TOPIC X]\n---\nx", "---\nla[][[]bels: [topic x]\n---\n", "---\nx: [[\"Topic X\"]]\n---\n", "see [[topic x]]", "see [a](TOPIC_x) 2024-01-02",
    "---\r\nx: \"[[topic\r\n---\r\nx]]", "a #de```tasks\nq```ep/x b [[Top```dataview\n```ic X]]", "---\npeople: Ann\n---\n#Deep/er text", "---\nparticipant: ann\n---\nDEEP", "# Participants\n- Ann\n", "# LABELS\n- a\n", "# Key\n- a\n", "---\nkey: {in: A}\n---\n- [ ] do #deep [[topic_X]]\n",
    "- [x] tag: deep\n# [[topic x]]\nt\n## H\nu deep", "#deeper [[topics x]]", "---\ncreated: 2024-01-02\n---\n#deep", "", None, "plain", "[[[topic x]]", "[[ x 2024-01-02 y", "#de_ep [[a]]",
]
PREDICATES = [
    Tag("deep"), Tag("De ep"), Tag("deep/er"), Link("Topic_X"), Link("topic x"), Link("2024-01-02"), Link("x [[2024-01-02"), Attribute("labels"), Attribute("labels", "topic_x"), Attribute("people", "ANN"), Attribute("people"), Attribute("key"), Attribute("key.in", "a"),
    Attribute("created", "2024-01-02"), Text("deep"), Text("d%p"), And((Tag("deep"), Link("topic_x"))), Or((And((Text("deep"), Attribute("created", "2024-01-02"))), Tag("deep/er"))), And(()), Or(()),
]


def _index(spark):
    rows = [(f"n{k:02}.md", x) for k, x in enumerate(NOTES)]
    return parse.build_index(spark.createDataFrame(rows, "filename string, content string").selectExpr("*", "cast(null as timestamp) as mtime"))


def test_texts_hold_what_accepted_notes_need(spark):
    raw, mapping = _index(spark).source
    kept = parse.index_from(parse.parse(raw, mapping).cache())
    assert search.narrowed("notes", kept, [Tag("deep")]) is kept  # an index without texts stays as it is
    content, none = F.coalesce("content", F.lit("")), F.lit(True)
    left = 0
    for entity, rows in (("notes", kept.notes), ("todos", kept.todos), ("segments", kept.segments)):
        hints = [search.hint(entity, p, content, mapping) for p in PREDICATES]
        may = {r["filename"]: r for r in raw.select("filename", *[(none if h is None else h | search.cut_apart(content)).alias(f"c{k}") for k, h in enumerate(hints)]).collect()}
        for r in rows.select("filename", *[search.condition(entity, p).alias(f"c{k}") for k, p in enumerate(PREDICATES)]).collect():
            assert not [p for k, p in enumerate(PREDICATES) if r[f"c{k}"] and not may[r["filename"]][f"c{k}"]], (entity, r)
        left += sum(not m[f"c{k}"] for m in may.values() for k in range(len(PREDICATES)))
    assert left > 200


def test_searches_parse_only_notes_that_may_match(spark):
    index = _index(spark)
    for found in (search.search_notes(index, links=["Topic_X"]), search.search_todos(index, links=["Topic_X"]), search.search_segments(index, predicate=Or((Link("Topic_X"), Tag("deep/er"))))):
        assert "contains" in found._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(r[0] for r in search.search_todos(index, links=["Topic_X"]).select("filename").collect()) == ["n14.md", "n15.md"]


def test_patterns_find_what_they_found(spark):
    rng = random.Random(11)
    parts = ["#", "#a", "#ä/b", " ", "\n", "\r\n", "\r", "2024-01-02", "x", "[[", "]]", "[a](b)", "](", " ", "٣٣٣٣-٣٣-٣٣", "", "```", "1"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for k in range(20000)] + [(-1, None)]
    texts = spark.createDataFrame(rows, "k int, t string")
    found = lambda pattern, group: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    tags = found(r"(?U)(?:^|\s)#([A-Za-zäöüÄÖÜß][A-Za-zäöüÄÖÜß/_]*)", 1)
    dated = F.regexp_replace("t", r"(?U)\b(\d{4}-\d{2}-\d{2})\b(?![^\[\]]*+(?:(?:\[(?!\[)|\](?!\]))[^\[\]]*+)*+\]\])", "[[$1]]")
    lines = F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("t", r"\r?\n\z", ""), r"\r?\n"))
    links = F.concat(found(T.MARKDOWN_LINK, 2), found(T.WIKI_LINK, 1))
    same = [a.eqNullSafe(b) for a, b in ((tags, T.raw_tags("t")), (dated, T.link_dates("t")), (lines, T.lines("t")), (links, T.links_of("t")))]
    assert texts.select(*[F.sum((~c).cast("int")) for c in same]).first()[:] == (0, 0, 0, 0)
