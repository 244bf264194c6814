"""Registered queries: each applies an operator to the notes generated from the tables, or to the tables themselves."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, maintenance, parse, reports, rewrite, search, vectors
from ..operators.parse import Index, build_index
from ..scratch import remove, scratch_path
from ..sources import corpus, files
from ..sources.corpus import TODAY
from ..streaming import streams
from .facts import with_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, select: str | None = None, plain: bool = False):
    """Adds a query over the index of the corpus, with SQL over the facts (or, if ``plain``, over the tables)."""

    def add(f: Callable[[Index], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(index_of(spark, sf_dir))
        if select:
            ORACLES[name] = select if plain else with_facts(select)
        return f

    return add


def on_tables(name: str, select: str | None = None, facts: bool = False):
    """Adds a query that takes the session and the folder of the tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if select:
            ORACLES[name] = with_facts(select) if facts else select
        return f

    return add


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(corpus.notes_raw(spark, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # times without a zone are UTC
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def joined(column: str, name: str | None = None) -> F.Column:
    """An array as text, in order of its elements."""
    return F.array_join(F.array_sort(column), ",").alias(name or column)


NORM = "lower(replace({}, '_', ' '))"

# --- parsing ---------------------------------------------------------------------------------------

on_tables("import_notes", "SELECT filename FROM nm UNION ALL SELECT 'doc/' || coalesce(source, 'none') || '/' || doc_id || '.md' FROM documents", True)(
    lambda s, d: files.import_notes(corpus.notes_raw(s, d, True), F.col("filename"), F.col("content"), F.col("mtime")).select("filename")
)
on_tables("frontmatter_split", """SELECT b.filename, b.body || CASE WHEN kind = 'project' THEN '```tasks' || chr(10) || 'not done' || chr(10) || '```' ELSE '' END AS body,
    CASE kind WHEN 'meeting' THEN 8 WHEN 'project' THEN 7 ELSE 5 END AS front_lines FROM b JOIN nm USING (filename)
    UNION ALL SELECT 'doc/' || coalesce(source, 'none') || '/' || doc_id || '.md', coalesce(text, ''), 0 FROM documents""", True)(
    lambda s, d: parse.split_front(corpus.notes_raw(s, d, True)).select("filename", "body", "front_lines")
)
register("strip_query_blocks", "SELECT filename, body FROM b")(lambda x: x.notes.select("filename", "body"))
register("note_attributes", "SELECT filename, key, value FROM a WHERE key <> 'city' UNION ALL SELECT filename, 'city', 'Köln' FROM c")(
    lambda x: parse.front_rows(x.parsed).select("filename", "key", "value")
)
on_tables("hash_prefixes", "SELECT 'd/' || doc_id || '.md' AS filename, 'topic' AS key, '#doc ' || doc_id || ' ' || coalesce(lang, 'none') || ' a#b #' || doc_id AS value FROM documents")(
    lambda s, d: build_index(table(s, d, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), F.lit(None).cast("timestamp").alias("mtime"),
        F.concat(F.lit("---\ntopic: \"#doc  #"), F.col("doc_id").cast("string"), F.lit("   #"), F.coalesce("lang", F.lit("none")), F.lit(" a#b ##"), F.col("doc_id").cast("string"), F.lit("\"\n---\n"), F.coalesce("text", F.lit(""))).alias("content"),
    )).attributes.filter("key = 'topic'").select("filename", "key", "value")
)
register("body_attributes", "SELECT filename, 'participants' AS key, cust AS value FROM o")(lambda x: parse.body_attributes(x.parsed).select("filename", "key", "value"))
on_tables("merged_attributes", "SELECT filename, key, value FROM a UNION ALL SELECT filename, 'participants', cust FROM o", True)(
    lambda s, d: build_index(corpus.notes_raw(s, d), None).attributes.select("filename", "key", "value")
)
register("mapped_attributes", "SELECT filename, key, value, is_array FROM a WHERE key = 'people'")(lambda x: x.attributes.filter("key = 'people'").select("filename", "key", "value", "is_array"))
register("transliterated_values", "SELECT filename, value FROM a WHERE key = 'city'")(lambda x: x.attributes.filter("key = 'city'").select("filename", "value"))
register("header_fields", "SELECT filename, header AS header_json FROM h")(lambda x: x.headers)
register("frontmatter_links", "SELECT filename, cust AS link FROM o")(lambda x: x.parsed.select("filename", F.explode(F.regexp_extract_all("front", F.lit(T.WIKI_LINK), F.lit(1))).alias("link")))
register("date_field_links", "SELECT filename, day AS link FROM o UNION ALL SELECT filename, day FROM p")(
    lambda x: x.parsed.select("filename", F.explode("attributes").alias("a")).filter("a.key = 'created'").select("filename", T.date_part(F.col("a.value")).alias("link"))
)
register("label_links", "SELECT filename, lower(nation) AS link FROM p")(
    lambda x: x.parsed.select("filename", F.explode("attributes").alias("a")).filter("a.key = 'labels'").select("filename", F.lower("a.value").alias("link"))
)
register("note_titles", "SELECT filename, title FROM n")(lambda x: x.notes.select("filename", "title"))
register("implicit_date_links", "SELECT filename, day AS link FROM o UNION ALL SELECT filename, dashed FROM t WHERE dashed IS NOT NULL")(
    lambda x: x.notes.select("filename", F.explode(F.regexp_extract_all(T.link_dates("body"), F.lit(T.WIKI_DATE), F.lit(1))).alias("link"))
)
register("extract_links", "SELECT filename, link FROM (SELECT filename, supp AS link FROM t UNION ALL SELECT filename, cust FROM o UNION ALL SELECT filename, 'https://example.com/s/' || k FROM p UNION ALL SELECT filename, 'Customer_' || k9 FROM p UNION ALL SELECT filename, 'order_' || k FROM c) x")(
    lambda x: x.notes.select("filename", F.explode(T.links_of("body")).alias("link"))
)
register("note_links", "SELECT filename, link FROM l")(lambda x: x.note_links)
register("note_tags", "SELECT filename, tag FROM g")(lambda x: x.note_tags)
on_tables("tag_hierarchy", "SELECT DISTINCT 'r/' || user_id || '/x' AS source, tag FROM (SELECT user_id, unnest([event_type, event_type || '/deep', event_type || '/deep/end']) AS tag FROM events) x")(
    lambda s, d: table(s, d, "events").select(F.concat(F.lit("r/"), F.col("user_id").cast("string"), F.lit("/x")).alias("source"), F.explode(T.with_parents(T.raw_tags(F.concat(F.lit("a #"), "event_type", F.lit("/deep/end9 b"))))).alias("tag")).distinct()
)
register("todos", "SELECT filename, line_number, closed, priority, due, text FROM t")(lambda x: x.todos.select("filename", "line_number", "closed", "priority", "due", "text"))
register("todo_fields", "SELECT filename, line_number, 'ship/' || flag AS tags, supp AS links FROM t")(lambda x: x.todos.select("filename", "line_number", F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links")))
register("todo_timestamps", "SELECT filename, line_number, updated FROM t")(lambda x: x.todos.select("filename", "line_number", "updated"))
register("segments", "SELECT filename, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(heading_level AS INTEGER) AS heading_level, text FROM s")(
    lambda x: x.segments.select("filename", "start_line", "end_line", "heading_level", "text")
)
register("segment_breadcrumbs", "SELECT segment_id, breadcrumb FROM sg")(lambda x: x.segments.select("segment_id", "breadcrumb"))
register("segment_tags", "SELECT segment_id, tag FROM sg JOIN g USING (filename)")(lambda x: x.segment_tags)
register("segment_links", "SELECT segment_id, link FROM sg JOIN l USING (filename)")(lambda x: x.segment_links)
register("segment_attributes", "SELECT segment_id, key, value FROM sg JOIN a USING (filename)")(lambda x: x.segment_attributes)
on_tables("segments_min_words", "SELECT 'jira/' || k || '.md#1' AS segment_id FROM o WHERE k % 40 >= 19", True)(
    lambda s, d: parse.segments(parse.parse(table(s, d, "orders").select(
        F.concat(F.lit("jira/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("filename"),
        F.concat(F.lit("word"), F.repeat(F.lit(" word"), (F.col("o_orderkey") % 40).cast("int"))).alias("content"), F.col("o_orderdate").alias("mtime"),
    ))).select("segment_id")
)
register("note_timestamps", "SELECT filename, created, updated FROM n")(lambda x: x.notes.select("filename", "created", "updated"))
register("note_counts", "SELECT filename, todo_count, link_count FROM n")(lambda x: x.notes.select("filename", "todo_count", "link_count"))


@on_tables("embedding_reuse", "SELECT doc_id, doc_id % 3 = 0 AS reused, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS DOUBLE) AS first_value FROM documents WHERE text IS NOT NULL")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("filename"), "text")
    known = rows.filter("doc_id % 3 = 0").select("filename", "text", F.array(F.lit(0.0)).alias("embedding"))
    return reports.reuse_embeddings(rows, known, lambda t: F.array(F.char_length(t).cast("double"))).select("doc_id", "reused", F.get("embedding", F.lit(0)).alias("first_value"))


# --- projections -----------------------------------------------------------------------------------

register("search_todos_all", "SELECT t.filename, line_number, closed, priority, due, text, title, n.created AS note_created, n.updated AS note_updated, t.updated FROM t JOIN n USING (filename)")(lambda x: search.todo_rows(search.search_todos(x)))
register("search_notes_all", "SELECT filename, title, created, updated, todo_count, link_count, (SELECT coalesce(string_agg(tag, ',' ORDER BY tag), '') FROM g WHERE g.filename = n.filename) AS tags FROM n")(lambda x: search.note_rows(search.search_notes(x)).drop("preview"))
register("body_preview", "SELECT filename, array_to_string(list_filter(string_split(body, chr(10)), lambda x: x <> '')[1:3], chr(10)) AS preview FROM b")(lambda x: x.notes.select("filename", T.preview("body").alias("preview")))
register("search_segments_all", "SELECT segment_id, filename, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(heading_level AS INTEGER) AS heading_level, breadcrumb, text FROM sg")(lambda x: search.segment_rows(x.segments))
register("format_todos", "SELECT filename, line_number, priority || ':' || due || ' {what} ' || text AS line FROM t")(
    lambda x: search.formatted(x, x.todos, "{priority}:{DUE} {what} {text}", {k: F.col(k) for k in ("priority", "due", "text")}).select("filename", "line_number", "line")
)
register("format_notes", "SELECT filename, title || ' {open ' || link_count AS line FROM n")(lambda x: search.formatted(x, x.notes, "{title} {open {links}", {"title": F.col("title"), "links": F.col("link_count"), "open {links": F.concat(F.lit("{open "), F.col("link_count").cast("string"))}).select("filename", "line"))
register("format_segments", "SELECT segment_id, breadcrumb || ' @' || start_line AS line FROM sg")(lambda x: search.formatted(x, x.segments, "{breadcrumb} @{line}", {"breadcrumb": F.col("breadcrumb"), "line": F.col("start_line")}).select("segment_id", "line"))
register("format_attr", "SELECT n.filename, coalesce(x.value, '') || ' ' || coalesce('[' || y.value || ']', '') AS line FROM n LEFT JOIN a x ON x.filename = n.filename AND x.key = 'status' LEFT JOIN a y ON y.filename = n.filename AND y.key = 'people'")(
    lambda x: search.formatted(x, x.notes, "{attr:Status} {attr:people}", {}).select("filename", "line")
)
register("default_format_todos", """SELECT filename, line_number, '"' || filename || '":' || line_number || ' ' || text AS line FROM t""")(lambda x: x.todos.select("filename", "line_number", search.default_todo_line().alias("line")))
register("default_format_notes", "SELECT filename, filename || ' [' || todo_count || ' todos, ' || link_count || ' links]' AS line FROM n")(lambda x: x.notes.select("filename", search.default_note_line().alias("line")))
register("default_format_segments", """SELECT segment_id, '"/v/' || filename || '":' || start_line || ' [' || breadcrumb || '] ' || replace(text, chr(10), ' / ') AS line FROM sg""")(
    lambda x: x.segments.select("segment_id", F.replace(search.default_segment_line(), F.concat(F.lit('"'), "filename"), F.concat(F.lit('"'), search.absolute("/v/"))).alias("line"))
)
register("show_updated", "SELECT filename, strftime(make_timestamp(updated * 1000000), '%Y-%m-%d %H:%M') AS shown FROM n")(lambda x: x.notes.select("filename", search.local_time("updated").alias("shown")))
register("list_only_files", "SELECT filename, min(line_number) AS line_number FROM t WHERE priority = 'B' GROUP BY filename")(
    lambda x: search.first_of_each_file(search.search_todos(x, priority="B"), F.asc("line_number")).select("filename", "line_number")
)

# --- filters ---------------------------------------------------------------------------------------

register("notes_by_tags", "SELECT filename FROM g WHERE tag = 'ship/R' INTERSECT SELECT filename FROM g WHERE lower(tag) = 'order/not_specified'")(lambda x: search.search_notes(x, tags=["ship/r", "Order/not specified"]).select("filename"))
register("todos_by_tags", "SELECT filename, line_number FROM t WHERE filename IN (SELECT filename FROM g WHERE tag = 'order/urgent')")(lambda x: search.search_todos(x, tags=["order/URGENT"]).select("filename", "line_number"))
register("notes_by_links", "SELECT filename FROM l WHERE link = 'Supplier_000000003'")(lambda x: search.search_notes(x, links=["supplier 000000003"]).select("filename"))
register("todos_by_links", "SELECT filename, line_number FROM t WHERE filename IN (SELECT filename FROM l WHERE link = 'Supplier_000000004')")(lambda x: search.search_todos(x, links=["Supplier_000000004"]).select("filename", "line_number"))
register("notes_by_attr", "SELECT filename FROM a WHERE key = 'company' AND value = 'BUILDING'")(lambda x: search.search_notes(x, attributes={"company": "building"}).select("filename"))
register("notes_by_list_attr", "SELECT filename FROM o WHERE cust = 'Customer_000000007'")(lambda x: search.search_notes(x, attributes={"people": "customer_000000007"}).select("filename"))
register("notes_attr_exists", "SELECT filename FROM p")(lambda x: search.search_notes(x, exists=["labels"]).select("filename"))
register("notes_updated_on", "SELECT filename FROM n WHERE updated >= CAST(epoch(TIMESTAMP '1998-06-10') AS BIGINT) AND updated < CAST(epoch(TIMESTAMP '1998-06-11') AS BIGINT)")(lambda x: search.search_notes(x, attributes={"updated": "1998-06-10"}).select("filename"))
register("notes_created_on", "SELECT filename FROM n WHERE created >= CAST(epoch(TIMESTAMP '1998-03-02') AS BIGINT) AND created < CAST(epoch(TIMESTAMP '1998-03-03') AS BIGINT)")(lambda x: search.search_notes(x, attributes={"created": "1998-03-02"}).select("filename"))
register("todos_text", "SELECT filename, line_number FROM t JOIN h USING (filename) WHERE lower(text) LIKE '%red%widget%' OR lower(header) LIKE '%red%widget%'")(lambda x: search.search_todos(x, text="RED%widget").select("filename", "line_number"))
register("notes_text", "SELECT filename FROM n JOIN h USING (filename) WHERE lower(title) LIKE '%nation_7%' OR lower(header) LIKE '%nation_7%'")(lambda x: search.search_notes(x, text="Nation_7").select("filename"))
register("notes_text_umlaut", "SELECT filename FROM c")(lambda x: search.search_notes(x, text="KOELN").select("filename"))
on_tables("body_umlaut", """SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%für%' AS lower_case, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%fÜr%' AS upper_case FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", T.like("text", "FüR").alias("lower_case"), T.like("text", "FÜR").alias("upper_case"))
)
register("notes_body", "SELECT filename FROM b WHERE lower(body) LIKE '%priority: e due: 1998%'")(lambda x: search.search_notes(x, body="Priority: E due: 1998").select("filename"))
on_tables("notes_body_documents", "SELECT filename FROM b WHERE lower(body) LIKE '%and the%' UNION ALL SELECT 'doc/' || coalesce(source, 'none') || '/' || doc_id || '.md' FROM documents WHERE lower(text) LIKE '%and the%'", True)(
    lambda s, d: search.search_notes(build_index(corpus.notes_raw(s, d, True)), body="And THE").select("filename")
)
register("notes_word", "SELECT filename FROM n JOIN h USING (filename) JOIN b USING (filename) WHERE lower(title) LIKE '%furniture%' OR lower(header) LIKE '%furniture%' OR lower(body) LIKE '%furniture%'")(
    lambda x: search.search_notes(x, predicate=search.Text("furniture")).select("filename")
)
register("web_filter", "SELECT filename FROM n JOIN h USING (filename) JOIN b USING (filename) WHERE (lower(title) LIKE '%order_12%' OR lower(header) LIKE '%order_12%') AND lower(body) LIKE '%order%12%' AND filename IN (SELECT filename FROM a WHERE key = 'type' AND value = 'meeting')")(
    lambda x: search.search_notes(x, text="order_12", attributes={"type": "meeting"}).filter(T.like("body", "order%12")).select("filename")
)
register("segments_text", "SELECT segment_id FROM sg WHERE lower(text) LIKE '%not a heading%'")(lambda x: search.search_segments(x, text="Not a heading").select("segment_id"))
register("segments_by_tags", "SELECT segment_id FROM sg WHERE filename IN (SELECT filename FROM g WHERE tag = 'supply/asia')")(lambda x: search.search_segments(x, tags=["supply/asia"]).select("segment_id"))
register("segments_by_links", "SELECT segment_id FROM sg WHERE filename IN (SELECT filename FROM l WHERE link = 'Customer_000000002')")(lambda x: search.search_segments(x, links=["Customer_000000002"]).select("segment_id"))
register("segments_by_attr", "SELECT segment_id FROM sg WHERE filename IN (SELECT filename FROM a WHERE key = 'status' AND value = 'P')")(lambda x: search.search_segments(x, attributes={"status": "p"}).select("segment_id"))
register("todos_priority", "SELECT filename, line_number FROM t WHERE priority = 'A'")(lambda x: search.search_todos(x, priority="A").select("filename", "line_number"))
register("todos_due_eq", "SELECT filename, line_number FROM t WHERE due = '19980615'")(lambda x: search.search_todos(x, due="1998-06-15").select("filename", "line_number"))
register("todos_due_le", "SELECT filename, line_number FROM t WHERE due <= '19960101'")(lambda x: search.search_todos(x, due_to="1996-01-01").select("filename", "line_number"))
register("todos_due_ge", "SELECT filename, line_number FROM t WHERE due >= '20000101'")(lambda x: search.search_todos(x, due_from="20000101").select("filename", "line_number"))
register("todos_open", "SELECT filename, line_number FROM t WHERE NOT closed")(lambda x: search.search_todos(x, closed=False).select("filename", "line_number"))
register("notes_date_preset", "SELECT filename FROM a WHERE key = 'created' AND value BETWEEN '1998-06-08' AND '1998-06-14'")(lambda x: search.search_notes(x, preset="last week", today=TODAY).select("filename"))
register("notes_created_between", "SELECT filename FROM a WHERE key = 'created' AND value BETWEEN '1997-02-01' AND '1997-03-15'")(lambda x: search.search_notes(x, created_from="1997-02-01", created_to="1997-03-15").select("filename"))
register("notes_last_28_days", "SELECT filename FROM a WHERE key = 'created' AND value BETWEEN '1998-05-18' AND '1998-06-15'")(lambda x: search.search_notes(x, preset="last_28_days", today=TODAY).select("filename"))
register("todos_combined", "SELECT filename, line_number FROM t WHERE NOT closed AND priority = 'C' AND due <= '19980615' AND filename IN (SELECT filename FROM g WHERE tag = 'order/high') AND filename IN (SELECT filename FROM a WHERE key = 'status' AND value = 'O')")(
    lambda x: search.search_todos(x, tags=["order/high"], attributes={"status": "O"}, priority="C", due_to="1998-06-15", closed=False).select("filename", "line_number")
)
_TREE = search.Or((search.And((search.Tag("order/low"), search.Attribute("status", "F"))), search.Link("Supplier_000000001"), search.And((search.Attribute("labels"), search.Text("asia")))))
_TREE_SQL = "(filename IN (SELECT filename FROM g WHERE tag = 'order/low') AND filename IN (SELECT filename FROM a WHERE key = 'status' AND value = 'F')) OR filename IN (SELECT filename FROM l WHERE link = 'Supplier_000000001')"
register("query_and_or", f"SELECT filename FROM n WHERE {_TREE_SQL} OR (filename IN (SELECT filename FROM p) AND filename IN (SELECT filename FROM b JOIN h USING (filename) WHERE lower(body) LIKE '%asia%' OR lower(header) LIKE '%asia%'))")(
    lambda x: search.search_notes(x, predicate=_TREE).select("filename")
)
register("query_and_or_todos", f"SELECT filename, line_number FROM t WHERE {_TREE_SQL}")(lambda x: search.search_todos(x, predicate=search.Or(_TREE.parts[:2])).select("filename", "line_number"))
register("query_and_or_segments", f"SELECT segment_id FROM sg WHERE ({_TREE_SQL}) OR (lower(text) LIKE '%deep%' AND filename IN (SELECT filename FROM n WHERE created >= CAST(epoch(TIMESTAMP '1998-01-04') AS BIGINT) AND created < CAST(epoch(TIMESTAMP '1998-01-05') AS BIGINT)))")(
    lambda x: search.search_segments(x, predicate=search.Or((*_TREE.parts[:2], search.And((search.Text("deep"), search.Attribute("created", "1998-01-04")))))).select("segment_id")
)


@on_tables("saved_search_matches", """ , q AS (
    SELECT 's' || s_suppkey AS query_id, 'Supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS supp, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT DISTINCT query_id, filename FROM q JOIN l ON link = supp WHERE filename IN (SELECT filename FROM g WHERE tag = 'order/urgent') AND filename IN (SELECT filename FROM a WHERE key = 'status' AND value = 'O')
    UNION SELECT query_id, filename FROM q JOIN a ON key = 'labels' AND value = nation""", True)  # fmt: skip
def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each supplier: urgent open meetings with it, or projects of its nation."""
    x = index_of(spark, sf_dir)
    base = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    term = lambda clause, kind, key, value: F.struct(F.lit(clause).alias("clause_id"), F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.alias("value"))
    terms = F.array(term(1, "link", "", F.concat(F.lit("Supplier_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))), term(1, "tag", "", F.lit("order/Urgent")), term(1, "attr", "Status", F.lit("o")), term(2, "attr", "labels", F.col("n_name")))
    searches = base.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("query_id"), F.explode(terms).alias("t")).select("query_id", "t.*")
    return search.saved_search_matches(x, searches)


register("notes_of_type", "SELECT filename FROM n WHERE kind IN ('project', 'person')")(lambda x: search.search_notes(x, types=["Project", "person"]).select("filename"))
on_tables("resolve_names", "SELECT 'order_' || o_orderkey || '.md' AS name, CAST(1 AS BIGINT) AS n_found, 'meeting/order_' || o_orderkey || '.md' AS filename FROM orders UNION ALL SELECT 'nobody.md', 0, NULL")(
    lambda s, d: search.resolve_names(corpus.notes_raw(s, d), table(s, d, "orders").select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("name")).unionByName(s.createDataFrame([("nobody.md",)], "name string")))
)
on_tables("notes_modified_since", "SELECT filename FROM (SELECT filename, k FROM o UNION ALL SELECT filename, k FROM p UNION ALL SELECT filename, k FROM c) x WHERE k % 30 >= 7", True)(lambda s, d: search.modified_since(corpus.notes_raw(s, d), TODAY, 7).select("filename"))
register("literal_backlinks", "SELECT filename FROM (SELECT DISTINCT filename FROM t WHERE supp = 'Supplier_000000005' ORDER BY filename LIMIT 100) x")(lambda x: search.literal_backlinks(x.notes, "[Supplier_000000005]"))

# --- nested attributes -----------------------------------------------------------------------------

# frontmatter of the assets as JSON; every fifth can't be read and has none
_ASSETS = """WITH k AS (SELECT p_partkey AS k, 'asset/part_' || p_partkey || '.md' AS filename, p_partkey % 5 <> 4 AS good FROM part),
    j AS (SELECT filename, k, '{"empty":{},"flag":true,"gone":null,"kind":"asset: \\"new\\"","long":"two lines\\n","meta":{"owner": "Ann_' || k % 7 || '", "size": ' || k || ', "Größe": "Koeln"},"none":[],"sub":{"deep": {"code": "K' || k || '", "list": ["x", "Y' || k % 3 || '"]}},'
        || '"tags":["a","b, c","d"],"title":"It''s part ' || k || '"}' AS header FROM k WHERE good)"""


def _assets(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(corpus.assets(spark, sf_dir))


on_tables("nested_headers", f"{_ASSETS} SELECT filename, CAST(CAST(header AS JSON) AS VARCHAR) AS header_json FROM j".replace(": ", ":").replace(", ", ",").replace('"asset:', '"asset: ').replace('"b,c"', '"b, c"'))(
    lambda s, d: _assets(s, d).headers.select("filename", F.replace(F.replace("header_json", F.lit('": '), F.lit('":')), F.lit(', "'), F.lit(',"')).alias("header_json"))
)
on_tables("nested_titles", f"{_ASSETS} SELECT filename, CASE WHEN good THEN 'It''s part ' || k ELSE replace(filename, '.md', '') END AS title FROM k")(lambda s, d: _assets(s, d).notes.select("filename", "title"))
on_tables("quoted_attributes", f"{_ASSETS} SELECT filename, 'tags' AS key, CAST(ord - 1 AS INTEGER) AS ord, ['a', 'b, c', 'd'][ord] AS value FROM j, range(1, 4) r(ord) UNION ALL SELECT filename, 'title', 0, 'It''s part ' || k FROM j UNION ALL SELECT filename, 'kind', 0, 'asset: \"new\"' FROM j")(
    lambda s, d: _assets(s, d).attributes.filter("key in ('tags', 'title', 'kind')").select("filename", "key", "ord", "value")
)
on_tables("notes_by_member", f"{_ASSETS} SELECT filename FROM j WHERE EXISTS (SELECT 1 FROM json_each(header, '$.meta') e WHERE lower(e.value ->> '$') = 'ann_3')")(
    lambda s, d: search.search_notes(_assets(s, d), attributes={"meta": "ANN_3"}).select("filename")
)
on_tables("notes_by_path", f"{_ASSETS} SELECT filename FROM j WHERE EXISTS (SELECT 1 FROM json_each(header, '$.sub.deep.list') e WHERE lower(e.value ->> '$') = 'y1') AND lower(json_extract_string(header, '$.sub.deep.code')) <> 'k1'")(
    lambda s, d: search.search_notes(_assets(s, d), attributes={"sub.deep.list": "y1"}).filter(~parse.has_attribute(F.col("header"), "sub.deep.code", "k1")).select("filename")
)
# json_each has no row for an empty list or object, and one for a scalar, null too
on_tables("attributes_that_exist", f"{_ASSETS} SELECT k.filename, key, coalesce(CASE json_type(header, '$.' || key) WHEN 'OBJECT' THEN len(json_keys(header, '$.' || key)) > 0 WHEN 'ARRAY' THEN json_array_length(header, '$.' || key) > 0 ELSE json_type(header, '$.' || key) IS NOT NULL END, false) AS there FROM k LEFT JOIN j USING (filename), (SELECT unnest(['meta', 'empty', 'none', 'gone', 'flag', 'sub.deep', 'sub.none', 'tags', 'Tags']) AS key) x")(
    lambda s, d: _assets(s, d).notes.select("filename", F.explode(F.array(*[F.struct(F.lit(key).alias("key"), F.coalesce(parse.has_attribute(F.col("header"), key), F.lit(False)).alias("there")) for key in ("meta", "empty", "none", "gone", "flag", "sub.deep", "sub.none", "tags", "Tags")])).alias("x")).select("filename", "x.*")
)

# --- letters beyond ASCII --------------------------------------------------------------------------

# tags and links of the notes with umlauts; filters lower what is stored in ASCII and the needle in any script, names are lowered in any script on both sides
_UMLAUTS = """WITH n AS (SELECT s_suppkey AS k, 'thema/KÖLN_' || s_suppkey || '.md' AS filename, 'KÖLN_' || s_suppkey AS stem FROM supplier UNION ALL SELECT s_suppkey, 'notiz/n_' || s_suppkey || '.md', 'n_' || s_suppkey FROM supplier),
    g AS (SELECT filename, unnest(['Übung', 'Übung/ÄRGER']) AS tag FROM n WHERE filename LIKE 'thema/%' UNION ALL SELECT filename, unnest(['übung', 'TEST']) FROM n WHERE filename LIKE 'notiz/%'),
    l AS (SELECT filename, 'Straße_Ä' AS link FROM n WHERE filename LIKE 'thema/%' UNION ALL SELECT filename, unnest(['köln ' || k, 'Ärger']) FROM n WHERE filename LIKE 'notiz/%')"""
_STORED = "translate(replace({}, '_', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _umlauts(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(corpus.umlauts(spark, sf_dir))


_TAG_NEEDLES, _LINK_NEEDLES = ("ÜBUNG", "Übung", "test", "übung/ärger", "Übung/ÄRGER"), ("STRASSE_Ä", "Straße_Ä", "straße ä", "ärger", "Ärger", "KÖLN_3", "köln_3")
on_tables("tags_umlaut", f"{_UMLAUTS} SELECT DISTINCT needle, filename FROM g, (SELECT unnest({list(_TAG_NEEDLES)}) AS needle) x WHERE {_STORED.format('tag')} = lower(replace(needle, '_', ' '))")(
    lambda s, d: _each_needle(_TAG_NEEDLES, lambda x: search.search_notes(_umlauts(s, d), tags=[x]).select(F.lit(x).alias("needle"), "filename"))
)
on_tables("links_umlaut", f"{_UMLAUTS} SELECT DISTINCT needle, filename FROM l, (SELECT unnest({list(_LINK_NEEDLES)}) AS needle) x WHERE {_STORED.format('link')} = lower(replace(needle, '_', ' ')) OR replace(link, '_', ' ') = replace(needle, '_', ' ')")(
    lambda s, d: _each_needle(_LINK_NEEDLES, lambda x: search.search_notes(_umlauts(s, d), links=[x]).select(F.lit(x).alias("needle"), "filename"))
)


def _each_needle(needles: tuple[str, ...], found: Callable[[str], DataFrame]) -> DataFrame:
    out = found(needles[0])
    for x in needles[1:]:
        out = out.unionByName(found(x))
    return out


_MEET = "FROM l JOIN n ON lower(replace(l.link, '_', ' ')) IN (lower(replace(n.stem, '_', ' ')), lower(replace(n.filename, '_', ' '))) WHERE l.filename <> n.filename"
on_tables("backlinks_umlaut", f"{_UMLAUTS} SELECT DISTINCT n.filename AS target, l.filename AS source {_MEET}")(lambda s, d: reports.backlinks(_umlauts(s, d)).select("target", "source"))
on_tables("graph_edges_umlaut", f"{_UMLAUTS} SELECT DISTINCT least(l.filename, n.filename) AS source, greatest(l.filename, n.filename) AS target {_MEET}")(lambda s, d: reports.graph_edges(_umlauts(s, d)))
on_tables("agenda_umlaut", f"{_UMLAUTS} SELECT DISTINCT n.stem AS group_name, l.filename, 2 AS line_number {_MEET}")(lambda s, d: reports.agenda(_umlauts(s, d), "project", TODAY).select("group_name", "filename", "line_number"))
on_tables("agenda_due_umlaut", f"{_UMLAUTS} SELECT DISTINCT n.stem AS group_name, l.filename {_MEET}")(lambda s, d: reports.agenda_by_due(_umlauts(s, d), TODAY).select("group_name", "filename"))
on_tables("agenda_note_umlaut", f"{_UMLAUTS} SELECT DISTINCT n.stem AS group_name, l.filename {_MEET} AND n.k = 3")(lambda s, d: reports.agenda_for_note(_umlauts(s, d), "notiz/n_3.md").select("group_name", "filename"))

# --- joins and reports -----------------------------------------------------------------------------

register("notes_with_todos", "SELECT n.filename, coalesce(string_agg(line_number || ':' || text, '|' ORDER BY line_number), '') AS todos FROM n LEFT JOIN t USING (filename) GROUP BY n.filename")(
    lambda x: search.notes_with_todos(x, x.notes).select("filename", F.array_join(F.transform("todos", lambda t: F.concat(t["line_number"].cast("string"), F.lit(":"), t["text"])), "|").alias("todos"))
)
register("backlinks", "SELECT target, source, updated FROM back JOIN n ON n.filename = source")(lambda x: reports.backlinks(x))


@on_tables("backlinks_fuzzy", "SELECT DISTINCT 'x' || s1.s_suppkey AS name, 'y' || s2.s_suppkey AS near FROM supplier s1 JOIN supplier s2 ON jaro_winkler_similarity('a note on supplier ' || lpad(CAST(s1.s_suppkey AS VARCHAR), 9, '0'), 'a note on supplier ' || lpad(CAST(s2.s_suppkey AS VARCHAR), 10, '0')) >= 0.98")
def backlinks_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with one digit too many against names."""
    of = lambda n: table(spark, sf_dir, "supplier").select(F.concat(F.lit("a note on supplier "), F.lpad(F.col("s_suppkey").cast("string"), n, "0")).alias("name"))
    key = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long").cast("string")
    return reports.similar_names(of(9), of(10), 0.98).select(F.concat(F.lit("x"), key("name")).alias("name"), F.concat(F.lit("y"), key("near")).alias("near"))


register("note_info", "SELECT n.filename, title, created, updated, (SELECT coalesce(string_agg(link, ',' ORDER BY link), '') FROM l WHERE l.filename = n.filename) AS links, (SELECT coalesce(string_agg(source, ',' ORDER BY source), '') FROM back WHERE target = n.filename) AS backlinks FROM n")(
    lambda x: reports.note_info(x)
)
_PAGES = "SELECT target, (r - 1) // 4 AS page, count(*) AS n, string_agg(source, ',' ORDER BY source) AS backlinks FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS r FROM (SELECT DISTINCT target, source FROM back) u) v GROUP BY 1, 2"
register("backlink_pages", _PAGES)(lambda x: reports.backlink_pages(x, 4).select("target", "page", "n", F.array_join("sources", ",").alias("backlinks")))
register("note_info_pages", f"SELECT n.filename, title, created, updated, (SELECT coalesce(string_agg(link, ',' ORDER BY link), '') FROM l WHERE l.filename = n.filename) AS links, coalesce(page, 0) AS page, coalesce(backlinks, '') AS backlinks FROM n LEFT JOIN ({_PAGES}) p ON target = n.filename")(
    lambda x: reports.note_info_pages(x, 4)
)
_VIEWED = ["project/Supplier_000000002.md", "person/Customer_000000003.md"]
register("note_view", f"SELECT n.filename, title, body, (SELECT coalesce(string_agg(source, ',' ORDER BY source), '') FROM back WHERE target = n.filename) AS backlinks FROM n JOIN b USING (filename) WHERE n.filename IN ('{_VIEWED[0]}', '{_VIEWED[1]}')")(
    lambda x: reports.note_view(x, _VIEWED)
)
register("agenda_projects", "SELECT group_name, ag.filename, line_number, text, priority, due FROM ag JOIN t USING (filename) WHERE NOT closed AND due <= '19980615'")(lambda x: reports.agenda(x, "project", TODAY))
_FIRST = "(SELECT filename, min(group_name) AS group_name FROM ag GROUP BY filename)"
register("agenda_due", f"SELECT group_name, t.filename, line_number, text, priority, due FROM t LEFT JOIN {_FIRST} f USING (filename) WHERE NOT closed AND due <= '19980615'")(lambda x: reports.agenda_by_due(x, TODAY))
register("agenda_unmatched", f"SELECT t.filename, line_number FROM t LEFT JOIN {_FIRST} f USING (filename) WHERE NOT closed AND due <= '19980615' AND group_name IS NULL")(
    lambda x: reports.agenda_unmatched(x, TODAY, "department", "project").select("filename", "line_number")
)
register("agenda_for_note", "SELECT group_name, t.filename, line_number, text, priority, due FROM ag JOIN t USING (filename) WHERE NOT closed AND group_name IN (SELECT link FROM l WHERE filename = 'meeting/order_1.md')")(
    lambda x: reports.agenda_for_note(x, "meeting/order_1.md")
)
register("agenda_sorted", "SELECT group_name, t.filename, line_number, due FROM ag JOIN t USING (filename) WHERE NOT closed AND due <= '19970101'")(lambda x: reports.agenda_order(reports.agenda(x, "project", "1997-01-01")).select("group_name", "filename", "line_number", "due"))
_LINE = "'- [ ] ' || text || ' priority:' || priority || ' due:' || due || ' ([' || regexp_extract(t.filename, '([^/]+)\\.md$', 1) || '](</v/' || t.filename || ':' || line_number || ' >))'"
register("agenda_lines", f"SELECT filename, line_number, {_LINE} AS line FROM t WHERE NOT closed")(lambda x: reports.open_todos(x).select("filename", "line_number", reports.agenda_line("/v").alias("line")))
_SUMMARY = _LINE.replace("/v/", "")
register("agenda_summary", f"SELECT group_name, t.filename, line_number, {_SUMMARY} || ' - Project: ' || group_name AS line FROM ag JOIN t USING (filename) WHERE NOT closed AND due <= '19980622'")(
    lambda x: reports.agenda_summary(reports.agenda(x, "project"), TODAY).select("group_name", "filename", "line_number", "line")
)
register("agenda_summary_count", "SELECT group_name, count(*) AS n FROM ag JOIN t USING (filename) WHERE NOT closed AND due <= '19980622' GROUP BY group_name")(
    lambda x: reports.agenda_summary(reports.agenda(x, "project"), TODAY).groupBy("group_name").agg(F.count("*").alias("n"))
)
_DUE = f"(SELECT coalesce(group_name, '') AS section, CASE WHEN group_name IS NULL THEN 4 ELSE 3 END AS part, t.*, {_SUMMARY} AS row_line FROM t LEFT JOIN {_FIRST} f USING (filename) WHERE NOT closed AND due <= '19980615')"
register("agenda_document", f"""SELECT 0 AS part, '' AS section, 0 AS ord, '# Agenda 1998-06-15' AS line UNION ALL SELECT 0, '', 1, '' UNION ALL SELECT 1, '', 0, '## Summary' UNION ALL SELECT 1, '', 1, ''
    UNION ALL SELECT 1, '', 2, CASE WHEN count(*) = 0 THEN 'No open todos found matching the criteria.' ELSE 'Found ' || count(*) || ' open todo(s) due on or before 1998-06-15.' END FROM {_DUE} d UNION ALL SELECT 1, '', 3, ''
    UNION ALL SELECT 2, '', 0, '## Projects' UNION ALL SELECT 2, '', 1, '' UNION ALL SELECT 2, '', unnest([2, 3]), unnest(['No projects with matching todos found.', '']) WHERE NOT EXISTS (SELECT 1 FROM {_DUE} d WHERE part = 3)
    UNION ALL SELECT DISTINCT 3, section, unnest([0, 1]), unnest(['### [[' || section || ']]', '']) FROM {_DUE} d WHERE part = 3
    UNION ALL SELECT DISTINCT 4, '', unnest([0, 1, 2, 3]), unnest(['## Unmatched Todos', '', 'The following todos match the due date filter but don''t link to any project:', '']) FROM {_DUE} d WHERE part = 4
    UNION ALL SELECT part, section, CAST(9 + row_number() OVER (PARTITION BY part, section ORDER BY due, priority, filename, line_number) AS INTEGER), row_line FROM {_DUE} d
    UNION ALL SELECT part, section, CAST(10 + count(*) AS INTEGER), '' FROM {_DUE} d GROUP BY part, section""")(lambda x: reports.agenda_document(reports.agenda_by_due(x, TODAY), "project", TODAY, TODAY))  # fmt: skip
register("agenda_document_empty", """SELECT * FROM (VALUES (0, '', 0, '# Agenda 1998-06-15'), (0, '', 1, ''), (1, '', 0, '## Summary'), (1, '', 1, ''), (1, '', 2, 'No open todos found matching the criteria.'), (1, '', 3, ''),
    (2, '', 0, '## Companies'), (2, '', 1, ''), (2, '', 2, 'No companies with matching todos found.'), (2, '', 3, '')) v(part, section, ord, line)""")(lambda x: reports.agenda_document(reports.agenda_by_due(x, "1890-01-01", "company"), "company", TODAY, "1890-01-01"))  # fmt: skip
register("absolute_paths", "SELECT DISTINCT filename, '/v/' || filename AS path FROM t WHERE NOT closed")(lambda x: reports.open_todos(x).select("filename", search.absolute("/v/").alias("path")).distinct())
register("backlink_lines", "SELECT target, '[' || source || '](' || source || ')' AS line FROM back")(lambda x: reports.backlinks(x).select("target", reports.backlink_line().alias("line")))

for _what, _sql in {
    "priority": "SELECT DISTINCT priority AS value FROM t", "due": "SELECT DISTINCT due AS value FROM t", "tag": "SELECT DISTINCT tag AS value FROM g", "link": "SELECT DISTINCT link AS value FROM l",
    "attr:company": "SELECT DISTINCT value FROM a WHERE key = 'company'", "attribute": "SELECT DISTINCT key AS value FROM a", "name": "SELECT DISTINCT stem AS value FROM nm",
}.items():
    register({"attribute": "attribute_names", "name": "note_names", "attr:company": "values_attr"}.get(_what, f"values_{_what}"), _sql)(lambda x, what=_what: reports.values(x, what))

# --- orders ----------------------------------------------------------------------------------------

register("todos_sorted_due", "SELECT filename, line_number, due FROM t ORDER BY due, filename, line_number")(lambda x: search.sort_todos(x, x.todos, "due").select("filename", "line_number", "due"))
register("todos_sorted_attr", "SELECT filename, line_number FROM t")(lambda x: search.sort_todos(x, x.todos, "attr:Status").select("filename", "line_number"))
register("notes_sorted_modified", "SELECT filename, updated FROM n ORDER BY updated DESC, filename")(lambda x: search.sort_notes(x, x.notes, "modified").select("filename", "updated"))
register("segments_sorted", "SELECT segment_id FROM sg")(lambda x: search.sort_segments(x, x.segments, "modified").select("segment_id"))
register("name_lookup", "SELECT stem AS name, filename, updated FROM nm WHERE lower(stem) LIKE '%order\\_1%' ESCAPE '\\' ORDER BY updated DESC, filename LIMIT 500")(lambda x: search.name_lookup(x.notes, "order_1"))

_VECTOR = [((k * 37) % 17 - 8) / 8 for k in range(64)]
_COSINE = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 9)"
on_tables("similar_topk", f"SELECT vec_id AS id, round({_COSINE.format('embedding', str(_VECTOR))}, 4) AS score FROM embeddings ORDER BY {_COSINE.format('embedding', str(_VECTOR))} DESC, vec_id LIMIT 10")(
    lambda s, d: reports.similar_to(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), _VECTOR).select("id", F.round("score", 4).alias("score"))
)
on_tables("similar_topk_tagged", f"SELECT vec_id AS id, round({_COSINE.format('embedding', str(_VECTOR))}, 4) AS score FROM embeddings WHERE label = 1 ORDER BY {_COSINE.format('embedding', str(_VECTOR))} DESC, vec_id LIMIT 10")(
    lambda s, d: reports.similar_tagged(
        table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("tag")), "l1", _VECTOR
    ).select("id", F.round("score", 4).alias("score"))
)
on_tables("similar_topk_batch", f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format('q.embedding', 'v.embedding')} DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) x WHERE rank <= 10")(
    lambda s, d: vectors.similar(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), table(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))).select("query_id", "rank", "id")
)

on_tables("similarity_lines", f"SELECT vec_id, printf('%.4f', {_COSINE.format('embedding', str(_VECTOR))}) || '  vec ' || vec_id AS line FROM embeddings WHERE embedding IS NOT NULL")(
    lambda s, d: table(s, d, "embeddings").filter("embedding is not null").select("vec_id", F.round(T.cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in _VECTOR])), 9).alias("score"), F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("line")).select("vec_id", reports.similarity_line().alias("line"))
)

# --- graph -----------------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target FROM back)"
register("graph_nodes", "SELECT filename AS id, title, kind FROM n")(reports.graph_nodes)
register("graph_edges", f"SELECT source, target FROM {_EDGES} e")(reports.graph_edges)
register("ego_network", f"""SELECT id, min(hops) AS hops FROM (
    SELECT 'person/Customer_000000001.md' AS id, 0 AS hops UNION ALL
    SELECT target, 1 FROM {_EDGES} e WHERE source = 'person/Customer_000000001.md' UNION ALL SELECT source, 1 FROM {_EDGES} e WHERE target = 'person/Customer_000000001.md' UNION ALL
    SELECT f.target, 2 FROM (SELECT source, target FROM {_EDGES} e UNION ALL SELECT target, source FROM {_EDGES} e) d JOIN (SELECT source, target FROM {_EDGES} e UNION ALL SELECT target, source FROM {_EDGES} e) f ON d.target = f.source WHERE d.source = 'person/Customer_000000001.md') x GROUP BY id""")(
    lambda x: reports.ego_network(reports.graph_edges(x), "person/Customer_000000001.md", 2)
)

# --- maintenance -----------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.notes_raw(spark, sf_dir).select("filename", "mtime")


def _key() -> F.Column:
    """The number in a generated filename."""
    return F.regexp_extract("filename", r"(\d+)\.md$", 1).cast("long")


_KEYED = "(SELECT filename, CAST(regexp_extract(filename, '(\\d+)\\.md$', 1) AS BIGINT) AS k FROM n) x"
on_tables("incremental_changed", f"SELECT filename FROM {_KEYED} WHERE k % 5 <> 1", True)(
    lambda s, d: maintenance.changed(_listing(s, d), _listing(s, d).filter(_key() % 5 < 4).withColumn("mtime", F.when(_key() % 5 == 1, F.col("mtime")).when(_key() % 5 == 2, F.lit(None)).otherwise(F.col("mtime") - F.expr("interval 1 hour"))).filter(_key() % 5 > 0)).select("filename")
)


@on_tables("upsert_notes", f"SELECT filename, CASE WHEN k % 10 = 0 THEN 'new' ELSE 'old' END AS state FROM {_KEYED} WHERE k % 10 <> 3", True)
def upsert_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table, some keys of which are replaced and some removed."""
    names = corpus.notes_raw(spark, sf_dir).select("filename")
    table = maintenance.KeyedTable(spark, scratch_path(spark, "keyed"), buckets=64)
    table.write(names.select("filename", F.lit("old").alias("state")))
    table.upsert(names.filter(_key() % 10 == 0).select("filename", F.lit("new").alias("state")), names.filter((_key() % 10).isin(0, 3)))
    return table.read()


@on_tables("refreshed_index", f"SELECT filename, tag FROM g WHERE CAST(regexp_extract(filename, '(\\d+)\\.md$', 1) AS BIGINT) % 7 > 1 UNION ALL SELECT filename, 'renewed' FROM {_KEYED} WHERE k % 7 = 0", True)
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a kept index after some of its notes were rewritten and some removed."""
    kept = maintenance.StoredIndex(spark, scratch_path(spark, "index"), buckets=64)
    raw = corpus.notes_raw(spark, sf_dir)
    kept.write(build_index(raw))
    kept.refresh(build_index(raw.filter(_key() % 7 == 0).withColumn("content", F.lit("now #renewed"))), raw.filter(_key() % 7 == 1))
    return kept.read().note_tags
def _with_texts(spark: SparkSession, sf_dir: str) -> maintenance.StoredIndex:
    kept = maintenance.StoredIndex(spark, scratch_path(spark, "index"), buckets=64, texts=True)
    kept.write(index_of(spark, sf_dir))
    return kept


on_tables("stored_notes_text", "SELECT filename FROM n JOIN h USING (filename) WHERE lower(title) LIKE '%nation_7%' OR lower(header) LIKE '%nation_7%' OR filename = 'meeting/order_1.md'", True)(
    lambda s, d: (lambda kept: search.search_notes(kept.holding("Nation_7"), text="Nation_7").select("filename").unionByName(search.search_notes(kept.holding("# Order 1 #"), body="# Order 1 #").select("filename")))(_with_texts(s, d))
)
on_tables("stored_segments_text", "SELECT segment_id FROM sg WHERE lower(text) LIKE '%not a heading%'", True)(lambda s, d: search.search_segments(_with_texts(s, d).holding("Not a heading"), text="Not a heading").select("segment_id"))
on_tables("stored_todos_text", "SELECT filename, line_number FROM t JOIN h USING (filename) WHERE lower(text) LIKE '%red%widget%' OR lower(header) LIKE '%red%widget%'", True)(
    lambda s, d: search.search_todos(_with_texts(s, d).holding("RED%widget"), text="RED%widget").select("filename", "line_number")
)
register("cleared_tags", "SELECT filename, tag FROM g WHERE CAST(regexp_extract(filename, '(\\d+)\\.md$', 1) AS BIGINT) % 4 = 0", False)(lambda x: maintenance.upsert(maintenance.clear(x.note_tags), x.note_tags.filter(_key() % 4 == 0)))
register("orphans", f"SELECT filename FROM {_KEYED} WHERE k % 7 = 0")(lambda x: maintenance.orphans(x.note_tags.select("filename").unionByName(x.notes.select("filename")), x.notes.filter(_key() % 7 != 0)))
register("pruned_tags", "SELECT filename, tag FROM g WHERE CAST(regexp_extract(filename, '(\\d+)\\.md$', 1) AS BIGINT) % 7 <> 0")(lambda x: maintenance.prune(x.note_tags, x.notes.filter(_key() % 7 != 0).select("filename")))
on_tables("refresh_summary", f"SELECT CASE WHEN k % 3 = 0 THEN 'removed' WHEN k % 11 = 1 THEN 'error' ELSE 'updated' END AS action, count(*) AS n FROM {_KEYED} WHERE k % 2 = 0 GROUP BY 1", True)(
    lambda s, d: maintenance.summary(maintenance.refresh_actions(_listing(s, d).filter(_key() % 2 == 0), _listing(s, d).filter(_key() % 3 != 0), _listing(s, d).filter((_key() % 11 == 1) & (_key() % 3 != 0))))
)
register("backfill_note_tags", "SELECT filename, tag FROM g")(lambda x: maintenance.backfill(x.notes.select("filename", F.to_json("tags").alias("tags_json")), "tags_json", "tag"))



# --- folders of files ------------------------------------------------------------------------------


@on_tables("vault_files", "SELECT filename, '---' || chr(10) || 'type: person' || chr(10) || 'company: ' || company || chr(10) || 'city: Köln' || chr(10) || '---' || chr(10) || 'Met at [[order_' || k || ']] about supplier ' || k9 || ' again.' || chr(10) AS content FROM c", True)
def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes as files, read again."""
    folder = scratch_path(spark, "vault")
    files.write_vault(corpus.persons(spark, sf_dir), folder)
    return files.read_vault(spark, folder)[0].select("filename", "content")


@on_tables("watched_folder", "SELECT filename, CASE k % 3 WHEN 0 THEN 'new ' || k ELSE 'old ' || k END AS content FROM (SELECT 'kept/' || s_suppkey || '.md' AS filename, s_suppkey AS k FROM supplier WHERE s_suppkey % 3 <> 1)")
def watched_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that follows a folder: a third of the files are written anew after a first round, a third are removed."""
    home, key = scratch_path(spark, "watched"), F.col("s_suppkey")
    folder, follow = f"{home}/vault", maintenance.KeyedTable(spark, f"{home}/table", buckets=4)
    notes = lambda how: table(spark, sf_dir, "supplier").select(key, F.concat(F.when(key % 3 == 1, "gone/").otherwise("kept/"), key.cast("string"), F.lit(".md")).alias("filename"), F.concat_ws(" ", F.lit(how), key.cast("string")).alias("content"))

    def refresh(versions: DataFrame, number: int) -> None:
        rows = versions.filter("not deleted").select("filename", "content")
        follow.upsert(rows, versions.select("filename"))

    follow.write(notes("").select("filename", "content").limit(0))
    files.write_vault(notes("old"), folder)
    streams.watch_folder(spark, folder, refresh, f"{home}/state", once=True).awaitTermination()
    files.write_vault(notes("new").filter(key % 3 == 0), folder)
    remove(spark, f"{folder}/gone")
    streams.watch_folder(spark, folder, refresh, f"{home}/state", once=True).awaitTermination()
    return follow.read().select("filename", "content")


@on_tables("json_results", "SELECT filename, line_number, text, priority FROM t", True)
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Todos as lines of JSON, read again."""
    folder = scratch_path(spark, "results")
    ingest.write_results(index_of(spark, sf_dir).todos.select("filename", "line_number", "text", "priority"), folder)
    return spark.read.schema("filename string, line_number int, text string, priority string").json(folder)


# --- rewriting -------------------------------------------------------------------------------------


def _entities(x: Index) -> DataFrame:
    return x.attributes.filter("key = 'type' and value in ('project', 'person')").select(T.stem("filename").alias("name"))


_NAMED = "FROM c JOIN p ON p.k9 = c.k9"
register("linker_counts", f"SELECT c.filename, CAST(1 AS BIGINT) AS n_links {_NAMED}")(lambda x: rewrite.link_entities(x.notes, _entities(x)).select("filename", "n_links"))
register("linker_rewrite", f"SELECT c.filename, 'Met at [[order_' || c.k || ']] about [[Supplier_' || c.k9 || ']] again.' AS body {_NAMED}")(lambda x: rewrite.link_entities(x.notes, _entities(x)).select("filename", "body"))
register("linker_totals", f"SELECT CAST(count(*) AS BIGINT) AS n_links, CAST(count(*) AS BIGINT) AS n_files {_NAMED}")(
    lambda x: rewrite.link_entities(x.notes, _entities(x)).agg(F.sum("n_links").alias("n_links"), F.count_if(F.col("n_links") > 0).alias("n_files"))
)
# every note's name: an order's heading names its note
on_tables("linker_all_names", f"SELECT filename, CAST(1 AS BIGINT) AS n_links, '# [[order_' || k || ']] #order/' || word AS first_line FROM o UNION ALL SELECT c.filename, 1, 'Met at [[order_' || c.k || ']] about [[Supplier_' || c.k9 || ']] again.' {_NAMED}", True)(
    lambda s, d: rewrite.link_entities(build_index(corpus.notes_raw(s, d)).notes, corpus.notes_raw(s, d).select(T.stem("filename").alias("name"))).select("filename", "n_links", F.substring_index("body", "\n", 1).alias("first_line"))
)


@on_tables("complete_todos", "SELECT o.filename, (SELECT count(*) FROM t WHERE t.filename = o.filename AND NOT closed AND line_number = 12) AS n_done FROM o", True)
def complete_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = corpus.meetings(spark, sf_dir)
    done = rewrite.complete_todos(raw, raw.select("filename", F.lit(12).alias("line_number")), TODAY)
    return done.select("filename", F.regexp_count("content", F.lit(r"- \[x\] [^\n]* ✅ \[\[1998-06-15\]\]")).cast("long").alias("n_done"))


on_tables("stamp_updated", "SELECT filename, CASE kind WHEN 'meeting' THEN 3 WHEN 'project' THEN 7 ELSE 5 END AS at_line FROM n", True)(
    lambda s, d: corpus.notes_raw(s, d).select("filename", F.array_position(F.split(rewrite.stamp_updated("content", "1998-06-15 10:00"), "\n"), "updated: 1998-06-15 10:00").cast("int").alias("at_line"))
)


@on_tables("journal_append", """WITH e AS (SELECT 'u/' || user_id || '.md' AS filename, user_id, ts, CASE WHEN event_type = 'error' THEN '- [ ] [' || strftime(ts, '%H:%M') || '] ' || event_type || ' due: 1998-06-15' ELSE '- [' || strftime(ts, '%H:%M') || '] ' || event_type END AS line FROM events),
    x AS (SELECT filename, user_id, line, max(ts) AS ts FROM e GROUP BY ALL)
    SELECT filename, CASE WHEN user_id % 3 = 0 THEN '# ' || filename || chr(10) || chr(10) || '## Yournal' || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY ts DESC, line DESC) || chr(10) || chr(10)
        ELSE '# ' || filename || chr(10) || '## Yournal' || chr(10) || coalesce(string_agg(line, chr(10) || chr(10) ORDER BY ts DESC, line DESC) FILTER (WHERE line <> '- [00:00] view') || chr(10) || chr(10), '') || '- [00:00] view' || chr(10) || chr(10) || '## Other' || chr(10) END AS content
    FROM x GROUP BY filename, user_id""")  # fmt: skip
def journal_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a journal, in a note with the heading or without; an entry that was made before stays single."""
    events = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("filename"), "ts", "event_type")
    notes = events.select("user_id", "filename").distinct().withColumn("content", F.concat(F.lit("# "), "filename", F.lit("\n"), F.when(F.col("user_id") % 3 == 0, "\n\n").otherwise("## Yournal\n\n- [00:00] view\n\n## Other\n")))
    entries = events.select("filename", "ts", rewrite.journal_entry(F.col("event_type"), F.col("event_type") == "error", TODAY, F.col("ts")).alias("line"))
    return rewrite.journal_append(notes, entries)


on_tables("template_fill", "SELECT doc_id, '1998-06-15 08:30 Monday, June 15, 1998 1998-06-16 1998-06-08 doc ' || doc_id AS filled FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", rewrite.fill_template(F.lit("{{date}} {{time}} {{date_human}} {{tomorrow}} {{lastweek}} {{title}}"), dt.datetime(1998, 6, 15, 8, 30), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("filled"))
)

# --- ingest ----------------------------------------------------------------------------------------

on_tables("page_titles", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", ingest.page_title("html").alias("title"))
)


def _now() -> F.Column:
    """When the corpus is converted."""
    return F.lit("2024-01-31 08:05:00").cast("timestamp")


# the page's title as in page_titles; a url's last path part, or unnamed
_TITLE = "trim(regexp_replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_WEB_NAME = "translate(coalesce(nullif(trim(regexp_extract(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)), ''), 'unnamed'), ' ', '_')"
on_tables("page_to_note", f"""SELECT page_id, 'web/2024/Jan/web-2024-01-31-' || {_WEB_NAME} || '.md' AS filename,
    '---' || chr(10) || 'created: 2024-01-31 08:05' || chr(10) || 'type: web' || chr(10) || 'source: "' || replace(coalesce(url, ''), '"', '\\"') || '"' || chr(10)
    || 'title: "' || replace({_TITLE}, '"', '\\"') || '"' || chr(10) || '---' || chr(10) || chr(10) || chr(10) AS head FROM pages""")(
    lambda s, d: ingest.pages_to_notes(table(s, d, "pages"), _now()).select("page_id", "filename", F.regexp_extract("content", r"(?s)^(---\n.*?\n---\n\n\n)", 1).alias("head"))
)
on_tables("page_bodies")(lambda s, d: ingest.pages_to_notes(table(s, d, "pages"), _now()).select("page_id", "content"))
on_tables("text_to_note", """WITH r AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)) AS w, coalesce(text, '') AS t FROM documents),
    k AS (SELECT doc_id, CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN list_slice(w, 1, len(w) - 1) ELSE w END AS w FROM r)
    SELECT doc_id, coalesce(w[1], '') AS title, array_to_string(list_transform(w, lambda x: CASE WHEN x = '' THEN chr(10) ELSE x || chr(10) || chr(10) END), '') AS body FROM k""")(lambda s, d: ingest.texts_to_notes(table(s, d, "documents")))  # fmt: skip


@on_tables("thread_to_note", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, strftime(make_timestamp((1700000000 + 60 * CAST(turn AS BIGINT)) * 1000000), '%Y-%m-%d %H:%M UTC') AS moment FROM conversations)
    SELECT conv_id AS thread, count(*) FILTER (WHERE k > 0) AS n_comments,
        '# Conversation ' || conv_id || chr(10) || chr(10) || coalesce(max('**Author:** u/' || role || '  ' || chr(10)) FILTER (WHERE k = 0), '') || '**Subreddit:** r/talk  ' || chr(10) || '**Score:** ' || conv_id % 7 || '  ' || chr(10) || max('**Posted:** ' || moment || '  ' || chr(10)) FILTER (WHERE k = 0) || chr(10)
        || coalesce(max('## Original Post' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10)) FILTER (WHERE k = 0 AND text NOT IN ('', '[deleted]')), '') || '**Link:** [https://example.com/](https://example.com/)' || chr(10) || chr(10) || '## Comments' || chr(10) || chr(10)
        || CASE WHEN count(*) = 1 THEN '*No comments found.*' || chr(10) || chr(10) ELSE '' END
        || coalesce(string_agg('### Comment ' || k || ' (by u/' || coalesce(role, '[deleted]') || ')' || chr(10) || chr(10) || '*Score: ' || turn || ' | Posted: ' || moment || '*' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY k) FILTER (WHERE k > 0 AND text NOT IN ('', '[deleted]', '[removed]')), '') AS content
    FROM c GROUP BY conv_id""")  # fmt: skip
def thread_to_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested threads, through JSON: each turn is a reply to the one before."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    when = lambda t: t["turn"].cast("long") * 60 + 1700000000
    data = lambda t: F.to_json(F.struct(t["role"].alias("author"), t["text"].alias("body"), t["turn"].alias("score"), when(t).alias("created_utc")))
    listing = lambda inner: F.concat(F.lit('{"data":{"children":['), inner, F.lit("]}}"))
    reply = lambda acc, t: F.concat(F.lit('{"kind":"t1","data":'), F.regexp_replace(data(t), r"\}$", ""), F.lit(',"replies":'), F.when(acc == "", '""').otherwise(listing(acc)), F.lit("}}"))
    nested = F.aggregate(F.reverse(F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1)))), F.lit(""), reply)
    first = F.get("t", F.lit(0))
    post = F.to_json(F.struct(
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), first["role"].alias("author"), F.lit("talk").alias("subreddit"), (F.col("conv_id") % 7).alias("score"), when(first).alias("created_utc"),
        first["text"].alias("selftext"), F.lit("https://example.com/").alias("url"), F.lit("/r/talk").alias("permalink"),
    ))
    threads = turns.select(F.col("conv_id").alias("thread"), F.concat(F.lit("["), listing(F.concat(F.lit('{"kind":"t3","data":'), post, F.lit("}"))), F.lit(","), listing(nested), F.lit("]")).alias("json"))
    return ingest.threads_to_notes(threads)


on_tables("mail_to_note", """SELECT 'in/m' || doc_id || '.eml' AS path, '---' || chr(10) || 'created: 2024-01-30 10:00' || chr(10) || 'type: mail' || chr(10) || 'source: "in/m' || doc_id || '.eml"' || chr(10) || 'title: "Document ' || doc_id || '"' || chr(10)
    || 'from: "Ann Example"' || chr(10) || 'to:' || chr(10) || '  - "[[bob_k]]"' || chr(10) || '  - "Cy"' || chr(10) || 'mail_date: "2024-01-30T10:00:00Z"' || chr(10) || '---' || chr(10) || chr(10) || chr(10) || '# Document ' || doc_id || chr(10) || chr(10)
    || '**From:** Ann Example' || chr(10) || chr(10) || '**To:** [[bob_k]], Cy' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '**Cc:** [[dee_l]]' || chr(10) || chr(10) ELSE '' END
    || '**Date:** 2024-01-30T10:00:00Z' || chr(10) || chr(10) || '**Message-ID:** m' || doc_id || '@example.com' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS content FROM documents""")(
    lambda s, d: ingest.mails_to_notes(corpus.mails(s, d), _now()).select("path", "content")
)
on_tables("word_to_note", """SELECT 'in/d' || doc_id || '.docx' AS path, 'Document ' || doc_id AS title, array_to_string(list_concat(['# Document ' || doc_id, '## About ' || doc_id],
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')), chr(10) || chr(10)) AS body FROM documents""")(lambda s, d: ingest.docx_to_notes(corpus.word_files(s, d)))
on_tables("frontmatter_render", """SELECT doc_id, '---' || chr(10) || 'created: 2024-01-31 08:05' || chr(10) || 'type: mail' || chr(10) || 'source: "' || coalesce(source, '') || '"' || chr(10)
    || coalesce('title: "say \\"' || lang || '\\""' || chr(10), '') || 'from: "' || doc_id || '"' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'to:' || chr(10) || '  - "[[a]]"' || chr(10) || '  - "b"' || chr(10) ELSE '' END
    || 'mail_date: "2024-01-30T10:00:00Z"' || chr(10) || '---' || chr(10) || chr(10) AS front FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", ingest.note_front(
        F.date_format(_now(), "yyyy-MM-dd HH:mm"), F.lit("mail"), F.col("source"), F.concat(F.lit('say "'), "lang", F.lit('"')), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("[[a]]"), F.lit("b"))).otherwise(F.array().cast("array<string>")), F.lit("2024-01-30T10:00:00Z"),
    ).alias("front"))
)
on_tables("route_note_path", f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'web/2024/Jan/web-2024-01-31-' || {_WEB_NAME} || '.md' WHEN 1 THEN 'documents/2024/Jan/document-2024-01-31-My_file_' || page_id || '.tar.md'
    WHEN 2 THEN 'mail/2023/Dec/mail-2023-12-0' || (1 + page_id % 9) || '-in' || page_id || '.md' ELSE 'notes/issue-2024-01-31-unnamed.md' END AS path FROM pages""")(
    lambda s, d: table(s, d, "pages").withColumn("kind", F.get(F.array(*map(F.lit, ("web", "document", "mail", "issue"))), (F.col("page_id") % 4).cast("int"))).select("page_id", ingest.note_path(
        F.col("kind"), F.when(F.col("kind") == "web", F.coalesce("url", F.lit(""))).when(F.col("kind") == "document", F.concat(F.lit("a dir/My file "), F.col("page_id").cast("string"), F.lit(".tar.gz"))).otherwise(F.concat(F.lit("/m/in"), F.col("page_id").cast("string"), F.lit(".eml"))),
        _now(), F.date_add(F.lit("2023-12-01").cast("date"), (F.col("page_id") % 9).cast("int")),
    ).alias("path"))
)
on_tables("email_person_link", "SELECT c_custkey, '[[' || replace(lower(c_mktsegment), '.', '_') || '_' || c_custkey || ']]' AS link FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", ingest.person_link(F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.com"))).alias("link"))
)
_ROUTED = "CASE page_id % 9 WHEN 0 THEN 'https://www.reddit.com/r/' || page_id WHEN 1 THEN 'https://github.com/a/' || page_id WHEN 2 THEN 'mail/x' || page_id || '.EML' WHEN 3 THEN 'files/x.docx' WHEN 4 THEN 'https://redd.it/' || page_id WHEN 5 THEN 'https://www.github.com/a' WHEN 6 THEN 'HTTPS://example.com/' || page_id WHEN 7 THEN 'x.msg' ELSE coalesce(url, '') END"
on_tables("route_sources", f"""SELECT page_id, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' THEN CASE WHEN contains(u, 'reddit.com') OR contains(u, 'redd.it') THEN 'reddit' WHEN starts_with(u, 'https://github.com/') OR starts_with(u, 'http://github.com/') THEN 'github' ELSE 'url' END
    WHEN lower(u) LIKE '%.eml' THEN 'eml' WHEN lower(u) LIKE '%.msg' THEN 'msg' ELSE 'document' END AS route FROM (SELECT page_id, {_ROUTED} AS u FROM pages) x""")(
    lambda s, d: table(s, d, "pages").select("page_id", ingest.route_source(F.expr(_ROUTED)).alias("route"))
)
on_tables("github_raw_url", "SELECT page_id, 'https://raw.githubusercontent.com/own/r' || page_id || CASE page_id % 4 WHEN 0 THEN '/main/docs/a.md' WHEN 1 THEN '/main/docs/README.md' WHEN 2 THEN '/dev/src/README.md' ELSE '/HEAD/README.md' END AS raw FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", ingest.github_raw_url(F.concat(F.lit("https://github.com/own/r"), F.col("page_id").cast("string"), F.get(F.array(*map(F.lit, ("/blob/main/docs/a.md", "/blob/main/docs", "/tree/dev/src/", ""))), (F.col("page_id") % 4).cast("int")))).alias("raw"))
)
on_tables("issue_comment_header", """SELECT event_id, '### [[anna u' || user_id || ']]' || CASE event_id % 4
    WHEN 0 THEN ' writes on [[' || strftime(ts, '%Y-%m-%d') || ']] at ' || strftime(ts, '%H:%M:%S') || '+0000' WHEN 1 THEN ' writes on [[' || strftime(ts, '%Y-%m-%d') || ']] at ' || strftime(ts, '%H:%M:%S') || 'Z'
    WHEN 2 THEN ' writes on [[' || strftime(ts, '%Y-%m-%d') || ']] at ' || strftime(ts, '%H:%M') ELSE ' (' || strftime(ts, '%Y-%m-%d %H:%M') || ')' END AS header FROM events""")(
    lambda s, d: table(s, d, "events").select("event_id", ingest.comment_header(F.concat(F.lit("Anna U"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.123+0000'"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.9Z'")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))).alias("header"))
)


def _styled() -> F.Column:
    """A document's text as a mail body, with what mail programs leave in it."""
    return F.concat(F.lit("Calibri 11\n  color: red\nfont-face\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" **\r\n")), F.lit("\n@page x\n\\_done\\* \\\\ {} <b> *x* \\q** \n\n"))


on_tables("mail_body_clean", r"""WITH i AS (SELECT doc_id, 'Calibri 11' || chr(10) || '  color: red' || chr(10) || 'font-face' || chr(10) || replace(coalesce(text, ''), chr(10), ' **' || chr(13) || chr(10)) || chr(10) || '@page x' || chr(10) || '\_done\* \\ {} <b> *x* \q** ' || chr(10) AS t FROM documents),
    k AS (SELECT doc_id, list_filter(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '^[\s\p{Z}]*(Times New Roman|Arial|Calibri|font-family:|font-size:|font-style:|font-weight:|color:|background-color:|mso-|@)')) AS w FROM i)
    SELECT doc_id, array_to_string(list_transform(list_slice(w, 1, len(w) - 1), lambda x: regexp_replace(regexp_replace(replace(regexp_replace(x, '\\([*_\[\](){}#+\-.!|])', '\1', 'g'), '\\', '\'), '[\s\p{Z}]+$', ''), '[*]+$', '')), chr(10)) AS cleaned FROM k""".replace("\\", "\\"))(
    lambda s, d: table(s, d, "documents").select("doc_id", ingest.clean_mail_body(_styled()).alias("cleaned"))
)


@on_tables("issues_to_notes", """SELECT 'jira/ISS-' || o_orderkey || '.md' AS filename, '---' || chr(10) || 'key: "ISS-' || o_orderkey || '"' || chr(10) || 'type: jira' || chr(10) || 'status: "' || o_orderstatus || '"' || chr(10)
    || 'issuetype: "Order"' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'assignee: "A \\B"' || chr(10) ELSE '' END || 'jira_created: "' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000+0000"' || chr(10)
    || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'labels:' || chr(10) || '  - "' || o_orderpriority || '"' || chr(10) || '  - "x"' || chr(10) END || '---' || chr(10) || chr(10)
    || '# ISS-' || o_orderkey || ' - Order of ' || o_custkey || chr(10) || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '## Description' || chr(10) || chr(10) || 'Text of ' || o_orderkey || chr(10) || chr(10) END
    || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '## Comments' || chr(10) || chr(10) || '### [[clerk ' || o_custkey || ']] writes on [[' || strftime(o_orderdate, '%Y-%m-%d') || ']] at 09:29:05+0000' || chr(10) || chr(10) || 'done' || chr(10) || chr(10)
    || '### [[unknown]] (later)' || chr(10) || chr(10) || 'again' || chr(10) || chr(10) END AS content FROM orders""")  # fmt: skip
def issues_to_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issue records, through JSON."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    name = lambda c, field="name": F.struct(c.alias(field))
    comment = lambda author, when, body: F.struct(author.alias("author"), when.alias("created"), F.lit(body).alias("body"))
    clerk = comment(name(F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")), "displayName"), F.concat(day, F.lit("T09:29:05.000+0000")), "done")
    nobody = comment(F.lit(None).cast("struct<displayName:string>"), F.lit("later"), "again")
    record = F.to_json(F.struct(
        F.concat(F.lit("ISS-"), key.cast("string")).alias("key"),
        F.struct(
            F.concat(F.lit("Order of "), F.col("o_custkey").cast("string")).alias("summary"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Text of "), key.cast("string"))).alias("description"),
            name(F.col("o_orderstatus")).alias("status"), name(F.lit("Order")).alias("issuetype"), F.when(key % 2 == 0, name(F.lit("A \\B"), "displayName")).alias("assignee"), F.concat(day, F.lit("T00:00:00.000+0000")).alias("created"),
            F.when(key % 3 != 0, F.array("o_orderpriority", F.lit("x"))).alias("labels"), F.when(key % 7 != 0, F.struct(F.array(clerk, nobody).alias("comments"))).alias("comment"),
        ).alias("fields"),
    ))
    return ingest.issues_to_notes(o.select(F.from_json(record, ingest.ISSUE).alias("i")).select("i.*"))


@on_tables("reconvert_status", "SELECT CASE doc_id % 6 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' WHEN 2 THEN CASE WHEN text IS NULL THEN 'failed' ELSE 'unchanged' END WHEN 5 THEN 'skipped' ELSE 'reconverted' END AS status, CASE doc_id % 6 WHEN 3 THEN 'new' WHEN 4 THEN 'beside' ELSE coalesce(text, '') END AS body, count(*) AS n FROM documents GROUP BY ALL")
def reconvert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a source, with one that failed, is unchanged, is new, lies beside the note too, or is nowhere."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 6)
    key = F.col("doc_id").cast("string")
    source, beside = F.concat(F.lit("files/"), key, F.lit(".docx")), F.concat(F.lit("notes/"), key, F.lit(".docx"))
    notes = docs.select(F.concat(F.lit("notes/"), key, F.lit(".md")).alias("filename"), F.lit("type: document").alias("front"), F.col("text").alias("body"), F.when(F.col("k") > 0, source).alias("source"))
    fresh = docs.filter("k in (1, 2, 3, 4)").select(source.alias("source"), F.when(F.col("k") == 2, F.col("text")).when(F.col("k") > 2, "new").alias("new_body"))
    fresh = fresh.unionByName(docs.filter("k = 4").select(beside.alias("source"), F.lit("beside").alias("new_body")))
    done = ingest.reconvert(notes, fresh)
    return done.groupBy("status", F.regexp_replace("content", r"^---\ntype: document\n---\n", "").alias("body")).agg(F.count("*").alias("n"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as three browsers' visits, in each browser's own time."""
    e = table(spark, sf_dir, "events").withColumn("unix", F.unix_seconds("ts")).withColumn("url_id", F.concat_ws("/", F.lit("u"), F.col("user_id").cast("string"), "event_type"))
    urls = e.select("url_id", F.col("url_id").alias("url"), F.when(F.col("event_type") == "view", "").otherwise(F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string"))).alias("title")).distinct()
    raw = {"safari": F.col("unix") - 978307200, "vivaldi": (F.col("unix") + 11644473600) * 1000000, "firefox": F.col("unix") * 1000000}
    return ingest.union_visits({b: (e.filter(F.col("event_id") % 3 == k).select("url_id", raw[b].alias("raw_time")), urls) for k, b in enumerate(raw)})


on_tables("visits_union", "SELECT url, title, vts AS ts, browser FROM v", True)(_visits)
on_tables("browser_epoch", "SELECT browser, min(vts) AS first_ts, max(vts) AS last_ts FROM v GROUP BY browser", True)(lambda s, d: _visits(s, d).groupBy("browser").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
on_tables("latest_visit", "SELECT url, max(vts) AS ts FROM v GROUP BY url", True)(lambda s, d: ingest.latest_visits(_visits(s, d)).select("url", "ts"))
on_tables("history_high_water", "SELECT browser, max(vts) AS high_water FROM v GROUP BY browser", True)(lambda s, d: ingest.high_water(_visits(s, d)))
on_tables("history_counts", "SELECT browser, count(*) AS n FROM v GROUP BY browser", True)(lambda s, d: _visits(s, d).groupBy("browser").agg(F.count("*").alias("n")))
on_tables("history_incremental", "SELECT url, vts AS ts, browser FROM v WHERE (browser = 'safari' AND vts > 1705320000) OR (browser <> 'safari' AND vts > 1706000000)", True)(
    lambda s, d: ingest.since_marks(_visits(s, d), s.createDataFrame([("safari", 1705320000)], "browser string, high_water long"), 1706000000).select("url", "ts", "browser")
)
on_tables("history_note", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_lines,
    max('- [' || coalesce(nullif(title, ''), url) || '](' || url || ') [' || browser || ' - ' || strftime(make_timestamp(vts * 1000000), '%H:%M') || '] [[' || strftime(make_timestamp(vts * 1000000), '%Y-%m-%d') || ']]') AS last_line FROM v GROUP BY 1""", True)(
    lambda s, d: ingest.history_lines(_visits(s, d)).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_lines"), F.max("line").alias("last_line"))
)
on_tables("history_notes", """, w AS (SELECT url, strftime(ts, '%Y-%m-%d') AS day, max({'ts': vts, 'browser': browser, 'title': title}) AS m FROM v GROUP BY ALL),
    e AS (SELECT day, url, m.ts AS vts, upper(m.browser[1]) || m.browser[2:] AS browser, '- [' || coalesce(nullif(m.title, ''), url) || '](' || url || ') [' || upper(m.browser[1]) || m.browser[2:] || ' - ' || strftime(make_timestamp(m.ts * 1000000), '%H:%M') || '] [[' || day || ']]' || chr(10) AS line FROM w)
    SELECT day, 'web/' || strftime(CAST(day AS DATE), '%Y/%b') || '/browser-' || day || '-00:00.md' AS filename,
        '---' || chr(10) || 'title: "Browser History"' || chr(10) || 'date: ' || day || chr(10) || 'type: note' || chr(10) || 'tags: [browser-history, daily]' || chr(10) || '---' || chr(10) || chr(10) || '# Browser History' || chr(10) || chr(10) || 'Created on [[' || day || ']]' || chr(10) || chr(10)
        || '## Summary' || chr(10) || chr(10) || 'Total unique URLs visited: ' || count(*) || chr(10) || chr(10) || CASE WHEN count(*) FILTER (WHERE browser = 'Safari') > 0 THEN '- Safari: ' || count(*) FILTER (WHERE browser = 'Safari') || ' URLs' || chr(10) ELSE '' END
        || CASE WHEN count(*) FILTER (WHERE browser = 'Vivaldi') > 0 THEN '- Vivaldi: ' || count(*) FILTER (WHERE browser = 'Vivaldi') || ' URLs' || chr(10) ELSE '' END || CASE WHEN count(*) FILTER (WHERE browser = 'Firefox') > 0 THEN '- Firefox: ' || count(*) FILTER (WHERE browser = 'Firefox') || ' URLs' || chr(10) ELSE '' END
        || chr(10) || '## History Entries' || chr(10) || chr(10) || string_agg(line, '' ORDER BY vts DESC, line DESC) AS content FROM e GROUP BY day""", True)(
    lambda s, d: ingest.history_notes(_visits(s, d)).withColumn("day", F.col("day").cast("string"))
)

# --- streams ---------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the table is a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@on_tables("stream_latest_note", "SELECT 'u/' || user_id || '.md' AS filename, max(event_id) AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) x WHERE r = 1 AND event_type <> 'error' GROUP BY 1")
def stream_latest_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as versions of a note; an error removes it."""
    versions = _event_stream(spark, sf_dir).select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("filename"), F.col("event_id").cast("string").alias("content"), F.col("ts").alias("mtime"), (F.col("event_type") == "error").alias("deleted"))
    last = versions.groupBy("filename").agg(F.max_by(F.struct("content", "deleted"), "mtime").alias("v")).select("filename", "v.content", "v.deleted")
    done = streams.run_once(last, scratch_path(spark, "latest"), "update")
    return streams.latest_of_updates(done, "filename").filter("not deleted").select("filename", F.col("content").cast("long").alias("version"))


@on_tables("stream_newest_version", "SELECT 'u/' || user_id || '.md' AS filename, event_id AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'error' DESC, sha256(CAST(event_id AS VARCHAR)) DESC) AS r FROM events) x WHERE r = 1 AND event_type <> 'error'")
def stream_newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as versions of a note in any order, by state that keeps older ones out; an error removes the note."""
    versions = _event_stream(spark, sf_dir).select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("filename"), F.col("event_id").cast("string").alias("content"), F.col("ts").alias("mtime"), (F.col("event_type") == "error").alias("deleted"))
    done = streams.run_once(streams.newest_versions(versions), scratch_path(spark, "newest"), "update")
    return streams.latest_of_updates(done, "filename").filter("not deleted").select("filename", F.col("content").cast("long").alias("version"))


@on_tables("history_windows", "SELECT strftime(time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, browser, count(*) AS n_visits FROM v GROUP BY 1, 2", True)
def history_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _event_stream(spark, sf_dir).select("ts", F.get(F.array(*map(F.lit, ("safari", "vivaldi", "firefox"))), (F.col("event_id") % 3).cast("int")).alias("browser"))
    done = streams.run_once(streams.visit_counts(visits), scratch_path(spark, "windows"), "update")
    return streams.latest_of_updates(done.withColumn("key", F.concat_ws("|", F.date_format("window_start", "yyyy-MM-dd HH:mm"), "browser")), "key").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "browser", "n_visits")


# --- flagship --------------------------------------------------------------------------------------


@register("open_priority_todos", "SELECT filename, line_number, text, due FROM t WHERE NOT closed AND priority = 'A' ORDER BY due, filename, line_number")
def open_priority_todos(x: Index) -> DataFrame:
    return search.sort_todos(x, search.search_todos(x, priority="A", closed=False), "due").select("filename", "line_number", "text", "due")
