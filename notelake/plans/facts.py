"""What the generated notes say, as SQL over the tables they were made from (for DuckDB)."""

#: Notes, todos, tags, links, attributes, headers and segments of the corpus, straight from the tables.
FACTS = """
o AS (
    SELECT o_orderkey AS k, 'meeting/order_' || o_orderkey || '.md' AS filename, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status,
           'Customer_' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS cust, lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS word,
           strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') || ' 10:30' AS upd, CAST(epoch(o_orderdate) AS BIGINT) AS created, CAST(epoch(o_orderdate) AS BIGINT) + 642600 AS updated
    FROM orders),
t0 AS (
    SELECT l_orderkey AS k, l_linenumber AS ln, l_linestatus = 'F' AS closed, substr('ABCDE', l_linenumber % 5 + 1, 1) AS priority, strftime(l_shipdate, '%Y%m%d') AS due,
           CASE WHEN l_linenumber % 2 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') END AS dashed, l_returnflag AS flag, 'Supplier_' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS supp,
           CAST(epoch(l_shipdate) AS BIGINT) AS ts, p_name
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
t1 AS (SELECT *, 'ship ' || p_name || ' [[' || supp || ']] priority: ' || priority || ' due: ' || coalesce(dashed, due) || ' #ship/' || flag AS text FROM t0),
t AS (
    SELECT 'meeting/order_' || k || '.md' AS filename, CAST(11 + row_number() OVER (PARTITION BY k ORDER BY ln, CASE WHEN closed THEN '- [x] ' ELSE '- [ ] ' END || text) AS INTEGER) AS line_number,
           closed, priority, due, text, flag, supp, dashed, ts AS updated, '- [' || CASE WHEN closed THEN 'x' ELSE ' ' END || '] ' || text AS line FROM t1),
p AS (
    SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS k9, 'project/Supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.md' AS filename, n_name AS nation,
           lower(replace(r_name, ' ', '_')) AS word, strftime(DATE '1998-01-01' + CAST(s_suppkey % 200 AS INTEGER), '%Y-%m-%d') AS day,
           CAST(epoch(CAST(DATE '1998-01-01' + CAST(s_suppkey % 200 AS INTEGER) AS TIMESTAMP)) AS BIGINT) AS created, CAST(epoch(TIMESTAMP '1998-06-01') AS BIGINT) + 86400 * (s_suppkey % 30) AS updated
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c AS (
    SELECT c_custkey AS k, 'person/Customer_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.md' AS filename, c_mktsegment AS company,
           CAST(epoch(TIMESTAMP '1998-06-01') AS BIGINT) + 86400 * (c_custkey % 30) AS updated, lpad(CAST(c_custkey % 10 AS VARCHAR), 9, '0') AS k9
    FROM customer),
n0 AS (SELECT filename, count(*) AS n FROM t GROUP BY filename),
g AS (
    SELECT filename, 'order' AS tag FROM o UNION SELECT filename, 'order/' || word FROM o UNION SELECT filename, 'ship' FROM t UNION SELECT filename, 'ship/' || flag FROM t
    UNION SELECT filename, 'supply' FROM p UNION SELECT filename, 'supply/' || word FROM p),
l AS (
    SELECT filename, cust AS link FROM o UNION SELECT filename, day FROM o UNION SELECT filename, supp FROM t UNION SELECT filename, dashed FROM t WHERE dashed IS NOT NULL
    UNION SELECT filename, 'https://example.com/s/' || k FROM p UNION SELECT filename, 'Customer_' || k9 FROM p UNION SELECT filename, day FROM p UNION SELECT filename, lower(nation) FROM p
    UNION SELECT filename, 'order_' || k FROM c),
nl AS (SELECT filename, count(*) AS n FROM l GROUP BY filename),
b AS (
    SELECT o.filename, '# Order ' || k || ' #order/' || word || chr(10) || 'Placed on ' || day || '.' || chr(10) || '## Items' || chr(10)
           || coalesce((SELECT string_agg(line || chr(10), '' ORDER BY line_number) FROM t WHERE t.filename = o.filename), '') || '## Participants' || chr(10) || '- [[' || cust || ']]' AS body FROM o
    UNION ALL
    SELECT filename, '# Overview #supply/' || word || chr(10) || 'Key ' || k || '.' || chr(10) || '## Notes' || chr(10) || 'See [[Customer_' || k9 || ']] and [site](https://example.com/s/' || k || ')' || chr(10)
           || '### Detail' || chr(10) || 'plain detail' || chr(10) || '##### Deep' || chr(10) || '```text' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) FROM p
    UNION ALL SELECT filename, 'Met at [[order_' || k || ']] about supplier ' || k9 || ' again.' FROM c),
n AS (
    SELECT o.filename, regexp_replace(o.filename, '\\.md$', '') AS title, created, updated, CAST(coalesce(n0.n, 0) AS INTEGER) AS todo_count, CAST(nl.n AS INTEGER) AS link_count, 'meeting' AS kind
    FROM o LEFT JOIN n0 USING (filename) JOIN nl USING (filename)
    UNION ALL SELECT p.filename, 'Supplier ' || k9, created, updated, 0, CAST(nl.n AS INTEGER), 'project' FROM p JOIN nl USING (filename)
    UNION ALL SELECT c.filename, regexp_replace(c.filename, '\\.md$', ''), updated, updated, 0, CAST(nl.n AS INTEGER), 'person' FROM c JOIN nl USING (filename)),
nm AS (SELECT *, regexp_extract(filename, '([^/]+)\\.md$', 1) AS stem FROM n),
a AS (
    SELECT filename, 'created' AS key, day AS value, false AS is_array FROM o UNION ALL SELECT filename, 'updated', upd, false FROM o UNION ALL SELECT filename, 'type', 'meeting', false FROM o
    UNION ALL SELECT filename, 'status', status, false FROM o UNION ALL SELECT filename, 'people', cust, true FROM o
    UNION ALL SELECT filename, 'title', 'Supplier ' || k9, false FROM p UNION ALL SELECT filename, 'type', 'project', false FROM p UNION ALL SELECT filename, 'labels', nation, true FROM p
    UNION ALL SELECT filename, 'tags', 'supply', true FROM p UNION ALL SELECT filename, 'created', day, false FROM p
    UNION ALL SELECT filename, 'type', 'person', false FROM c UNION ALL SELECT filename, 'company', company, false FROM c UNION ALL SELECT filename, 'city', 'Koeln', false FROM c),
h AS (
    SELECT filename, '{"created":"' || day || '","people":["' || cust || '"],"status":"' || status || '","type":"meeting","updated":"' || upd || '"}' AS header FROM o
    UNION ALL SELECT filename, '{"created":"' || day || '","labels":["' || nation || '"],"tags":["supply"],"title":"Supplier ' || k9 || '","type":"project"}' FROM p
    UNION ALL SELECT filename, '{"city":"Koeln","company":"' || company || '","type":"person"}' FROM c),
s AS (
    SELECT o.filename, 9 AS start_line, 10 AS end_line, 1 AS heading_level, o.filename AS breadcrumb, '# Order ' || k || ' #order/' || word || chr(10) || 'Placed on ' || day || '.' AS text FROM o
    UNION ALL SELECT o.filename, 11, 11 + coalesce(n0.n, 0), 2, o.filename || ' > Order ' || k || ' #order/' || word,
           '## Items' || coalesce((SELECT string_agg(chr(10) || line, '' ORDER BY line_number) FROM t WHERE t.filename = o.filename), '') FROM o LEFT JOIN n0 USING (filename)
    UNION ALL SELECT o.filename, 12 + coalesce(n0.n, 0), 13 + coalesce(n0.n, 0), 2, o.filename || ' > Order ' || k || ' #order/' || word, '## Participants' || chr(10) || '- [[' || cust || ']]' FROM o LEFT JOIN n0 USING (filename)
    UNION ALL SELECT filename, 8, 9, 1, filename, '# Overview #supply/' || word || chr(10) || 'Key ' || k || '.' FROM p
    UNION ALL SELECT filename, 10, 11, 2, filename || ' > Overview #supply/' || word, '## Notes' || chr(10) || 'See [[Customer_' || k9 || ']] and [site](https://example.com/s/' || k || ')' FROM p
    UNION ALL SELECT filename, 12, 17, 3, filename || ' > Overview #supply/' || word || ' > Notes',
           '### Detail' || chr(10) || 'plain detail' || chr(10) || '##### Deep' || chr(10) || '```text' || chr(10) || '# not a heading' || chr(10) || '```' FROM p
    UNION ALL SELECT filename, 6, 6, NULL, filename, 'Met at [[order_' || k || ']] about supplier ' || k9 || ' again.' FROM c),
sg AS (SELECT filename || '#' || start_line AS segment_id, * FROM s),
names AS (SELECT filename AS target, lower(replace(stem, '_', ' ')) AS name FROM nm UNION SELECT filename, lower(replace(filename, '_', ' ')) FROM nm),
back AS (SELECT DISTINCT names.target, l.filename AS source FROM l JOIN names ON lower(replace(l.link, '_', ' ')) = names.name WHERE names.target <> l.filename),
ag AS (SELECT nm.stem AS group_name, nm.filename AS group_file, back.source AS filename FROM nm JOIN back ON back.target = nm.filename WHERE nm.kind = 'project'),
v AS (
    SELECT 'u/' || user_id || '/' || event_type AS url, CASE WHEN event_type = 'view' THEN '' ELSE event_type || ' of ' || user_id END AS title, CAST(floor(epoch(ts)) AS BIGINT) AS vts,
           CASE event_id % 3 WHEN 0 THEN 'safari' WHEN 1 THEN 'vivaldi' ELSE 'firefox' END AS browser, ts, event_id
    FROM events)
"""


def with_facts(select: str) -> str:
    return f"WITH {FACTS} {select}"
