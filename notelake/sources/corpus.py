"""Notes generated from the relational tables, so that every fact in a note is known from a table.

Families: ``meeting/order_<k>.md`` for each order, with a todo for each of its line items;
``project/Supplier_<k>.md`` for each supplier; ``person/Customer_<k>.md`` for each customer; and
``doc/<source>/<doc_id>.md`` for each document, whose text is the note.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that reports take as today.
TODAY = "1998-06-15"
#: Modification time of files whose note says nothing about it: this day and the key's remainder in days.
MTIME_DAY, MTIME_SPREAD = "1998-06-01", 30


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table whose few bytes a row give long notes: dealt by key to as many tasks as a shuffle has, as its file alone would be one task."""
    return _table(spark, sf_dir, name).select(key, *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def _key(column: str) -> F.Column:
    return F.lpad(F.col(column).cast("string"), 9, "0")


def _mtime(key: str) -> F.Column:
    return F.date_add(F.to_date(F.lit(MTIME_DAY)), (F.col(key) % MTIME_SPREAD).cast("int")).cast("timestamp")


def _note(key: str, filename: F.Column, *parts) -> list[F.Column]:
    content = F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    return [filename.alias("filename"), content.alias("content"), _mtime(key).alias("mtime")]


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    day = lambda d: (F.col(d) if isinstance(d, str) else d).cast("date").cast("string")
    due = F.when(F.col("l_linenumber") % 2 == 1, day("l_shipdate")).otherwise(F.replace(day("l_shipdate"), F.lit("-"), F.lit("")))
    todo = F.concat(
        F.lit("- ["), F.when(F.col("l_linestatus") == "F", "x").otherwise(" "), F.lit("] ship "), F.col("p_name"), F.lit(" [[Supplier_"), _key("l_suppkey"),
        F.lit("]] priority: "), F.substring(F.lit("ABCDE"), (F.col("l_linenumber") % 5 + 1).cast("int"), F.lit(1)), F.lit(" due: "), due, F.lit(" #ship/"), F.col("l_returnflag"), F.lit("\n"),
    )
    items = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", todo.alias("todo"))
    listed = items.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "todo")))["todo"], "").alias("todos"))
    key, who, on = F.col("o_orderkey").cast("string"), F.concat(F.lit("[[Customer_"), _key("o_custkey"), F.lit("]]")), day("o_orderdate")
    word = F.lower(F.replace(F.substring("o_orderpriority", 3, 30), F.lit(" "), F.lit("_")))
    return orders.join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        *_note(
            "o_orderkey", F.concat(F.lit("meeting/order_"), key, F.lit(".md")),
            "---\ncreated: ", on, "\nupdated: ", day(F.date_add("o_orderdate", 7)), " 10:30\ntype: meeting\nstatus: ", F.col("o_orderstatus"), "\npeople:\n  - \"", who, "\"\n---\n",
            "# Order ", key, " #order/", word, "\nPlaced on ", on, ".\n## Items\n", F.coalesce("todos", F.lit("")), "## Participants\n- ", who, "\n",
        )
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = _key("s_suppkey")
    word = F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))
    return _spread(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        *_note(
            "s_suppkey", F.concat(F.lit("project/Supplier_"), key, F.lit(".md")),
            "---\ntitle: Supplier ", key, "\ntype: project\nlabels: [", F.col("n_name"), "]\ntags: [supply]\ncreated: ", F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (F.col("s_suppkey") % 200).cast("int")), "yyyy-MM-dd"), "\n---\n",
            "# Overview #supply/", word, "\nKey ", F.col("s_suppkey").cast("string"), ".\n## Notes\nSee [[Customer_", key, "]] and [site](https://example.com/s/", F.col("s_suppkey").cast("string"), ")\n",
            "### Detail\nplain detail\n##### Deep\n```text\n# not a heading\n```\n```tasks\nnot done\n```\n",
        )
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(
        *_note(
            "c_custkey", F.concat(F.lit("person/Customer_"), _key("c_custkey"), F.lit(".md")),
            "---\ntype: person\ncompany: ", F.col("c_mktsegment"), "\ncity: Köln\n---\n",
            "Met at [[order_", F.col("c_custkey").cast("string"), "]] about supplier ", F.lpad((F.col("c_custkey") % 10).cast("string"), 9, "0"), " again.\n",
        )
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each part, with nested and quoted frontmatter; every fifth one's can't be read."""
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    owner, which = (k % 7).cast("string"), (k % 3).cast("string")
    good = F.concat(
        F.lit("---\ntitle: 'It''s part "), key, F.lit("'\nkind: \"asset: \\\"new\\\"\"\nmeta: {owner: Ann_"), owner, F.lit(", size: "), key, F.lit(", Größe: Köln}\nsub:\n  deep:\n    code: K"), key,
        F.lit("\n    list: [x, Y"), which, F.lit("]\nempty: {}\nnone: []\ntags: [a, \"b, c\", 'd']\nflag: true\nlong: >\n  two\n  lines\ngone:\n---\n# Part "), key, F.lit("\n"),
    )
    bad = F.concat(F.lit("---\ntitle: \"unterminated\nkind: asset\n---\n# Part "), key, F.lit("\n"))
    return _spread(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("asset/part_"), key, F.lit(".md")).alias("filename"), F.when(k % 5 == 4, bad).otherwise(good).alias("content"), _mtime("p_partkey").alias("mtime"))


def umlauts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notes for each supplier, whose names, tags and links have umlauts in both cases."""
    key = F.col("s_suppkey").cast("string")
    topic = F.concat(F.lit("---\ntype: project\n---\n# Thema #Übung/ÄRGER\n[[Straße_Ä]]\n"))
    note = F.concat(F.lit("see [[köln "), key, F.lit("]] and [[Ärger]] #übung #TEST\n- [ ] tun due: 19980601\n"))
    base = _spread(spark, sf_dir, "supplier", "s_suppkey")
    one = base.select(F.concat(F.lit("thema/KÖLN_"), key, F.lit(".md")).alias("filename"), topic.alias("content"), _mtime("s_suppkey").alias("mtime"))
    return one.unionByName(base.select(F.concat(F.lit("notiz/n_"), key, F.lit(".md")).alias("filename"), note.alias("content"), _mtime("s_suppkey").alias("mtime")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("doc"), F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("filename"), F.col("text").alias("content"), _mtime("doc_id").alias("mtime"))


def notes_raw(spark: SparkSession, sf_dir: str, with_documents: bool = False) -> DataFrame:
    """``filename, content, mtime`` of the generated notes."""
    out = meetings(spark, sf_dir).unionByName(projects(spark, sf_dir)).unionByName(persons(spark, sf_dir))
    return out.unionByName(documents(spark, sf_dir)) if with_documents else out


# --- documents in other forms ----------------------------------------------------------------------


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: each document as a message; every second one has a copy's receiver."""
    key = F.col("doc_id").cast("string")
    content = F.concat(
        F.lit("From: Ann Example <ann@example.com>\nTo: bob.k@example.com, Cy <cy@example.com>\n"), F.when(F.col("doc_id") % 2 == 0, "Cc: dee.l@example.com\n").otherwise(""), F.lit("Subject: Document "), key,
        F.lit("\nDate: Tue, 30 Jan 2024 10:00:00 +0000\nMessage-ID: <m"), key, F.lit("@example.com>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.coalesce("text", F.lit("")),
    )
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("in/m"), key, F.lit(".eml")).alias("path"), F.encode(content, "UTF-8").alias("content"))


def _word_file(paragraphs: list[tuple[str, str]]) -> bytes:
    """A Word file of ``(style, text)``."""
    style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ""
    text = "".join(f'<w:p>{style(s)}<w:r><w:t xml:space="preserve">{escape(t, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{text}</w:body></w:document>')
    return out.getvalue()


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: each document as a Word file, with a title, a heading and a paragraph for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_word_file([("Title", f"Document {i}"), ("Heading2", f"About {i}"), *(("", line) for line in t.split("\n"))]) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"in/d{i}.docx" for i in batch.column("doc_id").to_pylist()], pa.string()), "content": pa.array(made, pa.binary())})

    # XML can't have other control characters
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "path string, content binary")
