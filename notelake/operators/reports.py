"""Reports: distinct values, backlinks, agendas, the link graph, similarity and note views."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python import jaro_winkler, similar_keys
from ..scratch import discard, stash
from . import parse
from .parse import Index

# --- values ----------------------------------------------------------------------------------------


def values(index: Index, what: str) -> DataFrame:
    """Distinct ``priority``, ``due``, ``tag``, ``link``, ``attribute`` names, note ``name`` or values of ``attr:<key>``."""
    if what in ("priority", "due"):
        return index.todos.select(F.col(what).alias("value")).filter("value is not null").distinct()
    if what == "tag":
        return index.note_tags.select(F.col("tag").alias("value")).distinct()
    if what == "link":
        return index.note_links.select(F.col("link").alias("value")).distinct()
    if what == "attribute":
        return index.attributes.select(F.col("key").alias("value")).distinct()
    if what == "name":
        return index.notes.select(T.stem("filename").alias("value")).distinct()
    if what.startswith("attr:"):
        return index.attributes.filter((F.lower("key") == what[5:].lower()) & F.col("value").isNotNull() & (~F.col("is_array") | (F.col("vtype") == "string"))).select("value").distinct()
    raise ValueError(what)


# --- backlinks -------------------------------------------------------------------------------------


def _targets(notes: DataFrame) -> DataFrame:
    """``name, target``: the compared forms under which a note is linked."""
    return notes.select(F.col("filename").alias("target"), F.explode(F.array_distinct(F.array(T.name_norm("filename"), T.name_norm(T.stem("filename"))))).alias("name"))


def _named_links(index: Index) -> DataFrame:
    """``filename, updated, name``: the compared forms of each note's links, from one pass over the notes."""
    names = F.array_distinct(F.transform("links", T.name_norm))
    return index.notes.select("filename", "updated", F.explode_outer(names).alias("name")).filter("name is not null")


def backlinks(index: Index, threshold: float | None = None) -> DataFrame:
    """``target, source, updated``: notes that link to each note by name or path; with a threshold, by similar names too."""
    links = _named_links(index).withColumnRenamed("filename", "source")
    names = _targets(index.notes)
    pairs = links.join(names, "name").filter("target <> source").select("target", "source", "updated").distinct()
    if threshold is not None:
        near = similar_names(links.select("name").distinct(), names.select("name").distinct(), threshold)
        fuzzy = links.join(near, "name").join(names.withColumnRenamed("name", "near"), "near").filter("target <> source").select("target", "source", "updated")
        pairs = pairs.unionByName(fuzzy).distinct()
    return pairs


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``name, near``: different names with a Jaro-Winkler similarity of at least ``threshold`` (over 0.9); names meet on keys.

    Keys are made for the lengths that the other names have. There are many for a name, so they are never broadcast; what
    meets is compared where it meets, and only similar names are shuffled again.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (stash(x.select("name").filter("name is not null").distinct(), "names") for x in (left, right))
    lengths = lambda x: frozenset(r[0] for r in x.select(F.char_length("name")).distinct().collect())  # noqa: E731  a row for each length
    keyed = lambda x, others: x.repartition(tasks, "name").select("name", F.explode(similar_keys(threshold, others)("name")).alias("key")).repartition(tasks, "key")
    mine, theirs = keyed(left, lengths(right)), keyed(right, lengths(left)).withColumnRenamed("name", "near")
    pairs = mine.hint("merge").join(theirs, "key").filter("name <> near").select("name", "near")
    return pairs.filter(jaro_winkler("name", "near") >= threshold).distinct()


def note_info(index: Index) -> DataFrame:
    """Each note with its links and the notes that link to it."""
    back = backlinks(index).groupBy(F.col("target").alias("filename")).agg(F.array_sort(F.collect_list("source")).alias("backlinks"))
    return index.notes.join(back, "filename", "left").select("filename", "title", "created", "updated", F.array_join(F.array_sort("links"), ",").alias("links"), F.coalesce(F.array_join("backlinks", ","), F.lit("")).alias("backlinks"))


def note_view(index: Index, filenames: list[str]) -> DataFrame:
    """Title, body and backlinks of some notes."""
    some = index.notes.filter(F.col("filename").isin(filenames)).select("filename", "title", "body")
    back = backlinks(index).filter(F.col("target").isin(filenames)).groupBy(F.col("target").alias("filename")).agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("backlinks"))
    return some.join(back, "filename", "left").withColumn("backlinks", F.coalesce("backlinks", F.lit("")))


def backlink_pages(index: Index, size: int = 1000) -> DataFrame:
    """``target, page, n, sources``: the notes that link to each note, in order, in pages (from 0) of ``size`` and a last one of the rest.

    Links are placed by ranges of target and source, so those of a note that most others link to are spread over many
    tasks, and no row or group holds more than a page. Only the first target of a range can have begun before it: the
    places of these, one for each range, are all that is broadcast.
    """
    return paged(backlinks(index).select("target", "source"), size)


def paged(pairs: DataFrame, size: int) -> DataFrame:
    """``target, page, n, sources`` of distinct ``target, source`` pairs; see ``backlink_pages``."""
    ranges = stash(pairs.repartitionByRange("target", "source").select("target", "source", F.spark_partition_id().alias("part")), "pairs")
    counts = ranges.groupBy("part", "target").agg(F.count("*").alias("n"))
    # of each range its first target, and what earlier ranges hold of it
    first = ranges.groupBy("part").agg(F.min("target").alias("target"))
    before = counts.join(F.broadcast(first.select(F.col("part").alias("later"), "target")), "target").filter("part < later").groupBy(F.col("later").alias("part"), "target").agg(F.sum("n").alias("before"))
    within = Window.partitionBy("part", "target").orderBy("source")
    place = F.row_number().over(within) - 1 + F.coalesce("before", F.lit(0))
    placed = ranges.join(F.broadcast(before), ["part", "target"], "left").withColumn("page", F.floor(place / size).cast("long"))
    return placed.groupBy("target", "page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source")).alias("sources"))


def note_info_pages(index: Index, size: int = 1000) -> DataFrame:
    """``note_info`` with a row for each page of backlinks, and one for a note without any."""
    # names, links and the rest are wanted in three places: the notes are parsed once, into a narrow table
    kept = replace(index, notes=stash(index.notes.select("filename", "title", "created", "updated", "links"), "linked"))
    pages = backlink_pages(kept, size).select(F.col("target").alias("filename"), "page", F.array_join("sources", ",").alias("backlinks"))
    notes = kept.notes.select("filename", "title", "created", "updated", F.array_join(F.array_sort("links"), ",").alias("links"))
    return notes.join(pages, "filename", "left").withColumns({"page": F.coalesce("page", F.lit(0).cast("long")), "backlinks": F.coalesce("backlinks", F.lit(""))})


def backlink_line() -> Column:
    return F.format_string("[%s](%s)", "source", "source")


# --- agenda ----------------------------------------------------------------------------------------


def agenda_notes(index: Index) -> DataFrame:
    """What agendas need of each note, written once: ``filename, stem, names`` (its links), ``kinds`` (its types) and ``lines``, its todos.

    An agenda asks for links, types and todos. From this table it has them all by one pass over the notes.
    """
    kinds = F.transform(F.flatten(F.transform(F.filter("merged", lambda g: g["key"] == "type"), lambda g: g["items"])), lambda x: F.lower(x["value"]))
    todo_lines = F.filter(F.transform(F.split("body", "\n"), lambda line, n: F.when(line.startswith("- ["), F.struct(n.alias("n"), F.regexp_replace(line, r"\r\z", "").alias("line")))), lambda x: x["line"].rlike(T.TODO))
    rows = index.parsed.select("filename", T.stem("filename").alias("stem"), F.array_distinct(F.transform("links", T.name_norm)).alias("names"), kinds.alias("kinds"), "front_lines", todo_lines.alias("lines"))
    return stash(rows, "agenda")


def _groups(kept: DataFrame, kind: str) -> DataFrame:
    """``group_file, group_name`` of notes of a type."""
    return kept.filter(F.array_contains("kinds", kind.lower())).select(F.col("filename").alias("group_file"), F.col("stem").alias("group_name"))


def _links_to(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``filename, group_file, group_name``: notes that link to a group's note, without that note itself."""
    names = groups.select("group_file", "group_name", F.explode(F.array_distinct(F.array(T.name_norm("group_file"), T.name_norm("group_name")))).alias("name"))
    links = kept.select("filename", F.explode("names").alias("name"))
    return links.join(names, "name").filter("filename <> group_file").select("filename", "group_file", "group_name").distinct()


def open_todos(index: Index, closed: bool = False) -> DataFrame:
    return index.todos.filter(F.col("closed") == closed)


def _kept_todos(kept: DataFrame, closed: bool = False) -> DataFrame:
    lines = kept.select("filename", "front_lines", F.explode("lines").alias("x")).select("filename", "front_lines", F.col("x.n").alias("n"), F.col("x.line").alias("line"))
    rows = lines.withColumns({"note_created": F.lit(None).cast("long"), "note_updated": F.lit(None).cast("long")})
    return parse.todo_fields(rows).filter(F.col("closed") == closed).select("filename", "line_number", "text", "priority", "due")


def agenda(index: Index, kind: str = "project", due_to: str | None = None, closed: bool = False) -> DataFrame:
    """Todos of the notes that link to each note of a type; with a date, those due by then."""
    kept = agenda_notes(index)
    todos = _kept_todos(kept, closed)
    if due_to:
        todos = todos.filter(F.col("due") <= due_to.replace("-", ""))
    return _links_to(kept, _groups(kept, kind)).join(todos, "filename").select("group_name", "filename", "line_number", "text", "priority", "due")


def agenda_by_due(index: Index, due_to: str, kind: str = "project", kept: DataFrame | None = None) -> DataFrame:
    """Open todos due by a date, or without one, each under the first project its note links to; ``group_name`` is null without any."""
    kept = agenda_notes(index) if kept is None else kept
    todos = _kept_todos(kept).filter(F.col("due").isNull() | (F.col("due") <= due_to.replace("-", "")))
    first = _links_to(kept, _groups(kept, kind)).groupBy("filename").agg(F.min(F.struct("group_file", "group_name")).alias("g")).select("filename", F.col("g.group_name").alias("group_name"))
    return todos.join(first, "filename", "left").select("group_name", "filename", "line_number", "text", "priority", "due")


def agenda_unmatched(index: Index, due_to: str, kind: str, other: str) -> DataFrame:
    """``agenda_by_due``'s todos of no group of a type, whose notes link to none of another type either."""
    kept = agenda_notes(index)
    return agenda_by_due(index, due_to, kind, kept).filter("group_name is null").join(_links_to(kept, _groups(kept, other)), "filename", "left_anti")


def agenda_for_note(index: Index, filename: str, kind: str = "project") -> DataFrame:
    """The agenda of one note: of itself if it is of the type, else of those of the type that it links to."""
    kept = agenda_notes(index)
    groups = _groups(kept, kind)
    own = groups.filter(F.col("group_file") == filename)
    names = kept.filter(F.col("filename") == filename).select(F.explode("names").alias("name")).distinct()
    linked = groups.withColumn("name", T.name_norm("group_name")).join(names, "name", "left_semi").drop("name")
    best = linked if own.isEmpty() else own
    return _links_to(kept, best).join(_kept_todos(kept), "filename").select("group_name", "filename", "line_number", "text", "priority", "due")


def agenda_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("group_name", F.asc_nulls_last("due"), F.asc_nulls_last("priority"), "filename", "line_number")


def agenda_line(root: str = "") -> Column:
    """``- [ ] text priority:P due:D ([stem](<path:line >))``; parts without a value are left out."""
    path = F.concat(F.lit(root + "/" if root else ""), F.col("filename"))
    return F.concat(
        F.lit("- [ ] "), F.col("text"), F.coalesce(F.concat(F.lit(" priority:"), F.col("priority")), F.lit("")), F.coalesce(F.concat(F.lit(" due:"), F.col("due")), F.lit("")),
        F.lit(" (["), T.stem("filename"), F.lit("](<"), path, F.lit(":"), F.col("line_number").cast("string"), F.lit(" >))"),
    )


def agenda_summary(rows: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Todos due by ``days`` from today, overdue ones too."""
    until = (dt.date.fromisoformat(today) + dt.timedelta(days=days)).strftime("%Y%m%d")
    return rows.filter(F.col("due") <= until).withColumn("line", F.concat(agenda_line(), F.lit(" - Project: "), F.col("group_name")))


# Headings and sentences of the agenda: fixed values.
HEADINGS = {"department": "Departments", "person": "Persons", "company": "Companies"}
NOTHING = "No open todos found matching the criteria."
UNMATCHED = "The following todos match the due date filter but don't link to any project:"


def agenda_document(rows: DataFrame, kind: str, today: str, due_to: str, root: str = "", with_summary: bool = True) -> DataFrame:
    """``part, section, ord, line``: the agenda's lines in order of part, section and ord: header, summary, groups, and todos of no group.

    ``rows`` are those of ``agenda_by_due``. Parts: 0 header, 1 summary, 2 heading of the groups, 3 groups, 4 todos of no group.
    """
    title = HEADINGS.get(kind, "Projects")
    order = [F.asc_nulls_last("due"), F.asc_nulls_last("priority"), F.asc("filename"), F.asc("line_number")]
    grouped = rows.select("*", F.when(F.col("group_name").isNull(), 4).otherwise(3).alias("part"), F.coalesce("group_name", F.lit("")).alias("section"))
    # todos are placed by ranges, so those of one group, or of none, are spread over tasks; written once for all that is asked below
    placed = stash(grouped.repartitionByRange("part", "section", *order).withColumn("__range", F.spark_partition_id()), "agenda-rows")
    counts = placed.groupBy("__range", "part", "section").agg(F.count("*").alias("n"))
    first = placed.groupBy("__range").agg(F.min(F.struct("part", "section")).alias("g")).select(F.col("__range").alias("later"), "g.part", "g.section")
    before = counts.join(F.broadcast(first), ["part", "section"]).filter("__range < later").groupBy(F.col("later").alias("__range"), "part", "section").agg(F.sum("n").alias("before"))
    within = F.row_number().over(Window.partitionBy("__range", "part", "section").orderBy(*order))
    todos = placed.join(F.broadcast(before), ["__range", "part", "section"], "left").select("part", "section", (within + F.coalesce("before", F.lit(0)) + 9).cast("int").alias("ord"), agenda_line(root).alias("line"))
    # a row for each group: its heading before its todos, and a blank line behind them
    sized = placed.groupBy("part", "section").agg(F.count("*").cast("int").alias("n"))
    heading = F.when(F.col("part") == 4, F.array(F.lit("## Unmatched Todos"), F.lit(""), F.lit(UNMATCHED), F.lit(""))).otherwise(F.array(F.concat(F.lit("### [["), "section", F.lit("]]")), F.lit("")))
    around = sized.select("part", "section", F.explode(F.concat(F.transform(heading, lambda x, n: F.struct(n.alias("ord"), x.alias("line"))), F.array(F.struct((F.col("n") + 10).alias("ord"), F.lit("").alias("line"))))).alias("x")).select("part", "section", "x.ord", "x.line")
    # one row, also of no todos
    counts = placed.agg(F.count("*").alias("n"), F.count_if(F.col("part") == 3).alias("grouped"))
    found = F.when(F.col("n") == 0, NOTHING).otherwise(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f" open todo(s) due on or before {due_to}.")))
    line = lambda part, n, text: F.struct(F.lit(part).alias("part"), F.lit("").alias("section"), F.lit(n).alias("ord"), (text if isinstance(text, Column) else F.lit(text)).alias("line"))
    top = [line(0, 0, f"# Agenda {today}"), line(0, 1, "")]
    top += [line(1, 0, "## Summary"), line(1, 1, ""), line(1, 2, found), line(1, 3, "")] if with_summary else []
    top += [line(2, 0, f"## {title}"), line(2, 1, ""), line(2, 2, F.when(F.col("grouped") == 0, f"No {title.lower()} with matching todos found.")), line(2, 3, F.when(F.col("grouped") == 0, ""))]
    head = counts.select(F.explode(F.array(*top)).alias("x")).select("x.*").filter("line is not null")
    return head.unionByName(around).unionByName(todos)


# --- graph -----------------------------------------------------------------------------------------


def graph_nodes(index: Index) -> DataFrame:
    single = F.filter("merged", lambda g: (g["key"] == "type") & ~g["is_array"])
    item = F.get(F.get(single, F.lit(0))["items"], F.lit(0))
    return index.notes.select(F.col("filename").alias("id"), F.coalesce("title", "filename").alias("title"), F.when(item["vtype"] == "string", item["value"]).alias("kind"))


def graph_edges(index: Index) -> DataFrame:
    """Undirected edges between notes; of notes with the same name, the first path gets the links."""
    names = _targets(index.notes).groupBy("name").agg(F.min("target").alias("target"))
    links = _named_links(index).withColumnRenamed("filename", "source")
    return links.join(names, "name").filter("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def ego_network(edges: DataFrame, start: str, hops: int = 1) -> DataFrame:
    """``id, hops``: a note and what lies within some hops. Each hop is a written table of what is new, so plans don't grow; ends where nothing is."""
    both = stash(edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))), "edges")
    known = stash(edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int"), "hops")
    frontier, old = known, []
    for k in range(1, hops + 1):
        reached = both.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = stash(reached.join(known.select("id"), "id", "left_anti").select("id", F.lit(k).alias("hops")), "frontier")
        if frontier.isEmpty():
            discard(frontier)
            break
        old.append(known)
        known = stash(known.unionByName(frontier), "hops")
        old.append(frontier)
    discard(both, *[t for t in old if t is not frontier])
    return known


# --- similarity ------------------------------------------------------------------------------------


def similar_to(vectors: DataFrame, vector: list[float], k: int = 10) -> DataFrame:
    """The ``k`` vectors nearest to one, without a shuffle of the others."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return vectors.filter("embedding is not null").select("id", T.cosine(F.col("embedding"), q).alias("score")).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(k)


def similar_tagged(vectors: DataFrame, tags: DataFrame, tag: str, vector: list[float], k: int = 10) -> DataFrame:
    """``similar_to`` among the vectors with a tag (``tags``: ``id, tag``)."""
    return similar_to(vectors.join(tags.filter(F.col("tag") == tag).select("id").distinct(), "id", "left_semi"), vector, k)


def similarity_line() -> Column:
    return F.format_string("%.4f  %s", "score", "line")


def reuse_embeddings(segments: DataFrame, previous: DataFrame, embed) -> DataFrame:
    """``segments`` with ``embedding`` and ``reused``: kept for text that is known in that file, else from ``embed(text)``; null if that fails.

    Texts meet by a 128-bit hash of their content, so no text is shuffled as a key.
    """
    mark = F.md5("text").alias("__text")
    known = previous.filter("embedding is not null").groupBy("filename", mark).agg(F.first("embedding").alias("embedding"))
    joined = segments.withColumn("__text", F.md5("text")).join(known, ["filename", "__text"], "left").drop("__text")
    old = joined.filter("embedding is not null").withColumn("reused", F.lit(True))
    new = joined.filter("embedding is null").withColumn("embedding", embed(F.col("text"))).withColumn("reused", F.lit(False))
    return old.unionByName(new)
