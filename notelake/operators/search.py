"""Filters, boolean trees, projections and orders over the tables of an index.

A row of notes, todos or segments has its note's tags, links and header, so every condition is a Column and a tree of
them too: a search is one scan without a join, and what is asked for alone is computed.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import stash
from .parse import Index, build_index, has_attribute, text_attribute

# --- predicates ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    word: str


@dataclass(frozen=True)
class Link:
    target: str


@dataclass(frozen=True)
class Tag:
    tag: str


@dataclass(frozen=True)
class Attribute:
    key: str
    value: str | None = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Predicate = Text | Link | Tag | Attribute | And | Or


def _day(value: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(value)
    except ValueError:
        return None


def _epoch(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days * 86400


def on_day(column: str, value: str) -> Column:
    """Epoch seconds within a day (UTC); a text that is no date matches nothing."""
    day = _day(value)
    return F.lit(False) if day is None else (F.col(column) >= _epoch(day)) & (F.col(column) < _epoch(day) + 86400)


def _has(array: str, test) -> Column:
    return F.exists(array, test)


def _tagged(entity: str, tag: str) -> Column:
    """Tags are those of the whole note; a segment has its own, those of the headings above and the note's, which has all of these."""
    return _has("tags" if entity == "notes" else "note_tags", lambda x: T.same_tag(x, tag))


def _linked(entity: str, target: str) -> Column:
    if entity == "notes":
        return _has("links", lambda x: T.same_link(x, target))
    return _has("links", lambda x: T.same_link(x, target)) | _has("note_links", lambda x: T.same_link(x, target))


def _header(entity: str) -> Column:
    return F.col("header" if entity == "notes" else "note_header")


def _attribute(entity: str, key: str, value: str | None) -> Column:
    if key in ("created", "updated") and value is not None:
        if entity == "todos" and key == "updated":
            return on_day("note_updated", value)
        return on_day({"notes": key, "todos": "note_made", "segments": "note_made" if key == "created" else "note_changed"}[entity], value)
    return has_attribute(_header(entity), key, value)


def _says(entity: str, word: str) -> Column:
    """A note's, todo's or segment's own text or, but for segments, the attributes of its note."""
    if entity == "segments":
        return T.like("text", word)
    own = T.like("text", word) if entity == "todos" else T.like("title", word) | T.like("body", word)
    return own | in_header(entity, word)


def in_header(entity: str, word: str) -> Column:
    return F.coalesce(T.like("header_json" if entity == "notes" else "note_header_json", word), F.lit(False))


def condition(entity: str, predicate: Predicate) -> Column:
    """A predicate tree on rows of ``notes``, ``todos`` or ``segments``."""
    if isinstance(predicate, And | Or):
        parts = [condition(entity, p) for p in predicate.parts]
        return reduce(lambda a, b: a & b if isinstance(predicate, And) else a | b, parts) if parts else F.lit(isinstance(predicate, And))
    if isinstance(predicate, Tag):
        return _tagged(entity, predicate.tag)
    if isinstance(predicate, Link):
        return _linked(entity, predicate.target)
    if isinstance(predicate, Attribute):
        return _attribute(entity, predicate.key, predicate.value)
    if isinstance(predicate, Text):
        return _says(entity, predicate.word)
    raise TypeError(predicate)


def where(entity: str, rows: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows of ``notes``, ``todos`` or ``segments`` that a predicate tree accepts."""
    return rows.filter(condition(entity, predicate))


# --- what a note's text must hold -------------------------------------------------------------------


def _holds(content: Column, words: Sequence[str]) -> Column:
    """Each word (ASCII) is somewhere in a text, in any case; blanks stand for underscores too."""
    lower = F.lower(content)
    return reduce(lambda a, b: a & b, [(T.spaced(lower) if " " in w else lower).contains(w) for w in words])


def hint(entity: str, predicate: Predicate, content: Column, mapping: dict[str, str]) -> Column | None:
    """What a note's raw text must hold for a predicate tree to accept the note or a row of it; None if nothing can be told.

    Tags, and links without brackets, are parts of the text as it stands, but for dates and labels of frontmatter. Keys
    are so too, unless brackets are left out within them or they are escaped.
    """
    if isinstance(predicate, And | Or):
        parts = [hint(entity, p, content, mapping) for p in predicate.parts]
        told = [p for p in parts if p is not None]
        if isinstance(predicate, And):
            return reduce(lambda a, b: a & b, told) if told else None
        return reduce(lambda a, b: a | b, told) if told and len(told) == len(parts) else None
    altered = content.contains("\\") | content.rlike(r"[\w-][\[\]]+[\w-]")
    if isinstance(predicate, Tag):
        return _holds(content, [T.norm_text(predicate.tag)]) if predicate.tag.isascii() else None
    if isinstance(predicate, Link):
        word = T.norm_text(predicate.target)
        if not word.isascii() or set("[]") & set(word) or re.fullmatch(r"(?s).{4}-.{2}-.{2}", word):
            return None
        return _holds(content, [word]) | content.contains("labels") | altered
    if isinstance(predicate, Attribute):
        key = predicate.key.split(".")[0].partition("[")[0]
        if not re.fullmatch(r"[A-Za-z0-9_-]+", key) or predicate.key in ("created", "updated"):
            return None
        names = [key] + [old for old, new in mapping.items() if new == key]
        return reduce(lambda a, b: a | b, [F.lower(content).contains(n.lower()) for n in names]) | altered if all(re.fullmatch(r"[A-Za-z0-9_-]+", n) for n in names) else None
    if isinstance(predicate, Text) and entity == "segments" and predicate.word.isascii() and not set("_\\") & set(predicate.word):
        return reduce(lambda a, b: a & b, [F.lower(content).contains(w.lower()) for w in predicate.word.split("%")])
    return None


def cut_apart(content: Column) -> Column:
    """Whether something is cut from a text before its tags and links are read: query blocks, or the first of two line end characters."""
    return content.contains("\r") | (content.contains("```") & reduce(lambda a, b: a | b, [content.contains(mark) for mark in T.QUERY_BLOCKS]))


def narrowed(entity: str, index: Index, predicates: Sequence[Predicate]) -> Index:
    """An index of the notes whose raw texts hold what the predicates need, so that only these are parsed; a search on it finds the same rows.

    Texts from which something is cut are all kept.
    """
    if index.source is None or not predicates:
        return index
    raw, mapping = index.source
    wanted = And(tuple(predicates))
    if hint(entity, wanted, F.col("content"), mapping) is None:
        return index
    return build_index(raw.filter(T.bound(F.coalesce("content", F.lit("")), lambda content: hint(entity, wanted, content, mapping) | cut_apart(content))), mapping)


# --- date presets ----------------------------------------------------------------------------------


def preset_range(name: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a named range; weeks begin on Monday."""
    key = name.lower().replace("-", "_").replace(" ", "_")
    one = dt.timedelta(days=1)
    week = today - one * today.weekday()
    month = today.replace(day=1)
    next_month = (month + dt.timedelta(days=32)).replace(day=1)
    last_month = (month - one).replace(day=1)
    year = today.replace(month=1, day=1)
    ranges = {
        "today": (today, today), "yesterday": (today - one, today - one),
        "this_week": (week, week + 6 * one), "last_week": (week - 7 * one, week - one),
        "this_month": (month, next_month - one), "last_month": (last_month, month - one),
        "this_year": (year, year.replace(month=12, day=31)), "last_year": (year.replace(year=year.year - 1), year - one),
        "last_28_days": (today - 28 * one, today),
    }
    for old, new in (("thisweek", "this_week"), ("lastweek", "last_week"), ("thismonth", "this_month"), ("lastmonth", "last_month"), ("thisyear", "this_year"), ("lastyear", "last_year")):
        ranges[old] = ranges[new]
    if key not in ranges:
        raise ValueError(f"unknown date range: {name}")
    return ranges[key]


def created_between(entity: str, rows: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Rows of notes whose text attribute ``created`` begins with a day in the range; a bound that is no date doesn't filter."""
    day = T.date_part(text_attribute(_header(entity), "created"))
    for bound, keep in ((low, lambda d: day >= d), (high, lambda d: day <= d)):
        if bound and _day(bound):
            rows = rows.filter(keep(bound))
    return rows


def _preset(entity: str, rows: DataFrame, preset: str, today: str | None) -> DataFrame:
    low, high = preset_range(preset, dt.date.fromisoformat(today) if today else dt.date.today())
    return created_between(entity, rows, low.isoformat(), high.isoformat())


# --- searches --------------------------------------------------------------------------------------


def search_notes(index: Index, tags: Sequence[str] = (), links: Sequence[str] = (), attributes: dict[str, str] | None = None, exists: Sequence[str] = (), text: str | None = None, body: str | None = None, types: Sequence[str] = (), preset: str | None = None, today: str | None = None, created_from: str | None = None, created_to: str | None = None, predicate: Predicate | None = None) -> DataFrame:
    """Notes that pass every given filter."""
    rows = narrowed("notes", index, _asked(tags, links, attributes, exists, predicate)).notes
    if body:
        rows = rows.filter(T.ascii_lower("body").contains(T.fold_text(body)))
    rows = _filtered("notes", rows, tags, links, attributes, exists, types)
    if text:
        rows = rows.filter(T.like("title", text) | in_header("notes", text))
    if preset:
        rows = _preset("notes", rows, preset, today)
    rows = created_between("notes", rows, created_from, created_to)
    return where("notes", rows, predicate) if predicate else rows


def _asked(tags: Sequence[str], links: Sequence[str], attributes: dict[str, str] | None, exists: Sequence[str] = (), predicate: Predicate | None = None) -> list[Predicate]:
    parts = [Tag(t) for t in tags] + [Link(x) for x in links] + [Attribute(k, v) for k, v in (attributes or {}).items()] + [Attribute(k) for k in exists]
    return parts + [predicate] if predicate else parts


def _filtered(entity: str, rows: DataFrame, tags: Sequence[str], links: Sequence[str], attributes: dict[str, str] | None, exists: Sequence[str], types: Sequence[str]) -> DataFrame:
    parts = _asked(tags, links, attributes, exists)
    rows = where(entity, rows, And(tuple(parts))) if parts else rows
    return rows.filter(reduce(lambda a, b: a | b, [has_attribute(_header(entity), "type", t) for t in types])) if types else rows


def search_todos(index: Index, tags: Sequence[str] = (), links: Sequence[str] = (), attributes: dict[str, str] | None = None, text: str | None = None, body: str | None = None, priority: str | None = None, due: str | None = None, due_from: str | None = None, due_to: str | None = None, closed: bool | None = None, preset: str | None = None, today: str | None = None, predicate: Predicate | None = None) -> DataFrame:
    """Todos that pass every given filter; tags, attributes, body and dates are those of the todo's note."""
    rows = narrowed("todos", index, _asked(tags, links, attributes, (), predicate)).todos
    if closed is not None:
        rows = rows.filter(F.col("closed") == closed)
    if priority:
        rows = rows.filter(F.col("priority") == priority)
    for value, keep in ((due, lambda d: F.col("due") == d), (due_from, lambda d: F.col("due") >= d), (due_to, lambda d: F.col("due") <= d)):
        if value:
            rows = rows.filter(keep(value.replace("-", "")))
    rows = _filtered("todos", rows, tags, links, attributes, (), ())
    if body:
        rows = rows.filter(T.ascii_lower("note_body").contains(T.fold_text(body)))
    if text:
        rows = rows.filter(T.like("text", text) | in_header("todos", text))
    if preset:
        rows = _preset("todos", rows, preset, today)
    return where("todos", rows, predicate) if predicate else rows


def search_segments(index: Index, tags: Sequence[str] = (), links: Sequence[str] = (), attributes: dict[str, str] | None = None, text: str | None = None, predicate: Predicate | None = None) -> DataFrame:
    rows = narrowed("segments", index, _asked(tags, links, attributes, (), predicate)).segments
    if text:
        rows = rows.filter(T.like("text", text))
    rows = _filtered("segments", rows, tags, links, attributes, (), ())
    return where("segments", rows, predicate) if predicate else rows


# --- projections -----------------------------------------------------------------------------------


def todo_rows(todos: DataFrame) -> DataFrame:
    return todos.select("filename", "line_number", "closed", "priority", "due", "text", F.col("note_title").alias("title"), F.col("note_made").alias("note_created"), F.col("note_changed").alias("note_updated"), "updated")


def note_rows(notes: DataFrame) -> DataFrame:
    return notes.select("filename", "title", "created", "updated", "todo_count", "link_count", F.array_join("tags", ",").alias("tags"), T.preview("body").alias("preview"))


def segment_rows(segments: DataFrame) -> DataFrame:
    return segments.select("segment_id", "filename", "start_line", "end_line", "heading_level", "breadcrumb", "text")


def notes_with_todos(index: Index, notes: DataFrame) -> DataFrame:
    """Notes with their todos nested, in line order; notes without one have an empty list."""
    nested = index.todos.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("line_number", "closed", "text"))).alias("todos"))
    return notes.join(nested, "filename", "left").withColumn("todos", F.coalesce("todos", F.array().cast("array<struct<line_number:int,closed:boolean,text:string>>")))


def attribute_texts(index: Index, key: str) -> DataFrame:
    """``filename, attr_text`` as ``{attr:key}`` renders it: text, ``[a, b]`` of text elements, or the value."""
    rows = index.attributes.filter(F.lower("key") == key.lower())
    elements = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("vtype") == "string", F.struct("ord", "value")))), lambda x: x["value"]), ", ")
    return rows.groupBy("filename").agg(F.when(F.bool_or("is_array"), F.concat(F.lit("["), elements, F.lit("]"))).otherwise(F.max(F.coalesce("value", F.lit("null")))).alias("attr_text"))


def attribute_text(merged: Column | str, key: str) -> Column:
    """``attribute_texts`` of one note, from its merged attributes; null without any."""
    groups = F.filter(merged, lambda g: (F.lower(g["key"]) == key.lower()) & (F.size(g["items"]) > 0))
    items = F.flatten(F.transform(groups, lambda g: F.transform(g["items"], lambda x, n: F.struct(n.alias("ord"), x["value"].alias("value"), x["vtype"].alias("vtype")))))
    elements = F.transform(F.filter(items, lambda x: x["vtype"] == "string"), lambda x: F.struct(x["ord"], x["value"]))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(elements), lambda x: x["value"]), ", "), F.lit("]"))
    return F.when(F.exists(groups, lambda g: g["is_array"]), listed).otherwise(F.array_max(F.transform(items, lambda x: F.coalesce(x["value"], F.lit("null")))))


def formatted(index: Index, rows: DataFrame, template: str, names: dict[str, Column]) -> DataFrame:
    """Adds ``line``: ``{name}`` expands to a column, ``{attr:key}`` to an attribute; other braces stay as they are."""
    columns, parts, at = rows.columns, [], 0
    while (start := template.find("{", at)) >= 0 and (end := template.find("}", start)) >= 0:
        name = template[start + 1 : end]
        parts.append(F.lit(template[at:start]))
        if name.lower().startswith("attr:"):
            carried = next((c for c in ("merged", "note_merged") if c in columns), None)
            own = f"__a{len(parts)}"
            if carried:  # rows have their note's attributes, so nothing is joined
                rows = rows.withColumn(own, attribute_text(carried, name[5:]))
            else:
                rows = rows.join(attribute_texts(index, name[5:]).withColumnRenamed("attr_text", own), "filename", "left")
            parts.append(F.coalesce(F.col(own), F.lit("")))
        elif name.lower() in names:
            parts.append(F.coalesce(names[name.lower()].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(template[start : end + 1]))
        at = end + 1
    parts.append(F.lit(template[at:]))
    return rows.withColumn("line", F.concat(*parts)).select(*columns, "line")


def local_time(column: str) -> Column:
    return F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd HH:mm")


def default_todo_line() -> Column:
    return F.concat(F.lit('"'), "filename", F.lit('":'), F.col("line_number").cast("string"), F.lit(" "), "text")


def default_note_line() -> Column:
    return F.format_string("%s [%d todos, %d links]", "filename", "todo_count", "link_count")


def default_segment_line() -> Column:
    return F.concat(F.lit('"'), "filename", F.lit('":'), F.col("start_line").cast("string"), F.lit(" ["), "breadcrumb", F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" / ")))


def absolute(root: str, column: str = "filename") -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.col(column))


def first_of_each_file(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each file in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("filename").orderBy(*order))).filter("__n = 1").drop("__n")


# --- orders ----------------------------------------------------------------------------------------


def _attribute_key(index: Index, rows: DataFrame, key: str) -> DataFrame:
    first = index.attributes.filter((F.lower("key") == key.lower()) & (F.col("vtype") != "array")).groupBy("filename").agg(F.min_by("value", "ord").alias("__key"))
    return rows.join(first, "filename", "left")


def sort_todos(index: Index, rows: DataFrame, by: str) -> DataFrame:
    """Todos by ``due``, ``priority``, ``filename``, ``modified``, ``created``, ``text`` or ``attr:<key>``; missing last, ties by place."""
    columns = rows.columns
    place = [F.asc("filename"), F.asc("line_number")]
    if by.startswith("attr:"):
        return _attribute_key(index, rows, by[5:]).orderBy(F.asc_nulls_last("__key"), *place).select(columns)
    if by in ("modified", "created"):
        return rows.orderBy(F.desc("note_changed" if by == "modified" else "note_made"), *place)
    first = {"due": [F.asc_nulls_last("due")], "priority": [F.asc_nulls_last("priority")], "text": [F.asc("text")], "filename": []}[by]
    return rows.orderBy(*first, *place)


def sort_notes(index: Index, rows: DataFrame, by: str) -> DataFrame:
    if by.startswith("attr:"):
        return _attribute_key(index, rows, by[5:]).orderBy(F.asc_nulls_last("__key"), "filename").select(rows.columns)
    first = {"modified": [F.desc("updated")], "created": [F.desc("created")], "title": [F.asc("title")], "filename": []}[by]
    return rows.orderBy(*first, "filename")


def sort_segments(index: Index, rows: DataFrame, by: str) -> DataFrame:
    if by == "modified":
        return rows.orderBy(F.desc("note_changed"), "filename", "start_line")
    return rows.orderBy(*({"text": ["text"], "filename": []}[by]), "filename", "start_line")


# --- names and many queries ------------------------------------------------------------------------


def resolve_names(notes: DataFrame, names: DataFrame) -> DataFrame:
    """``name, n_found, filename``: notes whose path is the name or ends with ``/name``; the path if there is one only.

    Each path is exploded to its suffixes, so the join is on equality.
    """
    parts = F.split("filename", "/")
    suffixes = notes.select("filename", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(F.split("filename", "/"), n, F.size(F.split("filename", "/"))), "/"))).alias("name"))
    found = names.select("name").distinct().join(suffixes, "name", "left").groupBy("name").agg(F.count("filename").alias("n_found"), F.min("filename").alias("filename"))
    return found.withColumn("filename", F.when(F.col("n_found") == 1, F.col("filename")))


def name_lookup(notes: DataFrame, part: str, limit: int = 500) -> DataFrame:
    """Names that contain a text, the latest notes first."""
    named = notes.select(T.stem("filename").alias("name"), "filename", "updated")
    return named.filter(T.ascii_lower("name").contains(T.fold_text(part))).orderBy(F.desc("updated"), "filename").limit(limit)


def term_table(index: Index) -> DataFrame:
    """``filename, kind, key, value`` of all that saved searches can ask for, in compared form, from one pass over the notes; a term more than once if notes share a path."""
    term = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    tags = F.transform("tags", lambda x: term("tag", F.lit(""), T.norm(x)))
    links = F.transform("links", lambda x: term("link", F.lit(""), T.norm(x)))
    attributes = F.flatten(F.transform("merged", lambda g: F.transform(g["items"], lambda x: term("attr", F.lower(g["key"]), F.lower(x["value"])))))
    none = F.array().cast("array<struct<kind:string,key:string,value:string>>")
    terms = F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (tags, links, attributes)]))
    return index.notes.select("filename", F.explode_outer(terms).alias("t")).select("filename", "t.*").filter("value is not null")


#: Up to so many different terms of saved searches go to all tasks; beyond that, notes' terms are shuffled to them.
FEW_TERMS = 500_000


def saved_search_matches(index: Index, searches: DataFrame) -> DataFrame:
    """``query_id, filename`` of searches in disjunctive form: rows ``query_id, clause_id, kind, key, value``; a clause needs all its terms.

    Notes come to a clause by its rarest term only, and what they hold is written once. Clauses with the same further terms
    meet a note as one, so a frequent term isn't multiplied by all the searches that have it.
    """
    place = ["kind", "key", "value"]
    cleaned = searches.select("query_id", "clause_id", "kind", F.lower(F.coalesce("key", F.lit(""))).alias("key"), F.when(F.col("kind") == "attr", F.lower("value")).otherwise(T.norm("value")).alias("value"))
    terms = stash(cleaned.distinct(), "terms")
    # terms without a value match nothing, as do their clauses
    asked_for = terms.select(*place).filter("value is not null").distinct()
    few = asked_for.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    held = stash(term_table(index).join(F.broadcast(asked_for) if few else asked_for, place, "left_semi").distinct(), "held")
    counts = held.groupBy(*place).agg(F.count("*").alias("n"))
    term = F.struct("kind", "key", "value")
    clauses = terms.join(counts, place, "left").groupBy("query_id", "clause_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), term.alias("term")))).alias("t"))
    seeds = clauses.select("query_id", "clause_id", F.col("t")[0]["term"].alias("seed"), F.sort_array(F.slice("t", F.lit(2), F.size("t"))["term"]).alias("rest"))
    met = held.select("filename", term.alias("seed")).join(seeds, "seed").select("query_id", "filename", "rest")
    alone = met.filter(F.size("rest") == 0).select("query_id", "filename")
    more = met.filter(F.size("rest") > 0)
    # of each note and list of further terms once: whether the note holds them all
    asked = more.select("filename", "rest").distinct()
    found = asked.select("filename", "rest", F.explode("rest").alias("term")).join(held.select("filename", term.alias("term")), ["filename", "term"]).groupBy("filename", "rest").agg(F.count("*").alias("n"))
    full = found.filter(F.col("n") == F.size("rest")).select("filename", "rest")
    return more.join(full, ["filename", "rest"], "left_semi").select("query_id", "filename").unionByName(alone).distinct()


def literal_backlinks(notes: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """The first files whose text contains ``[name]``."""
    return notes.filter(F.col("body").contains(f"[{name}]")).select("filename").orderBy("filename").limit(limit)


def modified_since(raw: DataFrame, today: str, days: int) -> DataFrame:
    return raw.filter(F.col("mtime") >= F.date_sub(F.to_date(F.lit(today)), days).cast("timestamp")).select("filename", "mtime")
