"""From note text to tables: notes, todos, segments, tags, links and attributes.

Everything works on one row of a note at a time: what needs a state over the lines (fences, headings, sections)
folds them within the row, so no line is shuffled. Attributes of a note are one VARIANT value, its header, in which
conditions look up paths. Only frontmatter goes through Python (Arrow). Arrays are exploded in the outer form: else
Spark computes them once more at the source, to drop empty ones there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python import front_attributes, front_fields, header_texts, merged_attributes

#: Attribute names that mean another attribute.
MAPPING = {"participant": "people", "participants": "people"}
MIN_ISSUE_WORDS = 20


def split_front(raw: DataFrame) -> DataFrame:
    """Adds ``front`` (null without frontmatter), ``body`` and ``front_lines``; line ends in both are single."""
    content = F.coalesce("content", F.lit(""))
    cut = raw.withColumn("__head", F.when(content.rlike(T.OPENED), F.regexp_extract(content, T.FRONT, 0)))
    has = F.col("__head") != ""
    front = F.regexp_extract("__head", T.FRONT, 1)
    # texts are cut by bytes: to count characters is most of the work otherwise
    behind = T.bytes_of(content, F.octet_length("__head") + 1, F.octet_length(content))
    cut = cut.withColumns({"__front": F.when(has, front), "__body": F.when(has, behind)})
    plain = lambda s: F.when(s.contains("\r"), F.regexp_replace(s, r"\r?\n\z|\r(?=\n)", "")).when(s.endswith("\n"), T.bytes_of(s, F.lit(1), F.octet_length(s) - 1)).otherwise(s)
    lines = F.octet_length("__front") - F.octet_length(F.replace("__front", F.lit("\n"), F.lit("")))
    return cut.select(*raw.columns, plain(F.col("__front")).alias("front"), F.when(has, plain(F.col("__body"))).otherwise(content).alias("body"), F.when(has, (lines + 2).cast("int")).otherwise(F.lit(0)).alias("front_lines"))


def parse(raw: DataFrame, mapping: dict[str, str] | None = MAPPING) -> DataFrame:
    """One row for each note, with its body, title, attributes, links, tags and times."""
    # marked so that conditions on their results don't run them once more below; what isn't asked for isn't run
    fields, own_rows, merged, header = (f.asNondeterministic() for f in (front_fields(), front_attributes(), merged_attributes(mapping), header_texts(mapping)))
    front = split_front(raw.select("filename", "content", F.col("mtime").cast("timestamp").alias("mtime")))
    plain = F.replace(F.replace("front", F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
    read = (
        front.withColumn("body", T.held(T.strip_query_blocks("body"))).withColumn("__plain", plain)
        .withColumn("__listed", F.when(F.col("body").rlike(T.ANY_LIST_SECTION), listed("body"))).withColumn("__listed", F.when(F.size("__listed") > 0, F.to_json("__listed")))
        .withColumns({"read": fields("__plain"), "attributes": own_rows("__plain"), "merged": merged("__plain", "__listed"), "header_json": header("__plain", "__listed")}).drop("__plain", "__listed")
    )
    dates = F.filter(F.array(*[T.date_part(F.col(f"read.{k}")) for k in ("created", "changed", "modified")]), lambda d: d.isNotNull())
    none = F.array().cast("array<string>")
    own = F.coalesce(T.all_matches("front", "[[", T.WIKI_LINK), none)
    # tag words count in todos only; a todo's hash tags are among the body's
    words = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(T.TODO_LINES), F.lit(0)), lambda line: F.regexp_extract_all(line, F.lit(T.TAG_WORD), F.lit(1))))
    with_links = read.select(
        "filename", "mtime", "front", "front_lines", "body", F.coalesce("read.title", T.title_of("filename")).alias("title"),
        "attributes", "merged", "header_json",
        F.array_distinct(F.concat(own, dates, F.coalesce("read.labels", none))).alias("front_links"),
        T.epoch_of_field(F.col("read.created")).alias("note_created"), T.epoch_of_field(F.col("read.updated")).alias("note_updated"),
        F.regexp_count("body", F.lit(T.TODO_LINES)).alias("todo_count"),
        F.array_sort(F.array_distinct(F.concat(words, T.with_parents(T.raw_tags("body"))))).alias("tags"),
    )
    return with_links.select(
        "*", F.array_distinct(F.concat(T.bound(T.link_dates("body"), T.links_of), F.col("front_links"))).alias("links"),
        F.coalesce("note_created", F.unix_seconds("mtime"), "note_updated").alias("created"), F.coalesce("note_updated", F.unix_seconds("mtime"), F.lit(0)).alias("updated"),
    )


def todos(parsed: DataFrame) -> DataFrame:
    """A row for each todo line of each body."""
    carried = [c for c in parsed.columns if c.startswith("note_")]
    return todo_fields(parsed.select("filename", "front_lines", *carried, F.posexplode_outer(T.lines("body")).alias("n", "line")).filter(F.col("line").rlike(T.TODO)))


def todo_fields(lines: DataFrame) -> DataFrame:
    """Todos of ``filename, front_lines, n, line``, the lines that are one (``n`` from 0), and of what they carry of their notes."""
    carried = [c for c in lines.columns if c.startswith("note_")]
    content = lines.select(
        "filename", (F.col("n") + 1 + F.col("front_lines")).cast("int").alias("line_number"), *carried,
        (F.lower(F.regexp_extract("line", T.TODO, 1)) == "x").alias("closed"), T.trim(F.regexp_extract("line", T.TODO, 2)).alias("text"),
    )
    found = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    day = lambda s: T.epoch_of_compact(T.compact_date(s))
    bare = F.filter(F.transform(F.regexp_extract_all("text", F.lit(T.BARE_DATE), F.lit(1)), day), lambda t: t.isNotNull())
    fields = content.select(
        "*", found(T.PRIORITY).alias("priority"), T.compact_date(found(T.DUE)).alias("due"),
        F.concat(T.raw_tags("text"), F.regexp_extract_all("text", F.lit(T.TAG_WORD), F.lit(1))).alias("tags"), T.links_of("text").alias("links"),
        F.coalesce(day(found(T.WIKI_DATE)), F.try_element_at(bare, F.lit(1))).alias("__date"),
    )
    return fields.select(
        F.concat_ws("#", "filename", F.col("line_number").cast("string")).alias("todo_id"), "filename", "closed", "priority", "due", F.to_date(F.try_to_timestamp("due", F.lit("yyyyMMdd"))).alias("due_date"),
        "text", "tags", "links", "line_number", F.coalesce(T.epoch_of_compact(F.col("due")), "__date", "note_updated", "note_created", F.lit(0)).cast("long").alias("updated"), *carried,
    )


# --- tables ----------------------------------------------------------------------------------------


_HEAD = "struct<n:int,level:int,heading:string,above:array<string>>"
#: What the fold over a body's lines knows: whether a fence is open, the open headings of levels 1 to 3, and all headings so far.
_STATE = f"struct<fenced:boolean,h1:string,h2:string,h3:string,heads:array<{_HEAD}>>"


def headings(lines: Column) -> Column:
    """``array<struct<n, level, heading, above>>``: the headings of level 1 to 4 outside fences (``n`` from 0), with those above them."""

    def step(state: Column, x: Column) -> Column:
        fence, level, heading = x["fence"], x["level"], x["heading"]
        is_head = ~fence & ~state["fenced"] & level.between(1, 4)
        above = F.filter(F.array(state["h1"], F.when(level > 2, state["h2"]), F.when(level > 3, state["h3"])), lambda h: h.isNotNull())
        above = F.when(level > 1, above).otherwise(F.array().cast("array<string>"))
        head = F.struct(x["n"].alias("n"), level.alias("level"), heading.alias("heading"), above.alias("above"))
        kept = lambda k: F.when(level == k, heading).when(level > k, state[f"h{k}"])  # noqa: E731  a heading ends those of its own and higher levels
        entered = F.struct(F.lit(False).alias("fenced"), *[kept(k).alias(f"h{k}") for k in (1, 2, 3)], F.concat(state["heads"], F.array(head.cast(_HEAD))).alias("heads")).cast(_STATE)
        turned = F.struct((~state["fenced"]).alias("fenced"), *[state[f"h{k}"].alias(f"h{k}") for k in (1, 2, 3)], state["heads"].alias("heads")).cast(_STATE)
        return F.when(is_head, entered).when(fence, turned).otherwise(state)

    nothing = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("fenced"), nothing.alias("h1"), nothing.alias("h2"), nothing.alias("h3"), F.array().cast(f"array<{_HEAD}>").alias("heads")).cast(_STATE)
    # only such lines change the state; what each says is read once
    found = F.filter(F.transform(lines, lambda line, n: F.when((line.startswith("#") | line.contains("```")) & line.rlike(T.STATE_LINE), F.struct(n.alias("n"), line.alias("line")))), lambda x: x.isNotNull())
    told = F.transform(found, lambda x: F.struct(x["n"].alias("n"), x["line"].rlike(T.FENCE).alias("fence"), F.length(F.regexp_extract(x["line"], T.HEADING, 1)).alias("level"), F.regexp_extract(x["line"], T.HEADING, 2).alias("heading")))
    return F.aggregate(told, start, step, lambda state: state["heads"])


def segments(parsed: DataFrame, min_issue_words: int = MIN_ISSUE_WORDS) -> DataFrame:
    """Sections under headings of level 1 to 4 outside fences, with the headings above them."""
    carried = [c for c in parsed.columns if c.startswith("note_")]
    lined = parsed.select("filename", "front_lines", *carried, T.lines("body").alias("lines")).withColumn("heads", headings(F.col("lines")))
    before = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("above")).cast(_HEAD)
    starts = F.when(F.coalesce(F.get("heads", F.lit(0))["n"], F.lit(-1)) == 0, F.col("heads")).otherwise(F.concat(F.array(before), F.col("heads")))
    each = lined.withColumn("heads", starts).select("filename", "front_lines", *carried, "lines", "heads", F.posexplode_outer("heads").alias("k", "head"))
    end = F.coalesce(F.get("heads", F.col("k") + 1)["n"], F.size("lines"))
    cut = each.select(
        "filename", *carried, (F.col("head.n") + F.col("front_lines") + 1).cast("int").alias("start_line"), (end + F.col("front_lines")).cast("int").alias("end_line"),
        F.col("head.level").alias("heading_level"), "head.heading", F.col("head.above").alias("above"), F.array_join(F.slice("lines", F.col("head.n") + 1, end - F.col("head.n")), "\n").alias("text"),
    )
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return cut.filter(F.col("text").rlike(T.SAYS) & (~F.col("filename").startswith("jira/") | (words >= min_issue_words))).select(
        F.concat_ws("#", "filename", F.col("start_line").cast("string")).alias("segment_id"), "filename", "start_line", "end_line", "heading_level", "text",
        F.array_join(F.concat(F.array("filename"), "above"), " > ").alias("breadcrumb"),
        F.concat(F.filter(F.array("heading"), lambda x: x.isNotNull()), "above").alias("headings"), *carried,
    )


def listed(body: Column | str) -> Column:
    """``array<struct<key, values>>``: lists that alone stand under a one-word heading; of headings with the same word the last counts."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(body if isinstance(body, Column) else F.col(body), F.lit(""))), T.SECTION_START), F.lit(2), F.lit(1 << 30))

    def item(line: Column) -> Column:
        """A list item's link or only word; null for any other line."""
        of = lambda own: T.bound(F.regexp_extract(own, r"^\[\[([^\]]+)\]\]$", 1), lambda link: F.when(link != "", link).when((own != "") & ~own.contains(" "), own))
        return T.bound(T.trim(F.regexp_extract(line, r"^[-*+] (.*)$", 1)), of)

    def section(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(block, r"\r?\n"), T.trim), lambda x: x != "")
        key = lambda r: F.lower(T.trim(F.regexp_replace(F.get(r, F.lit(0)), "^#+", "")))
        return T.bound(rows, lambda r: F.struct(key(r).alias("key"), F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))), item).alias("values")))

    def last_of_each(found: Column) -> Column:
        return F.filter(found, lambda s, k: ~F.exists(F.slice(found, k + 2, F.size(found) + 1), lambda later: later["key"] == s["key"]))

    # most sections aren't lists of such items; patterns tell before any line is cut
    found = F.transform(F.filter(blocks, lambda b: b.rlike(T.LIST_SECTION) & b.rlike(T.ONLY_LIST)), section)
    usable = F.filter(found, lambda s: (F.size(s["values"]) > 0) & (s["key"] != "") & ~s["key"].contains(" ") & F.forall(s["values"], lambda v: v.isNotNull()))
    return T.bound(usable, last_of_each)


def body_attributes(parsed: DataFrame) -> DataFrame:
    """``filename, key, ord, value``: lists that alone stand under a one-word heading."""
    each = parsed.select("filename", F.explode_outer(listed("body")).alias("s"))
    return each.select("filename", "s.key", F.posexplode_outer("s.values").alias("ord", "value")).filter("value is not null")


def front_rows(parsed: DataFrame) -> DataFrame:
    """``filename, key, ord, value, vtype, is_array`` of frontmatter as it stands."""
    return parsed.select("filename", F.explode_outer("attributes").alias("a")).filter("a.key is not null").select("filename", "a.*")


def attribute_rows(notes: DataFrame) -> DataFrame:
    """``filename, key, ord, value, vtype, is_array`` of notes with ``merged``."""
    each = notes.select("filename", F.explode_outer("merged").alias("g")).select("filename", "g.key", "g.is_array", F.posexplode_outer("g.items").alias("ord", "item"))
    return each.filter("ord is not null").select("filename", "key", "ord", F.col("item.value").alias("value"), F.col("item.vtype").alias("vtype"), "is_array")


def variant_path(key: str) -> str:
    """The path of a dotted key with optional indexes: ``a.b[0]``."""
    parts = []
    for part in key.split("."):
        name, _, rest = part.partition("[")
        quote = "'" if '"' in name else '"'
        parts.append(f"[{quote}{name}{quote}]" + (f"[{rest}" if rest else ""))
    return "$" + "".join(parts)


def _at(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, variant_path(key), kind)


def has_attribute(v: Column, key: str, value: str | None = None) -> Column:
    """Whether a header has something at a path: a scalar (null too), or an element or member at least; with ``value``, whether one equals it.

    Letters are compared without ASCII case. Keys are compared as they are; a path that can't be one matches nothing.
    """
    if not key or any(p.startswith("[") or not p for p in key.split(".")):
        return F.lit(False)
    elements, members = _at(v, key, "array<variant>"), F.map_values(_at(v, key, "map<string,variant>"))
    if value is None:
        return F.coalesce((F.size(F.coalesce(elements, members)) > 0) | (elements.isNull() & members.isNull() & _at(v, key, "variant").isNotNull()), F.lit(False))
    same = lambda s: F.coalesce(T.ascii_lower(s) == T.fold_text(value), F.lit(False))
    inside = lambda rows: F.exists(rows, lambda x: same(x.try_cast("string")))
    return F.coalesce(inside(elements), inside(members), same(_at(v, key, "string")))


def text_attribute(v: Column, key: str) -> Column:
    """A header's value at a path if it is a text, else null."""
    return F.when(F.schema_of_variant(_at(v, key, "variant")) == "STRING", _at(v, key, "string"))


@dataclass
class Index:
    """The tables of an index; all lazy. Rows of todos and segments carry what conditions on their note need."""

    parsed: DataFrame
    notes: DataFrame
    todos: DataFrame
    note_tags: DataFrame
    note_links: DataFrame
    todo_tags: DataFrame
    todo_links: DataFrame
    #: The notes' texts and the mapping that the index was built from; None if it was read from a table.
    source: tuple[DataFrame, dict[str, str]] | None = None

    @property
    def attributes(self) -> DataFrame:
        return attribute_rows(self.parsed)

    @property
    def headers(self) -> DataFrame:
        """``filename, header_json``: the attributes of notes that have some, as one JSON object."""
        return self.notes.filter("header_json is not null").select("filename", "header_json")

    @property
    def segments(self) -> DataFrame:
        return segments(_carrying(self.parsed)).withColumn("tags", T.with_parents(F.flatten(F.transform(F.concat(F.array("text"), "headings"), T.raw_tags)))).withColumn("links", F.flatten(F.transform(F.concat(F.array("text"), "headings"), T.links_of)))

    @property
    def segment_tags(self) -> DataFrame:
        """Own tags, those of the headings above, and the note's."""
        return self.segments.select("segment_id", F.explode_outer(F.array_union("tags", "note_tags")).alias("tag")).filter("tag is not null")

    @property
    def segment_links(self) -> DataFrame:
        return self.segments.select("segment_id", F.explode_outer(F.array_union("links", "note_links")).alias("link")).filter("link is not null")

    @property
    def segment_attributes(self) -> DataFrame:
        """Scalars and array elements as text; objects and nulls are left out."""
        flat = F.flatten(F.transform("note_merged", lambda g: F.transform(F.filter(g["items"], lambda x: x["vtype"].isin("string", "int", "bool")), lambda x: F.struct(g["key"].alias("key"), x["value"].alias("value")))))
        return self.segments.select("segment_id", F.explode_outer(F.array_distinct(flat)).alias("a")).filter("a.key is not null").select("segment_id", "a.key", "a.value")


def _carrying(parsed: DataFrame) -> DataFrame:
    """Notes with the columns that their todos and segments carry."""
    return parsed.withColumns({
        "note_title": F.col("title"), "note_tags": F.col("tags"), "note_links": F.col("links"), "note_header": F.col("header"), "note_header_json": F.col("header_json"), "note_merged": F.col("merged"), "note_body": F.col("body"),
        "note_made": F.col("created"), "note_changed": F.col("updated"),
    })


def build_index(raw: DataFrame, mapping: dict[str, str] | None = MAPPING) -> Index:
    return replace(index_from(parse(raw, mapping)), source=(raw, mapping or {}))


def index_from(parsed: DataFrame) -> Index:
    """An index over notes as ``parse`` gives them."""
    parsed = parsed.withColumn("header", F.try_parse_json("header_json"))
    notes = parsed.select("filename", "created", "updated", "title", "todo_count", F.size("links").alias("link_count"), "links", "body", "tags", "header", "header_json", "merged")
    rows = todos(_carrying(parsed))
    flat = lambda df, key, column, name: df.select(key, F.explode_outer(F.array_distinct(column)).alias(name)).filter(F.col(name).isNotNull())
    return Index(parsed, notes, rows, flat(notes, "filename", "tags", "tag"), flat(notes, "filename", "links", "link"), flat(rows, "todo_id", "tags", "tag"), flat(rows, "todo_id", "links", "link"))
