"""Other material as notes: pages, mail, Word files, issues, threads, texts and browser history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python import docx_paragraphs, mail_fields, page_markdown, page_title, thread_markdown
from ..scratch import stash


def quoted(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('\\"')), F.lit('"'))


def note_front(created: Column, kind: Column, source: Column, title: Column | None = None, sender: Column | None = None, to: Column | None = None, mail_date: Column | None = None) -> Column:
    """Frontmatter of a converted note: ``created, type, source, title, from, to, mail_date``; what is null (or no recipient) is left out."""
    line = lambda name, v: F.lit(None).cast("string") if v is None else F.concat(F.lit(f"{name}: "), quoted(v))
    many = F.lit(None).cast("string") if to is None else F.when(F.size(to) > 0, F.concat(F.lit("to:\n"), F.array_join(F.transform(to, lambda x: F.concat(F.lit("  - "), quoted(x))), "\n")))
    rows = F.array(F.concat(F.lit("created: "), created), F.concat(F.lit("type: "), kind), line("source", F.coalesce(source, F.lit(""))), line("title", title), line("from", sender), many, line("mail_date", mail_date))
    return F.concat(F.lit("---\n"), F.array_join(F.filter(rows, lambda x: x.isNotNull()), "\n"), F.lit("\n---\n\n"))


#: Folders by type of note; other types go to ``notes``.
FOLDERS = {"web": "web", "reddit": "web", "document": "documents", "mail": "mail"}


def note_name(kind: Column, source: Column) -> Column:
    """A file name from a source: the last part of an address's path, or a file's name without its extension."""
    path = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    part = F.replace(T.trim(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit(" "), F.lit("%20"))
    file = F.regexp_extract(F.regexp_replace(source, r"/+$", ""), r"([^/]*)$", 1)
    own = F.when(kind.isin("web", "reddit"), part).when(kind.isin("document", "mail"), F.regexp_replace(file, r"(?s)(?<=.)\.[^.]*$", "")).otherwise("")
    return F.translate(F.when(F.coalesce(own, F.lit("")) == "", "unnamed").otherwise(own), " /\\", "___")


def note_path(kind: Column, source: Column, now: Column, mail_day: Column | None = None) -> Column:
    """``<folder>/yyyy/Mon/<type>-<date>-<name>.md``; mail by its own day if it has one, and types without a folder in ``notes``."""
    day = now if mail_day is None else F.when(kind == "mail", F.coalesce(mail_day, now)).otherwise(now)
    folder = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FOLDERS.items()])
    below = F.when(folder.isNull(), "notes").otherwise(F.concat_ws("/", folder, F.date_format(day, "yyyy"), F.date_format(day, "MMM")))
    return F.concat_ws("/", below, F.concat(F.concat_ws("-", kind, F.date_format(day, "yyyy-MM-dd"), note_name(kind, source)), F.lit(".md")))


def write_notes(notes: DataFrame, folder: str) -> None:
    """A table of ``filename, content`` by the folder, year and month of the path; null where a path has none."""
    parts = F.split("filename", "/")
    dated = F.size(parts) >= 4
    part = lambda k: F.when(dated, F.element_at(F.when(dated, parts).otherwise(F.array_repeat(F.lit(""), 4)), k))
    notes.select("filename", "content", F.when(dated, part(-4)).otherwise(F.get(parts, F.lit(0))).alias("type"), part(-3).alias("year"), part(-2).alias("mon")).write.partitionBy("type", "year", "mon").parquet(folder)


def write_results(rows: DataFrame, folder: str) -> None:
    """A JSON line for each row."""
    rows.write.json(folder)


# --- pages -----------------------------------------------------------------------------------------


def pages_to_notes(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """``page_id, title, filename, content`` of HTML pages; ``now`` is when they are converted."""
    now = F.current_timestamp() if now is None else now
    kind = F.when(F.coalesce("url", F.lit("")).rlike(r"reddit\.com|redd\.it"), "reddit").otherwise("web")
    title = F.col("__title")
    head = note_front(F.date_format(now, "yyyy-MM-dd HH:mm"), kind, F.col("url"), title)
    return pages.withColumn("__title", page_title("html")).select("page_id", title.alias("title"), note_path(kind, F.coalesce("url", F.lit("")), now).alias("filename"), F.concat(head, F.lit("\n"), page_markdown("html")).alias("content"))


def route_source(url: Column) -> Column:
    """Which converter a source needs: reddit, github, url, eml, msg or document. Addresses are told by their exact beginning, files by their ending."""
    web = url.startswith("http://") | url.startswith("https://")
    return (
        F.when(web & url.rlike(r"reddit\.com|redd\.it"), "reddit").when(url.startswith("https://github.com/") | url.startswith("http://github.com/"), "github").when(web, "url")
        .when(F.lower(url).endswith(".eml"), "eml").when(F.lower(url).endswith(".msg"), "msg").otherwise("document")
    )


def github_raw_url(url: Column) -> Column:
    """The raw content of a GitHub page: a Markdown file itself, else the README of a folder or of the repository."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?github\.com/", ""), r"[?#].*$|/+$", ""), "/")
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))
    kind, ref = F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    rest = F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts), F.lit(1))), "/")
    readme = F.when(rest == "", "README.md").otherwise(F.concat(rest, F.lit("/README.md")))
    return F.when(F.size(parts) < 2, F.lit(None)).when((kind == "blob") & F.lower(rest).endswith(".md"), F.concat(raw, ref, F.lit("/"), rest)).when(kind.isin("blob", "tree"), F.concat(raw, ref, F.lit("/"), readme)).otherwise(F.concat(raw, F.lit("HEAD/README.md")))


# --- plain text, threads, issues -------------------------------------------------------------------


def texts_to_notes(docs: DataFrame) -> DataFrame:
    """``doc_id, title, body``: the first line is the title, every line a paragraph, and a blank one a line break more."""
    rows = F.transform(T.lines(F.coalesce("text", F.lit(""))), T.trim)
    body = F.array_join(F.transform(rows, lambda x: F.when(x == "", "\n").otherwise(F.concat(x, F.lit("\n\n")))), "")
    return docs.select("doc_id", F.coalesce(F.get(rows, F.lit(0)), F.lit("")).alias("title"), body.alias("body"))


def threads_to_notes(threads: DataFrame) -> DataFrame:
    """``thread, n_comments, content`` of threads (``thread, json``: the listing of the post and that of its nested comments).

    Comments are numbered depth first; empty, deleted and removed ones keep their number but aren't shown.
    """
    read = threads.select("thread", thread_markdown("json").alias("t"))
    return read.select("thread", F.get_json_object("t", "$.n").cast("long").alias("n_comments"), F.get_json_object("t", "$.text").alias("content"))


def flatten_thread(posts: DataFrame) -> DataFrame:
    """Comment trees of any depth, depth first: ``thread, number, author, text`` from ``thread, id, parent, kind, author, text, ord``.

    Only kind ``t1`` is kept; what hangs below another kind or below no comment isn't reached. One join a level, each written.
    """
    own = posts.filter("kind = 't1'")
    level = stash(own.filter("parent is null").select("*", F.array(F.struct("ord", "id")).alias("path")), "thread-level")
    found = [level]
    while not level.isEmpty():
        above = level.select("thread", F.col("id").alias("parent"), F.col("path").alias("__above"))
        step = own.join(above, ["thread", "parent"]).withColumn("path", F.concat("__above", F.array(F.struct("ord", "id")))).drop("__above").select(level.columns)
        level = stash(step, "thread-level")
        found.append(level)
    rows = reduce(DataFrame.unionByName, found)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("thread").orderBy("path"))).filter(~T.trim(F.coalesce("text", F.lit(""))).isin("", "[deleted]", "[removed]")).select("thread", "number", "author", "text")


ISSUE = (
    "key string, fields struct<summary:string,description:string,status:struct<name:string>,issuetype:struct<name:string>,priority:struct<name:string>,assignee:struct<displayName:string>,"
    "reporter:struct<displayName:string>,created:string,updated:string,resolutiondate:string,labels:array<string>,comment:struct<comments:array<struct<author:struct<displayName:string>,created:string,body:string>>>>"
)


def comment_header(author: Column, created: Column) -> Column:
    """``### [[author]] writes on [[date]] at time and zone``, or with a time stamp of another form, that stamp in brackets."""
    who = F.concat(F.lit("### [["), F.lower(author), F.lit("]]"))
    clock = F.substring(created, F.instr(created, "T") + 1, F.length(created))
    # up to the first sign, or to a final Z; fractions of a second go
    time, zone = (F.regexp_extract(clock, r"(?s)^([^+-]*?)([+-].*|Z?)$", k) for k in (1, 2))
    dated = F.concat(who, F.lit(" writes on [["), F.substring_index(created, "T", 1), F.lit("]] at "), F.substring_index(time, ".", 1), zone)
    return F.when(F.contains(created, F.lit("T")), dated).otherwise(F.concat(who, F.lit(" ("), created, F.lit(")")))


def issues_to_notes(issues: DataFrame) -> DataFrame:
    """``filename, content`` of issue records (schema ``ISSUE``); values stand as they are, between quotes."""
    f = lambda name: F.col(f"fields.{name}")
    line = lambda name, v: F.concat(F.lit(f'{name}: "'), v, F.lit('"\n'))
    if_there = lambda v: F.coalesce(v, F.lit(""))
    named = {
        "status": f("status.name"), "issuetype": f("issuetype.name"), "priority": f("priority.name"), "assignee": f("assignee.displayName"), "reporter": f("reporter.displayName"),
        "jira_created": f("created"), "jira_updated": f("updated"), "jira_resolutiondate": f("resolutiondate"),
    }
    labels = F.when(F.size(f("labels")) > 0, F.concat(F.lit("labels:\n"), F.array_join(F.transform(f("labels"), lambda x: F.concat(F.lit('  - "'), x, F.lit('"\n'))), "")))
    head = F.concat(F.lit("---\n"), line("key", F.col("key")), F.lit("type: jira\n"), *[if_there(line(name, v)) for name, v in named.items()], if_there(labels), F.lit("---\n\n"))
    title = F.concat(F.lit("# "), F.col("key"), F.lit(" - "), if_there(f("summary")), F.lit("\n\n"))
    text = F.when(if_there(f("description")) != "", F.concat(F.lit("## Description\n\n"), f("description"), F.lit("\n\n")))
    comment = lambda c: F.concat(comment_header(F.coalesce(c["author"]["displayName"], F.lit("Unknown")), if_there(c["created"])), F.lit("\n\n"), if_there(c["body"]), F.lit("\n\n"))
    comments = F.when(F.size(f("comment.comments")) > 0, F.concat(F.lit("## Comments\n\n"), F.array_join(F.transform(f("comment.comments"), comment), "")))
    return issues.select(F.concat(F.lit("jira/"), F.col("key"), F.lit(".md")).alias("filename"), F.concat(head, title, if_there(text), if_there(comments)).alias("content"))


# --- mail and Word files ---------------------------------------------------------------------------


def person_link(address: Column) -> Column:
    """A bare address as a link to a person."""
    return F.concat(F.lit("[["), F.replace(F.get(F.split(address, "@"), F.lit(0)), F.lit("."), F.lit("_")), F.lit("]]"))


# Starts of lines that mail programs leave of their style sheets: fixed values.
STYLE_LINES = ("Times New Roman", "Arial", "Calibri", "font-family:", "font-size:", "font-style:", "font-weight:", "color:", "background-color:", "mso-", "@")


def clean_mail_body(text: Column) -> Column:
    """Without style lines, escapes, and blanks and stars at line ends; an empty last line goes."""
    rows = F.filter(T.lines(text), lambda x: ~T.trim(x).rlike("^(?:" + "|".join(STYLE_LINES) + ")"))
    rows = F.when(F.element_at(F.concat(F.array(F.lit("x")), rows), -1) == "", F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    plain = lambda x: F.replace(F.regexp_replace(x, r"\\([*_\[\](){}#+\-.!|])", "$1"), F.lit("\\\\"), F.lit("\\"))
    return F.array_join(F.transform(rows, lambda x: F.regexp_replace(F.regexp_replace(plain(x), r"[\s\p{Z}]+\z", ""), r"\*+\z", "")), "\n")


def mails_to_notes(files: DataFrame, now: Column | None = None) -> DataFrame:
    """``path, subject, filename, content`` of messages (``path, content``); ``now`` stands for the date of those that have none."""
    now = F.current_timestamp() if now is None else now
    read = files.select("path", mail_fields("content").alias("m"))
    m = lambda name: F.col(f"m.{name}")
    subject = F.coalesce(m("subject"), F.lit("(No Subject)"))
    head = note_front(F.coalesce(m("created"), F.date_format(now, "yyyy-MM-dd HH:mm")), F.lit("mail"), F.col("path"), subject, m("sender"), m("recipients"), m("date"))
    # the lines of a mail's head: fixed values
    line = lambda name, v: F.coalesce(F.when(v != "", F.concat(F.lit(f"**{name}:** "), v, F.lit("\n\n"))), F.lit(""))
    block = F.concat(line("From", m("sender")), line("To", F.array_join(m("recipients"), ", ")), line("Cc", m("cc")), line("Date", m("date")), line("Message-ID", m("message_id")), F.lit("---\n\n"))
    attached = F.when(F.size("m.attachments") > 0, F.concat(F.lit("\n\n---\n\n## Attachments\n\n"), F.array_join(F.transform("m.attachments", lambda a: F.concat(F.lit("- "), a, F.lit("\n"))), ""))).otherwise("")
    path = note_path(F.lit("mail"), F.col("path"), now, F.to_date(F.substring(m("created"), 1, 10)))
    return read.select("path", subject.alias("subject"), path.alias("filename"), F.concat(head, F.lit("\n# "), subject, F.lit("\n\n"), block, m("body"), attached).alias("content"))


def heading_level(style: Column) -> Column:
    """Level of a Word paragraph style; null for text."""
    level = F.regexp_extract(F.lower(F.replace(style, F.lit(" "), F.lit(""))), r"^heading([1-6])$", 1)
    return F.when(F.lower(style) == "title", 1).when(level != "", level.cast("int"))


def docx_to_notes(files: DataFrame) -> DataFrame:
    """``path, title, body`` of Word files (``path, content``)."""
    read = files.select("path", F.filter(docx_paragraphs("content"), lambda p: T.trim(p["text"]) != "").alias("p"))
    body = F.transform("p", lambda p: F.concat(F.coalesce(F.concat(F.repeat(F.lit("#"), heading_level(p["style"])), F.lit(" ")), F.lit("")), p["text"]))
    first = F.get("p", F.lit(0))["text"]
    return read.select("path", F.when(F.length(first) < 200, first).otherwise("").alias("title"), F.array_join(body, "\n\n").alias("body"))


def reconvert(notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``filename, status, content``: notes (``filename, front, body, source``) against fresh bodies (``source, new_body``, null if that failed).

    A source is looked up beside its note first, by its name, then at its own path.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]*)/*$", 1)
    beside = F.concat(F.regexp_extract("filename", r"^(.*/)?[^/]*$", 1), base(F.col("source")))
    places = F.array(F.struct(F.lit(0).alias("rank"), beside.alias("source")), F.struct(F.lit(1).alias("rank"), F.col("source")))
    asked = notes.filter("source is not null").select("filename", F.explode(places).alias("p")).select("filename", "p.rank", "p.source")
    there = fresh.groupBy("source").agg(F.max(F.struct(F.col("new_body"))).alias("new"))
    found = asked.join(there, "source").groupBy("filename").agg(F.min_by("new", "rank").alias("__new"))
    joined = notes.join(found, "filename", "left").withColumn("new_body", F.col("__new.new_body"))
    status = F.when(F.col("__new").isNull(), "skipped").when(F.col("new_body").isNull(), "failed").when(F.col("new_body").eqNullSafe(F.col("body")), "unchanged").otherwise("reconverted")
    return joined.select("filename", status.alias("status"), F.concat(F.lit("---\n"), "front", F.lit("\n---\n"), F.when(status == "reconverted", F.col("new_body")).otherwise(F.coalesce("body", F.lit("")))).alias("content"))


# --- browser history -------------------------------------------------------------------------------


def union_visits(sources: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``url, title, ts, browser`` of several browsers: each has ``visits(url_id, raw_time)`` and ``urls(url_id, url, title)``."""
    out = None
    for browser, (visits, urls) in sources.items():
        rows = visits.join(urls, "url_id").select("url", "title", T.browser_epoch(F.lit(browser), F.col("raw_time")).alias("ts"), F.lit(browser).alias("browser"))
        out = rows if out is None else out.unionByName(rows)
    return out


def latest_visits(visits: DataFrame) -> DataFrame:
    """The last visit of each address over all browsers."""
    last = F.max(F.struct("ts", "browser", "title"))
    return visits.groupBy("url").agg(last.alias("v")).select("url", "v.title", "v.ts", "v.browser")


def high_water(visits: DataFrame) -> DataFrame:
    return visits.groupBy("browser").agg(F.max("ts").alias("high_water"))


def since_marks(visits: DataFrame, marks: DataFrame, default: int) -> DataFrame:
    """Visits after each browser's mark, or after ``default`` where there is none."""
    return visits.join(marks.select("browser", "high_water"), "browser", "left").filter(F.col("ts") > F.coalesce("high_water", F.lit(default))).drop("high_water")


#: Browsers in the order in which they are counted.
BROWSERS = ("Safari", "Vivaldi", "Firefox")


def history_lines(visits: DataFrame) -> DataFrame:
    """``day, ts, line`` of visits."""
    when = F.timestamp_seconds("ts")
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("url"))
    return visits.select(F.to_date(when).alias("day"), "ts", F.concat(F.lit("- ["), title, F.lit("]("), F.col("url"), F.lit(") ["), F.col("browser"), F.lit(" - "), F.date_format(when, "HH:mm"), F.lit("] [["), F.date_format(when, "yyyy-MM-dd"), F.lit("]]")).alias("line"))


def history_notes(visits: DataFrame, clock: str = "00:00") -> DataFrame:
    """``day, filename, content``: a note for each day with the last visit of each address, the latest first, and counts by browser."""
    day = F.to_date(F.timestamp_seconds("ts"))
    last = visits.groupBy(day.alias("day"), "url").agg(F.max(F.struct("ts", "browser", "title")).alias("v")).select("day", "url", "v.ts", "v.browser", "v.title").withColumn("browser", F.initcap("browser"))
    lines = history_lines(last).groupBy("day").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "line")), asc=False), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("lines"))
    count = lambda b: F.count_if(F.col("browser") == b).alias(b)
    counts = last.groupBy("day").agg(*map(count, BROWSERS))
    each = F.array_join(F.filter(F.array(*[F.when(F.col(b) > 0, F.concat(F.lit(f"- {b}: "), F.col(b).cast("string"), F.lit(" URLs\n"))) for b in BROWSERS]), lambda x: x.isNotNull()), "")
    date = F.date_format("day", "yyyy-MM-dd")
    # the note's fixed lines
    front = F.concat(F.lit('---\ntitle: "Browser History"\ndate: '), date, F.lit("\ntype: note\ntags: [browser-history, daily]\n---\n\n# Browser History\n\nCreated on [["), date, F.lit("]]\n\n"))
    content = F.concat(front, F.lit("## Summary\n\nTotal unique URLs visited: "), F.col("n").cast("string"), F.lit("\n\n"), each, F.lit("\n## History Entries\n\n"), F.col("lines"))
    path = F.concat(F.lit("web/"), F.date_format("day", "yyyy/MMM"), F.lit("/browser-"), date, F.lit(f"-{clock}.md"))
    return lines.join(counts, "day").select("day", path.alias("filename"), content.alias("content"))
