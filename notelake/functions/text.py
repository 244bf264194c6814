"""Column functions over note text: names, lines, dates, tags and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the note format: fixed values.
TODO = r"^- \[([ xX])\] (.*)$"
TODO_LINES = r"(?dm)^- \[[ xX]\] .*$"
PRIORITY = r"priority:\s*([A-Z])"
DUE = r"due:\s*(\d{4}-\d{2}-\d{2}|\d{8})"
TAG = r"(?U)#(?<=(?:^|\s)#)([A-Za-zäöüÄÖÜß][A-Za-zäöüÄÖÜß/_]*)"
TAG_WORD = r"tag:\s*([a-zA-Z0-9_]+)"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
WIKI_LINK = r"\[\[([^\]]+)\]\]"
HEADING = r"^(#{1,6})\s+(.*)$"
FENCE = r"^\s*```"
#: Lines that begin a section or turn a fence; texts that aren't blank; where a block of lines begins with a hash; a block whose second line is a list item.
STATE_LINE = r"^(?:#{1,4}\s|\s*```)"
SAYS = r"[^\s\p{Z}]"
SECTION_START = r"\r?\n(?=[\s\p{Z}&&[^\n]]*#)"
ANY_LIST_SECTION = r"(?m)^[\s\p{Z}&&[^\n]]*#[^\n]*\n[\s\p{Z}]*[-*+] "
LIST_SECTION = r"^[^\n]*\n[\s\p{Z}]*[-*+] "
#: A block all of whose further lines are list items of a link or a word, or blank.
ONLY_LIST = r"\A[^\n]*(?:\n(?:[\s\p{Z}&&[^\n]]*+|[\s\p{Z}&&[^\n]]*+[-*+] [\s\p{Z}&&[^\n]]*+(?:\[\[[^\n]*\]\][\s\p{Z}\x85&&[^\n]]*|[^ \n]*[\s\p{Z}\x85&&[^\n]]*))(?=\n|\z))*+\z"
OPENED = r"\A[\s\p{Z}&&[^\n]]*---"
#: Frontmatter at the start of a text, with its closing line: its lines.
FRONT = r"\A[\s\p{Z}&&[^\n]]*---[\s\p{Z}&&[^\n]]*\n((?:(?![\s\p{Z}&&[^\n]]*+---[\s\p{Z}&&[^\n]]*+(?:\n|\z))[^\n]*+\n)*+)[\s\p{Z}&&[^\n]]*---[\s\p{Z}&&[^\n]]*(?:\n|\z)"
QUERY_BLOCKS = {"```dataview\n": r"(?s)```dataview\n.*?```", "```tasks\n": r"(?s)```tasks\n.*?```"}
BARE_DATE = r"(?U)(?=\d{4}-)\b(\d{4}-\d{2}-\d{2})\b(?![^\[\]]*+(?:(?:\[(?!\[)|\](?!\]))[^\[\]]*+)*+\]\])"
WIKI_DATE = r"\[\[(\d{4}-\d{2}-\d{2})\]\]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def lit_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def norm(s: Column | str) -> Column:
    """Lower case (ASCII) with blanks for underscores: the form in which filters compare stored tags and links."""
    return ascii_lower(spaced(s))


def spaced(s: Column | str) -> Column:
    return F.replace(_c(s), F.lit("_"), F.lit(" "))


def name_norm(s: Column | str) -> Column:
    """Lower case in any script with blanks for underscores: the form in which links and notes' names meet."""
    return F.lower(spaced(s))


def same_tag(tag: Column, needle: str) -> Column:
    """A stored tag in ASCII lower case equals the needle in lower case of any script."""
    return norm(tag) == needle.lower().replace("_", " ")


def same_link(link: Column, needle: str) -> Column:
    """As for tags, or both as they are."""
    return same_tag(link, needle) | (spaced(link) == needle.replace("_", " "))


def fold_text(s: str) -> str:
    """A needle as ``ascii_lower`` makes the text it is looked for in: other letters keep their case."""
    return s.translate(str.maketrans(UPPER, LOWER))


def norm_text(s: str) -> str:
    return fold_text(s.replace("_", " "))


def ascii_lower(s: Column | str) -> Column:
    return F.translate(_c(s), UPPER, LOWER)


def like(s: Column | str, needle: str) -> Column:
    """Substring match, ASCII case-insensitive; ``%`` and ``_`` in the needle are wildcards."""
    return ascii_lower(s).like(f"%{fold_text(needle)}%")


def stem(filename: Column | str) -> Column:
    """Last path part without its ``.md``."""
    return F.regexp_extract(_c(filename), r"([^/]+?)(?:\.md)?$", 1)


def title_of(filename: Column | str) -> Column:
    """The path without every trailing ``.md``."""
    return F.regexp_replace(_c(filename), r"(\.md)+$", "")


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end begins no further line."""
    text = _c(text)
    ended = F.when(text.endswith("\n"), bytes_of(text, F.lit(1), F.octet_length(text) - 1)).otherwise(text)
    cut = F.when(text.contains("\r"), F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")).otherwise(F.split(ended, "\n"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held(value: Column) -> Column:
    """The value, computed where it stands: a condition on it isn't moved below, where the value would take the place of its name, each time it is named."""
    return F.when(F.spark_partition_id() >= 0, value)


def bytes_of(text: Column, start: Column, n: Column) -> Column:
    """Bytes of a text from a place (from 1), where characters begin and end; unlike characters they needn't be counted."""
    return F.substring(text.cast("binary"), start, n).cast("string")


def trim(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def compact_date(s: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD`` as ``YYYYMMDD``."""
    return F.replace(s, F.lit("-"), F.lit(""))


def epoch_of_compact(s: Column) -> Column:
    """Midnight UTC of a ``YYYYMMDD`` text; null if that is no date."""
    return F.unix_seconds(F.try_to_timestamp(s, F.lit("yyyyMMdd")))


def date_part(s: Column) -> Column:
    """The ``YYYY-MM-DD`` that a date field begins with, in brackets or not; else null."""
    found = F.regexp_extract(s, r"^\s*(?:\[\[)?(.{4}-.{2}-.{2})", 1)
    return F.when(found != "", found)


def epoch_of_field(s: Column) -> Column:
    """A date field as epoch seconds: all digits, or a date (in brackets or not) with an optional ``hh:mm``."""
    s = trim(s)
    day = F.regexp_extract(s, r"^(?:\[\[)?(\d{4}-\d{2}-\d{2})(?:\]\])?", 1)
    rest = F.regexp_extract(s, r"^(?:\[\[)?\d{4}-\d{2}-\d{2}(?:\]\])?\s*(\d{2}:\d{2})", 1)
    clock = F.when(rest == "", F.lit("00:00")).otherwise(rest)
    return F.when(s.rlike(r"^\d+$"), s.try_cast("bigint")).otherwise(F.unix_seconds(F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm"))))


def strip_query_blocks(body: Column | str) -> Column:
    out = _c(body)
    for mark, pattern in QUERY_BLOCKS.items():
        out = F.when(out.contains(mark), F.regexp_replace(out, pattern, "")).otherwise(out)
    return out


def all_matches(text: Column | str, mark: str, pattern: str, group: int = 1) -> Column:
    """A group of all matches of a pattern; texts without ``mark``, which each match has, aren't searched."""
    return F.when(~_c(text).contains(mark), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group)))


def link_dates(text: Column | str) -> Column:
    """Bare dates outside wiki links become wiki links."""
    return F.regexp_replace(_c(text), BARE_DATE, "[[$1]]")


def links_of(text: Column | str) -> Column:
    """Targets of Markdown links, then of wiki links, each in order."""
    return F.concat(all_matches(text, "](", MARKDOWN_LINK, 2), all_matches(text, "[[", WIKI_LINK))


def raw_tags(text: Column | str) -> Column:
    return all_matches(text, "#", TAG)


def with_parents(tags: Column) -> Column:
    """``a/b/c`` also gives ``a`` and ``a/b``; first occurrences."""

    def parents(parts: Column) -> Column:
        return F.transform(parts, lambda _, n: F.array_join(F.slice(parts, F.lit(1), n + 1), "/"))

    return F.array_distinct(F.flatten(F.transform(F.transform(tags, lambda tag: F.split(tag, "/")), parents)))


def transliterate(s: Column) -> Column:
    """German umlauts as two letters."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def preview(body: Column | str, n: int = 3) -> Column:
    """The first lines that aren't blank, trimmed."""
    return F.array_join(F.slice(F.filter(F.transform(lines(body), trim), lambda x: x != ""), 1, n), "\n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length, empty ones and those of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def browser_epoch(kind: Column | str, raw: Column) -> Column:
    """A browser's own visit time as Unix seconds."""
    kind = _c(kind)
    return F.when(kind == "safari", raw + 978307200).when(kind == "vivaldi", F.floor(raw / 1000000) - 11644473600).when(kind == "firefox", F.floor(raw / 1000000)).cast("long")


def register(spark) -> None:
    """SQL functions ``nl_norm``, ``nl_tag_parents`` and ``nl_cosine``."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION nl_norm(s STRING) RETURNS STRING RETURN translate(replace(s, '_', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION nl_tag_parents(tag STRING) RETURNS ARRAY<STRING> RETURN transform(sequence(1, size(split(tag, '/'))), n -> array_join(slice(split(tag, '/'), 1, n), '/'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION nl_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "CASE WHEN size(a) = size(b) AND size(a) > 0 AND aggregate(a, 0D, (s, x) -> s + x * x) > 0 AND aggregate(b, 0D, (s, x) -> s + x * x) > 0 "
        "THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) ELSE 0D END"
    )
