"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences, in SQL functions only.

A section begins after blank lines or at a heading, a paragraph is a line, and a leaf is a sentence
(at most 200 characters). Cutting loses no character. A leaf's digest is the MD5 of its text, a
paragraph's and a section's that of its children's digests, and the root is the SHA-256 of the
sections' digests: equal roots mean equal texts, and where roots differ, the sections and paragraphs
whose digests differ locate the edits. The fingerprint string is the root, a colon, and the first eight
digits of each leaf (``,`` between leaves, ``;`` between paragraphs, ``/`` between sections). The likeness
of two fingerprints is 1 for equal roots, and else the share of distinct leaves that both have.

Defined results: a null text counts as empty; the empty text has one empty leaf. Repeated rows each get a
row; among rows with equal ids the order is by text. Null ids stand after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a bucket of the id order, and most buckets (their bounds pass through the driver).
BUCKET_ROWS, MAX_BUCKETS = 100, 100_000

_SECTION = r"(?<=\n\n)(?!\n)|(?<=\n)(?=#{1,6} )"
_PARAGRAPH = r"(?<=\n)"
_LEAF = r"[^.!?]{0,200}[.!?]+\s*|[^.!?]{1,200}"


def tree(text: Column) -> Column:
    """``array<struct<digest, paragraphs: array<struct<digest, leaves: array<string>>>>>``, the sections."""
    leaves = F.transform(
        F.split(F.coalesce(text, F.lit("")), _SECTION),
        lambda section: F.transform(F.split(section, _PARAGRAPH), lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda leaf: F.md5(leaf))),
    )
    paragraphs = F.transform(leaves, lambda s: F.transform(s, lambda p: F.struct(F.md5(F.array_join(p, "")).alias("digest"), p.alias("leaves"))))
    return F.transform(paragraphs, lambda s: F.struct(F.md5(F.array_join(F.transform(s, lambda p: p["digest"]), "")).alias("digest"), s.alias("paragraphs")))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ""), 256)


def leaf_marks(sections: Column) -> Column:
    """First eight digits of all leaves, in order."""
    return F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: F.transform(p["leaves"], lambda x: F.substring(x, 1, 8))))))


def fingerprint(sections: Column) -> Column:
    below = F.transform(sections, lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.array_join(F.transform(p["leaves"], lambda x: F.substring(x, 1, 8)), ",")), ";"))
    return F.concat(root(sections), F.lit(":"), F.array_join(below, "/"))


def likeness(one: Column, other: Column) -> Column:
    """Of two fingerprint strings."""
    marks = lambda f: F.array_distinct(F.split(F.substring_index(f, ":", -1), "[,;/]"))
    both = F.size(F.array_intersect(marks(one), marks(other)))
    # texts whose leaves are the same set but in another order or number are not equal
    return F.when(F.substring_index(one, ":", 1) == F.substring_index(other, ":", 1), F.lit(1.0)).otherwise(F.least(F.lit(0.999999), both / F.greatest(F.lit(1), F.size(F.array_union(marks(one), marks(other))))))


def differing(one: Column, other: Column) -> Column:
    """Where two trees differ: ``array<struct<section, paragraph>>``, numbers from 0; equal sections aren't entered."""
    n = F.greatest(F.size(one), F.size(other))
    found = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda s: F.when(F.get(one, s)["digest"].eqNullSafe(F.get(other, s)["digest"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.greatest(F.coalesce(F.size(F.get(one, s)["paragraphs"]), F.lit(1)), F.coalesce(F.size(F.get(other, s)["paragraphs"]), F.lit(1)), F.lit(1)) - 1),
                    lambda p: ~F.get(F.get(one, s)["paragraphs"], p)["digest"].eqNullSafe(F.get(F.get(other, s)["paragraphs"], p)["digest"]),
                ),
                lambda p: F.struct(s.alias("section"), p.alias("paragraph")),
            )
        ),
    )
    return F.flatten(found)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, sections, fingerprint`` of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree(F.col("text")).alias("sections")).withColumn("fingerprint", fingerprint(F.col("sections")))


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, equal, edits`` of documents in both tables: where the second text differs from the first."""
    a = fingerprints(before).select("doc_id", F.col("sections").alias("one"))
    b = fingerprints(after).select("doc_id", F.col("sections").alias("other"))
    return a.join(b, "doc_id").select("doc_id", (root(F.col("one")) == root(F.col("other"))).alias("equal"), differing(F.col("one"), F.col("other")).alias("edits"))


def _literal(values: list[int]) -> Column:
    """An array as one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _count_up_to(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by binary search."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    if not steps:
        return F.lit(0)
    array = _literal(bounds)
    # beyond the end, get() gives null and the step isn't taken
    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) <= key, at + s).otherwise(at))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``doc_id, text``, ``carried`` and, as ``next_<name>``, what the next row by descending id has; the first row follows the last.

    Rows go to buckets of the id order, by quantiles of the ids; a bucket's first row also goes to the
    end of the bucket before it. So no task sorts more than a bucket, and texts are shuffled once. Rows of one
    id (or without one) stay in one bucket: ids are meant to be keys, and a table in which one id has a third of the rows
    has them sorted in one task, on disk where they don't fit into memory.
    """
    least = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[c for c in carried if c != "text"]).withColumn("key", F.coalesce("doc_id", F.lit(least)))
    own = [c for c in rows.columns if c != "key"]
    ids = rows.select("key")
    count = ids.count()
    wanted = min(MAX_BUCKETS, max(1, count // BUCKET_ROWS))
    bounds: list[int] = []
    if wanted > 1:
        shares = F.split(F.lit(",".join(str(k / wanted) for k in range(1, wanted))), ",").cast("array<double>")
        bounds = sorted(set(ids.agg(F.percentile_approx("key", shares, max(10_000, 20 * wanted)).alias("at")).first()["at"]))
    bucketed = rows.withColumn("bucket", _count_up_to(bounds, F.col("key")))
    # at most one row for each bucket comes to the driver
    heads = {r["bucket"]: r["head"] for r in bucketed.select("bucket", "key").groupBy("bucket").agg(F.max("key").alias("head")).collect()}
    filled = sorted(heads)
    head_of = [heads.get(k, least) for k in range(len(bounds) + 1)]
    above = {low: high for low, high in zip(filled, filled[1:] + filled[:1], strict=True)}
    above_of = [above.get(k, 0) for k in range(len(bounds) + 1)]
    stay = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(_literal(above_of), F.col("bucket")).cast("int").alias("b"), F.lit(1).alias("guest"))
    dealt = bucketed.withColumn("to", F.explode(F.when(F.get(_literal(head_of), F.col("bucket")) == F.col("key"), F.array(stay, guest)).otherwise(F.array(stay))))
    order = Window.partitionBy("b").orderBy("guest", F.desc("key"), F.xxhash64("text"), "text")
    placed = dealt.select(*own, "key", F.col("to.b").alias("b"), F.col("to.guest").alias("guest"))
    return placed.select(*own, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter("guest = 0").drop("guest")


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the next document's, and of the text whose second half is replaced by that one's start."""
    # a text's own fingerprint is made before the shuffle and goes along, also to the document before it
    first = docs.select("doc_id", "text", fingerprint(tree(F.col("text").cast("string"))).alias("fingerprint"))
    rows = with_next(first, ["text", "fingerprint"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = (F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    prints = edited.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", tree(F.col("edited")).alias("edited"))
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
