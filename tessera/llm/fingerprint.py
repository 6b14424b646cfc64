"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of sentences.

A text is cut without loss: sections end behind a run of empty lines, paragraphs behind a line feed,
pieces behind a sentence's closing marks or after PIECE characters.  A piece's digest is its SHA-256, an
inner node's the SHA-256 of its children's.  Equal roots mean equal texts; where two roots differ, the sections
that differ, in these the paragraphs and in these the pieces locate the edit.  The likeness of two trees is the
Jaccard similarity of their piece digests (two empty texts: 1).

Only DataFrame functions run here.  Nulls: a null text is empty; a null doc_id sorts as the smallest.
Repeated rows are ordered by text.  A single row is followed by itself.  Very long texts have as many pieces as they
need.  Only doc_id and text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, let, ordered_bounds, read_table

PIECE = 160
_PIECES = rf"(?s)[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"


def tree(text: Column) -> Column:
    """array (sections) of array (paragraphs) of array (digests of pieces)."""
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PIECES), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, r"(?<=\n\n)(?!\n)"), lambda s: F.transform(F.split(s, r"(?<=\n)"), pieces))


def _node(mark: str, digests: Column) -> Column:
    return F.sha2(F.concat(F.lit(mark), F.array_join(digests, ",")), 256)


def section_digests(nodes: Column) -> Column:
    return F.transform(nodes, lambda s: _node("s", F.transform(s, lambda p: _node("p", p))))


def root(nodes: Column) -> Column:
    return _node("r", section_digests(nodes))


def leaves(nodes: Column) -> Column:
    """The distinct pieces, each by the first 60 bits of its digest."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(nodes)), lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def _changed(before: Column, after: Column) -> Column:
    """struct<at, removed, added>: where two arrays of digests differ, from their common beginning to their common end."""
    same = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    least = F.least(F.size(before), F.size(after))
    return let(
        same(before, after),
        lambda p: let(
            F.struct((F.when(p == 0, least + 1).otherwise(p) - 1).alias("at")),
            lambda x: let(
                same(F.reverse(F.slice(before, x["at"] + 1, F.size(before))), F.reverse(F.slice(after, x["at"] + 1, F.size(after)))),
                lambda q: let(
                    F.when(q == 0, least - x["at"]).otherwise(q - 1),
                    lambda end: F.struct(x["at"].alias("at"), (F.size(before) - x["at"] - end).alias("removed"), (F.size(after) - x["at"] - end).alias("added")),
                ),
            ),
        ),
    )


def edits(before: Column, after: Column) -> Column:
    """array<struct<at, removed, added>>: the edit that makes ``after`` of ``before``, from the sections downwards.

    Numbered from 0 in the node above.  A level is looked into only where one node of each tree differs there, so the
    last entry is the edit: nodes from at on that are removed, and how many stand there instead; with equal roots
    there is none.  Levels: sections, paragraphs, pieces.
    """
    one = lambda c: (c["removed"] == 1) & (c["added"] == 1)
    paragraphs = lambda s: F.transform(s, lambda p: _node("p", p))

    def of_pieces(a: Column, b: Column, c: Column) -> Column:
        return F.when(one(c), F.array(_changed(F.element_at(a, c["at"] + 1), F.element_at(b, c["at"] + 1)))).otherwise(F.array())

    def of_paragraphs(c: Column) -> Column:
        a, b = (F.element_at(x, c["at"] + 1) for x in (before, after))
        return F.when(one(c), let(_changed(paragraphs(a), paragraphs(b)), lambda d: F.concat(F.array(d), of_pieces(a, b, d)))).otherwise(F.array())

    top = let(_changed(section_digests(before), section_digests(after)), lambda c: F.concat(F.array(c), of_paragraphs(c)))
    return F.when(root(before) == root(after), F.array()).otherwise(top)


def with_next(docs: DataFrame, per_bucket: int = 256) -> DataFrame:
    """doc_id, text, tree, leaves, next_text, next_leaves: next in descending doc_id order, the first row after the last.

    Rows are dealt over buckets of neighbouring ids; the first row of each bucket is also sent, as a
    guest, behind the last row of the bucket before it, so texts move once and no task sees more than
    its bucket.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = ordered_bounds(docs, "doc_id", per_bucket)
    bucket = bucket_of(F.col("doc_id"), bounds)
    heads = docs.select("doc_id").groupBy(bucket.alias("bucket")).agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head"))
    # one row for each of at most MAX_BOUNDS + 1 buckets
    heads = F.broadcast(heads.select("bucket", F.col("head.doc_id").alias("head_id")))
    sent = rows.withColumn("bucket", bucket).join(heads, "bucket", "left")
    before = (F.col("bucket") + 1) % (len(bounds) + 1)
    place = lambda guest, to: F.struct(F.lit(guest).alias("guest"), to.alias("to"))
    own, ahead = place(False, F.col("bucket")), place(True, before)
    to = F.when(F.col("doc_id").eqNullSafe(F.col("head_id")), F.array(own, ahead)).otherwise(F.array(own))
    placed = sent.select("doc_id", "text", F.explode(to).alias("at")).select("doc_id", "text", "at.guest", "at.to")
    # the tree is made where the window will have the rows, so that the next row's leaves come with its text
    placed = placed.repartition("to").withColumn("tree", tree(F.col("text"))).withColumn("leaves", leaves(F.col("tree")))
    order = Window.partitionBy("to").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    ahead = {"next_text": F.lead("text").over(order), "next_leaves": F.lead("leaves").over(order)}
    return placed.withColumns(ahead).filter("NOT guest").drop("guest", "to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the edits (from the text to the edited one)."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_tree", tree(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), root(F.col("tree")).alias("fingerprint"), root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaves(F.col("edited_tree"))).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        edits(F.col("tree"), F.col("edited_tree")).alias("edits"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(read_table(spark, sf_dir, "documents"))
    return found.withColumn("edited_at", F.nullif(F.concat_ws(".", F.transform("edits", lambda e: e["at"].cast("string"))), F.lit(""))).drop("edits")
