"""Line dedup through a tree of line templates, as log parsers build it.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading
``depth`` tokens (``SHORT_DEPTH`` in lines of fewer than ``FIELDS`` tokens), where a token with a digit counts as a variable field
``<*>``. The tokens of a line are cut into ``FIELDS`` consecutive fields, or taken one by one in a shorter line. A
template of a leaf fixes ``similarity`` of the fields and leaves the others variable, and every
choice of fixed fields is tried: two lines of a leaf have a template in common
if that share of their fields is equal, whatever other lines the leaf holds. A line is also a template by itself,
with its digit tokens variable.

Templates need constant content: at least half of the tokens and ``LEAST_CHARS`` characters without a
digit. A line without it ('1.5 2.5 3.5') is compared as it stands, token by token, and lines of fewer than ``SHORTEST``
tokens have no variable fields but digit tokens. Lines of fewer than ``LEAST_TOKENS`` tokens and ``LEAST_CHARS`` characters are no templates and stay.

A template that occurs in two documents or more is recurring. Of its lines only the
first one (by document, then place) stays; so the first document keeps what it said,
and what is repeated after it goes.

Exact templates are counted over all lines. Choices of fields are made once for each distinct line, and only in leaves that
hold several of them; counts combine on the map side and the joins by leaf and by choice are salted, so a leaf or a template with a large part of the
lines is shared by many tasks.

Rules for odd input: NULL text stays NULL; empty lines stay; documents that are equal
in id and text count as one document and are treated alike; a NULL doc_id is an id of
its own and comes first; a document may lose all its lines and then has the empty
text. Templates are told apart by 64-bit hashes. Input columns are kept, but for those
that have the name of a result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.staging import stage

VARIABLE = "<*>"
FIELDS = 8
SHORTEST = 5
SHORT_DEPTH = 2
LEAST_TOKENS = 3
LEAST_CHARS = 8
SALTS = 16
RESULTS = ["text", "n_lines", "n_dropped", "dropped"]


def _tokens(line: Column) -> Column:
    # Tried at the start of a token only and without going back, so a long token costs its length.
    return F.array_remove(F.split(F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*", VARIABLE), r"\s+"), "")


def _fields(tokens: Column) -> Column:
    """32-bit hashes of the fields; field i of n tokens begins at ``i * n / fields``, and a short line has a field for each token."""
    n = F.size(tokens)
    fields = F.least(n, F.lit(FIELDS))

    def field(i: Column) -> Column:
        low, high = F.floor(i * n / fields).cast("int"), F.floor((i + 1) * n / fields).cast("int")
        return F.hash(F.array_join(F.slice(tokens, low + 1, high - low), " "))

    return F.when(n >= SHORTEST, F.transform(F.sequence(F.lit(0), fields - 1), field))


def parsed_lines(docs: DataFrame, depth: int) -> DataFrame:
    """``doc_id, text_hash, place, template, leaf, fields``: one row for each line.

    Lines that are no template have none; lines without variable fields have no leaf and no fields.
    """
    lines = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("place", "line")
    )
    cut = lines.select("doc_id", "text_hash", "place", "line", _tokens(F.col("line")).alias("tokens"))
    cut = cut.withColumn("constant", F.array_remove("tokens", VARIABLE))
    tokens, n, constant = F.col("tokens"), F.size("tokens"), F.col("constant")
    # A column of its own, else it would be computed for each use.
    cut = cut.withColumn("content", (2 * F.size(constant) >= n) & (F.length(F.array_join(constant, "")) >= LEAST_CHARS))
    content = F.col("content")
    bare = F.regexp_replace("line", r"\s+", "")
    as_it_stands = F.xxhash64(F.lit("line"), F.array_join(F.array_remove(F.split("line", r"\s+"), ""), " "))
    lead = F.when(n >= FIELDS, depth).otherwise(min(depth, SHORT_DEPTH))
    leaf = F.xxhash64(n, F.array_join(F.slice(tokens, F.lit(1), lead), " "), F.lit("leaf"))
    return cut.select(
        "doc_id",
        "text_hash",
        "place",
        F.when(content, F.xxhash64(n, F.array_join(tokens, " "))).when((n >= LEAST_TOKENS) | (F.length(bare) >= LEAST_CHARS), as_it_stands).alias("template"),
        F.when(content & (n >= SHORTEST), leaf).alias("leaf"),
        F.when(content, _fields(tokens)).alias("fields"),
    )


def choices(fields: Column, leaf: Column, similarity: float) -> Column:
    """One 64-bit name for every choice of fixed fields."""

    def names(size: int) -> Column:
        fixed = math.ceil(similarity * size)
        return F.array(*[F.xxhash64(leaf, F.lit(k), *[F.get(fields, F.lit(i)) for i in some]) for k, some in enumerate(combinations(range(size), fixed))])

    out = F.when(F.size(fields) == FIELDS, names(FIELDS))
    for size in range(SHORTEST, FIELDS):
        out = out.when(F.size(fields) == size, names(size))
    return out


def _in_two_documents(first: Column, last: Column) -> Column:
    return ~(first["doc_id"].eqNullSafe(last["doc_id"]) & (first["text_hash"] == last["text_hash"]))


def _salted(df: DataFrame) -> DataFrame:
    """Copies of a table with one row for each key, to be joined to rows that have a salt.

    Spark takes the copies for as many rows as there were before; unasked it would broadcast all of them.
    """
    return df.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")).hint("merge")


def general_templates(lines: DataFrame, similarity: float) -> DataFrame:
    """``template, first``: distinct lines with a recurring choice of fields, and the first place of it."""
    open_lines = lines.where("fields is not null")
    document = F.struct("doc_id", "text_hash")
    leaves = open_lines.groupBy("leaf").agg(
        F.min(document).alias("first"), F.max(document).alias("last"), F.min("template").alias("low"), F.max("template").alias("high")
    )
    several = stage(leaves.where((F.col("low") != F.col("high")) & _in_two_documents(F.col("first"), F.col("last"))).select("leaf"), "leaves")
    salt = F.pmod("template", F.lit(SALTS)).cast("int").alias("salt")
    here = F.struct("doc_id", "text_hash", "place")
    shared = open_lines.select("*", salt).join(_salted(several), ["leaf", "salt"], "left_semi")
    distinct = shared.groupBy("template", "leaf").agg(F.first("fields").alias("fields"), F.min(here).alias("first"), F.max(here).alias("last"))
    named = stage(distinct.select("template", "first", "last", F.explode(choices(F.col("fields"), F.col("leaf"), similarity)).alias("name")), "choices")
    seen = named.groupBy("name").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("template").alias("low"), F.max("template").alias("high")
    )
    recurring = seen.where((F.col("low") != F.col("high")) & _in_two_documents(F.col("first"), F.col("last"))).select("name", "first")
    joined = named.select("template", "name", salt).join(_salted(recurring), ["name", "salt"])
    return joined.groupBy("template").agg(F.min("first").alias("first"))


def recurring_places(docs: DataFrame, depth: int = 3, similarity: float = 0.75) -> DataFrame:
    """``_doc, _hash, dropped``: the places of the lines that go, for every document that loses some."""
    # The filter comes after staging; before, Spark would cut every line into tokens several times.
    lines = stage(parsed_lines(docs, depth), "lines").where("template is not null")
    here = F.struct("doc_id", "text_hash", "place")
    seen = lines.groupBy("template").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    exact = seen.where(_in_two_documents(F.col("first"), F.col("last"))).select("template", "first")
    firsts = exact.unionByName(general_templates(lines, similarity)).groupBy(F.col("template").alias("_template")).agg(F.min("first").alias("first"))
    slim = lines.select("doc_id", "text_hash", "place", "template")
    repeats = slim.join(firsts, slim["template"] == firsts["_template"]).where(here != F.col("first"))
    return repeats.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("place").alias("dropped")  # of one document
    )


def drop_recurring_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.75) -> DataFrame:
    """``docs`` with ``text`` without recurring lines, ``n_lines, n_dropped`` and the places ``dropped``."""
    repeats = recurring_places(docs.select("doc_id", "text"), depth, similarity)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row.text")
    joined = rows.join(repeats, F.col("_row.doc_id").eqNullSafe(repeats["_doc"]) & (F.xxhash64(text) == repeats["_hash"]), "left")
    lines = F.split(text, "\n")
    dropped = F.coalesce(F.array_sort("dropped"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    cleaned = F.when(F.size("_dropped") == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    results = {
        "text": cleaned,
        "n_lines": F.coalesce(F.size("_lines"), F.lit(0)),
        "n_dropped": F.size("_dropped"),
        "dropped": F.col("_dropped"),
    }
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in results]
    return joined.withColumn("_lines", lines).withColumn("_dropped", dropped).select(*kept, *[c.alias(n) for n, c in results.items()])
