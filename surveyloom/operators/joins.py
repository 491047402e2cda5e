"""Null-safe joins on same-named keys, folds, lookups and code lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join where NULL keys match NULL keys; key columns appear once.

    Spark plans ``<=>`` as an equi-join, so this is never a nested loop.
    """
    l, r = left.alias("l"), right.alias("r")
    cond = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    joined = l.join(r, reduce(Column.__and__, cond), how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"l.`{c}`") for c in left.columns])

    def key(k: str) -> Column:
        if how in ("full", "full_outer", "outer"):
            return F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k)
        side = "r" if how in ("right", "right_outer") else "l"
        return F.col(f"{side}.`{k}`").alias(k)

    rest_l = [c for c in left.columns if c not in keys]
    rest_r = [c for c in right.columns if c not in keys]
    clash = set(rest_l) & set(rest_r)
    return joined.select(
        *[key(k) for k in keys],
        *[F.col(f"l.`{c}`").alias(f"{c}.x" if c in clash else c) for c in rest_l],
        *[F.col(f"r.`{c}`").alias(f"{c}.y" if c in clash else c) for c in rest_r],
    )


def fold_join(tables: Iterable[DataFrame], keys: Sequence[str], how: str) -> DataFrame:
    """Join a list of tables left to right on the same keys."""
    return reduce(lambda a, b: join_on(a, b, keys, how), tables)


def suffix_columns(df: DataFrame, suffix: str, keys: Sequence[str]) -> DataFrame:
    """Append ``suffix`` to every column that is not a key."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keys else c + suffix) for c in df.columns])


def add_title(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str) -> DataFrame:
    """Left join to a code list; a code with several rows fans out."""
    return join_on(df, lookup.withColumnRenamed(lookup_key, key), [key], "left")


def in_list(df: DataFrame, codes: DataFrame, column: str, list_column: str) -> DataFrame:
    """Keep rows whose code is in the list; NULL is in a list that holds NULL."""
    wanted = codes.select(F.col(list_column).alias(column)).distinct()
    return join_on(df, wanted, [column], "left_semi")


def missing_from(expected: DataFrame, found: DataFrame, column: str, found_column: str) -> DataFrame:
    """Distinct expected codes that do not occur in ``found``."""
    have = found.select(F.col(found_column).alias(column)).distinct()
    return join_on(expected.select(column).distinct(), have, [column], "left_anti")


def apply_crosswalk(df: DataFrame, pairs: Mapping[str, str], source: str, target: str) -> DataFrame:
    """Add ``target``: the paired code, or the source code where none is paired.

    The pairs are program text, so their join side is bounded by the program.
    """
    table = df.sparkSession.createDataFrame(list(pairs.items()), f"{source} string, {target} string")
    joined = df.join(F.broadcast(table), source, "left")
    return joined.select(*df.columns, F.coalesce(F.col(target), F.col(source)).alias(target))


# Keys that the sketch of frequent items keeps; at most this many reach the driver.
HOT_KEYS = 1000


def hot_keys(df: DataFrame, keys: Sequence[str], share: float) -> list[int]:
    """Hashes of the keys that may hold more than ``share`` of the rows, from one mergeable sketch.

    The sketch overstates a count and never leaves out a key above ``share``; a key that is
    listed without need is split without need.
    """
    if not 1 / HOT_KEYS <= share <= 1:
        raise ValueError(f"a share between {1 / HOT_KEYS} and 1 is needed")
    hashed = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("_h"))
    # The sketch tracks 16 times the keys asked for.
    top = F.expr(f"approx_top_k(_h, {HOT_KEYS}, {16 * HOT_KEYS})")
    found = hashed.agg(F.count("*").alias("n"), top.alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] > share * found["n"]]


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", share: float = 0.01, pieces: int = 64) -> DataFrame:
    """``join_on`` for a left side in which some keys hold much of the rows.

    Left rows of hot keys are dealt to ``pieces`` by the hash of the whole row, right rows of
    these keys are repeated for every piece, and all other rows are joined as they are. One small
    job finds the hot keys. Rows that are equal in all columns stay in one piece. Right rows are
    repeated, so only joins that keep no unmatched right row are possible.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat unmatched rows of the right side")
    hot = hot_keys(left, keys, share)
    if not hot:
        return join_on(left, right, keys, how)

    def is_hot(df: DataFrame) -> Column:
        return F.array_contains(F.lit(hot), F.xxhash64(*[F.col(f"`{k}`") for k in keys]))

    whole = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns], F.lit(1))
    dealt = left.withColumn("_piece", F.when(is_hot(left), F.pmod(whole, F.lit(pieces))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot(right), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.select("*", F.explode(copies).alias("_piece"))
    joined = join_on(dealt, repeated, [*keys, "_piece"], how)
    return joined.drop("_piece")
