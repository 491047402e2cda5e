"""Exact weighted quantiles by radix descent, for all groups at once.

The rows collapse to ``(group, value, weight)``. A value's place in the order of doubles
is a 64-bit number (``image``); its bits are cut into ``DIGITS``. Weights summed by the first
digit say which bucket of a group holds the wanted cumulative weight, sums by the second digit inside that
bucket say which part of it, and so on: after the last digit one value is left. The depth is fixed, no window has more
rows than a digit has values, and nothing depends on how the values are spread, so a group whose
values all lie close together is shared by many tasks like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.operators.joins import join_on
from surveyloom.sources.staging import stage

# Widths of the digits; the first has the sign, the exponent and 10 bits of the fraction (buckets of 0.1 %).
DIGITS = (22, 21, 21)
SHIFTS = tuple(sum(DIGITS[i + 1 :]) for i in range(len(DIGITS)))


def image(x: Column) -> Column:
    """The 64 bits of a double as a number of the same order; both zeros are 0. Not for not-a-number."""
    a = F.abs(x)
    guess = F.greatest(F.floor(F.log2(a)), F.lit(-1022))
    unit = F.pow(F.lit(2.0), guess)
    # The logarithm may be off by one at powers of two.
    exponent = F.greatest(F.when(a < unit, guess - 1).when(a / 2 >= unit, guess + 1).otherwise(guess), F.lit(-1022))
    fraction = F.floor(a / F.pow(F.lit(2.0), exponent) * float(1 << 52)).cast("long")
    bits = F.shiftleft((exponent + 1022).cast("long"), 52) + fraction
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(x < 0, -size).otherwise(size)


def digit(bits: Column, level: int) -> Column:
    """One digit of an image; the first keeps its sign."""
    high = F.shiftright(bits, SHIFTS[level])
    return high if level == 0 else high.bitwiseAND(F.lit((1 << DIGITS[level]) - 1))


BITS = 62


def membership_masks(conds: Sequence[Column | None]) -> list[Column]:
    """Columns ``_mask0, _mask1, ...`` whose bits tell which conditions hold (always, when None)."""
    masks = []
    for low in range(0, len(conds), BITS):
        mask = F.lit(0).cast("long")
        for i, cond in enumerate(conds[low : low + BITS]):
            bit = F.lit(1 << i).cast("long")
            mask = mask.bitwiseOR(bit if cond is None else F.when(cond, bit).otherwise(F.lit(0).cast("long")))
        masks.append(mask.alias(f"_mask{low // BITS}"))
    return masks


def mask_names(n: int) -> list[str]:
    return [f"_mask{i}" for i in range(-(-n // BITS))]


def has_bit(i: int) -> Column:
    """Whether condition i holds, from the columns of ``membership_masks``."""
    return F.col(f"_mask{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0


def number(column: str) -> Column:
    """A measure as a double; not-a-number is missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def weight_histogram(
    df: DataFrame, keys: Sequence[str], weight: str, members: Mapping[str, Mapping[str, Column | None]]
) -> DataFrame:
    """Weight and row count per ``(block, var, *keys, bucket, x)``.

    ``members`` maps a block label to its variables and its row condition.
    Rows first collapse by their pattern of block membership, once for all
    blocks, and only the collapsed rows are copied to their blocks.
    """
    labels = list(members)
    variables = list(dict.fromkeys(v for cols in members.values() for v in cols["columns"]))
    masks = mask_names(len(members))
    # Inputs and masks are computed in steps of their own: generated methods above 8,000 bytes are not compiled.
    slim = df.select(
        *keys,
        F.col(weight).cast("double").alias("_w"),
        *membership_masks([spec["where"] for spec in members.values()]),
        F.array(*[F.struct(F.lit(v).alias("_var"), number(v).alias("_x")) for v in variables]).alias("_v"),
    )
    rows = slim.select(*keys, "_w", *masks, F.inline("_v"))
    cells = (
        rows.where(F.col("_x").isNotNull())
        .groupBy("_var", *keys, *masks, "_x")
        .agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"))
    )
    in_blocks = []
    for i, label in enumerate(labels):
        wanted = has_bit(i) & F.col("_var").isin(*members[label]["columns"])
        in_blocks.append(F.when(wanted, F.lit(label)))
    # The image of a value is computed once, not once a block.
    placed = cells.withColumn("_image", image(F.col("_x"))).withColumn("_bucket", digit(F.col("_image"), 0))
    return placed.select(
        "_var", *keys, "_x", "_w", "_n", F.explode(F.array_compact(F.array(*in_blocks))).alias("_block"), "_image", "_bucket"
    )


def bucket_totals(hist: DataFrame, group: Sequence[str]) -> DataFrame:
    """Cumulative weight after each bucket, and group totals."""
    per_bucket = hist.groupBy(*group, "_bucket").agg(F.sum("_w").alias("_bw"), F.sum("_n").alias("_bn"))
    # One operator: both frames share the partitioning and the order.
    in_order = Window.partitionBy(*group).orderBy("_bucket")
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_bucket.select(
        *group,
        "_bucket",
        "_bw",
        F.sum("_bw").over(running).alias("_cum"),
        F.sum("_bw").over(whole).alias("_total"),
        F.sum("_bn").over(whole).alias("_rows"),
    ).where(F.col("_bw") > 0)


def locate(
    hist: DataFrame, buckets: DataFrame, group: Sequence[str], share: Column, out: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``share`` of the total.

    ``share`` may read any column of ``buckets``, which may repeat a group for
    several shares told apart by the ``extra`` columns. Shares below 0 or above
    1 give the smallest or the largest value. The first level is computed and staged at once;
    ``hist`` is read twice, so it should be a staged table.
    """
    before = F.col("_cum") - F.col("_bw")
    hit = (
        buckets.withColumn("_goal", F.least(share, F.lit(1.0)) * F.col("_total"))
        .where((F.col("_cum") >= F.col("_goal")) & ((before < F.col("_goal")) | (before <= 0)))
        .select(*group, *extra, "_bucket", "_goal", before.alias("_before"), "_total", "_rows")
    )
    # One row a group and share. Its written size is known, so while it is small it is broadcast and the histogram stays where it is.
    hit = stage(hit, "hits")
    near = join_on(hist.where(F.col("_w") > 0), hit, [*group, "_bucket"], "inner")
    # One bucket of each group is left; it is read several times from here on.
    near = stage(near, "buckets")
    each = [*group, *extra]
    upto = Window.partitionBy(*each).orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, len(DIGITS)):
        near = near.withColumn("_digit", digit(F.col("_image"), level))
        sums = near.groupBy(*each, "_digit", "_goal", "_before").agg(F.sum("_w").alias("_dw"))
        running = sums.withColumn("_cum", F.col("_before") + F.sum("_dw").over(upto))
        place = F.struct("_digit", (F.col("_cum") - F.col("_dw")).alias("_start"))
        # The last digit covers a goal missed by rounding in the last bit.
        found = F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_goal"), place)), F.max(place))
        chosen = running.groupBy(*each).agg(found.alias("_at")).select(*each, "_at._digit", "_at._start")
        near = join_on(near, chosen, [*each, "_digit"], "inner").withColumn("_before", F.col("_start")).drop("_digit", "_start")
    return near.groupBy(*each).agg(F.max("_x").alias(out), F.max("_total").alias("_total"), F.max("_rows").alias("_rows"))
