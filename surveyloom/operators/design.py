"""Survey designs: estimates with standard errors over many sub-populations.

A design holds a DataFrame of person rows. ``sums`` reads it once for any
number of blocks and groups. Persons with the same keys and the same pattern
(blocks they are in, whole-number inputs, inputs that are missing or below a
median) differ in their weights only, so they first collapse to one row with a
sum for each weight; this combines on the map side. Only the patterns are spread
over replicates and blocks. Everything after that works on one row per key and replicate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.money import share
from surveyloom.operators import quantile
from surveyloom.operators.gram import row_rank
from surveyloom.operators.joins import in_list, join_on
from surveyloom.operators.measures import Block, Measure
from surveyloom.operators.tquantile import t_quantile_column
from surveyloom.sources.staging import stage

REPLICATE = "_r"
# Whole-stage code generation stops above 100 columns, keys and weight included.
MAX_COLUMNS_PER_PASS = 100


def _as_blocks(by, measures, where, domains) -> dict[str, Block]:
    if domains is None:
        return {"all": Block(tuple(measures), where)}
    return {
        label: Block(tuple(measures), cond if where is None else (where if cond is None else where & cond))
        for label, cond in domains.items()
    }


def _rows_name(label: str) -> str:
    """Column that counts the rows of a block; a group without any has no estimate of it."""
    return f"{label}__rows"


def _any_block(blocks: Mapping[str, Block]) -> Column | None:
    conds = [b.where for b in blocks.values()]
    return None if any(c is None for c in conds) else reduce(Column.__or__, conds)


def _median_column(label: str, var: str) -> str:
    return f"_m__{label}__{var}"


def _terms(block: Block) -> list[tuple[str, str]]:
    """Sums that the measures of one block need, each once."""
    need: list[tuple[str, str]] = [("w", "")]
    for m in block.measures:
        if m.column is None:
            continue
        if m.kind == "total":
            need.append(("wx", m.column))
        elif m.kind == "mean":
            need += [("wx", m.column), ("wk", m.column)]
        else:
            need += [("le", m.column), ("wk", m.column)]
        if m.strict and m.column is not None:
            need.append(("null", m.column))
    return list(dict.fromkeys(need))


def _term_name(label: str, term: tuple[str, str]) -> str:
    return f"{label}__{term[0]}__{term[1]}"


def _term(kind: str, var: str = "") -> Column:
    return F.col(_term_name("", (kind, var)))


def _theta(m: Measure) -> Column:
    if m.column is None:
        return _term("w")
    if m.kind == "total":
        return _term("wx", m.column)
    return share(_term("wx" if m.kind == "mean" else "le", m.column), _term("wk", m.column))


def _unless_null_input(m: Measure, value: Column) -> Column:
    if not (m.strict and m.column is not None):
        return value
    return F.when(F.max(_term("null", m.column)) == 0, value)


def _median_members(blocks: Mapping[str, Block]) -> dict[str, dict]:
    """Row condition and median inputs of the blocks that have medians."""
    return {
        label: {"where": b.where, "columns": b.columns_of("median")}
        for label, b in blocks.items()
        if b.columns_of("median")
    }


class ReplicateSums:
    """Sums per key and replicate (0 is the base weight), finished block by block."""

    def __init__(self, df: DataFrame, keys: list[str], blocks: dict[str, Block], scale: float):
        self.df, self.keys, self.blocks, self.scale = df, keys, blocks, scale

    def staged(self, name: str = "sums") -> ReplicateSums:
        """The same sums as a written table, for use in several results."""
        return ReplicateSums(stage(self.df, name), self.keys, self.blocks, self.scale)

    def _present(self, label: str) -> Column:
        return F.col(_rows_name(label)) > 0

    def _select(self, label: str, by: Sequence[str] | None, measures: Sequence[Measure] | None):
        block = self.blocks[label]
        if measures is not None:
            block = Block(tuple(measures), block.where)
        terms = _terms(block)
        df = self.df.where(self._present(label)).select(
            *self.keys, REPLICATE, *[F.col(_term_name(label, t)).alias(_term_name("", t)) for t in terms]
        )
        keys = self.keys if by is None else list(by)
        if keys != self.keys:
            # Sums over replicates add up, so a coarser grouping needs no second scan.
            names = [_term_name("", t) for t in terms]
            df = df.groupBy(*keys, REPLICATE).agg(*[F.sum(c).alias(c) for c in names])
        return df, keys, block

    def block(self, label: str, by: Sequence[str] | None = None, measures: Sequence[Measure] | None = None) -> DataFrame:
        """Estimates of one block: the keys, then ``X`` and ``X_se`` columns."""
        df, keys, block = self._select(label, by, measures)
        return self._finish(df, keys, block.measures)

    def stacked(self, name: str = "domain", labels: Sequence[str] | None = None) -> DataFrame:
        """All blocks that share one list of measures, as rows of one table."""
        labels = list(self.blocks) if labels is None else list(labels)
        first = self.blocks[labels[0]]
        if any(tuple(self.blocks[x].measures) != tuple(first.measures) for x in labels):
            raise ValueError("stacked blocks need the same measures")
        terms = _terms(first)
        per_block = [
            F.struct(F.lit(x).alias(name), self._present(x).alias("_here"), *[F.col(_term_name(x, t)).alias(_term_name("", t)) for t in terms])
            for x in labels
        ]
        rows = self.df.select(*self.keys, REPLICATE, F.inline(F.array(*per_block))).where("_here")
        return self._finish(rows, [name, *self.keys], first.measures)

    def _finish(self, df, keys, measures):
        theta = {m.name: f"_e_{m.name}" for m in measures}
        est = df.withColumns({theta[m.name]: _theta(m) for m in measures})
        # At most one row per replicate and key meets in a window partition.
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        base = F.col(REPLICATE) == 0
        est = est.withColumns({f"_b_{m.name}": F.max(F.when(base, F.col(theta[m.name]))).over(w) for m in measures})
        aggs: list[Column] = []
        for m in measures:
            t, b = F.col(theta[m.name]), F.col(f"_b_{m.name}")
            se = F.sqrt(F.lit(self.scale) * F.sum(F.when(~base, (t - b) * (t - b))))
            undefined = F.count_if(t.isNull())
            aggs.append(_unless_null_input(m, F.max(b)).alias(m.name))
            aggs.append(_unless_null_input(m, F.when(undefined == 0, se)).alias(f"{m.name}_se"))
        grouped = est.groupBy(*keys).agg(*aggs)
        with_medians = [m for m in measures if m.kind == "median"]
        return self._put_medians(grouped, keys, with_medians) if with_medians else grouped

    def _put_medians(self, est: DataFrame, keys: list[str], measures: Sequence[Measure]) -> DataFrame:
        raise ValueError("a median belongs to the grouping it was computed for; use estimate()")


@dataclass(frozen=True)
class Patterns:
    """Persons collapsed by keys and pattern: columns of the pattern, the bit of each condition, inputs that have sums of their own."""

    df: DataFrame
    names: list[str]
    bits: Mapping[tuple[str, ...], int]
    others: list[str]

    def holds(self, *condition: str) -> Column:
        return quantile.has_bit(self.bits[condition])


class ReplicateDesign:
    """Person rows with a base weight and replicate weights.

    The standard error is ``sqrt(scale * sum_r (theta_r - theta_0)^2)``;
    ``scale`` defaults to ``4 / R``, the successive-difference rule.
    """

    def __init__(
        self,
        df: DataFrame,
        weight: str,
        replicates: Sequence[str] | str,
        scale: float | None = None,
        count: int | None = None,
        degrees: str = "count",
    ):
        """``replicates`` names the weight columns, or one array column of ``count`` weights.

        The count of an array is required; rows with another number of weights fail.
        The degrees of freedom of a median's limits are the number of persons or, where that is
        less, of replicates, minus one. ``degrees="rank"`` puts the rank of the replicate weights
        of all persons of the design in the place of their number (one small job).
        """
        if degrees not in ("count", "rank"):
            raise ValueError(f"degrees are by 'count' or 'rank', not {degrees!r}")
        if isinstance(replicates, str) and count is None:
            raise ValueError("an array of replicate weights needs its count")
        self.df, self.weight, self.degrees = df, weight, degrees
        self.replicates = replicates if isinstance(replicates, str) else list(replicates)
        self.count = count if isinstance(replicates, str) else len(self.replicates)
        self.scale = 4.0 / self.count if scale is None else scale

    def where(self, cond: Column) -> ReplicateDesign:
        return ReplicateDesign(self.df.where(cond), self.weight, self.replicates, self.scale, self.count, self.degrees)

    def _independent_replicates(self) -> int:
        if self.degrees == "count":
            return self.count
        return row_rank(self.df, self._replicate_weights(), self.count)

    def _replicate_weights(self) -> Column:
        if isinstance(self.replicates, str):
            weights = F.col(self.replicates)
            wrong = F.raise_error(F.format_string("expected %d replicate weights, found %d", F.lit(self.count), F.size(weights)))
            return F.when(F.size(weights) == self.count, weights).otherwise(wrong)
        return F.array(*[F.col(c).cast("double") for c in self.replicates])

    def _all_weights(self) -> Column:
        return F.concat(F.array(F.col(self.weight).cast("double")), self._replicate_weights())

    def _is_whole(self, column: str) -> bool:
        return isinstance(self.df.schema[column].dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType))

    def _patterns(self, keys: list[str], blocks: Mapping[str, Block], medians: DataFrame | None) -> Patterns:
        """Persons collapsed by keys and pattern, with the sum of each weight, and of each weight times each other input."""
        terms = dict.fromkeys(term for b in blocks.values() for term in _terms(b))
        conds: dict[tuple[str, ...], Column | None] = {("block", x): b.where for x, b in blocks.items()}
        conds |= {("known", v): quantile.number(v).isNotNull() for kind, v in terms if kind in ("wk", "null")}
        for label, block in blocks.items():
            for v in block.columns_of("median"):
                below = quantile.number(v) <= F.col(_median_column(label, v))
                conds["le", label, v] = below if block.where is None else block.where & below
        inputs = list(dict.fromkeys(v for kind, v in terms if kind == "wx"))
        whole = [v for v in inputs if self._is_whole(v)]
        others = [v for v in inputs if v not in whole]
        base = _any_block(blocks)
        persons = self.df if base is None else self.df.where(base)
        if medians is not None:
            persons = join_on(persons, medians, keys, "left")
        # One array holds the pattern: generated code counts columns.
        pattern = [*quantile.membership_masks(list(conds.values())), *[F.col(v).cast("long") for v in whole]]
        factors = [F.struct(F.lit(i).alias("_v"), x.alias("_x")) for i, x in enumerate([F.lit(1.0), *[quantile.number(v) for v in others]])]
        slim = persons.select(*keys, F.array(*pattern).alias("_p"), self._all_weights().alias("_ws"), F.array(*factors).alias("_vs"))
        weight = [F.col("_ws")[r] for r in range(self.count + 1)]
        if others:
            rows = slim.select(*keys, "_p", "_ws", F.inline("_vs")).where(F.col("_x").isNotNull())
            weight = [w * F.col("_x") for w in weight]
        else:
            rows = slim.withColumn("_v", F.lit(0))
        sums = [F.sum(w).alias(f"_s{r}") for r, w in enumerate(weight)]
        collapsed = rows.groupBy(*keys, "_p", "_v").agg(F.count("*").alias("_n"), *sums)
        masks = quantile.mask_names(len(conds))
        names = [*masks, *[f"_f_{v}" for v in whole]]
        flat = collapsed.select(
            *keys, "_v", "_n", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)], F.array(*[f"_s{r}" for r in range(self.count + 1)]).alias("_ws")
        )
        return Patterns(flat, names, {c: i for i, c in enumerate(conds)}, others)

    def sums(self, by: Sequence[str], blocks: Mapping[str, Block], medians: DataFrame | None = None) -> ReplicateSums:
        """One pass over the persons for all blocks."""
        keys, blocks = list(by), dict(blocks)
        return self._spread(keys, blocks, self._patterns(keys, blocks, medians))

    def _spread(self, keys: list[str], blocks: dict[str, Block], patterns: Patterns) -> ReplicateSums:
        """Sums of every block per key and replicate, from the patterns."""
        width = [len(_terms(b)) + 1 for b in blocks.values()]
        if sum(width) + len(keys) + 3 > MAX_COLUMNS_PER_PASS and len(blocks) > 1:
            return self._spread_in_passes(keys, blocks, patterns)
        long = patterns.df.select(*keys, "_v", "_n", *patterns.names, F.posexplode("_ws").alias(REPLICATE, "_w"))
        weights_alone = F.col("_v") == 0
        sums: dict[str, Column] = {}
        for label, block in blocks.items():
            here = patterns.holds("block", label)
            inside = here & weights_alone
            sums[_rows_name(label)] = F.when(inside, F.col("_n")).otherwise(F.lit(0))
            for kind, var in _terms(block):
                if kind == "w":
                    value = F.when(inside, F.col("_w"))
                elif kind == "wx" and var in patterns.others:
                    value = F.when(here & (F.col("_v") == patterns.others.index(var) + 1), F.col("_w"))
                elif kind == "wx":
                    value = F.when(inside, F.col("_w") * F.col(f"_f_{var}"))
                elif kind == "wk":
                    value = F.when(inside & patterns.holds("known", var), F.col("_w"))
                elif kind == "null":
                    value = F.when(inside & ~patterns.holds("known", var), F.col("_n").cast("double"))
                else:
                    value = F.when(weights_alone & patterns.holds("le", label, var), F.col("_w"))
                # Never NULL: the generated code of a wide sum is several times faster then.
                sums[_term_name(label, (kind, var))] = F.coalesce(value, F.lit(0.0))
        inputs = long.select(*keys, REPLICATE, *[c.alias(n) for n, c in sums.items()])
        df = inputs.groupBy(*keys, REPLICATE).agg(*[F.sum(n).alias(n) for n in sums])
        return ReplicateSums(df, keys, blocks, self.scale)

    def _spread_in_passes(self, keys: list[str], blocks: dict[str, Block], patterns: Patterns) -> ReplicateSums:
        """Halve the blocks until each pass fits; the persons are collapsed once, and only small results are joined."""
        labels = list(blocks)
        half = len(labels) // 2
        low, high = (self._spread(keys, {x: blocks[x] for x in part}, patterns).df for part in (labels[:half], labels[half:]))
        on = [*keys, REPLICATE]
        both = join_on(low, high, on, "full_outer")
        df = both.select(*on, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in both.columns if c not in on])
        return ReplicateSums(df, keys, blocks, self.scale)

    def estimate(
        self,
        by: Sequence[str],
        measures: Sequence[Measure],
        where: Column | None = None,
        domains: Mapping[str, Column | None] | None = None,
        name: str = "domain",
    ) -> DataFrame:
        """Estimates per group, or per domain and group when domains are given.

        Lazy for totals and means. With medians, two small results (medians
        and replicate sums) are written to the staging folder on the way.
        """
        blocks = _as_blocks(by, measures, where, domains)
        sums = self.estimate_sums(by, blocks)
        return sums.block("all") if domains is None else sums.stacked(name)

    def _medians(self, keys: list[str], blocks: Mapping[str, Block], keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Histogram, bucket totals, and medians per ``(block, var, *keys)``; ``keep`` stages the totals too, for later limits."""
        members = _median_members(blocks)
        base = _any_block({x: blocks[x] for x in members})
        persons = self.df if base is None else self.df.where(base)
        group = ["_block", "_var", *keys]
        hist = stage(quantile.weight_histogram(persons, keys, self.weight, members), "histogram")
        buckets = quantile.bucket_totals(hist, group)
        if keep:
            buckets = stage(buckets, "bucket_totals")
        return hist, buckets, quantile.locate(hist, buckets, group, F.lit(0.5), "_median")

    def medians(self, by: Sequence[str], measures: Sequence[Measure], where: Column | None = None) -> DataFrame:
        """Medians alone: no replicate weight is read; the histogram and small tables are staged on the way."""
        names = {m.column: m.name for m in measures}
        _, _, mid = self._medians(list(by), {"all": Block(tuple(measures), where)})
        return mid.groupBy(*by).agg(
            *[F.max(F.when(F.col("_var") == v, F.col("_median"))).alias(name) for v, name in names.items()]
        )

    def estimate_sums(self, by: Sequence[str], blocks: Mapping[str, Block]) -> ReplicateSums:
        """Like ``sums``, and able to finish medians."""
        keys = list(by)
        members = _median_members(blocks)
        if not members:
            return self.sums(keys, blocks)
        hist, buckets, mid = self._medians(keys, blocks, keep=True)
        mid = stage(mid, "medians")
        # One row per key; Catalyst broadcasts it only while the written size is small.
        wide = mid.groupBy(*keys).agg(
            *[
                F.max(F.when((F.col("_block") == x) & (F.col("_var") == v), F.col("_median"))).alias(_median_column(x, v))
                for x, spec in members.items()
                for v in spec["columns"]
            ]
        )
        plain = self.sums(keys, blocks, stage(wide, "medians_by_key")).staged("sums_with_medians")
        return MedianSums(plain, self._independent_replicates(), mid, hist, buckets)


class MedianSums(ReplicateSums):
    """Replicate sums that also know the medians and where to look for limits."""

    def __init__(self, sums: ReplicateSums, independent: int, mid: DataFrame, hist: DataFrame, buckets: DataFrame):
        super().__init__(sums.df, sums.keys, sums.blocks, sums.scale)
        self.independent, self.mid, self.hist, self.buckets = independent, mid, hist, buckets

    def block(self, label, by=None, measures=None):
        df, keys, block = self._select(label, by, measures)
        if keys != self.keys and block.columns_of("median"):
            raise ValueError("medians cannot be rolled up; estimate them for these keys")
        rows = df.select(F.lit(label).alias("_block"), "*")
        return self._finish(rows, ["_block", *keys], block.measures).drop("_block")

    def stacked(self, name="domain", labels=None):
        return super().stacked("_block", labels).withColumnRenamed("_block", name)

    def _put_medians(self, est, keys, measures):
        """Woodruff limits: share of weight below the median, turned back to values."""
        group = ["_block", "_var", *self.keys]
        by_var = {m.column: m for m in measures}
        shares = est.select(
            *keys,
            F.inline(F.array(*[F.struct(F.lit(v).alias("_var"), F.col(f"{m.name}_se").alias("_se_p")) for v, m in by_var.items()])),
        )
        df = F.least(F.lit(self.independent), F.col("_rows")) - 1
        known = (
            join_on(self.mid, shares, group, "inner")
            .withColumn("_t", t_quantile_column(df, max(1, self.independent - 1)))
            .withColumn("_h", F.col("_t") * F.col("_se_p"))
        )
        sides = known.where(F.col("_h").isNotNull()).select(
            *group,
            F.inline(
                F.array(
                    F.struct(F.lit("lo").alias("_side"), (0.5 - F.col("_h")).alias("_share")),
                    F.struct(F.lit("hi").alias("_side"), (0.5 + F.col("_h")).alias("_share")),
                )
            ),
        )
        near = join_on(self.buckets, sides, group, "inner")
        limits = quantile.locate(self.hist, near, group, F.col("_share"), "_x", extra=["_side"])
        width = limits.groupBy(*group).agg((F.max("_x") - F.min("_x")).alias("_width"))
        found = join_on(known, width, group, "left").withColumn("_se", F.col("_width") / (2 * F.col("_t")))
        wide = found.groupBy(*keys).agg(
            *[F.max(F.when(F.col("_var") == v, F.col("_median"))).alias(f"_m_{v}") for v in by_var],
            *[F.max(F.when(F.col("_var") == v, F.col("_se"))).alias(f"_s_{v}") for v in by_var],
        )
        medians = {m.name: f"_m_{m.column}" for m in measures} | {f"{m.name}_se": f"_s_{m.column}" for m in measures}
        joined = join_on(est, wide, keys, "left")
        return joined.select(*[F.col(medians.get(c, c)).alias(c) for c in est.columns])


class LinearDesign:
    """Person rows with one weight and independent sampling of persons.

    Variances are by linearisation, with the row count of the whole filtered
    design: ``n / (n - 1) * (sum z^2 - (sum z)^2 / n)``.
    """

    def __init__(self, df: DataFrame, weight: str):
        self.df, self.weight = df, weight

    def estimate(
        self,
        by: Sequence[str],
        measures: Sequence[Measure],
        where: Column | None = None,
        domains: Mapping[str, Column | None] | None = None,
        name: str = "domain",
        among: tuple[DataFrame, str, str] | None = None,
    ) -> DataFrame:
        """Estimates per group, or per domain and group when domains are given.

        ``among`` restricts the design, and so its row count, to the codes of a list: the list, the grouping
        column that holds a code, and the list's column. It meets the collapsed rows, never the persons.
        """
        if among is not None and among[1] not in by:
            raise ValueError(f"{among[1]} is not a grouping column")
        if any(m.kind == "median" for m in measures):
            raise ValueError("medians need a replicate design")
        keys, blocks = list(by), _as_blocks(by, measures, where, domains)
        base = _any_block(blocks)
        persons = self.df if base is None else self.df.where(base)
        variables = list(dict.fromkeys(m.column for m in measures if m.column))
        # Persons collapse by keys and membership pattern; only the collapsed rows are copied to their domains.
        masks = quantile.mask_names(len(blocks))
        w = F.col("_w")
        slim = persons.select(
            *keys,
            F.col(self.weight).cast("double").alias("_w"),
            *[quantile.number(v).alias(f"_x_{v}") for v in variables],
            *quantile.membership_masks([b.where for b in blocks.values()]),
        )
        aggs = {"_n": F.count("*"), "_sw": F.sum(w), "_sww": F.sum(w * w)}
        for v in variables:
            x = F.col(f"_x_{v}")
            known = x.isNotNull()
            aggs |= {
                f"_null_{v}": F.count_if(x.isNull()),
                f"_wx_{v}": F.coalesce(F.sum(w * x), F.lit(0.0)),
                f"_wwx_{v}": F.coalesce(F.sum(w * w * x), F.lit(0.0)),
                f"_wwxx_{v}": F.coalesce(F.sum(w * w * x * x), F.lit(0.0)),
                f"_wk_{v}": F.coalesce(F.sum(F.when(known, w)), F.lit(0.0)),
                f"_wwk_{v}": F.coalesce(F.sum(F.when(known, w * w)), F.lit(0.0)),
            }
        patterns = slim.groupBy(*keys, *masks).agg(*[c.alias(n) for n, c in aggs.items()])
        if among is not None:
            patterns = in_list(patterns, *among)
        inside = F.array_compact(F.array(*[F.when(quantile.has_bit(i), F.lit(x)) for i, x in enumerate(blocks)]))
        copies = patterns.select(*keys, *aggs, F.explode(inside).alias(name))
        groups = copies.groupBy(name, *keys).agg(*[F.sum(n).alias(n) for n in aggs])
        # One row per domain, and the domains are program text: a bounded side.
        sizes = groups.groupBy(name).agg(F.sum("_n").cast("double").alias("_rows"))
        groups = groups.join(F.broadcast(sizes), name)
        n = F.col("_rows")

        def se(square: Column, linear: Column | float) -> Column:
            linear = linear if isinstance(linear, Column) else F.lit(linear)
            return F.sqrt(F.greatest(F.try_divide(n, n - 1) * (square - linear * linear / n), F.lit(0.0)))

        out: list[Column] = []
        for m in measures:
            v = m.column
            if v is None:
                est, err = F.col("_sw"), se(F.col("_sww"), F.col("_sw"))
            elif m.kind == "total":
                est, err = F.col(f"_wx_{v}"), se(F.col(f"_wwxx_{v}"), F.col(f"_wx_{v}"))
            else:
                k = F.col(f"_wk_{v}")
                est = share(F.col(f"_wx_{v}"), k)
                square = F.col(f"_wwxx_{v}") - 2 * est * F.col(f"_wwx_{v}") + est * est * F.col(f"_wwk_{v}")
                err = F.try_divide(se(square, 0.0), k)
            if m.strict and v is not None:
                ok = F.col(f"_null_{v}") == 0
                est, err = F.when(ok, est), F.when(ok, err)
            out += [est.alias(m.name), err.alias(f"{m.name}_se")]
        return groups.select(*([name] if domains is not None else []), *keys, *out)
