"""Quality rules whose cutoffs are chosen under a bound on false rejection, in built-in functions only.

Every rule rejects a document if one statistic of its text is above a cutoff.
Cutoffs come from labelled documents: in each stratum (the language) and for each
rule, the lowest cutoff of a fixed grid for which an exact binomial test shows that
good documents are rejected at a rate of at most ``max_false_rejection / rules``.
The test is the Clopper-Pearson bound turned round: with ``k`` of ``n`` good
documents above the cutoff, the rate is proven if ``P(Bin(n, rate) <= k)`` is at most
the level. The level is ``error`` divided by strata x rules. Within one rule the
cutoffs are tested from the highest down until one fails, a fixed sequence, which
needs no further division; lower cutoffs reject more, so the last one proven is the
lowest one proven. By the union bound all rules together reject at most
``max_false_rejection`` of the good documents of every stratum, with confidence
``1 - error``. A stratum with too few labels proves nothing and rejects nothing.

Rules for odd input: NULL text counts as empty; an empty text has no words and
fails the base rule; a NULL language is a stratum; labels without a document, or
with NULL quality, are not used; a document labelled twice is good only if all its
labels say so; repeated documents count each. Without labels nothing but the base
rule rejects. Only the columns named below are read or returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.sources.staging import stage

SPACE = r"\x20\x09-\x0D"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# A window's place in its text takes these low bits of a sort key: 2^30 words fill a text of the largest size.
PLACE_BITS = 30
# Statistic of each rule, made from the columns of text_statistics().
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
}
# Cutoffs that may be chosen, the same for all rules.
GRID = [i / 100 for i in range(1, 20)] + [i / 20 for i in range(4, 20)]


def _count_of(text: Column, char_class: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, char_class, ""))).cast("long")


def _equal_neighbours(sorted_keys: Column, key) -> Column:
    """Places in a sorted array whose key equals the one before or after."""
    last = F.size(sorted_keys) - 1

    def same(i: Column) -> Column:
        here = key(F.get(sorted_keys, i))
        return ((i > 0) & (key(F.get(sorted_keys, i - 1)) == here)) | ((i < last) & (key(F.get(sorted_keys, i + 1)) == here))

    return F.when(last > 0, F.filter(F.sequence(F.lit(0), last), same)).otherwise(F.array().cast("array<int>"))


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of every whole text.

    A repeated three-word window is found by sorting hashes of the windows; the
    windows whose hashes meet are compared as words, so the count is exact.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    words = docs.select(
        *keep,
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"),
        lines.alias("_lines"),
        _count_of(text, r"[#*$%&|<>]").alias("n_symbols"),
        _count_of(text, r"[A-Z]").alias("n_capitals"),
        _count_of(text, r"[!?]").alias("n_marks"),
        _count_of(text, r"[0-9]").alias("n_digits"),
    )
    w = F.col("_words")
    counts = [
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        "n_marks",
        "n_digits",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    ]

    def packed(i: Column) -> Column:
        hashed = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed)).otherwise(F.array().cast("array<bigint>"))
    hashed = words.select(*counts, "_words", windows.alias("_windows"))
    in_order = hashed.withColumn("_windows", F.sort_array("_windows"))
    s = F.col("_windows")
    met = in_order.withColumn("_met", _equal_neighbours(s, lambda x: F.shiftright(x, PLACE_BITS)))

    def spelled(i: Column) -> Column:
        at = F.get(s, i).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, at), F.get(w, at + 1), F.get(w, at + 2)).alias("words"), at.alias("at"))

    spelled_out = met.withColumn("_met", F.sort_array(F.transform("_met", spelled)))
    m = F.col("_met")
    places = spelled_out.withColumn("_places", _equal_neighbours(m, lambda x: x["words"])).withColumn(
        "_places", F.sort_array(F.transform("_places", lambda i: F.get(m, i)["at"]))
    )
    p = F.col("_places")
    # A place covers three words, or as many as there are before the next place.
    covered = F.aggregate(
        F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda n, i: n + F.least(F.lit(3), F.get(p, i + 1) - F.get(p, i)),
    )
    repeat = F.when(F.size(p) > 0, covered + 3).otherwise(F.lit(0).cast("long"))
    names = [c if isinstance(c, str) else None for c in counts]
    kept = [n for n in names if n] + ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    return places.select(*dict.fromkeys(kept), repeat.alias("n_repeat_words"))


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """``P(Bin(n, rate) <= k)``, summed term by term in logarithms; 1 where k is above its mean."""
    odds = math.log(rate) - math.log1p(-rate)
    zero = F.struct((n * math.log1p(-rate)).cast("double").alias("log_term"), F.lit(0.0).alias("total"))

    def add(a: Column, j: Column) -> Column:
        log_next = a["log_term"] + F.log((n - j) / (j + 1.0)) + odds
        return F.struct(F.when(j < n, log_next).otherwise(a["log_term"]).alias("log_term"), (a["total"] + F.exp(a["log_term"])).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), zero, add, lambda a: a["total"])
    return F.when(k <= n * rate, total).otherwise(F.lit(1.0))


def choose_cutoffs(
    labelled: DataFrame, stratum: str, max_false_rejection: float = 0.02, error: float = 0.05
) -> DataFrame:
    """One row for each stratum: ``_stratum`` and the cutoff of each rule, NULL where none is proven.

    ``labelled`` holds good documents only, with the statistics of RULES as columns.
    """
    rate = max_false_rejection / len(RULES)
    # A document is above the first `level` cutoffs of the grid.
    level = [
        F.struct(F.lit(r).alias("rule"), F.array_size(F.filter(F.array(*map(F.lit, GRID)), lambda c: F.col(r) > c)).alias("level")) for r in RULES
    ]
    counts = labelled.select(F.col(stratum).alias("_stratum"), F.inline(F.array(*level))).groupBy("_stratum", "rule", "level").agg(F.count("*").alias("n"))
    per_rule = counts.groupBy("_stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("level", "n")).alias("levels")  # one entry for each cutoff at most
    )

    def above(i: Column) -> Column:
        return F.aggregate(
            F.filter("levels", lambda x: x["level"] > i), F.lit(0).cast("long"), lambda a, x: a + x["n"]
        )

    tested = per_rule.withColumn("tests", F.count("*").over(Window.partitionBy(F.lit(0)))).select(
        "_stratum", "rule", "n", "tests", F.posexplode(F.array(*map(F.lit, GRID))).alias("i", "cutoff"), "levels"
    )
    proven = tested.where(binomial_at_most(above(F.col("i")), F.col("n"), rate) <= error / F.col("tests"))
    best = [F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES]
    return proven.groupBy("_stratum").agg(*best)


def apply_quality_rules(
    docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, error: float = 0.05
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the name of the ``failed_rules``.

    The statistics are staged, since the cutoffs and the verdicts both read them.
    """
    stats = text_statistics(docs, ["doc_id", "lang"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stage(stats.withColumn("base_failed", failed), "quality").withColumns({r: F.expr(sql) for r, sql in RULES.items()})
    good = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(F.min("quality").alias("_quality"))
        .where("_quality = 1")
    )
    labelled = stats.where("not base_failed").join(good, stats["doc_id"] == good["_labelled"])
    cutoffs = choose_cutoffs(labelled, "lang", max_false_rejection, error)
    judged = stats.join(cutoffs, stats["lang"].eqNullSafe(cutoffs["_stratum"]), "left")
    breaks = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in RULES]))
    return judged.select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size(breaks) == 0)).alias("kept"), breaks.alias("failed_rules")
    )
