"""Survey data derived from the given tables by rule.

Every order line is a person; the part is the occupation. The rules are plain
SQL text that Spark and the checking engine read alike, so both start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLICATES = "PWGTPR"
BASE = "PWGTP"

_CODE = "'15' || lpad(substr(p_brand, 7), 2, '0') || substr(p_type, 1, 2)"

# Person columns with the names of the census codebook.
PERSON = {
    "SOCP": f"CASE WHEN p_size = 50 THEN NULL ELSE {_CODE} END",
    "AGEP": "CAST(14 + (7 * l_orderkey + 3 * l_linenumber + l_partkey) % 60 AS INT)",
    "SEX": "CAST(1 + (l_orderkey + l_linenumber) % 2 AS INT)",
    "ESR": "CAST(CASE (3 * l_orderkey + l_partkey) % 8 WHEN 7 THEN NULL WHEN 6 THEN 6 WHEN 5 THEN 3 ELSE 1 END AS INT)",
    "WKHP": "CAST(NULLIF(15 + (11 * l_orderkey + 5 * l_linenumber) % 50, 15) AS INT)",
    "WKW": "CAST(CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE 1 + (l_partkey + l_linenumber) % 6 END AS INT)",
    "PAOC": "CAST(NULLIF(1 + (l_orderkey + 2 * l_partkey) % 5, 5) AS INT)",
    "MAR": "CAST(1 + (l_suppkey + l_linenumber) % 5 AS INT)",
    "SCHL": "CAST(NULLIF(1 + (5 * l_partkey + 3 * l_orderkey + l_linenumber) % 25, 25) AS INT)",
    "SCH": "CAST(1 + (3 * l_orderkey + l_suppkey) % 3 AS INT)",
    "PINCP": "CASE WHEN l_orderkey % 17 = 3 THEN NULL ELSE CAST(FLOOR(l_extendedprice) AS DOUBLE) END",
    "WAGP": "CASE WHEN l_orderkey % 13 = 5 THEN NULL ELSE CAST(FLOOR(l_extendedprice) - 100 * (l_orderkey % 7) AS DOUBLE) END",
    "ADJINC": "CAST(1.0061 AS DOUBLE)",
    "SOCP10": f"CASE WHEN l_linenumber = 1 THEN 'N.A.//' WHEN l_linenumber = 2 THEN NULL ELSE {_CODE} END",
    "SOCP12": f"CASE WHEN l_linenumber = 1 THEN {_CODE} ELSE 'N.A.//' END",
}
# The same persons with the names of the harmonised codebook.
HARMONISED_PERSON = {
    "OCCSOC": PERSON["SOCP"],
    "YEAR": "CAST(2019 + l_orderkey % 2 AS INT)",
    "AGE": PERSON["AGEP"],
    "SEX": PERSON["SEX"],
    "EMPSTAT": PERSON["ESR"],
    "UHRSWORK": PERSON["WKHP"],
    "WKSWORK2": "CAST(1 + (l_partkey + l_linenumber) % 6 AS INT)",
    "NCHILD": "CAST((l_orderkey + 2 * l_partkey) % 4 AS INT)",
    "NCHLT5": "CAST((l_orderkey + l_suppkey) % 3 AS INT)",
    "MARST": "CAST(1 + (l_suppkey + l_linenumber) % 6 AS INT)",
    "EDUCD": "CAST(CASE WHEN l_orderkey % 31 = 0 THEN 999 ELSE 2 + (5 * l_partkey + 3 * l_orderkey) % 115 END AS INT)",
    "INCTOT": "CASE WHEN l_orderkey % 4001 = 3 THEN NULL ELSE CAST(FLOOR(l_extendedprice) AS DOUBLE) END",
    "PERWT": "CAST(6 * l_quantity AS DOUBLE)",
}
QUANTITY = "CAST(l_quantity AS BIGINT)"
TITLES = f"SELECT DISTINCT {_CODE} AS SOCCODE18, p_brand || ' ' || p_type AS OCC_TITLE FROM part WHERE p_brand <> 'Brand#25'"
PROMISING = (
    f"SELECT DISTINCT {_CODE} AS SOCCODE18 FROM part WHERE p_type IN ('LARGE', 'MEDIUM') "
    "AND CAST(substr(p_brand, 7) AS INT) % 3 = 0"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(lines: DataFrame) -> DataFrame:
    """Persons dealt out evenly, at every size, as the files of a survey are; the given table is one row group."""
    return lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lines_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = _spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


def with_weights(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Named columns plus the base weight and an array of 80 replicate weights.

    Weight r is ``q * (3 + (31 * orderkey + 17 * linenumber + 13 * r) % 7)``. The
    factor depends on the line through a remainder of 7 only, so it is looked up
    in a constant.
    """
    rows = (", ".join(f"{3 + (m + 13 * r) % 7}D" for r in range(1, 81)) for m in range(7))
    factors = F.expr("array(" + ", ".join(f"array({row})" for row in rows) + ")")
    kind = F.expr("CAST((31 * l_orderkey + 17 * l_linenumber) % 7 AS INT)")
    q = F.expr(f"CAST({QUANTITY} AS DOUBLE)")
    slim = df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()], q.alias("_q"), kind.alias("_kind"))
    return slim.select(
        *columns,
        (F.col("_q") * 6).alias(BASE),
        F.transform(F.element_at(factors, F.col("_kind") + 1), lambda f: f * F.col("_q")).alias(REPLICATES),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_weights(lines_with_parts(spark, sf_dir), PERSON)


def weighted_lines(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    """Order lines with survey weights, for single operators."""
    return with_weights(_spread(table(spark, sf_dir, "lineitem")), columns)


def harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_with_parts(spark, sf_dir).select(*[F.expr(sql).alias(n) for n, sql in HARMONISED_PERSON.items()])


def from_part(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_part(spark, sf_dir, TITLES)


def promising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_part(spark, sf_dir, PROMISING)
