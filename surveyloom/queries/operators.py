"""One query per operator, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions import cleaning, money, recode
from surveyloom.operators import distinct, gram, joins, ranking, reshape
from surveyloom.operators.design import LinearDesign, ReplicateDesign
from surveyloom.operators.measures import mean, median, total
from surveyloom.plans import codebooks, occupations, vintages
from surveyloom.queries import sqlgen, standin
from surveyloom.queries.standin import table
from surveyloom.sources import readers, records, writers
from surveyloom.sources.readers import cut_columns
from surveyloom.sources.staging import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison, after a shift by a hundredth of the last digit.

    Exact ties are common (a mean of two amounts); without the shift, the last bit of
    a sum, which depends on the order of the rows, decides which way they fall.
    """
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[F.round(F.col(f"`{c}`") + 10.0 ** -(digits + 2), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns]
    )


# -- sources and cleaning ---------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"
)
def scan_project(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    year = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (
        F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    )
    return lines.where(year).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


_CODED = (
    "CASE WHEN l_linenumber = 1 THEN repeat('b', CAST(1 + l_orderkey % 9 AS INT)) "
    "WHEN l_linenumber = 2 THEN '*' WHEN l_linenumber = 3 THEN '**' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9)) END"
)


@query(
    f"WITH t AS (SELECT l_orderkey, l_linenumber, {_CODED} AS code FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(code, 'b{1,8}') THEN NULL ELSE code END AS no_blank, "
    "CASE WHEN code IN ('*', '**') THEN NULL ELSE code END AS no_star, TRY_CAST(code AS DOUBLE) AS number FROM t"
)
def null_codes(spark, sf_dir):
    coded = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CODED).cast("string").alias("code"))
    code = F.col("code")
    return coded.select(
        "l_orderkey",
        "l_linenumber",
        cleaning.null_microdata_codes(code).alias("no_blank"),
        cleaning.null_if_any(code, cleaning.WAGE_NULL_CODES).alias("no_star"),
        cleaning.to_number(code).alias("number"),
    )


_LINE = (
    "lpad(CAST(p_partkey AS VARCHAR(12)), 12, ' ') || rpad(p_brand, 10, ' ') || rpad(p_type, 10, ' ') "
    "|| CASE WHEN p_size = 50 THEN '    ' ELSE lpad(CAST(p_size AS VARCHAR(4)), 4, ' ') END"
)


@query(
    "SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS size FROM part"
)
def fixed_width(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.expr(_LINE).cast("string").alias("value"))
    return cut_columns(lines, "value", _RECORD)


_RECORD = {
    "id": (1, 12, T.LongType()),
    "brand": (13, 10, T.StringType()),
    "kind": (23, 10, T.StringType()),
    "size": (33, 4, T.IntegerType()),
}


@query(
    "SELECT p_partkey AS id, p_type AS kind, CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS size FROM part "
    "WHERE p_size >= 10 AND p_size < 50 AND p_brand <> 'Brand#1' AND p_brand IN ('Brand#2', 'Brand#13', 'Brand#25')"
)
def fixed_records(spark, sf_dir):
    """Some columns of files of fixed records; three of the filters reach the scan."""
    path = new_folder(spark, "records")
    # 36 characters and the line end.
    table(spark, sf_dir, "part").select(F.expr(_LINE).cast("string").alias("value")).write.text(path)
    rows = records.read_records(spark, path, _RECORD, 37)
    wanted = (F.col("size") >= 10) & (F.col("brand") != "Brand#1") & F.col("brand").isin("Brand#2", "Brand#13", "Brand#25")
    return rows.where(wanted).select("id", "kind", "size")


@query(
    "SELECT n_name, r_name, CAST(n_nationkey AS INT) AS n_nationkey, 'x' || n_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def folder_tables(spark, sf_dir):
    """Two tables written as CSV files into one folder, read by name, joined by a code of text."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    code = F.concat(F.lit("x"), F.col("n_regionkey").cast("string"))
    folder = new_folder(spark, "folder")
    writers.write_tables(
        {
            "nation": nation.select("n_nationkey", "n_name", code.alias("region")),
            "region": region.select("r_name", F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("region")),
        },
        folder,
        "csv",
    )
    schemas = {
        "nation": ("nation", T.StructType().add("n_name", "string").add("region", "string").add("n_nationkey", T.IntegerType())),
        "region": ("region", T.StructType().add("region", "string").add("r_name", "string")),
    }
    tables = readers.read_folder(spark, folder, schemas)
    return tables["nation"].join(tables["region"], "region").select("n_name", "r_name", "n_nationkey", "region")


@query(
    "SELECT p_brand AS code, year(l_shipdate)::INT AS year, count(*) AS n, round(sum(l_quantity) + 1e-6, 4) AS quantity "
    "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1997) GROUP BY ALL"
)
def bucketed_extract(spark, sf_dir):
    """Persons in folders by year, bucketed by occupation; sums of two years without an exchange after the scan."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("code"), F.year("l_shipdate").alias("year"), "l_quantity"
    )
    extract = writers.write_bucketed(rows, new_folder(spark, "extract"), "code", 8, ["year"])
    wanted = extract.where(F.col("year").isin(1996, 1997))
    return rounded(wanted.groupBy("code", "year").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


@query(
    "SELECT p_partkey, CAST(CASE WHEN p_size >= 45 THEN '101.00' ELSE CAST(p_size AS VARCHAR) || '.50' END AS DOUBLE) AS hourly, "
    "CAST(CASE WHEN p_size >= 45 THEN '209000' ELSE CAST(p_size * 1000 AS VARCHAR) END AS DOUBLE) AS annual FROM part"
)
def top_code(spark, sf_dir):
    size = F.col("p_size")
    hourly = F.when(size >= 45, F.lit("#")).otherwise(F.concat(size.cast("string"), F.lit(".50")))
    annual = F.when(size >= 45, F.lit("#")).otherwise((size * 1000).cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        cleaning.parse_number(cleaning.replace_top_code(hourly, cleaning.HOURLY_TOP_CODE)).alias("hourly"),
        cleaning.parse_number(cleaning.replace_top_code(annual, cleaning.ANNUAL_TOP_CODE)).alias("annual"),
    )


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(
    f"SELECT o_orderkey, {_CENTS} / 100.0::DOUBLE AS amount, CAST(o_custkey % 100 AS DOUBLE) AS pct, "
    "CAST(NULL AS DOUBLE) AS nothing FROM orders"
)
def parse_number(spark, sf_dir):
    amount = F.concat(F.lit("about $"), F.format_number("o_totalprice", 2), F.lit(" a year"))
    pct = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        cleaning.parse_number(amount).alias("amount"),
        cleaning.parse_number(pct).alias("pct"),
        cleaning.parse_number(F.lit("n/a")).alias("nothing"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 1) AS l_quantity, NULLIF(l_extendedprice, 1) AS l_extendedprice, "
    "NULLIF(l_discount, 1) AS l_discount, NULLIF(l_tax, 1) AS l_tax, "
    "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus FROM lineitem"
)
def across_clean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").drop("l_partkey", "l_suppkey", "l_shipdate")
    numbers = cleaning.column_range(lines, "l_quantity", "l_tax")
    lines = cleaning.across(lines, lambda c: F.nullif(c, F.lit(1.0)), numbers)
    return cleaning.across(lines, lambda c: cleaning.null_if_any(c, ["N"]), only_strings=True)


@query(
    "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') || CAST(1000 + p_partkey % 9000 AS VARCHAR) || '-' || p_type AS code FROM part"
)
def code_normalise(spark, sf_dir):
    code = F.expr("lpad(CAST(p_size AS STRING), 2, '0') || '-' || CAST(1000 + p_partkey % 9000 AS STRING) || '-' || p_type")
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.remove_first(code).alias("code"))


@query(
    "SELECT p_partkey, p_name || ' \"' || p_brand || '\", new' AS title, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN '' "
    "ELSE p_type END AS code, CAST(p_size AS INT) AS size FROM part"
)
def csv_round_trip(spark, sf_dir):
    """Delimited text with quotes, commas, empty and missing fields, written by Spark's writer functions and parsed again."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.col("p_name"), F.lit(' "'), "p_brand", F.lit('", new')).alias("title"),
        F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("code"),
        F.col("p_size").alias("size"),
    )
    text = part.select(F.to_csv(F.struct(*part.columns), writers.TO_CSV).alias("line"))
    fields = F.from_csv("line", "p_partkey long, title string, code string, size int", writers.QUOTED)
    return text.select(fields.alias("f")).select("f.*")


# Texts of orders; in the order with the largest number three columns are wider than in all others.
_LATE = "(SELECT o_orderkey = max(o_orderkey) OVER () AS late, * FROM orders)"
_TEXTS = {
    "o_orderkey": "CAST(o_orderkey AS {text})",
    "amount": "CAST(CAST(floor(o_totalprice) AS BIGINT) AS {text}) || CASE WHEN late THEN '.5' ELSE '' END",
    "big": "CAST(o_custkey + CASE WHEN late THEN 3000000000 ELSE 0 END AS {text})",
    "mark": "CASE WHEN late THEN 'late, \"row\"' ELSE CAST(o_custkey % 9 AS {text}) END",
    "zip": "lpad(CAST(o_custkey % 1000 AS {text}), 5, '0')",
    "day": "CAST(CAST(o_orderdate AS DATE) AS {text})",
    "gaps": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS {text}) END",
    "nothing": "CAST(NULL AS {text})",
}


def _late_row_files(spark, sf_dir) -> str:
    """A folder of CSV files with a header, below the staging folder."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).scalar()
    rows = orders.withColumn("late", F.col("o_orderkey") == last)
    path = new_folder(spark, "late-row")
    writers.write_table(rows.select(*[F.expr(sql.format(text="STRING")).alias(n) for n, sql in _TEXTS.items()]), path, "csv")
    return path


def _late_row_counts(column: str, kind: str, fits: str, n_null: str = "0", example: str = "NULL") -> str:
    known = f"count(*) - ({n_null})"
    return (
        f"SELECT '{column}' AS \"column\", '{kind}' AS type, CAST({known} AS BIGINT) AS n_values, CAST({n_null} AS BIGINT) AS n_null, "
        + ", ".join(f"CAST({n} AS BIGINT) AS {c}" for c, n in zip(("n_int", "n_bigint", "n_double", "n_date"), fits.replace("all", known).split(", ")))
        + f", CAST({example} AS VARCHAR) AS text_example FROM orders"
    )


@query(
    " UNION ALL ".join(
        [
            _late_row_counts("o_orderkey", "int", "all, all, all, 0"),
            _late_row_counts("amount", "double", "all - 1, all - 1, all, 0"),
            _late_row_counts("big", "bigint", "all - 1, all, all, 0"),
            _late_row_counts("mark", "string", "all - 1, all - 1, all - 1, 0", example="'late, \"row\"'"),
            _late_row_counts("zip", "string", "0, 0, 0, 0", example="min(lpad(CAST(o_custkey % 1000 AS VARCHAR), 5, '0'))"),
            _late_row_counts("day", "date", "0, 0, 0, all"),
            _late_row_counts("gaps", "int", "all, all, all, 0", "count(*) FILTER (o_orderkey % 3 = 0)"),
            _late_row_counts("nothing", "string", "0, 0, 0, 0", "count(*)"),
        ]
    )
)
def inferred_types(spark, sf_dir):
    """Types of CSV files from all their rows: one late row widens three columns."""
    return readers.read_inferred(spark, _late_row_files(spark, sf_dir))[1]


_INFERRED_TYPES = {"o_orderkey": "INT", "amount": "DOUBLE", "big": "BIGINT", "day": "DATE", "gaps": "INT"}


@query(
    "SELECT "
    + ", ".join(f"CAST({sql.format(text='VARCHAR')} AS {_INFERRED_TYPES.get(n, 'VARCHAR')}) AS {n}" for n, sql in _TEXTS.items())
    + f" FROM {_LATE}"
)
def inferred_read(spark, sf_dir):
    """The same files, read with the types found."""
    return readers.read_inferred(spark, _late_row_files(spark, sf_dir))[0]


# -- indicators, recodes ------------------------------------------------------

_FLAGS = "WORKINGAGE FTEMP PTEMP FEM MAL MOM MOMYC SMOM SMOMYC LESSBACH BACHMORE EDATT_RC CNT".split()


def _persons(spark, sf_dir) -> DataFrame:
    """Stand-in persons with indicators and adjusted money."""
    return vintages.prepare_persons(standin.persons(spark, sf_dir), vintages.VINTAGE_2020)


@query(
    f"WITH {sqlgen.cte_persons()}, {sqlgen.cte_flags()} SELECT AGEP, SEX, ESR, PAOC, {', '.join(_FLAGS)}, count(*) AS n "
    "FROM persons GROUP BY ALL"
)
def person_flags(spark, sf_dir):
    flagged = codebooks.add_indicators(standin.persons(spark, sf_dir), codebooks.CENSUS)
    return flagged.groupBy("AGEP", "SEX", "ESR", "PAOC", *_FLAGS).agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, CASE WHEN p_size = 50 THEN 'Missing' WHEN p_size >= 41 THEN 'Bach or more' WHEN p_size >= 31 THEN "
    "'Some college' WHEN p_size >= 26 THEN 'Associate' WHEN p_size >= 16 THEN 'Some college' WHEN p_size >= 13 THEN "
    "'HS or GED' ELSE 'Less than HS' END AS tier FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS p_size FROM part)"
)
def education_tiers(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("size", F.expr("CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END"))
    size = F.col("size")
    rules = [
        (size == 50, "Missing"),
        (size >= 41, "Bach or more"),
        (size >= 31, "Some college"),
        (size >= 26, "Associate"),
        (size >= 16, "Some college"),
        (size >= 13, "HS or GED"),
    ]
    return parts.select("p_partkey", recode.first_match(rules, "Less than HS").alias("tier"))


@query(
    "WITH t AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 "
    "WHEN '5-LOW' THEN 4 END AS priority FROM orders) SELECT o_orderkey, o_orderpriority, CAST(priority AS INT) AS priority "
    "FROM t WHERE (priority <= 2 OR o_orderpriority = '5-LOW') AND o_totalprice >= 20000 AND o_orderstatus <> 'P'"
)
def ordinal_filter(spark, sf_dir):
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    orders = table(spark, sf_dir, "orders").withColumn("priority", recode.ordinal(F.col("o_orderpriority"), levels))
    keep = (F.col("priority") <= 2) | (F.col("o_orderpriority") == "5-LOW")
    return orders.where(keep & (F.col("o_totalprice") >= 20000) & (F.col("o_orderstatus") != "P")).select(
        "o_orderkey", "o_orderpriority", "priority"
    )


@query(
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1.006149 * 1.09257667 + 1e-6, 4) AS adjusted, "
    "round(l_extendedprice * 1.09257667 + 1e-6, 4) AS wage FROM lineitem"
)
def adjust_income(spark, sf_dir):
    price, adjustment = F.col("l_extendedprice"), F.lit(1.006149)
    v = vintages.VINTAGE_2015
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            vintages.adjusted(price, v, adjustment).alias("adjusted"),
            vintages.adjusted(price, v, adjustment, adjust=False).alias("wage"),
        )
    )


_PAIRS = {"Brand#1": "Brand#10", "Brand#2": "Brand#10", "Brand#3": "Brand#3X", "Brand#25": "Brand#2Y"}
_PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS.items()) + ")"


@query(
    f"SELECT p_partkey, p_brand, coalesce(b, p_brand) AS survey_code FROM part LEFT JOIN {_PAIRS_SQL} x(a, b) ON p_brand = a"
)
def crosswalk_fallback(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return joins.apply_crosswalk(parts, _PAIRS, "p_brand", "survey_code")


@query(
    "SELECT o_orderkey, CASE WHEN status IS NULL THEN NULL WHEN status = 'N.A.//' THEN o_orderpriority ELSE status END AS code "
    "FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'N.A.//' WHEN 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders)"
)
def sentinel_fallback(spark, sf_dir):
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'N.A.//' WHEN 'P' THEN NULL ELSE o_orderstatus END")
    code = recode.sentinel_fallback(status, vintages.NO_CODE, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))


# -- joins --------------------------------------------------------------------


@query(
    "SELECT o_orderkey, o_custkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"
)
def crosswalk_fanout(spark, sf_dir):
    """A code with several rows fans out; an order has seven lines at most."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.join_on(orders, lines, ["o_orderkey"], "left").select("o_orderkey", "o_custkey", "l_linenumber")


@query(
    "WITH c AS (SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k, count(*) AS customers FROM customer WHERE c_nationkey <> 5 GROUP BY ALL), "
    "s AS (SELECT CASE WHEN s_nationkey = 4 THEN NULL ELSE s_nationkey END AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey <> 6 GROUP BY ALL), "
    "n AS (SELECT n_nationkey AS k, n_name AS area FROM nation), "
    "a AS (SELECT coalesce(c.k, s.k) AS k, customers, suppliers FROM c FULL JOIN s ON c.k IS NOT DISTINCT FROM s.k) "
    "SELECT coalesce(a.k, n.k) AS nation, customers, suppliers, area FROM a FULL JOIN n ON a.k IS NOT DISTINCT FROM n.k"
)
def outer_merge3(spark, sf_dir):
    customers = (
        table(spark, sf_dir, "customer")
        .where("c_nationkey <> 5")
        .groupBy(F.expr("nullif(c_nationkey, 3)").alias("nation"))
        .agg(F.count("*").alias("customers"))
    )
    suppliers = (
        table(spark, sf_dir, "supplier")
        .where("s_nationkey <> 6")
        .groupBy(F.expr("nullif(s_nationkey, 4)").alias("nation"))
        .agg(F.count("*").alias("suppliers"))
    )
    nations = table(spark, sf_dir, "nation").withColumnsRenamed({"n_nationkey": "nation", "n_name": "area"}).drop("n_regionkey")
    return joins.fold_join([customers, suppliers, nations], ["nation"], "full_outer")


@query(
    "WITH c AS (SELECT c_custkey AS k, c_name AS title FROM customer WHERE c_custkey % 7 <> 0), "
    "o AS (SELECT o_custkey AS k, max(o_orderpriority) AS title FROM orders GROUP BY o_custkey) "
    "SELECT coalesce(c.k, o.k) AS code, c.title AS title_list, o.title AS title_found FROM c FULL JOIN o ON c.k = o.k"
)
def outer_compare(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("title"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.max("o_orderpriority").alias("title"))
    both = joins.join_on(listed, found, ["code"], "full_outer")
    return both.withColumnsRenamed({"title.x": "title_list", "title.y": "title_found"})


@query("SELECT c_custkey AS code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_codes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return joins.missing_from(expected, orders, "code", "o_custkey")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS title FROM lineitem LEFT JOIN "
    "(SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey"
)
def lookup_title(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    names = table(spark, sf_dir, "part").where("p_size < 40").select("p_partkey", F.col("p_name").alias("title"))
    return joins.add_title(lines, names, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "title")


@query(
    "WITH top AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) DESC, l_partkey LIMIT 50) "
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM top)"
)
def semi_join_list(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    sold = lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("sold"))
    best = ranking.top_n(sold, 50, "sold", ["l_partkey"])
    return joins.in_list(lines.select("l_orderkey", "l_linenumber", "l_partkey"), best, "l_partkey", "l_partkey")


# -- aggregation ----------------------------------------------------------------


@query(
    "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"
)
def first_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = ranking.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "SELECT l_returnflag, count(DISTINCT nullif(l_partkey, 7)) + max(CASE WHEN l_partkey = 7 THEN 1 ELSE 0 END) AS codes "
    "FROM lineitem GROUP BY l_returnflag"
)
def distinct_codes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr("nullif(l_partkey, 7L)").alias("code"))
    return lines.groupBy("l_returnflag").agg(ranking.distinct_count("code").cast("long").alias("codes"))


_LINES = f"src AS (SELECT *, {standin.QUANTITY} AS q, NULLIF(l_discount, 0) AS disc, CAST(l_linestatus = 'O' AS INT) AS open, CAST(floor(l_extendedprice) AS DOUBLE) AS price FROM lineitem)"


def _design(spark, sf_dir, degrees: str = "count") -> ReplicateDesign:
    columns = {c: c for c in "l_returnflag l_linestatus l_suppkey l_quantity l_shipdate".split()}
    columns |= {
        "disc": "nullif(l_discount, 0D)",
        "open": "CAST(l_linestatus = 'O' AS INT)",
        "price": "CAST(floor(l_extendedprice) AS DOUBLE)",
    }
    lines = standin.weighted_lines(spark, sf_dir, columns)
    return ReplicateDesign(lines, standin.BASE, standin.REPLICATES, count=80, degrees=degrees)


def _survey_sql(keys, measures, where="TRUE", digits=4, independent="80") -> str:
    return f"WITH {_LINES} SELECT * FROM {sqlgen.estimate('src', keys, measures, where, digits, independent)}"


_COUNT = [total("n")]
_TOTAL = [total("open_lines", "open"), total("qty", "l_quantity"), total("disc_total", "disc")]
_STRICT = [total("open_lines", "open", strict=True), total("disc_total", "disc", strict=True)]
_MEAN = [mean("mean_price", "price"), mean("mean_disc", "disc")]
_MEDIAN = [median("median_price", "price")]


@query(_survey_sql(["l_returnflag"], _COUNT))
def svy_count(spark, sf_dir):
    return rounded(_design(spark, sf_dir).estimate(["l_returnflag"], _COUNT))


@query(_survey_sql(["l_returnflag", "l_linestatus"], _TOTAL))
def svy_total(spark, sf_dir):
    return rounded(_design(spark, sf_dir).estimate(["l_returnflag", "l_linestatus"], _TOTAL))


@query(_survey_sql(["l_suppkey"], _STRICT))
def svy_total_strict(spark, sf_dir):
    return rounded(_design(spark, sf_dir).estimate(["l_suppkey"], _STRICT))


@query(_survey_sql(["l_returnflag", "l_linestatus"], _MEAN))
def svy_mean(spark, sf_dir):
    return rounded(_design(spark, sf_dir).estimate(["l_returnflag", "l_linestatus"], _MEAN))


_DOMAINS = {
    "all": "TRUE",
    "open": "l_linestatus = 'O'",
    "bulk": "l_quantity >= 25",
    "bulk open": "l_linestatus = 'O' AND l_quantity >= 25",
    "year 1997": "l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'",
    "one pair": "l_linestatus = 'F' AND l_suppkey = 7",
}


@query(
    f"WITH {_LINES} "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS domain, * FROM {sqlgen.estimate('src', ['l_returnflag'], [total('n'), *_TOTAL[:1]], c)}"
        for d, c in _DOMAINS.items()
    )
)
def domain_totals(spark, sf_dir):
    ntz = {d: F.expr(c.replace("TIMESTAMP ", "TIMESTAMP_NTZ ")) for d, c in _DOMAINS.items()}
    return rounded(_design(spark, sf_dir).estimate(["l_returnflag"], [total("n"), *_TOTAL[:1]], domains=ntz))


@query(
    f"WITH {_LINES}, c AS (SELECT l_suppkey, price, sum(6 * q) OVER (PARTITION BY l_suppkey ORDER BY price) AS c, "
    "sum(6 * q) OVER (PARTITION BY l_suppkey) AS t FROM src) SELECT l_suppkey, min(price) AS median_price FROM c WHERE c >= 0.5 * t GROUP BY 1"
)
def svy_median(spark, sf_dir):
    design = _design(spark, sf_dir)
    return design.medians(["l_suppkey"], _MEDIAN)


@query(_survey_sql(["l_suppkey"], _MEDIAN))
def svy_median_se(spark, sf_dir):
    return rounded(_design(spark, sf_dir).estimate(["l_suppkey"], _MEDIAN))


# The stand-in weights are multiples of seven rows that are independent of each other (a circulant matrix of 3 to 9).
@query(_survey_sql(["l_suppkey"], _MEDIAN, independent="(SELECT count(DISTINCT (31 * l_orderkey + 17 * l_linenumber) % 7) FROM lineitem)"))
def svy_median_rank_df(spark, sf_dir):
    """Degrees of freedom from the rank of the replicate weights."""
    return rounded(_design(spark, sf_dir, "rank").estimate(["l_suppkey"], _MEDIAN))


@query(
    f"WITH k AS (SELECT (31 * l_orderkey + 17 * l_linenumber) % 7 AS kind, sum(CAST({standin.QUANTITY} AS DOUBLE) * {standin.QUANTITY}) AS qq "
    "FROM lineitem GROUP BY 1) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, sum(qq * (3 + (kind + 13 * i) % 7) * (3 + (kind + 13 * j) % 7)) AS g "
    "FROM k CROSS JOIN range(1, 81) AS a(i) JOIN range(1, 81) AS b(j) ON i <= j GROUP BY 1, 2"
)
def replicate_gram(spark, sf_dir):
    """Gram matrix of the replicate weights; all its numbers are whole, so the sums are exact."""
    design = _design(spark, sf_dir)
    return gram.gram_matrix(design.df, F.col(standin.REPLICATES), 80)


_LINEAR = f"src AS (SELECT *, CAST(6 * {standin.QUANTITY} AS DOUBLE) AS w, NULLIF(l_discount, 0) AS disc, CAST(l_linestatus = 'O' AS INT) AS open, CAST(floor(l_extendedprice) AS DOUBLE) AS price FROM lineitem)"


def _linear(spark, sf_dir) -> LinearDesign:
    return LinearDesign(_design(spark, sf_dir).df, standin.BASE)


@query(
    f"WITH {_LINEAR} SELECT 'all' AS domain, * FROM {sqlgen.linear('src', ['l_returnflag'], [total('n'), *_TOTAL], 'w')} "
    f"UNION ALL SELECT 'bulk' AS domain, * FROM {sqlgen.linear('src', ['l_returnflag'], [total('n'), *_TOTAL], 'w', 'l_quantity >= 25')}"
)
def svy_lin_total(spark, sf_dir):
    domains = {"all": None, "bulk": F.col("l_quantity") >= 25}
    return rounded(_linear(spark, sf_dir).estimate(["l_returnflag"], [total("n"), *_TOTAL], domains=domains))


@query(f"WITH {_LINEAR} SELECT * FROM {sqlgen.linear('src', ['l_suppkey'], _MEAN, 'w')}")
def svy_lin_mean(spark, sf_dir):
    return rounded(_linear(spark, sf_dir).estimate(["l_suppkey"], _MEAN))


_TOP = [total("EMPCNT"), mean("MN_INC", "PINCP")]


@query(
    f"WITH {sqlgen.cte_persons()}, {sqlgen.cte_flags()}, titles AS ({standin.TITLES}) SELECT e.*, OCC_TITLE FROM "
    f"{sqlgen.estimate('persons', ['SOCP'], _TOP, 'WORKINGAGE = 1 AND FTEMP = 1')} e LEFT JOIN titles ON SOCP = SOCCODE18 "
    "ORDER BY EMPCNT DESC NULLS LAST, SOCP LIMIT 50"
)
def svy_top50(spark, sf_dir):
    """Flagship: indicators, domain, replicate count and mean, title, top 50."""
    persons = _persons(spark, sf_dir)
    design = ReplicateDesign(persons, standin.BASE, standin.REPLICATES, count=80)
    est = design.estimate(["SOCP"], _TOP, where=F.expr("WORKINGAGE = 1 AND FTEMP = 1"))
    titled = joins.add_title(est, standin.titles(spark, sf_dir), "SOCP", "SOCCODE18")
    return rounded(ranking.top_n(titled, 50, "EMPCNT", ["SOCP"]))


@query(
    "WITH t AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS qty, coalesce(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END), 0) AS open_qty, "
    "0 AS zero FROM lineitem GROUP BY 1) SELECT l_suppkey, round(CAST(open_qty AS DOUBLE) / qty + 1e-8, 6) AS p_open, CAST(NULL AS DOUBLE) AS p_none FROM t"
)
def share_of_total(spark, sf_dir):
    qty = F.col("l_quantity").cast("long")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(qty).alias("qty"), F.sum(F.when(F.col("l_linestatus") == "O", qty).otherwise(0)).alias("open_qty"), F.sum(qty * 0).alias("zero")
    )
    shares = reshape.row_shares(sold, {"p_open": ("open_qty", "qty"), "p_none": ("open_qty", "zero")})
    return rounded(shares.select("l_suppkey", "p_open", "p_none"), 6)


@query(
    "WITH t AS (SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY 1) "
    "SELECT l_returnflag, CAST(qty AS BIGINT) AS qty, round(CAST(qty AS DOUBLE) / sum(qty) OVER () + 1e-8, 6) AS p_qty FROM t"
)
def share_of_column(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return rounded(reshape.column_shares(sold, {"p_qty": "qty"}), 6)


# -- sets, shapes, ranks ----------------------------------------------------------

_LISTS = {str(i): (status, least) for i, (status, least) in enumerate([(s, q) for q in (0, 10, 20, 30) for s in ("F", "O", "P")], 1)}
_LABELS = {str(i): label for i, label in enumerate(["all", "female", "mom", "mom young children", "single mom"], 1)}
_LIST_SQL = {
    i: f"(SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = '{s}' AND o_totalprice > {q} * 10000 "
    "GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20)"
    for i, (s, q) in _LISTS.items()
}


def _order_lists(spark, sf_dir) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    out = {}
    for i, (status, least) in _LISTS.items():
        some = orders.where((F.col("o_orderstatus") == status) & (F.col("o_totalprice") > least * 10000))
        out[i] = ranking.top_n(some.groupBy("o_custkey").agg(F.count("*").alias("n")), 20, "n", ["o_custkey"])
    return out


@query("SELECT DISTINCT o_custkey FROM (" + " UNION ALL ".join(f"SELECT * FROM {s}" for s in _LIST_SQL.values()) + ")")
def stack_distinct(spark, sf_dir):
    return reshape.stack_tables(list(_order_lists(spark, sf_dir).values())).select("o_custkey").distinct()


@query(
    " UNION ALL ".join(f"SELECT '{_LABELS.get(i, i)}' AS category, o_custkey, n FROM {s}" for i, s in _LIST_SQL.items())
)
def stack_labelled(spark, sf_dir):
    stacked = reshape.stack_labelled(_order_lists(spark, sf_dir), "category")
    return stacked.withColumn("category", recode.map_values(F.col("category"), _LABELS))


@query(
    "SELECT c_name AS name, CAST(c_nationkey AS INT) AS nation, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier"
)
def union_lookup(spark, sf_dir):
    names = {"c_name": "name", "s_name": "name", "c_nationkey": "nation", "s_nationkey": "nation", "c_mktsegment": "segment"}
    customers = table(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_mktsegment").withColumnsRenamed(names)
    suppliers = table(spark, sf_dir, "supplier").select("s_name", "s_nationkey").withColumnsRenamed(names)
    return reshape.stack_tables([customers, suppliers])


_LONG = {"all": "TRUE", "open": "l_linestatus = 'O'", "bulk": "l_quantity >= 25"}


def _long_measures(label: str):
    return [total(f"{label}_n"), total(f"{label}_open", "open"), total(f"{label}_qty", "l_quantity")]


def _long_columns(label: str) -> str:
    return ", ".join(c for m in _long_measures(label) for c in (m.name, f"{m.name}_se"))


@query(
    f"WITH {_LINES} "
    + " UNION ALL ".join(
        f"SELECT name, value FROM (SELECT * FROM {sqlgen.estimate('src', [], _long_measures(d), c)}) UNPIVOT (value FOR name IN ({_long_columns(d)}))"
        for d, c in _LONG.items()
    )
)
def poptab_long(spark, sf_dir):
    from surveyloom.operators.measures import Block

    design = _design(spark, sf_dir)
    blocks = {d: Block(_long_measures(d), F.expr(c)) for d, c in _LONG.items()}
    sums = design.sums([], blocks)
    return rounded(reshape.stack_tables([reshape.to_long(sums.block(d)) for d in blocks]))


_SIDE = "(SELECT c_nationkey AS k, CASE WHEN c_nationkey = 3 THEN NULL ELSE 'N' || c_nationkey END AS title, count(*) AS n FROM customer WHERE c_mktsegment = '{}' GROUP BY ALL)"


@query(
    "SELECT a.k, a.title, a.n, b.n AS n_build, c.n AS n_mach FROM "
    + _SIDE.format("AUTOMOBILE") + " a LEFT JOIN "
    + _SIDE.format("BUILDING") + " b ON a.k = b.k AND a.title IS NOT DISTINCT FROM b.title LEFT JOIN "
    + _SIDE.format("MACHINERY") + " c ON a.k = c.k AND a.title IS NOT DISTINCT FROM c.title"
)
def suffix_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    title = F.expr("CASE WHEN c_nationkey = 3 THEN NULL ELSE 'N' || c_nationkey END").alias("title")

    def side(segment: str) -> DataFrame:
        some = customers.where(F.col("c_mktsegment") == segment)
        return some.groupBy(F.col("c_nationkey").alias("k"), title).agg(F.count("*").alias("n"))

    keys = ["k", "title"]
    others = {"_build": "BUILDING", "_mach": "MACHINERY"}
    return joins.fold_join(
        [side("AUTOMOBILE"), *[joins.suffix_columns(side(s), x, keys) for x, s in others.items()]], keys, "left"
    )


@query(
    "SELECT t1.o_custkey, t1.n, "
    + ", ".join(f"t{i}.n AS n_{i}" for i in _LIST_SQL if i != "1")
    + f" FROM {_LIST_SQL['1']} t1 "
    + " ".join(f"LEFT JOIN {sql} t{i} ON t1.o_custkey = t{i}.o_custkey" for i, sql in _LIST_SQL.items() if i != "1")
)
def wide_top_lists(spark, sf_dir):
    """The whole chain of lists, joined to the first."""
    lists = _order_lists(spark, sf_dir)
    sides = [joins.suffix_columns(df, "" if i == "1" else f"_{i}", ["o_custkey"]) for i, df in lists.items()]
    return joins.fold_join(sides, ["o_custkey"], "left")


_OPENINGS = (
    "SELECT n_name AS area, CASE WHEN l_linenumber = 7 THEN NULL WHEN p_size = 50 THEN p_type || '-0000' ELSE p_type || '-' || p_brand END AS OCC_CODE, "
    "p_type AS OCC_TITLEAZ, count(*) AS total_openings FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3"
)
_RANKS = (
    f"o AS ({_OPENINGS}), k AS (SELECT *, rank() OVER (PARTITION BY area ORDER BY total_openings DESC) + "
    "(count(*) OVER (PARTITION BY area, total_openings) - 1) / 2.0::DOUBLE AS openings_rank FROM o "
    "WHERE OCC_CODE IS NULL OR NOT contains(OCC_CODE, '-0000')), ranks AS (SELECT * FROM k WHERE openings_rank <= 40)"
)


def _openings(spark, sf_dir) -> DataFrame:
    code = F.expr(
        "CASE WHEN l_linenumber = 7 THEN NULL WHEN p_size = 50 THEN p_type || '-0000' ELSE p_type || '-' || p_brand END"
    )
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return (
        standin.lines_with_parts(spark, sf_dir)
        .join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("area"), code.alias("OCC_CODE"), F.col("p_type").alias("OCC_TITLEAZ"))
        .agg(F.count("*").alias("total_openings"))
    )


@query(f"WITH {_RANKS} SELECT area, OCC_CODE, OCC_TITLEAZ, total_openings, CAST(openings_rank AS DOUBLE) AS openings_rank FROM ranks")
def area_rank_top(spark, sf_dir):
    return occupations.area_ranks(_openings(spark, sf_dir))


@query(
    "SELECT o_orderstatus, o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY v DESC NULLS LAST) + "
    "(count(*) OVER (PARTITION BY o_orderstatus, v) - 1) / 2.0::DOUBLE AS DOUBLE) AS value_rank FROM "
    "(SELECT *, CAST(floor(o_totalprice / 100) AS BIGINT) AS v FROM orders)"
)
def average_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 100))
    return ranking.average_rank(orders, ["o_orderstatus"], "v", "value_rank").select("o_orderstatus", "o_orderkey", "value_rank")


_AREAS = [f"NATION_{i}" for i in range(25)]


@query(
    f"WITH {_RANKS} SELECT OCC_CODE, OCC_TITLEAZ, "
    + ", ".join(f"CAST(max(CASE WHEN area = '{a}' THEN openings_rank END) AS DOUBLE) AS {a}" for a in _AREAS)
    + " FROM ranks GROUP BY 1, 2"
)
def area_rank_pivot(spark, sf_dir):
    # The area table is bounded: one row for each area.
    areas = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").distinct().orderBy("n_name").collect()]
    return occupations.area_rank_matrix(occupations.area_ranks(_openings(spark, sf_dir)), areas)


@query(
    "SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS wage, format('{:.1f}', p_size / 8.0::DOUBLE * 100) || '%' AS growth, "
    "round(p_retailprice / 8, 2) AS openings FROM part"
)
def report_format(spark, sf_dir):
    size = F.col("p_size") / F.lit(8.0)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        money.dollar_text(F.col("p_retailprice")).alias("wage"),
        F.replace(money.percent_text(size, 1), F.lit(","), F.lit("")).alias("growth"),
        F.round(F.col("p_retailprice") / 8, 2).alias("openings"),
    )


@query(
    "WITH t AS (SELECT r_name, n_name, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
    "SELECT 'nation' AS level, r_name, n_name, count(DISTINCT code) AS n_codes FROM t GROUP BY ALL UNION ALL "
    "SELECT 'region', r_name, NULL, count(DISTINCT code) FROM t GROUP BY ALL UNION ALL SELECT 'all', NULL, NULL, count(DISTINCT code) FROM t"
)
def distinct_codes_rollup(spark, sf_dir):
    """Distinct codes by area, by region and overall, from one set of bitmaps."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = (
        lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .select("r_name", "n_name", F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END").alias("code"))
    )
    return distinct.distinct_rollup(rows, {"nation": ["r_name", "n_name"], "region": ["r_name"], "all": []}, "code")
