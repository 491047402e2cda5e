"""Survey vintages as configuration: codes, crosswalks, dollar years."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.cleaning import remove_first
from surveyloom.functions.money import scale
from surveyloom.functions.recode import sentinel_fallback
from surveyloom.operators.joins import add_title, apply_crosswalk, join_on
from surveyloom.operators.ranking import first_per_key
from surveyloom.operators.reshape import stack_tables
from surveyloom.plans.codebooks import CENSUS, add_indicators

# Occupation code to the collapsed code of the 2018 survey codes.
CROSSWALK_2018 = {
    "151231": "151230",
    "151232": "151230",
    "173012": "17301X",
    "173022": "17302X",
    "173026": "17302X",
    "253021": "2530XX",
    "274011": "2740XX",
    "312011": "312010",
    "312021": "312020",
    "333051": "333050",
    "414012": "414010",
    "419022": "419020",
    "434199": "434YYY",
    "439199": "439XXX",
    "472051": "472050",
    "472073": "472070",
    "472081": "472080",
    "475041": "475040",
    "492022": "492020",
    "499012": "499010",
    "499099": "4990XX",
    "514121": "514120",
    "519141": "5191XX",
    "519161": "519160",
    "531047": "531000",
    "533032": "533030",
}
# The same for the 2010 survey codes.
CROSSWALK_2010 = {
    "151231": "151150",
    "151232": "151150",
    "173011": "173010",
    "173012": "173010",
    "173022": "173020",
    "173023": "173020",
    "173026": "173020",
    "232093": "232090",
    "253021": "253000",
    "274011": "274010",
    "291292": "292021",
    "292032": "292030",
    "292034": "292030",
    "292035": "292030",
    "292055": "292050",
    "312011": "312010",
    "312021": "312020",
    "399031": "399030",
    "413091": "413099",
    "414012": "414010",
    "419022": "419020",
    "435031": "435030",
    "472051": "472050",
    "472073": "472070",
    "472081": "472080",
    "472151": "472150",
    "472152": "472150",
    "475041": "475040",
    "492022": "492020",
    "499012": "499010",
    "514121": "514120",
    "519161": "519199",
    "531047": "531000",
    "533032": "533030",
    "533052": "533020",
}
# 2015 to 2020 dollars, and the code that means "see the other column".
DOLLARS_2015_TO_2020 = 1.09257667
NO_CODE = "N.A.//"


@dataclass(frozen=True)
class Vintage:
    """How one survey year differs from another.

    ``wage_without_adjustment`` leaves the within-year income adjustment out of
    wages when a dollar-year factor applies; by default both apply.
    """

    year: int
    code: str
    crosswalk: dict[str, str]
    merged_from: tuple[str, str] | None = None
    dollars: float = 1.0
    wage_without_adjustment: bool = False


VINTAGE_2020 = Vintage(2020, "SOCCODE18", CROSSWALK_2018)
VINTAGE_2015 = Vintage(2015, "SOCCODE10", CROSSWALK_2010, ("SOCP10", "SOCP12"), DOLLARS_2015_TO_2020)


def adjusted(col: Column, v: Vintage, adjustment: Column, adjust: bool = True) -> Column:
    factors: list[Column | float] = [adjustment] if adjust else []
    return scale(col, *factors, *([v.dollars] if v.dollars != 1.0 else []))


def prepare_persons(data: DataFrame, v: Vintage, titles: DataFrame | None = None) -> DataFrame:
    """Indicators, money in one dollar year, merged occupation code, and a title only if titles are given.

    The result tables add titles after aggregation, so persons are not joined for them.

    Earnings (``PERNP``) are the adjusted wages (``WAGP``), not the adjusted
    total earnings.
    """
    persons = add_indicators(data, CENSUS)
    if v.merged_from is not None:
        first, second = v.merged_from
        persons = persons.withColumn("SOCP", sentinel_fallback(F.col(first), NO_CODE, F.col(second)))
    persons = persons.withColumns(
        {
            "PINCP": adjusted(F.col("PINCP"), v, F.col("ADJINC")),
            "PERNP": adjusted(F.col("WAGP"), v, F.col("ADJINC"), not v.wage_without_adjustment),
        }
    )
    return persons if titles is None else add_title(persons, titles, "SOCP", v.code)


def titles_2018(lookup: DataFrame) -> DataFrame:
    return lookup.select("SOCCODE18", "OCC_TITLE")


def codes_2010(lookup: DataFrame, missing: DataFrame) -> DataFrame:
    """Both code lists as one, without dashes in either code."""
    both = stack_tables([lookup, missing])
    return both.withColumns({c: remove_first(F.col(c)) for c in ("SOCCODE10", "SOCCODE10_CENSUS")})


def titles_2010(codes: DataFrame, order_by: Sequence[str] = ("Census_OccCode_2010",)) -> DataFrame:
    """One title per code: the first row in an explicit order."""
    return first_per_key(codes, ["SOCCODE10"], order_by).select("SOCCODE10", "OCC_TITLE")


def promising_codes(promising: DataFrame, v: Vintage, codes: DataFrame | None = None) -> DataFrame:
    """Survey codes of the promising occupations, with code and title.

    With ``codes`` (2010) every survey code also brings its census codes, one
    row each.
    """
    base = promising.select(remove_first(F.col("OCC_CODE")).alias("OCC_CODE"), "OCC_TITLE")
    mapped = apply_crosswalk(base, v.crosswalk, "OCC_CODE", v.code)
    if codes is None:
        return mapped
    census = codes.select("SOCCODE10", "SOCCODE10_CENSUS")
    return join_on(mapped, census, [v.code], "left").select("OCC_CODE", "OCC_TITLE", "SOCCODE10", "SOCCODE10_CENSUS")


def promising_data(promising: DataFrame, codes: DataFrame) -> DataFrame:
    """The full promising table with survey codes attached on code and title."""
    data = promising.withColumn("OCC_CODE", remove_first(F.col("OCC_CODE")))
    return join_on(data, codes, ["OCC_CODE", "OCC_TITLE"], "left")
