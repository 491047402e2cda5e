"""Survey result tables from person rows with indicators.

Two scans of the person rows give everything: one for the income lists (with
medians, a light scan of the base weight comes before it) and one for all
counts. Each leaves a small staged table of sums per occupation and replicate;
every result table is a view of these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.design import LinearDesign, ReplicateDesign, ReplicateSums
from surveyloom.operators.joins import add_title, fold_join, in_list, join_on, missing_from, suffix_columns
from surveyloom.operators.measures import Block, Measure, mean, median, total
from surveyloom.operators.ranking import top_n
from surveyloom.operators.reshape import column_shares, row_shares, stack_tables, to_long
from surveyloom.sources.staging import stage

TOP = 50
# Labels of the twelve lists, in order, with the suffix of each in
# the wide table.
POPULATIONS = {
    "all": None,
    "female": "SEX = 2",
    "mom": "MOM = 1",
    "mom young children": "MOMYC = 1",
    "single mom": "SMOM = 1",
    "single mom young children": "SMOMYC = 1",
}
LESS_BACHELOR = {
    "all less bach": "all",
    "female less bach": "female",
    "mom less bach": "mom",
    "mom young children lb": "mom young children",
    "single mom lb": "single mom",
    "single mom young children lb": "single mom young children",
}
SUFFIXES = {
    "all": "",
    "female": "_fem",
    "mom": "_mom",
    "mom young children": "_momyc",
    "single mom": "_smom",
    "single mom young children": "_smomyc",
    "all less bach": "_lb",
    "female less bach": "_lbfem",
    "mom less bach": "_lbmom",
    "mom young children lb": "_lbmomyc",
    "single mom lb": "_lbsingmom",
    "single mom young children lb": "_lbsingmomyc",
}
# Estimate name to indicator, per result table.
TOTALS_ALL = {
    "FTCNT": "FTEMP",
    "PTCNT": "PTEMP",
    "FEMCNT": "FEM",
    "MALCNT": "MAL",
    "MOMCNT": "MOM",
    "MOMYCCNT": "MOMYC",
    "SMOMCNT": "SMOM",
    "SMOMYCCNT": "SMOMYC",
    "LBACHCNT": "LESSBACH",
    "BACHMCNT": "BACHMORE",
}
TOTALS_WORKING_AGE = {
    "FTCNT": "FTEMP",
    "PTCNT": "PTEMP",
    "FEMCNT": "FEM",
    "MLCNT": "MAL",
    "MOMCNT": "MOM",
    "MOMYCCNT": "MOMYC",
    "SMOMCNT": "SMOM",
    "SMOMYCCNT": "SMOMYC",
}
TOTALS_FULL_TIME = {
    "FEMFTCNT": "FEM",
    "MLFTCNT": "MAL",
    "MOMFTCNT": "MOM",
    "MOMYCFTCNT": "MOMYC",
    "SMOMFTCNT": "SMOM",
    "SMOMYCFTCNT": "SMOMYC",
}
TOTALS_IN_SCHOOL = {
    "FEMSCHLCNT": "FEM",
    "MLSCHLCNT": "MAL",
    "MOMSCHLCNT": "MOM",
    "MOMYCSCHLCNT": "MOMYC",
    "SMOMSCHLCNT": "SMOM",
    "SMOMYCSCHLCNT": "SMOMYC",
}
TOTALS_EDUCATION = {
    "WFEMCNT": "FEM",
    "WMOMCNT": "MOM",
    "WMOMYCCNT": "MOMYC",
    "WSMOMCNT": "SMOM",
    "WSMOMYCCNT": "SMOMYC",
}
SHARES_EDUCATION = {
    "pTot": "TOTCNT",
    "pWFEM": "WFEMCNT",
    "pWMOM": "WMOMCNT",
    "pWMOMYC": "WMOMYCCNT",
    "pWSMOM": "WSMOMCNT",
    "pWSMOMYC": "WSMOMYCCNT",
}
SHARES_WOMEN = {
    "pFem": "FEMCNT",
    "pMom": "MOMCNT",
    "pMomYC": "MOMYCCNT",
    "pSMom": "SMOMCNT",
    "pSMomYC": "SMOMYCCNT",
}
SHARES_ALL = {
    "pFT": "FTCNT",
    "pPT": "PTCNT",
    "pFEM": "FEMCNT",
    "pMAL": "MALCNT",
    "pMOM": "MOMCNT",
    "pMOMYC": "MOMYCCNT",
    "pSMOM": "SMOMCNT",
    "pSMOMYC": "SMOMYCCNT",
    "pLBACH": "LBACHCNT",
    "pBACHM": "BACHMCNT",
}

FULL_TIME = "WORKINGAGE = 1 AND FTEMP = 1"
INCOME = (total("EMPCNT"), mean("MN_INC", "PINCP"), median("MED_INC", "PINCP"), median("MED_WG", "PERNP"))
MEN, MEN_LB = "male", "male less bach"


def _and(*conds: str | None) -> Column | None:
    some = [f"({c})" for c in conds if c]
    return F.expr(" AND ".join(some)) if some else None


def list_conditions(men: bool = False) -> dict[str, Column | None]:
    """Row conditions of the twelve lists among full-time workers, and of the men."""
    out = {x: _and(cond) for x, cond in POPULATIONS.items()}
    out |= {x: _and("LESSBACH = 1", POPULATIONS[of]) for x, of in LESS_BACHELOR.items()}
    if men:
        out |= {MEN: _and("SEX = 1"), MEN_LB: _and("LESSBACH = 1", "SEX = 1")}
    return out


def totals(names: Mapping[str, str], count: str | None = None, strict: bool = False) -> tuple[Measure, ...]:
    head = (total(count),) if count else ()
    return (*head, *[total(name, column, strict) for name, column in names.items()])


def _of_total(shares: Mapping[str, str], whole: str) -> dict[str, tuple[str, str]]:
    return {p: (part, whole) for p, part in shares.items()}


@dataclass
class SurveyTables:
    """All result tables of one vintage; see the module text for the plan.

    ``titles`` maps an occupation code (column ``key``) to ``OCC_TITLE``;
    ``promising`` holds the survey codes of promising occupations in ``code``.
    """

    persons: DataFrame
    weight: str
    replicates: Sequence[str]
    titles: DataFrame
    promising: DataFrame
    code: str = "SOCCODE18"
    promising_code: str | None = None
    key: str = "SOCP"
    title: str = "OCC_TITLE"
    top: int = TOP
    count: int | None = None

    def __post_init__(self):
        slim = self.persons.drop(self.title) if self.title in self.persons.columns else self.persons
        self.design = ReplicateDesign(slim, self.weight, self.replicates, count=self.count)
        self._income: DataFrame | None = None
        self._counts: ReplicateSums | None = None
        self._lists: DataFrame | None = None
        self._list_codes: DataFrame | None = None

    # -- the two passes -------------------------------------------------

    def income(self) -> DataFrame:
        """Count, mean and medians per population and occupation (staged)."""
        if self._income is None:
            blocks = {x: Block(INCOME, cond) for x, cond in list_conditions(men=True).items()}
            self._income = stage(
                self.design.where(_and(FULL_TIME)).estimate_sums([self.key], blocks).stacked("category"), "income"
            )
        return self._income

    def counts(self) -> ReplicateSums:
        """Sums for all counts by occupation and education tier (staged)."""
        if self._counts is None:
            strict = totals({"FEMCNT": "FEM", "MALCNT": "MAL"}, "EMPCNT", strict=True)
            lenient = totals(TOTALS_ALL, "TOTCNT")
            blocks = {
                "everyone": Block(lenient),
                "working_age": Block(totals(TOTALS_WORKING_AGE, "WAPOPCNT"), F.expr("WORKINGAGE = 1")),
                "full_time": Block((*lenient, *strict), _and(FULL_TIME)),
                "in_school": Block(totals(TOTALS_IN_SCHOOL, "WASCHLCNT"), _and(FULL_TIME, "SCH >= 2")),
                "employed": Block(totals({"FTCNT": "FTEMP", "PTCNT": "PTEMP"}, "TOTCNT"), _and("ESR = 1", "WORKINGAGE = 1")),
                "employed_women": Block(
                    totals({"FTCNT": "FTEMP", "PTCNT": "PTEMP"}, "TOTCNT", strict=True),
                    _and("ESR = 1", "WORKINGAGE = 1", "SEX = 2"),
                ),
                "full_time_lb": Block(strict, _and(FULL_TIME, "LESSBACH = 1")),
            }
            self._counts = self.design.sums([self.key, "EDATT_RC"], blocks).staged("counts")
        return self._counts

    # -- helpers ----------------------------------------------------------

    def _titled(self, df: DataFrame) -> DataFrame:
        return add_title(df, self.titles, self.key, self.code)

    def _population(self, label: str, codes: DataFrame, column: str) -> DataFrame:
        rows = self.income().where(F.col("category") == label).drop("category")
        return self._titled(in_list(rows, codes, self.key, column))

    def _by_occupation(self, block: str, measures: Sequence[Measure], codes: DataFrame, column: str) -> DataFrame:
        return in_list(self.counts().block(block, [self.key], measures), codes, self.key, column)

    def _attach(self, first: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
        keys = [self.key, self.title]
        return fold_join([first, *[suffix_columns(df, sfx, keys) for sfx, df in blocks.items()]], keys, "left")

    # -- tables -----------------------------------------------------------

    def population_table(self) -> DataFrame:
        """Totals of three domains, long, each estimate followed by its error."""
        c = self.counts()
        wide = [
            c.block("working_age", [], totals(TOTALS_WORKING_AGE, "WAPOPCNT")),
            c.block("full_time", [], totals(TOTALS_FULL_TIME, "WAFTCNT")),
            c.block("in_school", [], totals(TOTALS_IN_SCHOOL, "WASCHLCNT")),
        ]
        return stack_tables([to_long(df) for df in wide])

    def top_lists(self) -> DataFrame:
        """The twelve lists of largest occupations with a label (staged)."""
        if self._lists is None:
            ranked = self._titled(self.income().where(~F.col("category").isin(MEN, MEN_LB)))
            self._lists = stage(top_n(ranked, self.top, "EMPCNT", [self.key, self.title], ["category"]), "top_lists")
        return self._lists

    def list_codes(self) -> DataFrame:
        """Distinct occupations over all lists (staged)."""
        if self._list_codes is None:
            self._list_codes = stage(self.top_lists().select(self.key).distinct(), "list_codes")
        return self._list_codes

    def top_lists_wide(self, outer: bool = False) -> DataFrame:
        """One row per occupation, one set of columns per list.

        Occupations of the overall list only, or of any list when ``outer``.
        One conditional aggregation replaces a chain of joins.
        """
        measures = [c for m in INCOME for c in (m.name, f"{m.name}_se")]
        cells = [
            F.max(F.when(F.col("category") == label, F.col(c))).alias(c + sfx)
            for label, sfx in SUFFIXES.items()
            for c in measures
        ]
        lists = self.top_lists()
        if not outer:
            overall = lists.where(F.col("category") == "all").select(self.key)
            lists = in_list(lists, overall, self.key, self.key)
        return lists.groupBy(self.key, self.title).agg(*cells)

    def education_table(self) -> DataFrame:
        measures = totals(TOTALS_EDUCATION, "TOTCNT")
        return column_shares(self.counts().block("full_time", ["EDATT_RC"], measures), SHARES_EDUCATION)

    def full_part_time(self) -> DataFrame:
        shares = _of_total({"pFT": "FTCNT", "pPT": "PTCNT"}, "TOTCNT")
        codes = self.list_codes()
        sides = []
        for block, strict in (("employed", False), ("employed_women", True)):
            measures = totals({"FTCNT": "FTEMP", "PTCNT": "PTEMP"}, "TOTCNT", strict)
            sides.append(self._titled(row_shares(self._by_occupation(block, measures, codes, self.key), shares)))
        return self._attach(sides[0], {"_fem": sides[1]})

    def women_table(self) -> DataFrame:
        names = {n: c for n, c in TOTALS_ALL.items() if n not in ("FTCNT", "PTCNT")}
        codes = self.list_codes()
        base = self._by_occupation("full_time", totals(names, "TOTCNT"), codes, self.key)
        base = self._titled(row_shares(base, _of_total(SHARES_WOMEN, "TOTCNT")))
        groups = {"_mom": "mom", "_momyc": "mom young children", "_smomyc": "single mom young children"}
        return self._attach(base, {sfx: self._population(x, codes, self.key) for sfx, x in groups.items()})

    def sex_income(self, less_bachelor: bool = False) -> DataFrame:
        """Share of women, and income of all, women and men, for listed occupations."""
        block, everyone, women, men = (
            ("full_time_lb", "all less bach", "female less bach", MEN_LB)
            if less_bachelor
            else ("full_time", "all", "female", MEN)
        )
        codes = self.list_codes()
        strict = totals({"FEMCNT": "FEM", "MALCNT": "MAL"}, "EMPCNT", strict=True)
        counted = self._by_occupation(block, strict, codes, self.key)
        income = self._population(everyone, codes, self.key).drop("EMPCNT", "EMPCNT_se")
        base = join_on(counted, income, [self.key], "left")
        base = row_shares(base, _of_total({"pFEM": "FEMCNT", "pMAL": "MALCNT"}, "EMPCNT"))
        sides = {"_fem": self._population(women, codes, self.key), "_ml": self._population(men, codes, self.key)}
        return self._attach(base, dict(sorted(sides.items(), reverse=less_bachelor)))

    def promising_table(self) -> DataFrame:
        """Promising occupations: everyone, full-time with medians, women, men."""
        codes, column = self.promising, self.promising_code or self.code
        measures, shares = totals(TOTALS_ALL, "TOTCNT"), _of_total(SHARES_ALL, "TOTCNT")
        base = self._titled(row_shares(self._by_occupation("everyone", measures, codes, column), shares))
        full = row_shares(self._by_occupation("full_time", measures, codes, column), shares)
        medians = self._population("all", codes, column).select(
            self.key, self.title, "MED_INC", "MED_INC_se", "MED_WG", "MED_WG_se"
        )
        full = join_on(full, medians, [self.key], "left")
        sides = {
            "_ft": full,
            "_femft": self._population("female", codes, column),
            "_mlft": self._population(MEN, codes, column),
        }
        return self._attach(base, sides)

    def promising_with_data(self, data: DataFrame) -> DataFrame:
        """The promising table outer-joined to the occupation data, on ``code``."""
        return join_on(self.promising_table(), data.withColumnRenamed(self.code, self.key), [self.key], "full_outer")

    def missing_promising(self) -> DataFrame:
        """Promising survey codes without any person."""
        column = self.promising_code or self.code
        return missing_from(self.promising, self.persons, column, self.key)

    def all_tables(self, data: DataFrame | None = None) -> dict[str, DataFrame]:
        out = {
            "population_table": self.population_table(),
            "sex_income": self.sex_income(),
            "sex_income_less_bachelor": self.sex_income(less_bachelor=True),
            "top_lists_long": self.top_lists(),
            "top_lists_wide": self.top_lists_wide(),
            "women_table": self.women_table(),
            "education_table": self.education_table(),
            "full_part_time": self.full_part_time(),
            "promising_table": self.promising_table(),
        }
        if data is not None:
            out["promising_with_data"] = self.promising_with_data(data)
        return out


@dataclass
class LinearTables:
    """Result tables with linearised errors and NULL-propagating estimates."""

    persons: DataFrame
    titles: DataFrame
    promising: DataFrame
    weight: str = "PERWT"
    key: str = "OCCSOC"
    code: str = "SOCCODE18"
    income: str = "INCTOT"
    employed: str = "EMPSTAT = 1"
    title: str = "OCC_TITLE"
    top: int = TOP
    count: int | None = None

    def __post_init__(self):
        slim = self.persons.drop(self.title) if self.title in self.persons.columns else self.persons
        self.design = LinearDesign(slim, self.weight)
        self._lists: DataFrame | None = None

    def _titled(self, df: DataFrame) -> DataFrame:
        return add_title(df, self.titles, self.key, self.code)

    def _measures(self) -> tuple[Measure, ...]:
        return (total("EMPCNT"), mean("MN_INC", self.income, strict=True))

    def top_lists(self) -> DataFrame:
        """The twelve lists with a label (staged)."""
        if self._lists is None:
            est = self.design.estimate(
                [self.key], self._measures(), where=_and(FULL_TIME), domains=list_conditions(), name="category"
            )
            ranked = self._titled(est)
            self._lists = stage(top_n(ranked, self.top, "EMPCNT", [self.key, self.title], ["category"]), "linear_lists")
        return self._lists

    def list_codes(self) -> DataFrame:
        return self.top_lists().select(self.key).distinct()

    def education_table(self) -> DataFrame:
        measures = totals(TOTALS_EDUCATION, "TOTCNT", strict=True)
        est = stage(self.design.estimate(["EDATT_RC"], measures, where=_and(FULL_TIME)), "linear_education")
        return column_shares(est, SHARES_EDUCATION)

    def full_part_time(self) -> DataFrame:
        shares = _of_total({"pFT": "FTCNT", "pPT": "PTCNT"}, "TOTCNT")
        measures = totals({"FTCNT": "FTEMP", "PTCNT": "PTEMP"}, "TOTCNT", strict=True)
        everyone = _and(self.employed, "WORKINGAGE = 1")
        # The list restricts the design itself, so the row count is that of the listed occupations.
        domains = {"all": everyone, "women": everyone & F.expr("SEX = 2")}
        both = self.design.estimate([self.key], measures, domains=domains, name="category", among=(self.list_codes(), self.key, self.key))
        both = stage(self._titled(row_shares(both, shares)), "linear_full_part_time")
        sides = [both.where(F.col("category") == x).drop("category") for x in ("all", "women")]
        keys = [self.key, self.title]
        return fold_join([sides[0], suffix_columns(sides[1], "_fem", keys)], keys, "left")

    def promising_table(self) -> DataFrame:
        """Promising occupations: everyone, then full-time with mean income."""
        listed = (self.promising, self.key, self.code)
        everyone = {n: c for n, c in TOTALS_ALL.items() if n != "MALCNT"}
        full = {n: c for n, c in everyone.items() if n not in ("FTCNT", "PTCNT")}
        income = mean("MN_INC", self.income, strict=True)
        both = []
        for names, where, extra in ((everyone, None, ()), (full, _and(FULL_TIME), (income,))):
            shares = {p: c for p, c in SHARES_ALL.items() if c in names}
            est = self.design.estimate([self.key], (*totals(names, "TOTCNT", strict=True), *extra), where=where, among=listed)
            both.append(self._titled(row_shares(est, _of_total(shares, "TOTCNT"))))
        keys = [self.key, self.title]
        return fold_join([both[0], suffix_columns(both[1], "_ft", keys)], keys, "left")
