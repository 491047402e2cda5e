"""Fixed schemas of the public sources.

Files are read by header name, so a file may hold more columns than its schema.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(*groups: tuple[T.DataType, list[str]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for t, names in groups for n in names])


# Column names of the published files.
HOURLY_WAGES = ["H_MEAN", "H_PCT10", "H_PCT25", "H_MEDIAN", "H_PCT75", "H_PCT90"]
ANNUAL_WAGES = ["A_MEAN", "A_PCT10", "A_PCT25", "A_MEDIAN", "A_PCT75", "A_PCT90"]

WAGES = T.StructType(
    [
        T.StructField(n, _S)
        for n in [
            *["NAICS", "NAICS_TITLE", "I_GROUP", "OWN_CODE", "OCC_CODE", "OCC_TITLE", "O_GROUP"],
            *["TOT_EMP", "PCT_TOTAL", "PCT_RPT"],
            *HOURLY_WAGES,
            *ANNUAL_WAGES,
        ]
    ]
)
PROJECTIONS = T.StructType(
    [
        T.StructField("Area Name", _S),
        T.StructField("SOC Code2", _S),
        T.StructField("Occupation Title", _S),
        T.StructField("total_openings", _D),
        T.StructField("percchange_2030", _D),
    ]
)
EDUCATION = T.StructType(
    [
        T.StructField("2021 National Employment Matrix code", _S),
        T.StructField("2021 National Employment Matrix title", _S),
        T.StructField("Typical education needed for entry", _S),
        T.StructField("Work experience in a related occupation", _S),
        T.StructField("Typical on-the-job training needed to attain competency in the occupation", _S),
    ]
)
OCCUPATIONS_2018 = _schema((_S, ["SOCCODE18", "OCC_TITLE"]))
OCCUPATIONS_2010 = _schema((_S, ["Census_OccCode_2010", "SOCCODE10_CENSUS", "SOCCODE10", "OCC_TITLE"]))


def weight_columns(prefix: str, replicates: int = 80) -> list[str]:
    return [f"{prefix}{r}" for r in range(1, replicates + 1)]


# Column names of the person files.
_MONEY = ["HINCP", "INTP", "OIP", "PAP", "RETP", "SEMP", "SSIP", "SSP", "WAGP", "PERNP", "PINCP"]
_CODES = [
    "FES", "HUPAOC", "NOC", "AGEP", "CIT", "NATIVITY", "COW", "FER", "MAR", "SCH", "SCHG", "SCHL", "SEX", "ESR",
    "WKHP", "WKL", "WKW", "JWAP", "JWDP", "MSP", "PAOC", "LANX", "MIL", "HICOV", "POVPIP", "RAC1P", "HISP",
]


def _microdata(ids: list[str], codes: list[str], occupations: list[str]) -> T.StructType:
    return T.StructType(
        [
            *_schema((_S, ids), (_I, ["SPORDER"]), (_D, ["PWGTP", "ADJINC"]), (_D, _MONEY), (_I, codes), (_S, occupations)),
            *[T.StructField(w, _D) for w in weight_columns("PWGTP")],
        ]
    )


MICRODATA_2020 = _microdata(["SERIALNO", "PUMA"], ["HHT2", *_CODES, "WKWN"], ["OCCP", "SOCP"])
MICRODATA_2015 = _microdata(["SERIALNO"], ["FPARC", *_CODES], ["OCCP10", "OCCP12", "SOCP10", "SOCP12"])

HARMONISED = T.StructType(
    [
        *_schema(
            (_I, ["YEAR", "AGE", "EMPSTAT", "UHRSWORK", "WKSWORK2", "SEX", "NCHILD", "NCHLT5", "MARST", "EDUCD"]),
            (_S, ["OCCSOC"]),
            (_D, ["INCTOT", "PERWT"]),
        ),
        *[T.StructField(w, _D) for w in weight_columns("REPWTP")],
    ]
)
