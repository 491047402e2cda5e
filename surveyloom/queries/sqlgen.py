"""SQL for checking survey estimates, written from the definitions.

The form is deliberately another one than the library's: persons are crossed
with the replicate numbers, medians use plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from surveyloom.operators.measures import Measure
from surveyloom.operators.tquantile import t_quantile
from surveyloom.queries import standin

REPLICATE_WEIGHT = (
    "CAST(CASE WHEN r = 0 THEN 6 * q ELSE q * (3 + (31 * l_orderkey + 17 * l_linenumber + 13 * r) % 7) END AS DOUBLE)"
)
_T = "[" + ", ".join(repr(t_quantile(k)) for k in range(1, 81)) + "]"


def cte_persons() -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in standin.PERSON.items())
    return (
        f"base AS (SELECT {cols}, {standin.QUANTITY} AS q, l_orderkey, l_linenumber "
        "FROM lineitem JOIN part ON l_partkey = p_partkey)"
    )


def cte_flags(source: str = "base", name: str = "persons") -> str:
    """Indicators by CASE, from their definitions; NULL stays NULL."""
    def flag(cond: str) -> str:
        return f"CASE WHEN {cond} THEN 1 WHEN NOT ({cond}) THEN 0 END"

    ft, mom = "(ESR = 1 AND WKHP >= 35 AND WKW <= 3)", "(PAOC <= 3 AND SEX = 2)"
    momyc = "((PAOC = 1 OR PAOC = 3) AND SEX = 2)"
    flags = {
        "WORKINGAGE": "AGEP >= 18 AND AGEP < 65",
        "FTEMP": ft,
        "PTEMP": f"ESR = 1 AND WKHP > 0 AND WKW <= 5 AND NOT {ft}",
        "FEM": "SEX = 2",
        "MAL": "SEX = 1",
        "MOM": mom,
        "MOMYC": momyc,
        "SMOM": f"{mom} AND MAR >= 2",
        "SMOMYC": f"{momyc} AND MAR >= 2",
        "LESSBACH": "SCHL <= 20",
        "BACHMORE": "SCHL >= 21",
    }
    cols = ", ".join(f"{flag(c)} AS {n}" for n, c in flags.items())
    tier = (
        "CASE WHEN SCHL = 20 THEN 'Associate' WHEN SCHL >= 21 THEN 'Bach or more' WHEN SCHL >= 18 THEN 'Some college' "
        "WHEN SCHL >= 16 THEN 'HS or GED' ELSE 'Less than HS' END AS EDATT_RC"
    )
    money = "PINCP * ADJINC AS PINCP, WAGP * ADJINC AS PERNP"
    return f"{name} AS (SELECT * EXCLUDE (PINCP), {cols}, {tier}, 1 AS CNT, {money} FROM {source})"


def _same(a: str, b: str, keys: Sequence[str]) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys) or "TRUE"


def _list(prefix: str, keys: Sequence[str]) -> str:
    return "".join(f"{prefix}.{k}, " for k in keys)


def _theta(m: Measure) -> str:
    if m.column is None:
        value = "sum(w)"
    elif m.kind == "total":
        value = f"coalesce(sum(w * {m.column}), 0)"
    else:
        value = f"sum(w * {m.column}) / NULLIF(sum(CASE WHEN {m.column} IS NOT NULL THEN w END), 0)"
    if m.strict and m.column is not None:
        value = f"CASE WHEN count(*) = count({m.column}) THEN {value} END"
    return f"CAST({value} AS DOUBLE) AS {m.name}"


def estimate(source: str, keys: Sequence[str], measures: Sequence[Measure], where: str = "TRUE", digits: int = 4, independent: str = "80") -> str:
    """A subselect with the keys and, rounded, ``X`` and ``X_se`` per measure.

    ``independent`` is the number of independent replicates behind a median's limits.
    """
    linear = [m for m in measures if m.kind != "median"]
    medians = [m for m in measures if m.kind == "median"]
    k = "".join(f"{c}, " for c in keys)
    group = ", ".join([*keys, "r"])
    sql = (
        f"WITH reps AS (SELECT {k}r, count(*) AS n_rows{''.join(', ' + _theta(m) for m in linear)} FROM "
        f"(SELECT *, {REPLICATE_WEIGHT} AS w FROM {source} CROSS JOIN range(0, 81) AS t(r) WHERE {where}) GROUP BY {group}), "
        f"zero AS (SELECT * FROM reps WHERE r = 0), "
        f"est AS (SELECT {_list('a', keys)}max(a.n_rows) AS n_rows"
        + "".join(
            f", max(a.{m.name}) AS {m.name}, CASE WHEN count(b.{m.name}) = 80 THEN "
            f"sqrt(4.0 / 80 * sum((b.{m.name} - a.{m.name}) * (b.{m.name} - a.{m.name}))) END AS {m.name}_se"
            for m in linear
        )
        + f" FROM zero a JOIN reps b ON {_same('a', 'b', keys)} AND b.r > 0 "
        + (f"GROUP BY {', '.join('a.' + c for c in keys)}" if keys else "")
        + ")"
    )
    joins = ""
    for i, m in enumerate(medians):
        sql += ", " + _median(source, keys, m, where, f"m{i}", independent)
        joins += f" LEFT JOIN m{i} ON {_same('e', f'm{i}', keys)}"
    cols = []
    for m in measures:
        if m.kind == "median":
            i = medians.index(m)
            cols += [f"round(m{i}.med + 1e-{digits + 2}, {digits}) AS {m.name}", f"round(m{i}.se + 1e-{digits + 2}, {digits}) AS {m.name}_se"]
        else:
            cols += [f"round(e.{m.name} + 1e-{digits + 2}, {digits}) AS {m.name}", f"round(e.{m.name}_se + 1e-{digits + 2}, {digits}) AS {m.name}_se"]
    return f"({sql} SELECT {_list('e', keys)}{', '.join(cols)} FROM est e{joins})"


def _median(source: str, keys: Sequence[str], m: Measure, where: str, name: str, independent: str) -> str:
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    by_r = "GROUP BY " + ", ".join([*[f"d.{c}" for c in keys], "r"])
    x = m.column
    return (
        f"{name}_d AS (SELECT *, CAST(6 * q AS DOUBLE) AS w0 FROM {source} WHERE ({where}) AND {x} IS NOT NULL), "
        f"{name}_c AS (SELECT {k}{x} AS x, sum(w0) OVER ({part} ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, "
        f"sum(w0) OVER ({part}) AS tot, count(*) OVER ({part}) AS n FROM {name}_d), "
        f"{name}_m AS (SELECT {k}min(CASE WHEN c >= 0.5 * tot THEN x END) AS med, max(n) AS n FROM {name}_c {by}), "
        f"{name}_p AS (SELECT {_list('d', keys)}r, sum(CASE WHEN {x} <= med THEN w ELSE 0 END) / sum(w) AS p FROM "
        f"(SELECT *, {REPLICATE_WEIGHT} AS w FROM {name}_d CROSS JOIN range(0, 81) AS t(r)) d "
        f"JOIN {name}_m ON {_same('d', f'{name}_m', keys)} {by_r}), "
        f"{name}_h AS (SELECT {_list('a', keys)}sqrt(4.0 / 80 * sum((b.p - a.p) * (b.p - a.p))) AS se_p "
        f"FROM {name}_p a JOIN {name}_p b ON {_same('a', 'b', keys)} AND a.r = 0 AND b.r > 0 "
        + (f"GROUP BY {', '.join('a.' + c for c in keys)}" if keys else "")
        + "), "
        f"{name}_t AS (SELECT {_list('g', keys)}med, se_p, CASE WHEN n > 1 THEN {_T}[CAST(least({independent}, n) - 1 AS INT)] END AS t "
        f"FROM {name}_m g JOIN {name}_h ON {_same('g', f'{name}_h', keys)}), "
        f"{name} AS (SELECT {_list('g', keys)}max(med) AS med, "
        f"(min(CASE WHEN c >= least(0.5 + t * se_p, 1) * tot THEN x END) - min(CASE WHEN c >= (0.5 - t * se_p) * tot THEN x END)) "
        f"/ (2 * max(t)) AS se FROM {name}_t g JOIN {name}_c ON {_same('g', f'{name}_c', keys)} "
        + (f"GROUP BY {', '.join('g.' + c for c in keys)}" if keys else "")
        + ")"
    )


def linear(source: str, keys: Sequence[str], measures: Sequence[Measure], weight: str, where: str = "TRUE", digits: int = 4) -> str:
    """Linearised estimates by explicit residuals, two passes."""
    k = "".join(f"{c}, " for c in keys)
    means = [m for m in measures if m.kind == "mean"]
    point, err = [], []
    for m in measures:
        x = "1" if m.column is None else m.column
        if m.kind == "mean":
            value = f"sum({weight} * {x}) / NULLIF(sum(CASE WHEN {x} IS NOT NULL THEN {weight} END), 0)"
            z = f"CASE WHEN {x} IS NULL THEN 0 ELSE {weight} * ({x} - {m.name}) / {m.name}_k END"
        else:
            value = f"coalesce(sum({weight} * {x}), 0)"
            z = f"coalesce({weight} * {x}, 0)"
        if m.strict and m.column is not None:
            value = f"CASE WHEN count(*) = count({x}) THEN {value} END"
        point.append(f"CAST({value} AS DOUBLE) AS {m.name}")
        ok = f"{m.name} IS NOT NULL"
        se = f"sqrt(greatest(n_rows / (n_rows - 1.0) * (sum(({z}) * ({z})) - sum({z}) * sum({z}) / n_rows), 0))"
        if m.kind == "mean":
            se = f"sqrt(n_rows / (n_rows - 1.0) * sum(({z}) * ({z})))"
        err.append(f"round(max({m.name}) + 1e-{digits + 2}, {digits}) AS {m.name}, round(CASE WHEN count(CASE WHEN {ok} THEN 1 END) > 0 THEN {se} END + 1e-{digits + 2}, {digits}) AS {m.name}_se")
    known = "".join(f", sum(CASE WHEN {m.column} IS NOT NULL THEN {weight} END) AS {m.name}_k" for m in means)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    by_d = f"GROUP BY {', '.join('d.' + c for c in keys)}, n_rows" if keys else "GROUP BY n_rows"
    return (
        f"(WITH dom AS (SELECT * FROM {source} WHERE {where}), size AS (SELECT count(*) AS n_rows FROM dom), "
        f"pt AS (SELECT {k}{', '.join(point)}{known} FROM dom {by}) "
        f"SELECT {_list('d', keys)}{', '.join(err)} FROM dom d JOIN pt ON {_same('d', 'pt', keys)} CROSS JOIN size {by_d})"
    )
