"""DuckDB oracle text for every registered query.

Each statement starts from the same fixture view ``e`` as the Spark side and
a decoded view ``d`` written independently in SQL (CASE per dictionary), so
a decode bug on either side shows up as a mismatch.
"""

from __future__ import annotations

from ..functions.codes import WHITESPACE
from ..functions.dictionary import DECODE_SPEC, DOMAINS, UNKNOWN
from ..sources.fixture import DUCKDB_FIXTURE_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rate(n: str, total: str) -> str:
    """Same arithmetic as ``numeric.rate``: (n/total)*100, half-even to 0.1."""
    return f"(round_even((CAST({n} AS DOUBLE) / {total}) * 100 * 10, 0) / 10)"


def decode_case(raw: str) -> str:
    whens = " ".join(f"WHEN {code} THEN {q(label)}" for code, label in DOMAINS[raw].items())
    return f"COALESCE(CASE {raw} {whens} END, {q(UNKNOWN)})"


_WS = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)
NORM = f"(CASE WHEN starts_with(trim(cod_establecimiento, {_WS}), '00-') THEN '01-' || substr(trim(cod_establecimiento, {_WS}), 4) ELSE trim(cod_establecimiento, {_WS}) END)"


def municipality_sql(c: str) -> str:
    return f"(CASE WHEN strpos({c}, '-') > 0 THEN split_part({c}, '-', 1) || '-' || split_part({c}, '-', 2) END)"


DECODED_SQL = (
    "SELECT anio, n.cod AS cod_establecimiento, "
    + ", ".join(
        [
            f"{decode_case('departamento_f')} AS departamento",
            "depto_mupio",
            f"{decode_case('sector')} AS sector",
            f"{decode_case('area')} AS area",
            f"{decode_case('sexo')} AS sexo",
            "grado",
            f"{decode_case('nivel')} AS nivel",
            f"{decode_case('pueblo_per')} AS pueblo",
            f"{decode_case('plan_est')} AS plan_estudios",
            f"{decode_case('jornada_est')} AS jornada",
            f"{decode_case('resultado_f')} AS resultado",
            f"{decode_case('repitente')} AS repitente",
            f"{decode_case('graduando')} AS graduando",
            f"{municipality_sql('n.cod')} AS municipio_codigo",
        ]
        + [f"{raw} AS {spec[2]}" for raw, spec in DECODE_SPEC.items()]
    )
    + f" FROM (SELECT *, {NORM} AS cod FROM e) n"
)

PREFIX = f"WITH e AS ({DUCKDB_FIXTURE_SQL}), d AS ({DECODED_SQL})"


def with_views(body: str, extra: str = "") -> str:
    """``WITH e, d[, extra CTEs] <body>``."""
    return f"{PREFIX}{', ' + extra if extra else ''} {body}"


def outcome_cols(total: str = "count(resultado)", not_promoted: bool = True, result: str = "resultado") -> str:
    cols = [
        f"{total} AS total",
        f"count(CASE WHEN {result} = 'Promovido' THEN 1 END) AS promovidos",
    ]
    if not_promoted:
        cols.append(f"count(CASE WHEN {result} = 'No promovido' THEN 1 END) AS no_promovidos")
    cols.append(f"count(CASE WHEN {result} IN ('Retirado', 'Retirado definitivo') THEN 1 END) AS retirados")
    return ", ".join(cols)


def rate_cols(not_promoted: bool = True) -> str:
    cols = [f"{rate('promovidos', 'total')} AS tasa_promocion"]
    if not_promoted:
        cols.append(f"{rate('no_promovidos', 'total')} AS tasa_no_promocion")
    cols.append(f"{rate('retirados', 'total')} AS tasa_retiro")
    return ", ".join(cols)


def grouped(dim: str, not_promoted: bool = False, source: str = "d") -> str:
    """SELECT body of A8/A5 for one dimension (as a subquery)."""
    return (
        f"SELECT *, {rate_cols(not_promoted)} FROM (SELECT {dim}, {outcome_cols(not_promoted=not_promoted)} "
        f"FROM {source} WHERE {dim} IS NOT NULL GROUP BY {dim})"
    )


DEPARTMENT_SUMMARY = grouped("departamento", not_promoted=True)
NATIONAL = f"SELECT *, {rate_cols(True)} FROM (SELECT {outcome_cols(total='count(*)')} FROM d)"
