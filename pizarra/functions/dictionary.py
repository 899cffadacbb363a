"""Code dictionaries of the enrolment microdata.

The published data carries integer codes; these dictionaries turn them into
readable labels. They are exposed three ways:

* plain Python dicts (``DOMAINS``), the single source of truth;
* Spark ``MapType`` literals (``label_map``) for row-level decode inside
  whole-stage codegen, with no join and no Python on the hot path;
* a long ``dictionary(domain, code, label)`` DataFrame for the relational
  form of the decode (a broadcast join: the table has < 100 rows, a bound
  fixed by the published code lists, not by the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import per_context

# ---------------------------------------------------------------------------
# FIXED VALUES: code -> label dictionaries of the published data dictionary.
# They must stay byte-exact (accents included) for results to match.
# ---------------------------------------------------------------------------
SECTOR = {1: "Público", 2: "Privado", 3: "Municipal", 4: "Cooperativa"}
AREA = {1: "Urbana", 2: "Rural", 9: "Ignorado"}
SEXO = {1: "Hombre", 2: "Mujer", 9: "Ignorado"}
NIVEL = {
    1: "Preprimaria",
    2: "Primaria",
    3: "Básico",
    4: "Diversificado",
    5: "Primaria de adultos",
    9: "Ignorado",
}
PUEBLO = {
    1: "Maya",
    2: "Garífuna",
    3: "Xinka",
    4: "Afrodescendiente/Creole/Afromestizo",
    5: "Ladino/Mestizo",
    6: "Extranjero",
    9: "Ignorado",
}
PLAN_ESTUDIOS = {
    1: "Diario",
    2: "Fin de semana",
    3: "Virtual a distancia",
    4: "Semipresencial",
    5: "Mixto",
}
JORNADA = {
    1: "Matutina",
    2: "Vespertina",
    3: "Nocturna",
    4: "Doble",
    5: "Intermedia",
    9: "Ignorado",
}
RESULTADO = {
    1: "Promovido",
    2: "Vigente",
    3: "Retirado",
    4: "Retirado definitivo",
    5: "No promovido",
    9: "Ignorado",
}
REPITENTE = {1: "Sí", 2: "No", 9: "Ignorado"}
GRADUANDO = {1: "Sí", 2: "No", 9: "Ignorado"}
DEPARTAMENTOS = {
    1: "Guatemala",
    2: "El Progreso",
    3: "Sacatepéquez",
    4: "Chimaltenango",
    5: "Escuintla",
    6: "Santa Rosa",
    7: "Sololá",
    8: "Totonicapán",
    9: "Quetzaltenango",
    10: "Suchitepéquez",
    11: "Retalhuleu",
    12: "San Marcos",
    13: "Huehuetenango",
    14: "Quiché",
    15: "Baja Verapaz",
    16: "Alta Verapaz",
    17: "Petén",
    18: "Izabal",
    19: "Zacapa",
    20: "Chiquimula",
    21: "Jalapa",
    22: "Jutiapa",
}
# Department id -> workbook file name of the published release.
DEPARTMENT_FILES = {
    1: "guatemala.xlsx",
    2: "el_progreso.xlsx",
    3: "sacatepequez.xlsx",
    4: "chimaltenango.xlsx",
    5: "escuintla.xlsx",
    6: "santa_rosa.xlsx",
    7: "solola.xlsx",
    8: "totonicapan.xlsx",
    9: "quetzaltenango.xlsx",
    10: "suchitepequez.xlsx",
    11: "retalhuleu.xlsx",
    12: "san_marcos.xlsx",
    13: "huehuetenango.xlsx",
    14: "quiche.xlsx",
    15: "baja_verapaz.xlsx",
    16: "alta_verapaz.xlsx",
    17: "peten.xlsx",
    18: "izabal.xlsx",
    19: "zacapa.xlsx",
    20: "chiquimula.xlsx",
    21: "jalapa.xlsx",
    22: "jutiapa.xlsx",
}
# Published record count per department file (control totals of the release).
DEPARTMENT_RECORDS = {
    16: 391085,
    15: 81736,
    4: 166965,
    20: 127409,
    2: 49803,
    5: 207618,
    1: 863879,
    13: 316771,
    18: 120326,
    21: 99625,
    22: 134571,
    17: 169629,
    9: 232627,
    14: 268998,
    11: 98128,
    3: 91552,
    12: 303565,
    6: 108264,
    7: 122831,
    10: 159287,
    8: 113139,
    19: 71079,
}
# Small-department trial run (development mode of the batch).
TRIAL_DEPARTMENTS = (2, 19, 15)
# Establishment-code 4th segment -> level code it offers.
SEGMENT_LEVEL = {"40": 1, "41": 1, "42": 1, "43": 2, "44": 5, "45": 3, "46": 4}
# Valid grade range per level code (inclusive).
GRADE_RANGES = {1: (0, 6), 2: (1, 6), 3: (1, 3), 4: (4, 7), 5: (1, 4)}
# Expected full-release shares (percent) used by the control check.
CONTROL_SHARES = {
    "sector": {"Público": 74.7, "Privado": 20.9, "Cooperativa": 4.0, "Municipal": 0.3},
    "area": {"Rural": 61.4, "Urbana": 38.6},
    "sexo": {"Hombre": 50.7, "Mujer": 49.3},
    "nivel": {"Primaria": 56.4, "Básico": 17.8, "Preprimaria": 17.1, "Diversificado": 8.5},
    "resultado": {"Promovido": 85.2, "No promovido": 9.2, "Retirado": 5.5},
}
# Published totals: (figure, whether it is published as "about").
CONTROL_TOTALS = {"inscripciones": (4298887, False), "municipios_guatemala": (17, False), "municipios": (340, True)}
UNKNOWN = "Desconocido"
IGNORED = "Ignorado"
# Outcome label sets.
PROMOTED = ("Promovido",)
NOT_PROMOTED = ("No promovido",)
DROPPED_OUT = ("Retirado", "Retirado definitivo")
# ---------------------------------------------------------------------------

# raw column -> (dictionary, decoded label column, kept-code column).
# Raw names are the snake_case form of the published headers.
DECODE_SPEC: dict[str, tuple[dict[int, str], str, str]] = {
    "sector": (SECTOR, "sector", "sector_codigo"),
    "area": (AREA, "area", "area_codigo"),
    "sexo": (SEXO, "sexo", "sexo_codigo"),
    "nivel": (NIVEL, "nivel", "nivel_codigo"),
    "pueblo_per": (PUEBLO, "pueblo", "pueblo_per_codigo"),
    "plan_est": (PLAN_ESTUDIOS, "plan_estudios", "plan_est_codigo"),
    "jornada_est": (JORNADA, "jornada", "jornada_est_codigo"),
    "resultado_f": (RESULTADO, "resultado", "resultado_f_codigo"),
    "repitente": (REPITENTE, "repitente", "repitente_codigo"),
    "graduando": (GRADUANDO, "graduando", "graduando_codigo"),
    "departamento_f": (DEPARTAMENTOS, "departamento", "departamento_f_codigo"),
}

DOMAINS: dict[str, dict[int, str]] = {raw: spec[0] for raw, spec in DECODE_SPEC.items()}


@per_context
def _map_of(items: tuple[tuple[int, str], ...]) -> Column:
    return F.create_map(*[x for code, label in items for x in (F.lit(code).cast("int"), F.lit(label))])


def label_map(mapping: dict[int, str]) -> Column:
    """``map<int,string>`` literal; constant-folded by Catalyst. Building it costs
    a driver-to-JVM call per entry, so the last few are kept."""
    return _map_of(tuple(mapping.items()))


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant table as SQL ``VALUES``: a local relation whose size
    Spark knows, so it picks the join strategy by itself."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(value)

    casts = ", ".join(f"CAST(c{i} AS {kind}) AS `{name}`" for i, (name, kind) in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")


def decode_expr(col: Column | str, mapping: dict[int, str]) -> Column:
    """Label for a code; null code or a code absent from the map -> ``Desconocido``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(label_map(mapping)[c], F.lit(UNKNOWN))


def dictionary_df(spark: SparkSession) -> DataFrame:
    """Long ``(domain, code, label)`` table of every dictionary (< 100 rows)."""
    rows = [(raw, code, label) for raw, mapping in DOMAINS.items() for code, label in mapping.items()]
    return local_table(spark, rows, "domain string, code int, label string")
