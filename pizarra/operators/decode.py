"""Ingest-side row operators: code repair, municipality, dictionary decode.

Everything is one projection (a single ``select``), so Catalyst fuses it with
the scan into one whole-stage-codegen stage and column pruning removes any
decoded column a later query does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import municipality, normalise_code
from ..functions.dictionary import DECODE_SPEC, UNKNOWN, dictionary_df, label_map

# Decoded (27-column) layout: labels replace codes under readable names, the
# original codes are kept as ``<raw>_codigo`` after the municipality.
DECODED_ORDER = [
    "anio",
    "cod_establecimiento",
    "departamento",
    "depto_mupio",
    "sector",
    "area",
    "sexo",
    "grado",
    "nivel",
    "pueblo",
    "plan_estudios",
    "jornada",
    "resultado",
    "repitente",
    "graduando",
    "municipio_codigo",
] + [spec[2] for spec in DECODE_SPEC.values()]


def integer_code(df: DataFrame, name: str, schema: T.StructType | None = None) -> Column:
    """A code column as ``int`` the way a dict with int keys sees it: integral
    values match, fractional values (1.5) and malformed text never do.
    Text such as ``'1'`` is read as 1 (documented deviation: a typed scan
    would have produced 1 in the first place)."""
    dtype = (schema or df.schema)[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("int")
    if isinstance(dtype, T.LongType):
        return c.try_cast("int")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.when(c == F.floor(c), c.try_cast("int"))
    return F.trim(c.cast("string")).try_cast("int")


def with_municipality(df: DataFrame, column: str = "cod_establecimiento") -> DataFrame:
    """D1 + D2: repaired code and ``municipio_codigo`` (first two segments)."""
    fixed = normalise_code(column)
    return df.withColumns({column: fixed, "municipio_codigo": municipality(fixed)})


def decode_all(df: DataFrame) -> DataFrame:
    """D1-D6 in one projection.

    * code repaired, municipality derived (only if the code column exists);
    * every present coded column replaced by its label (null or unmapped ->
      ``Desconocido``) and renamed; its original value kept as ``<raw>_codigo``;
    * absent columns are skipped, untouched columns pass through.
    """
    schema = df.schema  # one driver-to-JVM call, not one per column
    present = set(schema.names)
    out: dict[str, Column] = {}
    for name in schema.names:
        if name == "cod_establecimiento":
            fixed = normalise_code(name)
            out[name] = fixed.alias(name)
            out["municipio_codigo"] = municipality(fixed).alias("municipio_codigo")
        elif name in DECODE_SPEC:
            mapping, label_col, _ = DECODE_SPEC[name]
            out[label_col] = F.coalesce(label_map(mapping)[integer_code(df, name, schema)], F.lit(UNKNOWN)).alias(label_col)
        else:
            out[name] = F.col(name)
    for raw, (_, _, code_col) in DECODE_SPEC.items():
        if raw in present:
            out[code_col] = F.col(raw).alias(code_col)
    order = [c for c in DECODED_ORDER if c in out] + [c for c in out if c not in DECODED_ORDER]
    return df.select(*[out[c] for c in order])


def decode_join(df: DataFrame, columns: list[str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """The same decode as a relational lookup against a long dictionary
    ``(domain, code, label)``, the published one unless the caller has another.

    The published dictionary is a local table of under 100 rows, so Spark makes
    each lookup a broadcast hash join by itself; a caller's table goes through
    the same measured-size choice. A code that a caller's dictionary lists
    twice takes the smallest label, so no row is ever multiplied.
    """
    if dictionary is None:
        dictionary = dictionary_df(df.sparkSession)
    else:
        dictionary = dictionary.groupBy("domain", "code").agg(F.min("label").alias("label"))
    columns = columns or [c for c in DECODE_SPEC if c in df.columns]
    out = df
    for raw in columns:
        _, label_col, code_col = DECODE_SPEC[raw]
        lookup = dictionary.where(F.col("domain") == raw).select(F.col("code").alias(f"__k_{raw}"), F.col("label").alias(f"__l_{raw}"))
        out = (
            out.withColumn(f"__c_{raw}", integer_code(out, raw))
            .join(lookup, F.col(f"__c_{raw}") == F.col(f"__k_{raw}"), "left")
            .withColumn(label_col if label_col != raw else f"__n_{raw}", F.coalesce(F.col(f"__l_{raw}"), F.lit(UNKNOWN)))
            .withColumnRenamed(raw, code_col)
            .drop(f"__c_{raw}", f"__k_{raw}", f"__l_{raw}")
        )
        if label_col == raw:
            out = out.withColumnRenamed(f"__n_{raw}", label_col)
    return out
