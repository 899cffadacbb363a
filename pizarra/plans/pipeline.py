"""O1: the batch — ingest, then analyse, handing over through Parquet.

Ingest:  department files -> one scan -> decode (one projection) ->
         processed table (partitioned by department) + exact 5,000-row sample.
Analyse: processed table -> ONE aggregate into the outcome cube, written as
         a table (lineage cut: losing an executor later never re-reads the
         raw data) -> every output is a roll-up of the cube:
         department summary, the four gap tables (one long table), and the
         indicator document (figures, shares, insights) as JSON.

The only per-row work is the scan+decode and the cube's partial aggregate;
everything after runs on at most a few hundred thousand cube cells.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionary import DEPARTMENT_FILES, TRIAL_DEPARTMENTS
from ..operators import answers as ans
from ..operators import indicators as ind
from ..operators import insights as ins
from ..operators import quality as qual
from ..operators.decode import DECODED_ORDER, decode_all, decode_join, with_municipality
from ..sources import files

PROCESSED = "educacion_2024"
SAMPLE = "muestra_5000"
CUBE = "outcome_cube"
SUMMARY = "resumen_departamentos"
GAPS = "brechas"
INDICATORS = "indicadores_nacionales"
DEPARTMENT_TEXTS = "insights_departamentos"
MUNICIPALITIES = "municipios"


def ingest(
    spark: SparkSession,
    folder: str,
    out: str,
    catalogue: Mapping[int, str] = DEPARTMENT_FILES,
    fmt: str | None = None,
    trial: bool = False,
    sample_rows: int = 5000,
    dictionary: DataFrame | None = None,
) -> str:
    """``dictionary`` (domain, code, label) replaces the published one."""
    raw = files.scan_departments(spark, folder, catalogue, fmt, TRIAL_DEPARTMENTS if trial else None)
    processed = f"{out}/{PROCESSED}"
    if dictionary is None:
        files.write_processed(raw, processed, decode_all, "departamento_f")
    else:  # joins: the decoded rows are dealt
        files.write_processed(decode_join(with_municipality(raw), dictionary=dictionary).select(*DECODED_ORDER), processed)
    stored = files.scan_processed(spark, processed)
    files.write_sample_csv(files.sample_exact(stored, sample_rows), f"{out}/{SAMPLE}")
    return processed


def analyse(spark: SparkSession, out: str, municipalities: DataFrame | None = None) -> dict[str, str]:
    """``municipalities`` (codigo, municipio) adds the table of municipalities with
    their names."""
    decoded = files.scan_processed(spark, f"{out}/{PROCESSED}")
    cube_path = f"{out}/{CUBE}"
    files.write_table(ind.outcome_cube(decoded), cube_path)
    cube = spark.read.parquet(cube_path)
    outputs = {
        SUMMARY: f"{out}/{SUMMARY}",
        GAPS: f"{out}/{GAPS}",
        INDICATORS: f"{out}/{INDICATORS}",
    }
    files.write_table(ind.department_summary(cube, "n"), outputs[SUMMARY], order=[F.desc("tasa_retiro"), "departamento"])
    files.write_table(ind.gap_all(cube, weight="n"), outputs[GAPS], partition_by="dimension", order=["dimension", "label"])
    files.write_json_document(ans.indicators_document(cube, "n"), outputs[INDICATORS])
    outputs[CUBE] = cube_path
    outputs[DEPARTMENT_TEXTS] = f"{out}/{DEPARTMENT_TEXTS}"
    files.write_table(ins.insights_department(cube, weight="n"), outputs[DEPARTMENT_TEXTS], order=["departamento"])
    if municipalities is not None:
        outputs[MUNICIPALITIES] = f"{out}/{MUNICIPALITIES}"
        files.write_table(qual.municipality_names(decoded, municipalities), outputs[MUNICIPALITIES], order=["departamento", "municipio_codigo"])
    return outputs


def run_pipeline(
    spark: SparkSession,
    folder: str,
    out: str,
    catalogue: Mapping[int, str] = DEPARTMENT_FILES,
    fmt: str | None = None,
    trial: bool = False,
    dictionary: DataFrame | None = None,
    municipalities: DataFrame | None = None,
) -> dict[str, str]:
    ingest(spark, folder, out, catalogue, fmt, trial, dictionary=dictionary)
    return analyse(spark, out, municipalities)


def department(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One department's figures, class and text, from what the batch has written."""
    texts = spark.read.parquet(f"{out}/{DEPARTMENT_TEXTS}")
    return read_summary(spark, out).join(texts, "departamento").where(F.col("departamento") == name)


def answers(spark: SparkSession, out: str, asked: DataFrame) -> DataFrame:
    """B16 over the cube that the batch has written."""
    return ans.answer_batch(spark.read.parquet(f"{out}/{CUBE}"), asked, "n")


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{SUMMARY}")


def context(spark: SparkSession, out: str) -> DataFrame:
    """C1 from the outputs in ``out``; those that were not written are left out."""
    here = {name: f"{out}/{name}" for name in (INDICATORS, SUMMARY, GAPS) if files.path_exists(spark, f"{out}/{name}")}
    return ans.context_from_outputs(
        spark.read.text(here[INDICATORS], wholetext=True) if INDICATORS in here else None,
        spark.read.parquet(here[SUMMARY]) if SUMMARY in here else None,
        spark.read.parquet(here[GAPS]) if GAPS in here else None,
    )
