"""Command line: the batch (ingest -> analyse) and what can be had of its outputs.

    python -m pizarra run --input data/raw --output data/processed [--trial] [--format xlsx]
                          [--dictionary codes.csv] [--municipalities municipios.csv]
    python -m pizarra show --output data/processed [--department Petén]
    python -m pizarra context --output data/processed
    python -m pizarra ask --output data/processed [--questions questions.csv]

CSV files have a header: domain, code, label (dictionary); codigo, municipio
(municipalities); pregunta_id, pregunta, dimension, label, metrica (questions).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answers as ans
from .plans import pipeline as pl
from .session import build_session
from .sources import files


QUESTIONS = "pregunta_id int, pregunta string, dimension string, label string, metrica string"


def table(spark: SparkSession, path: str | None, schema: str) -> DataFrame | None:
    """A CSV file with a header that must be the schema's."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path) if path else None


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="pizarra")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="ingest the department files and compute every output")
    run.add_argument("--input", required=True, help="folder with the per-department files")
    run.add_argument("--output", required=True, help="folder for the processed table and results")
    run.add_argument("--format", default=None, choices=["xlsx", "csv", "parquet"], help="file format (default: from extension)")
    run.add_argument("--trial", action="store_true", help="only the three small trial departments")
    run.add_argument("--dictionary", help="CSV of the code dictionary (default: the published one)")
    run.add_argument("--municipalities", help="CSV of municipality names; adds their table to the outputs")
    show = sub.add_parser("show", help="print the department ranking and the indicator document, or one department")
    show.add_argument("--output", required=True)
    show.add_argument("--department", help="only this department's figures and text")
    context = sub.add_parser("context", help="print the context document (JSON)")
    context.add_argument("--output", required=True)
    ask = sub.add_parser("ask", help="answer structured questions from the aggregates")
    ask.add_argument("--output", required=True)
    ask.add_argument("--questions", help="CSV of questions (default: the sample ones)")
    args = ap.parse_args(argv)

    spark = build_session()
    if args.cmd == "run":
        catalogue = pl.DEPARTMENT_FILES
        if args.format and args.format != "xlsx":
            catalogue = {k: v.rsplit(".", 1)[0] + "." + args.format for k, v in catalogue.items()}
        dictionary = table(spark, args.dictionary, "domain string, code int, label string")
        municipalities = table(spark, args.municipalities, "codigo string, municipio string")
        outputs = pl.run_pipeline(spark, args.input, args.output, catalogue, args.format, args.trial, dictionary, municipalities)
        for name, path in outputs.items():
            print(f"{name}: {path}")
    elif args.cmd == "context":
        print(pl.context(spark, args.output).first()["contexto"])
    elif args.cmd == "ask":
        asked = table(spark, args.questions, QUESTIONS) if args.questions else ans.questions(spark)
        for r in pl.answers(spark, args.output, asked).orderBy("pregunta_id").collect():  # as many as were asked
            print(f"{r['pregunta_id']}. {r['pregunta']} {r['respuesta']} [{r['fuente'] or '-'}]")
    elif args.department:
        row = pl.department(spark, args.output, args.department).first()
        if row is None:
            print(f"no such department: {args.department}", file=sys.stderr)
            spark.stop()
            return 1
        for name, value in row.asDict().items():
            print(f"{name}: {value}")
    else:
        pl.read_summary(spark, args.output).orderBy(F.desc("tasa_retiro"), "departamento").show(30, truncate=False)
        doc = files.scan_indicators_json(spark, f"{args.output}/{pl.INDICATORS}").first()
        print(doc.indicadores)
        for text in doc.insights:
            print("-", text)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
