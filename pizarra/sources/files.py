"""File sources and sinks.

* ``scan_departments``: the per-department files named by a catalogue are read
  by ONE scan over the list of existing paths (missing files are skipped
  with a warning; none at all is an error) — never a loop of jobs.
* The department id is stamped from the file each row came from
  (``_metadata.file_path`` -> catalogue file name by plain string functions
  -> id through a map literal), overwriting the data column, as the
  published files require.
* The processed table is written ``partitionBy(departamento_f_codigo)`` so a
  department filter becomes partition pruning, behind a ``rebalance`` hint so
  AQE splits a department holding a large share of rows into several tasks. The
  batch rebalances the raw rows and decodes them where they are written.
"""

from __future__ import annotations

import csv
import math
import uuid
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.dictionary import DEPARTMENT_FILES, TRIAL_DEPARTMENTS
from ..operators.decode import DECODED_ORDER
from ..session import cut, scan_only
from .fixture import RAW_COLUMNS

PART_COL = "departamento_f_codigo"

RAW_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType() if c == "cod_establecimiento" else T.IntegerType(), True)
        for c in RAW_COLUMNS
    ]
)

INDICATORS_SCHEMA = T.StructType(
    [
        T.StructField(
            "indicadores",
            T.StructType(
                [
                    T.StructField("total_estudiantes", T.LongType()),
                    T.StructField("tasa_promocion", T.DoubleType()),
                    T.StructField("tasa_no_promocion", T.DoubleType()),
                    T.StructField("tasa_retiro", T.DoubleType()),
                    T.StructField("por_nivel", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("por_area", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("por_sector", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("por_sexo", T.MapType(T.StringType(), T.DoubleType())),
                ]
            ),
        ),
        T.StructField("insights", T.ArrayType(T.StringType())),
        T.StructField("promedio_retiro_nacional", T.DoubleType()),
    ]
)


# ------------------------------------------------------------ filesystem
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    if not fs.rename(s, d):
        raise OSError(f"rename failed: {src} -> {dst}")


def replace(spark: SparkSession, src: str, dst: str) -> None:
    """Rename over whatever an interrupted run left at ``dst``: a plain rename
    would put the folder inside an existing one."""
    fs, d = _fs(spark, dst)
    fs.delete(d, True)
    rename(spark, src, dst)


def first_data_file(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False) -> str | None:
    """The file itself, or a data file in a folder that has bytes; None without
    one. The listing is read only up to it."""
    fs, p = _fs(spark, path)
    status = fs.getFileStatus(p)
    if not status.isDirectory():
        return path if status.getLen() > 0 else None
    listing = fs.listFiles(p, True) if recursive else fs.listStatusIterator(p)
    while listing.hasNext():
        s = listing.next()
        name = s.getPath().getName()
        if s.isFile() and s.getLen() > 0 and name.endswith(suffix) and not name.startswith(("_", ".")):
            return str(s.getPath().toString())
    return None


def csv_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names on a CSV file's first line."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff")]), ()))


# ------------------------------------------------------------- catalogue
def _file_and_folder(path: Column) -> tuple[Column, Column]:
    """The last two names of a path."""
    return F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def catalogue_file(path: Column, names: Iterable[str]) -> Column:
    """The catalogue entry a row's file belongs to: the file itself
    (``.../guatemala.xlsx``) or its folder (``.../guatemala.csv/part-0.csv``).
    Plain string functions plus a hash-set membership test: the path is the
    same for every row of a file, so no per-row regex."""
    names = list(names)
    last, parent = _file_and_folder(path)
    return F.when(last.isin(*names), last).when(parent.isin(*names), parent)


def stem_of(name: str) -> str:
    return name.rsplit(".", 1)[0] if "." in name else name


def file_stem(path: Column, catalogue: Mapping[int, str] = DEPARTMENT_FILES) -> Column:
    """Catalogue file stem of a row's file (``guatemala``), null outside the catalogue."""
    return F.substring_index(catalogue_file(path, catalogue.values()), ".", 1)


def stamp_department(df: DataFrame, catalogue: Mapping[int, str], path: Column | None = None, column: str = "departamento_f") -> DataFrame:
    """S3: overwrite the department column with the id of the row's file."""
    path = path if path is not None else F.col("_metadata.file_path")
    items = []
    for dep_id, name in catalogue.items():
        items += [F.lit(name), F.lit(dep_id).cast("int")]
    ids = F.create_map(*items)
    return df.withColumn(column, F.coalesce(*[ids[part] for part in _file_and_folder(path)]))


def existing_files(spark: SparkSession, folder: str, catalogue: Mapping[int, str], only: Iterable[int] | None = None) -> dict[int, str]:
    """Catalogue entries whose file exists; warns for each missing one and
    raises when none is found (driver-side metadata calls only)."""
    wanted = set(only) if only is not None else None
    found: dict[int, str] = {}
    for dep_id, name in catalogue.items():
        if wanted is not None and dep_id not in wanted:
            continue
        path = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, path):
            found[dep_id] = path
        else:
            warnings.warn(f"department file not found, skipped: {name}", stacklevel=2)
    if not found:
        raise FileNotFoundError(f"no department data file found in {folder}")
    return found


#: Without these a file is no department file; any other column may be missing.
REQUIRED = ("cod_establecimiento", "resultado_f")


def bound(header: Sequence[str], where: str) -> tuple[T.StructType, list[Column]]:
    """The schema that a CSV reader needs for a header (published or snake_case
    names, in any order), and the raw columns in it under their own names."""
    from .xlsx import canonical

    names = [canonical(h) for h in header]
    known = [n for n in names if n]
    if any(c not in known for c in REQUIRED) or len(set(known)) < len(known):
        raise ValueError(f"{where}: header {tuple(header)} lacks or repeats columns (needed: {', '.join(REQUIRED)})")
    schema = T.StructType([T.StructField(h, RAW_SCHEMA[n].dataType if n else T.StringType()) for h, n in zip(header, names)])
    return schema, [F.col(f"`{h}`").alias(n) for h, n in zip(header, names) if n]


def scan_csv(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The raw columns of CSV files or folders, bound by header name (published or
    snake_case), in whatever order a department has them; a column that it lacks is
    null. One header is read per path, of its first file with bytes; Spark holds
    every other file of the path to it, and a file with another header is an error,
    not swapped data. Empty files have no rows. One scan per distinct header, all in
    one job; ``_file`` is the path a row came from."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        first = first_data_file(spark, path)
        if first is None:
            warnings.warn(f"no data in {path}, skipped", stacklevel=2)
        else:
            by_header.setdefault(csv_header(spark, first), []).append(path)
    if not by_header:
        raise FileNotFoundError("no department file holds any data")
    frames = []
    for header, found in by_header.items():
        schema, columns = bound(header, found[0])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
        frames.append(reader.csv(found).select(*columns, F.col("_metadata.file_path").alias("_file")))
    out = union_departments(frames)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(RAW_SCHEMA[c].dataType).alias(c) for c in RAW_COLUMNS], "_file")


def scan_departments(
    spark: SparkSession,
    folder: str,
    catalogue: Mapping[int, str] = DEPARTMENT_FILES,
    fmt: str | None = None,
    only: Iterable[int] | None = None,
) -> DataFrame:
    """S2 + S3 (+ U1 implicitly): one scan over every existing department
    file, typed by the explicit raw schema, department stamped from the file."""
    found = existing_files(spark, folder, catalogue, only)
    fmt = fmt or next(iter(found.values())).rsplit(".", 1)[-1]
    paths = list(found.values())
    if fmt == "xlsx":
        from .xlsx import read_workbooks

        return stamp_department(read_workbooks(spark, paths), catalogue, F.col("_path")).select(*RAW_COLUMNS)
    if fmt == "csv":
        return stamp_department(scan_csv(spark, paths), catalogue, F.col("_file")).select(*RAW_COLUMNS)
    if fmt != "parquet":
        raise ValueError(f"unsupported format {fmt}")
    df = spark.read.schema(RAW_SCHEMA).parquet(*paths)
    return stamp_department(df, catalogue).select(*RAW_COLUMNS)


def union_departments(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by column name; a column missing in a frame becomes null."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames to union")
    return out


def export_departments(raw: DataFrame, folder: str, catalogue: Mapping[int, str] = DEPARTMENT_FILES, fmt: str = "csv") -> str:
    """Write raw rows as one file set per department, named by the catalogue
    stem (``guatemala.csv/``) — a stand-in for the published per-department
    files, made by one partitioned write plus a rename per department.

    Rows whose department is outside the catalogue have no file to go to: the
    write fails instead of dropping them. Running again over what an
    interrupted run left replaces it."""
    spark = raw.sparkSession
    folder = folder.rstrip("/")
    items = []
    for dep_id, name in catalogue.items():
        items += [F.lit(dep_id).cast("int"), F.lit(f"{stem_of(name)}.{fmt}")]
    staged = f"{folder}/_staging-{uuid.uuid4().hex}"
    outside = F.raise_error(F.concat(F.lit("department outside the catalogue: "), F.coalesce(F.col("departamento_f").cast("string"), F.lit("null"))))
    w = raw.withColumn("archivo", F.coalesce(F.create_map(*items)[F.col("departamento_f")], outside)).write.partitionBy("archivo")
    if fmt == "csv":
        # keep blank padding of the codes: the CSV writer trims by default
        w = w.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        w.csv(staged)
    else:
        w.parquet(staged)
    for name in catalogue.values():
        target = f"{stem_of(name)}.{fmt}"
        src = f"{staged}/archivo={target}"
        if path_exists(spark, src):
            replace(spark, src, f"{folder}/{target}")
    return folder


# ------------------------------------------------------------- processed
def write_processed(rows: DataFrame, path: str, decode: Callable[[DataFrame], DataFrame] | None = None, dept: str = PART_COL) -> None:
    """K1: decoded table, Parquet, one folder per department.

    With ``decode`` the rows are raw ones of department column ``dept``: they are dealt
    and sorted as they are, and decoded in the tasks that write them. A raw row is a
    code and numbers, a decoded one has a dozen labels besides. ``decode`` has to keep
    rows in their place (a projection, not a join)."""
    dealt = rows.hint("rebalance", dept)
    decoded = dealt if decode is None else decode(dealt.sortWithinPartitions(dept))
    decoded.write.mode("overwrite").partitionBy(PART_COL).parquet(path)


def scan_processed(spark: SparkSession, path: str, departments: Iterable[int] | None = None) -> DataFrame:
    """S5 (+ S4 with ``departments``): the decoded table; a department filter
    prunes partitions. Missing table -> FileNotFoundError asking for ingest."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"{path} not found: run the ingest first") from exc
        raise
    if departments is not None:
        df = df.where(F.col(PART_COL).isin(*list(departments)))
    return df.select(*[c for c in DECODED_ORDER if c in df.columns])


def trial_subset(spark: SparkSession, path: str) -> DataFrame:
    """The small-department trial run (partition-pruned read)."""
    return scan_processed(spark, path, TRIAL_DEPARTMENTS)


#: Leading hex digits of the hash whose histogram finds the sample's cutoff; the
#: histogram, and what a task hands to it, has at most 16**SAMPLE_DIGITS rows.
SAMPLE_DIGITS = 4


def sample_exact(df: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """K2: exactly ``min(n, rows)`` rows without replacement, reproducible:
    the ``n`` rows with the smallest ``md5(seed | row)``.

    Rows of files are hashed in one pass: hashes spread evenly, so the share ``n`` of
    all rows says below which hash a little more than ``n`` of them lie, and only these
    are written (a cut table) and ordered. That there are ``n`` of them is counted, not
    assumed; many equal rows, which have one hash, can leave fewer.

    Then, and for rows that are not a plain read of files, every row is written once
    with its hash. A histogram of the hash's leading digits (one aggregate, at most
    ``16**SAMPLE_DIGITS`` rows) gives the bucket in which the n-th row lies; only rows
    up to it reach the final ordering. Without the written table Spark moves the filter
    on the hash into whatever makes the rows (a join's condition, for one) and computes
    it, with all the columns it is made of, several times for every row."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))
    if scan_only(df):
        wanted, rows = n + 8 * math.isqrt(n) + 64, df.count()
        if wanted >= rows:
            return df.orderBy(digest).limit(n)
        # the hash is no column of what is filtered: with it Spark's code for the row
        # outgrows what the JVM compiles
        few = cut(df.where(digest < f"{(wanted << 32) // rows:08x}"))
        if few.count() >= n:
            return few.orderBy(digest).limit(n)
    hashed = cut(df.withColumn("_h", digest))
    bucket = F.substring("_h", 1, SAMPLE_DIGITS)  # hex digits: text order is number order
    counts = hashed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # over the histogram only
    cutoff = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).agg(F.max("b"))
    return hashed.where(bucket <= cutoff.scalar()).orderBy("_h").limit(n).drop("_h")


def write_sample_csv(sample: DataFrame, path: str) -> None:
    sample.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def single_file(df: DataFrame, order: Sequence[Column | str] | None = None) -> DataFrame:
    """One output partition (see ``write_table``); Spark drops a sort placed
    below a repartition, so the order is re-applied within the partition."""
    one = df.repartition(1)
    return one.sortWithinPartitions(*order) if order else one


def write_table(df: DataFrame, path: str, partition_by: str | None = None, order: Sequence[Column | str] | None = None) -> None:
    """K3/K4: small result tables (already aggregated, bounded by group counts),
    one file each, rows in ``order`` if given.

    ``repartition(1)``, not ``coalesce(1)``: a coalesce is narrow, so it would
    pull the aggregate's final merge (for the cube: every map task's partial
    groups over the whole table) into the one writer task. The repartition
    keeps the aggregate parallel and shuffles only its bounded result."""
    w = single_file(df, order).write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_json_document(doc: DataFrame, path: str) -> None:
    """K5: a one-row column with the indicator document as JSON text, written
    indented as a text file (UTF-8, no escaping)."""
    column = doc.columns[0]
    indented = F.to_json(F.from_json(column, INDICATORS_SCHEMA), {"pretty": "true"})
    doc.select(indented.alias(column)).repartition(1).write.mode("overwrite").text(path)


def scan_indicators_json(spark: SparkSession, path: str) -> DataFrame:
    """The indicator document with an explicit schema (pretty or compact)."""
    return spark.read.schema(INDICATORS_SCHEMA).option("multiLine", True).json(path)
