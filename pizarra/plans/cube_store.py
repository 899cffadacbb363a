"""The outcome cube as a versioned table that changed files correct.

Each department file's own cube is kept beside the whole one. When files change,
only those are scanned; the difference between their new and their old cube is a
signed delta, and the whole cube plus the delta is the next version. Deleting a
file is a delta with no new side.

Layout of a store folder:

* ``parts/<commit>/``: cubes of the files that one commit scanned, by ``file``;
* ``cube/<commit>/``: the whole cube after a commit;
* ``commits/<n>.json``: commit n, with its batch id and, per live file, the commit
  that holds its cube.

A commit counts once its JSON is there, and that is put in place by a rename, last of
all: what an interrupted commit left is never read and its folder names are never
used again. A batch id that has been committed changes nothing when it is replayed.
Commits are made one at a time (one writer); readers always see a whole version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionary import DEPARTMENT_FILES
from ..operators import indicators as ind
from ..operators.decode import decode_all
from ..sources import files


def _commits(spark: SparkSession, store: str) -> list[str]:
    fs, p = files._fs(spark, f"{store}/commits")
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _publish(spark: SparkSession, store: str, number: int, commit: dict) -> None:
    fs, temporary = files._fs(spark, f"{store}/commits/_{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(commit, sort_keys=True), "utf-8"))
    out.close()
    target = f"{store}/commits/{number:012d}.json"
    if files.path_exists(spark, target):
        raise RuntimeError(f"commit {number} is there already: another writer is at work")
    files.rename(spark, str(temporary.toString()), target)


def latest(spark: SparkSession, store: str) -> dict:
    """The newest commit: number, name, batch, files (file -> commit name); an empty
    store has number 0 and no files."""
    found = _commits(spark, store.rstrip("/"))
    return _read(spark, found[-1]) if found else {"number": 0, "name": None, "batch": None, "files": {}}


def committed(spark: SparkSession, store: str, batch: str) -> bool:
    found = _commits(spark, store.rstrip("/"))
    return bool(found) and not spark.read.text(found, wholetext=True).where(F.get_json_object("value", "$.batch") == batch).isEmpty()


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{d} string" for d in ind.CUBE_DIMS) + ", n long")


def apply(spark: SparkSession, store: str, batch: str, changed: str | None = None, deleted: Sequence[int] = (), catalogue: Mapping[int, str] = DEPARTMENT_FILES, only: Sequence[int] | None = None, fmt: str = "csv") -> int:
    """Commit a batch of changes and return the version's number.

    The folder ``changed`` holds the new or replaced department files (``only``
    those of some departments); files of ``deleted`` departments go. The work is a
    scan of the changed files and a merge of cubes, whose size the code domains
    bound."""
    store = store.rstrip("/")
    last = latest(spark, store)
    if committed(spark, store, batch):
        return last["number"]
    name = f"{last['number'] + 1:012d}-{uuid.uuid4().hex}"
    names = {files.stem_of(v): k for k, v in catalogue.items()}
    found = files.existing_files(spark, changed, catalogue, only) if changed else {}
    fresh = [files.stem_of(catalogue[k]) for k in found]
    gone = [files.stem_of(catalogue[k]) for k in deleted if k not in found]
    unknown = sorted(set(gone) - set(last["files"]))
    if unknown:
        raise ValueError(f"not in the store: {unknown}")
    if found:
        raw = files.scan_departments(spark, changed, catalogue, fmt, list(found))
        stem = {v: k for k, v in names.items()}
        items = [x for dep, s in stem.items() for x in (F.lit(dep), F.lit(s))]
        rows = decode_all(raw).withColumn("file", F.create_map(*items)[F.col("departamento_f_codigo")])
        # file and departamento go together; files without rows have no part
        cube = rows.groupBy("file", *ind.CUBE_DIMS).agg(F.count(F.lit(1)).alias("n"))
        cube.repartition(1).write.parquet(f"{store}/parts/{name}")
    delta = _empty(spark)
    if found:
        delta = delta.unionByName(spark.read.parquet(f"{store}/parts/{name}").select(*ind.CUBE_DIMS, "n"))
    replaced = [f for f in (*fresh, *gone) if f in last["files"]]
    if replaced:
        delta = delta.unionByName(parts(spark, store, {f: last["files"][f] for f in replaced}).select(*ind.CUBE_DIMS, (-F.col("n")).alias("n")))
    whole = spark.read.parquet(f"{store}/cube/{last['name']}") if last["name"] else _empty(spark)
    merged = whole.unionByName(delta).groupBy(*ind.CUBE_DIMS).agg(F.sum("n").alias("n")).where("n <> 0")
    merged.repartition(1).write.parquet(f"{store}/cube/{name}")
    live = {f: c for f, c in last["files"].items() if f not in gone} | {f: name for f in fresh}
    _publish(spark, store, last["number"] + 1, {"number": last["number"] + 1, "name": name, "batch": batch, "files": live})
    return last["number"] + 1


def parts(spark: SparkSession, store: str, where: Mapping[str, str]) -> DataFrame:
    """The stored cubes of some files (file -> commit name), one scan."""
    folders = sorted(set(where.values()))
    wanted = F.array(*(F.concat(F.lit(f), F.lit("/"), F.lit(c)) for f, c in where.items()))
    rows = spark.read.parquet(*(f"{store.rstrip('/')}/parts/{c}" for c in folders))
    commit = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    return rows.where(F.array_contains(wanted, F.concat(F.col("file"), F.lit("/"), commit))).select("file", *ind.CUBE_DIMS, "n")


def cube(spark: SparkSession, store: str, number: int | None = None) -> DataFrame:
    """The whole cube, of the newest version or of one that is named."""
    store = store.rstrip("/")
    commit = latest(spark, store) if number is None else _read(spark, f"{store}/commits/{number:012d}.json")
    if commit["name"] is None:
        raise FileNotFoundError(f"no commit in {store}")
    return spark.read.parquet(f"{store}/cube/{commit['name']}").select(*ind.CUBE_DIMS, "n")
