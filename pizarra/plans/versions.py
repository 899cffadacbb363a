"""Registered queries between versions of the files, and by sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dictionary import DEPARTMENT_FILES
from ..operators import quality as qual
from ..operators import sketches, versions
from ..operators.decode import decode_all
from ..session import cut, fresh_dir
from ..sources import files
from ..sources.fixture import enrolments
from . import cube_store
from . import oracle as o
from .registry import register

W = o.with_views
CSV_CATALOGUE = {k: v.replace(".xlsx", ".csv") for k, v in DEPARTMENT_FILES.items()}

# A second version of the files: department 5's undecided outcomes are settled,
# department 7 came twice, department 9's preprimary level is missing.
NEW_SQL = (
    "SELECT * REPLACE (CASE WHEN departamento_f = 5 AND resultado_f = 9 THEN 1 ELSE resultado_f END AS resultado_f) FROM e "
    "WHERE NOT COALESCE(departamento_f = 9 AND nivel = 1, false) UNION ALL SELECT * FROM e WHERE departamento_f = 7"
)
DIFF_SQL = (
    "SELECT * EXCLUDE (s_old, s_new), CAST(s_old AS BIGINT) AS n_old, CAST(s_new AS BIGINT) AS n_new, "
    "CASE WHEN s_old = 0 THEN 'added' WHEN s_new = 0 THEN 'removed' ELSE 'changed' END AS change FROM ("
    "SELECT * EXCLUDE (is_new), count(CASE WHEN NOT is_new THEN 1 END) AS s_old, count(CASE WHEN is_new THEN 1 END) AS s_new FROM ("
    f"SELECT *, false AS is_new FROM e UNION ALL SELECT *, true FROM ({NEW_SQL})) GROUP BY ALL) WHERE s_old <> s_new"
)


def two_versions(spark, sf_dir):
    """Both versions, written as an ingest would have left them."""
    e = cut(enrolments(spark, sf_dir))
    settled = F.when((F.col("departamento_f") == 5) & (F.col("resultado_f") == 9), 1).otherwise(F.col("resultado_f"))
    missing = F.coalesce((F.col("departamento_f") == 9) & (F.col("nivel") == 1), F.lit(False))
    return e, e.where(~missing).withColumn("resultado_f", settled).unionAll(e.where("departamento_f = 7"))


@register("ingest_diff", W(DIFF_SQL))
def q_ingest_diff(spark, sf_dir):
    return versions.multiset_diff(*two_versions(spark, sf_dir))


@register(
    "ingest_diff_summary",
    W(f"SELECT departamento_f, CAST(sum(greatest(n_new - n_old, 0)) AS BIGINT) AS added, CAST(sum(greatest(n_old - n_new, 0)) AS BIGINT) AS removed FROM ({DIFF_SQL}) GROUP BY departamento_f"),
)
def q_ingest_diff_summary(spark, sf_dir):
    return versions.diff_summary(versions.multiset_diff(*two_versions(spark, sf_dir)), ["departamento_f"])


@register(
    "incremental_cube",
    W(
        "SELECT departamento, area, sector, sexo, nivel, pueblo, resultado, count(*) AS n FROM d "
        "WHERE departamento_f_codigo <> 4 AND NOT (departamento_f_codigo = 3 AND sexo_codigo = 1) GROUP BY ALL"
    ),
)
def q_incremental_cube(spark, sf_dir):
    """Files of 20 departments, then two that come later, one that is replaced, one
    that goes, and the same batch once more."""
    store = fresh_dir(spark, "cube-store")
    raw = enrolments(spark, sf_dir)
    first = files.export_departments(raw, fresh_dir(spark, "files-1"), DEPARTMENT_FILES, "csv")
    second = files.export_departments(
        raw.where("departamento_f in (21, 22) or (departamento_f = 3 and sexo <> 1)"), fresh_dir(spark, "files-2"), DEPARTMENT_FILES, "csv"
    )
    cube_store.apply(spark, store, "enero", first, catalogue=CSV_CATALOGUE, only=[k for k in CSV_CATALOGUE if k < 21])
    for _ in range(2):
        cube_store.apply(spark, store, "febrero", second, deleted=[4], catalogue=CSV_CATALOGUE, only=[3, 21, 22])
    return cube_store.cube(spark, store)


SCHOOL = "CASE WHEN size(split(cod_establecimiento, '-', -1)) >= 3 THEN substring_index(cod_establecimiento, '-', 3) END"
SCHOOL_SQL = (
    "CASE WHEN len(string_split(cod_establecimiento, '-')) >= 3 THEN split_part(cod_establecimiento, '-', 1) || '-' || "
    "split_part(cod_establecimiento, '-', 2) || '-' || split_part(cod_establecimiento, '-', 3) END"
)


@register(
    "school_sketches",
    W(
        f"SELECT departamento, count(*) AS n, count(DISTINCT {SCHOOL_SQL}) AS establecimientos, count(DISTINCT cod_establecimiento) AS codigos, "
        "true AS dentro_de_cota, true AS igual_que_directo FROM d GROUP BY departamento"
    ),
)
def q_school_sketches(spark, sf_dir):
    """Schools and codes per department from a cube of sketches by department, level
    and area, beside the exact counts: whether the estimates keep the error bound,
    and whether the roll-up equals the sketch of the rows themselves."""
    view = cut(decode_all(enrolments(spark, sf_dir)).select("departamento", "nivel", "area", "cod_establecimiento"))
    values = {"s": F.expr(SCHOOL), "c": F.col("cod_establecimiento")}
    cube = sketches.sketch_cube(view, ["departamento", "nivel", "area"], values)
    rolled = sketches.roll_up(cube, ["departamento"], ["s", "c"])
    direct = sketches.sketch_cube(view, ["departamento"], values)

    def settled(df, suffix):
        """Estimates that depend on the sketch's registers only: united with itself, a
        sketch forgets the order in which it was made, which sharpens its estimate."""
        return df.select("departamento", *(F.hll_sketch_estimate(F.hll_union(c, c)).alias(f"{c}{suffix}") for c in "sc"))

    same = settled(rolled, "_rolled").join(settled(direct, "_direct"), "departamento")
    exact = qual.school_counts(view)
    both = sketches.estimates(rolled, ["s", "c"]).join(same, "departamento").join(exact, "departamento")
    near = lambda est, n: F.abs(F.col(est) - F.col(n)) <= F.lit(sketches.error_bound()) * F.col(n)
    return both.select(
        "departamento", "n", "establecimientos", "codigos",
        (near("s", "establecimientos") & near("c", "codigos")).alias("dentro_de_cota"), ((F.col("s_rolled") == F.col("s_direct")) & (F.col("c_rolled") == F.col("c_direct"))).alias("igual_que_directo"),
    )
