"""Phases of a run whose figures are observed while they are written, and audits of proofs against outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.sinks import shared_path

FIGURES = "fase int, nome string, linhas long, nulos long, erro string"


def run_phases(rows: DataFrame, phases: list[tuple[str, Callable[[DataFrame], DataFrame]]], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows after all phases, and a row of figures for each: rows written, rows with a null, error.

    Each phase is written below ``path`` and the next one reads it; its figures are collected by Spark during that one write,
    without a second pass. A phase that fails ends the run; its row has the error, and the rows are those of the phase
    before. The figures are written as JSON beside the phases.
    """
    spark, path = rows.sparkSession, path or shared_path(rows.sparkSession, "phases")
    figures = []
    for n, (name, phase) in enumerate(phases, 1):
        try:
            out, seen = phase(rows), Observation(f"phase {n}")
            some_null: Column = F.lit(False)
            for c in out.columns:
                some_null = some_null | F.col(c).isNull()
            out.observe(seen, F.count(F.lit(1)).alias("linhas"), F.count_if(some_null).alias("nulos")).write.mode("overwrite").parquet(f"{path}/{n}")
            figures.append((n, name, seen.get["linhas"], seen.get["nulos"], None))
            rows = spark.read.schema(out.schema).parquet(f"{path}/{n}")
        except Exception as e:  # noqa: BLE001  a failed phase is a row of the figures
            figures.append((n, name, None, None, type(e).__name__))
            break
    spark.createDataFrame(figures, FIGURES).coalesce(1).write.mode("overwrite").json(f"{path}/figures")
    return rows, spark.read.schema(FIGURES).json(f"{path}/figures")


def cross_audit(proofs: DataFrame, nodes: DataFrame, values: list[str]) -> dict[str, DataFrame]:
    """Four sheets of an audit: every proof with its node, figures by type, types with few samples, and each divergence.

    ``proofs`` has (sha, tipo, values...), ``nodes`` (sha, tipo, values...), one row a file each; files of one side only are
    kept. A file is ``ok`` where all values agree, and a type graduates with two such files.
    """
    p = proofs.select("sha", F.col("tipo").alias("tipo_prova"), *(F.col(v).alias(f"prova_{v}") for v in values), F.lit(True).alias("_p"))
    n = nodes.select("sha", F.col("tipo").alias("tipo_no"), *(F.col(v).alias(f"no_{v}") for v in values), F.lit(True).alias("_n"))
    both = p.join(n, "sha", "full_outer")
    differ = [~F.col(f"prova_{v}").eqNullSafe(F.col(f"no_{v}")) for v in values]
    count = sum((d.cast("int") for d in differ), F.lit(0))
    state = F.when(F.col("_n").isNull(), "sem no").when(F.col("_p").isNull(), "sem prova").when(count > 0, "divergente").otherwise("ok")
    audit = both.withColumns({"tipo": F.coalesce("tipo_prova", "tipo_no"), "estado": state, "divergencias": F.when(F.col("_p") & F.col("_n"), count)})
    sheet = audit.select("sha", "tipo", "estado", "divergencias")
    summary = sheet.groupBy("tipo").agg(*(F.count_if(F.col("estado") == s).alias(s.replace(" ", "_")) for s in ("ok", "divergente", "sem no", "sem prova")))
    missing = summary.filter("ok < 2").select("tipo", (F.lit(2) - F.col("ok")).alias("faltam"))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("campo"), F.col(f"prova_{v}").cast("string").alias("prova"), F.col(f"no_{v}").cast("string").alias("no")) for v in values)))
    details = audit.filter("estado = 'divergente'").select("sha", each.alias("x")).select("sha", "x.campo", "x.prova", "x.no").filter(~F.col("prova").eqNullSafe(F.col("no")))
    return {"auditoria_cruzada": sheet, "tipos_resumo": summary, "amostras_faltantes": missing, "divergencias_detalhe": details}


def mood_heat_map(moods: DataFrame, today: str, days: int = 90) -> DataFrame:
    """(data, autor, humor): the cells of the last ``days``: one a day and author, that of the first path."""
    recent = moods.filter(F.col("data").between(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date")) & F.col("humor").isNotNull())
    return recent.groupBy("data", "autor").agg(F.min_by("humor", "path").alias("humor"))


def write_heat_map(cells: DataFrame, path: str) -> None:
    """One JSON document a month of cells, sorted, so that no document holds more than a month."""
    cell = F.struct(F.date_format("data", "yyyy-MM-dd").alias("data"), "autor", "humor")
    months = cells.groupBy(F.date_format("data", "yyyy-MM").alias("mes")).agg(F.array_sort(F.collect_list(cell)).alias("celulas"))
    months.write.mode("overwrite").json(path)


def read_heat_map(spark: SparkSession, path: str) -> DataFrame:
    schema = "mes string, celulas array<struct<data: string, autor: string, humor: double>>"
    cells = spark.read.schema(schema).json(path).select(F.explode("celulas").alias("c"))
    return cells.select(F.col("c.data").cast("date").alias("data"), "c.autor", "c.humor")
