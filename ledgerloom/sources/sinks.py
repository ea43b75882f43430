"""Writers: files by tag, summaries, and upserts that keep what people entered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that spark.checkpoint.dir names; /tmp where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_by_tag(rows: DataFrame, tag: str, path: str) -> None:
    """A folder of CSV files for each tag, sorted by date within each file; rows without a tag are left out.

    Rows are rebalanced by tag: Spark splits a large tag into several files.
    """
    tagged = rows.filter(F.col(tag).isNotNull())
    tagged.hint("rebalance", tag).sortWithinPartitions(tag, "data").write.partitionBy(tag).option("header", True).csv(path)


def tag_summary(rows: DataFrame, tag: str) -> DataFrame:
    return rows.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.count("*").alias("quantidade"), F.sum("valor").cast("decimal(28,2)").alias("total"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], human: list[str]) -> DataFrame:
    """All keys of both sides: machine columns of the new row where there is one, human columns of the old row first."""
    machine = [c for c in new.columns if c not in key and c not in human]
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in (*machine, *human)], F.lit(True).alias("_old"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in (*machine, *human)], F.lit(True).alias("_new"))
    both = o.join(n, key, "full_outer")
    take = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in machine]
    return both.select(*key, *take, *[F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in human])


#: Columns of the ledger sheet, in their order.
LEDGER_COLUMNS = ("identificador", "data", "valor", "local", "quem", "categoria", "classificacao", "banco_origem", "tipo", "mes_ref")


def write_sheet(rows: DataFrame, columns: tuple[str, ...], path: str) -> None:
    """The listed columns that are there, in the order of the list; others, and private ones (``_``), never leave."""
    rows.select(*[c for c in columns if c in rows.columns and not c.startswith("_")]).write.mode("overwrite").parquet(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One table a sheet below ``path``, in the order of the sheets."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def sheet_counts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    out = None
    for name in names:
        n = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("aba"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def yearly_share(value, rate, life):
    """Value by yearly rate (0.1 where there is none) over its life (2), exactly."""
    rate, life = F.coalesce(rate, F.lit(0.1)), F.coalesce(life, F.lit(2))
    return value.cast("decimal(18,2)") * rate.cast("decimal(8,6)") / life.cast("decimal(6,0)")


def monthly_loss(value, rate, life):
    """Monthly loss of an item, two places."""
    return F.round(yearly_share(value, rate, life), 2).cast("double")


def due_dates(rows: DataFrame) -> DataFrame:
    """(conta, dia) from the columns c and d of a sheet, where they hold both, else from a and b."""
    day = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("int")
    late = F.col("c").isNotNull() & day("d").isNotNull()
    out = rows.select(F.when(late, F.col("c")).otherwise(F.col("a")).alias("conta"), F.when(late, day("d")).otherwise(day("b")).alias("dia"))
    return out.filter("conta is not null and dia between 1 and 31")


def write_reports(rows: DataFrame, path: str) -> None:
    """A Markdown text for each month, below a folder of its name."""
    sums = rows.groupBy("mes_ref").agg(
        F.coalesce(F.sum(F.when(F.col("tipo") == "Receita", F.col("valor"))), F.lit(0)).cast("decimal(28,2)").alias("r"), F.coalesce(F.sum(F.when(F.col("tipo").isin("Despesa", "Imposto"), F.col("valor"))), F.lit(0)).cast("decimal(28,2)").alias("d"))
    text = F.concat(F.lit("# "), "mes_ref", F.lit("\nReceita: "), F.col("r").cast("string"), F.lit("\nDespesa: "), F.col("d").cast("string"))
    sums.select("mes_ref", text.alias("value")).write.partitionBy("mes_ref").option("lineSep", "\0").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\0").option("inferSchema", "false").schema("value string, mes_ref string").text(path).select("mes_ref", F.col("value").alias("texto"))


def write_cache(rows: DataFrame, path: str) -> None:
    """JSON lines; Spark's committer renames finished files, so a reader never sees half a cache."""
    rows.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that fit the schema; others are left out."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter(F.col("_corrupt_record").isNull() | F.col(names[0]).isNotNull()).select(*names)


def idempotent(old: DataFrame | None, new: DataFrame, key: tuple[str, ...] = ("tipo", "data", "categoria")) -> DataFrame:
    """``old`` with those of ``new`` whose hash (12 digits over the key) it lacks; each hash once."""
    hashed = new.withColumn("hash", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key]), 256), 1, 12)).dropDuplicates(["hash"])
    return hashed if old is None else old.unionByName(hashed.join(old.select("hash"), "hash", "left_anti"))


def divergences(rows: DataFrame, proof: DataFrame, key: str) -> DataFrame:
    """Three flags of what differs between a proof and the ledger, and the masked text."""
    p = proof.select(key, *[F.col(c).alias(f"_{c}") for c in ("valor", "data", "local")])
    flags = [(~F.col(f"_{c}").eqNullSafe(F.col(c))).alias(f"dif_{c}") for c in ("valor", "data", "local")]
    return rows.join(p, key).select(key, *flags, F.regexp_replace("local", r"[0-9]{3}\.[0-9]{3}", "***").alias("local"))


def retained(days: DataFrame, today: str, daily: int, weekly: int) -> DataFrame:
    """Backups that stay: those of the last ``daily`` days, and the last of each of the ``weekly`` weeks before."""
    end = F.lit(today).cast("date")
    recent = F.col("dia") > F.date_sub(end, daily)
    older = days.filter(~recent & (F.col("dia") > F.date_sub(end, daily + 7 * weekly))).groupBy(F.date_trunc("week", "dia").alias("w")).agg(F.max("dia").alias("dia")).select("dia")
    return days.filter(recent).unionByName(older)


def tax_package(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Writes totals (JSON), rows by tag (CSV) and the originals (text), and gives the totals as they were read back."""
    tag_summary(rows, "tag").write.json(f"{path}/totais")
    write_by_tag(rows.select("identificador", "data", "valor", "tag"), "tag", f"{path}/eventos")
    rows.select(F.col("identificador").cast("string").alias("value")).distinct().write.text(f"{path}/originais")
    back = spark.read.schema("tag string, quantidade bigint, total decimal(28,2)").json(f"{path}/totais")
    return back.select("tag", F.col("quantidade").alias("n"), "total")


def note_actions(old: DataFrame, new: DataFrame, marker: str | None = None) -> DataFrame:
    """(nota, acao) of notes (nota, texto): new ones, changed ones, and those whose text is the same, which are not written.

    With a ``marker``, which every written note has, a note without it is a person's own and stays (``pessoal``).
    """
    own = F.lit(False) if marker is None else ~F.contains("texto", F.lit(marker))
    o = old.select("nota", F.sha2("texto", 256).alias("_o"), own.alias("_own"))
    same = F.col("_o") == F.sha2("texto", 256)
    return new.join(o, "nota", "left").select("nota", F.when(F.col("_o").isNull(), "nova").when(F.col("_own"), "pessoal").when(same, "igual").otherwise("mudou").alias("acao"))


def _checksum(rows: DataFrame) -> tuple:
    """Rows and a checksum that does not depend on their order."""
    return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows.columns)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())


def backup(rows: DataFrame, path: str) -> tuple:
    """Writes the rows and returns the checksum of what was written."""
    rows.write.parquet(path)
    return _checksum(rows.sparkSession.read.schema(rows.schema).parquet(path))


def restore(spark: SparkSession, path: str, checksum: tuple) -> DataFrame:
    """The rows of a backup, if they have the checksum."""
    rows = spark.read.parquet(path)
    if _checksum(rows) != checksum:
        raise ValueError("the backup is not what was written")
    return rows
