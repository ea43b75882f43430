"""Rollups, diagnostics, completeness, payments and contracts over ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schema import CLASSES, DOUBTFUL, EXPENSE, INCOME, NEEDED, SURPLUS, TAX, TRANSFER

SPENT = (EXPENSE, TAX)


def total(condition: Column, value: str = "valor") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)")


def spent() -> Column:
    return F.col("tipo").isin(*SPENT)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or null."""
    return F.coalesce(F.when(b != 0, a.cast("double") / b.cast("double")), F.lit(0.0))


def monthly_summary(rows: DataFrame) -> DataFrame:
    """Income, expense, balance, top category and class totals of each month, transfers left out."""
    rows = rows.filter(F.col("tipo") != TRANSFER)
    by_category = rows.filter(spent()).groupBy("mes_ref", "categoria").agg(F.sum("valor").alias("v"))
    # the largest, the least name among equals: aggregates, no sort
    top = by_category.groupBy("mes_ref").agg(
        F.min_by("categoria", F.struct((-F.col("v")).alias("v"), "categoria")).alias("top_categoria"), F.max("v").cast("decimal(28,2)").alias("top_valor")
    )
    sums = rows.groupBy("mes_ref").agg(
        total(F.col("tipo") == INCOME).alias("receita"), total(spent()).alias("despesa"),
        *[total(spent() & (F.col("classificacao") == c)).alias(n) for c, n in ((NEEDED, "obrigatorio"), (DOUBTFUL, "questionavel"), (SURPLUS, "superfluo"))],
    )
    return sums.join(top, "mes_ref", "left").withColumn("saldo", (F.col("receita") - F.col("despesa")).cast("decimal(28,2)"))


def by_category(rows: DataFrame) -> DataFrame:
    return rows.filter(spent()).groupBy("categoria").agg(F.sum("valor").cast("decimal(28,2)").alias("total"), F.count("*").alias("n"))


def top_share(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest groups and their percent of the total of these n."""
    top = rows.filter(spent()).groupBy(key).agg(F.sum("valor").cast("decimal(28,2)").alias("total")).orderBy(F.desc("total"), key).limit(n)
    return top.withColumn("share", F.round(ratio(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(1)))) * 100, 4))


def month_change(rows: DataFrame) -> DataFrame:
    """Each month's expense against the month before that has rows."""
    months = rows.filter(spent()).groupBy("mes_ref").agg(F.sum("valor").cast("decimal(28,2)").alias("total"))
    w = Window.partitionBy(F.lit(1)).orderBy("mes_ref")  # one row a month
    return months.withColumn("before", F.lag("total").over(w)).withColumn("delta", (F.col("total") - F.col("before")).cast("decimal(28,2)"))


def against_mean(rows: DataFrame, month: str, before: list[str]) -> DataFrame:
    """Expense by category in a month, and its mean over the months before (absent months count as 0)."""
    rows = rows.filter(spent() & F.col("mes_ref").isin(month, *before))
    out = rows.groupBy("categoria").agg(total(F.col("mes_ref") == month).alias("atual"), total(F.col("mes_ref") != month).alias("soma"))
    mean = (F.col("soma").cast("double") / len(before)).alias("media")
    return out.select("categoria", "atual", F.round(mean, 4).alias("media"), F.round(F.col("atual").cast("double") - F.col("soma").cast("double") / len(before), 4).alias("diferenca"))


def anomalies(rows: DataFrame, month: str, before: str) -> DataFrame:
    """Categories that rose over half, came or went between two months."""
    out = rows.filter(spent() & F.col("mes_ref").isin(month, before)).groupBy("categoria").agg(
        total(F.col("mes_ref") == month).alias("atual"), total(F.col("mes_ref") == before).alias("anterior")
    )
    kind = (
        F.when((F.col("anterior") == 0) & (F.col("atual") > 200), "nova").when((F.col("atual") == 0) & (F.col("anterior") > 200), "sumiu")
        .when((F.col("anterior") > 100) & (F.col("atual") > 100) & (F.abs(F.col("atual") - F.col("anterior")) > F.col("anterior") * 0.5), "variou")
    )
    return out.withColumn("anomalia", kind)


def sankey(rows: DataFrame, n: int = 8) -> DataFrame:
    """Edges category -> class -> person of the n largest categories."""
    rows = rows.filter(spent())
    top = rows.groupBy("categoria").agg(F.sum("valor").alias("v")).orderBy(F.desc("v"), "categoria").limit(n).select("categoria")
    kept = rows.join(F.broadcast(top), "categoria", "left_semi")  # n rows
    edges = [kept.groupBy(F.col(a).alias("de"), F.col(b).alias("para")).agg(F.sum("valor").cast("decimal(28,2)").alias("valor")) for a, b in (("categoria", "classificacao"), ("classificacao", "quem"))]
    return edges[0].unionByName(edges[1])


def robust_limits(rows: DataFrame) -> DataFrame:
    """Card use by bank against max(1.5 x largest month, used, 1000)."""
    months = rows.filter(spent()).groupBy("banco_origem", "mes_ref").agg(F.sum("valor").alias("m"))
    out = months.groupBy("banco_origem").agg(F.max("m").alias("maior"), F.max_by("m", "mes_ref").alias("usado"))
    limit = F.greatest((F.col("maior") * F.lit("1.5").cast("decimal(2,1)")).cast("decimal(28,3)"), F.col("usado").cast("decimal(28,3)"), F.lit(1000).cast("decimal(28,3)"))
    return out.select("banco_origem", F.col("usado").cast("decimal(28,2)").alias("usado"), limit.alias("limite"), F.round(F.col("usado").cast("double") / limit.cast("double"), 4).alias("uso"))


def balance_by_bank(rows: DataFrame, today: str, days: int = 30) -> DataFrame:
    from .ledger_ops import signed

    rows = signed(rows)
    recent = F.col("data") > F.date_sub(F.lit(today).cast("date"), days)
    return rows.groupBy("banco_origem").agg(
        F.sum("valor_assinado").cast("decimal(28,2)").alias("saldo"), total(recent, "valor_assinado").alias("delta"), F.count("*").alias("n")
    )


def completeness(rows: DataFrame, documented: DataFrame) -> DataFrame:
    """Month x category: rows with and without a document. ``documented`` has (identificador)."""
    marked = rows.filter(spent()).join(documented.select("identificador").distinct().withColumn("_doc", F.lit(1)), "identificador", "left")
    return marked.groupBy("mes_ref", "categoria").agg(
        F.count("*").alias("total"), F.count("_doc").alias("com_doc"), (F.count("*") - F.count("_doc")).alias("sem_doc"),
        F.round(F.count("_doc") / F.count("*") * 100, 2).alias("cobertura"),
    )


def recurring(rows: DataFrame, key: str, months: int, least: float) -> DataFrame:
    """Keys with rows in at least ``months`` months and a total of at least ``least``."""
    out = rows.filter(spent()).groupBy(key).agg(F.countDistinct("mes_ref").alias("meses"), F.sum("valor").cast("decimal(28,2)").alias("total"))
    return out.filter((F.col("meses") >= months) & (F.col("total") >= least))


def contracts(rows: DataFrame, banks: DataFrame) -> DataFrame:
    """(name, violations) of the arithmetic and domain contracts; one pass for the row-wise ones."""
    expense = F.col("tipo") == EXPENSE
    flags = {
        "despesa_nao_negativa": expense & (F.col("valor") < 0),
        "categoria_em_despesa": expense & F.col("categoria").isNull(),
        "tipo_valido": ~F.col("tipo").isin(INCOME, EXPENSE, TAX, TRANSFER),
        "classe_valida": F.col("tipo").isin(*SPENT) & ~F.col("classificacao").isin(*CLASSES),
        "valor_presente": F.col("valor").isNull(),
    }
    row = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    out = row.unpivot([], list(flags), "contrato", "violacoes")
    unknown = rows.join(banks.select("banco_origem"), "banco_origem", "left_anti").agg(F.count("*").alias("violacoes")).select(F.lit("banco_valido").alias("contrato"), "violacoes")
    classes = rows.filter(F.col("tipo").isin(*SPENT)).groupBy("mes_ref").agg(F.sum("valor").alias("a"), F.sum(F.when(F.col("classificacao").isin(*CLASSES), F.col("valor"))).alias("b"))
    sums = classes.filter(F.abs(F.col("a") - F.coalesce("b", F.lit(0))) > 0.01).agg(F.count("*").alias("violacoes")).select(F.lit("classes_somam_despesa").alias("contrato"), "violacoes")
    return out.unionByName(unknown).unionByName(sums)
