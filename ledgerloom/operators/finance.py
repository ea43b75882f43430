"""Projections, bills, calendars, tax regimes and payslips, as expressions over rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import CLASSES, EXPENSE, INCOME, TAX, TRANSFER

from .analytics import spent, total
from .graph import _stored
from .rules import first_match
from .similar import greedy_heads, nearest_heads

MONEY = "decimal(28,2)"


def balances(rows: DataFrame) -> DataFrame:
    """(mes_ref, saldo): income less expense of each month with rows, transfers left out."""
    months = rows.filter(F.col("tipo") != TRANSFER).groupBy("mes_ref")
    return months.agg((total(F.col("tipo") == INCOME) - total(spent())).cast(MONEY).alias("saldo"))


def rhythms(rows: DataFrame, spans: tuple[int, ...] = (12, 3)) -> DataFrame:
    """Mean monthly balance over all months and over the last n; null where there are fewer than n months.

    One pass: the sorted list of months (one entry a month) is cut to its last n.
    """
    months = balances(rows).agg(F.array_sort(F.collect_list(F.struct("mes_ref", F.col("saldo").cast("double").alias("saldo")))).alias("m"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["saldo"]) / F.size(a)
    columns = [F.round(F.when(F.size("m") > 0, mean(F.col("m"))), 2).alias("todos")]
    columns += [F.round(F.when(F.size("m") >= n, mean(F.slice("m", -n, n))), 2).alias(f"ultimos_{n}") for n in spans]
    return months.select(*columns)


def robust_contribution(rhythm: DataFrame) -> DataFrame:
    """The largest positive of the rhythms, 0 if none is."""
    return rhythm.withColumn("aporte", F.greatest(F.lit(0.0), *rhythm.columns))


def curve(start: Column, rate: Column, deposit: Column, month: Column) -> Column:
    """Value after ``month`` months of v -> v * (1 + rate / 12) + deposit, in closed form."""
    i = rate / 12
    growth = F.pow(1 + i, month)
    return F.when(rate == 0, start + deposit * month).otherwise(start * growth + deposit * (growth - 1) / i)


def curves(spark: SparkSession, start: float, deposit: float, rates: dict[str, float], months: int) -> DataFrame:
    """(cenario, mes, valor) for each scenario and month from 0."""
    cases = spark.createDataFrame([(n, float(r)) for n, r in rates.items()], "cenario string, taxa double")
    rows = cases.select("cenario", "taxa", F.explode(F.sequence(F.lit(0), F.lit(months))).alias("mes"))
    return rows.select("cenario", "mes", F.round(curve(F.lit(float(start)), F.col("taxa"), F.lit(float(deposit)), F.col("mes")), 2).alias("valor"))


def months_until(curve_rows: DataFrame, goal: float) -> DataFrame:
    """First month in which each scenario reaches the goal, null if none does."""
    return curve_rows.groupBy("cenario").agg(F.min(F.when(F.col("valor") >= goal, F.col("mes"))).alias("meses"))


def months_to_goal(balance: Column, goal: Column, now: Column) -> Column:
    """ceil(missing / balance): 0 if reached, null if the balance is not positive."""
    return F.when(now >= goal, 0).when(balance > 0, F.ceil((goal - now) / balance)).cast("long")


def expected_bills(terms: DataFrame, paid: DataFrame, today: str) -> DataFrame:
    """Expected bill of each account in today's month - due on its day, the 28th at most - unless paid.

    terms: (conta, dia); paid: (conta, mes_ref).
    """
    day = F.lit(today).cast("date")
    due = F.make_date(F.year(day), F.month(day), F.least("dia", F.lit(28)))
    open_terms = terms.join(paid.filter(F.col("mes_ref") == F.date_format(day, "yyyy-MM")).select("conta").distinct(), "conta", "left_anti")
    return open_terms.select("conta", due.alias("vencimento"), F.when(due < day, "atrasado").otherwise("pendente").alias("status"))


def due_calendar(terms: DataFrame, today: str, days: int = 14) -> DataFrame:
    """(dia, contas) for each of the next days: how many accounts fall due; days that a month lacks are dropped."""
    day = F.lit(today).cast("date")
    calendar = terms.sparkSession.range(1).select(F.explode(F.sequence(day, F.date_add(day, days - 1))).alias("dia"))
    due = terms.groupBy(F.col("dia").alias("d")).agg(F.count("*").alias("n"))  # 31 rows at most
    return calendar.join(F.broadcast(due), F.dayofmonth("dia") == F.col("d"), "left").select("dia", F.coalesce("n", F.lit(0)).cast("long").alias("contas"))


def bill_estimate(rows: DataFrame, key: str, bill: Column) -> DataFrame:
    """Latest bill where a key has at least two, else the mean of its rows."""
    latest = F.max_by("valor", F.when(bill, F.struct("data", "identificador")))
    cents = F.sum((F.col("valor") * 100).cast("bigint"))
    mean = F.floor((2 * cents + F.count("valor")) / (2 * F.count("valor"))) / 100  # halves go up, in whole cents
    out = rows.groupBy(key).agg(F.count_if(bill).alias("n"), latest.alias("_latest"), mean.alias("_mean"))
    return out.select(
        key, F.when(F.col("n") >= 2, F.col("_latest").cast("double")).otherwise(F.col("_mean")).alias("estimativa"),
        F.when(F.col("n") >= 2, "ultimo").otherwise("media").alias("origem"),
    )


def progressive(base: Column, brackets: list[tuple[float, float, float]]) -> Column:
    """max(0, base * rate - deduction) of the first (limit, rate, deduction) that holds the base; 0 beyond the last."""
    return first_match([(base <= limit, F.greatest(F.lit(0.0), base * rate - deduction)) for limit, rate, deduction in brackets], 0.0)


def regimes(rows: DataFrame, brackets, inss_cap: float, dependant: float, simple_rate: float, simple_cap: float) -> DataFrame:
    """Tax by the full and the simplified regime and which is cheaper (the full one among equals).

    rows: (rendimentos, inss, medicas, dependentes, ...) as doubles.
    """
    full = F.greatest(F.lit(0.0), F.col("rendimentos") - F.least(F.col("inss"), F.lit(inss_cap)) - F.col("medicas") - F.col("dependentes") * dependant)
    simple = F.greatest(F.lit(0.0), F.col("rendimentos") - F.least(F.col("rendimentos") * simple_rate, F.lit(simple_cap)))
    out = rows.withColumns({"imposto_completo": F.round(progressive(full, brackets), 2), "imposto_simplificado": F.round(progressive(simple, brackets), 2)})
    return out.withColumn("regime", F.when(F.col("imposto_completo") <= F.col("imposto_simplificado"), "completo").otherwise("simplificado"))


def validations(rows: DataFrame) -> DataFrame:
    """(regra, ocorrencias) of the ledger's validator, each a single aggregate."""
    per_row = rows.agg(
        F.count_if(F.col("categoria").isNull() | (F.col("categoria") == "Outros")).alias("sem_categoria"),
        F.count_if(F.col("classificacao").isNotNull() & ~F.col("classificacao").isin(*CLASSES, "N/A")).alias("classificacao_invalida"),
    ).unpivot([], ["sem_categoria", "classificacao_invalida"], "regra", "ocorrencias")
    twice = rows.filter("identificador is not null").groupBy("identificador").agg((F.count("*") - 1).alias("n"))
    months = rows.groupBy("mes_ref").agg(total(F.col("tipo") == INCOME).alias("r"), total(F.col("tipo").isin(EXPENSE, TAX)).alias("d"))
    per_month = months.agg(
        F.count_if(F.col("r") == 0).alias("meses_sem_receita"), F.count_if((F.col("d") > F.col("r")) & (F.col("r") > 0)).alias("despesa_maior_receita")
    ).unpivot([], ["meses_sem_receita", "despesa_maior_receita"], "regra", "ocorrencias")
    duplicates = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("ocorrencias")).select(F.lit("duplicatas").alias("regra"), "ocorrencias")
    return per_row.unionByName(duplicates).unionByName(per_month)


def same_reality(rows: DataFrame, key: list[str], tolerance: float = 0.05) -> DataFrame:
    """(id, grupo): payslips of one key whose values differ by at most ``tolerance`` of the smaller, greedily by id.

    A row joins the first group whose founder (its least id) it is close to. Equal values of a key are one node; close ones
    lie in neighbouring buckets of their logarithms, so pairs are found by equi joins, and founders by rounds over
    all keys at once.
    """
    nodes = _stored(rows.filter("id is not null and valor is not null").groupBy(*key, "valor").agg(F.min("id").alias("node")), "payslips")
    scale = math.log1p(tolerance) + 1e-9
    place = F.struct(*key, F.signum("valor").alias("sign"))
    bucket = F.when(F.col("valor") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("valor")) / scale))
    placed = nodes.select(place.alias("place"), bucket.alias("bucket"), "valor", "node")
    others = placed.select("place", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"), F.col("valor").alias("w"), F.col("node").alias("b"))
    close = F.abs(F.col("valor") - F.col("w")) <= tolerance * F.least(F.abs("valor"), F.abs("w"))
    edges = _stored(placed.join(others, ["place", "bucket"]).filter((F.col("node") < F.col("b")) & close).select(F.col("node").alias("a"), "b"), "close")
    heads = greedy_heads(nodes, edges)
    joined = nearest_heads(edges.withColumn("score", F.lit(1.0)), heads).select("node", F.col("head").alias("grupo"))
    groups = nodes.join(joined, "node", "left").select(*(F.col(c).alias(f"_{c}") for c in (*key, "valor")), F.coalesce("grupo", "node").alias("grupo"))
    same = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in (*key, "valor")]
    return rows.join(groups, same, "left").select("id", F.coalesce("grupo", "id").alias("grupo"))
