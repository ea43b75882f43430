"""Filters, dedup and pairing over ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import dedup_text
from ledgerloom.schema import EXPENSE, INCOME, TAX, TRANSFER

#: The bank name of rows that come from old records.
HISTORY = "Histórico"


def of_month(rows: DataFrame, month: str) -> DataFrame:
    return rows.filter(F.col("mes_ref") == month)


def of_month_if_there(rows: DataFrame, month: str, column: str = "mes_ref") -> DataFrame:
    """Rows of a month; a table without the column passes through."""
    return rows.filter(F.col(column) == month) if column in rows.columns else rows


def of_period(rows: DataFrame, granularity: str, period) -> DataFrame:
    """year 'yyyy', day 'yyyy-MM-dd', ISO week number (of any year) or month."""
    if granularity == "ano":
        return rows.filter(F.col("mes_ref").startswith(str(period)))
    if granularity == "dia":
        return rows.filter(F.col("data") == F.lit(period).cast("date"))
    if granularity == "semana":
        return rows.filter(F.weekofyear("data") == int(period))
    return of_month(rows, period)


def statement_bar(rows: DataFrame, bank=None, category=None, text=None, expenses_only=False, documented: DataFrame | None = None, uncategorized_only=False) -> DataFrame:
    """Statement filters; what is not given does not filter; the text is literal and case does not matter."""
    if bank:
        rows = rows.filter(F.col("banco_origem") == bank)
    if category:
        rows = rows.filter(F.col("categoria") == category)
    if text:
        rows = rows.filter(F.upper("local").contains(text.upper()))
    if documented is not None:
        rows = rows.join(documented, "identificador", "left_semi")
    if uncategorized_only:
        rows = rows.filter(F.col("categoria").isNull() | (F.col("categoria") == "Outros"))
    return rows.filter(F.col("tipo").isin(EXPENSE, TAX)) if expenses_only else rows


def last_months(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the last n months that have rows."""
    months = rows.select("mes_ref").distinct().orderBy(F.desc("mes_ref")).limit(n)
    return rows.join(F.broadcast(months), "mes_ref", "left_semi")  # n rows


def loud_categories(rows: DataFrame, least: int) -> DataFrame:
    """Rows of categories with at least ``least`` rows."""
    keep = rows.groupBy("categoria").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return rows.join(keep.select("categoria"), "categoria", "left_semi")


def dedup_identifier(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each identifier; rows without one all stay."""
    keyed = rows.filter(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.unionByName(rows.filter(F.col(key).isNull()))


def dedup_key(value: str = "valor") -> list[Column]:
    """Date, absolute value, key text and bank of a row; history rows and rows without a bank share one."""
    bank = F.coalesce(F.nullif("banco_origem", F.lit("")), F.lit(HISTORY))
    return [F.col("data").alias("_d"), F.abs(value).alias("_v"), dedup_text(F.col("local")).alias("_t"), F.when(bank == HISTORY, "_sem_banco").otherwise(bank).alias("_b")]


def dedup_fuzzy(rows: DataFrame) -> DataFrame:
    """Best row of each group of equal keys; groups with a virtual row stay untouched.

    Rows of a known bank go before history rows, then longer texts, then the first by ``ordem``. Groups are reduced to
    their number, their virtual rows and their best row before anything is joined, so a frequent key is no hot task.
    """
    key = ["_d", "_v", "_t", "_b"]
    rich = F.length(F.coalesce(F.nullif("descricao", F.lit("")), F.col("local"), F.lit("")))
    rank = F.struct((F.coalesce("banco_origem", F.lit("")) == HISTORY).alias("h"), (-rich).alias("r"), "ordem")
    keyed = rows.select("*", *dedup_key())
    groups = keyed.groupBy(*key).agg(F.count("*").alias("_n"), F.max(F.col("virtual").cast("int")).alias("_virtual"), F.min_by("ordem", rank).alias("_best")).filter("_n > 1 and _virtual = 0")
    same = [keyed[k].eqNullSafe(groups[k]) for k in key]
    marked = keyed.join(groups, same, "left").select(*[keyed[c] for c in rows.columns], groups["_best"])
    return marked.filter(F.col("_best").isNull() | (F.col("_best") == F.col("ordem"))).drop("_best")


def without_history(rows: DataFrame) -> DataFrame:
    """History rows and rows without a bank go where a real bank has the same date, value and key text; virtual rows count on neither side."""
    real = F.coalesce("banco_origem", F.lit("")).isin("", HISTORY) == F.lit(False)
    keyed = rows.select("*", *dedup_key(), real.alias("_real"))
    seen = keyed.filter("_real and not virtual").select("_d", "_v", "_t").distinct().withColumn("_seen", F.lit(True))
    out = keyed.join(seen, ["_d", "_v", "_t"], "left").filter("_seen is null or _real or virtual")
    return out.select(rows.columns)


def without_sheet_twins(rows: DataFrame) -> DataFrame:
    """Where date, value, bank and person have rows of an OFX file and of a sheet, the sheet's rows go."""
    file = F.lower(F.coalesce("arquivo", F.lit("")))
    ofx, sheet = file.endswith(".ofx"), file.rlike(r"\.(xlsx|xls|csv)$")
    known = ~F.coalesce("banco_origem", F.lit("")).isin("", HISTORY) & ~F.col("virtual")
    keyed = rows.select("*", F.col("data").alias("_d"), F.abs("valor").alias("_v"), F.col("banco_origem").alias("_b"), F.coalesce("quem", F.lit("")).alias("_q"), (sheet & known).alias("_sheet"), (ofx & known).alias("_ofx"))
    key = ["_d", "_v", "_b", "_q"]
    both = keyed.filter("_sheet or _ofx").groupBy(*key).agg(F.bool_or("_ofx").alias("_a"), F.bool_or("_sheet").alias("_c")).filter("_a and _c").select(*key, F.lit(True).alias("_both"))
    return keyed.join(both, key, "left").filter("_both is null or not _sheet").select(rows.columns)


def mark_transfers(rows: DataFrame, own) -> DataFrame:
    """Rows with ``par``: the incoming row an expense pairs with; both become transfers.

    An expense pairs with the first incoming row (income, or a transfer) of equal date and value and another person,
    if ``own`` (a condition on a row's text) holds on at least one of the two. Incoming rows are reduced to the first
    of each person, with and without ``own``, before the join.
    """
    text = rows.withColumn("_own", F.coalesce(own, F.lit(False))).withColumn("_v", F.abs("valor"))
    into = text.filter(F.col("tipo").isin(INCOME, TRANSFER)).groupBy("data", "_v", F.coalesce("quem", F.lit("")).alias("_para")).agg(
        F.min("ordem").alias("_first"), F.min(F.when(F.col("_own"), F.col("ordem"))).alias("_first_own"))
    out = text.filter(F.coalesce(F.col("tipo") == EXPENSE, F.lit(True))).select("data", "_v", F.coalesce("quem", F.lit("")).alias("_de"), "_own", F.col("ordem").alias("saida"))
    pairs = out.join(into, ["data", "_v"]).filter("_de <> _para").withColumn("entrada", F.when(F.col("_own"), F.col("_first")).otherwise(F.col("_first_own")))
    pairs = pairs.filter("entrada is not null").groupBy("saida").agg(F.min("entrada").alias("entrada"))
    marked = pairs.select(F.col("saida").alias("ordem"), F.col("entrada").alias("par")).unionByName(pairs.select(F.col("entrada").alias("ordem"), F.lit(None).cast("long").alias("par")).distinct())
    marked = marked.groupBy("ordem").agg(F.max("par").alias("par"), F.lit(True).alias("_ti"))
    return rows.join(marked, "ordem", "left").withColumn("tipo", F.when(F.col("_ti"), TRANSFER).otherwise(F.col("tipo"))).select(*rows.columns, "par")


def deduplicate(rows: DataFrame, own) -> DataFrame:
    """All levels in order: one row an identifier, transfers marked, history and equal keys and sheet twins dropped."""
    once = dedup_identifier(rows, "identificador", ["ordem"])
    marked = mark_transfers(once, own).drop("par")
    return without_sheet_twins(dedup_fuzzy(without_history(marked)))


def residual_duplicates(rows: DataFrame, key: list) -> DataFrame:
    """Rows beyond the first of each key, in all."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("groups"))


def mirror_pairs(rows: DataFrame, key: list, virtual) -> DataFrame:
    """How many virtual and real rows of a key pair off."""
    n = rows.groupBy(*key).agg(F.count_if(virtual).alias("virtual"), F.count_if(~virtual).alias("real"))
    return n.select(*key, F.least("virtual", "real").alias("pairs")).filter("pairs > 0")


def signed(rows: DataFrame) -> DataFrame:
    """Adds valor_assinado: income positive, all else negative."""
    return rows.withColumn("valor_assinado", F.when(F.col("tipo") == INCOME, F.col("valor")).otherwise(-F.col("valor")))
