"""Accounts and bills against the ledger, calendars, sorting, searches, routing and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import spent


def account_matches(rows: DataFrame, accounts: list[tuple[str, bool]]) -> DataFrame:
    """(conta, identificador, como): rows of each account, by equal category, else by the account's text in the place.

    An account with rows of its category takes no others; a card's rows must say 'fatura'. The accounts are a
    maintained list, which becomes one expression.
    """
    hits = []
    for name, card in accounts:
        bill = F.lower("local").contains("fatura") if card else F.lit(True)
        same, part = F.col("categoria") == name, F.lower("local").contains(name.lower())
        hits.append(F.when((same | part) & bill, F.struct(F.lit(name).alias("conta"), F.when(same, "categoria").otherwise("texto").alias("como"))))
    found = rows.select("identificador", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.conta", "identificador", "h.como")
    exact = found.groupBy("conta").agg(F.bool_or(F.col("como") == "categoria").alias("_x"))  # one row an account
    return found.join(F.broadcast(exact), "conta").filter(~F.col("_x") | (F.col("como") == "categoria")).select("conta", "identificador", "como")


def paid_in_month(accounts: DataFrame, rows: DataFrame, month: str, length: int = 10) -> DataFrame:
    """(conta, paga): does an expense of the month name the account's first signs?

    All runs of that many signs of the month's places are the join key, so accounts meet rows by equality.
    """
    key = F.lower(F.substring("conta", 1, length))
    of = rows.filter(spent() & (F.col("mes_ref") == month)).select(F.lower("local").alias("l")).distinct()
    n = accounts.select("conta", key.alias("k")).distinct()
    sizes = [r["n"] for r in n.select(F.length("k").alias("n")).distinct().collect()]  # at most ``length`` numbers
    starts = lambda s: F.sequence(F.lit(1), F.greatest(F.length("l") - (s - 1), F.lit(1)))
    grams = F.flatten(F.array(*[F.transform(starts(s), _cut(s)) for s in sizes])) if sizes else F.array().cast("array<string>")
    seen = of.select(F.explode(F.array_distinct(grams)).alias("k")).distinct().withColumn("_p", F.lit(True))
    return n.join(seen, "k", "left").select("conta", F.coalesce("_p", F.lit(False)).alias("paga"))


def _cut(size: int):
    return lambda i: F.substring(F.col("l"), i, F.lit(size))


def previous_months(month: Column, n: int) -> Column:
    """array<string>: the n months before a 'yyyy-MM', the nearest first."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_format(F.add_months(first, -i), "yyyy-MM"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``posicao``, their place by date (then ``ordem``), and an identifier where there is none.

    Places are counted within a day and shifted by the days before, so no task sorts the whole ledger.
    """
    own = F.row_number().over(Window.partitionBy("data").orderBy("ordem"))
    days = rows.groupBy("data").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("data")).rowsBetween(Window.unboundedPreceding, -1))  # one row a day
    days = days.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    out = rows.withColumn("_own", own).join(days, rows["data"].eqNullSafe(days["data"])).drop(days["data"])
    made = F.concat(F.lit("SEM-"), F.col("ordem").cast("string"))
    return out.withColumns({"posicao": (F.col("_own") + F.col("_before")).cast("long"), "identificador": F.coalesce(F.col("identificador").cast("string"), made)}).drop("_own", "_before")


def merged_results(parts: list[DataFrame]) -> DataFrame:
    """Search results (id, texto) of several sources, each id once, from the first source that has it."""
    out = None
    for i, p in enumerate(parts):
        q = p.select("id", "texto", F.lit(i).alias("fonte"))
        out = q if out is None else out.unionByName(q)
    return out.groupBy("id").agg(F.min_by("texto", F.struct("fonte", "texto")).alias("texto"), F.min("fonte").alias("fonte"))


def graph_first(bills: DataFrame, edges: DataFrame, text: Column, today: str, least: float) -> DataFrame:
    """(conta, vencimento, estado): bills by their edge or their due date, else by their text.

    Where at least ``least`` of an account's bills are in the graph, those with an edge are paid and others late or pending
    by their date; other accounts go by ``text``.
    """
    day = F.lit(today).cast("date")
    j = bills.join(edges.select("bill").distinct().withColumn("_e", F.lit(True)), "bill", "left")
    share = j.groupBy("conta").agg((F.count("_e") / F.count("*")).alias("_s"))
    by_date = F.when(F.col("vencimento") < day, "atrasado").otherwise("pendente")
    state = F.when(F.col("_s") >= least, F.when(F.col("_e"), "pago").otherwise(by_date)).otherwise(F.when(text, "pago").otherwise(by_date))
    return j.join(share, "conta").select("bill", "conta", state.alias("estado"), F.when(F.col("_s") >= least, "grafo").otherwise("texto").alias("fonte"))


def month_calendar(rows: DataFrame, month: str, today: str, kinds: dict[str, str]) -> DataFrame:
    """(dia, classe, atrasado, n, total) of a month's payments, the class by the first keyword that the text holds."""
    kind = F.lit("outros")
    for word, name in reversed(kinds.items()):
        kind = F.when(F.lower("local").contains(word), name).otherwise(kind)
    of = rows.filter(F.col("mes_ref") == month)
    return of.groupBy(F.dayofmonth("data").alias("dia"), kind.alias("classe"), ((F.col("data") < F.lit(today).cast("date")) & ~F.col("pago")).alias("atrasado")).agg(F.count("*").alias("n"), F.sum("valor").cast("decimal(28,2)").alias("total"))


def routing_plan(files: DataFrame, folders: dict[str, str]) -> DataFrame:
    """(path, destino, acao): where files (path, tipo, pessoa, data) would go; a dry run moves nothing."""
    folder = F.lit(None).cast("string")
    for kind, name in folders.items():
        folder = F.when(F.col("tipo") == kind, name).otherwise(folder)
    to = F.concat_ws("/", F.lit("arquivo"), F.col("pessoa"), folder, F.date_format("data", "yyyy"), F.element_at(F.split("path", "/"), -1))
    target = F.when(folder.isNotNull(), to)
    return files.select("path", target.alias("destino"), F.when(target.isNull(), "conferir").when(target == F.col("path"), "nada").otherwise("mover").alias("acao"))


def page_diagnosis(files: DataFrame, least: int = 50) -> DataFrame:
    """(path, pagina, tipo, chars): pages of a text layer (divided by form feeds), native or scan by their signs.

    A file without a text layer gives one row, an error.
    """
    pages = F.when(F.col("content").isNotNull(), F.split("content", "\f"))
    rows = files.select("path", F.posexplode_outer(pages).alias("n", "t"))
    chars = F.length(F.regexp_replace("t", r"\s", ""))
    return rows.select("path", (F.coalesce("n", F.lit(0)) + 1).alias("pagina"), F.when(F.col("t").isNull(), "erro").when(chars >= least, "nativa").otherwise("scan").alias("tipo"), F.coalesce(chars, F.lit(0)).alias("chars"))


def attachments(mails: DataFrame, depth: int = 2) -> DataFrame:
    """(path, nome): names of a mail's attachments; mails nested deeper than ``depth`` are not opened."""
    nested = F.size(F.regexp_extract_all("content", F.lit(r"(?i)(Content-Type:\s*message/rfc822)"), F.lit(1)))
    names = F.regexp_extract_all("content", F.lit(r'(?i)Content-Disposition:\s*attachment;\s*filename="([^"]+)"'), F.lit(1))
    return mails.filter(nested <= depth).select("path", F.explode(names).alias("nome"))


def domain_risk(rows: DataFrame, forbidden: list[str], longest: int, value: tuple[float, float], categories: list[str]) -> Column:
    """Risk of a suggestion: ALTO with a forbidden token, else by how many of three bounds fail; DESCONHECIDO without an entry."""
    words = F.split(F.lower("local"), r"[^a-zà-ÿ0-9#]+")
    bad = F.arrays_overlap(words, F.array(*[F.lit(w) for w in forbidden]))
    fails = (F.length("local") > longest).cast("int") + (~F.col("valor").between(*value)).cast("int") + (~F.col("quem").isin(*categories)).cast("int")
    return F.when(F.col("categoria").isNull(), "DESCONHECIDO").when(bad, "ALTO").when(fails == 0, "BAIXO").when(fails == 1, "MEDIO").otherwise("ALTO")
