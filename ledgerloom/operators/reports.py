"""Sheets, reports, filters and key figures over ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import fold, parse_br
from ledgerloom.schema import INCOME, TRANSFER

from .analytics import ratio, spent, total

MONEY = "decimal(28,2)"


def of_map(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """The value of a small map, else the default."""
    out = F.lit(default).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def person_id(name: Column, persons: dict[str, str]) -> Column:
    """The id of a legacy name; other names are ids already, in small letters."""
    return F.coalesce(of_map(name, persons), F.lower(name))


def of_person(rows: DataFrame, person: str | None, persons: dict[str, str]) -> DataFrame:
    """Rows of a person, by legacy name or id on either side; 'Todos' or nothing filters nothing."""
    if not person or person == "Todos":
        return rows
    return rows.filter(person_id(F.col("quem"), persons) == persons.get(person, person.lower()))


def of_method(rows: DataFrame, method: str, groups: dict[str, str]) -> DataFrame:
    """Rows whose payment method falls into the same group as ``method``; a method without a group is its own."""
    return rows.filter(F.coalesce(of_map(F.col("forma_pagamento"), groups), "forma_pagamento") == groups.get(method, method))


def drill_down(rows: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Equality filters by column; unknown columns and empty values are passed over."""
    for column, value in chosen.items():
        if column in rows.columns and value:
            rows = rows.filter(F.col(column) == value)
    return rows


def recent_expenses(rows: DataFrame, today: str, days: int) -> DataFrame:
    day = F.lit(today).cast("date")
    return rows.filter(spent() & F.col("data").between(F.date_sub(day, days), day))


def facets(rows: DataFrame, equal: dict[str, str | None], text: str, term: str | None) -> DataFrame:
    """Equality facets (None filters nothing) and a term that the text holds, whatever its case."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.filter(F.lower(text).contains(term.lower())) if term else rows


def diary(events: DataFrame, mode: str | None, days: int | None, person: str | None, today: str) -> DataFrame:
    if mode:
        events = events.filter(F.col("event_type") == mode)
    if days is not None:
        day = F.to_date("ts")
        events = events.filter(day.between(F.date_sub(F.lit(today).cast("date"), days), F.lit(today).cast("date")))
    return events.filter(F.col("autor") == person) if person else events


def suggestions(rows: DataFrame, least: float, categories: list[str], risks: list[str]) -> DataFrame:
    """By least confidence, categories (none: all) and accepted risk levels."""
    rows = rows.filter((F.col("confianca") >= least) & F.col("risco").isin(*risks))
    return rows.filter(F.col("categoria").isin(*categories)) if categories else rows


def resolve_person(cpf: Column, cnpj: Column, company: Column, alias: Column, cpfs: dict, cnpjs: dict, companies: dict, aliases: dict, fallback: str) -> Column:
    """By personal id, company id, part of a company name, alias, in this order, else the fallback."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    by_name = F.lit(None).cast("string")
    for part, person in companies.items():
        by_name = F.when(fold(F.upper(company)).contains(part), person).otherwise(by_name)
    return F.coalesce(of_map(digits(cpf), cpfs), of_map(digits(cnpj), cnpjs), by_name, of_map(F.lower(F.trim(alias)), aliases), F.lit(fallback))


def human_label(aliases: Column, transaction: Column, company: Column, name: Column, limit: int = 40) -> Column:
    """The first alias, else the transaction's label, else the company, else the name, cut."""
    return F.coalesce(F.get(aliases, F.lit(0)), transaction, company, F.substring(name, 1, limit))


def shown(value: Column, missing: str = "—") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def parse_br_or(text: Column, default: float) -> Column:
    return F.coalesce(parse_br(text), F.lit(default).cast("decimal(18,2)"))


def income_table(rows: DataFrame, salaries: DataFrame, real: Column) -> DataFrame:
    """Payslips (mes_ref, fonte, bruto), and income rows that ``real`` accepts for months without a payslip."""
    rest = rows.filter((F.col("tipo") == INCOME) & real).join(salaries.select("mes_ref").distinct(), "mes_ref", "left_anti")
    own = salaries.select("mes_ref", "fonte", "bruto", F.lit(None).cast("string").alias("banco"))
    return own.unionByName(rest.select("mes_ref", F.col("local").alias("fonte"), F.col("valor").alias("bruto"), F.col("banco_origem").alias("banco")))


def narrative(rows: DataFrame, month: str, before: list[str]) -> DataFrame:
    """A month's figures against the month before (10 %), the mean of the months before (15 %) and a quarter of surplus."""
    rows = rows.filter((F.col("tipo") != TRANSFER) & F.col("mes_ref").isin(month, *before))
    now = F.col("mes_ref") == month
    m = rows.agg(
        total((F.col("tipo") == INCOME) & now).alias("receita"), total(spent() & now).alias("despesa"), total(spent() & (F.col("mes_ref") == before[-1])).cast("double").alias("a"),
        (total(spent() & ~now).cast("double") / len(before)).alias("media"), total(spent() & now & (F.col("classificacao") == "Supérfluo")).cast("double").alias("s"))
    d = F.col("despesa").cast("double")
    return m.select(
        "receita", "despesa", (F.col("receita") - F.col("despesa")).cast(MONEY).alias("saldo"), F.round(ratio(F.col("receita") - F.col("despesa"), F.col("receita")) * 100, 2).alias("poupanca"),
        F.when(d > F.col("a") * 1.1, "subiu").when(d < F.col("a") * 0.9, "caiu").otherwise("estável").alias("contra_anterior"),
        F.when(d > F.col("media") * 1.15, "acima").when(d < F.col("media") * 0.85, "abaixo").otherwise("na média").alias("contra_media"), (F.col("s") / d > 0.25).alias("alerta_superfluo"))


def rises_and_falls(rows: DataFrame, month: str, before: str, n: int) -> DataFrame:
    """The n largest relative rises of categories (new ones first) and the n largest falls."""
    c = rows.filter(spent() & F.col("mes_ref").isin(month, before)).groupBy("categoria").agg(total(F.col("mes_ref") == month).alias("atual"), total(F.col("mes_ref") == before).alias("anterior"))
    change = F.when(F.col("anterior") > 0, F.round((F.col("atual") - F.col("anterior")).cast("double") / F.col("anterior").cast("double") * 100, 4))
    c = c.withColumn("variacao", change)
    up = c.filter("atual > anterior").orderBy(F.desc(F.coalesce("variacao", F.lit(1e18))), "categoria").limit(n).withColumn("lado", F.lit("alta"))
    down = c.filter("atual < anterior").orderBy("variacao", "categoria").limit(n).withColumn("lado", F.lit("queda"))
    return up.unionByName(down).select("lado", "categoria", "atual", "anterior", F.lit(True).alias("dita"), "variacao")


def averages(rows: DataFrame, n: int, ahead: tuple[int, ...]) -> DataFrame:
    """Mean income, expense and balance of the last n months with rows, and the balance over months ahead."""
    months = rows.filter(F.col("tipo") != TRANSFER).groupBy("mes_ref").agg(total(F.col("tipo") == INCOME).cast("double").alias("r"), total(spent()).cast("double").alias("d"))
    last = months.orderBy(F.desc("mes_ref")).limit(n)
    out = last.agg(F.round(F.avg("r"), 2).alias("receita"), F.round(F.avg("d"), 2).alias("despesa"), F.round(F.avg(F.col("r") - F.col("d")), 2).alias("saldo"))
    return out.select("*", *[F.round(F.col("saldo") * m, 2).alias(f"em_{m}") for m in ahead])


def top_series(rows: DataFrame, n: int) -> DataFrame:
    """(serie, chave, total): the n largest of income by place, expense by category and expense by place."""
    into = F.col("tipo") == INCOME
    said = F.explode(F.filter(F.array(
        F.when(into, F.struct(F.lit("receita_local").alias("serie"), F.col("local").alias("chave"))),
        F.when(spent(), F.struct(F.lit("despesa_categoria").alias("serie"), F.col("categoria").alias("chave"))),
        F.when(spent(), F.struct(F.lit("despesa_local").alias("serie"), F.col("local").alias("chave")))), lambda x: x.isNotNull()))
    sums = rows.select(said.alias("s"), "valor").groupBy("s.serie", "s.chave").agg(F.sum("valor").cast(MONEY).alias("total"))
    rn = F.row_number().over(Window.partitionBy("serie").orderBy(F.desc("total"), "chave"))
    return sums.withColumn("rn", rn).filter(F.col("rn") <= n).select("serie", "chave", "total")


def available(rows: DataFrame, month: str) -> DataFrame:
    """(tipo, valor): weeks and days of a month and all years that have rows."""
    of = rows.filter(F.col("mes_ref") == month)
    kind = lambda df, n, c: df.select(F.lit(n).alias("tipo"), c.alias("valor")).distinct()
    weeks = kind(of, "semana", F.date_format(F.date_trunc("week", "data"), "yyyy-MM-dd"))
    return weeks.unionByName(kind(of, "dia", F.date_format("data", "yyyy-MM-dd"))).unionByName(kind(rows, "ano", F.substring("mes_ref", 1, 4)))


def completeness_kpis(cells: DataFrame, critical: float = 50, middling: float = 80) -> DataFrame:
    """Global coverage of (mes_ref, categoria, total, com_doc) cells, and how many categories are critical or middling."""
    by = cells.groupBy("categoria").agg(F.sum("total").alias("t"), F.sum("com_doc").alias("c")).withColumn("p", F.col("c") * 100.0 / F.col("t"))
    return by.agg(
        F.round(F.sum("c") * 100.0 / F.sum("t"), 4).alias("cobertura"), F.sum("t").alias("transacoes"), F.sum("c").alias("com_doc"),
        F.count_if(F.col("p") < critical).alias("criticas"), F.count_if((F.col("p") >= critical) & (F.col("p") < middling)).alias("medias"))


def alerts(rows: DataFrame, cells: DataFrame, months: int, least: float, high: float) -> DataFrame:
    """(chave, alerta), each once: recurring places, high values, and cells of two rows or more without a document."""
    s = rows.filter(spent())
    steady = s.groupBy("local").agg(F.countDistinct("mes_ref").alias("m"), F.sum("valor").alias("v")).filter((F.col("m") >= months) & (F.col("v") >= least))
    parts = (
        steady.select(F.col("local").alias("chave"), F.lit("recorrente").alias("alerta")), s.filter(F.col("valor") >= high).select(F.col("local").alias("chave"), F.lit("valor_alto").alias("alerta")),
        cells.filter("total >= 2 and com_doc = 0").select(F.concat_ws(" ", "mes_ref", "categoria").alias("chave"), F.lit("sem_cobertura").alias("alerta")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def family_grid(rows: DataFrame, families: dict[str, str], all_: list[str]) -> DataFrame:
    """(mes_ref, familia, n) for every month with rows and every family."""
    n = rows.withColumn("familia", of_map(F.col("categoria"), families)).groupBy("mes_ref").agg(*[F.count_if(F.col("familia") == f).alias(f) for f in all_])
    return n.unpivot("mes_ref", all_, "familia", "n")


def period_delta(rows: DataFrame, month: str, before: str) -> DataFrame:
    part = lambda c, m: total(c & (F.col("mes_ref") == m))
    into = F.col("tipo") == INCOME
    p = rows.filter(F.col("mes_ref").isin(month, before)).agg(part(into, month).alias("r1"), part(into, before).alias("r0"), part(spent(), month).alias("d1"), part(spent(), before).alias("d0"))
    pct = lambda a, b: F.round(ratio(F.col(a) - F.col(b), F.col(b)) * 100, 4)
    return p.select(F.col("r1").alias("receita"), F.col("d1").alias("despesa"), pct("r1", "r0").alias("delta_receita"), pct("d1", "d0").alias("delta_despesa"))


def insights(rows: DataFrame, least: int) -> DataFrame:
    """(insight, valor): largest category, most frequent place, most expensive weekday (Monday is 0); none of few rows."""
    first = lambda df, key, by: df.orderBy(F.desc(by), key).limit(1).select(F.col(key).cast("string").alias("valor"))
    parts = {
        "maior_categoria": first(rows.groupBy("categoria").agg(F.sum("valor").alias("v")), "categoria", "v"), "local_frequente": first(rows.groupBy("local").agg(F.count("*").alias("v")), "local", "v"),
        "dia_caro": first(rows.groupBy(F.weekday("data").alias("dia")).agg(F.sum("valor").alias("v")), "dia", "v")}
    enough = rows.agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("insight"), "valor")
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(enough), F.lit(True), "left_semi")  # one row


def payment_kpis(rows: DataFrame, today: str, reach: int, soon: int) -> DataFrame:
    """Rows with ``pago`` around today: what is open, how many are late, due soon and paid."""
    day = F.lit(today).cast("date")
    rows = rows.filter(F.col("data").between(F.date_sub(day, reach), F.date_add(day, reach)))
    open_ = ~F.col("pago")
    return rows.agg(
        total(open_).alias("a_pagar"), F.count_if(open_ & (F.col("data") < day)).alias("atrasados"),
        F.count_if(open_ & F.col("data").between(day, F.date_add(day, soon))).alias("em_7_dias"), F.count_if(F.col("pago")).alias("pagos"))


def week_delta(rows: DataFrame, monday: str, weeks: int) -> DataFrame:
    """A week's expense against the mean of the weeks before that have rows: above, below or within 15 %."""
    start = F.lit(monday).cast("date")
    week = F.date_trunc("week", "data").cast("date")
    of = rows.filter(spent() & week.between(F.date_sub(start, 7 * weeks), start)).groupBy(week.alias("w")).agg(F.sum("valor").alias("v"))
    out = of.agg(F.sum(F.when(F.col("w") == start, F.col("v"))).cast(MONEY).alias("agora"), F.avg(F.when(F.col("w") < start, F.col("v").cast("double"))).alias("m"))
    now = F.col("agora").cast("double")
    return out.select("agora", F.round("m", 2).alias("media"), F.when(now > F.col("m") * 1.15, "acima").when(now < F.col("m") * 0.85, "abaixo").otherwise("dentro").alias("delta"))


def analysis_sheet(rows: DataFrame, months: int, health: list[str]) -> DataFrame:
    """(parte, chave, total): expense by category, class, last months and the health group, balance by person."""
    s = rows.filter(spent())
    sums = lambda df, part, key: df.groupBy(key.alias("chave")).agg(F.sum("valor").cast(MONEY).alias("total")).select(F.lit(part).alias("parte"), "chave", "total")
    last = rows.select("mes_ref").distinct().orderBy(F.desc("mes_ref")).limit(months)
    person = rows.filter(F.col("tipo") != TRANSFER).groupBy(F.col("quem").alias("chave")).agg((total(F.col("tipo") == INCOME) - total(spent())).cast(MONEY).alias("total"))
    out = sums(s, "categoria", F.col("categoria")).unionByName(sums(s, "classe", F.col("classificacao"))).unionByName(person.select(F.lit("pessoa").alias("parte"), "chave", "total"))
    out = out.unionByName(sums(s.join(F.broadcast(last), "mes_ref", "left_semi"), "mes", F.col("mes_ref")))  # ``months`` rows
    return out.unionByName(sums(s.filter(F.col("categoria").isin(*health)), "saude", F.lit("grupo")))


def income_over_salary(rows: DataFrame, salaries: DataFrame, no_income: Column, limit: float, december: float) -> DataFrame:
    """Months of both sides whose income exceeds the salary by more than a factor."""
    r = rows.filter((F.col("tipo") == INCOME) & ~no_income).groupBy("mes_ref").agg(F.sum("valor").cast(MONEY).alias("receita"))
    s = salaries.groupBy("mes_ref").agg(F.sum("bruto").cast(MONEY).alias("salario")).filter("salario > 0")
    bar = F.when(F.col("mes_ref").endswith("-12"), december).otherwise(limit)
    return r.join(s, "mes_ref").filter(F.col("receita").cast("double") > F.col("salario").cast("double") * bar)


def summary_differences(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Months of both sides where income or expense of the summary is not that of the ledger."""
    own = rows.filter(F.col("tipo") != TRANSFER).groupBy("mes_ref").agg(total(F.col("tipo") == INCOME).alias("r"), total(spent()).alias("d"))
    j = own.join(summary.select("mes_ref", "receita", "despesa"), "mes_ref")
    out = j.select("mes_ref", (F.abs(F.col("r") - F.col("receita")) > 0.01).alias("receita_difere"), (F.abs(F.col("d") - F.col("despesa")) > 0.01).alias("despesa_difere"))
    return out.filter("receita_difere or despesa_difere")


def fidelity(raw: DataFrame, book: DataFrame, tolerance: float) -> DataFrame:
    """Sums of absolute statement values against the ledger by bank; banks of both sides."""
    sums = lambda df, n: df.groupBy("banco_origem").agg(F.sum(F.abs("valor")).cast(MONEY).alias(n))
    return sums(raw, "bruto").join(sums(book, "livro"), "banco_origem").withColumn("fiel", F.abs(F.col("bruto") - F.col("livro")) <= tolerance)


def lone_transfers(rows: DataFrame, limit: float) -> DataFrame:
    """Transfers alone in their date and value, their share, and whether it exceeds the limit."""
    g = rows.filter(F.col("tipo") == TRANSFER).groupBy("data", "valor").agg(F.count("*").alias("n"))
    out = g.agg(F.sum(F.when(F.col("n") < 2, F.col("n"))).alias("orfas"), F.sum("n").alias("total"))
    return out.select("orfas", "total", F.round(ratio(F.col("orfas"), F.col("total")), 6).alias("share"), (F.col("orfas") > F.col("total") * F.lit(limit)).alias("violado"))


def coverage_check(rows: DataFrame, least: float) -> DataFrame:
    c = F.when(F.col("potencial") > 0, F.col("extraidas").cast("double") / F.col("potencial")).otherwise(1.0)
    return rows.select("tipo", "potencial", "extraidas", F.round(c, 6).alias("cobertura"), (c >= least).alias("ok"))


def count_cases(rows: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """(categoria, n): rows for which each condition holds, in one pass."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in cases.items()]).unpivot([], list(cases), "categoria", "n")
