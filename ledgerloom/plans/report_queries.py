"""Reports, sheets, filters and key figures over the ledger view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import analytics as A
from ledgerloom.operators import ledger_ops as L
from ledgerloom.operators import reports as P
from ledgerloom.schema import EXPENSE, INCOME, TAX, TRANSFER

from .catalogue import query
from .ledger import ledger, table
from .ledger_queries import D, SPENT, W, dsum

MONTH, BEFORE = "1997-06", ["1997-03", "1997-04", "1997-05"]
TODAY = "1997-06-15"
#: Legacy names of persons and their ids.
PERSONS = {"AFRICA": "pessoa_a", "ASIA": "pessoa_b", "EUROPE": "pessoa_b", "Casal": "casal"}
CASE_PERSON = "CASE quem WHEN 'AFRICA' THEN 'pessoa_a' WHEN 'ASIA' THEN 'pessoa_b' WHEN 'EUROPE' THEN 'pessoa_b' ELSE lower(quem) END"


# ---- filters


@query(f"{W} SELECT identificador, {CASE_PERSON} AS pessoa FROM ledger WHERE {CASE_PERSON} = 'pessoa_b'")
def filter_person(spark, d):
    """Both sides are normalized; 'Todos' filters nothing."""
    rows = P.of_person(ledger(spark, d), "ASIA", PERSONS)
    assert P.of_person(rows, "Todos", PERSONS) is rows
    return rows.select("identificador", P.person_id(F.col("quem"), PERSONS).alias("pessoa"))


METHODS = {"TED": "Transferência", "DOC": "Transferência", "Transf": "Transferência", "PIX": "Pix"}
FORM = "CASE identificador % 5 WHEN 0 THEN 'TED' WHEN 1 THEN 'DOC' WHEN 2 THEN 'PIX' WHEN 3 THEN 'Transferência' ELSE 'Boleto' END"


@query(f"{W} SELECT identificador FROM ledger WHERE {FORM} IN ('TED', 'DOC', 'Transf', 'Transferência')")
def filter_method(spark, d):
    """methods in canonical groups."""
    return P.of_method(ledger(spark, d).withColumn("forma_pagamento", F.expr(FORM)), "TED", METHODS).select("identificador")


@query(f"{W} SELECT identificador FROM ledger WHERE mes_ref = '{MONTH}'")
def filter_month_if_there(spark, d):
    """a table without the column passes through."""
    rows = ledger(spark, d)
    assert L.of_month_if_there(rows.drop("mes_ref"), MONTH).columns == rows.drop("mes_ref").columns
    return L.of_month_if_there(rows, MONTH).select("identificador")


@query(f"""{W} SELECT identificador, "local" FROM ledger WHERE banco_origem = 'NATION_7' AND categoria = 'BUILDING' AND contains(upper("local"), '#0') AND {SPENT} AND identificador IN (SELECT l_orderkey FROM lineitem) AND classificacao = 'Obrigatório'""")
def filter_statement_all(spark, d):
    """all facets of the statement bar, and those of a drill-down."""
    docs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("identificador"))
    rows = L.statement_bar(ledger(spark, d), bank="NATION_7", category="BUILDING", text="#0", expenses_only=True, documented=docs)
    return P.drill_down(rows, {"classificacao": "Obrigatório", "desconhecida": "x", "mes_ref": ""}).select("identificador", "local")


@query(f"{W} SELECT identificador, data FROM ledger WHERE {SPENT} AND data >= DATE '{TODAY}' - 365 AND data <= DATE '{TODAY}'")
def filter_recent_expenses(spark, d):
    """Expenses with a date in the last 365 days."""
    return P.recent_expenses(ledger(spark, d), TODAY, 365).select("identificador", "data")


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND source IN (SELECT min(source) FROM documents) AND contains(lower(text), 'the') AND n_chars BETWEEN 200 AND 5000""")
def filter_grid(spark, d):
    """type, size, source and term of a document grid."""
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("source").alias("s")).first()["s"]
    return P.facets(docs, {"lang": "en", "source": first}, "text", "THE").filter(F.col("n_chars").between(200, 5000)).select("doc_id")


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-28 00:00:00' AND user_id % 2 = 1""")
def filter_diary(spark, d):
    """mode, period and person of diary entries."""
    e = table(spark, d, "events").withColumn("autor", F.when(F.col("user_id") % 2 == 1, "a").otherwise("b"))
    return P.diary(e, "click", 7, "a", "2024-01-27").select("event_id")


@query(f"""{W}, s AS (SELECT identificador, round(CAST(identificador % 97 AS DOUBLE) / 97, 3) AS confianca, categoria, CASE identificador % 3 WHEN 0 THEN 'BAIXO' WHEN 1 THEN 'MEDIO' ELSE 'ALTO' END AS risco FROM ledger)
 SELECT identificador, confianca FROM s WHERE confianca >= 0.8 AND categoria IN ('BUILDING', 'MACHINERY') AND risco IN ('BAIXO', 'MEDIO')""")
def filter_suggestions(spark, d):
    """least confidence, categories and risk levels."""
    k = F.col("identificador")
    s = ledger(spark, d).select("identificador", F.round((k % 97).cast("double") / 97, 3).alias("confianca"), "categoria", F.when(k % 3 == 0, "BAIXO").when(k % 3 == 1, "MEDIO").otherwise("ALTO").alias("risco"))
    return P.suggestions(s, 0.8, ["BUILDING", "MACHINERY"], ["BAIXO", "MEDIO"]).select("identificador", "confianca")


# ---- persons, labels, maps

COMPANY = "CASE WHEN identificador % 4 = 1 THEN '11.222.333/0001-44' END"


@query(f"""{W} SELECT identificador, CASE WHEN identificador % 3 = 0 THEN 'pessoa_a' WHEN identificador % 4 = 1 THEN 'pessoa_b' WHEN contains(upper("local"), '9') THEN 'pessoa_c' WHEN quem = 'ASIA' THEN 'pessoa_b' ELSE 'casal' END AS pessoa FROM ledger""")
def resolve_person(spark, d):
    """By personal id, company id, company name, alias, else the fallback."""
    k = F.col("identificador")
    rows = ledger(spark, d).withColumns({"cpf": F.when(k % 3 == 0, "111.222.333-44"), "cnpj": F.expr(COMPANY)})
    person = P.resolve_person(F.col("cpf"), F.col("cnpj"), F.col("local"), F.col("quem"), {"11122233344": "pessoa_a"}, {"11222333000144": "pessoa_b"}, {"9": "pessoa_c"}, {"asia": "pessoa_b"}, "casal")
    return rows.select("identificador", person.alias("pessoa"))


EDGE_KINDS = {"URGENT": "pago_com", "BUILDING": "confirma", "MACHINERY": "comprovante"}


@query(f"""{W} SELECT identificador, CASE categoria WHEN 'BUILDING' THEN 'confirma' WHEN 'MACHINERY' THEN 'comprovante' ELSE 'pago_com' END AS aresta, CASE categoria WHEN 'BUILDING' THEN 'fiscal' WHEN 'FURNITURE' THEN 'fiscal' WHEN 'MACHINERY' THEN 'pagamento' END AS familia,
 CASE WHEN identificador % 5 = 0 THEN quem WHEN identificador % 5 = 1 THEN 'T ' || "local" WHEN identificador % 5 = 2 THEN categoria ELSE substring("local" || ' ' || categoria || ' ' || banco_origem || ' ' || quem, 1, 40) END AS rotulo,
 coalesce(CASE WHEN identificador % 7 <> 0 THEN CAST(valor AS VARCHAR) END, '—') AS mostrado FROM ledger""")
def labels_and_kinds(spark, d):
    """Human label, edge kind, family and what stands for null."""
    k = F.col("identificador")
    rows = ledger(spark, d)
    label = P.human_label(F.when(k % 5 == 0, F.array("quem")), F.when(k % 5 == 1, F.concat(F.lit("T "), "local")), F.when(k % 5 == 2, F.col("categoria")), F.concat_ws(" ", "local", "categoria", "banco_origem", "quem"))
    return rows.select(
        "identificador", P.of_map(F.col("categoria"), EDGE_KINDS, "pago_com").alias("aresta"), P.of_map(F.col("categoria"), {"BUILDING": "fiscal", "FURNITURE": "fiscal", "MACHINERY": "pagamento"}).alias("familia"),
        label.alias("rotulo"), P.shown(F.when(k % 7 != 0, F.col("valor"))).alias("mostrado"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 1 THEN 0.00 ELSE CAST(1234.5 AS DECIMAL(18,2)) END AS numero,
 'R$ ' || translate(format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)), ',.', '.,') AS moeda FROM orders""")
def numbers_br(spark, d):
    """Numbers with a default, and money as text."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    text = F.when(k % 3 == 0, F.regexp_replace(X.currency_br(v), r"^R\$ ", "")).when(k % 3 == 1, "n/d").otherwise("1.234,50")
    return table(spark, d, "orders").select(k.alias("id"), P.parse_br_or(text, 0.0).alias("numero"), X.currency_br(v).alias("moeda"))


KEY = "lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"
BODY = f"('35' || '2401' || '12345678000190' || CASE WHEN o_orderkey % 2 = 0 THEN '55' ELSE '65' END || '001' || {KEY} || '1' || lpad(CAST(o_custkey AS VARCHAR), 8, '0'))"


@query(f"""WITH b AS (SELECT o_orderkey AS id, {BODY} AS body FROM orders), s AS (SELECT *, list_sum(list_transform(range(43), lambda i: CAST(substring(body, 43 - CAST(i AS INTEGER), 1) AS INTEGER) * (2 + i % 8))) % 11 AS r FROM b),
 k AS (SELECT id, body, body || CASE WHEN id % 4 = 0 THEN '5' WHEN r < 2 THEN '0' ELSE CAST(CAST(11 - r AS INTEGER) AS VARCHAR) END AS chave, CASE WHEN r < 2 THEN '0' ELSE CAST(CAST(11 - r AS INTEGER) AS VARCHAR) END AS digito FROM s)
 SELECT id, chave, substring(chave, 44, 1) = digito AS valida, substring(chave, 7, 14) AS cnpj, substring(chave, 21, 2) AS modelo, substring(chave, 1, 2) AS uf, substring(chave, 3, 4) AS aamm, substring(chave, 23, 3) AS serie, substring(chave, 26, 9) AS numero FROM k""")
def invoice_keys(spark, d):
    """A written key's digits, its check digit and its parts."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("35240112345678000190"), F.when(k % 2 == 0, "55").otherwise("65"), F.lit("001"), F.lpad(k.cast("string"), 9, "0"), F.lit("1"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    rows = table(spark, d, "orders").select(k.alias("id"), body.alias("body"))
    rows = rows.withColumn("full", F.concat("body", F.when(F.col("id") % 4 == 0, "5").otherwise(X.check_digit(F.col("body")))))
    written = F.concat_ws(" ", F.lit("NF-e"), F.substring("full", 1, 22), F.substring("full", 23, 22))
    key = rows.select("id", X.invoice_key(F.regexp_replace(written, "NF-e", "")).alias("chave"))
    return key.select("id", "chave", X.check_digit_ok(F.col("chave")).alias("valida"), *X.key_parts(F.col("chave")))


# ---- sheets and reports

SALARIES = f"""sal AS (SELECT mes_ref, 'folha ' || quem AS fonte, CAST(sum(valor) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS bruto FROM ledger WHERE tipo = '{INCOME}' AND month(data) % 2 = 0 GROUP BY 1, 2)"""


def salaries(spark, d):
    rows = ledger(spark, d).filter((F.col("tipo") == INCOME) & (F.month("data") % 2 == 0))
    return rows.groupBy("mes_ref", F.concat(F.lit("folha "), "quem").alias("fonte")).agg((F.sum("valor") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(18,2)").alias("bruto"))


@query(f"""{W}, {SALARIES} SELECT mes_ref, fonte, bruto, CAST(NULL AS VARCHAR) AS banco FROM sal UNION ALL
 SELECT mes_ref, "local", valor, banco_origem FROM ledger WHERE tipo = '{INCOME}' AND mes_ref NOT IN (SELECT mes_ref FROM sal) AND contains("local", '7')""")
def income_table(spark, d):
    """A2: payslips, and real income of months without one."""
    return P.income_table(ledger(spark, d), salaries(spark, d), F.col("local").contains("7"))


_M = f"""m AS (SELECT {dsum(f"tipo = '{INCOME}' AND mes_ref = '{MONTH}'")} AS receita, {dsum(f"{SPENT} AND mes_ref = '{MONTH}'")} AS despesa, {dsum(f"{SPENT} AND mes_ref = '{BEFORE[-1]}'")} AS anterior,
 {dsum(f"{SPENT} AND mes_ref IN ('{BEFORE[0]}', '{BEFORE[1]}', '{BEFORE[2]}')")} AS soma, {dsum(f"{SPENT} AND mes_ref = '{MONTH}' AND classificacao = 'Supérfluo'")} AS superfluo FROM ledger WHERE tipo <> '{TRANSFER}')"""


@query(f"""{W}, {_M}, x AS (SELECT *, CAST(despesa AS DOUBLE) AS d, CAST(anterior AS DOUBLE) AS a, CAST(soma AS DOUBLE) / 3 AS media FROM m)
 SELECT receita, despesa, CAST(receita - despesa AS {D}) AS saldo, round(CAST(receita - despesa AS DOUBLE) / CAST(receita AS DOUBLE) * 100, 2) AS poupanca,
 CASE WHEN d > a * 1.1 THEN 'subiu' WHEN d < a * 0.9 THEN 'caiu' ELSE 'estável' END AS contra_anterior, CASE WHEN d > media * 1.15 THEN 'acima' WHEN d < media * 0.85 THEN 'abaixo' ELSE 'na média' END AS contra_media,
 CAST(superfluo AS DOUBLE) / d > 0.25 AS alerta_superfluo FROM x""")
def month_narrative(spark, d):
    """A month's figures and what its narrative says of them."""
    return P.narrative(ledger(spark, d), MONTH, BEFORE)


@query(f"""{W}, v AS (SELECT categoria || ' ' || classificacao AS categoria, mes_ref, valor FROM ledger WHERE {SPENT} AND mes_ref IN ('{MONTH}', '{BEFORE[-1]}')), c AS (SELECT categoria, {dsum(f"mes_ref = '{MONTH}'")} AS atual, {dsum(f"mes_ref = '{BEFORE[-1]}'")} AS anterior FROM v GROUP BY 1),
 p AS (SELECT *, CASE WHEN anterior > 0 THEN round(CAST(atual - anterior AS DOUBLE) / CAST(anterior AS DOUBLE) * 100, 4) END AS variacao FROM c),
 u AS (SELECT *, row_number() OVER (ORDER BY coalesce(variacao, 1e18) DESC, categoria) AS rn FROM p WHERE atual > anterior), q AS (SELECT *, row_number() OVER (ORDER BY variacao, categoria) AS rn FROM p WHERE atual < anterior)
 SELECT 'alta' AS lado, categoria, atual, anterior, CASE WHEN variacao IS NULL THEN 'NOVA' ELSE CAST(variacao AS VARCHAR) END IS NOT NULL AS dita, variacao FROM u WHERE rn <= 5 UNION ALL SELECT 'queda', categoria, atual, anterior, TRUE, variacao FROM q WHERE rn <= 5""")
def rises_and_falls(spark, d):
    """The five largest rises, new ones first, and falls."""
    rows = ledger(spark, d).withColumn("categoria", F.concat_ws(" ", "categoria", "classificacao"))
    return P.rises_and_falls(rows, MONTH, BEFORE[-1], 5)


@query(f"""{W}, b AS (SELECT mes_ref, CAST({dsum(f"tipo = '{INCOME}'")} AS DOUBLE) AS r, CAST({dsum(SPENT)} AS DOUBLE) AS d, row_number() OVER (ORDER BY mes_ref DESC) AS rn FROM ledger WHERE tipo <> '{TRANSFER}' GROUP BY 1),
 a AS (SELECT round(avg(r), 2) AS receita, round(avg(d), 2) AS despesa, round(avg(r - d), 2) AS saldo FROM b WHERE rn <= 6)
 SELECT receita, despesa, saldo, round(saldo * 6, 2) AS em_6, round(saldo * 12, 2) AS em_12 FROM a""")
def averages_and_projection(spark, d):
    """Means of the last six months with rows, and what they come to in 6 and 12 months."""
    return P.averages(ledger(spark, d), 6, (6, 12))


@query(f"""{W} SELECT categoria AS tag, CAST(sum(valor) AS {D}) AS total, count(*) AS n FROM ledger WHERE tipo = '{TAX}' AND mes_ref BETWEEN '1997-01' AND '{MONTH}' GROUP BY 1""")
def tax_to_date(spark, d):
    """Taxes of the year up to the month."""
    rows = ledger(spark, d).filter((F.col("tipo") == TAX) & F.col("mes_ref").between(MONTH[:4] + "-01", MONTH))
    return rows.groupBy(F.col("categoria").alias("tag")).agg(F.sum("valor").cast("decimal(28,2)").alias("total"), F.count("*").alias("n"))


@query(f"""{W} SELECT CAST({dsum(f"tipo = '{INCOME}' AND mes_ref <= '{MONTH}'")} - {dsum(f"{SPENT} AND mes_ref <= '{MONTH}'")} AS {D}) AS saldo FROM ledger WHERE {CASE_PERSON} = 'pessoa_b'""")
def balance_to_month(spark, d):
    """All months up to this one, of a person."""
    until = F.col("mes_ref") <= MONTH
    return P.of_person(ledger(spark, d), "ASIA", PERSONS).agg((A.total((F.col("tipo") == INCOME) & until) - A.total(A.spent() & until)).cast("decimal(28,2)").alias("saldo"))


@query(f"""{W}, s AS (SELECT 'receita_local' AS serie, "local" AS chave, sum(valor) AS v FROM ledger WHERE tipo = '{INCOME}' AND mes_ref = '{MONTH}' GROUP BY 2 UNION ALL
 SELECT 'despesa_categoria', categoria, sum(valor) FROM ledger WHERE {SPENT} AND mes_ref = '{MONTH}' GROUP BY 2 UNION ALL SELECT 'despesa_local', "local", sum(valor) FROM ledger WHERE {SPENT} AND mes_ref = '{MONTH}' GROUP BY 2)
 SELECT serie, chave, CAST(v AS {D}) AS total FROM s QUALIFY row_number() OVER (PARTITION BY serie ORDER BY v DESC, chave) <= 10""")
def three_top_series(spark, d):
    """A14."""
    return P.top_series(ledger(spark, d).filter(F.col("mes_ref") == MONTH), 10)


@query(f"""{W} SELECT 'semana' AS tipo, strftime(date_trunc('week', data), '%Y-%m-%d') AS valor FROM ledger WHERE mes_ref = '{MONTH}' GROUP BY 2 UNION ALL SELECT 'dia', strftime(data, '%Y-%m-%d') FROM ledger WHERE mes_ref = '{MONTH}' GROUP BY 2
 UNION ALL SELECT 'ano', substring(mes_ref, 1, 4) FROM ledger GROUP BY 2""")
def available_periods(spark, d):
    """A15."""
    return P.available(ledger(spark, d), MONTH)


@query(f"""{W} SELECT mes_ref, row_number() OVER (ORDER BY CASE WHEN mes_ref = '{MONTH}' THEN 0 ELSE 1 END, mes_ref DESC) AS ordem FROM (SELECT DISTINCT mes_ref FROM ledger)""")
def months_current_first(spark, d):
    """T5."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col("mes_ref") == MONTH, 0).otherwise(1), F.desc("mes_ref"))  # one row a month
    return ledger(spark, d).select("mes_ref").distinct().withColumn("ordem", F.row_number().over(w).cast("long"))


COMPLETE = f"""c AS (SELECT mes_ref, categoria, count(*) AS total, count(doc) AS com_doc FROM (SELECT * FROM ledger WHERE {SPENT}) LEFT JOIN (SELECT DISTINCT l_orderkey AS doc FROM lineitem WHERE l_returnflag = 'R') ON doc = identificador GROUP BY 1, 2)"""


def completeness(spark, d):
    return A.completeness(ledger(spark, d), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("identificador")))


@query(f"""{W}, {COMPLETE}, g AS (SELECT categoria, sum(com_doc) * 100.0::DOUBLE / sum(total) AS p FROM c GROUP BY 1)
 SELECT round((SELECT sum(com_doc) * 100.0::DOUBLE / sum(total) FROM c), 4) AS cobertura, CAST((SELECT sum(total) FROM c) AS BIGINT) AS transacoes, CAST((SELECT sum(com_doc) FROM c) AS BIGINT) AS com_doc,
 count(*) FILTER (p < 50) AS criticas, count(*) FILTER (p >= 50 AND p < 80) AS medias FROM g""")
def completeness_kpis(spark, d):
    """Global coverage, critical categories (below 50 %) and middling ones (below 80 %)."""
    return P.completeness_kpis(completeness(spark, d))


@query(f"""{W}, o AS (SELECT * FROM ledger WHERE {SPENT} AND identificador NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT mes_ref, categoria, identificador, valor, "local" FROM o""")
def orphan_rows(spark, d):
    """The rows without a document behind each cell."""
    docs = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("identificador"))
    return ledger(spark, d).filter(A.spent()).join(docs, "identificador", "left_anti").select("mes_ref", "categoria", "identificador", "valor", "local")


@query(f"""{W}, {COMPLETE}, r AS (SELECT "local" AS chave, 'recorrente' AS alerta FROM ledger WHERE {SPENT} GROUP BY 1 HAVING count(DISTINCT mes_ref) >= 3 AND sum(valor) >= 100)
 SELECT * FROM r UNION SELECT "local", 'valor_alto' FROM ledger WHERE {SPENT} AND valor >= 300000 UNION SELECT mes_ref || ' ' || categoria, 'sem_cobertura' FROM c WHERE total >= 2 AND com_doc = 0""")
def document_alerts(spark, d):
    """Recurring suppliers, high values and cells without any document."""
    return P.alerts(ledger(spark, d), completeness(spark, d), 3, 100, 300000)


FAMILIES = {"BUILDING": "fiscal", "FURNITURE": "fiscal", "MACHINERY": "pagamento"}


@query(f"""{W}, f AS (SELECT mes_ref, CASE categoria WHEN 'BUILDING' THEN 'fiscal' WHEN 'FURNITURE' THEN 'fiscal' WHEN 'MACHINERY' THEN 'pagamento' END AS familia FROM ledger), g AS (SELECT * FROM (SELECT DISTINCT mes_ref FROM ledger), (VALUES ('fiscal'), ('pagamento'), ('saude')) t(familia))
 SELECT g.mes_ref, g.familia, count(f.familia) AS n FROM g LEFT JOIN f ON f.mes_ref = g.mes_ref AND f.familia = g.familia GROUP BY 1, 2""")
def family_grid(spark, d):
    """Month by family, zeros included."""
    return P.family_grid(ledger(spark, d), FAMILIES, ["fiscal", "pagamento", "saude"])


@query(f"""{W}, p AS (SELECT {dsum(f"tipo = '{INCOME}' AND mes_ref = '{MONTH}'")} AS r1, {dsum(f"tipo = '{INCOME}' AND mes_ref = '{BEFORE[-1]}'")} AS r0, {dsum(f"{SPENT} AND mes_ref = '{MONTH}'")} AS d1, {dsum(f"{SPENT} AND mes_ref = '{BEFORE[-1]}'")} AS d0 FROM ledger)
 SELECT r1 AS receita, d1 AS despesa, round(CAST(r1 - r0 AS DOUBLE) / CAST(r0 AS DOUBLE) * 100, 4) AS delta_receita, round(CAST(d1 - d0 AS DOUBLE) / CAST(d0 AS DOUBLE) * 100, 4) AS delta_despesa FROM p""")
def period_delta(spark, d):
    """A month against the one before, by sign."""
    return P.period_delta(ledger(spark, d), MONTH, BEFORE[-1])


@query(f"""{W}, m AS (SELECT * FROM ledger WHERE mes_ref = '{MONTH}' AND {SPENT}), c AS (SELECT categoria, sum(valor) AS v FROM m GROUP BY 1), l AS (SELECT "local", count(*) AS n FROM m GROUP BY 1), w AS (SELECT isodow(data) - 1 AS dia, sum(valor) AS v FROM m GROUP BY 1)
 SELECT 'maior_categoria' AS insight, (SELECT categoria FROM c ORDER BY v DESC, categoria LIMIT 1) AS valor WHERE (SELECT count(*) FROM m) >= 30 UNION ALL
 SELECT 'local_frequente', (SELECT "local" FROM l ORDER BY n DESC, "local" LIMIT 1) WHERE (SELECT count(*) FROM m) >= 30 UNION ALL SELECT 'dia_caro', (SELECT CAST(dia AS VARCHAR) FROM w ORDER BY v DESC, dia LIMIT 1) WHERE (SELECT count(*) FROM m) >= 30""")
def insights(spark, d):
    """Nothing is said of fewer than 30 rows."""
    return P.insights(ledger(spark, d).filter((F.col("mes_ref") == MONTH) & A.spent()), 30)


@query(f"""{W} SELECT {dsum(f"tipo = '{INCOME}'")} AS entradas, {dsum(f"tipo <> '{INCOME}'")} AS saidas, CAST({dsum(f"tipo = '{INCOME}'")} - {dsum(f"tipo <> '{INCOME}'")} AS {D}) AS saldo, count(*) AS n FROM ledger WHERE mes_ref = '{MONTH}'""")
def statement_totals(spark, d):
    """A29."""
    into = F.col("tipo") == INCOME
    out = ledger(spark, d).filter(F.col("mes_ref") == MONTH).agg(A.total(into).alias("entradas"), A.total(~into).alias("saidas"), F.count("*").alias("n"))
    return out.withColumn("saldo", (F.col("entradas") - F.col("saidas")).cast("decimal(28,2)"))


@query(f"""{W}, e AS (SELECT data, valor, CASE WHEN identificador % 3 = 0 THEN 'pago' WHEN data < DATE '{TODAY}' THEN 'atrasado' ELSE 'pendente' END AS s FROM ledger WHERE {SPENT} AND data BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}' + 30)
 SELECT {dsum("s <> 'pago'")} AS a_pagar, count(*) FILTER (s = 'atrasado') AS atrasados, count(*) FILTER (s = 'pendente' AND data <= DATE '{TODAY}' + 7) AS em_7_dias, count(*) FILTER (s = 'pago') AS pagos FROM e""")
def payment_kpis(spark, d):
    """What is open, late, due within a week and paid."""
    rows = ledger(spark, d).filter(A.spent()).withColumn("pago", F.col("identificador") % 3 == 0)
    return P.payment_kpis(rows, TODAY, 30, 7)


@query(f"""{W}, w AS (SELECT sum(valor) FILTER (data BETWEEN DATE '1997-06-09' AND DATE '1997-06-15') AS agora, sum(valor) FILTER (data < DATE '1997-06-09') AS antes, count(DISTINCT date_trunc('week', data)) FILTER (data < DATE '1997-06-09') AS n
  FROM ledger WHERE {SPENT} AND data >= DATE '1997-06-09' - 84 AND data <= DATE '1997-06-15')
 SELECT CAST(agora AS {D}) AS agora, round(CAST(antes AS DOUBLE) / n, 2) AS media, CASE WHEN CAST(agora AS DOUBLE) > CAST(antes AS DOUBLE) / n * 1.15 THEN 'acima' WHEN CAST(agora AS DOUBLE) < CAST(antes AS DOUBLE) / n * 0.85 THEN 'abaixo' ELSE 'dentro' END AS delta FROM w""")
def week_delta(spark, d):
    """This week against the mean of the twelve before that have rows."""
    return P.week_delta(ledger(spark, d), "1997-06-09", 12)


@query(f"""{W}, t AS (SELECT CAST({dsum(SPENT)} AS DOUBLE) AS g, CAST({dsum(SPENT + " AND categoria IS NOT NULL AND categoria <> 'BUILDING'")} AS DOUBLE) AS c FROM ledger) SELECT round(c / g * 100, 4) AS cobertura_valor, (SELECT count(DISTINCT categoria) FROM ledger WHERE {SPENT}) AS categorias FROM t""")
def category_coverage_value(spark, d):
    """The share of what is spent that has a category (one of them stands for none here)."""
    known = F.col("categoria").isNotNull() & (F.col("categoria") != "BUILDING")
    out = ledger(spark, d).filter(A.spent()).agg(F.sum("valor").cast("double").alias("g"), F.sum(F.when(known, F.col("valor"))).cast("double").alias("c"), F.countDistinct("categoria").alias("categorias"))
    return out.select(F.round(F.col("c") / F.col("g") * 100, 4).alias("cobertura_valor"), "categorias")


@query(f"""{W}, t AS (SELECT mes_ref, categoria, CAST(sum(valor) AS {D}) AS v FROM ledger WHERE {SPENT} GROUP BY 1, 2), last6 AS (SELECT DISTINCT mes_ref FROM ledger ORDER BY 1 DESC LIMIT 6)
 SELECT 'categoria' AS parte, categoria AS chave, CAST(sum(v) AS {D}) AS total FROM t GROUP BY 2 UNION ALL SELECT 'classe', classificacao, CAST(sum(valor) AS {D}) FROM ledger WHERE {SPENT} GROUP BY 2
 UNION ALL SELECT 'pessoa', quem, CAST({dsum(f"tipo = '{INCOME}'")} - {dsum(SPENT)} AS {D}) FROM ledger WHERE tipo <> '{TRANSFER}' GROUP BY 2
 UNION ALL SELECT 'mes', mes_ref, CAST(sum(v) AS {D}) FROM t WHERE mes_ref IN (SELECT mes_ref FROM last6) GROUP BY 2 UNION ALL SELECT 'saude', 'grupo', CAST(sum(v) AS {D}) FROM t WHERE categoria IN ('HOUSEHOLD', 'FURNITURE')""")
def analysis_sheet(spark, d):
    """A4: categories, classes, balance by person, the last six months and the health group, in long form."""
    return P.analysis_sheet(ledger(spark, d), 6, ["HOUSEHOLD", "FURNITURE"])


# ---- contracts that can fail


@query(f"""{W}, {SALARIES}, r AS (SELECT mes_ref, sum(valor) AS r FROM ledger WHERE tipo = '{INCOME}' AND NOT contains("local", '13') GROUP BY 1), s AS (SELECT mes_ref, sum(bruto) * CAST(4.5 AS DECIMAL(2,1)) AS s FROM sal GROUP BY 1)
 SELECT mes_ref, CAST(r AS {D}) AS receita, CAST(s AS {D}) AS salario FROM r JOIN s USING (mes_ref) WHERE s > 0 AND CAST(r AS DOUBLE) > CAST(s AS DOUBLE) * CASE WHEN mes_ref LIKE '%-12' THEN 2.5 ELSE 2.0 END""")
def income_over_salary(spark, d):
    """Q1: months whose income, without what is no income, exceeds twice the salary (2.5 in December)."""
    pay = salaries(spark, d).withColumn("bruto", F.col("bruto") * F.lit("4.5").cast("decimal(2,1)"))
    return P.income_over_salary(ledger(spark, d), pay, F.col("local").contains("13"), 2.0, 2.5)


@query(f"""{W} SELECT identificador, texto FROM (SELECT *, CASE WHEN identificador % 50 = 0 THEN 'Juros ' ELSE '' END || "local" AS texto FROM ledger) WHERE tipo = '{INCOME}' AND regexp_matches(texto, '(?i)Juros|IOF|Multa')""")
def charges_as_income(spark, d):
    """Q3: interest, tax on operations and fines booked as income."""
    text = F.concat(F.when(F.col("identificador") % 50 == 0, "Juros ").otherwise(""), "local")
    return ledger(spark, d).withColumn("texto", text).filter((F.col("tipo") == INCOME) & F.col("texto").rlike("(?i)Juros|IOF|Multa")).select("identificador", "texto")


@query(f"""{W}, b AS (SELECT * FROM ledger WHERE identificador % 1000 <> 0), r AS (SELECT mes_ref, {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(SPENT)} AS despesa FROM b WHERE tipo <> '{TRANSFER}' GROUP BY 1),
 l AS (SELECT mes_ref, {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(SPENT)} AS despesa FROM ledger WHERE tipo <> '{TRANSFER}' GROUP BY 1)
 SELECT l.mes_ref, abs(l.receita - r.receita) > 0.01 AS receita_difere, abs(l.despesa - r.despesa) > 0.01 AS despesa_difere FROM l JOIN r USING (mes_ref) WHERE abs(l.receita - r.receita) > 0.01 OR abs(l.despesa - r.despesa) > 0.01""")
def summary_against_ledger(spark, d):
    """Q9 and Q10: a summary that lost rows differs from the ledger; months of both sides only."""
    rows = ledger(spark, d)
    return P.summary_differences(rows, A.monthly_summary(rows.filter(F.col("identificador") % 1000 != 0)))


@query(f"""{W}, b AS (SELECT banco_origem, sum(CASE WHEN identificador % 500 = 0 THEN valor + 1 ELSE valor END) AS bruto, sum(valor) AS livro, count(*) AS linhas FROM ledger GROUP BY 1)
 SELECT banco_origem, CAST(bruto AS {D}) AS bruto, CAST(livro AS {D}) AS livro, abs(bruto - livro) <= 0.02 AS fiel FROM b""")
def fidelity_audit(spark, d):
    """Statement lines, some of them altered on the way, against the ledger."""
    raw = ledger(spark, d).select("banco_origem", F.when(F.col("identificador") % 500 == 0, F.col("valor") + 1).otherwise(F.col("valor")).alias("valor"))
    return P.fidelity(raw, ledger(spark, d), 0.02)


@query(f"""{W}, t AS (SELECT * FROM ledger WHERE tipo = '{TRANSFER}'), g AS (SELECT data, CAST(round(valor / 10000) AS BIGINT) AS v, count(*) AS n FROM t GROUP BY 1, 2)
 SELECT CAST(sum(n) FILTER (n < 2) AS BIGINT) AS orfas, CAST(sum(n) AS BIGINT) AS total, round(CAST(sum(n) FILTER (n < 2) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS share, CAST(sum(n) FILTER (n < 2) AS DOUBLE) > CAST(sum(n) AS DOUBLE) * 0.65 AS violado FROM g""")
def transfers_without_partner(spark, d):
    """Q4: no more than 65 % of transfers alone in their date and value."""
    rows = ledger(spark, d).withColumn("valor", F.round(F.col("valor") / 10000).cast("long"))
    return P.lone_transfers(rows, 0.65)


@query("""WITH e AS (SELECT l_linestatus AS tipo, count(*) AS potencial, count(*) FILTER (l_quantity > 3) AS extraidas FROM lineitem GROUP BY 1) SELECT tipo, potencial, extraidas, round(extraidas * 1.0::DOUBLE / potencial, 6) AS cobertura, extraidas * 1.0::DOUBLE / potencial >= 0.94 AS ok FROM e""")
def extraction_coverage(spark, d):
    """Q18: rows read against rows that a file could give."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("tipo")).agg(F.count("*").alias("potencial"), F.count_if(F.col("l_quantity") > 3).alias("extraidas"))
    return P.coverage_check(e, 0.94)


CASES = {"nome_invalido": "p_name LIKE '%a%'", "sem_tipo": "p_size < 10", "orfao": "p_retailprice > 1500", "longo": "length(p_name) > 20"}


@query("SELECT categoria, n FROM (SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in CASES.items()) + " FROM part) UNPIVOT (n FOR categoria IN (" + ", ".join(CASES) + "))")
def structure_audit(spark, d):
    """Q17: four categories of faulty notes, counted in one pass."""
    return P.count_cases(table(spark, d, "part"), {n: F.expr(c) for n, c in CASES.items()})
