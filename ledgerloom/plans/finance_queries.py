"""Payments, projections, bills, tax and validation over the ledger view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import finance as N
from ledgerloom.schema import EXPENSE, INCOME, TRANSFER

from .catalogue import query
from .ledger import SQL, ledger, table
from .ledger_queries import D, SPENT, W, dsum

#: Yearly tax brackets of 2025 (up to this base, rate, deduction), caps and allowances.
BRACKETS = [(26963.20, 0.0, 0.0), (33919.80, 0.075, 2022.24), (45012.60, 0.15, 4566.23), (55976.16, 0.225, 7941.67), (999999999.99, 0.275, 10740.98)]
INSS_CAP, DEPENDANT, SIMPLE_RATE, SIMPLE_CAP = 7786.02, 2275.08, 0.2, 16754.34
RATES = {"pessimista": 0.04, "realista": 0.08, "otimista": 0.12}
TODAY = "1997-03-15"


def _bracket_sql(base: str) -> str:
    return "CASE " + " ".join(f"WHEN {base} <= CAST({a!r} AS DOUBLE) THEN greatest(0.0::DOUBLE, {base} * {r!r}::DOUBLE - {d!r}::DOUBLE)" for a, r, d in BRACKETS) + " ELSE 0.0::DOUBLE END"


@query("""SELECT o_orderkey AS identificador, CASE WHEN o_orderkey % 11 = 0 THEN 'Crédito' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Pix' WHEN 1 THEN 'Débito' WHEN 2 THEN 'Boleto'
 WHEN 3 THEN 'Transferência' WHEN 4 THEN 'Pix' ELSE 'Débito' END END AS forma_pagamento FROM orders""")
def payment_method_case(spark, d):
    k = F.col("o_orderkey")
    text = F.get(F.array(*[F.lit(t) for t in ("pix enviado", "compra DEBITO", "Boleto pago", "ted recebida", "PIX de BOLETO", "saque")]), (k % 6).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("identificador"), text.alias("t"), F.when(k % 11 == 0, "cartao").otherwise("cc").alias("kind"))
    return rows.select("identificador", X.payment_method(F.col("t"), F.col("kind")).alias("forma_pagamento"))


@query(f"{W} SELECT devedor, count(*) AS n FROM (SELECT CASE WHEN identificador % 3 = 0 THEN categoria ELSE quem END AS devedor FROM ledger) GROUP BY 1")
def effective_debtor(spark, d):
    named = ledger(spark, d).withColumn("pessoa_devedora", F.when(F.col("identificador") % 3 == 0, F.col("categoria")))
    return named.groupBy(F.coalesce("pessoa_devedora", "quem").alias("devedor")).agg(F.count("*").alias("n"))


@query(f"""{W} SELECT identificador, substring(sha256(strftime(data, '%Y-%m-%d') || '|' || lower(trim("local")) || '|' || CAST(-valor AS VARCHAR)), 1, 16) AS chave FROM ledger""")
def key_hash(spark, d):
    return ledger(spark, d).select("identificador", X.key_hash(F.col("data"), F.col("local"), -F.col("valor")).alias("chave"))


@query(f"""{W}, m AS (SELECT mes_ref, CAST({dsum(f"tipo = '{INCOME}'")} - {dsum(SPENT)} AS DOUBLE) AS s, row_number() OVER (ORDER BY mes_ref DESC) AS rn FROM ledger WHERE tipo <> '{TRANSFER}' GROUP BY 1)
 SELECT round(avg(s), 2) AS todos, CASE WHEN count(*) >= 12 THEN round(avg(s) FILTER (rn <= 12), 2) END AS ultimos_12, CASE WHEN count(*) >= 3 THEN round(avg(s) FILTER (rn <= 3), 2) END AS ultimos_3,
  greatest(0.0::DOUBLE, round(avg(s), 2), CASE WHEN count(*) >= 12 THEN round(avg(s) FILTER (rn <= 12), 2) END, CASE WHEN count(*) >= 3 THEN round(avg(s) FILTER (rn <= 3), 2) END) AS aporte FROM m""")
def rhythms(spark, d):
    return N.robust_contribution(N.rhythms(ledger(spark, d)))


_CURVE = " UNION ALL ".join(
    f"SELECT '{n}' AS cenario, CAST(m AS INTEGER) AS mes, round(10000.0::DOUBLE * pow(1 + {r!r}::DOUBLE / 12, m) + 500.0::DOUBLE * (pow(1 + {r!r}::DOUBLE / 12, m) - 1) / ({r!r}::DOUBLE / 12), 2) AS valor FROM range(0, 61) t(m)"
    for n, r in RATES.items()
)


@query(_CURVE)
def projection_curve(spark, d):
    return N.curves(spark, 10000.0, 500.0, RATES, 60)


@query(f"WITH c AS ({_CURVE}) SELECT cenario, min(mes) FILTER (valor >= 40000) AS meses FROM c GROUP BY 1")
def months_to_target(spark, d):
    return N.months_until(N.curves(spark, 10000.0, 500.0, RATES, 60), 40000)


@query(f"""{W}, m AS (SELECT banco_origem, CAST({dsum(f"tipo = '{INCOME}'")} - {dsum(SPENT)} AS DOUBLE) AS agora, count(DISTINCT mes_ref) AS meses FROM ledger WHERE tipo <> '{TRANSFER}' GROUP BY 1)
 SELECT banco_origem, CAST(CASE WHEN agora >= 50000000 THEN 0 WHEN agora / meses > 0 THEN ceil((50000000 - agora) / (agora / meses)) END AS BIGINT) AS meses FROM m""")
def months_to_goal(spark, d):
    rows = ledger(spark, d).filter(F.col("tipo") != TRANSFER).groupBy("banco_origem").agg(
        (N.total(F.col("tipo") == INCOME) - N.total(N.spent())).cast("decimal(28,2)").cast("double").alias("agora"), F.countDistinct("mes_ref").alias("n"))
    return rows.select("banco_origem", N.months_to_goal(F.col("agora") / F.col("n"), F.lit(50000000.0), F.col("agora")).alias("meses"))


@query(f"""{W}, paid AS (SELECT DISTINCT banco_origem FROM ledger WHERE {SPENT} AND mes_ref = '1997-03' AND identificador % 4 = 0)
 SELECT n_name AS conta, make_date(1997, 3, least(n_nationkey + 1, 28)) AS vencimento, CASE WHEN make_date(1997, 3, least(n_nationkey + 1, 28)) < DATE '{TODAY}' THEN 'atrasado' ELSE 'pendente' END AS status
 FROM nation WHERE n_name NOT IN (SELECT banco_origem FROM paid)
 UNION ALL SELECT banco_origem, DATE '{TODAY}', 'pago' FROM paid""")
def paid_union_expected(spark, d):
    paid = ledger(spark, d).filter(N.spent() & (F.col("identificador") % 4 == 0)).select(F.col("banco_origem").alias("conta"), "mes_ref")
    terms = table(spark, d, "nation").select(F.col("n_name").alias("conta"), (F.col("n_nationkey") + 1).alias("dia"))
    now = paid.filter(F.col("mes_ref") == TODAY[:7]).select("conta").distinct()
    return N.expected_bills(terms, paid, TODAY).unionByName(now.select("conta", F.lit(TODAY).cast("date").alias("vencimento"), F.lit("pago").alias("status")))


@query(f"""SELECT CAST(DATE '{TODAY}' + CAST(i AS INTEGER) AS DATE) AS dia, (SELECT count(*) FROM nation WHERE n_nationkey + 1 = day(DATE '{TODAY}' + CAST(i AS INTEGER))) AS contas FROM range(0, 14) t(i)""")
def calendar_14d(spark, d):
    terms = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("dia"))
    return N.due_calendar(terms, TODAY)


@query(f"""{W}, g AS (SELECT "local", count(*) FILTER (tipo = '{EXPENSE}') AS n, arg_max(valor, (data, identificador)) FILTER (tipo = '{EXPENSE}') AS ultimo, floor((2 * sum(CAST(valor * 100 AS BIGINT)) + count(valor)) / (2.0::DOUBLE * count(valor))) / 100 AS media FROM ledger GROUP BY 1)
 SELECT "local", CASE WHEN n >= 2 THEN CAST(ultimo AS DOUBLE) ELSE media END AS estimativa, CASE WHEN n >= 2 THEN 'ultimo' ELSE 'media' END AS origem FROM g""")
def bill_estimate(spark, d):
    return N.bill_estimate(ledger(spark, d), "local", F.col("tipo") == EXPENSE)


_TAXED = f"""{W}, p AS (SELECT "local" AS pessoa, year(data) AS ano, CAST(CAST(sum(valor) AS {D}) AS DOUBLE) / 10 AS rendimentos, CAST(CAST(sum(valor) AS {D}) AS DOUBLE) * 0.011::DOUBLE AS inss,
  CAST(count(*) AS DOUBLE) * 100 AS medicas, CAST(count(*) % 3 AS DOUBLE) AS dependentes FROM ledger WHERE tipo = '{INCOME}' GROUP BY 1, 2)"""


def _people(spark, d):
    s = F.sum("valor").cast("decimal(28,2)").cast("double")
    return ledger(spark, d).filter(F.col("tipo") == INCOME).groupBy(F.col("local").alias("pessoa"), F.year("data").cast("long").alias("ano")).agg(
        (s / 10).alias("rendimentos"), (s * 0.011).alias("inss"), (F.count("*").cast("double") * 100).alias("medicas"), (F.count("*") % 3).cast("double").alias("dependentes"))


@query(f"{_TAXED} SELECT pessoa, ano, round({_bracket_sql('rendimentos')}, 2) AS imposto FROM p")
def progressive_tax(spark, d):
    return _people(spark, d).select("pessoa", "ano", F.round(N.progressive(F.col("rendimentos"), BRACKETS), 2).alias("imposto"))


@query(f"""{_TAXED}, b AS (SELECT *, greatest(0.0::DOUBLE, rendimentos - least(inss, {INSS_CAP}::DOUBLE) - medicas - dependentes * {DEPENDANT}::DOUBLE) AS c,
  greatest(0.0::DOUBLE, rendimentos - least(rendimentos * {SIMPLE_RATE}::DOUBLE, {SIMPLE_CAP}::DOUBLE)) AS s FROM p),
 t AS (SELECT pessoa, ano, round({_bracket_sql('c')}, 2) AS imposto_completo, round({_bracket_sql('s')}, 2) AS imposto_simplificado FROM b)
 SELECT *, CASE WHEN imposto_completo <= imposto_simplificado THEN 'completo' ELSE 'simplificado' END AS regime FROM t""")
def regime_compare(spark, d):
    return N.regimes(_people(spark, d), BRACKETS, INSS_CAP, DEPENDANT, SIMPLE_RATE, SIMPLE_CAP).select("pessoa", "ano", "imposto_completo", "imposto_simplificado", "regime")


@query(f"""{W} SELECT t.tag, EXISTS (SELECT 1 FROM ledger WHERE categoria = t.tag AND tipo = '{EXPENSE}') AS presente FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('MEDICAL'), ('PENSION')) t(tag)""")
def tax_checklist(spark, d):
    tags = spark.createDataFrame([(t,) for t in ("AUTOMOBILE", "BUILDING", "MEDICAL", "PENSION")], "tag string")
    seen = ledger(spark, d).filter(F.col("tipo") == EXPENSE).select(F.col("categoria").alias("tag"), F.lit(True).alias("presente")).distinct()
    return tags.join(seen, "tag", "left").select("tag", F.coalesce("presente", F.lit(False)).alias("presente"))


@query(f"""{W}, m AS (SELECT mes_ref, {dsum(f"tipo = '{INCOME}'")} AS r, {dsum(SPENT)} AS d FROM ledger GROUP BY 1)
 SELECT 'sem_categoria' AS regra, count(*) FILTER (categoria IS NULL OR categoria = 'Outros') AS ocorrencias FROM ledger
 UNION ALL SELECT 'classificacao_invalida', count(*) FILTER (classificacao NOT IN ('Obrigatório', 'Questionável', 'Supérfluo', 'N/A')) FROM ledger
 UNION ALL SELECT 'duplicatas', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ledger GROUP BY identificador)
 UNION ALL SELECT 'meses_sem_receita', count(*) FILTER (r = 0) FROM m UNION ALL SELECT 'despesa_maior_receita', count(*) FILTER (d > r AND r > 0) FROM m""")
def validator_all(spark, d):
    return N.validations(ledger(spark, d))


@query(f"""WITH RECURSIVE {W[5:]}, x AS (SELECT identificador AS id, mes_ref, "local" AS l, CAST(valor AS DOUBLE) AS v, row_number() OVER (PARTITION BY mes_ref, "local" ORDER BY identificador) AS rn FROM ledger WHERE tipo = '{INCOME}'),
 s AS (SELECT mes_ref, l, rn, id, id AS grupo, [{{'g': id, 'v': v}}] AS heads FROM x WHERE rn = 1
 UNION ALL SELECT mes_ref, l, rn, id, coalesce(h, id), CASE WHEN h IS NULL THEN list_append(heads, {{'g': id, 'v': v}}) ELSE heads END
 FROM (SELECT x.*, s.heads, list_filter(s.heads, lambda f: abs(x.v - f.v) <= 0.05 * least(abs(x.v), abs(f.v)))[1].g AS h FROM s JOIN x ON x.mes_ref = s.mes_ref AND x.l = s.l AND x.rn = s.rn + 1))
 SELECT id, grupo FROM s""")
def same_reality_groups(spark, d):
    """J10."""
    rows = ledger(spark, d).filter(F.col("tipo") == INCOME).select(F.col("identificador").alias("id"), "mes_ref", "local", F.col("valor").cast("double").alias("valor"))
    return N.same_reality(rows, ["mes_ref", "local"])


@query(f"""{W} SELECT ano, "local" AS pessoa, CAST(sum(valor) AS {D}) AS total FROM (SELECT year(data) AS ano, * FROM ledger WHERE tipo = '{INCOME}') GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY ano ORDER BY sum(valor) DESC, "local") <= 3""")
def top_incomes_by_year(spark, d):
    from pyspark.sql import Window

    sums = ledger(spark, d).filter(F.col("tipo") == INCOME).groupBy(F.year("data").cast("long").alias("ano"), F.col("local").alias("pessoa")).agg(F.sum("valor").cast("decimal(28,2)").alias("total"))
    return sums.withColumn("rn", F.row_number().over(Window.partitionBy("ano").orderBy(F.desc("total"), "pessoa"))).filter("rn <= 3").drop("rn")
