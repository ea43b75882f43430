"""Filters, dedup, rollups and contracts over the ledger view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import analytics as A
from ledgerloom.operators import ledger_ops as L
from ledgerloom.operators.rules import first_match, value_rule
from ledgerloom.schema import EXPENSE, INCOME, TAX, TRANSFER

from .catalogue import query
from .ledger import SQL, ledger, table

W = f"WITH {SQL}"
SPENT = f"tipo IN ('{EXPENSE}', '{TAX}')"
D = "DECIMAL(28,2)"


def dsum(condition: str, value: str = "valor") -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN {value} END), 0) AS {D})"


@query(f"""{W}, v AS (SELECT * FROM ledger WHERE tipo <> '{TRANSFER}'),
 c AS (SELECT mes_ref, categoria, sum(valor) AS s, row_number() OVER (PARTITION BY mes_ref ORDER BY sum(valor) DESC, categoria) AS rn FROM v WHERE {SPENT} GROUP BY 1, 2),
 m AS (SELECT mes_ref, {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(SPENT)} AS despesa,
   {dsum(SPENT + " AND classificacao = 'Obrigatório'")} AS obrigatorio, {dsum(SPENT + " AND classificacao = 'Questionável'")} AS questionavel,
   {dsum(SPENT + " AND classificacao = 'Supérfluo'")} AS superfluo FROM v GROUP BY 1)
 SELECT m.*, c.categoria AS top_categoria, CAST(c.s AS {D}) AS top_valor, CAST(receita - despesa AS {D}) AS saldo
 FROM m LEFT JOIN c ON m.mes_ref = c.mes_ref AND rn = 1""")
def monthly_summary(spark, d):
    return A.monthly_summary(ledger(spark, d))


@query(f"""{W} SELECT identificador, data, valor, tipo, upper(substring(sha256(strftime(data, '%Y-%m-%d') || '|' || CAST(valor AS VARCHAR) || '|' || "local" || '|' || banco_origem), 1, 16)) AS chave,
 year(data) || '-Q' || quarter(data) AS trimestre FROM ledger""")
def ledger_conform(spark, d):
    rows = ledger(spark, d)
    return rows.select("identificador", "data", "valor", "tipo", X.ledger_key(F.col("data"), F.col("valor"), F.col("local"), F.col("banco_origem")).alias("chave"), X.quarter_label(F.col("data")).alias("trimestre"))


@query(f"{W} SELECT banco_origem, count(*) AS n FROM ledger GROUP BY 1")
def rows_per_bank(spark, d):
    return ledger(spark, d).groupBy("banco_origem").agg(F.count("*").alias("n"))


@query(f"{W} SELECT * FROM ledger WHERE mes_ref = '1997-03'")
def filter_month(spark, d):
    return L.of_month(ledger(spark, d), "1997-03")


@query(f"{W} SELECT identificador, data FROM ledger WHERE weekofyear(data) = 7")
def filter_period_week(spark, d):
    return L.of_period(ledger(spark, d), "semana", 7).select("identificador", "data")


@query(f"{W} SELECT identificador FROM ledger WHERE mes_ref LIKE '1998%'")
def filter_year(spark, d):
    return L.of_period(ledger(spark, d), "ano", 1998).select("identificador")


@query(f"""{W} SELECT identificador, "local", valor FROM ledger WHERE banco_origem = (SELECT min(n_name) FROM nation) AND upper("local") LIKE '%1%' AND {SPENT}""")
def filter_statement_bar(spark, d):
    bank = table(spark, d, "nation").agg(F.min("n_name").alias("n")).first()["n"]
    return L.statement_bar(ledger(spark, d), bank=bank, text="1", expenses_only=True).select("identificador", "local", "valor")


@query(f"{W} SELECT identificador, mes_ref FROM ledger WHERE mes_ref IN (SELECT DISTINCT mes_ref FROM ledger ORDER BY 1 DESC LIMIT 3)")
def filter_last_n_months(spark, d):
    return L.last_months(ledger(spark, d), 3).select("identificador", "mes_ref")


@query(f"{W} SELECT identificador, valor FROM ledger WHERE data BETWEEN DATE '1996-02-01' AND DATE '1996-02-15'")
def filter_interval(spark, d):
    return ledger(spark, d).filter(F.col("data").between("1996-02-01", "1996-02-15")).select("identificador", "valor")


@query(f"{W} SELECT categoria, count(*) AS n FROM ledger WHERE categoria IN (SELECT categoria FROM ledger GROUP BY 1 HAVING count(*) >= 100) GROUP BY 1")
def filter_loud_categories(spark, d):
    return L.loud_categories(ledger(spark, d), 100).groupBy("categoria").agg(F.count("*").alias("n"))


@query(f"""{W} SELECT identificador, CASE WHEN upper("local") LIKE '%7%' AND abs(valor) < 100000 THEN 'sete' WHEN abs(valor) > 200000 THEN 'alto'
 WHEN categoria = 'BUILDING' THEN 'obra' ELSE 'Outros' END AS regra FROM ledger""")
def rule_categorize(spark, d):
    x = F.col("valor")
    rules = [
        (F.upper("local").contains("7") & value_rule(F.lit("< 100000"), x), "sete"),
        (value_rule(F.lit("> 200000"), x), "alto"),
        ((F.col("categoria") == "BUILDING") & value_rule(F.lit("sem limite"), x), "obra"),
    ]
    return ledger(spark, d).select("identificador", first_match(rules, "Outros").alias("regra"))


@query(f"""{W} SELECT r.nome, count(l.identificador) AS n FROM (VALUES ('sete', '7'), ('cem', '100'), ('zero', '00')) r(nome, p) LEFT JOIN ledger l ON contains(l."local", r.p) GROUP BY 1""")
def rule_hits(spark, d):
    rules = {"sete": "7", "cem": "100", "zero": "00"}
    rows = ledger(spark, d).agg(*[F.count_if(F.col("local").contains(p)).alias(n) for n, p in rules.items()])
    return rows.unpivot([], list(rules), "nome", "n")


@query("""SELECT p_brand, count(*) AS n FROM part WHERE p_type NOT LIKE 'A%' GROUP BY 1 HAVING count(*) >= 3""")
def recurring_uncategorized(spark, d):
    return table(spark, d, "part").filter(~F.col("p_type").startswith("A")).groupBy("p_brand").agg(F.count("*").alias("n")).filter("n >= 3")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_identifier(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    keyed = rows.withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return L.dedup_identifier(keyed, "k", ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("k", "l_shipdate")


@query("""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS "groups" FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def residual_duplicates(spark, d):
    return L.residual_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{W} SELECT categoria, CAST(sum(valor) AS {D}) AS total, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY 1")
def expense_by_category(spark, d):
    return A.by_category(ledger(spark, d))


@query(f"""{W} SELECT {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(SPENT)} AS despesa, {dsum("categoria = 'BUILDING' AND " + SPENT)} AS investido,
 round(CAST({dsum("categoria = 'BUILDING' AND " + SPENT)} AS DOUBLE) / CAST({dsum(f"tipo = '{INCOME}'")} AS DOUBLE), 6) AS poupanca FROM ledger""")
def flow_kpis(spark, d):
    out = ledger(spark, d).agg(A.total(F.col("tipo") == INCOME).alias("receita"), A.total(A.spent()).alias("despesa"), A.total((F.col("categoria") == "BUILDING") & A.spent()).alias("investido"))
    return out.withColumn("poupanca", F.round(A.ratio(F.col("investido"), F.col("receita")), 6))


@query(f"""{W} SELECT mes_ref, {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(f"tipo = '{EXPENSE}'")} AS despesa, {dsum(f"tipo = '{TAX}'")} AS imposto, count(*) AS n FROM ledger GROUP BY 1""")
def comparative_months(spark, d):
    return ledger(spark, d).groupBy("mes_ref").agg(
        A.total(F.col("tipo") == INCOME).alias("receita"), A.total(F.col("tipo") == EXPENSE).alias("despesa"), A.total(F.col("tipo") == TAX).alias("imposto"), F.count("*").alias("n")
    )


@query(f"""{W} SELECT "local", CAST(sum(valor) AS {D}) AS total, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY 1 ORDER BY total DESC, "local" LIMIT 10""")
def top_beneficiaries(spark, d):
    return ledger(spark, d).filter(A.spent()).groupBy("local").agg(F.sum("valor").cast("decimal(28,2)").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "local").limit(10)


@query(f"{W} SELECT banco_origem, mes_ref, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE {SPENT} GROUP BY 1, 2")
def card_bills(spark, d):
    return ledger(spark, d).filter(A.spent()).groupBy("banco_origem", "mes_ref").agg(F.sum("valor").cast("decimal(28,2)").alias("total"))


@query(f"""{W}, t AS (SELECT banco_origem, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE {SPENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
 SELECT banco_origem, total, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100, 4) AS share FROM t""")
def breakdown_topn_share(spark, d):
    return A.top_share(ledger(spark, d), "banco_origem", 5)


@query(f"{W} SELECT classificacao, categoria, CAST(sum(valor) AS {D}) AS total, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY ROLLUP (classificacao, categoria)")
def class_category_tree(spark, d):
    return ledger(spark, d).filter(A.spent()).rollup("classificacao", "categoria").agg(F.sum("valor").cast("decimal(28,2)").alias("total"), F.count("*").alias("n"))


@query(f"""{W} SELECT count(DISTINCT categoria) AS categorias, count(*) AS n, CAST(sum(valor) AS {D}) AS total, count(DISTINCT mes_ref) AS meses FROM ledger WHERE {SPENT}""")
def category_kpis(spark, d):
    return ledger(spark, d).filter(A.spent()).agg(F.countDistinct("categoria").alias("categorias"), F.count("*").alias("n"), F.sum("valor").cast("decimal(28,2)").alias("total"), F.countDistinct("mes_ref").alias("meses"))


@query(f"""{W}, t AS (SELECT categoria FROM ledger WHERE {SPENT} GROUP BY 1 ORDER BY sum(valor) DESC, 1 LIMIT 3)
 SELECT categoria AS de, classificacao AS para, CAST(sum(valor) AS {D}) AS valor FROM ledger WHERE {SPENT} AND categoria IN (FROM t) GROUP BY 1, 2
 UNION ALL SELECT classificacao, quem, CAST(sum(valor) AS {D}) FROM ledger WHERE {SPENT} AND categoria IN (FROM t) GROUP BY 1, 2""")
def sankey_edges(spark, d):
    return A.sankey(ledger(spark, d), 3)


@query(f"""{W}, v AS (SELECT *, CASE WHEN tipo = '{INCOME}' THEN valor ELSE -valor END AS s FROM ledger)
 SELECT banco_origem, CAST(sum(s) AS {D}) AS saldo, {dsum("data > DATE '1998-12-31' - 30", "s")} AS delta, count(*) AS n FROM v GROUP BY 1""")
def bank_balance_30d(spark, d):
    return A.balance_by_bank(ledger(spark, d), "1998-12-31")


@query(f"""{W}, m AS (SELECT banco_origem, mes_ref, sum(valor) AS m FROM ledger WHERE {SPENT} GROUP BY 1, 2),
 b AS (SELECT banco_origem, max(m) AS maior, arg_max(m, mes_ref) AS usado FROM m GROUP BY 1)
 SELECT banco_origem, CAST(usado AS {D}) AS usado, CAST(greatest(CAST(maior * 1.5 AS DECIMAL(28,3)), CAST(usado AS DECIMAL(28,3)), CAST(1000 AS DECIMAL(28,3))) AS DECIMAL(28,3)) AS limite,
 round(CAST(usado AS DOUBLE) / greatest(CAST(maior AS DOUBLE) * 1.5, CAST(usado AS DOUBLE), 1000.0), 4) AS uso FROM b""")
def card_utilization(spark, d):
    return A.robust_limits(ledger(spark, d))


@query(f"{W} SELECT CAST(isodow(data) - 1 AS INTEGER) AS dia, CAST(weekofyear(data) AS INTEGER) AS semana, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE {SPENT} GROUP BY 1, 2")
def heatmap_weekday_week(spark, d):
    return ledger(spark, d).filter(A.spent()).groupBy(F.weekday("data").alias("dia"), F.weekofyear("data").alias("semana")).agg(F.sum("valor").cast("decimal(28,2)").alias("total"))


@query("SELECT event_type, CAST(ts AS DATE) AS dia, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (CAST(ts AS DATE)), (user_id))")
def facet_counts(spark, d):
    e = table(spark, d, "events").withColumn("dia", F.to_date("ts"))
    return e.groupingSets([[F.col("event_type")], [F.col("dia")], [F.col("user_id")]], "event_type", "dia", "user_id").agg(F.count("*").alias("n"))


@query(f"""{W}, t AS (SELECT categoria, sum(valor) AS total FROM ledger WHERE {SPENT} AND data BETWEEN DATE '1997-05-05' AND DATE '1997-05-11' GROUP BY 1)
 SELECT categoria, CAST(total AS {D}) AS total, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100, 4) AS share FROM t""")
def weekly_top_categories(spark, d):
    return A.top_share(ledger(spark, d).filter(F.col("data").between("1997-05-05", "1997-05-11")), "categoria", 100)


@query(f"""{W} SELECT CAST(date_trunc('week', data) AS DATE) AS semana, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE {SPENT} AND data >= DATE '1997-05-05' - 84 AND data < DATE '1997-05-05' GROUP BY 1""")
def previous_12_weeks(spark, d):
    rows = ledger(spark, d).filter(A.spent() & (F.col("data") >= F.date_sub(F.lit("1997-05-05").cast("date"), 84)) & (F.col("data") < "1997-05-05"))
    return rows.groupBy(F.date_trunc("week", "data").cast("date").alias("semana")).agg(F.sum("valor").cast("decimal(28,2)").alias("total"))


@query(f"""{W}, t AS (SELECT categoria, {dsum("mes_ref = '1997-06'")} AS atual, {dsum("mes_ref = '1997-05'")} AS anterior FROM ledger WHERE {SPENT} AND mes_ref IN ('1997-05', '1997-06') GROUP BY 1)
 SELECT *, CASE WHEN anterior = 0 AND atual > 200 THEN 'nova' WHEN atual = 0 AND anterior > 200 THEN 'sumiu' WHEN anterior > 100 AND atual > 100 AND abs(atual - anterior) > anterior * 0.5 THEN 'variou' END AS anomalia FROM t""")
def month_anomalies(spark, d):
    return A.anomalies(ledger(spark, d), "1997-06", "1997-05")


@query(f"""{W} SELECT categoria, {dsum("mes_ref = '1997-06'")} AS atual, round(CAST({dsum("mes_ref <> '1997-06'")} AS DOUBLE) / 3, 4) AS media,
 round(CAST({dsum("mes_ref = '1997-06'")} AS DOUBLE) - CAST({dsum("mes_ref <> '1997-06'")} AS DOUBLE) / 3, 4) AS diferenca
 FROM ledger WHERE {SPENT} AND mes_ref IN ('1997-03', '1997-04', '1997-05', '1997-06') GROUP BY 1""")
def diagnostic_vs_mean(spark, d):
    return A.against_mean(ledger(spark, d), "1997-06", ["1997-03", "1997-04", "1997-05"])


@query(f"""{W} SELECT t.tag, {dsum("categoria = t.tag AND " + f"tipo = '{TAX}'")} AS total, count(*) FILTER (categoria = t.tag AND tipo = '{TAX}') AS n
 FROM (VALUES ('BUILDING'), ('MACHINERY'), ('AUSENTE')) t(tag) CROSS JOIN ledger GROUP BY 1""")
def tax_totals_dense(spark, d):
    tags = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("AUSENTE",)], "tag string")
    sums = ledger(spark, d).filter(F.col("tipo") == TAX).groupBy(F.col("categoria").alias("tag")).agg(F.sum("valor").alias("s"), F.count("*").alias("c"))
    return tags.join(sums, "tag", "left").select("tag", F.coalesce("s", F.lit(0)).cast("decimal(28,2)").alias("total"), F.coalesce("c", F.lit(0)).alias("n"))


@query(f"""{W}, m AS (SELECT mes_ref, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE {SPENT} GROUP BY 1)
 SELECT mes_ref, total, lag(total) OVER (ORDER BY mes_ref) AS "before", CAST(total - lag(total) OVER (ORDER BY mes_ref) AS {D}) AS delta FROM m""")
def lag_month_delta(spark, d):
    return A.month_change(ledger(spark, d))


@query(f"""{W}, x AS (SELECT *, (SELECT 1) FROM ledger WHERE {SPENT})
 SELECT mes_ref, categoria, count(*) AS total, count(doc) AS com_doc, count(*) - count(doc) AS sem_doc, round(CAST(count(doc) AS DOUBLE) / count(*) * 100, 2) AS cobertura
 FROM x LEFT JOIN (SELECT DISTINCT l_orderkey AS doc FROM lineitem WHERE l_returnflag = 'R') ON doc = identificador GROUP BY 1, 2""")
def completeness_matrix(spark, d):
    docs = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("identificador"))
    return A.completeness(ledger(spark, d), docs)


@query(f"""{W} SELECT "local", count(DISTINCT mes_ref) AS meses, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE {SPENT} GROUP BY 1 HAVING count(DISTINCT mes_ref) >= 3 AND sum(valor) >= 100""")
def gap_alerts(spark, d):
    return A.recurring(ledger(spark, d), "local", 3, 100)


@query(f"""{W}, s AS (SELECT data, sum(CASE WHEN tipo = '{INCOME}' THEN valor ELSE -valor END) AS v FROM ledger GROUP BY 1)
 SELECT data, CAST(sum(v) OVER (ORDER BY data) AS {D}) AS saldo FROM s""")
def running_balance(spark, d):
    from pyspark.sql import Window

    days = L.signed(ledger(spark, d)).groupBy("data").agg(F.sum("valor_assinado").alias("v"))
    return days.select("data", F.sum("v").over(Window.partitionBy(F.lit(1)).orderBy("data")).cast("decimal(28,2)").alias("saldo"))  # one row a day


@query(f"""{W}, s AS (SELECT banco_origem, mes_ref, sum(CASE WHEN tipo = '{INCOME}' THEN valor ELSE -valor END) AS v FROM ledger GROUP BY 1, 2)
 SELECT banco_origem, mes_ref, CAST(sum(v) OVER (PARTITION BY banco_origem ORDER BY mes_ref) AS {D}) AS saldo FROM s""")
def running_balance_by_bank(spark, d):
    from pyspark.sql import Window

    months = L.signed(ledger(spark, d)).groupBy("banco_origem", "mes_ref").agg(F.sum("valor_assinado").alias("v"))
    return months.select("banco_origem", "mes_ref", F.sum("v").over(Window.partitionBy("banco_origem").orderBy("mes_ref")).cast("decimal(28,2)").alias("saldo"))


@query(f"""{W} SELECT 'despesa_nao_negativa' AS contrato, count(*) FILTER (tipo = '{EXPENSE}' AND valor < 0) AS violacoes FROM ledger
 UNION ALL SELECT 'categoria_em_despesa', count(*) FILTER (tipo = '{EXPENSE}' AND categoria IS NULL) FROM ledger
 UNION ALL SELECT 'tipo_valido', count(*) FILTER (tipo NOT IN ('{INCOME}', '{EXPENSE}', '{TAX}', '{TRANSFER}')) FROM ledger
 UNION ALL SELECT 'classe_valida', count(*) FILTER ({SPENT} AND classificacao NOT IN ('Obrigatório', 'Questionável', 'Supérfluo')) FROM ledger
 UNION ALL SELECT 'valor_presente', count(*) FILTER (valor IS NULL) FROM ledger
 UNION ALL SELECT 'banco_valido', count(*) FROM ledger WHERE banco_origem NOT IN (SELECT n_name FROM nation)
 UNION ALL SELECT 'classes_somam_despesa', count(*) FROM (SELECT mes_ref FROM ledger WHERE {SPENT} GROUP BY 1 HAVING abs(sum(valor) - sum(CASE WHEN classificacao IS NOT NULL THEN valor END)) > 0.01)""")
def contracts_all(spark, d):
    return A.contracts(ledger(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("banco_origem")))


@query(f"""{W} SELECT mes_ref, {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(SPENT)} AS despesa FROM ledger GROUP BY 1 HAVING {dsum(SPENT)} > {dsum(f"tipo = '{INCOME}'")} AND {dsum(f"tipo = '{INCOME}'")} > 0""")
def months_in_the_red(spark, d):
    out = ledger(spark, d).groupBy("mes_ref").agg(A.total(F.col("tipo") == INCOME).alias("receita"), A.total(A.spent()).alias("despesa"))
    return out.filter("despesa > receita and receita > 0")


@query(f"{W} SELECT identificador, data, valor FROM ledger ORDER BY data DESC, identificador DESC LIMIT 20")
def latest_rows(spark, d):
    return ledger(spark, d).orderBy(F.desc("data"), F.desc("identificador")).limit(20).select("identificador", "data", "valor")


@query(f"{W} SELECT identificador FROM ledger ORDER BY data, identificador LIMIT 25 OFFSET 50")
def page_slice(spark, d):
    return ledger(spark, d).orderBy("data", "identificador").offset(50).limit(25).select("identificador")


@query(f"""{W} SELECT mes_ref, substring('janfevmarabrmaijunjulagosetoutnovdez', (CAST(substring(mes_ref, 6, 2) AS INTEGER) - 1) * 3 + 1, 3) || '/' || substring(mes_ref, 3, 2) AS rotulo, count(*) AS n FROM ledger GROUP BY 1, 2""")
def month_labels(spark, d):
    return ledger(spark, d).groupBy("mes_ref", X.month_label(F.col("mes_ref")).alias("rotulo")).agg(F.count("*").alias("n"))


@query(f"""{W}, y AS (SELECT substring(mes_ref, 1, 4) AS ano, quem, {dsum(f"tipo = '{INCOME}'")} AS receita, {dsum(SPENT)} AS despesa FROM ledger GROUP BY 1, 2) SELECT * FROM y""")
def yearly_by_person(spark, d):
    return ledger(spark, d).groupBy(F.substring("mes_ref", 1, 4).alias("ano"), "quem").agg(A.total(F.col("tipo") == INCOME).alias("receita"), A.total(A.spent()).alias("despesa"))
