"""Document texts built from the tables, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import identifiers as I  # noqa: E741

from .catalogue import query
from .ledger import ledger, table
from .ledger_queries import D, W

K = "lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN substring({K}, 1, 8) || '000199|' ELSE '' END || '11222333000144' AS empresas,
 CASE WHEN o_orderkey % 3 = 0 THEN {K} || '123' END AS pessoa, CASE WHEN o_orderkey % 5 = 0 THEN repeat({K}, 5) || '5500' END AS chave FROM orders""")
def page_ids(spark, d):
    k = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    part = lambda a, n: F.substring(k, a, n)
    company = F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/0001-99"))
    person = F.concat(part(1, 3), F.lit(". "), part(4, 3), F.lit("."), part(7, 2), F.lit("1-23"))
    key = F.array_join(F.transform(F.regexp_extract_all(F.concat(F.repeat(k, 5), F.lit("5500")), F.lit("([0-9]{4})"), F.lit(1)), lambda x: x), " ")
    text = F.concat(
        F.lit("nota 11.222.333/0001-44\n"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CNPJ: "), company)).otherwise(""), F.lit("\n"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("CPF "), person)).otherwise(""), F.lit("\n"), F.when(F.col("o_orderkey") % 5 == 0, key).otherwise(""))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("t"))
    t = F.col("t")
    return rows.select("id", F.array_join(I.company_ids(t), "|").alias("empresas"), I.person_id(t).alias("pessoa"), I.invoice_key_of(t).alias("chave"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/csv' ELSE 'application/octet-stream' END AS mime FROM (SELECT c_custkey AS id FROM customer)""")
def file_kinds(spark, d):
    k = F.col("c_custkey")
    content = F.when(k % 4 == 0, F.lit(b"%PDF-1.7")).when(k % 4 == 1, F.unhex(F.lit("89504E470D0A"))).otherwise(F.lit(b"a,b"))
    name = F.concat(k.cast("string"), F.when(k % 4 == 2, ".CSV").otherwise(".bin"))
    return table(spark, d, "customer").select(k.alias("id"), I.mime_of(content, name).alias("mime"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size * 12 WHEN 1 THEN p_size WHEN 2 THEN CAST(floor(p_size / 30) AS INTEGER) END AS meses FROM part""")
def warranty_months(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("Garantia de "), n, F.lit(" anos"))).when(k % 4 == 1, F.concat(n, F.lit(" meses de garantia"))).when(k % 4 == 2, F.concat(n, F.lit(" dias"))).otherwise("sem prazo")
    return table(spark, d, "part").select(k.alias("id"), I.months_of(text).alias("meses"))


@query(f"""SELECT l_orderkey AS id, count(*) AS itens, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS {D}) AS total, CAST(0.5 AS DOUBLE) AS cobertura FROM lineitem GROUP BY 1""")
def receipt_recall(spark, d):
    br = "translate(format_number(l_extendedprice, 2), ',.', '.,')"
    line = F.expr(f"concat(lpad(l_partkey, 6, '0'), ' ITEM ', l_suppkey, ' ', cast(l_quantity as int), ' UN x 1,00 ', {br})")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.collect_list(line), "\n").alias("t"), (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) * 2).alias("pago"))
    read = rows.select(F.col("l_orderkey").alias("id"), "pago", I.receipt_items(F.col("t")).alias("i"))
    total = F.aggregate("i", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x["valor"]).cast("decimal(28,2)"))
    return read.select("id", F.size("i").cast("long").alias("itens"), total.alias("total"), I.recall(F.col("i"), F.col("pago")).alias("cobertura"))


@query(f"""{W}, s AS (SELECT identificador, CASE WHEN identificador % 2 = 0 THEN categoria END AS e, CASE WHEN identificador % 3 = 0 THEN CASE WHEN identificador % 9 = 0 THEN quem ELSE categoria END END AS o,
  CASE WHEN identificador % 5 = 0 THEN 'x' END AS h FROM ledger),
 t AS (SELECT CASE WHEN e = o THEN 'ok' WHEN e IS NOT NULL AND o IS NOT NULL THEN 'divergente' WHEN e IS NOT NULL THEN 'apenas_etl' WHEN o IS NOT NULL THEN 'apenas_opus' WHEN h IS NOT NULL THEN 'so_humano' ELSE 'vazio' END AS status FROM s)
 SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percentual FROM t GROUP BY 1""")
def field_parity(spark, d):
    k = F.col("identificador")
    rows = ledger(spark, d).select(F.when(k % 2 == 0, F.col("categoria")).alias("e"), F.when(k % 3 == 0, F.when(k % 9 == 0, F.col("quem")).otherwise(F.col("categoria"))).alias("o"), F.when(k % 5 == 0, "x").alias("h"))
    counts = rows.groupBy(I.field_status(F.col("e"), F.col("o"), F.col("h")).alias("status")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("percentual", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))  # six rows at most


@query("""WITH p AS (SELECT o_custkey AS id, array_agg(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1) SELECT id, len(k) >= 2 AS misto FROM p""")
def mixed_pages(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("k")).select("id", I.mixed_kinds(F.col("k")).alias("misto"))
