"""Sources, sinks and streams: rows written in a foreign format and read back, and streams against the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.schema import EXPENSE, INCOME
from ledgerloom.sources import sinks, statements as S
from ledgerloom.streaming import events_stream as E
from ledgerloom.streaming import merge as M

from .catalogue import query
from .ledger import ledger, table
from .ledger_queries import D, W

_BR = "translate(format_number(valor, 2), ',.', '.,')"


def _as_text(spark, d, line: str, head: str = "", foot: str = ""):
    """(path, content): texts of a bank and month, with a sorted line for each ledger row of a range of ids, so that no text grows with the data."""
    part = F.floor(F.col("identificador") / 1_000_000).alias("part")
    rows = ledger(spark, d).select(F.concat_ws(" ", "banco_origem", "mes_ref").alias("path"), part, F.struct("identificador", F.expr(line).alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort("xs"), lambda x: x["line"]), "\n")
    return rows.groupBy("path", "part").agg(F.collect_list("x").alias("xs")).select("path", F.concat(F.lit(head), body, F.lit(foot)).alias("content"))


@query(f"""{W} SELECT data, "local", valor, CASE WHEN identificador % 10 = 0 THEN '{INCOME}' ELSE '{EXPENSE}' END AS tipo
 FROM (SELECT * REPLACE (CASE WHEN identificador % 10 = 0 THEN 'Estorno ' || "local" ELSE "local" END AS "local") FROM ledger WHERE identificador % 11 <> 0)""")
def csv_card_round_trip(spark, d):
    path = sinks.shared_path(spark, "card")
    k = F.col("identificador")
    rows = ledger(spark, d).select(
        F.when(k % 11 == 0, "bad date").otherwise(F.col("data").cast("string")).alias("date"),
        F.when(k % 10 == 0, F.concat(F.lit("Estorno "), "local")).otherwise(F.col("local")).alias("title"), (-F.col("valor")).cast("string").alias("amount"))
    rows.write.option("header", True).csv(path)
    return S.read_card_csv(spark, path)


@query(f"""{W} SELECT data, CASE WHEN tipo = '{INCOME}' THEN valor ELSE -valor END AS valor, CAST(identificador AS VARCHAR) AS identificador, "local" || ' & ' || categoria AS descricao,
 CASE WHEN tipo = '{INCOME}' THEN '{INCOME}' ELSE '{EXPENSE}' END AS tipo FROM ledger""")
def csv_account_round_trip(spark, d):
    path = sinks.shared_path(spark, "account")
    ledger(spark, d).select(
        F.date_format("data", "dd/MM/yyyy").alias("Data"), F.when(F.col("tipo") == INCOME, F.col("valor")).otherwise(-F.col("valor")).alias("Valor"),
        F.col("identificador").alias("Identificador"), F.concat("local", F.lit(" &amp; "), "categoria").alias("Descrição")).write.option("header", True).csv(path)
    return S.read_account_csv(spark, path)


@query(f"""{W} SELECT 'BANCO ' || substring(banco_origem, 1, 1) AS banco_origem, data, -valor AS valor, CASE WHEN identificador % 10 = 0 THEN categoria ELSE "local" END AS descricao,
 CAST(identificador AS VARCHAR) AS identificador, '{EXPENSE}' AS tipo FROM ledger WHERE substring(banco_origem, 1, 1) = 'A'
 UNION ALL SELECT 'Outro', data, -valor, CASE WHEN identificador % 10 = 0 THEN categoria ELSE "local" END, CAST(identificador AS VARCHAR), '{EXPENSE}' FROM ledger
 WHERE substring(banco_origem, 1, 1) <> 'A'""")
def ofx_parse(spark, d):
    line = """concat('<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>', date_format(data, 'yyyyMMdd'), '120000<TRNAMT>-', valor, '<FITID>', identificador,
      if(identificador % 10 = 0, concat('<NAME>', categoria), concat('<NAME>x<MEMO>', local)), '</STMTTRN>')"""
    files = _as_text(spark, d, line)
    files = files.select("path", F.concat(F.lit("OFXHEADER:100\n<OFX><FI><ORG>Bank "), F.substring("path", 1, 1), F.lit("</FI>\n"), "content", F.lit("</OFX>")).alias("content"))
    return S.parse_ofx(files, {"bank a": "BANCO A"})


@query(f"""{W} SELECT banco_origem || ' ' || mes_ref AS path, data, "local", valor FROM ledger WHERE identificador % 3 <> 0""")
def statement_text_parse(spark, d):
    line = f"concat(date_format(data, 'dd/MM/yyyy'), '  ', if(identificador % 3 = 0, 'SALDO DO DIA', local), '   ', {_BR})"
    return S.parse_statement_text(_as_text(spark, d, line)).drop("n")


@query(f"""{W} SELECT banco_origem || ' ' || mes_ref AS path, make_date(CASE WHEN month(data) <= 6 THEN 2000 ELSE 1999 END, month(data), day(data)) AS data, "local",
 CASE WHEN identificador % 2 = 0 THEN '02/10' END AS parcela, valor FROM ledger WHERE NOT (month(data) = 2 AND day(data) = 29)""")
def card_bill_parse(spark, d):
    line = f"concat(if(month(data) = 2 and day(data) = 29, 'x ', ''), date_format(data, 'dd/MM'), ' ', local, if(identificador % 2 = 0, ' 02/10', ''), ' ', {_BR})"
    files = _as_text(spark, d, line, head="01/01 BEFORE 1,00\nDETALHE\n", foot="\nRESUMO\n01/01 AFTER 2,00")
    return S.parse_card_bill(files.withColumn("vencimento", F.lit("2000-06-10").cast("date")), "DETALHE", "RESUMO").drop("n")


@query(f"""{W} SELECT CAST(identificador AS VARCHAR) AS path, CASE WHEN identificador % 2 = 0 THEN lpad(CAST(identificador AS VARCHAR), 33, '1') || lpad(CAST(CAST(valor * 100 AS BIGINT) AS VARCHAR), 14, '0') END AS linha_digitavel,
 CASE WHEN identificador % 3 = 0 OR identificador % 2 = 0 THEN valor END AS valor, data AS vencimento FROM ledger""")
def boleto_parse(spark, d):
    digits = "concat(lpad(identificador, 33, '1'), lpad(cast(valor * 100 as bigint), 14, '0'))"
    text = f"concat('Vencimento: ', date_format(data, 'dd/MM/yyyy'), if(identificador % 3 = 0, concat('\\nValor do documento R$ ', {_BR}), ''), if(identificador % 2 = 0, concat('\\n', {digits}), ''))"
    files = ledger(spark, d).select(F.col("identificador").cast("string").alias("path"), F.expr(text).alias("content"))
    return S.parse_boleto(files)


@query(f"""{W} SELECT '{EXPENSE}' AS tag, count(*) AS quantidade, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE tipo = '{EXPENSE}' UNION ALL
 SELECT '{INCOME}', count(*), CAST(sum(valor) AS {D}) FROM ledger WHERE tipo = '{INCOME}'""")
def csv_by_tag(spark, d):
    path = sinks.shared_path(spark, "tags")
    rows = ledger(spark, d).select("identificador", "data", "valor", F.when(F.col("tipo").isin(EXPENSE, INCOME), F.col("tipo")).alias("tag"))
    sinks.write_by_tag(rows, "tag", path)
    back = spark.read.schema("identificador long, data date, valor decimal(18,2), tag string").option("header", True).csv(path)
    return sinks.tag_summary(back, "tag")


@query(f"""{W} SELECT identificador, CAST(CASE WHEN identificador % 3 = 0 THEN valor + 1 ELSE valor END AS DECIMAL(18,2)) AS valor, CASE WHEN identificador % 2 = 0 THEN 'ok' END AS marca FROM ledger
 WHERE identificador % 2 = 0 OR identificador % 3 = 0""")
def validation_upsert(spark, d):
    rows = ledger(spark, d).select("identificador", "valor")
    old = rows.filter("identificador % 2 = 0").withColumn("marca", F.lit("ok"))
    new = rows.filter("identificador % 3 = 0").select("identificador", (F.col("valor") + 1).cast("decimal(18,2)").alias("valor"), F.lit(None).cast("string").alias("marca"))
    return sinks.upsert(old, new, ["identificador"], ["marca"])


def _stream(spark, d):
    return E.source(spark, f"{d}/events*.parquet")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_distinct(spark, d):
    return E.distinct_events(_stream(spark, d))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS semana, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS total FROM events GROUP BY 1, 2")
def stream_weekly(spark, d):
    return E.weekly(_stream(spark, d), _events(spark, d))


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) - CAST(i AS INTEGER) AS desde FROM events, range(0, 7) t(i))
 SELECT user_id, CAST(desde AS DATE) AS desde, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3""")
def stream_busy_windows(spark, d):
    return E.busy_windows(_stream(spark, d), _events(spark, d))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 DAY THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT user_id, CAST(min(ts) AS DATE) AS desde, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return E.sessions(_stream(spark, d), _events(spark, d))


@query("SELECT user_id, event_type, max(ts) AS ts, CASE WHEN user_id % 3 = 0 THEN 'visto' END AS marca FROM events GROUP BY 1, 2 UNION ALL SELECT c_custkey + 1000000000, 'sem evento', NULL, 'visto' FROM customer")
def stream_upsert(spark, d):
    """Micro-batches merged into a table by key; what people marked stays, whatever is run again."""
    path = sinks.shared_path(spark, "merged")
    table = M.MergedTable(spark, path, "user_id long, event_type string, ts timestamp, marca string", ["user_id", "event_type"], ["marca"])
    events = _events(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("marca"))
    marked = events.filter("user_id % 3 = 0").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts")).withColumn("marca", F.lit("visto"))
    customers = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 1000000000).alias("user_id"), F.lit("sem evento").alias("event_type"), F.lit(None).cast("timestamp").alias("ts"), F.lit("visto").alias("marca"))
    table.apply(marked.unionByName(customers), 0, "ts")
    # the stream's batches come after the table's first one; each keeps the latest row of a key
    rows = _stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "event_type", "ts", F.lit(None).cast("string").alias("marca"))
    return M.merged(rows, table, "ts", f"{path}/state", first=1)


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 1000 DAY AS late FROM events")
def stream_routed(spark, d):
    """Events in time and late ones in two tables of one stream; a first delivery knows no later events."""
    path = sinks.shared_path(spark, "routed")
    in_time, late = M.routed(_stream(spark, d), path, f"{path}/state", 45)
    return in_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))
