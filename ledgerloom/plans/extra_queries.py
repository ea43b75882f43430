"""Accounts, calendars, searches, envelopes, packages and the remaining figures over the ledger, texts and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import analytics as A
from ledgerloom.operators import ledger_ops as L
from ledgerloom.operators import payments as Y
from ledgerloom.operators import text_ops as T
from ledgerloom.operators.finance import curves
from ledgerloom.schema import INCOME
from ledgerloom.sources import sinks
from ledgerloom.streaming import events_stream as E

from .catalogue import query
from .ledger import ledger, table
from .ledger_queries import D, SPENT, W

K = "identificador"
TODAY, MONTH = "1997-06-15", "1997-06"
ACCOUNTS = [("BUILDING", False), ("MACHINERY", True), ("er#00000001", False), ("er#0000000", True), ("nada", False)]


@query(f"""{W}, t AS (SELECT * REPLACE (CASE WHEN {K} % 3 = 0 THEN "local" || ' fatura' ELSE "local" END AS "local") FROM ledger),
 a AS (SELECT * FROM (VALUES ('BUILDING', FALSE), ('MACHINERY', TRUE), ('er#00000001', FALSE), ('er#0000000', TRUE), ('nada', FALSE)) v(conta, cartao)),
 h AS (SELECT conta, {K}, CASE WHEN categoria = conta THEN 'categoria' ELSE 'texto' END AS como FROM t, a WHERE (categoria = conta OR contains(lower("local"), lower(conta))) AND (NOT cartao OR contains(lower("local"), 'fatura')))
 SELECT conta, {K}, como FROM h WHERE como = 'categoria' OR conta NOT IN (SELECT conta FROM h WHERE como = 'categoria')""")
def account_rows(spark, d):
    """Category equality, else the text; cards need 'fatura'."""
    rows = ledger(spark, d).withColumn("local", F.when(F.col(K) % 3 == 0, F.concat("local", F.lit(" fatura"))).otherwise(F.col("local")))
    return Y.account_matches(rows, ACCOUNTS)


@query(f"""{W}, a AS (SELECT DISTINCT substring(c_name, 1, 18) AS conta FROM customer) SELECT conta, EXISTS (SELECT 1 FROM ledger WHERE mes_ref = '{MONTH}' AND {SPENT} AND contains(lower("local"), lower(substring(conta, 1, 10)))) AS paga FROM a""")
def paid_accounts(spark, d):
    """The first ten signs in the place of an expense of the month."""
    accounts = table(spark, d, "customer").select(F.substring("c_name", 1, 18).alias("conta"))
    return Y.paid_in_month(accounts, ledger(spark, d), MONTH)


@query(f"""{W} SELECT mes_ref, strftime(CAST(mes_ref || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS anterior, strftime(CAST(mes_ref || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') || '|' || strftime(CAST(mes_ref || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m') || '|' || strftime(CAST(mes_ref || '-01' AS DATE) - INTERVAL 3 MONTH, '%Y-%m') AS tres FROM (SELECT DISTINCT mes_ref FROM ledger)""")
def previous_months(spark, d):
    """W15."""
    rows = ledger(spark, d).select("mes_ref").distinct()
    return rows.select("mes_ref", F.get(Y.previous_months(F.col("mes_ref"), 1), F.lit(0)).alias("anterior"), F.array_join(Y.previous_months(F.col("mes_ref"), 3), "|").alias("tres"))


@query(f"""{W} SELECT row_number() OVER (ORDER BY data NULLS LAST, {K}) AS posicao, CASE WHEN {K} % 10 = 0 THEN 'SEM-' || {K} ELSE CAST({K} AS VARCHAR) END AS identificador FROM (SELECT {K}, CASE WHEN {K} % 17 = 0 THEN NULL ELSE data END AS data FROM ledger)""")
def sorted_rows(spark, d):
    """Place by date, and identifiers filled in."""
    k = F.col(K)
    rows = ledger(spark, d).select(F.when(k % 10 != 0, k).alias("identificador"), k.alias("ordem"), F.when(k % 17 != 0, F.col("data")).alias("data"))
    return Y.numbered(rows).select("posicao", "identificador")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def last_events(spark, d):
    """T2."""
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(15)


@query("""WITH u AS (SELECT p_partkey AS id, p_name AS texto, 0 AS f FROM part WHERE contains(lower(p_name), 'bl') UNION ALL SELECT p_partkey, p_brand, 1 FROM part WHERE contains(p_brand, '3') UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier)
 SELECT id, arg_min(texto, (f, texto)) AS texto, min(f) AS fonte FROM u GROUP BY 1""")
def merged_search(spark, d):
    """Each id once, from the first source."""
    p = table(spark, d, "part")
    parts = [p.filter(F.lower("p_name").contains("bl")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("texto")), p.filter(F.col("p_brand").contains("3")).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("texto")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("texto"))]
    return Y.merged_results(parts)


@query("""SELECT kind, id, name FROM (SELECT 'part' AS kind, CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'customer', c_custkey, c_name FROM customer) WHERE lower(name) LIKE '%er%'
 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) <= 50""")
def global_search_four(spark, d):
    """Four kinds of node, 50 of each."""
    out = None
    for kind, key, name in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name")):
        rows = table(spark, d, kind).filter(F.lower(name).contains("er")).orderBy(key).limit(50).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{W}, b AS (SELECT {K} AS bill, banco_origem AS conta, data AS vencimento, "local" FROM ledger WHERE {SPENT}), j AS (SELECT b.*, bill IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS e FROM b), s AS (SELECT conta, count(*) FILTER (e) * 1.0::DOUBLE / count(*) AS s FROM j GROUP BY 1)
 SELECT bill, conta, CASE WHEN CASE WHEN s >= 0.75 THEN e ELSE contains("local", '7') END THEN 'pago' WHEN vencimento < DATE '{TODAY}' THEN 'atrasado' ELSE 'pendente' END AS estado, CASE WHEN s >= 0.75 THEN 'grafo' ELSE 'texto' END AS fonte FROM j JOIN s USING (conta)""")
def bills_graph_first(spark, d):
    """The graph where it covers enough of an account, else the text; open bills by their due date."""
    bills = ledger(spark, d).filter(A.spent()).select(F.col(K).alias("bill"), F.col("banco_origem").alias("conta"), F.col("data").alias("vencimento"), "local")
    edges = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("bill"))
    return Y.graph_first(bills, edges, F.col("local").contains("7"), TODAY, 0.75)


@query(f"""{W} SELECT CAST(day(data) AS INTEGER) AS dia, CASE WHEN contains("local", '7') THEN 'energia' WHEN contains("local", '9') THEN 'agua' ELSE 'outros' END AS classe, data < DATE '{TODAY}' AND {K} % 3 <> 0 AS atrasado, count(*) AS n, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE mes_ref = '{MONTH}' GROUP BY 1, 2, 3""")
def payment_calendar(spark, d):
    """Class by keyword, past and unpaid is overdue."""
    return Y.month_calendar(ledger(spark, d).withColumn("pago", F.col(K) % 3 == 0), MONTH, TODAY, {"7": "energia", "9": "agua"})


@query(f"""{W}, f AS (SELECT 'in/' || {K} || '.pdf' AS path, CASE {K} % 4 WHEN 0 THEN 'nfe' WHEN 1 THEN 'boleto' END AS tipo, quem, data, {K} FROM ledger), t AS (SELECT path, CASE WHEN tipo IS NOT NULL THEN 'arquivo/' || quem || '/' || CASE tipo WHEN 'nfe' THEN 'notas' ELSE 'contas' END || '/' || year(data) || '/' || {K} || '.pdf' END AS destino FROM f)
 SELECT *, CASE WHEN destino IS NULL THEN 'conferir' ELSE 'mover' END AS acao FROM t""")
def routing_plan(spark, d):
    """A dry run."""
    k = F.col(K)
    files = ledger(spark, d).select(F.concat(F.lit("in/"), k.cast("string"), F.lit(".pdf")).alias("path"), F.when(k % 4 == 0, "nfe").when(k % 4 == 1, "boleto").alias("tipo"), F.col("quem").alias("pessoa"), "data")
    return Y.routing_plan(files, {"nfe": "notas", "boleto": "contas"})


@query(f"""{W}, p AS (SELECT {K}, CAST(1 AS INTEGER) AS pagina, CASE WHEN {K} % 3 = 0 THEN 'erro' ELSE 'nativa' END AS tipo FROM ledger UNION ALL SELECT {K}, 2, 'scan' FROM ledger WHERE {K} % 3 = 1) SELECT CAST({K} AS VARCHAR) AS path, pagina, tipo FROM p""")
def page_diagnosis(spark, d):
    """Pages of a text layer, native or scanned; a file without one is an error."""
    body = F.expr(f"if({K} % 3 = 0, null, concat(repeat(local, 5), if({K} % 3 = 1, concat(chr(12), ' x '), '')))")
    return Y.page_diagnosis(ledger(spark, d).select(F.col(K).cast("string").alias("path"), body.alias("content"))).select("path", "pagina", "tipo")


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, n AS nome FROM ledger, (VALUES ('a.pdf'), ('b.xml')) t(n) WHERE {K} % 4 < 3 AND (n = 'a.pdf' OR {K} % 2 = 0)""")
def mail_attachments(spark, d):
    """Mails nested too deep are not opened."""
    body = F.expr(f"""concat(repeat('Content-Type: message/rfc822\\n', cast({K} % 4 as int)), 'Content-Disposition: attachment; filename="a.pdf"\\n', if({K} % 2 = 0, 'content-disposition: ATTACHMENT; filename="b.xml"', ''))""")
    return Y.attachments(ledger(spark, d).select(F.col(K).cast("string").alias("path"), body.alias("content")))


@query(f"""{W} SELECT categoria AS tag, count(*) AS n, CAST(sum(valor) AS {D}) AS total FROM ledger WHERE tipo = 'Imposto' AND year(data) = 1997 GROUP BY 1""")
def tax_package(spark, d):
    """K9: totals as JSON, rows as CSV by tag, and the list of originals, written and read back."""
    rows = ledger(spark, d).filter((F.col("tipo") == "Imposto") & (F.year("data") == 1997))
    return sinks.tax_package(spark, rows.withColumn("tag", F.col("categoria")), sinks.shared_path(spark, "package"))


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS nota, CASE WHEN {K} % 10 = 0 THEN 'pessoal' WHEN {K} % 2 = 0 AND {K} % 3 = 0 THEN 'igual' WHEN {K} % 2 = 0 THEN 'mudou' ELSE 'nova' END AS acao FROM ledger""")
def vault_notes(spark, d):
    """Notes whose text is the same are not written again, and those without the marker never."""
    k = F.col(K)
    note = lambda df: df.select(k.cast("string").alias("nota"), F.concat_ws("\n", F.lit("# nota"), F.lit("sincronizado: true"), "local", F.when(k % 3 == 0, "x").otherwise(F.col("categoria"))).alias("texto"))
    old = ledger(spark, d).filter(k % 2 == 0).withColumn("categoria", F.lit("antes"))
    written = note(old).withColumn("texto", F.when(F.col("nota").cast("long") % 10 == 0, F.lit("minha nota")).otherwise(F.col("texto")))
    return sinks.note_actions(written, note(ledger(spark, d)), "sincronizado: true")


@query(f"""{W} SELECT {K}, valor FROM ledger""")
def restored_backup(spark, d):
    """Restored only if its checksum is what was written down."""
    path = sinks.shared_path(spark, "backup")
    checksum = sinks.backup(ledger(spark, d).select(K, "valor"), path)
    return sinks.restore(spark, path, checksum)


@query("""SELECT doc_id, (a < 40) OR (w < 3) OR (n > 100 AND n - a > n * 0.5) AS illegible, w AS known FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^A-Za-z0-9À-ÿ]', '', 'g')) AS a,
 CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'que') AS INTEGER) + CAST(contains(lower(text), 'der') AS INTEGER) + CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), 'est') AS INTEGER) AS w FROM documents)""")
def legibility_known(spark, d):
    """Few signs, few known words, or too many other signs."""
    known = X.known_words(F.col("text"), ("the", "que", "der", "and", "est"))
    return table(spark, d, "documents").select("doc_id", (X.illegible(F.col("text")) | (known < 3)).alias("illegible"), known.alias("known"))


@query("""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-zA-ZÀ-ÿ0-9]{2,}')) AS token FROM part), c AS (SELECT p_partkey, token, count(*) AS c FROM t GROUP BY 1, 2), l AS (SELECT p_partkey, sum(c) AS n FROM c GROUP BY 1),
 i AS (SELECT token, ln(CAST((SELECT count(*) FROM part) AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1), w AS (SELECT p_partkey, token, c / n * idf AS w FROM c JOIN l USING (p_partkey) JOIN i USING (token) WHERE idf > 0)
 SELECT p_partkey, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 9) AS w FROM w""")
def tfidf_weights(spark, d):
    """Unit vectors, tokens without weight dropped."""
    part = table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_brand"))
    terms = T.term_counts(part, "p_partkey", "t")
    return T.weights(terms, T.idf(terms, part.count()), "p_partkey").withColumn("w", F.round("w", 9))


@query(f"""{W}, r AS (SELECT *, CASE WHEN {K} % 7 = 0 THEN NULL ELSE categoria END AS c, CAST(length("local") > 17 AS INTEGER) + CAST(valor NOT BETWEEN 1000 AND 200000 AS INTEGER) + CAST(quem NOT IN ('ASIA', 'AFRICA', 'EUROPE') AS INTEGER) AS f FROM ledger)
 SELECT {K}, CASE WHEN c IS NULL THEN 'DESCONHECIDO' WHEN list_contains(string_split(lower("local"), '#'), '000000077') THEN 'ALTO' WHEN f = 0 THEN 'BAIXO' WHEN f = 1 THEN 'MEDIO' ELSE 'ALTO' END AS risco FROM r""")
def suggestion_risk(spark, d):
    """Forbidden tokens, then how many bounds fail."""
    rows = ledger(spark, d).withColumn("categoria", F.when(F.col(K) % 7 != 0, F.col("categoria"))).withColumn("texto", F.col("local"))
    rows = rows.withColumn("local", F.replace("local", F.lit("#"), F.lit(" ")))
    return rows.select(K, Y.domain_risk(rows, ["000000077"], 17, (1000, 200000), ["ASIA", "AFRICA", "EUROPE"]).alias("risco"))


@query(f"""{W}, t AS (SELECT DISTINCT {K}, unnest(string_split(lower("local"), '#')) AS token FROM ledger WHERE categoria IS DISTINCT FROM 'BUILDING') SELECT token, count(*) AS n, round(0.4 * least(count(*) / 10.0::DOUBLE, 1.0) + 0.6 * least(1 / 3.0::DOUBLE, 1.0), 6) AS confianca FROM t WHERE length(token) >= 4 GROUP BY 1 HAVING count(*) >= 3""")
def new_type_candidates(spark, d):
    """Tokens that files without a type share."""
    rows = ledger(spark, d).filter("categoria <> 'BUILDING'").select(K, F.explode(F.array_distinct(F.split(F.lower("local"), "#"))).alias("token"))
    g = rows.filter(F.length("token") >= 4).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3")
    return g.withColumn("confianca", F.round(0.4 * F.least(F.col("n") / 10.0, F.lit(1.0)) + 0.6 * F.least(F.lit(1 / 3.0), F.lit(1.0)), 6))


# ---- windows


@query(f"""{W}, m AS (SELECT mes_ref, isodow(data) - 1 AS dia, week(data) AS semana, sum(valor) AS v FROM ledger WHERE {SPENT} GROUP BY 1, 2, 3), k AS (SELECT mes_ref, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY 1), t AS (SELECT mes_ref FROM k ORDER BY n DESC, mes_ref LIMIT 1)
 SELECT CAST(dia AS INTEGER) AS dia, CAST(semana AS INTEGER) AS semana, CAST(v AS {D}) AS total FROM m WHERE mes_ref = (SELECT mes_ref FROM t)""")
def heatmap_of_mode_month(spark, d):
    """Weekday by ISO week of the most frequent month."""
    rows = ledger(spark, d).filter(A.spent())
    mode = rows.groupBy("mes_ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mes_ref").limit(1).select("mes_ref")
    return rows.join(F.broadcast(mode), "mes_ref", "left_semi").groupBy(F.weekday("data").alias("dia"), F.weekofyear("data").alias("semana")).agg(F.sum("valor").cast("decimal(28,2)").alias("total"))  # one month


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1, 2 HAVING avg(value) >= 40),
 r AS (SELECT user_id, max(day) AS last, count(*) AS n FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d) GROUP BY user_id, run) SELECT user_id, max(n) AS record, coalesce(max(n) FILTER (last = DATE '2024-01-30'), 0) AS current FROM r GROUP BY 1""")
def mood_streaks_30d(spark, d):
    """Record and current streak within 30 days; the current one ends today."""
    from ledgerloom.operators.events_ops import islands

    e = table(spark, d, "events").filter(F.to_date("ts").between("2024-01-01", "2024-01-30"))
    good = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m")).filter("m >= 40").select("user_id", "day")
    return islands(good).groupBy("user_id").agg(F.max("length").alias("record"), F.coalesce(F.max(F.when(F.col("last") == F.lit("2024-01-30").cast("date"), F.col("length"))), F.lit(0)).alias("current"))


_V = f"sum(CASE WHEN tipo = '{INCOME}' THEN valor ELSE -valor END)"


@query(f"{W}, s AS (SELECT data, {_V} AS v FROM ledger GROUP BY 1), c AS (SELECT data, CAST(sum(v) OVER (ORDER BY data) AS {D}) AS saldo FROM s) SELECT * FROM c ORDER BY data DESC LIMIT 90")
def balance_curve(spark, d):
    """Daily cumulative balance, its last 90 points."""
    days = L.signed(ledger(spark, d)).groupBy("data").agg(F.sum("valor_assinado").alias("v"))
    out = days.select("data", F.sum("v").over(Window.partitionBy(F.lit(1)).orderBy("data")).cast("decimal(28,2)").alias("saldo"))  # one row a day
    return out.orderBy(F.desc("data")).limit(90)


@query(f"{W}, s AS (SELECT banco_origem, data, {_V} AS v FROM ledger GROUP BY 1, 2) SELECT banco_origem, data, CAST(sum(v) OVER (PARTITION BY banco_origem ORDER BY data) AS {D}) AS saldo FROM s QUALIFY row_number() OVER (PARTITION BY banco_origem ORDER BY data DESC) <= 30")
def bank_sparklines(spark, d):
    """Cumulative balance by bank, the last 30 points of each."""
    days = L.signed(ledger(spark, d)).groupBy("banco_origem", "data").agg(F.sum("valor_assinado").alias("v"))
    w = Window.partitionBy("banco_origem")
    out = days.withColumns({"saldo": F.sum("v").over(w.orderBy("data")).cast("decimal(28,2)"), "rn": F.row_number().over(w.orderBy(F.desc("data")))})
    return out.filter("rn <= 30").select("banco_origem", "data", "saldo")


RATES = {"menos": 0.06, "base": 0.08, "mais": 0.10}


@query(" UNION ALL ".join(f"SELECT '{n}' AS cenario, CAST(m AS INTEGER) AS mes, round(5000.0::DOUBLE * pow(1 + {r!r}::DOUBLE / 12, m) + 250.0::DOUBLE * (pow(1 + {r!r}::DOUBLE / 12, m) - 1) / ({r!r}::DOUBLE / 12), 2) AS valor FROM range(0, 61, 12) t(m)" for n, r in RATES.items()))
def five_year_curves(spark, d):
    """Five years, two points of rate up and down, a point a year."""
    return curves(spark, 5000.0, 250.0, RATES, 60).filter("mes % 12 = 0")


@query(f"""WITH n AS (SELECT n_nationkey + 1 AS dia, 100 + n_nationkey AS v FROM nation), c AS (SELECT CAST(DATE '1997-02-20' + CAST(i AS INTEGER) AS DATE) AS d FROM range(0, 14) t(i)), s AS (SELECT d, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM c LEFT JOIN n ON dia = day(d) GROUP BY 1)
 SELECT d AS dia, total, CAST(sum(total) OVER (ORDER BY d) AS BIGINT) AS acumulado FROM s""")
def calendar_cumulative(spark, d):
    """What falls due on each of 14 days, and all up to then; days that a month lacks are dropped."""
    terms = table(spark, d, "nation").groupBy((F.col("n_nationkey") + 1).alias("dia")).agg(F.sum(100 + F.col("n_nationkey")).alias("v"))
    days = spark.sql("select explode(sequence(date'1997-02-20', date'1997-03-05')) as d")
    s = days.join(terms, F.dayofmonth("d") == F.col("dia"), "left").select(F.col("d").alias("dia"), F.coalesce("v", F.lit(0)).cast("long").alias("total"))
    return s.withColumn("acumulado", F.sum("total").over(Window.partitionBy(F.lit(1)).orderBy("dia")))  # 14 rows


@query(f"""{W} SELECT banco, count(*) AS n FROM (SELECT CASE WHEN {K} % 40 = 0 THEN lower(banco_origem) ELSE banco_origem END AS banco FROM ledger) WHERE banco NOT IN (SELECT n_name FROM nation) GROUP BY 1""")
def bank_domain(spark, d):
    """Q8: rows of banks that are not in the list."""
    rows = ledger(spark, d).select(F.when(F.col(K) % 40 == 0, F.lower("banco_origem")).otherwise(F.col("banco_origem")).alias("banco"))
    return rows.groupBy("banco").agg(F.count("*").alias("n")).join(table(spark, d, "nation").select(F.col("n_name").alias("banco")), "banco", "left_anti")


@query(f"""{W} SELECT {K}, data AS primeira FROM ledger WHERE {K} % 3 <> 2 UNION ALL SELECT {K}, NULL FROM ledger WHERE {K} % 3 = 2""")
def first_dates(spark, d):
    """The first plausible date of a text."""
    t = F.expr(f"if({K} % 3 = 2, 'sem 31/02/1997', concat('99/99/1999 e ', date_format(data, 'dd/MM/yyyy'), ' 01/01/2001'))")
    return ledger(spark, d).select(K, X.first_date_br(t).alias("primeira"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, min(day) AS first, count(*) AS n FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d) GROUP BY user_id, run)
 SELECT user_id, CAST(min(first + 6) AS DATE) AS day FROM r WHERE n >= 7 GROUP BY 1""")
def stream_first_runs(spark, d):
    """W3 as a stream with a state for each user."""
    return E.first_runs(E.source(spark, f"{d}/events*.parquet"), table(spark, d, "events"), 7)


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY AS late FROM events")
def late_events(spark, d):
    """Late rows of a batch go to a side table."""
    e = table(spark, d, "events")
    on_time, late = E.split_late(e, e, 20)
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(f"""{W}, r AS (SELECT data, quem, valor FROM ledger WHERE {K} % 5 = 0), a AS (SELECT l.{K}, l.quem, l.data, max(r.data) AS d FROM ledger l JOIN r ON r.quem = l.quem AND r.data < l.data GROUP BY 1, 2, 3) SELECT {K}, CAST(a.d AS DATE) AS anterior FROM a""")
def asof_rate(spark, d):
    """As-of join: the latest earlier day of a person's own series, without joining pairs."""
    rows = ledger(spark, d).select(K, "quem", "data", (F.col(K) % 5 == 0).alias("r"))
    days = rows.groupBy("quem", "data").agg(F.bool_or("r").alias("r"))  # one row a day and person
    w = Window.partitionBy("quem").orderBy("data").rowsBetween(Window.unboundedPreceding, -1)
    before = days.withColumn("anterior", F.max(F.when(F.col("r"), F.col("data"))).over(w))
    return rows.join(before.select("quem", "data", "anterior"), ["quem", "data"]).filter("anterior is not null").select(K, "anterior")


@query("""SELECT 'ambos' AS lado, name FROM (SELECT c_mktsegment AS name FROM customer WHERE c_nationkey < 12 INTERSECT SELECT c_mktsegment FROM customer WHERE c_nationkey >= 12) UNION ALL SELECT 'so_pedidos', CAST(k AS VARCHAR) FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def set_operations(spark, d):
    """INTERSECT and EXCEPT."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    both = c.filter("c_nationkey < 12").select(F.col("c_mktsegment").alias("name")).intersect(c.filter("c_nationkey >= 12").select("c_mktsegment"))
    only = o.select(F.col("o_custkey").alias("k")).subtract(c.filter("c_custkey % 2 = 0").select("c_custkey"))
    return both.select(F.lit("ambos").alias("lado"), "name").unionByName(only.select(F.lit("so_pedidos").alias("lado"), F.col("k").cast("string").alias("name")))
