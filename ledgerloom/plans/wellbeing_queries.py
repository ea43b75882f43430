"""Diaries, recaps, cycles, goals and reviews over events, and over fields that two readers filled in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import wellbeing as B

from .catalogue import query
from .ledger import ledger, table
from .ledger_queries import W

TODAY = "2024-01-28"
DAY = "CAST(ts AS DATE)"
DAILY = f"daily AS (SELECT user_id, {DAY} AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)"
RECENT = f"day BETWEEN DATE '{TODAY}' - {{}} AND DATE '{TODAY}'"


def events(spark, d):
    return table(spark, d, "events")


def daily(spark, d):
    return B.last_of_day(events(spark, d))


def kind(*names: str):
    return F.col("event_type").isin(*names)


@query(f"WITH {DAILY} SELECT * FROM daily")
def mood_last_of_day(spark, d):
    """W28."""
    return daily(spark, d)


@query(f"""WITH {DAILY} SELECT user_id, arg_min(day, (-value, day)) AS melhor, max(value) AS maximo, arg_min(day, (value, day)) AS pior, min(value) AS minimo FROM daily WHERE {RECENT.format(13)} GROUP BY 1""")
def best_and_worst_days(spark, d):
    """W9."""
    return B.best_and_worst(daily(spark, d), TODAY, 14)


@query(f"""WITH {DAILY}, g AS (SELECT user_id, CAST(DATE '{TODAY}' - CAST(i AS INTEGER) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events), range(0, 10) t(i)) SELECT g.user_id, g.day, value FROM g LEFT JOIN daily USING (user_id, day)""")
def series_of_days(spark, d):
    """Every user and each of the last days."""
    return B.series(daily(spark, d), events(spark, d), TODAY, 10)


@query(f"""WITH {DAILY} SELECT user_id, floor((2 * sum(CAST(round(value * 100) AS BIGINT)) FILTER ({RECENT.format(6)}) + count(value) FILTER ({RECENT.format(6)})) / nullif(2.0::DOUBLE * count(value) FILTER ({RECENT.format(6)}), 0)) / 100 AS media, count(*) FILTER ({RECENT.format(6)}) AS dias, count(*) AS total FROM daily GROUP BY 1""")
def mood_statistics(spark, d):
    """A43."""
    return B.statistics(daily(spark, d), TODAY, 7)


@query(f"""WITH {DAILY} SELECT user_id, round(avg(value) FILTER ({RECENT.format(13)}), 6) AS atual, round(avg(value) FILTER (day BETWEEN DATE '{TODAY}' - 27 AND DATE '{TODAY}' - 14), 6) AS anterior FROM daily GROUP BY 1""")
def comparable_windows(spark, d):
    """A window and the one before it."""
    return B.window_means(daily(spark, d), TODAY, 14)


@query(f"""WITH w AS (SELECT * FROM events WHERE {DAY} BETWEEN DATE '{TODAY}' - 13 AND DATE '{TODAY}'), k AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM w WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
 t AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS treinos, arg_min(event_type, (-n, event_type)) AS rotina, round(sum(s) / sum(n), 6) AS duracao FROM k GROUP BY 1),
 e AS (SELECT user_id, count(*) AS eventos, round(CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN count(*) FILTER (event_type = 'signup' AND value > 30) * 100.0::DOUBLE / count(*) FILTER (event_type = 'signup') END, 4) AS tarefas_pct FROM w GROUP BY 1)
 SELECT e.user_id, eventos, coalesce(treinos, 0) AS treinos, rotina, duracao, tarefas_pct FROM e LEFT JOIN t USING (user_id)""")
def recap(spark, d):
    """A44, A45, A47 and A48."""
    return B.recap(events(spark, d), TODAY, 14, kind("click", "view"), kind("signup"), F.col("value") > 30)


@query(f"""WITH x AS (SELECT user_id, {DAY} AS day, avg(value) AS v, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS n FROM events GROUP BY 1, 2)
 SELECT CASE WHEN p THEN 'positivo' WHEN n THEN 'negativo' ELSE 'neutro' END AS modo, round(avg(v), 6) AS media, count(*) AS dias FROM x GROUP BY 1""")
def mood_by_mode(spark, d):
    """A49."""
    return B.by_mode(events(spark, d), kind("purchase"), kind("error"))


@query(f"""WITH {DAILY}, t AS (SELECT DISTINCT user_id, {DAY} AS day FROM events WHERE event_type = 'click') SELECT t.day IS NOT NULL AS com, round(avg(value), 6) AS media, count(*) AS dias FROM daily LEFT JOIN t USING (user_id, day) GROUP BY 1""")
def mood_with_training(spark, d):
    """A51."""
    return B.with_and_without(daily(spark, d), events(spark, d).filter(kind("click")).select("user_id", F.to_date("ts").alias("day")))


_S = "(SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events WHERE event_type = '{}' GROUP BY 1)"


@query(f"""WITH a AS (SELECT strftime(day, '%Y-%m') AS mes, round(avg(value), 6) AS a FROM {_S.format('click')} WHERE day < DATE '2024-01-20' GROUP BY 1), b AS (SELECT strftime(day + 20, '%Y-%m') AS mes, round(avg(value), 6) AS b FROM {_S.format('view')} GROUP BY 1)
 SELECT coalesce(a.mes, b.mes) AS mes, a, b FROM a FULL JOIN b ON a.mes = b.mes""")
def monthly_measures(spark, d):
    """Months of either side."""
    e = events(spark, d)
    return B.monthly_outer(B.daily_series(e, kind("click")).filter("day < date'2024-01-20'"), B.daily_series(e, kind("view")).withColumn("day", F.date_add("day", 20)))


@query(f"""SELECT a.day, a.value AS a, b.n AS b FROM {_S.format('click')} a JOIN (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type = 'error' AND value > 20 GROUP BY 1) b ON a.day = b.day""")
def aligned_series(spark, d):
    """Daily mean of one, count of the other, days of both."""
    e = events(spark, d)
    return B.aligned(B.daily_series(e, kind("click")), B.daily_series(e, kind("error") & (F.col("value") > 20), "count"))


@query(f"""WITH s AS (SELECT user_id, max({DAY}) AS inicio FROM events WHERE event_type = 'signup' AND {DAY} <= DATE '2024-03-10' GROUP BY 1)
 SELECT user_id, inicio, CAST((DATE '2024-03-10' - inicio) % 28 + 1 AS INTEGER) AS dia, CAST(inicio + CAST((floor((DATE '2024-03-10' - inicio) / 28) + 1) * 28 AS INTEGER) AS DATE) AS proximo FROM s""")
def cycle_days(spark, d):
    """P36 and W29."""
    return B.cycle_day(events(spark, d).filter(kind("signup")).select("user_id", F.to_date("ts").alias("day")), "2024-03-10")


@query(f"SELECT user_id, least(count(*), 3) AS intensidade FROM events WHERE event_type IN ('error', 'view') AND {DAY} = DATE '{TODAY}' GROUP BY 1")
def symptom_intensity(spark, d):
    """E49."""
    return B.intensity(events(spark, d), TODAY, kind("error", "view"))


@query("""WITH w AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2) SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY week DESC) <= 3""")
def latest_weeks(spark, d):
    """Up to three weeks."""
    return B.latest_weeks(events(spark, d), 3)


@query(f"""WITH {DAILY}, s AS (SELECT user_id, floor((2 * sum(CAST(round(value * 100) AS BIGINT)) FILTER ({RECENT.format(6)}) + count(value) FILTER ({RECENT.format(6)})) / nullif(2.0::DOUBLE * count(value) FILTER ({RECENT.format(6)}), 0)) / 100 AS media, count(*) FILTER ({RECENT.format(6)}) AS dias, count(*) AS total FROM daily GROUP BY 1),
 h AS (SELECT user_id, list_filter([CASE WHEN media > 60 THEN 'semana boa' END, CASE WHEN media < 40 THEN 'semana difícil' END, CASE WHEN dias >= 5 THEN 'constante' END, CASE WHEN total >= 15 THEN 'fiel' END, CASE WHEN dias = 0 THEN 'ausente' END, CASE WHEN total > 0 THEN 'presente' END], lambda x: x IS NOT NULL)[1:3] AS l FROM s)
 SELECT user_id, CAST(i AS INTEGER) AS ordem, l[i] AS destaque FROM h, range(1, 4) t(i) WHERE i <= len(l)""")
def recap_highlights(spark, d):
    """The first of the rules that hold, in order."""
    s = B.statistics(daily(spark, d), TODAY, 7)
    m, n, t = F.col("media"), F.col("dias"), F.col("total")
    return B.highlights(s, [("semana boa", m > 60), ("semana difícil", m < 40), ("constante", n >= 5), ("fiel", t >= 15), ("ausente", n == 0), ("presente", t > 0)], 3)


# ---- goals and projections

GOALS = "SELECT c_custkey AS id, CAST(1000 + c_custkey % 50 * 100 AS DOUBLE) AS alvo, round(c_acctbal, 2) AS atual, CAST(DATE '2024-01-15' + CAST(c_custkey % 400 - 100 AS INTEGER) AS DATE) AS prazo, c_nationkey FROM customer"


def goal_rows(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), (1000 + k % 50 * 100).cast("double").alias("alvo"), F.round("c_acctbal", 2).alias("atual"), F.date_add(F.lit("2024-01-15").cast("date"), (k % 400 - 100).cast("int")).alias("prazo"), "c_nationkey")


@query(f"""WITH g AS ({GOALS}), m AS (SELECT *, (year(prazo) - 2024) * 12 + month(prazo) - 1 AS meses, greatest(0.0::DOUBLE, alvo - atual) AS f FROM g)
 SELECT id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, atual / alvo)), 9) AS progresso, round(f, 2) AS falta, CAST(meses AS INTEGER) AS meses, round(CASE WHEN meses > 0 THEN f / meses END, 6) AS ritmo FROM m""")
def goal_progress(spark, d):
    """E41 and E42."""
    return B.goals(goal_rows(spark, d), "2024-01-15")


@query(f"""WITH g AS ({GOALS}), m AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
 SELECT id, round(greatest(0.0::DOUBLE, atual * 100 - coalesce(s, 0)), 2) AS abertura, round(atual + coalesce(s, 0), 2) AS atualizado FROM g LEFT JOIN m ON o_custkey = id""")
def goal_balances(spark, d):
    """What a balance was before what moved since, and a goal's balance brought up to date."""
    moved = table(spark, d, "orders").filter("o_orderdate >= date'1998-01-01'").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    return goal_rows(spark, d).join(moved, "id", "left").select("id", F.round(B.opening_balance(F.col("atual") * 100, s), 2).alias("abertura"), F.round(F.col("atual") + s, 2).alias("atualizado"))


@query(f"""WITH g AS ({GOALS}) SELECT id, CAST(DATE '2024-01-15' + CAST(i AS INTEGER) * 30 AS DATE) AS dia, round(atual + alvo / 10 * i, 2) AS valor FROM g, range(1, 7) t(i)""")
def linear_projection(spark, d):
    """Steps of 30 days."""
    rows = goal_rows(spark, d).select("id", F.explode(B.linear_projection(F.col("atual"), F.col("alvo") / 10, 6, "2024-01-15")).alias("p"))
    return rows.select("id", "p.dia", "p.valor")


@query(f"""WITH g AS ({GOALS}), x AS (SELECT id, greatest(atual, 0.0::DOUBLE) AS v, alvo AS c, alvo * 6 AS ano FROM g), n AS (SELECT *, ceil(ln((ano * 25 * (0.06::DOUBLE / 12) + c) / (v * (0.06::DOUBLE / 12) + c)) / ln(1 + 0.06::DOUBLE / 12)) AS n FROM x)
 SELECT id, CAST(CASE WHEN v >= ano * 25 THEN 0 WHEN c > 0 AND n <= 1200 THEN n END AS INTEGER) AS mes FROM n""")
def independence(spark, d):
    """When the value reaches 25 yearly costs."""
    return goal_rows(spark, d).select("id", B.independence_month(F.greatest("atual", F.lit(0.0)), F.col("alvo"), 0.06, F.col("alvo") * 6).alias("mes"))


# ---- reviews of fields that two readers filled in

FIELD_SQL = f"""f AS (SELECT data || '' AS arquivo, 'campo' || (identificador % 7) AS campo, CASE WHEN identificador % 2 = 0 THEN categoria END AS etl,
  CASE WHEN identificador % 3 = 0 THEN CASE WHEN identificador % 9 = 0 THEN quem ELSE categoria END END AS opus, CASE WHEN identificador % 5 = 0 THEN 'x' END AS humano, banco_origem AS tipo, identificador FROM ledger)"""


def fields(spark, d):
    k = F.col("identificador")
    return ledger(spark, d).select(
        F.col("data").cast("string").alias("arquivo"), F.concat(F.lit("campo"), k % 7).alias("campo"), F.when(k % 2 == 0, F.col("categoria")).alias("etl"),
        F.when(k % 3 == 0, F.when(k % 9 == 0, F.col("quem")).otherwise(F.col("categoria"))).alias("opus"), F.when(k % 5 == 0, "x").alias("humano"), F.col("banco_origem").alias("tipo"), "identificador")


PARITY = """g AS (SELECT {key}, count(*) FILTER (etl IS NOT NULL OR opus IS NOT NULL) AS campos, count(*) FILTER (etl = opus) AS iguais, count(*) FILTER (etl <> opus) AS divergentes, count(*) FILTER ((etl IS NULL) <> (opus IS NULL)) AS de_um_lado,
  count(humano) AS h, count(*) FILTER (humano IS NOT NULL AND (etl IS NOT NULL OR opus IS NOT NULL)) AS hs FROM f GROUP BY 1),
 p AS (SELECT {key}, round(CASE WHEN campos > 0 THEN iguais * 100.0::DOUBLE / campos ELSE 0.0 END, 4) AS paridade, divergentes, de_um_lado, CASE WHEN h = 0 THEN 'nenhum' WHEN h = campos THEN 'completo' WHEN h = hs THEN 'parcial' ELSE 'alheio' END AS humano FROM g)"""


@query(f"{W}, {FIELD_SQL}, {PARITY.format(key='arquivo')} SELECT * FROM p")
def file_parity(spark, d):
    """A61 and E35."""
    return B.parity(fields(spark, d), "arquivo")


@query(f"{W}, {FIELD_SQL}, {PARITY.format(key='tipo')} SELECT round(avg(paridade), 4) AS paridade, count(*) FILTER (humano <> 'completo') AS aguardando, count(*) FILTER (paridade < 60) AS tipos_baixos, count(*) AS tipos FROM p")
def readiness_kpis(spark, d):
    """A65 and E36."""
    p = B.parity(fields(spark, d), "tipo")
    return p.agg(F.round(F.avg("paridade"), 4).alias("paridade"), F.count_if(F.col("humano") != "completo").alias("aguardando"), F.count_if(F.col("paridade") < 60).alias("tipos_baixos"), F.count("*").alias("tipos"))


MARKS = "k AS (SELECT tipo AS item, campo AS dimensao, CASE WHEN identificador % 4 = 0 THEN NULL ELSE identificador % 3 <> 0 END AS ok FROM f)"


def marks(spark, d):
    k = F.col("identificador")
    return fields(spark, d).select(F.col("tipo").alias("item"), F.col("campo").alias("dimensao"), F.when(k % 4 != 0, k % 3 != 0).alias("ok"))


@query(f"{W}, {FIELD_SQL}, {MARKS} SELECT item, count(ok) AS marcas, round(count(*) FILTER (ok) * 1.0::DOUBLE / count(ok), 6) AS fidelidade FROM k GROUP BY 1")
def review_fidelity(spark, d):
    """What is not applicable counts on neither side."""
    return B.fidelity_rate(marks(spark, d), "item")


@query(f"{W}, {FIELD_SQL}, {MARKS} SELECT dimensao, count(*) AS n FROM k WHERE NOT ok GROUP BY 1 HAVING count(*) >= 3")
def rejected_dimensions(spark, d):
    """A63."""
    return B.rejected_dimensions(marks(spark, d), 3)


DIFFS = """s AS (SELECT identificador, tipo, CASE WHEN identificador % 11 = 0 THEN NULL ELSE 1 END AS tem, list_filter([CASE WHEN etl IS DISTINCT FROM opus AND (etl IS NOT NULL OR opus IS NOT NULL) THEN 'categoria' END, CASE WHEN identificador % 5 = 0 THEN 'valor' END], lambda x: x IS NOT NULL) AS c FROM f),
 v AS (SELECT *, CASE WHEN tem IS NULL THEN 'INSUFICIENTE' WHEN len(c) = 0 THEN 'GRADUADO_OK' ELSE 'DIVERGENTE' END AS verdict FROM s)"""


def verdicts(spark, d):
    k = F.col("identificador")
    some = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    proof = some(F.create_map(F.lit("categoria"), F.col("etl"), F.lit("valor"), F.lit("1")))
    out = some(F.create_map(F.lit("categoria"), F.col("opus"), F.lit("valor"), F.when(k % 5 == 0, "2").otherwise("1")))
    rows = fields(spark, d).select("identificador", "tipo", proof.alias("prova"), F.when(k % 11 != 0, out).alias("saida"))
    rows = rows.withColumn("d", B.compare_maps(F.col("prova"), F.col("saida")))
    return rows.select("identificador", "tipo", F.array_join(F.transform("d", lambda x: x["campo"]), "|").alias("campos"), B.verdict(F.col("saida"), F.col("d")).alias("verdict"))


@query(f"{W}, {FIELD_SQL}, {DIFFS} SELECT identificador, verdict, array_to_string(c, '|') AS campos FROM v WHERE tem IS NOT NULL")
def proof_comparison(spark, d):
    """The fields in which a proof and an output differ, and the verdict."""
    return verdicts(spark, d).filter("verdict <> 'INSUFICIENTE'").select("identificador", "verdict", "campos")


@query(f"""{W}, {FIELD_SQL}, {DIFFS}, g AS (SELECT tipo, count(*) FILTER (verdict = 'GRADUADO_OK') AS ok, count(*) FILTER (verdict = 'DIVERGENTE') AS divergentes FROM v GROUP BY 1)
 SELECT *, CASE WHEN ok >= 2 AND divergentes > 0 THEN 'REGREDINDO' WHEN ok >= 2 THEN 'GRADUADO' WHEN ok = 1 THEN 'CALIBRANDO' ELSE 'PENDENTE' END AS estado FROM g""")
def type_graduation(spark, d):
    """E57."""
    return B.graduation(verdicts(spark, d), "tipo")
