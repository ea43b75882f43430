"""Diaries, recaps, cycles, goals and reviews over (user_id, ts, event_type, value) events and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_of(column: str = "ts") -> Column:
    return F.to_date(column)


def within(day: Column, today: str, days: int) -> Column:
    """Is the day among the last ``days`` days up to today?"""
    end = F.lit(today).cast("date")
    return day.between(F.date_sub(end, days - 1), end)


def last_of_day(events: DataFrame) -> DataFrame:
    """The last value of each user and day."""
    return events.groupBy("user_id", day_of().alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def best_and_worst(daily: DataFrame, today: str, days: int) -> DataFrame:
    """Best and worst day of each user in the window, the earliest among equals."""
    rows = daily.filter(within(F.col("day"), today, days))
    return rows.groupBy("user_id").agg(
        F.min_by("day", F.struct((-F.col("value")).alias("v"), "day")).alias("melhor"), F.max("value").alias("maximo"), F.min_by("day", F.struct("value", "day")).alias("pior"), F.min("value").alias("minimo"))


def series(daily: DataFrame, users: DataFrame, today: str, days: int) -> DataFrame:
    """(user_id, day, value) for every user and each of the last days; null where there is nothing."""
    end = F.lit(today).cast("date")
    grid = users.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    return grid.join(daily.select("user_id", "day", "value"), ["user_id", "day"], "left")


def statistics(daily: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Mean of the last days (two places), days in them, and days in all, by user."""
    recent = within(F.col("day"), today, days)
    cents, n = F.sum(F.when(recent, F.round(F.col("value") * 100).cast("bigint"))), F.count(F.when(recent, F.col("value")))
    mean = F.when(n > 0, F.floor((2 * cents + n) / (2 * n)) / 100)  # halves go up, in whole hundredths
    return daily.groupBy("user_id").agg(mean.alias("media"), F.count_if(recent).alias("dias"), F.count("*").alias("total"))


def window_means(daily: DataFrame, today: str, days: int) -> DataFrame:
    """Mean of the last days and of as many days before them, null where a window is empty."""
    end = F.lit(today).cast("date")
    before = F.col("day").between(F.date_sub(end, 2 * days - 1), F.date_sub(end, days))
    return daily.groupBy("user_id").agg(F.round(F.avg(F.when(within(F.col("day"), today, days), F.col("value"))), 6).alias("atual"), F.round(F.avg(F.when(before, F.col("value"))), 6).alias("anterior"))


def recap(events: DataFrame, today: str, days: int, training: Column, task: Column, done: Column) -> DataFrame:
    """Key figures of a window by user: events, trainings, their most frequent kind and mean value, tasks done in percent."""
    rows = events.filter(within(day_of(), today, days))
    kinds = rows.filter(training).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    kinds = kinds.groupBy("user_id").agg(
        F.sum("n").alias("treinos"), F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("rotina"), F.round(F.sum("s") / F.sum("n"), 6).alias("duracao"))
    tasks = rows.groupBy("user_id").agg(F.count("*").alias("eventos"), F.round(F.when(F.count_if(task) > 0, F.count_if(task & done) * 100.0 / F.count_if(task)), 4).alias("tarefas_pct"))
    return tasks.join(kinds, "user_id", "left").select("user_id", "eventos", F.coalesce("treinos", F.lit(0)).alias("treinos"), "rotina", "duracao", "tarefas_pct")


def by_mode(events: DataFrame, positive: Column, negative: Column) -> DataFrame:
    """Mean of users' daily values by the day's mode; positive beats negative, days without either are neutral."""
    daily = events.groupBy("user_id", day_of().alias("day")).agg(F.avg("value").alias("v"), F.bool_or(positive).alias("p"), F.bool_or(negative).alias("n"))
    mode = F.when(F.col("p"), "positivo").when(F.col("n"), "negativo").otherwise("neutro")
    return daily.groupBy(mode.alias("modo")).agg(F.round(F.avg("v"), 6).alias("media"), F.count("*").alias("dias"))


def with_and_without(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Mean of daily values on days that ``days`` (user_id, day) has and on others."""
    marked = daily.join(days.select("user_id", "day").distinct().withColumn("com", F.lit(True)), ["user_id", "day"], "left")
    return marked.groupBy(F.coalesce("com", F.lit(False)).alias("com")).agg(F.round(F.avg("value"), 6).alias("media"), F.count("*").alias("dias"))


def monthly_outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Monthly means of two series (day, value), months of either."""
    mean = lambda df, n: df.groupBy(F.date_format("day", "yyyy-MM").alias("mes")).agg(F.round(F.avg("value"), 6).alias(n))
    return mean(a, "a").join(mean(b, "b"), "mes", "full")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days of both series (day, value)."""
    return a.select("day", F.col("value").alias("a")).join(b.select("day", F.col("value").alias("b")), "day")


def daily_series(events: DataFrame, chosen: Column, how: str = "mean") -> DataFrame:
    """(day, value): mean or count of the chosen events by day."""
    agg = F.round(F.avg("value"), 6) if how == "mean" else F.count("*").cast("double")
    return events.filter(chosen).groupBy(day_of().alias("day")).agg(agg.alias("value"))


def cycle_day(starts: DataFrame, today: str, length: int = 28) -> DataFrame:
    """Day of the cycle (1 to ``length``, again from 1 after it) and next start, by user; ``starts`` has (user_id, day)."""
    end = F.lit(today).cast("date")
    last = starts.filter(F.col("day") <= end).groupBy("user_id").agg(F.max("day").alias("inicio"))
    return last.select("user_id", "inicio", (F.pmod(F.datediff(end, "inicio"), F.lit(length)) + 1).cast("int").alias("dia"), F.date_add("inicio", ((F.floor(F.datediff(end, "inicio") / length) + 1) * length).cast("int")).alias("proximo"))


def intensity(events: DataFrame, today: str, symptom: Column, most: int = 3) -> DataFrame:
    """min(3, symptoms of today) by user."""
    return events.filter(symptom & (day_of() == F.lit(today).cast("date"))).groupBy("user_id").agg(F.least(F.count("*"), F.lit(most)).alias("intensidade"))


def latest_weeks(events: DataFrame, n: int) -> DataFrame:
    """The latest item of each of a user's last n ISO weeks with items."""
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    w = Window.partitionBy("user_id").orderBy(F.desc("week"))
    rows = events.groupBy("user_id", week.alias("week")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("user_id", "week", "event_id")


def highlights(stats: DataFrame, rules: list[tuple[str, Column]], most: int = 5) -> DataFrame:
    """(user_id, ordem, destaque): the first rules, in their order, that hold for a user."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return stats.select("user_id", F.posexplode(F.slice(hit, 1, most)).alias("p", "destaque")).select("user_id", (F.col("p") + 1).alias("ordem"), "destaque")


def goals(rows: DataFrame, today: str) -> DataFrame:
    """Progress (at most 1), missing amount, months left and needed monthly pace of goals (id, alvo, atual, prazo)."""
    end = F.lit(today).cast("date")
    progress = F.when(F.col("alvo") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("atual") / F.col("alvo")))).otherwise(0.0)
    months = (F.year("prazo") - F.year(end)) * 12 + F.month("prazo") - F.month(end)
    missing = F.greatest(F.lit(0.0), F.col("alvo") - F.col("atual"))
    return rows.select("id", F.round(progress, 9).alias("progresso"), F.round(missing, 2).alias("falta"), months.cast("int").alias("meses"), F.round(F.when(months > 0, missing / months), 6).alias("ritmo"))


def linear_projection(balance: Column, monthly: Column, steps: int, today: str) -> Column:
    """array<struct<dia, valor>>: the balance after each of so many steps of 30 days."""
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct(F.date_add(F.lit(today).cast("date"), i * 30).alias("dia"), F.round(balance + monthly * i, 2).alias("valor")))


def independence_month(start: Column, monthly: Column, rate: float, yearly_cost: Column, factor: float = 25, limit: int = 1200) -> Column:
    """The first month in which the compounded value reaches ``factor`` yearly costs, in closed form; null beyond the limit."""
    i, goal = rate / 12, yearly_cost * factor
    n = F.ceil(F.log((goal * i + monthly) / (start * i + monthly)) / F.log(F.lit(1 + i)))
    return F.when(start >= goal, 0).when((monthly > 0) & (n <= limit), n).cast("int")


def opening_balance(now: Column, moved: Column) -> Column:
    """What a balance was before what moved since, floored at 0."""
    return F.greatest(F.lit(0.0), now - moved)


# ---- reviews


def fidelity_rate(marks: DataFrame, key: str) -> DataFrame:
    """Share of marks (key, dimensao, ok) that are true among those that are not null."""
    return marks.groupBy(key).agg(F.count("ok").alias("marcas"), F.round(F.when(F.count("ok") > 0, F.count_if(F.col("ok")) / F.count("ok")), 6).alias("fidelidade"))


def rejected_dimensions(marks: DataFrame, least: int) -> DataFrame:
    """Dimensions rejected at least so often, the most frequent first, then by name."""
    return marks.filter(~F.col("ok")).groupBy("dimensao").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def compare_maps(proof: Column, output: Column) -> Column:
    """array<struct<campo, prova, saida>> of the fields in which two maps differ, by name."""
    both = F.map_zip_with(F.coalesce(proof, F.create_map().cast("map<string,string>")), F.coalesce(output, F.create_map().cast("map<string,string>")), lambda k, a, b: F.struct(a.alias("prova"), b.alias("saida"), a.eqNullSafe(b).alias("igual")))
    entries = F.filter(F.map_entries(both), lambda e: ~e["value"]["igual"])
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("campo"), e["value"]["prova"].alias("prova"), e["value"]["saida"].alias("saida"))))


def verdict(output: Column, differences: Column) -> Column:
    return F.when(output.isNull(), "INSUFICIENTE").when(F.size(differences) == 0, "GRADUADO_OK").otherwise("DIVERGENTE")


def graduation(samples: DataFrame, key: str) -> DataFrame:
    """State of each type from its samples (key, verdict): two that agree graduate it, active divergences set it back."""
    g = samples.groupBy(key).agg(F.count_if(F.col("verdict") == "GRADUADO_OK").alias("ok"), F.count_if(F.col("verdict") == "DIVERGENTE").alias("divergentes"))
    state = F.when((F.col("ok") >= 2) & (F.col("divergentes") > 0), "REGREDINDO").when(F.col("ok") >= 2, "GRADUADO").when(F.col("ok") == 1, "CALIBRANDO").otherwise("PENDENTE")
    return g.withColumn("estado", state)


def parity(fields: DataFrame, key: str) -> DataFrame:
    """Percent of agreeing fields of a file, its divergent and one-sided fields, and whether people filled in a subset of it.

    ``fields`` has (key, campo, etl, opus, humano).
    """
    a, b, h = F.col("etl"), F.col("opus"), F.col("humano")
    said, both = a.isNotNull() | b.isNotNull(), a.isNotNull() & b.isNotNull()
    g = fields.groupBy(key).agg(
        F.count_if(said).alias("campos"), F.count_if(both & (a == b)).alias("iguais"), F.count_if(both & (a != b)).alias("divergentes"), F.count_if(said & ~both).alias("de_um_lado"),
        F.count("humano").alias("h"), F.count_if(h.isNotNull() & said).alias("hs"))
    human = F.when(F.col("h") == 0, "nenhum").when(F.col("h") == F.col("campos"), "completo").when(F.col("h") == F.col("hs"), "parcial").otherwise("alheio")
    return g.select(key, F.round(F.when(F.col("campos") > 0, F.col("iguais") * 100.0 / F.col("campos")).otherwise(0.0), 4).alias("paridade"), "divergentes", "de_um_lado", human.alias("humano"))
