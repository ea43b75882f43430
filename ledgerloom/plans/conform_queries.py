"""Conforming, dedup levels, rules and tags over raw statement rows and overlapping books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import conform as C
from ledgerloom.functions import expressions as X
from ledgerloom.operators import ledger_ops as L
from ledgerloom.operators import rules as R
from ledgerloom.schema import DOUBTFUL, EXPENSE, INCOME, NEEDED, TAX, TRANSFER, TYPES

from .books import BOOKS_SQL, COLUMNS, COMPANIES, COUPLE, RAW_SQL, WORDS, books, raw
from .catalogue import query

W, B = f"WITH {RAW_SQL}", f"WITH {BOOKS_SQL}"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"translate({x}, '{X.ACCENTED}', '{X.PLAIN}')"


def couple_sql(t: str) -> str:
    names = [rf"regexp_matches({fold(f'upper({t})')}, '\b{C.quoted(n)}\b')" for n in COUPLE.names]
    ids = [i for i in ("".join(filter(str.isdigit, x)) for x in COUPLE.ids) if len(i) == 11]
    return "coalesce(" + " OR ".join(names + [f"contains(regexp_replace({t}, '[^0-9]', '', 'g'), '{i}')" for i in ids]) + ", FALSE)"


def variant_sql(t: str, bank: str) -> str:
    out = []
    for v in COUPLE.variants:
        hits = " + ".join(rf"CAST(regexp_matches({fold(f'upper({t})')}, '(^|\W){C.quoted(x)}(\W|\d|$)') AS INTEGER)" for x in v.tokens)
        part = f"{bank} IN ({', '.join(map(lit, v.banks))}) AND {hits} >= {v.least}"
        if v.markers:
            part += " AND (" + " OR ".join(f"contains({fold(f'upper({t})')}, '{m}')" for m in v.markers) + ")"
        out.append(part + (rf" AND regexp_matches({t}, '\d\d/\d\d')" if v.dated else ""))
    return "coalesce(" + " OR ".join(f"({x})" for x in out) + ", FALSE)"


TEXT = "trim(replace(descricao, '&amp;', '&'))"
LOCAL = rf"""coalesce(nullif(trim(regexp_extract(texto, '{C.SENT}', 1)), ''), nullif(trim(regexp_extract(texto, '{C.RECEIVED}', 1)), ''),
  CASE WHEN contains(texto, ' - Parcela ') THEN trim(split_part(texto, ' - Parcela ', 1)) END, trim(substring(texto, 1, 60)))"""
PERSON = f"""CASE WHEN banco_origem IN {C.FIRST} THEN 'pessoa_a' WHEN banco_origem IN {C.SECOND} OR arquivo LIKE '%/pj/%' OR arquivo LIKE '%/pf/%' THEN 'pessoa_b'
  WHEN banco_origem = 'Nubank' THEN 'pessoa_a' ELSE 'casal' END"""
METHOD = """CASE WHEN extrato = 'cartao' THEN 'Crédito' WHEN contains(upper(texto), 'PIX') THEN 'Pix' WHEN contains(upper(texto), 'DÉBITO') OR contains(upper(texto), 'DEBITO') THEN 'Débito'
  WHEN contains(upper(texto), 'BOLETO') THEN 'Boleto' WHEN contains(upper(texto), 'TED') OR contains(upper(texto), 'DOC') THEN 'Transferência' WHEN extrato = 'cc' THEN 'Débito' ELSE 'Crédito' END"""


def type_sql(bank: bool) -> str:
    own = couple_sql("texto") + (f" OR {variant_sql('texto', 'banco_origem')}" if bank else "")
    return f"""CASE WHEN {own} OR regexp_matches(upper(texto), '{C.OPERATIONAL}') THEN '{TRANSFER}' WHEN regexp_matches(upper(texto), '{C.TAXES}') THEN '{TAX}'
  WHEN sugerido IN {TYPES} THEN sugerido WHEN regexp_matches(upper(texto), '{C.EARNED}') THEN '{INCOME}' WHEN regexp_matches(upper(texto), '{C.CHARGED}') THEN '{EXPENSE}' WHEN valor > 0 THEN '{INCOME}' ELSE '{EXPENSE}' END"""


def canonical_sql(n: str) -> str:
    norm = f"trim({fold(f'upper({n})')})"
    out = "CASE " + " ".join(
        rf"WHEN contains({norm}, '{k}') THEN CASE WHEN {norm} = '{k}' THEN {lit(COMPANIES[k])} WHEN contains(upper({n}), '{k}') THEN regexp_replace({n}, '(?is)^(.*?){C.quoted(k)}(.*)$', '\1{COMPANIES[k]}\2') ELSE {lit(COMPANIES[k])} END"
        for k in sorted(COMPANIES, key=lambda k: (-len(k), k))
    ) + f" ELSE {n} END"
    for k in sorted(WORDS, key=lambda k: (-len(k), k)):
        out = rf"regexp_replace({out}, '(?i)\b{C.accented(k)}\b', '{WORDS[k]}', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\bSA\b', 'S/A', 'g'), '\bS\s+A\b', 'S/A', 'g')"
    return f"CASE WHEN regexp_matches({n}, '{C.TECHNICAL}') THEN {n} ELSE {out} END"


CONFORMED = rf"""texts AS (SELECT *, {TEXT} AS texto FROM raw), locals AS (SELECT *, {LOCAL} AS l FROM texts),
 conformed AS MATERIALIZED (SELECT coalesce(CAST(identificador AS VARCHAR), substring(sha256(strftime(data, '%Y-%m-%d') || '|' || lower(texto) || '|' || CAST(valor AS VARCHAR)), 1, 16)) AS identificador,
  data, strftime(data, '%Y-%m') AS mes_ref, abs(valor) AS valor, {METHOD} AS forma_pagamento, {canonical_sql('l')} AS local, {PERSON} AS quem, banco_origem,
  CASE WHEN virtual THEN '{TRANSFER}' ELSE {type_sql(False)} END AS tipo, texto AS descricao, virtual FROM locals)"""


def conformed(spark, d):
    return C.conform(raw(spark, d), COUPLE, COMPANIES, WORDS)


@query(f"{W}, {CONFORMED} SELECT * FROM conformed")
def conform_rows(spark, d):
    """P1 with P2, P4 to P7, P9 to P12."""
    return conformed(spark, d)


@query(f"{W}, texts AS (SELECT *, {TEXT} AS texto FROM raw) SELECT ordem, {type_sql(True)} AS tipo FROM texts")
def type_inference(spark, d):
    """Eight tests, short names asked as the bank is known."""
    rows = raw(spark, d).withColumn("texto", C.clean(F.col("descricao")))
    return rows.select("ordem", C.type_of(F.col("texto"), F.col("sugerido"), F.col("valor"), F.col("banco_origem"), COUPLE).alias("tipo"))


@query(f"{W}, texts AS (SELECT *, {TEXT} AS texto FROM raw) SELECT ordem, {LOCAL} AS local FROM texts")
def counterparty(spark, d):
    """P4."""
    return raw(spark, d).withColumn("texto", C.clean(F.col("descricao"))).select("ordem", C.counterparty(F.col("texto")).alias("local"))


@query(f"{W} SELECT ordem, {PERSON} AS quem, CASE WHEN arquivo LIKE '%/pj/%' THEN 'pj' WHEN arquivo LIKE '%/pf/%' THEN 'pf' END AS subtipo FROM raw")
def person_and_subtype(spark, d):
    """P5 and P6."""
    sub = C.subtype_of(F.col("arquivo"))
    return raw(spark, d).select("ordem", C.person_of(F.col("banco_origem"), sub).alias("quem"), sub.alias("subtipo"))


@query(f"{W} SELECT ordem, {couple_sql('descricao')} AS casal, {variant_sql('descricao', 'banco_origem')} AS variante FROM raw")
def couple_matchers(spark, d):
    """P7 and P8."""
    t = F.col("descricao")
    return raw(spark, d).select("ordem", C.of_couple(t, COUPLE).alias("casal"), C.of_variant(t, F.col("banco_origem"), COUPLE).alias("variante"))


@query(f"{W} SELECT ordem, {canonical_sql('descricao')} AS nome, regexp_matches(descricao, '{C.TECHNICAL}') AS tecnico FROM raw")
def canonical_names(spark, d):
    """P9 to P12."""
    t = F.col("descricao")
    return raw(spark, d).select("ordem", C.canonical_supplier(t, COMPANIES, WORDS).alias("nome"), C.is_technical(t).alias("tecnico"))


ORPHAN = f"tipo = '{TRANSFER}' AND NOT virtual AND NOT {couple_sql('descricao')} AND NOT regexp_matches(upper(descricao), '{C.KEPT_TRANSFER}')"


@query(f"""{W}, {CONFORMED} SELECT identificador, CASE WHEN {ORPHAN} THEN tipo END AS tipo_anterior, CASE WHEN {ORPHAN} THEN CASE WHEN valor > 0 THEN '{INCOME}' ELSE '{EXPENSE}' END ELSE tipo END AS tipo, valor FROM conformed""")
def demote_orphan_transfers(spark, d):
    """R8."""
    return C.demote_orphans(conformed(spark, d), COUPLE).select("identificador", "tipo_anterior", "tipo", "valor")


@query(f"""{W}, {CONFORMED} SELECT identificador, CASE WHEN tipo IN ('{INCOME}', '{EXPENSE}') AND banco_origem <> '' AND ({couple_sql('descricao')} OR {variant_sql('descricao', 'banco_origem')}) THEN '{TRANSFER}' ELSE tipo END AS tipo, valor FROM conformed""")
def promote_to_transfer(spark, d):
    """R9."""
    return C.promote_holders(conformed(spark, d), COUPLE).select("identificador", "tipo", "valor")


# ---- overlapping books: dedup levels

KEYED = "SELECT *, abs(valor) AS v, lower(trim(regexp_replace(coalesce(local, ''), '^.*? - ', ''))) AS t, CASE WHEN coalesce(banco_origem, '') IN ('', 'Histórico') THEN '_sem_banco' ELSE banco_origem END AS b, coalesce(nullif(descricao, ''), local) AS dito FROM {}"
COLS = ", ".join(COLUMNS)
ONCE = f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY identificador ORDER BY ordem) AS rn FROM {{}}) WHERE identificador IS NULL OR rn = 1"
NO_HISTORY = f"""SELECT {", ".join("h." + c for c in COLUMNS)} FROM ({KEYED}) h LEFT JOIN (SELECT DISTINCT data, v, t FROM ({KEYED}) WHERE b <> '_sem_banco' AND NOT virtual) r ON r.data = h.data AND r.v = h.v AND r.t = h.t
  WHERE r.v IS NULL OR b <> '_sem_banco' OR virtual"""
FUZZY = f"""SELECT {COLS} FROM (SELECT *, count(*) OVER (PARTITION BY data, v, t, b) AS n, max(CAST(virtual AS INTEGER)) OVER (PARTITION BY data, v, t, b) AS vv,
  row_number() OVER (PARTITION BY data, v, t, b ORDER BY CASE WHEN banco_origem = 'Histórico' THEN 1 ELSE 0 END, length(coalesce(dito, '')) DESC, ordem) AS rn FROM ({KEYED})) WHERE n = 1 OR vv = 1 OR rn = 1"""
SHEETS = f"""SELECT {COLS} FROM (SELECT *, max(CASE WHEN k AND lower(arquivo) LIKE '%.ofx' THEN 1 ELSE 0 END) OVER (PARTITION BY data, v, banco_origem, coalesce(quem, '')) AS a
  FROM (SELECT *, b <> '_sem_banco' AND NOT virtual AS k FROM ({KEYED}))) WHERE NOT (a = 1 AND k AND coalesce(regexp_matches(lower(arquivo), '\\.(xlsx|xls|csv)$'), FALSE))"""
PAIRS = f"""SELECT o.ordem AS saida, min(i.ordem) AS entrada FROM ({KEYED}) o JOIN ({KEYED}) i ON o.data = i.data AND o.v = i.v AND coalesce(o.quem, '') <> coalesce(i.quem, '')
  WHERE (o.tipo = '{EXPENSE}' OR o.tipo IS NULL) AND i.tipo IN ('{INCOME}', '{TRANSFER}') AND ({couple_sql('o.dito')} OR {couple_sql('i.dito')}) GROUP BY 1"""


def of(sql: str, table: str) -> str:
    return sql.replace("{}", table)


def _own():
    return C.of_couple(F.coalesce(F.nullif("descricao", F.lit("")), "local"), COUPLE)


@query(f"{B} SELECT ordem FROM ({of(NO_HISTORY, 'books')})")
def history_anti_join(spark, d):
    """Date, absolute value and key text; virtual rows on neither side."""
    return L.without_history(books(spark, d)).select("ordem")


@query(f"{B} SELECT ordem FROM ({of(SHEETS, 'books')})")
def paired_sources(spark, d):
    """Date, absolute value, bank and person."""
    return L.without_sheet_twins(books(spark, d)).select("ordem")


@query(f"{B} SELECT ordem, banco_origem FROM ({of(FUZZY, 'books')})")
def dedup_fuzzy_key(spark, d):
    """T7 with P13 and P14."""
    return L.dedup_fuzzy(books(spark, d)).select("ordem", "banco_origem")


@query(f"{B} {of(PAIRS, 'books')}")
def transfer_pairs(spark, d):
    """Other person, and a holder named on one side at least."""
    return L.mark_transfers(books(spark, d), _own()).filter("par is not null").select(F.col("ordem").alias("saida"), F.col("par").alias("entrada"))


@query(f"""{B} SELECT data, abs(valor) AS valor, least(count(*) FILTER (virtual), count(*) FILTER (NOT virtual)) AS pairs FROM books WHERE tipo = '{TRANSFER}' GROUP BY 1, 2
 HAVING least(count(*) FILTER (virtual), count(*) FILTER (NOT virtual)) > 0""")
def mirror_pairs(spark, d):
    """Per date and absolute value among transfers."""
    rows = books(spark, d).filter(F.col("tipo") == TRANSFER).withColumn("valor", F.abs("valor"))
    return L.mirror_pairs(rows, ["data", "valor"], F.col("virtual"))


MARKED = f"""marked AS (SELECT * REPLACE (CASE WHEN ordem IN (SELECT saida FROM pairs) OR ordem IN (SELECT entrada FROM pairs) THEN '{TRANSFER}' ELSE tipo END AS tipo) FROM once)"""


@query(f"""{B}, once AS ({of(ONCE, 'books')}), pairs AS ({of(PAIRS, 'once')}), {MARKED}, l1 AS ({of(NO_HISTORY, 'marked')}), l2 AS ({of(FUZZY, 'l1')}), l3 AS ({of(SHEETS, 'l2')}) SELECT ordem, tipo, banco_origem FROM l3""")
def dedup_levels(spark, d):
    """Identifiers, transfers, then history, equal keys and sheet twins."""
    return L.deduplicate(books(spark, d), _own()).select("ordem", "tipo", "banco_origem")


# ---- rules, tags and categories

OVERRIDES = [
    R.Override("maria silva", category="Família", class_=NEEDED, value="<250000"),
    R.Override("", kind=INCOME, category="Salário", bank="c6", value_min=100000, day_min=1, day_max=7, structural=True),
    R.Override("farmácia", category="Saúde", class_=NEEDED, tag="dedutivel_medico", bank=" itaú "),
]
RULES = [
    R.Rule(r"PADARIA|FARM[AÁ]CIA", category="Padaria", class_=DOUBTFUL, value="<150000"),
    R.Rule(r"PADARIA|FARM[AÁ]CIA", category="Aluguel", class_=NEEDED, value=">=150000"),
    R.Rule(r"DARF", kind=TAX, tag="imposto_pago"),
    R.Rule(r"JUROS|IOF", category="Juros", kind=EXPENSE),
    R.Rule(r"#0*1\d*$", category="Cliente um", class_="Supérfluo", value="sem valor"),
]
FIT_SQL = [
    "contains(up, 'MARIA SILVA') AND valor < 250000", "upper(trim(banco_origem)) = 'C6' AND valor >= 100000 AND day(data) >= 1 AND day(data) <= 7", "contains(up, 'FARMÁCIA') AND upper(trim(banco_origem)) = 'ITAÚ'",
    "regexp_matches(texto, '(?i)PADARIA|FARM[AÁ]CIA') AND valor < 150000", "regexp_matches(texto, '(?i)PADARIA|FARM[AÁ]CIA') AND valor >= 150000", "regexp_matches(texto, '(?i)DARF')",
    "regexp_matches(texto, '(?i)JUROS|IOF')", r"regexp_matches(texto, '(?i)#0*1\d*$')",
]


def _said(name: str) -> str:
    values = [getattr(e, name) for e in [*OVERRIDES, *RULES]]
    return "CASE regra " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values) if v) + " END"


CATEGORIZED = f"""{CONFORMED}, r1 AS (SELECT *, descricao || ' ' || local AS texto, upper(descricao || ' ' || local) AS up FROM conformed),
 r2 AS (SELECT *, CASE {' '.join(f'WHEN {c} THEN {i}' for i, c in enumerate(FIT_SQL))} END AS regra FROM r1),
 r3 AS (SELECT * REPLACE (coalesce({_said('kind')}, tipo) AS tipo), {_said('category')} AS c, {_said('class_')} AS s, {_said('tag')} AS tag_irpf FROM r2),
 r4 AS (SELECT *, CASE WHEN c IS NULL AND tipo = '{EXPENSE}' THEN '{DOUBTFUL}' WHEN tipo IN ('{EXPENSE}', '{TAX}') THEN s END AS s2 FROM r3),
 categorized AS MATERIALIZED (SELECT identificador, valor, tipo, tag_irpf, regra, coalesce(c, 'Outros') AS categoria, descricao, local, mes_ref,
  CASE WHEN tipo IN ('{INCOME}', '{TRANSFER}') THEN NULL WHEN s2 IS NOT NULL THEN s2 WHEN tipo = '{TAX}' THEN '{NEEDED}' ELSE '{DOUBTFUL}' END AS classificacao FROM r4)"""


def categorized(spark, d):
    none = F.lit(None).cast("string")
    rows = conformed(spark, d).withColumns({"categoria": none, "classificacao": none, "tag_irpf": none})
    return R.categorize(rows, OVERRIDES, RULES)


@query(f"{W}, {CATEGORIZED} SELECT identificador, valor, tipo, tag_irpf, regra, categoria, classificacao FROM categorized")
def categorize_rows(spark, d):
    """R1 to R3 with F6 and F7."""
    return categorized(spark, d).select("identificador", "valor", "tipo", "tag_irpf", "regra", "categoria", "classificacao")


@query(f"""{W}, {CATEGORIZED} SELECT count(*) AS total, count(*) FILTER (categoria <> 'Outros') AS categorizadas, round(count(*) FILTER (categoria <> 'Outros') * 100.0::DOUBLE / count(*), 4) AS cobertura FROM categorized""")
def category_coverage(spark, d):
    """R5."""
    return R.coverage(categorized(spark, d))


@query(f"""{W}, {CATEGORIZED} SELECT "local", count(*) AS n FROM categorized WHERE categoria = 'Outros' GROUP BY 1 HAVING count(*) >= 3""")
def new_patterns(spark, d):
    """R4."""
    return categorized(spark, d).filter("categoria = 'Outros'").groupBy("local").agg(F.count("*").alias("n")).filter("n >= 3")


TAGS = [(r"PAGTO.*SALARIO", "rendimento_tributavel"), (r"RESGATE", "rendimento_isento"), (r"DARF|DAS ", "imposto_pago"), (r"FARM[AÁ]CIA", "dedutivel_medico"), (r"TED \d", "transferencia")]
_TAG = "CASE " + " ".join(f"WHEN regexp_matches(descricao || ' ' || local, '(?i){p}') THEN '{t}' END" if i == len(TAGS) - 1 else f"WHEN regexp_matches(descricao || ' ' || local, '(?i){p}') THEN '{t}'" for i, (p, t) in enumerate(TAGS))
_IDENT = r"coalesce(nullif(regexp_extract(descricao || ' ' || local, '\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}'), ''), nullif(regexp_extract(descricao || ' ' || local, '\d{3}\.\d{3}\.\d{3}-\d{2}'), ''))"
TAGGED = f"{CATEGORIZED}, tagged AS MATERIALIZED (SELECT * REPLACE (coalesce(tag_irpf, {_TAG}) AS tag_irpf), {_IDENT} AS cnpj_cpf FROM categorized)"


def tagged(spark, d):
    return R.tagged(categorized(spark, d), TAGS)


@query(f"{W}, {TAGGED} SELECT identificador, valor, tag_irpf, cnpj_cpf FROM tagged")
def tax_tags(spark, d):
    """R6 and R7 with P15."""
    return tagged(spark, d).select("identificador", "valor", "tag_irpf", "cnpj_cpf")


@query(f"""{W}, {TAGGED} SELECT tag_irpf AS tag, mes_ref, valor, cnpj_cpf, "local" FROM tagged WHERE tag_irpf IS NOT NULL""")
def tax_events(spark, d):
    """What the tax sheet lists."""
    return tagged(spark, d).filter("tag_irpf is not null").select(F.col("tag_irpf").alias("tag"), "mes_ref", "valor", "cnpj_cpf", "local")


@query(f"""{W}, {TAGGED} SELECT tag_irpf AS tag, count(*) AS eventos, count(cnpj_cpf) AS com_id, round(count(cnpj_cpf) * 100.0::DOUBLE / count(*), 4) AS completude FROM tagged WHERE tag_irpf IS NOT NULL GROUP BY 1""")
def tax_completeness(spark, d):
    """E40, by tag."""
    out = tagged(spark, d).filter("tag_irpf is not null").groupBy(F.col("tag_irpf").alias("tag")).agg(F.count("*").alias("eventos"), F.count("cnpj_cpf").alias("com_id"))
    return out.withColumn("completude", F.round(F.col("com_id") * 100.0 / F.col("eventos"), 4))


EARNS, NOT_EARNED = r"SALARIO|RENDIMENTO", r"REEMBOLSO|ESTORNO|CASHBACK"


@query(f"""{W}, {CATEGORIZED} SELECT identificador, regexp_matches(descricao, '(?i){EARNS}') AS fonte_real FROM categorized WHERE tipo = '{INCOME}'""")
def income_sources(spark, d):
    """what the white list matches, whatever the black list says; else no."""
    rows = categorized(spark, d).filter(F.col("tipo") == INCOME)
    return rows.select("identificador", F.when(F.col("descricao").rlike("(?i)" + EARNS), True).when(F.col("descricao").rlike("(?i)" + NOT_EARNED), False).otherwise(False).alias("fonte_real"))
