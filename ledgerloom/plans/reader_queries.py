"""Document texts written from the tables, read again, and sheets and caches written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import identifiers as I  # noqa: E741
from ledgerloom.operators import intake as N
from ledgerloom.schema import EXPENSE, INCOME, TAX, TRANSFER
from ledgerloom.sources import documents as R
from ledgerloom.sources import sinks, statements

from .books import COUPLE
from .catalogue import query
from .conform_queries import couple_sql
from .ledger import ledger, table
from .ledger_queries import D, SPENT, W

K = "identificador"
BR = "translate(format_number({}, 2), ',.', '.,')"


def text(spark, d, expr: str, *keep: str, spread: bool = False):
    """(path, content, ...): one text for each ledger row; ``spread`` where parsing them takes longer than a shuffle of the rows."""
    rows = ledger(spark, d)
    rows = rows.repartition(8 * spark.sparkContext.defaultParallelism, K) if spread else rows  # a small file is one task else
    return rows.select(F.col(K).cast("string").alias("path"), F.expr(expr).alias("content"), *keep)


# ---- statements


@query(f"""{W} SELECT {K}, CASE WHEN {K} % 3 = 0 THEN valor WHEN {K} % 3 = 1 THEN CAST(-valor AS DECIMAL(18,2)) END AS valor FROM ledger WHERE {K} % 3 < 2""")
def account_columns(spark, d):
    """Entry and exit columns; rows without either go."""
    k = F.col(K)
    rows = ledger(spark, d).select(K, F.when(k % 3 == 0, F.col("valor")).otherwise(F.lit(0).cast("decimal(18,2)")).alias("entrada"), F.when(k % 3 == 1, F.col("valor")).alias("saida"))
    return rows.select(K, R.account_value(F.col("entrada"), F.col("saida")).cast("decimal(18,2)").alias("valor")).filter("valor is not null")


ACCOUNT = [(r"SALARIO|PAGTO SAL", INCOME), (r"FATURA", TRANSFER), (r"\bCDB\b|RDB", TRANSFER)]
STATEMENT = [(r"FATURA", TRANSFER), (r"SALARIO", INCOME), (r"REND(IMENTO)?\b", INCOME), (r"DARF|DAS\b", TAX)]
LINE = f"CASE {K} % 8 WHEN 0 THEN 'PAGTO SALARIO FATURA' WHEN 1 THEN 'PGTO FATURA CARTAO' WHEN 2 THEN 'CDB resgate' WHEN 3 THEN 'PIX Maria Silva Souza' WHEN 4 THEN 'DARF 0220' WHEN 5 THEN 'REND PAGO APLIC' WHEN 6 THEN 'PIX Maria Silva Souza SALARIO' ELSE local END"
SIGNED = f"CASE WHEN {K} % 2 = 0 THEN valor ELSE -valor END"


@query(f"""{W}, t AS (SELECT {K}, {LINE} AS t, {SIGNED} AS v FROM ledger) SELECT {K},
 CASE WHEN regexp_matches(t, '(?i)SALARIO|PAGTO SAL') THEN '{INCOME}' WHEN regexp_matches(t, '(?i)FATURA') THEN '{TRANSFER}' WHEN regexp_matches(t, '(?i)\\bCDB\\b|RDB') THEN '{TRANSFER}' WHEN {couple_sql('t')} THEN '{TRANSFER}' WHEN regexp_matches(t, '(?i)DARF|DAS\\b') THEN '{TAX}' WHEN v > 0 THEN '{INCOME}' ELSE '{EXPENSE}' END AS conta,
 CASE WHEN {couple_sql('t')} THEN '{TRANSFER}' WHEN regexp_matches(t, '(?i)FATURA') THEN '{TRANSFER}' WHEN regexp_matches(t, '(?i)SALARIO') THEN '{INCOME}' WHEN regexp_matches(t, '(?i)REND(IMENTO)?\\b') THEN '{INCOME}' WHEN regexp_matches(t, '(?i)DARF|DAS\\b') THEN '{TAX}' WHEN v > 0 THEN '{INCOME}' ELSE '{EXPENSE}' END AS extrato,
 CASE WHEN {couple_sql('t')} THEN '{TRANSFER}' WHEN regexp_matches(t, '(?i)estorno') THEN '{INCOME}' ELSE '{EXPENSE}' END AS cartao FROM t""")
def statement_types(spark, d):
    """The order of tests of an account, a statement and a card."""
    t, v = F.col("t"), F.col("v")
    rows = ledger(spark, d).select(K, F.expr(LINE).alias("t"), F.expr(SIGNED).alias("v"))
    card = R.typed(t, F.lit(-1), COUPLE, [("estorno", INCOME)], 0)
    return rows.select(K, R.typed(t, v, COUPLE, [*ACCOUNT, (r"DARF|DAS\b", TAX)], 3).alias("conta"), R.typed(t, v, COUPLE, STATEMENT, 0).alias("extrato"), card.alias("cartao"))


@query(f"""{W}, t AS (SELECT {K}, CASE WHEN {K} % 4 = 0 THEN valor WHEN {K} % 4 = 1 THEN CAST(round(CAST(valor * 5.25 AS DECIMAL(20,4)), 2) AS DECIMAL(18,2)) WHEN {K} % 4 = 2 THEN valor ELSE 0.00 END AS valor, {K} % 20 = 0 AS p FROM ledger)
 SELECT {K}, CAST(valor AS DECIMAL(18,2)) AS valor, CASE WHEN p THEN '{TRANSFER}' ELSE '{EXPENSE}' END AS tipo, FALSE AS virtual FROM t UNION ALL SELECT {K}, CAST(valor AS DECIMAL(18,2)), '{TRANSFER}', TRUE FROM t WHERE p""")
def card_sheet(spark, d):
    """Own currency, else the foreign one by its rate, else as it is; payments get a mirror."""
    k, v, none = F.col(K), F.col("valor"), F.lit(None).cast("decimal(18,2)")
    value = R.card_value(F.when(k % 4 == 0, v).otherwise(none), F.when((k % 4 == 1) | (k % 4 == 2), v), F.when(k % 4 == 1, F.lit("5.25").cast("decimal(4,2)")))
    rows = ledger(spark, d).select(K, value.alias("valor"))
    return R.mirrors(rows, k % 20 == 0).select(K, "valor", "tipo", "virtual")


@query(f"""{W} SELECT {K}, '05/03' AS dia, 'LOJA A' AS texto, '02/10' AS parcela, 'BRL' AS moeda, valor FROM ledger WHERE {K} % 3 = 0 UNION ALL SELECT {K}, '06/03', 'SHOP B', NULL, 'USD', valor FROM ledger WHERE {K} % 2 = 0 UNION ALL SELECT {K}, '07/03', 'BAR C', NULL, 'BRL', 12.50 FROM ledger""")
def bill_lines(spark, d):
    """Several entries in a line, each taken once."""
    v = BR.format("valor")
    line = f"concat(if({K} % 3 = 0, concat('05/03 LOJA A 02/10 ', {v}, ' '), ''), if({K} % 2 = 0, concat('06/03 SHOP B US$ ', {v}, ' '), ''), '07/03 BAR C 12,50')"
    rows = ledger(spark, d).select(K, F.explode(R.bill_line(F.expr(line))).alias("x"))
    return rows.select(K, "x.dia", "x.texto", "x.parcela", "x.moeda", "x.valor")


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, CAST(month(data) AS INTEGER) AS mes, CAST(year(data) AS INTEGER) AS ano, CAST(CASE WHEN {K} % 3 = 0 THEN 0 ELSE {K} % 900 + 100 END AS INTEGER) AS kwh, valor FROM ledger UNION ALL SELECT CAST({K} AS VARCHAR), 1, 2020, 55, 10.00 FROM ledger WHERE {K} % 2 = 0""")
def energy_bills(spark, d):
    """Blocks of a screenshot's text."""
    body = f"concat('lixo\\nMês\\n', date_format(data, 'MM/yyyy'), if({K} % 3 = 0, '', concat('\\nConsumo\\n', {K} % 900 + 100, ' kWh')), '\\nValor\\nR$ ', {BR.format('valor')}, if({K} % 2 = 0, '\\nMês\\n01/2020\\n55 KWH\\nR$ 10,00', '\\nMês\\nsem nada'))"
    return R.energy_blocks(text(spark, d, body))


# ---- invoices


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, n AS nota, CAST({K} AS VARCHAR) AS numero, data, CASE WHEN n = 1 THEN valor ELSE 7.50 END AS total FROM ledger, (VALUES (1), (2)) t(n) WHERE {K} % 5 <> 0 OR n = 1""")
def consumer_invoices(spark, d):
    """Several invoices in a text; a part without two of the three markers is none."""
    part = lambda total: f"concat('NFC-e N ', {K}, ' Serie 1\\nCONSUMIDOR CPF\\n', date_format(data, 'dd/MM/yyyy'), ' 10:00\\nVALOR TOTAL R$ ', {total}, '\\n')"
    body = f"concat('cabeçalho\\n', {part(BR.format('valor'))}, if({K} % 5 <> 0, {part("'7,50'")}, 'NFC-e N 1\\nnada\\n'))"
    rows = R.split_invoices(text(spark, d, body), r"NFC-e N")
    first = rows.select("path", "nota", *R.invoice_head(F.col("content")))
    return first.select("path", "nota", "numero", "data", "total")


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, CAST(i AS INTEGER) AS item, '78900' || lpad(CAST(i AS VARCHAR), 3, '0') AS codigo, CASE WHEN i = 2 THEN 'LEITE INTEGRAL DE CAIXA' ELSE 'PAO ' || categoria END AS descricao, CAST(CASE WHEN i = 2 THEN 1.5 ELSE {K} % 9 + 1 END AS DECIMAL(18,3)) AS qtde, valor FROM ledger, (VALUES (1), (2), (3)) t(i) WHERE i < 3 OR {K} % 2 = 0""")
def consumer_items(spark, d):
    """Item lines, and lines that go on with the text of the one before."""
    v = BR.format("valor")
    body = f"concat('ITENS\\n78900001 PAO ', categoria, ' ', {K} % 9 + 1, ' UN 1,00 ', {v}, '\\n  78900002 LEITE INTEGRAL 1,5 L 2,00 ', {v}, '\\nDE CAIXA\\n', if({K} % 2 = 0, concat('78900003 PAO ', categoria, ' ', {K} % 9 + 1, ' UN 1,00 ', {v}, '\\n'), ''), 'QTD. TOTAL DE ITENS 3')"
    return R.invoice_items(text(spark, d, body).withColumn("nota", F.lit(1))).drop("nota")


KEY = "35240112345678000190550010000000011123456789"
NFE = """concat('<nfeProc xmlns="http://example.org/nfe"><!-- <vNF>1.00</vNF> --><NFe><infNFe Id="NFe', {key}, '"><ide><dhEmi>', data, 'T10:00:00</dhEmi></ide><emit><xNome>', if(identificador % 2 = 0, concat('<![CDATA[', local, ']]>'), local), ' &amp; <!-- x -->Cia</xNome></emit><det nItem="1"><prod><cProd>A</cProd><xProd>', categoria, '</xProd><vProd>', valor, '</vProd></prod><imposto><ICMS><ICMS00><vICMS>1.50</vICMS></ICMS00></ICMS><PIS><PISAliq><vPIS>0.25</vPIS></PISAliq></PIS></imposto></det><det nItem="2"><prod><cProd>B</cProd><vProd>2.00</vProd></prod></det><total><ICMSTot><vNF>', valor + 2, '</vNF></ICMSTot></total></infNFe></NFe><protNFe><infProt><cStat>', if(identificador % 7 = 0, '101', '100'), '</cStat></infProt></protNFe></nfeProc>')"""


def _key() -> str:
    body = KEY[:43]
    rest = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(body))) % 11
    return body + str(0 if rest < 2 else 11 - rest)


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, '{_key()}' AS chave, '12345678000190' AS cnpj_emitente, "local" || ' & Cia' AS razao_social, data AS data_emissao, CAST(valor + 2 AS DECIMAL(18,2)) AS total, {K} % 7 = 0 AS cancelada FROM ledger WHERE {K} % 5 <> 0""")
def xml_invoices(spark, d):
    """Keys with a wrong digit are no invoices; cancelled ones are marked."""
    bad = _key()[:43] + str((int(_key()[43]) + 1) % 10)
    return statements.parse_nfe(text(spark, d, NFE.format(key=f"if({K} % 5 = 0, '{bad}', '{_key()}')"), spread=True))


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, 1 AS item, 'A' AS codigo, categoria AS descricao, valor AS valor_total, 1.50 AS icms, 0.00 AS ipi, 0.25 AS pis, 0.00 AS cofins FROM ledger UNION ALL SELECT CAST({K} AS VARCHAR), 2, 'B', NULL, 2.00, 0.00, 0.00, 0.00, 0.00 FROM ledger""")
def xml_items(spark, d):
    """Four taxes at any depth, each item by itself."""
    return statements.parse_nfe_items(text(spark, d, NFE.format(key=f"'{_key()}'"), spread=True)).drop("qtde")


LAYOUTS = [
    ("aluguel", r"recibo de aluguel", {"valor": r"valor:? R\$ ([\d.,]+)", "pagador": r"de: (\w+)", "data": r"em (\d{2}/\d{2}/\d{4})"}),
    ("servico", r"prestação de serviço", {"valor": r"R\$ ([\d.,]+)", "pagador": r"cliente: (\w+)"}), ("generico", r"recibo", {"valor": r"([\d.]+,\d{2})"}),
]


@query(f"""{W} SELECT {K}, CASE {K} % 4 WHEN 0 THEN 'aluguel' WHEN 1 THEN 'servico' WHEN 2 THEN 'generico' END AS layout, round(CASE {K} % 4 WHEN 0 THEN 2.0::DOUBLE / 3 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.0 END, 4) AS confianca, CASE WHEN {K} % 4 < 3 THEN valor END AS valor, CASE WHEN {K} % 4 = 0 THEN quem END AS pagador FROM (SELECT * REPLACE (split_part(quem, ' ', 1) AS quem) FROM ledger)""")
def receipts(spark, d):
    """The first layout whose mark the text holds, and how much of it was found."""
    v = BR.format("valor")
    body = f"case {K} % 4 when 0 then concat('RECIBO DE ALUGUEL valor R$ ', {v}, ' de: ', quem) when 1 then concat('recibo de prestação de serviço R$ ', {v}) when 2 then concat('Recibo ', {v}) else 'nota' end"
    rows = ledger(spark, d).select(K, F.expr(body).alias("content"))
    name, share, found = R.receipt_layout(F.col("content"), LAYOUTS)
    return rows.select(K, name.alias("layout"), share.alias("confianca"), statements.parse_br(found["valor"]).alias("valor"), found["pagador"].alias("pagador"))


# ---- payslips, tax, health


@query(f"""{W}, p AS (SELECT CAST({K} AS VARCHAR) AS path, strftime(data, '%Y-%m') AS mes_ref, CASE WHEN {K} % 3 = 1 THEN '13º Integral' ELSE 'Folha Mensal' END AS tipo, CAST(valor + 100 AS {D}) AS bruto, CAST(50.25 AS {D}) AS inss, CAST(CASE WHEN {K} % 2 = 0 THEN 10.50 ELSE 0 END AS {D}) AS irrf, CAST(30 AS {D}) AS vr_va, valor, {K} % 4 = 0 AS dito FROM ledger WHERE {K} % 6 <> 0)
 SELECT path, mes_ref, tipo, bruto, inss, irrf, vr_va, CASE WHEN dito THEN CAST(valor AS {D}) ELSE CAST(bruto - inss - irrf - vr_va AS {D}) END AS liquido FROM p""")
def payslips(spark, d):
    """Texts without a month and downloaded copies are left out; net falls back to gross less deductions."""
    v = BR.format("valor")
    body = f"concat(if({K} % 6 = 0, 'Referência: ?\\n', concat('Referência: ', date_format(data, 'MM/yyyy'), '\\n')), 'P Salario ', {v}, '\\nP ', if({K} % 3 = 1, '13 Salario Integral', 'Adicional'), ' 100,00\\nD INSS folha 50,25\\n', if({K} % 2 = 0, 'D irrf 10,50\\n', ''), 'D Vale Alimentação 30,00\\n', if({K} % 4 = 0, concat('Líquido: ', {v}), 'fim'))"
    files = text(spark, d, body)
    copies = files.withColumn("path", F.concat("path", F.lit(" (1).pdf")))
    return R.payslip(R.without_copies(files.unionByName(copies)))


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, '07.20.' || {K} AS numero, data AS vencimento, CAST(valor + 10 AS {D}) AS principal, CAST(1.50 AS {D}) AS multa, CAST(0.75 AS {D}) AS juros, CAST(valor + 12.25 AS {D}) AS total, CASE WHEN {K} % 2 = 0 THEN 1 ELSE 2 END AS meses FROM ledger WHERE {K} % 9 <> 0""")
def tax_slips(spark, d):
    """Composition, totals and distinct months."""
    v = BR.format("valor")
    body = f"concat(if({K} % 9 = 0, 'outro', 'Documento de Arrecadação do Simples'), '\\nNúmero: 07.20.', {K}, '\\nVencimento: ', date_format(data, 'dd/MM/yyyy'), '\\n1001 IRPJ SIMPLES 01/2024 ', {v}, ' 1,00 0,50\\n1002 CSLL ', if({K} % 2 = 0, '01/2024', '02/2024'), ' 10,00 0,50 0,25\\n')"
    return R.tax_slip(text(spark, d, body))


@query(f"""{W} SELECT CAST({K} AS VARCHAR) || CASE WHEN {K} % 2 = 0 THEN '-RETIF.DEC' ELSE '.DEC' END AS path, '2024' AS exercicio, '2023' AS ano_base, lpad(CAST({K} AS VARCHAR), 11, '0') AS cpf, "local" AS nome, 'DIRPF|' || lpad(CAST({K} AS VARCHAR), 11, '0') || '|2023' || CASE WHEN {K} % 2 = 0 THEN '_RETIF' ELSE '' END AS chave, {K} % 2 = 0 AS retificadora FROM ledger WHERE {K} % 10 <> 0""")
def tax_returns(spark, d):
    """Fields at fixed places; without a name there is no return."""
    body = f"concat('IRPF    202420233000', lpad({K}, 11, '0'), rpad(if({K} % 10 = 0, ' ', local), 60, ' '), 'resto')"
    files = text(spark, d, body)
    return R.tax_return(files.withColumn("path", F.concat("path", F.when(F.col("path").cast("long") % 2 == 0, "-RETIF.DEC").otherwise(".DEC"))))


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, CAST({K} % 90000 + 1000 AS VARCHAR) AS registro, data, CAST(CASE WHEN {K} % 2 = 0 THEN 6 ELSE 1 END AS INTEGER) AS meses, m AS medicamento, CASE m WHEN 'Novalgina 500mg' THEN 'dipirona' END AS principio FROM ledger, (VALUES ('Novalgina 500mg'), ('Desconhecido 10mg')) t(m) WHERE {K} % 7 <> 0""")
def prescriptions(spark, d):
    """One row a medicine, its active ingredient by the catalogue."""
    body = f"concat(if({K} % 7 = 0, 'sem', concat('CRM ', {K} % 90000 + 1000)), '\\nData ', date_format(data, 'dd/MM/yyyy'), if({K} % 2 = 0, '\\nValidade 6 meses', ''), '\\n1) Novalgina 500mg\\n2. Desconhecido 10mg\\n')"
    return R.prescription(text(spark, d, body), {"novalgina": "dipirona", "tylenol": "paracetamol"})


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, CAST(CASE WHEN {K} % 2 = 0 THEN 24 ELSE 3 END AS INTEGER) AS meses, data AS inicio, CASE WHEN {K} % 3 = 0 THEN 'fabricante' ELSE 'varejo' END AS origem, CAST(data + to_months(CASE WHEN {K} % 2 = 0 THEN 24 ELSE 3 END) AS DATE) AS fim FROM ledger WHERE {K} % 5 <> 0""")
def warranties(spark, d):
    """Months, who stands for them, until when."""
    body = f"concat(if({K} % 5 = 0, 'nota', 'Termo de GARANTIA'), if({K} % 3 = 0, ' do fabricante', ''), '\\n', date_format(data, 'dd/MM/yyyy'), '\\nprazo de ', if({K} % 2 = 0, '2 anos', '90 dias'))"
    return R.warranty(text(spark, d, body))


@query(f"""{W} SELECT CAST({K} AS VARCHAR) AS path, CAST({K} AS VARCHAR) AS bilhete, valor AS premio, strftime(data, '%d/%m/%Y') AS vigencia FROM ledger UNION ALL SELECT CAST({K} AS VARCHAR), '9', 5.00, NULL FROM ledger WHERE {K} % 2 = 0""")
def warranty_policies(spark, d):
    """Several bills in a text, two of three markers each."""
    body = f"concat('x BILHETE Nº ', {K}, '\\nSEGURO garantia\\nPrêmio R$ ', {BR.format('valor')}, '\\nVigência: ', date_format(data, 'dd/MM/yyyy'), '\\nBILHETE Nº 9\\nSEGURO\\n', if({K} % 2 = 0, 'Prêmio: 5,00', 'nada'))"
    return R.split_policies(text(spark, d, body))


@query(f"""{W} SELECT CAST({K} % 50 AS VARCHAR) AS sha, count(*) AS arquivos, CASE WHEN {K} % 50 IN (SELECT 2 * n_nationkey FROM nation) THEN 'lido' ELSE 'pedido' END AS estado FROM ledger GROUP BY 1, 3""")
def cached_vision(spark, d):
    """External results by hash; what has none is asked for once."""
    files = ledger(spark, d).select(F.col(K).alias("path"), (F.col(K) % 50).cast("string").alias("sha"))
    cache = table(spark, d, "nation").select((F.col("n_nationkey") * 2).cast("string").alias("sha"), F.col("n_name").alias("resultado"))
    done, asked = R.cached_results(files, cache)
    counts = files.groupBy("sha").agg(F.count("*").alias("arquivos"))
    states = done.select("sha", F.lit("lido").alias("estado")).distinct().unionByName(asked.select("sha", F.lit("pedido").alias("estado")))
    return counts.join(states, "sha")


@query(f"""{W} SELECT {K}, abs(CASE WHEN {K} % 2 = 0 THEN valor ELSE -valor END) AS valor, CASE {K} % 3 WHEN 0 THEN 'Obrigatório' WHEN 1 THEN 'Supérfluo' ELSE 'outra' END AS classificacao FROM ledger WHERE {K} % 11 <> 0 AND {K} % 13 <> 0""")
def history_import(spark, d):
    """Rows without date or value go, classes are mapped."""
    k = F.col(K)
    rows = ledger(spark, d).select(K, F.when(k % 11 != 0, F.col("data")).alias("data"), F.when(k % 13 != 0, F.when(k % 2 == 0, F.col("valor")).otherwise(-F.col("valor"))).alias("valor"), F.when(k % 3 == 0, "obrigatorio").when(k % 3 == 1, "SUPERFLUO").otherwise("outra").alias("classificacao"))
    return R.history_rows(rows, {"obrigatorio": "Obrigatório", "superfluo": "Supérfluo"}).select(K, "valor", "classificacao")


@query(f"""{W} SELECT {K}, CASE {K} % 5 WHEN 0 THEN 'nubank' WHEN 1 THEN 'nubank' WHEN 2 THEN 'c6' WHEN 3 THEN 'itau' END AS banco, CASE {K} % 5 WHEN 0 THEN 'cartao' WHEN 1 THEN 'conta' WHEN 2 THEN 'conta' WHEN 3 THEN 'conta' END AS tipo FROM ledger""")
def file_detection(spark, d):
    """Bank and kind by the header line."""
    head = f"case {K} % 5 when 0 then 'date,title,amount' when 1 then 'Data,Valor,Identificador,Descrição' when 2 then 'Data;Entrada(R$);Saída(R$)' when 3 then 'lançamento;x' else 'a,b' end"
    rows = ledger(spark, d).select(K, F.expr(head).alias("h"))
    bank, kind = R.detected(F.col("h"))
    return rows.select(K, bank.alias("banco"), kind.alias("tipo"))


@query(f"""{W} SELECT {K} FROM ledger WHERE {K} % 6 IN (0, 1, 4)""")
def file_scan(spark, d):
    """Known endings in any case, without downloaded copies."""
    name = f"concat('/in/f', {K}, case {K} % 6 when 0 then '.CSV' when 1 then '.pdf' when 2 then ' (1).pdf' when 3 then '.txt' when 4 then '.jpeg' else '' end)"
    return R.scan(ledger(spark, d).select(K, F.expr(name).alias("path"))).select(K)


@query(f"""{W} SELECT CAST(data AS VARCHAR) AS path, 'evento' AS tipo, "local" AS autor FROM ledger WHERE {K} % 3 = 0 UNION ALL SELECT CAST(data AS VARCHAR), NULL, NULL FROM ledger WHERE {K} % 3 <> 0""")
def front_matters(spark, d):
    """Notes with and without a head."""
    rows = ledger(spark, d).select(F.col("data").cast("string").alias("path"), F.expr(f"if({K} % 3 = 0, concat('---\\ntipo: evento\\nautor: ', local, '\\nlista:\\n---\\ncorpo'), 'sem cabeça')").alias("content"))
    return statements.front_matter(rows).select("path", F.col("campos")["tipo"].alias("tipo"), F.col("campos")["autor"].alias("autor"))


# ---- envelopes, pages, inbox


@query(f"""{W} SELECT {K}, CASE {K} % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'absoluto' WHEN 2 THEN 'sobe' ELSE 'ligacao' END AS estado, CASE WHEN {K} % 4 = 0 THEN 'nf/' || "local" || '.pdf' END AS membro FROM ledger""")
def zip_guard(spark, d):
    """Members outside the folder and links are refused."""
    name = f"case {K} % 4 when 0 then concat('nf/', local, '.pdf') when 1 then '/etc/x' when 2 then 'a/../../b' else 'atalho' end"
    rows = ledger(spark, d).select(K, F.expr(name).alias("nome"), (F.col(K) % 4 == 3).alias("link"))
    state = N.member_state(F.col("nome"), F.col("link"))
    return rows.select(K, state.alias("estado"), F.when(state == "ok", F.col("nome")).alias("membro"))


@query(f"""{W} SELECT data, CASE WHEN count(DISTINCT i) >= 2 THEN TRUE ELSE FALSE END AS misto, count(*) AS paginas FROM (SELECT data, CASE WHEN {K} % 3 = 0 THEN categoria END AS i FROM ledger) GROUP BY 1""")
def mixed_files(spark, d):
    """A file is mixed if identifiers stand on different sets of its pages."""
    pages = ledger(spark, d).select(F.col("data").alias("arquivo"), F.col(K).alias("pagina"), F.when(F.col(K) % 3 == 0, F.array("categoria")).otherwise(F.array().cast("array<string>")).alias("ids"))
    return N.mixed_by_identifiers(pages).select(F.col("arquivo").alias("data"), "misto", "paginas")


@query(f"""{W} SELECT sha8, min(nome) AS canonico, count(*) AS n FROM (SELECT 'h' || {K} % 500 AS sha8, 'f' || {K} % 500 || CASE WHEN {K} % 3 = 0 THEN '' ELSE '_' || {K} % 3 END || '.pdf' AS nome, {K} FROM ledger) GROUP BY 1 HAVING count(*) FILTER (NOT contains(nome, '_')) > 0 OR TRUE""")
def inbox_duplicates(spark, d):
    """Copies by hash; the name without a number in its end goes first."""
    k = F.col(K)
    name = F.concat(F.lit("f"), (k % 500).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), (k % 3).cast("string"))), F.lit(".pdf"))
    return N.duplicates(ledger(spark, d).select(F.concat(F.lit("h"), (k % 500).cast("string")).alias("sha8"), name.alias("nome")))


@query(f"""{W}, s AS (SELECT CAST({K} AS VARCHAR) AS sha8, 'x' AS tipo FROM ledger WHERE {K} % 2 = 0), m AS (SELECT CAST({K} AS VARCHAR) AS sha8, CASE WHEN {K} % 6 = 0 THEN 'ignorado' ELSE 'enviado' END AS estado FROM ledger WHERE {K} % 3 = 0)
 SELECT coalesce(estado, 'novo') AS estado, count(*) AS n FROM (SELECT coalesce(s.sha8, m.sha8) AS sha8, CASE WHEN s.sha8 IS NULL THEN 'sumido' ELSE m.estado END AS estado FROM s FULL JOIN m USING (sha8)) GROUP BY 1""")
def inbox_states(spark, d):
    """What was scanned against what was stored, counted by state."""
    k, sha = F.col(K), F.col(K).cast("string").alias("sha8")
    scan = ledger(spark, d).filter(k % 2 == 0).select(sha, F.lit("x").alias("tipo"))
    stored = ledger(spark, d).filter(k % 3 == 0).select(sha, F.when(k % 6 == 0, "ignorado").otherwise("enviado").alias("estado"))
    return N.queue(scan, stored).groupBy("estado").agg(F.count("*").alias("n"))


@query(f"""{W}, a AS (SELECT 'in/' || {K} AS path, {K} % 100 AS horas FROM ledger), g AS (SELECT 'in/' || {K} AS path, {K} % 4 = 0 AS aresta FROM ledger WHERE {K} % 2 = 0)
 SELECT path, CASE WHEN aresta THEN 'ligado' WHEN aresta IS NOT NULL THEN 'sem_aresta' WHEN horas > 48 THEN 'orfao' ELSE 'recente' END AS estado FROM a LEFT JOIN g USING (path)""")
def inbox_orphans(spark, d):
    """Inbox files against the graph, by age."""
    k = F.col(K)
    files = ledger(spark, d).select(F.concat(F.lit("in/"), k.cast("string")).alias("path"), (k % 100).alias("horas"))
    known = ledger(spark, d).filter(k % 2 == 0).select(F.concat(F.lit("in/"), k.cast("string")).alias("path"), (k % 4 == 0).alias("aresta"))
    return N.orphan_state(files, known, 48)


@query(f"""{W}, o AS (SELECT {K} AS doc, CASE WHEN {K} % 3 = 0 THEN 'h' || {K} ELSE 'velho' END AS sha, 'f' || {K} % 400 || '.pdf' AS nome FROM ledger WHERE {K} % 2 = 0), f AS (SELECT 'h' || {K} AS sha, 'f' || {K} % 400 || '.pdf' AS nome, 'arq/' || {K} AS path FROM ledger WHERE {K} % 5 <> 0),
 s AS (SELECT sha, min(path) AS path FROM f GROUP BY 1), n AS (SELECT nome, min(path) AS path FROM f GROUP BY 1)
 SELECT doc, coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NOT NULL THEN 'sha256' WHEN n.path IS NOT NULL THEN 'nome' ELSE 'quebrado' END AS por FROM o LEFT JOIN s USING (sha) LEFT JOIN n USING (nome)""")
def path_backfill(spark, d):
    """Broken paths, found again by hash, else by name."""
    k = F.col(K)
    name = F.concat(F.lit("f"), (k % 400).cast("string"), F.lit(".pdf"))
    docs = ledger(spark, d).filter(k % 2 == 0).select(k.alias("doc"), F.when(k % 3 == 0, F.concat(F.lit("h"), k.cast("string"))).otherwise("velho").alias("sha"), name.alias("nome"))
    files = ledger(spark, d).filter(k % 5 != 0).select(F.concat(F.lit("h"), k.cast("string")).alias("sha"), name.alias("nome"), F.concat(F.lit("arq/"), k.cast("string")).alias("path"))
    return N.backfill(docs, files)


@query(f"""{W}, c AS (SELECT {K} AS item, 1 AS prioridade, 'sem tipo' AS motivo FROM ledger WHERE {K} % 7 = 0 UNION ALL SELECT {K}, 2, 'conferir' FROM ledger WHERE {K} % 5 = 0 UNION ALL SELECT {K}, 3, 'baixa confiança' FROM ledger WHERE {K} % 100 < 80 AND {K} % 3 = 0 UNION ALL SELECT {K}, 4, 'sem vínculo' FROM ledger WHERE {K} % 2 = 0)
 SELECT item, min(prioridade) AS prioridade, arg_min(motivo, prioridade) AS motivo FROM c GROUP BY 1""")
def review_queue(spark, d):
    """Each document once, by its most urgent reason."""
    k = F.col(K)
    reasons = [(k % 7 == 0, "sem tipo"), (k % 5 == 0, "conferir"), ((k % 100 < 80) & (k % 3 == 0), "baixa confiança"), (k % 2 == 0, "sem vínculo")]
    return N.review_queue(ledger(spark, d).withColumn("item", k), reasons)


@query(f"""{W} SELECT {K}, CASE WHEN dias = 0 AND {K} % 2 = 0 THEN 'exato' WHEN dias = 0 THEN 'mesmo_dia' WHEN {K} % 2 = 0 THEN 'mesmo_valor' WHEN abs(dias) <= 3 THEN 'proximo' ELSE 'distante' END AS nome, dias FROM (SELECT {K}, CAST(CASE WHEN {K} % 10 = 0 THEN 0 ELSE {K} % 15 - 7 END AS INTEGER) AS dias FROM ledger)""")
def match_names(spark, d):
    """What kind of match it is, and its signed days (0 where a date is none)."""
    k = F.col(K)
    other = F.when(k % 10 != 0, F.date_add("data", (k % 15 - 7).cast("int")).cast("string")).otherwise("ruim")
    days = N.signed_days(F.col("data").cast("string"), other)
    return ledger(spark, d).select(K, N.match_name(days, k % 2 == 0).alias("nome"), days.alias("dias"))


@query(f"""{W} SELECT {K}, CASE WHEN {K} % 3 = 0 THEN mes_ref WHEN {K} % 3 = 1 THEN '2024-07' END AS competencia FROM ledger""")
def payslip_months(spark, d):
    """From the metadata, else from the end of the name."""
    k = F.col(K)
    name = F.when(k % 3 == 1, "holerite_2024-07").otherwise("holerite")
    return ledger(spark, d).select(K, N.payslip_month(F.when(k % 3 == 0, F.col("mes_ref")), name).alias("competencia"))


@query(f"""{W} SELECT {K}, CASE WHEN {K} % 4 = 0 THEN 'dipirona 500 mg' WHEN {K} % 4 = 1 THEN 'PLAYSTATION 5' ELSE "local" END AS texto FROM ledger""")
def product_fixes(spark, d):
    """Readings that are wrong only beside certain words."""
    t = f"case {K} % 4 when 0 then 'd1pirona 500 mg' when 1 then 'PLAYSTATION S' else local end"
    return ledger(spark, d).select(K, N.fixed(F.expr(t), [(r"\bd1pirona\b(?=.*\bmg\b)", "dipirona"), (r"(?<=PLAYSTATION )S\b", "5")]).alias("texto"))


# ---- graph ingestion


@query(f"""{W}, d AS (SELECT {K} AS doc, CASE WHEN {K} % 8 <> 0 THEN 'k' || {K} END AS chave, CASE WHEN {K} % 5 = 0 THEN NULL ELSE lpad(CAST({K} % 90 AS VARCHAR), 14, '0') END AS cnpj, "local" AS nome, data FROM ledger)
 SELECT doc, CASE WHEN cnpj IS NULL THEN 'BOLETO|' || substring(sha256(nome), 1, 12) ELSE cnpj END AS fornecedor, strftime(data, '%Y-%m') AS periodo FROM d WHERE chave IS NOT NULL""")
def fiscal_ingestion(spark, d):
    """Required fields, a made-up supplier where there is no tax id, edges to supplier and period."""
    k = F.col(K)
    docs = ledger(spark, d).select(k.alias("doc"), F.when(k % 8 != 0, F.concat(F.lit("k"), k.cast("string"))).alias("chave"), F.when(k % 5 != 0, F.lpad((k % 90).cast("string"), 14, "0")).alias("cnpj"), F.col("local").alias("nome"), "data")
    return N.ingest_documents(docs)


@query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey, l_quantity, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS total, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS codigo FROM lineitem)
 SELECT l_orderkey AS doc, CAST(n AS INTEGER) AS n, coalesce(codigo, 'SEMCOD' || lpad(CAST(n AS VARCHAR), 4, '0')) AS codigo, CASE WHEN l_partkey % 2 = 0 THEN l_quantity ELSE 1.0 END AS qtde, total FROM i WHERE total IS NOT NULL""")
def receipt_ingestion(spark, d):
    """Codes by position, quantity 1 by default, items without a total dropped."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordem"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey").cast("string")).alias("codigo"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).alias("qtde"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    return N.receipt_items(rows)


@query("""SELECT l_suppkey AS fornecedor, CAST(l_shipdate AS DATE) AS data, l_partkey AS codigo, count(*) AS vistos, max(l_quantity) AS qtde FROM lineitem GROUP BY 1, 2, 3""")
def item_upsert(spark, d):
    """One item for each supplier, date and code; the largest quantity stays."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fornecedor"), F.to_date("l_shipdate").alias("data"), F.col("l_partkey").alias("codigo"), F.col("l_quantity").alias("qtde"))
    return rows.groupBy("fornecedor", "data", "codigo").agg(F.count("*").alias("vistos"), F.max("qtde").alias("qtde"))


@query(f"""{W}, p AS (SELECT {K} AS apolice, CASE WHEN {K} % 3 = 0 THEN {K} + 1 END AS item FROM ledger) SELECT 'assegura' AS kind, apolice AS src, item AS dst FROM p WHERE item IS NOT NULL UNION ALL SELECT 'emitida_por', {K}, {K} % 25 FROM ledger UNION ALL SELECT 'prescreve', {K}, {K} % 7 FROM ledger WHERE {K} % 2 = 0""")
def special_ingestion(spark, d):
    """Edges of policies, prescriptions and warranties; what is unknown gives none."""
    k = F.col(K)
    return N.special_edges(ledger(spark, d).select(k.alias("src"), F.when(k % 3 == 0, k + 1).alias("assegura"), (k % 25).alias("emitida_por"), F.when(k % 2 == 0, k % 7).alias("prescreve")), ["assegura", "emitida_por", "prescreve"])


@query(f"""{W} SELECT {K}, CASE {K} % 4 WHEN 0 THEN 'nfce_modelo_65' WHEN 1 THEN 'boleto_servico' ELSE categoria END AS novo, {K} % 4 < 2 AS mudou FROM ledger""")
def type_rewrite(spark, d):
    """Divergent document types to canonical ones; a dry run tells what would change."""
    t = F.expr(f"case {K} % 4 when 0 then 'nfce' when 1 then 'boleto' else categoria end")
    return N.rewritten(ledger(spark, d).select(K, t.alias("tipo")), {"nfce": "nfce_modelo_65", "boleto": "boleto_servico"}).select(K, "novo", "mudou")


@query(f"""{W} SELECT {K} AS proposta, CASE WHEN {K} % 2 = 0 AND {K} % 3 = 0 THEN 'viva' WHEN {K} % 2 = 0 OR {K} % 3 = 0 THEN 'parcial' ELSE 'morta' END AS estado FROM ledger""")
def stale_proposals(spark, d):
    """Proposals whose document and transaction are still there."""
    k = F.col(K)
    rows = ledger(spark, d)
    return N.proposal_state(rows.select(k.alias("proposta"), k.alias("doc"), k.alias("tx")), rows.filter(k % 2 == 0).select(k.alias("doc")), rows.filter(k % 3 == 0).select(k.alias("tx")))


# ---- sheets, caches and validations


@query(f"""{W} SELECT {K}, data, valor, "local", quem, categoria, classificacao, banco_origem, tipo, mes_ref FROM ledger""")
def ledger_sheet(spark, d):
    """K2: the listed columns in their order; private ones never leave."""
    path = sinks.shared_path(spark, "sheet")
    rows = ledger(spark, d).withColumn("_descricao", F.lit("x"))
    sinks.write_sheet(rows, sinks.LEDGER_COLUMNS, path)
    back = spark.read.parquet(path)
    assert not [c for c in back.columns if c.startswith("_")]
    return back


@query(f"""{W} SELECT 'extrato' AS aba, count(*) AS n FROM ledger UNION ALL SELECT 'resumo_mensal', count(DISTINCT mes_ref) FROM ledger WHERE tipo <> '{TRANSFER}' UNION ALL SELECT 'renda', count(*) FROM ledger WHERE tipo = '{INCOME}' UNION ALL SELECT 'irpf', count(*) FROM ledger WHERE tipo = '{TAX}'
 UNION ALL SELECT 'analise', count(DISTINCT categoria) FROM ledger WHERE {SPENT} UNION ALL SELECT 'inventario', count(*) FROM part UNION ALL SELECT 'prazos', count(*) FROM nation UNION ALL SELECT 'dividas_ativas', count(*) FROM supplier WHERE s_acctbal < 0""")
def workbook(spark, d):
    """Eight sheets written in order and read back."""
    from ledgerloom.operators import analytics as A

    rows = ledger(spark, d)
    sheets = {
        "extrato": rows, "renda": rows.filter(F.col("tipo") == INCOME), "dividas_ativas": table(spark, d, "supplier").filter("s_acctbal < 0"), "inventario": table(spark, d, "part").select("p_partkey"), "prazos": table(spark, d, "nation"),
        "resumo_mensal": A.monthly_summary(rows), "irpf": rows.filter(F.col("tipo") == TAX), "analise": A.by_category(rows)}
    path = sinks.shared_path(spark, "workbook")
    sinks.write_workbook(sheets, path)
    return sinks.sheet_counts(spark, path, list(sheets))


@query("""SELECT p_partkey AS item, floor((2 * CAST(round(p_retailprice * 100) AS BIGINT) * (p_size % 20 + 1) + 100 * (p_size % 5 + 1)) / (200.0::DOUBLE * (p_size % 5 + 1))) / 100 AS perda_mensal FROM part""")
def inventory_losses(spark, d):
    """K4: value by yearly rate over the months of life."""
    value, rate, life = F.col("p_retailprice"), (F.col("p_size") % 20 + 1) / 100.0, F.col("p_size") % 5 + 1
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), sinks.monthly_loss(value, rate, life).alias("perda_mensal"))


@query("""SELECT n_name AS conta, CAST(n_nationkey + 1 AS INTEGER) AS dia FROM nation""")
def due_dates(spark, d):
    """K5: account and day in the third and fourth column, else in the first and second."""
    n = table(spark, d, "nation")
    four = n.filter("n_nationkey % 2 = 0").select(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b"), F.col("n_name").alias("c"), (F.col("n_nationkey") + 1).cast("string").alias("d"))
    two = n.filter("n_nationkey % 2 = 1").select(F.col("n_name").alias("a"), (F.col("n_nationkey") + 1).cast("string").alias("b"), F.lit(None).cast("string").alias("c"), F.lit("").alias("d"))
    return sinks.due_dates(four.unionByName(two))


@query(f"""{W} SELECT mes_ref, '# ' || mes_ref || chr(10) || 'Receita: ' || CAST(CAST(coalesce(sum(valor) FILTER (tipo = '{INCOME}'), 0) AS {D}) AS VARCHAR) || chr(10) || 'Despesa: ' || CAST(CAST(coalesce(sum(valor) FILTER ({SPENT}), 0) AS {D}) AS VARCHAR) AS texto FROM ledger GROUP BY 1""")
def monthly_reports(spark, d):
    """K6: a Markdown text a month, written and read back."""
    path = sinks.shared_path(spark, "reports")
    sinks.write_reports(ledger(spark, d), path)
    return sinks.read_reports(spark, path)


@query(f"""{W}, w AS (SELECT date_trunc('week', data) AS w, CAST(sum(valor) AS {D}) AS total, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY 1) SELECT strftime(w, '%Y-%m-%d') AS semana, total, n FROM w""")
def weekly_cache(spark, d):
    """Caches as JSON, read back with their schema; a line that does not fit is left out."""
    path = sinks.shared_path(spark, "cache")
    weeks = ledger(spark, d).filter(F.col("tipo").isin(EXPENSE, TAX)).groupBy(F.date_format(F.date_trunc("week", "data"), "yyyy-MM-dd").alias("semana")).agg(F.sum("valor").cast("decimal(28,2)").alias("total"), F.count("*").alias("n"))
    sinks.write_cache(weeks, path)
    return sinks.read_cache(spark, path, "semana string, total decimal(28,2), n bigint")


@query(f"""{W}, m AS (SELECT DISTINCT substring(sha256(tipo || '|' || CAST(data AS VARCHAR) || '|' || categoria), 1, 12) AS hash, tipo, data, categoria FROM ledger) SELECT * FROM m""")
def milestones(spark, d):
    """Written twice, kept once, by the hash of kind, day and text."""
    rows = ledger(spark, d).select("tipo", "data", "categoria")
    return sinks.idempotent(sinks.idempotent(None, rows), rows)


@query(f"""{W} SELECT {K}, {K} % 2 = 0 AS dif_valor, {K} % 3 = 0 AS dif_data, {K} % 5 = 0 AS dif_local, regexp_replace("local", '[0-9]{{3}}\\.[0-9]{{3}}', '***') AS "local" FROM ledger WHERE {K} % 2 = 0 OR {K} % 3 = 0 OR {K} % 5 = 0""")
def ground_truth(spark, d):
    """Three flags of divergence between proof and ledger, personal data masked."""
    k = F.col(K)
    rows = ledger(spark, d)
    proof = rows.select(K, F.when(k % 2 == 0, F.col("valor") + 1).otherwise(F.col("valor")).alias("valor"), F.when(k % 3 == 0, F.date_add("data", 1)).otherwise(F.col("data")).alias("data"), F.when(k % 5 == 0, "x").otherwise(F.col("local")).alias("local"))
    return sinks.divergences(rows, proof, K).filter("dif_valor or dif_data or dif_local").select(K, "dif_valor", "dif_data", "dif_local", "local")


@query(f"""{W}, b AS (SELECT DISTINCT data AS dia FROM ledger WHERE data <= DATE '1998-08-02') SELECT dia FROM b WHERE dia > DATE '1998-08-02' - 7 UNION SELECT max(dia) FROM b WHERE dia <= DATE '1998-08-02' - 7 AND dia > DATE '1998-08-02' - 35 GROUP BY date_trunc('week', dia)""")
def backup_retention(spark, d):
    """The last seven days, and the last of each week of the four weeks before."""
    days = ledger(spark, d).select(F.col("data").alias("dia")).distinct().filter("dia <= date'1998-08-02'")
    return sinks.retained(days, "1998-08-02", 7, 4)
