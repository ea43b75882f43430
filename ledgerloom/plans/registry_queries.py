"""Files of many kinds through one ordered dispatcher, and archives and mails through their tree of members."""

from __future__ import annotations

import io
import zipfile
from email.message import EmailMessage

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import phases as P
from ledgerloom.sources import containers as C
from ledgerloom.sources import registry as R
from ledgerloom.sources import sinks

from .catalogue import query
from .ledger import ledger, table
from .ledger_queries import W
from .reader_queries import BR, K, _key

V = BR.format("valor")
KEY = _key()


def files(spark, d):
    """(path, content): one file for each ledger row, of seven kinds."""
    body = f"""case {K} % 7
      when 0 then concat('date,title,amount\\n', data, ',', local, ',', valor)
      when 1 then 'date,title,amount\\n1997-01-01'
      when 2 then concat('linha ', local, '\\n\\nfim')
      when 3 then concat('Demonstrativo de Pagamento de Salário: ', date_format(data, 'MM/yyyy'), ' Seg: 1\\nDescrição Referência Descontos Proventos\\n+ Horas Normais 200.00 R$ ', {V},
        if({K} % 2 = 0, '\\n+ 13o Salário Integral 6.00 R$ 100,00', ''), '\\n- IRRF 27.50 (R$ 20,29)\\n- INSS 14.00 (R$ 10,07)\\n- Desc.Vale Alimentação 22.00 (R$ 6,52)', if({K} % 3 = 0, concat('\\nValor líquido a receber: R$ ', {V}), ''))
      when 4 then concat('Mensalista Foo de 1997\\n8781 DIAS NORMAIS 31,00 ', {V})
      when 5 then concat('Mensalista Março de ', year(data), if({K} % 2 = 0,
        concat('\\n8781 DIAS NORMAIS 31,00 ', {V}, '\\n998 I.N.S.S. 9,88 8,07\\n999 IMPOSTO DE RENDA 27,50 9,55\\nTotal 1,00\\nValor Líquido 7,38'),
        concat('\\nSALARIO INTEGRAL 12,00 ', {V}, '\\nADIANTAMENTO 13 SALARIO 20,00\\nINSS 13 SALARIO 14,00 5,00\\nIRRF 13 SALARIO 27,50 4,00')))
      else concat('DANFE Documento Auxiliar da Nota Fiscal Eletrônica\\nNº 000', {K}, ' SÉRIE 1\\n{" ".join(KEY[i : i + 4] for i in range(0, 44, 4))}\\nEmitente: ', local, '\\nCNPJ 12.345.678/0001-90\\nDATA DE EMISSÃO: ', date_format(data, 'dd/MM/yyyy'),
        '\\nCÓDIGO DESCRIÇÃO NCM CFOP UN QTDE VALOR\\nA1-{{}} Mesa de madeira 94036000 5102 un 2 10,00 20,00 20,00 3,60 1,00\\nfina ', categoria, '\\nB22 Cadeira 94016100 5102 PC 1,5 ', {V}, ' ', {V},
        '\\nCÁLCULO DO IMPOSTO\\nVALOR TOTAL DA NOTA: R$ ', {V}, if({K} % 2 = 0, '\\nNOTA FISCAL CANCELADA', '')) end""".replace("{{}}", "x")
    path = f"concat('/in/', {K}, case {K} % 7 when 0 then '.csv' when 1 then '.CSV' when 2 then '.txt' when 4 then '.txt' else '.pdf' end)"
    return ledger(spark, d).select(F.expr(path).alias("path"), F.expr(body).alias("content"))


_PATH = f"'/in/' || {K} || CASE {K} % 7 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' WHEN 2 THEN '.txt' WHEN 4 THEN '.txt' ELSE '.pdf' END"


@query(f"""{W}, f AS (SELECT {_PATH} AS path, {K} % 7 AS m FROM ledger), r(m, reader, n, falhou) AS (VALUES (0, 'card_csv', 1, FALSE), (1, 'card_csv', NULL, TRUE), (1, NULL, NULL, TRUE), (2, 'lines', 1, FALSE), (2, 'lines', 2, FALSE),
 (3, 'signed_payslip', 1, FALSE), (4, 'coded_payslip', NULL, TRUE), (4, 'lines', 1, FALSE), (4, 'lines', 2, FALSE), (5, 'coded_payslip', 1, FALSE), (6, 'printed_invoice', 1, FALSE), (6, 'printed_invoice', 2, FALSE), (6, 'printed_invoice', 3, FALSE))
 SELECT path, reader, n, falhou FROM f JOIN r USING (m)""")
def reader_registry(spark, d):
    """The first reader that accepts a file and does not fail; failures and unread files are rows."""
    return R.dispatch(files(spark, d)).select("path", "reader", "n", F.col("error").isNotNull().alias("falhou"))


_MONEY = "CAST({} AS DECIMAL(18,2))"


@query(f"""{W}, p AS (SELECT {_PATH} AS path, {K} % 7 AS m, {K} AS k, data, valor FROM ledger WHERE {K} % 7 IN (3, 5)),
 q AS (SELECT path, CASE WHEN m = 3 THEN strftime(data, '%Y-%m') ELSE year(data) || '-03' END AS mes_ref, CASE WHEN m = 3 AND k % 2 = 0 OR m = 5 AND k % 2 = 1 THEN '13º Integral' ELSE 'Folha Mensal' END AS tipo,
  {_MONEY.format("valor + CASE WHEN m = 3 AND k % 2 = 0 THEN 100 ELSE 0 END")} AS bruto, {_MONEY.format("CASE WHEN m = 3 THEN 10.07 WHEN k % 2 = 0 THEN 8.07 ELSE 5 END")} AS inss,
  {_MONEY.format("CASE WHEN m = 3 THEN 20.29 WHEN k % 2 = 0 THEN 9.55 ELSE 4 END")} AS irrf, {_MONEY.format("CASE WHEN m = 3 THEN 6.52 ELSE 0 END")} AS vr_va, m, k, valor FROM p)
 SELECT path, mes_ref, tipo, bruto, inss, irrf, vr_va, {_MONEY.format("CASE WHEN m = 3 AND k % 3 = 0 THEN valor WHEN m = 5 AND k % 2 = 0 THEN 7.38 WHEN m = 5 THEN bruto - 20 - inss - irrf ELSE bruto - inss - irrf - vr_va END")} AS liquido FROM q""")
def payslip_layouts(spark, d):
    """Signed lines, and one code or key word a line, also of a 13th salary."""
    rows = R.dispatch(files(spark, d)).filter("reader in ('signed_payslip', 'coded_payslip') and error is null")
    money = [F.col("fields")[c].cast("decimal(18,2)").alias(c) for c in ("bruto", "inss", "irrf", "vr_va", "liquido")]
    return rows.select("path", F.col("fields")["mes_ref"].alias("mes_ref"), F.col("fields")["tipo"].alias("tipo"), *money)


@query(f"""{W}, f AS (SELECT {_PATH} AS path, * FROM ledger WHERE {K} % 7 = 6)
 SELECT path, 0 AS item, '{KEY}' AS chave, CAST({K} AS VARCHAR) AS numero, data AS data_emissao, CAST(valor AS DECIMAL(18,2)) AS valor, {K} % 2 = 0 AS cancelada, NULL AS descricao, NULL AS unidade, NULL AS icms FROM f
 UNION ALL SELECT path, 1, NULL, NULL, NULL, 20.00, NULL, 'Mesa de madeira fina ' || categoria, 'UN', 3.60 FROM f UNION ALL SELECT path, 2, NULL, NULL, NULL, valor, NULL, 'Cadeira', 'PC', 0.00 FROM f""")
def printed_invoices(spark, d):
    """Header and items of an invoice's print."""
    f = lambda c: F.col("fields")[c]
    rows = R.dispatch(files(spark, d)).filter("reader = 'printed_invoice' and error is null")
    return rows.select(
        "path", f("item").cast("int").alias("item"), f("chave").alias("chave"), f("numero").alias("numero"), f("data_emissao").cast("date").alias("data_emissao"), F.coalesce(f("total"), f("valor_total")).cast("decimal(18,2)").alias("valor"),
        f("cancelada").cast("boolean").alias("cancelada"), f("descricao").alias("descricao"), f("unidade").alias("unidade"), f("icms").cast("decimal(18,2)").alias("icms"))


@query(f"""{W} SELECT path, 'banco x' AS banco, CASE m WHEN 0 THEN 'cartao' ELSE 'cc' END AS tipo, CASE WHEN j THEN 'ana' WHEN c THEN 'bia' ELSE 'ana' END AS pessoa, CASE WHEN j THEN 'pj' ELSE '' END AS subtipo,
 strftime(data, '%Y-%m') AS periodo, CASE m WHEN 2 THEN 'pdf' ELSE 'csv' END AS formato, CASE WHEN j THEN 0.9 WHEN c THEN 0.95 ELSE 0.5 END AS confianca
 FROM (SELECT '/in/' || CASE WHEN {K} % 3 = 0 THEN 'PJ/' ELSE '' END || {K} || CASE {K} % 4 WHEN 2 THEN '.pdf' WHEN 3 THEN '.txt' ELSE '.csv' END AS path, {K} % 4 AS m, {K} % 3 = 0 AS j, {K} % 5 = 0 AS c, data FROM ledger) WHERE m < 3""")
def detected_files(spark, d):
    """Kind by suffix and header, person by path and content, period by the first dated row."""
    who = f"if({K} % 5 = 0, ' conta 070.475', '')"
    body = f"case {K} % 4 when 0 then concat('date,title,amount\\n', data, ',a{{}},1') when 1 then concat('Data,Valor,Identificador,Descrição\\n', date_format(data, 'dd/MM/yyyy'), ',1,2,b') when 2 then concat('Período de visualização: ', date_format(data, 'dd/MM/yyyy'), ' até 31/12/2030') else 'x' end".replace("{}", "")
    path = f"concat('/in/', if({K} % 3 = 0, 'PJ/', ''), {K}, case {K} % 4 when 2 then '.pdf' when 3 then '.txt' else '.csv' end)"
    rows = ledger(spark, d).select(F.expr(path).alias("path"), F.expr(f"concat({body}, {who})").alias("content"))
    return R.detect(rows, "banco x", [("path", "pj/", "ana", "pj", 0.9), ("content", "070.475", "bia", "", 0.95)], ("ana", "", 0.5))


def _containers(batches):
    """(path, content) of each page: an archive, one that climbs out of its folder, a mail with an archive, or the page itself."""
    for batch in batches:
        paths, contents = [], []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data, kind = (html or "").encode(), page % 4
            if kind < 3:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("../out.html" if kind == 1 else "in/page.html", data)
                own = held.getvalue()
                if kind == 2:
                    mail = EmailMessage()
                    mail["Subject"] = "pages"
                    mail.set_content("see there")
                    mail.add_attachment(own, maintype="application", subtype="zip", filename="pages.zip")
                    own = mail.as_bytes()
                data = own
            paths.append(f"/in/{page}" + (".zip", ".zip", ".eml", ".html")[kind])
            contents.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


@query("""WITH m AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/in/' || page_id || '.zip' WHEN 1 THEN '/in/' || page_id || '.zip' WHEN 2 THEN '/in/' || page_id || '.eml' ELSE '/in/' || page_id || '.html' END AS path,
  CASE page_id % 4 WHEN 0 THEN page_id || '.zip!in/page.html' WHEN 1 THEN page_id || '.zip!../out.html' WHEN 2 THEN page_id || '.eml!pages.zip!in/page.html' ELSE page_id || '.html' END AS member,
  CASE page_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS depth, CASE WHEN page_id % 4 = 1 THEN 'unsafe path' ELSE 'ok' END AS status, coalesce(html, '') AS html FROM pages),
 h AS (SELECT path, member, depth, status, CASE WHEN status = 'ok' THEN strlen(html) END AS size, CASE WHEN status = 'ok' THEN sha256(html) END AS sha256 FROM m)
 SELECT path, member, depth, status, size, sha256, sha256 IS NOT NULL AND path || '!' || member <> min(path || '!' || member) OVER (PARTITION BY sha256) AS copia FROM h""")
def expanded_containers(spark, d):
    """Archives, mails and plain files as members with their real hashes; copies refer to the first."""
    found = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_containers, "path string, content binary")
    return C.first_copies(C.expand(found)).select("path", "member", "depth", "status", "size", "sha256", F.col("copy_of").isNotNull().alias("copia"))


@query(f"""{W}, r AS (SELECT CAST({K} AS VARCHAR) AS path, {K} % 4 AS m, {K} AS k, floor(valor) AS v FROM ledger)
 SELECT path, 0 AS item, CASE m WHEN 0 THEN 'loja' WHEN 1 THEN 'mercado' WHEN 2 THEN 'farmacia' ELSE 'posto' END AS emissor, NULL AS codigo, NULL AS descricao, CAST(CASE WHEN k % 3 = 0 THEN 4 * v ELSE v END AS DECIMAL(18,2)) AS valor, k % 3 = 0 AS conferir, NULL AS inconsistente FROM r
 UNION ALL SELECT path, 1, NULL, CASE WHEN m IN (0, 2) THEN '7890000000001' ELSE 'SEMCOD0001' END, CASE m WHEN 3 THEN 'GASOLINA COMUM' ELSE 'PRODUTO UM' END, CAST(v AS DECIMAL(18,2)), NULL, m <> 2 AND k % 5 = 0 FROM r""")
def thermal_receipts(spark, d):
    """Item lines by kind of shop, the share of the total that they make up, and lines whose figures do not fit."""
    v, q = "cast(cast(floor(valor) as decimal(12,0)) as string)", f"if({K} % 5 = 0, '2 ', '1 ')"
    body = f"""concat('CUPOM FISCAL\n', case {K} % 4 when 0 then concat('LOJAS AMERICANAS\n7890000000001 PRODUTO UM ', {q}, 'UN x ', {v}, ',00 ', {v}, ',00\nSEM CODIGO 1 UN x 1,00 1,00')
      when 1 then concat('SUPERMERCADO X\nPRODUTO UM ', {q}, 'x ', {v}, ',00 ', {v}, ',00\nDEBITO ', {v}, ',00') when 2 then concat('DROGARIA Y\n7890000000001 PRODUTO UM ', {v}, ',00\nDEBITO ', {v}, ',00')
      else concat('AUTO POSTO Z\nGASOLINA COMUM ', {q}, 'L x ', {v}, ',000 ', {v}, ',00\nLAVAGEM 1 UN x 1,00 1,00') end,
      '\nSUBTOTAL ', {v}, ',00\nTOTAL ', cast(cast(floor(valor) * if({K} % 3 = 0, 4, 1) as decimal(12,0)) as string), ',00')"""
    rows = R.dispatch(ledger(spark, d).select(F.col(K).cast("string").alias("path"), F.expr(body).alias("content")))
    f = lambda c: F.col("fields")[c]
    return rows.select(
        "path", f("item").cast("int").alias("item"), f("emissor").alias("emissor"), f("codigo").alias("codigo"), f("descricao").alias("descricao"), F.coalesce(f("total"), f("valor_total")).cast("decimal(18,2)").alias("valor"),
        f("conferir").cast("boolean").alias("conferir"), f("inconsistente").cast("boolean").alias("inconsistente"))


# ---- phases, audits, caches


@query(f"""{W} SELECT 1 AS fase, 'ler' AS nome, count(*) AS linhas, 0 AS nulos, NULL AS erro FROM ledger UNION ALL SELECT 2, 'marcar', count(*), count(*) FILTER ({K} % 3 <> 0), NULL FROM ledger
 UNION ALL SELECT 3, 'gastos', count(*), count(*) FILTER ({K} % 3 <> 0), NULL FROM ledger WHERE tipo = 'Despesa'""")
def phase_figures(spark, d):
    """Figures of three phases, observed while each is written."""
    phases = [("ler", lambda r: r), ("marcar", lambda r: r.withColumn("marca", F.when(F.col(K) % 3 == 0, "x"))), ("gastos", lambda r: r.filter("tipo = 'Despesa'"))]
    return P.run_phases(ledger(spark, d), phases)[1]


_AUDIT = f"""p AS (SELECT {K} AS sha, categoria AS tipo, CASE WHEN {K} % 5 = 0 THEN valor + 1 ELSE valor END AS valor, data FROM ledger WHERE {K} % 7 <> 0), n AS (SELECT {K} AS sha, categoria AS tipo, valor, CASE WHEN {K} % 11 = 0 THEN NULL ELSE data END AS data FROM ledger WHERE {K} % 4 <> 0),
 a AS (SELECT coalesce(p.sha, n.sha) AS sha, coalesce(p.tipo, n.tipo) AS tipo, CASE WHEN n.sha IS NULL THEN 'sem no' WHEN p.sha IS NULL THEN 'sem prova' WHEN p.valor IS DISTINCT FROM n.valor OR p.data IS DISTINCT FROM n.data THEN 'divergente' ELSE 'ok' END AS estado, p.valor AS pv, n.valor AS nv, p.data AS pd, n.data AS nd FROM p FULL JOIN n ON p.sha = n.sha)"""


def _audit(spark, d):
    k, rows = F.col(K), ledger(spark, d)
    proofs = rows.filter(k % 7 != 0).select(k.alias("sha"), F.col("categoria").alias("tipo"), F.when(k % 5 == 0, F.col("valor") + 1).otherwise(F.col("valor")).cast("decimal(18,2)").alias("valor"), "data")
    nodes = rows.filter(k % 4 != 0).select(k.alias("sha"), F.col("categoria").alias("tipo"), "valor", F.when(k % 11 != 0, F.col("data")).alias("data"))
    return P.cross_audit(proofs, nodes, ["valor", "data"])


@query(f"""{W}, {_AUDIT} SELECT tipo, count(*) FILTER (estado = 'ok') AS ok, count(*) FILTER (estado = 'divergente') AS divergente, count(*) FILTER (estado = 'sem no') AS sem_no, count(*) FILTER (estado = 'sem prova') AS sem_prova FROM a GROUP BY 1""")
def audit_by_type(spark, d):
    """The sheet of types."""
    return _audit(spark, d)["tipos_resumo"]


@query(f"""{W}, {_AUDIT} SELECT sha, 'valor' AS campo, CAST(pv AS VARCHAR) AS prova, CAST(nv AS VARCHAR) AS no FROM a WHERE estado = 'divergente' AND pv IS DISTINCT FROM nv UNION ALL SELECT sha, 'data', CAST(pd AS VARCHAR), CAST(nd AS VARCHAR) FROM a WHERE estado = 'divergente' AND pd IS DISTINCT FROM nd""")
def audit_divergences(spark, d):
    """The sheet of divergences, written as a workbook's table and read back."""
    path = sinks.shared_path(spark, "audit")
    sinks.write_workbook(_audit(spark, d), path)
    return spark.read.parquet(f"{path}/divergencias_detalhe")


@query("""WITH m AS (SELECT CAST(ts AS DATE) AS data, user_id, event_id, value FROM events), t AS (SELECT max(data) AS hoje FROM m)
 SELECT data, 'p' || user_id AS autor, arg_min(value, event_id) AS humor FROM m, t WHERE data BETWEEN hoje - 89 AND hoje AND value IS NOT NULL GROUP BY 1, 2""")
def mood_heat_map(spark, d):
    """Cells of 90 days as JSON, read back."""
    e = table(spark, d, "events")
    moods = e.select(F.to_date("ts").alias("data"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("autor"), F.col("event_id").alias("path"), F.col("value").cast("double").alias("humor"))
    today = str(moods.agg(F.max("data")).first()[0])
    path = sinks.shared_path(spark, "heat")
    P.write_heat_map(P.mood_heat_map(moods, today), path)
    return P.read_heat_map(spark, path)


@query("""SELECT p_partkey AS item, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CASE WHEN p_size % 3 = 0 THEN 0.10 ELSE CAST((p_size % 20 + 1) AS DECIMAL(8,2)) / 100 END / CASE WHEN p_size % 4 = 0 THEN 2 ELSE p_size % 5 + 1 END, 6) AS DOUBLE) AS perda FROM part""")
def inventory_defaults(spark, d):
    """K4: a tenth a year over two where a sheet has no rate or no life."""
    rate = F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 20 + 1) / F.lit(100.0))
    life = F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 5 + 1)
    exact = sinks.yearly_share(F.col("p_retailprice"), rate, life)
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.round(exact, 6).cast("double").alias("perda"))
