"""Expressions, parsers and operators on small rows with the odd cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.functions.similarity import token_set, token_sort
from ledgerloom.operators import finance as N
from ledgerloom.operators import ledger_ops as L
from ledgerloom.sources import sinks
from ledgerloom.sources import statements as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, value", [("1.234,56", 1234.56), ("-0,50", -0.5), ("12", 12), ("abc", None), ("", None), (None, None)])
def test_parse_br(spark, text, value):
    got = one(spark, X.parse_br(F.col("t")), t=text)
    assert (got is None) == (value is None) and (value is None or float(got) == value)


def test_invoice_key_and_check_digit(spark):
    body = "35240112345678000190550010000000011123456789"[:43]
    total = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(body)))
    digit = 0 if total % 11 < 2 else 11 - total % 11
    assert one(spark, X.check_digit_ok(F.col("k")), k=body + str(digit)) and not one(spark, X.check_digit_ok(F.col("k")), k=body + str((digit + 1) % 10))
    assert one(spark, X.invoice_key(F.col("k")), k=" ".join(body) + " 7") == body + "7" and one(spark, X.invoice_key(F.col("k")), k="12") is None


def test_names_and_masks(spark):
    assert one(spark, X.normal_supplier(F.col("t")), t=" Padaria  São João - Filial S/A LTDA ") == "PADARIA SÃO JOÃO FILIAL S A"
    assert one(spark, X.slug(F.col("t")), t="  Ação & Reação! ") == "acao-reacao"
    assert one(spark, X.mask_pii(F.col("t")), t="123.456.789-09 a@b.co") == "***.***.***-** ***@***"
    assert one(spark, X.first_date_br(F.col("t")), t="99/99/2024 31/12/2023") == dt.date(2023, 12, 31)
    assert token_sort("b a", "a b") == 100.0 and token_set("a b c", "a b") == 100.0 and token_set("", "x") == 0.0


def test_dedup_keeps_null_identifiers_and_virtual_groups(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, "z")], "id string, n int, t string")
    assert sorted(r["n"] for r in L.dedup_identifier(rows, "id", ["n"]).collect()) == [1, 3, 4]


def test_card_csv_skips_bad_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,title,amount\n2024-01-02,Estorno loja,-5.00\nbad,x,1\n2024-01-03,Mercado,12.3\n2024-01-04,y,zz\n")
    got = {r["local"]: (float(r["valor"]), r["tipo"]) for r in S.read_card_csv(spark, str(tmp_path)).collect()}
    assert got == {"Estorno loja": (5.0, "Receita"), "Mercado": (12.3, "Despesa")}


def test_ofx_without_identifier_gets_a_hash(spark):
    text = "<ORG>NU PAGAMENTOS\n<STMTTRN><DTPOSTED>20240105<TRNAMT>-3.50<NAME>Loja</STMTTRN><STMTTRN><DTPOSTED>2024<TRNAMT>1</STMTTRN>"
    rows = S.parse_ofx(spark.createDataFrame([(text,)], "content string"), {"nu pag": "Nubank"}).collect()
    assert len(rows) == 1 and rows[0]["banco_origem"] == "Nubank" and len(rows[0]["identificador"]) == 16 and rows[0]["descricao"] == "Loja"


def test_card_bill_year_turn_and_sections(spark):
    text = "05/12 ANTES 1,00\nDETALHE\n05/12 LOJA 02/03 10,00\n05/01 OUTRA 1.000,00\nRESUMO\n05/01 FORA 5,00"
    files = spark.createDataFrame([("p", text, dt.date(2024, 1, 20))], "path string, content string, vencimento date")
    got = [(r["data"], r["local"], r["parcela"], float(r["valor"])) for r in S.parse_card_bill(files, "DETALHE", "RESUMO").orderBy("n").collect()]
    assert got == [(dt.date(2023, 12, 5), "LOJA", "02/03", 10.0), (dt.date(2024, 1, 5), "OUTRA", None, 1000.0)]


def test_card_bills_of_one_path_have_their_own_sections(spark):
    texts = ["05/01 ANTES 1,00\nDETALHE\n05/01 A 1,00\n05/01 B 2,00\nRESUMO\n05/01 FORA 3,00", "DETALHE\n06/01 C 4,00", "06/01 ANTES 5,00\n06/01 ANTES 6,00\n06/01 ANTES 7,00\nRESUMO\n07/01 DETALHE 8,00\n\n08/01 D 9,00"]
    files = spark.createDataFrame([("p", t, dt.date(2024, 1, 20)) for t in texts], "path string, content string, vencimento date").coalesce(1)
    got = sorted((r["local"], r["n"]) for r in S.parse_card_bill(files, "DETALHE", "RESUMO").collect())
    assert got == [("A", 2), ("B", 3), ("C", 1), ("D", 6), ("DETALHE", 4)]


def test_nfe(spark):
    body = "3524011234567800019055001000000001112345678"
    total = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(body)))
    key = body + str(0 if total % 11 < 2 else 11 - total % 11)
    xml = f"""<nfeProc xmlns="urn:x"><NFe><infNFe Id="NFe{key}"><ide><dhEmi>2024-01-05T10:00:00-03:00</dhEmi></ide><emit><xNome>Loja</xNome></emit>
    <det><prod><cProd>1</cProd><xProd>Pão</xProd><qCom>2.0</qCom><vProd>3.50</vProd></prod></det><det><prod><cProd>2</cProd><xProd>Leite</xProd><qCom>1</qCom><vProd>4</vProd></prod></det>
    <total><ICMSTot><vNF>7.50</vNF></ICMSTot></total></infNFe></NFe><protNFe><infProt><cStat>100</cStat></infProt></protNFe></nfeProc>"""
    files = spark.createDataFrame([("a", xml), ("b", "<x/>")], "path string, content string")
    rows = S.parse_nfe(files).collect()
    assert [(r["chave"], r["razao_social"], float(r["total"]), r["cancelada"], r["data_emissao"]) for r in rows] == [(key, "Loja", 7.5, False, dt.date(2024, 1, 5))]
    assert [(r["item"], r["descricao"], float(r["valor_total"])) for r in S.parse_nfe_items(files).collect()] == [(1, "Pão", 3.5), (2, "Leite", 4.0)]


def test_nfe_of_odd_xml(spark):
    body = "3524011234567800019055001000000001112345678"
    total = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(body)))
    key = body + str(0 if total % 11 < 2 else 11 - total % 11)
    item = "<n:det nItem='1'><n:prod><n:cProd>A</n:cProd><!-- <n:vProd>3</n:vProd> --><n:vProd>2.00</n:vProd></n:prod><n:imposto>{}</n:imposto></n:det>"
    taxes = "<n:ICMS><n:ICMSSN101><n:orig>0</n:orig><n:vICMS>1.50</n:vICMS></n:ICMSSN101></n:ICMS><n:IPI><n:cEnq>999</n:cEnq><n:IPITrib><n:vIPI>0.70</n:vIPI></n:IPITrib></n:IPI><n:PIS/>"
    make = lambda inner, after="": f'<?xml version="1.0"?><n:nfeProc xmlns:n="urn:x"><n:NFe><n:infNFe Id="NFe{key}"><n:emit><n:CNPJ>99.888.777/0001-66</n:CNPJ>{inner}</n:emit>{item.format(taxes)}<!-- <n:total><n:ICMSTot><n:vNF>1.00</n:vNF></n:ICMSTot></n:total> --><n:total><n:ICMSTot><n:vNF>9.00</n:vNF></n:ICMSTot></n:total></n:infNFe></n:NFe>{after}</n:nfeProc>'
    event = "<n:evento><n:infEvento><n:tpEvento>110111</n:tpEvento></n:infEvento></n:evento>"
    texts = {
        "entity": make("<n:xNome>A &amp; B &#76;TDA</n:xNome>"), "cdata": make("<n:xNome><![CDATA[A <B> & C]]></n:xNome>"), "event": make("<n:xNome> </n:xNome>", event),
        "state": make("", "<n:protNFe><n:infProt><n:cStat>135</n:cStat></n:infProt></n:protNFe>"), "broken": make("<n:xNome>"), "null": None, "empty": "",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = {r["path"]: (r["razao_social"], str(r["total"]), r["cnpj_emitente"], r["cancelada"]) for r in S.parse_nfe(files).collect()}
    assert got == {
        "entity": ("A & B LTDA", "9.00", "99888777000166", False), "cdata": ("A <B> & C", "9.00", "99888777000166", False), "event": (None, "9.00", "99888777000166", True),
        "state": (None, "9.00", "99888777000166", True),
    }
    items = {r["path"]: (str(r["valor_total"]), *(str(r[t]) for t in ("icms", "ipi", "pis", "cofins"))) for r in S.parse_nfe_items(files).collect()}
    assert items["entity"] == ("2.00", "1.50", "0.70", "0.00", "0.00") and set(items) == set(got)


def test_front_matter_and_copies(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntipo: evento\nautor: x y\nlista:\n---\ncorpo")
    (tmp_path / "a (1).md").write_text("---\ntipo: copia\n---\n")
    (tmp_path / "b.md").write_text("sem")
    got = sorted((r["campos"] or {}).get("tipo", "") for r in S.front_matter(S.read_files(spark, str(tmp_path), "*.md")).collect())
    assert got == ["", "evento"]


def test_upsert_keeps_human_columns(spark):
    old = spark.createDataFrame([(1, "a", "ok"), (2, "b", None)], "id int, v string, marca string")
    new = spark.createDataFrame([(1, "A", None), (3, "c", None)], "id int, v string, marca string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["id"], ["marca"]).collect()) == [(1, "A", "ok"), (2, "b", None), (3, "c", None)]


def test_finance_edges(spark):
    rows = spark.createDataFrame([(1, "k", 100.0), (2, "k", 104.0), (3, "k", 110.0), (4, "k", 105.0), (5, "j", 1.0)], "id long, chave string, valor double")
    assert {r["id"]: r["grupo"] for r in N.same_reality(rows, ["chave"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    goal = lambda b, g, n: spark.range(1).select(N.months_to_goal(F.lit(b), F.lit(g), F.lit(n)).alias("x")).first()["x"]
    assert (goal(10.0, 95.0, 0.0), goal(0.0, 95.0, 0.0), goal(-1.0, 5.0, 9.0)) == (10, None, 0)
    curve = {r["mes"]: r["valor"] for r in N.curves(spark, 100.0, 10.0, {"x": 0.0}, 3).collect()}
    assert curve == {0: 100.0, 1: 110.0, 2: 120.0, 3: 130.0}


def test_library_does_not_import_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, ledgerloom.plans.catalogue; sys.exit(any(m.startswith('ledgerloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0
