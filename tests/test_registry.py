"""The dispatcher over files, its layouts, and trees of archives and mails, with invented values."""

import hashlib
import io
import zipfile
from email.message import EmailMessage

import pytest

from ledgerloom.sources import containers as C
from ledgerloom.sources import layouts as L
from ledgerloom.sources import registry as R

SIGNED = """Demonstrativo de Pagamento de Salário: 03/26 Seg: 7
Empresa: EXEMPLO LTDA
Descrição Referência Descontos Proventos
+ Horas Normais 200.00 R$ 8.000,25
- IRRF 27.50 (R$ 1.200,29)
- INSS 14.00 (R$ 900,07)
- Desc.Vale Alimentação 22.00 (R$ 96,52)
Total (R$ 2.196,88) R$ 8.000,25
Valor líquido a receber: R$ 5.803,37
"""
CODED = "EXEMPLO\nMensalista Março de 2026\n8781 DIAS NORMAIS 31,00 9.000,00\n998 I.N.S.S. 9,88 900,00\n999 IMPOSTO DE RENDA 27,50 1.100,00\n2.000,00\nValor Líquido 7.000,00\n"
BONUS = "Mensalista Dezembro de 2025\nSALARIO INTEGRAL 12,00 6.000,00\nADIANTAMENTO 13 SALARIO 3.000,00\nINSS 13 SALARIO 14,00 600,00\nIRRF 13 SALARIO 15,00 300,00\n"


def test_payslips():
    (a,) = L.signed_payslip(SIGNED)
    assert a == {"mes_ref": "2026-03", "tipo": "Folha Mensal", "bruto": "8000.25", "inss": "900.07", "irrf": "1200.29", "vr_va": "96.52", "liquido": "5803.37"}
    (b,) = L.signed_payslip("Pagamento de Salário: 10/25\n+ 13o Salário Adiantado 6.00 R$ 2.000,00\n")
    assert (b["tipo"], b["liquido"]) == ("13º Adiantamento", "2000.00")
    (c,) = L.coded_payslip(CODED)
    assert [c[k] for k in ("mes_ref", "bruto", "inss", "irrf", "liquido")] == ["2026-03", "9000.00", "900.00", "1100.00", "7000.00"]
    (d,) = L.coded_payslip(BONUS)
    assert (d["tipo"], d["liquido"]) == ("13º Integral", "2100.00")
    for read in (L.signed_payslip, L.coded_payslip, L.printed_invoice):
        with pytest.raises(ValueError):
            list(read("nothing of the kind"))


def test_thermal_receipts():
    text = "CUPOM FISCAL\nSUPERMERCADO X\nARROZ TIPO 1 2 x 10,00 20,00\nLEITE 1 UN X 5,00 6,00\nDEBITO 26,00\nSUBTOTAL 26,00\nTOTAL R$ 26,00\nTROCO 0,00"
    head, *items = L.thermal_receipt(text)
    assert (head["emissor"], head["recall"], head["conferir"], head["itens"]) == ("mercado", "1.0000", "false", "2")
    assert [(i["codigo"], i["descricao"], i["qtde"], i["inconsistente"]) for i in items] == [("SEMCOD0001", "ARROZ TIPO 1", "2", "false"), ("SEMCOD0002", "LEITE", "1", "true")]
    head, *items = L.thermal_receipt("DROGARIA Y\n7890000000001 DIPIRONA GOTAS 12,50\nDEBITO 99,00\nTOTAL 99,00")
    assert (head["emissor"], head["conferir"]) == ("farmacia", "true") and [i["valor_total"] for i in items] == ["12.50"]
    head, *items = L.thermal_receipt("AUTO POSTO\nGASOLINA COMUM 12,345 L x 5,899 72,82\nLAVAGEM 1 UN x 9,00 9,00\nTOTAL 81,82")
    assert [i["descricao"] for i in items] == ["GASOLINA COMUM"] and items[0]["unidade"] == "L" and items[0]["inconsistente"] == "false"
    (head,) = L.thermal_receipt("")
    assert head["recall"] == "0.0000"


def test_dispatch_falls_through_and_tells_of_failures(spark, monkeypatch):
    rows = [("a/x.csv", "date,title,amount\n2026-01-02,Padaria,10\n2026-01-03,\"Posto, Alfa\",20\n"), ("b.csv", "date,title,amount\nonly one"), ("c.pdf", SIGNED), ("d.txt", "Mensalista Foo de 2026\nx"), ("e.bin", "?"), (None, "plain"), ("f.txt", None), ("g.txt", "")]
    files = spark.createDataFrame(rows, "path string, content string").selectExpr("*", "1 as n", "'x' as error")
    got = sorted(((r["path"], r["reader"], r["n"], r["error"]) for r in R.dispatch(files).collect()), key=str)
    assert got == sorted(
        [
            ("a/x.csv", "card_csv", 1, None), ("a/x.csv", "card_csv", 2, None), ("b.csv", "card_csv", None, "ValueError: 1 cells instead of 3"), ("b.csv", None, None, "no reader"), ("c.pdf", "signed_payslip", 1, None),
            ("d.txt", "coded_payslip", None, "ValueError: no month"), ("d.txt", "lines", 1, None), ("d.txt", "lines", 2, None), ("e.bin", None, None, "no reader"), (None, None, None, "no reader"), ("f.txt", None, None, "no reader"),
        ],
        key=str,
    )  # a file that a reader takes and that has no rows has none
    monkeypatch.setenv(R.OFF, "card_csv, signed_payslip")
    off = {(r["path"], r["reader"]) for r in R.dispatch(files).collect()}
    assert ("a/x.csv", None) in off and ("c.pdf", None) in off and ("d.txt", "lines") in off
    broken = R.Reader("broken", lambda p, t: 1 / 0, lambda t: iter(()))
    first = {r["path"]: (r["reader"], r["error"]) for r in R.dispatch(files.limit(1), (broken, *R.READERS[1:])).collect()}
    assert all(e is None or "ZeroDivisionError" in e or e == "no reader" for _, e in first.values())


def test_detection(spark):
    rows = [("/in/pj/a.csv", "date,title,amount\n2026-02-03,x,1"), ("/in/b.csv", "Data,Valor,Identificador,Descrição\n05/11/2025,1,2,conta 070"), ("c.pdf", "Período de visualização: 01/04/2026 até 30/04/2026"), ("d.csv", "other"), ("e.txt", "date,title,amount"), (None, None)]
    got = {r["path"]: tuple(r)[2:] for r in R.detect(spark.createDataFrame(rows, "path string, content string"), "b", [("path", "/pj/", "ana", "pj", 0.9), ("content", "070", "bia", "pf", 0.95)], ("ana", "", 0.5)).collect()}
    assert got == {"/in/pj/a.csv": ("cartao", "ana", "pj", "2026-02", "csv", 0.9), "/in/b.csv": ("cc", "bia", "pf", "2025-11", "csv", 0.95), "c.pdf": ("cc", "ana", "", "2026-04", "pdf", 0.5)}


def zipped(members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return held.getvalue()


def mail(*parts):
    m = EmailMessage()
    m.set_content("text")
    for name, data in parts:
        if isinstance(data, EmailMessage):
            m.add_attachment(data, filename=name)
        else:
            m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m


def test_containers(spark):
    link = zipfile.ZipInfo("shortcut")
    link.external_attr = 0o120777 << 16
    deep = mail(("a.eml", mail(("b.eml", mail(("c.eml", mail(("d.bin", b"deep"))))))))
    files = {
        "x/plain.txt": b"hello", "bomb.zip": zipped([("small", b"1"), ("zeros", b"\0" * 5_000_000), ("after", b"2")]), "odd.zip": zipped([("/etc/x", b"1"), ("a/../../b", b"2"), (link, b"target"), ("ok/y.txt", b"hello")]),
        "nested.zip": zipped([("in.zip", zipped([("y", b"hello")]))]), "three.eml": deep.as_bytes(), "cut.zip": zipped([("z", b"1" * 9000)])[:60], "null": None,
    }
    df = spark.createDataFrame([(p, None if d is None else bytearray(d)) for p, d in files.items()], "path string, content binary").selectExpr("*", "'s' as status")
    got = C.first_copies(C.expand(df, cap=1_000_000)).collect()
    by = {(r["path"], r["member"]): (r["depth"], r["status"], r["size"]) for r in got}
    assert by["x/plain.txt", "plain.txt"] == (0, "ok", 5) and by["null", "null"] == (0, "ok", 0)
    assert by["bomb.zip", "bomb.zip!small"] == (1, "ok", 1) and by["bomb.zip", ""] == (0, "cap", None) and ("bomb.zip", "bomb.zip!after") not in by
    assert {m.split("!")[1]: s for (p, m), (_, s, _) in by.items() if p == "odd.zip"} == {"/etc/x": "unsafe path", "a/../../b": "unsafe path", "shortcut": "link", "ok/y.txt": "ok"}
    assert by["nested.zip", "nested.zip!in.zip!y"] == (2, "ok", 5)
    assert by["three.eml", "three.eml!a.eml!b.eml!c.eml"][1] == "too deep" and not any("d.bin" in m for _, m in by)
    assert any(s.startswith("broken") for (p, _), (_, s, _) in by.items() if p == "cut.zip")
    copies = {r["member"]: r["copy_of"] for r in got if r["sha256"] == hashlib.sha256(b"hello").hexdigest()}
    assert copies == {"nested.zip!in.zip!y": None, "odd.zip!ok/y.txt": "nested.zip!nested.zip!in.zip!y", "plain.txt": "nested.zip!nested.zip!in.zip!y"}


def test_inbox(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.PDF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "sub" / "c.pdf").write_bytes(b"PK\x03\x04 an archive")
    (tmp_path / "sub" / "d.txt").write_bytes(b"text")
    got = {r["name"]: (r["size"], r["sha256"], r["kind"]) for r in C.scan_inbox(spark, str(tmp_path)).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest(), k) for n, b, k in (("a b.PDF", b"%PDF-1.4 x", "pdf"), ("c.pdf", b"PK\x03\x04 an archive", "zip"), ("d.txt", b"text", "txt"))}
