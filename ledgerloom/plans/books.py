"""Raw statement rows and overlapping books made from the ledger view, in expressions that Spark and DuckDB read alike.

``raw`` turns each ledger row into a bank's statement line (24 kinds of description); ``books`` adds to the ledger
what several sources of the same bank would: old records, sheet twins, texts with a bank's prefix, mirrors of card
payments, incoming sides of transfers and repeated identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.functions.conform import Couple, Variant
from ledgerloom.schema import INCOME, TRANSFER

from .ledger import SQL as LEDGER
from .ledger import ledger

COUPLE = Couple(
    names=("MARIA SILVA SOUZA", "JOAO PEREIRA"), ids=("111.222.333-44", "000"),
    variants=(Variant(("Itaú", "C6", "Nubank"), ("MARIA", "SOUZA", "SILVA"), 2, ("TRANSF", "PIX"), True), Variant(("Santander",), ("JOAO",))),
)
COMPANIES = {"AMERICANAS S A": "Americanas S.A.", "SUPERMERCADO CENTRAL": "Supermercado Central", "SUPERMERCADO": "Mercado"}
WORDS = {"SAO": "São", "JOAO": "João", "FARMACIA": "Farmácia", "ELETRICA": "Elétrica"}

K = "identificador"
TEXTS = [
    "'Transferência enviada pelo Pix - ' || local || ' - 123.456.789-00 - BANCO'", "'Compra no débito - ' || local", "'Transferência Recebida - ' || local || ' 11222333000144 - BANCO'",
    "local || ' - Parcela 2/10'", "'PAGAMENTO  DE FATURA'", "'RESGATE RDB'", "'DARF RECEITA FED ' || local", "'PAGTO SALARIO ' || local", "'IOF POR FATURA'",
    "'Pix Maria Silva Souza &amp; filhos'", "'TED 111.222.333-44 transferência'", "'MARIA SOUZA 12/05 TRANSF'", "'  PADARIA SAO JOAO SA '", "'BOLETO ENERGIA ELETRICA'",
    "'12.345.678/0001-95'", "'deadbeefdeadbeef01'", "'CDB C6 LIM. GARANT'", "'REEMBOLSO ' || local", "'JUROS  POR FATURA ' || local",
    "'SUPERMERCADO CENTRAL S A 0123456789 0123456789 0123456789 0123456789 0123456789'", "'AMERICANAS S A LOJA ' || local", "'FARMÁCIA POPULAR 99,90'", "'joao 3 X'", "local",
]


def _case(test: str, values: list[str], other: str = "NULL") -> str:
    return f"CASE {test} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


RAW = {
    "identificador": f"CASE WHEN {K} % 10 <> 0 THEN {K} END", "ordem": K, "data": "data", "valor": f"CASE WHEN {K} % 2 = 0 THEN valor ELSE -valor END",
    "descricao": _case(f"{K} % 24", TEXTS), "banco_origem": _case(f"{K} % 9", ["'Itaú'", "'C6'", "'Santander'", "'Nubank (PF)'", "'Nubank (PJ)'", "'Nubank'", "'Histórico'", "''"], "banco_origem"),
    "extrato": f"CASE WHEN {K} % 5 = 0 THEN 'cartao' WHEN {K} % 5 = 1 THEN 'outro' ELSE 'cc' END", "arquivo": _case(f"{K} % 7", ["'/in/pj/a.ofx'", "'/in/pf/pj/b.xlsx'", "'/in/pf/c.csv'"], "'/in/d.pdf'"),
    "sugerido": _case(f"{K} % 4", ["'Receita'", "'Despesa'", "'outro'"]), "virtual": f"{K} % 31 = 0",
}
BOOKS = [
    ("TRUE", {"identificador": K, "ordem": f"{K} * 10", "local": f"CASE WHEN {K} % 6 = 0 THEN 'Pix Maria Silva Souza' ELSE local END", "arquivo": f"CASE WHEN {K} % 3 = 0 THEN '/in/A.OFX' ELSE '/in/b.csv' END"}),
    (f"{K} % 4 = 0", {"ordem": f"{K} * 10 + 1", "valor": f"CASE WHEN {K} % 8 = 0 THEN CAST(valor + 1 AS DECIMAL(18,2)) ELSE valor END", "local": "'Banco - ' || local", "banco_origem": "'Histórico'"}),
    (f"{K} % 3 = 0", {"identificador": f"{K} + 1000000000000", "ordem": f"{K} * 10 + 2", "local": "'TRANSF ENVIADA PIX'", "arquivo": "'/in/b.xlsx'"}),
    (f"{K} % 5 = 0", {"ordem": f"{K} * 10 + 3", "local": "'X - ' || upper(local)", "descricao": "'texto longo ' || local", "arquivo": "'/in/c.pdf'"}),
    (f"{K} % 7 = 0", {"ordem": f"{K} * 10 + 4", "quem": "'ESPELHO'", "tipo": f"'{TRANSFER}'", "arquivo": "'/in/d.xls'", "virtual": "TRUE"}),
    (f"{K} % 6 = 0", {"ordem": f"{K} * 10 + 5", "local": "'recebido'", "quem": "'OUTRA'", "tipo": f"'{INCOME}'"}),
    (f"{K} % 9 = 0", {"identificador": K, "ordem": f"{K} * 10 + 6"}),
]
DEFAULTS = {
    "identificador": "CAST(NULL AS BIGINT)", "ordem": "0", "data": "data", "valor": "valor", "local": "local", "descricao": "CAST(NULL AS STRING)", "quem": "quem",
    "banco_origem": f"CASE WHEN {K} % 13 = 0 THEN '' ELSE banco_origem END", "tipo": "tipo", "arquivo": "CAST(NULL AS STRING)", "virtual": "FALSE",
}
COLUMNS = list(DEFAULTS)


def _items(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


RAW_SQL = f"{LEDGER}, raw AS (SELECT {', '.join(_items(RAW))} FROM ledger)"
BOOKS_SQL = f"{LEDGER}, books AS (" + " UNION ALL ".join(f"SELECT {', '.join(_items(DEFAULTS | c))} FROM ledger WHERE {w}" for w, c in BOOKS) + ")"


def raw(spark, d) -> DataFrame:
    return ledger(spark, d).selectExpr(*_items(RAW))


def books(spark, d) -> DataFrame:
    rows, out = ledger(spark, d), None
    for where, columns in BOOKS:
        part = rows.filter(where).selectExpr(*_items(DEFAULTS | columns))
        out = part if out is None else out.unionByName(part)
    return out
