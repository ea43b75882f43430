"""Statement readers: CSV, OFX, statement text, card bills, boletos, invoices (XML) and front matter.

Readers take a path or rows (path, content) of whole files and return ledger-shaped rows; all parsing is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import check_digit_ok, fenced, invoice_key, parse_br
from ledgerloom.schema import EXPENSE, INCOME

#: Titles of refunds, entities of HTML, lines of daily balances.
REFUND = r"(?i)\b(estorno|reembolso)\b"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
BALANCE = r"(?i)SALDO (DO DIA|ANTERIOR|TOTAL)"


def unescape(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _day(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def read_card_csv(spark: SparkSession, path: str) -> DataFrame:
    """``date,title,amount`` lines: absolute values, refunds are income; lines that do not parse are left out."""
    rows = spark.read.schema("date string, title string, amount string").option("header", True).option("mode", "PERMISSIVE").csv(path)
    amount = F.col("amount").try_cast("decimal(18,2)")
    out = rows.select(
        _day(F.col("date"), "yyyy-MM-dd").alias("data"), F.col("title").alias("local"), F.abs(amount).alias("valor"),
        F.when(F.col("title").rlike(REFUND), INCOME).otherwise(EXPENSE).alias("tipo"),
    )
    return out.filter("data is not null and valor is not null")


def read_account_csv(spark: SparkSession, path: str) -> DataFrame:
    """``Data,Valor,Identificador,Descrição`` lines, dd/MM/yyyy; the sign is kept and gives the type."""
    rows = spark.read.schema("d string, v string, identificador string, descricao string").option("header", True).option("enforceSchema", True).csv(path)
    out = rows.select(_day(F.col("d"), "dd/MM/yyyy").alias("data"), F.col("v").try_cast("decimal(18,2)").alias("valor"), "identificador", unescape(F.trim("descricao")).alias("descricao"))
    return out.filter("data is not null and valor is not null").withColumn("tipo", F.when(F.col("valor") > 0, INCOME).otherwise(EXPENSE))


def parse_ofx(files: DataFrame, banks: dict[str, str]) -> DataFrame:
    """(content) of OFX files -> one row a transaction of any account.

    Text: memo, else payee, else name; identifier: FITID, else a hash; the bank by a part of ORG.
    """
    field = lambda block, name: F.nullif(F.trim(F.regexp_extract(block, rf"<{name}>([^<\r\n]*)", 1)), F.lit(""))
    org = F.upper(F.regexp_extract("content", r"<ORG>([^<\r\n]*)", 1))
    bank = F.lit("Outro")
    for part, name in reversed(banks.items()):
        bank = F.when(org.contains(part.upper()), name).otherwise(bank)
    t = files.select(bank.alias("banco_origem"), F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))).alias("b"))
    b = F.col("b")
    out = t.select(
        "banco_origem", _day(F.substring(field(b, "DTPOSTED"), 1, 8), "yyyyMMdd").alias("data"), field(b, "TRNAMT").try_cast("decimal(18,2)").alias("valor"),
        F.coalesce(field(b, "MEMO"), field(b, "PAYEE"), field(b, "NAME"), F.lit("Transação OFX")).alias("descricao"), field(b, "FITID").alias("fitid"),
    ).filter("data is not null and valor is not null")
    hashed = F.substring(F.sha2(F.concat_ws("|", F.col("data").cast("string"), "descricao", F.col("valor").cast("string")), 256), 1, 16)
    return out.withColumns({"identificador": F.coalesce("fitid", hashed), "tipo": F.when(F.col("valor") > 0, INCOME).otherwise(EXPENSE)}).drop("fitid")


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line"))


def parse_statement_text(files: DataFrame) -> DataFrame:
    """``dd/MM/yyyy TEXT value`` lines without those of daily balances."""
    pattern = r"^\s*(\d{2}/\d{2}/\d{4})\s+(.+?)\s+(-?[\d.]+,\d{2})\s*$"
    found = lines(files).filter(F.col("line").rlike(pattern) & ~F.col("line").rlike(BALANCE))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return found.select("path", "n", _day(part(1), "dd/MM/yyyy").alias("data"), part(2).alias("local"), parse_br(part(3)).alias("valor"))


def parse_card_bill(files: DataFrame, detail: str, summary: str) -> DataFrame:
    """Detail lines ``dd/MM TEXT [nn/nn] value`` of card bills (path, content, vencimento).

    The last header above a line of the same text (``detail`` or ``summary``) says whether it counts, also where several
    texts have one path; instalments are taken out of the text; months after the due month belong to the year before.
    """
    kind = lambda x: F.when(x.contains(detail), "detail").when(x.contains(summary), "summary")
    rows = fenced(files.select("path", "vencimento", F.split("content", r"\r?\n").alias("lines")))
    heads = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), kind(x).alias("kind"))), lambda h: h["kind"].isNotNull())
    rows = fenced(rows.withColumn("heads", heads))
    # from each header to the next one, which needs no window over the lines
    end = lambda i: F.coalesce(F.get("heads", i + 1)["at"], F.size("lines"))
    parts = F.transform("heads", lambda h, i: F.struct(h["kind"].alias("kind"), h["at"].alias("at"), F.slice("lines", h["at"] + 1, end(i) - h["at"]).alias("part")))
    rows = rows.select("path", "vencimento", F.explode(F.filter(parts, lambda p: p["kind"] == "detail")).alias("p"))
    rows = rows.select("path", "vencimento", "p.at", F.posexplode("p.part").alias("i", "line")).withColumn("n", F.col("at") + F.col("i"))
    pattern = r"^\s*(\d{2})/(\d{2})\s+(.+?)(?:\s+(\d{2}/\d{2}))?\s+(-?[\d.]+,\d{2})\s*$"
    rows = rows.filter(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    due, month = F.col("vencimento"), part(2).cast("int")
    year = F.when(month <= F.month(due), F.year(due)).otherwise(F.year(due) - 1)
    day = _day(F.concat_ws("-", year.cast("string"), part(2), part(1)), "yyyy-MM-dd")
    return rows.select("path", "n", day.alias("data"), part(3).alias("local"), F.nullif(part(4), F.lit("")).alias("parcela"), parse_br(part(5)).alias("valor"))


def parse_boleto(files: DataFrame) -> DataFrame:
    """Digit line (47 digits), value (of the document, else charged, else in the line's last ten digits) and due date."""
    line = F.regexp_replace(F.regexp_extract("content", r"(\d{5}\.?\d{5}\s?\d{5}\.?\d{6}\s?\d{5}\.?\d{6}\s?\d\s?\d{14})", 1), r"[^0-9]", "")
    amount = lambda label: parse_br(F.regexp_extract("content", rf"(?i){label}\D{{0,20}}([\d.]+,\d{{2}})", 1))
    coded = (F.substring(line, 38, 10).try_cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    return files.select(
        "path", F.nullif(line, F.lit("")).alias("linha_digitavel"), F.coalesce(amount("valor do documento"), amount("valor cobrado"), coded).alias("valor"),
        _day(F.regexp_extract("content", r"(?i)vencimento\D{0,20}(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy").alias("vencimento"),
    )


#: The parts of an invoice's tree that are read, below the root of a processed one or as the root itself, with the answers and events around it.
_HEAD = """_Id: string, ide: struct<dhEmi: string, dEmi: string>, emit: struct<CNPJ: string, xNome: string>, total: struct<ICMSTot: struct<vNF: string>>"""
_ITEMS = """det: array<struct<_nItem: string, prod: struct<cProd: string, xProd: string, qCom: string, vProd: string>,
 imposto: struct<ICMS: map<string, struct<vICMS: string>>, IPI: map<string, struct<vIPI: string>>, PIS: map<string, struct<vPIS: string>>, COFINS: map<string, struct<vCOFINS: string>>>>>"""
_STATE = "struct<infEvento: struct<tpEvento: string, cStat: string>>"
_AROUND = f"chNFe string, protNFe struct<infProt: struct<chNFe: string, cStat: string>>, evento {_STATE}, retEvento {_STATE}, cStat string"


def nfe_trees(files: DataFrame, invoice: str = f"{_HEAD}, {_ITEMS}") -> DataFrame:
    """(path, nota, x): each file's XML in one structured pass, whatever its prefixes; ``nota`` is the invoice in it.

    Entities and CDATA are text, comments are nothing; a file that is not well-formed has nulls. The fence keeps it one
    pass: each use of the tree would else parse the file again.
    """
    fields = f"NFe struct<infNFe: struct<{invoice}>>, infNFe struct<{invoice}>, {_AROUND}"
    tree = files.select("path", F.from_xml("content", fields, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x"))
    return fenced(tree).select("path", F.coalesce("x.NFe.infNFe", "x.infNFe").alias("nota"), "x")


def parse_nfe(files: DataFrame) -> DataFrame:
    """Headers of invoices (path, content as XML): model 55 with a valid 44-digit key; cancelled ones are marked."""
    rows = nfe_trees(files, _HEAD).withColumn("chave", invoice_key(F.coalesce("x.protNFe.infProt.chNFe", "x.chNFe", "nota._Id")))
    rows = rows.filter(F.col("chave").isNotNull()).filter(check_digit_ok(F.col("chave")) & (F.substring("chave", 21, 2) == "55"))
    states = F.array("x.protNFe.infProt.cStat", "x.retEvento.infEvento.cStat", "x.cStat")
    events = F.array("x.evento.infEvento.tpEvento", "x.retEvento.infEvento.tpEvento")
    cancelled = F.exists(states, lambda c: c.isin("101", "135")) | F.array_contains(events, "110111")
    own = F.nullif(F.regexp_replace("nota.emit.CNPJ", r"\D", ""), F.lit(""))
    return rows.select(
        "path", "chave", F.coalesce(own, F.substring("chave", 7, 14)).alias("cnpj_emitente"), F.nullif(F.trim("nota.emit.xNome"), F.lit("")).alias("razao_social"),
        F.to_date(F.substring(F.coalesce("nota.ide.dhEmi", "nota.ide.dEmi"), 1, 10)).alias("data_emissao"), F.col("nota.total.ICMSTot.vNF").try_cast("decimal(18,2)").alias("total"),
        F.coalesce(cancelled, F.lit(False)).alias("cancelada"),
    )


def parse_nfe_items(files: DataFrame) -> DataFrame:
    """(path, item, codigo, descricao, qtde, valor_total, icms, ipi, pis, cofins): each item by itself, taxes of any kind, 0 without."""
    items = nfe_trees(files, _ITEMS).select("path", F.posexplode("nota.det").alias("item", "i"))

    def tax(name: str, field: str) -> Column:
        kinds = F.transform(F.map_values(F.col(f"i.imposto.{name}")), lambda v: v[field].try_cast("decimal(18,2)"))
        return F.coalesce(F.try_element_at(F.filter(kinds, lambda v: v.isNotNull()), F.lit(1)), F.lit(0).cast("decimal(18,2)"))

    return items.select(
        "path", (F.col("item") + 1).alias("item"), "i.prod.cProd", "i.prod.xProd", F.col("i.prod.qCom").try_cast("decimal(18,4)").alias("qtde"), F.col("i.prod.vProd").try_cast("decimal(18,2)").alias("valor_total"),
        *[tax(n, f).alias(n.lower()) for n, f in (("ICMS", "vICMS"), ("IPI", "vIPI"), ("PIS", "vPIS"), ("COFINS", "vCOFINS"))],
    ).withColumnsRenamed({"cProd": "codigo", "xProd": "descricao"})


def front_matter(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, campos map<string, string>): flat ``key: value`` lines between two ``---`` lines, null without."""
    block = F.regexp_extract("content", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\w+:\s*\S"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), F.trim(F.regexp_extract(x, r"^\w+:\s*(.*)$", 1))))
    return files.select("path", F.when(block != "", F.map_from_entries(entries)).alias("campos"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of all text files below a folder, without copies named `` (1)`` or `` (2)``."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = rows.select(F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
    return rows.filter(~F.col("path").rlike(r" \([12]\)\.[^.]+$"))
