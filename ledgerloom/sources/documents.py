"""Readers of document texts (path, content): bills, invoices, receipts, payslips, tax slips, prescriptions, warranties.

A text comes from a text layer or an external reader; all parsing is native. Texts that lack what makes their kind are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.conform import Couple, of_couple
from ledgerloom.functions.expressions import parse_br
from ledgerloom.functions.identifiers import months_of
from ledgerloom.schema import EXPENSE, INCOME, TRANSFER

MONEY = r"([0-9][0-9.]*,[0-9]{2})"


def group(text: Column, pattern: str, i: int = 1) -> Column:
    """The group of the first match, null without a match or where it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def every(text: Column, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(i))


def summed(values: Column) -> Column:
    """The sum of an array of Brazilian numbers; what is no number counts 0."""
    zero = F.lit(0).cast("decimal(28,2)")
    return F.aggregate(values, zero, lambda s, x: (s + F.coalesce(parse_br(x), zero)).cast("decimal(28,2)"))


def month_ref(text: Column) -> Column:
    """MM/YYYY or MM/YY as YYYY-MM."""
    pattern = r"\b(0[1-9]|1[0-2])/((?:[0-9]{2})?[0-9]{2})\b"
    year = group(text, pattern, 2)
    return F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), group(text, pattern))


# ---- statements


def account_value(entry: Column, exit_: Column) -> Column:
    """Signed value of a statement with entry and exit columns; null where both are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.when(zero(entry) > 0, entry).when(zero(exit_) > 0, -exit_)


def card_value(brl: Column, usd: Column, rate: Column) -> Column:
    """Value in the own currency, else the foreign one by its rate, else the foreign one as it is; 0 without either."""
    some = lambda c: F.coalesce(c, F.lit(0)) != 0
    return F.when(some(brl), brl).when(some(usd) & some(rate), F.round(usd * rate, 2)).when(some(usd), usd).otherwise(F.lit(0)).cast("decimal(18,2)")


def mirrors(rows: DataFrame, payment: Column) -> DataFrame:
    """Card rows, and for each invoice payment among them a virtual row that mirrors it as a transfer."""
    own = rows.withColumns({"tipo": F.when(payment, TRANSFER).otherwise(EXPENSE), "virtual": F.lit(False)})
    return own.unionByName(own.filter(payment).withColumns({"tipo": F.lit(TRANSFER), "virtual": F.lit(True)}))


def typed(text: Column, value: Column, couple: Couple, order: list[tuple[str, str]], couple_at: int) -> Column:
    """A statement's type: the first of (pattern, type) that matches, the couple's names at a place among them, else the sign."""
    tests = [(text.rlike("(?i)" + p), t) for p, t in order]
    tests.insert(couple_at, (of_couple(text, couple), TRANSFER))
    out = None
    for c, t in tests:
        out = F.when(c, t) if out is None else out.when(c, t)
    return out.otherwise(F.when(value > 0, INCOME).otherwise(EXPENSE))


def bill_line(line: Column) -> Column:
    """array<struct<dia, texto, parcela, moeda, valor>> of a bill's line: instalments, then foreign, then own amounts.

    What one pattern has taken is cut out before the next one looks, so no part counts twice.
    """
    kinds = (("parcela", r"(\d{2}/\d{2}) ([^\d/]+?) (\d{2}/\d{2}) " + MONEY), ("usd", r"(\d{2}/\d{2}) ([^\d/]+?) US()\$ " + MONEY), ("brl", r"(\d{2}/\d{2}) ([^\d/]+?)() " + MONEY))
    rest, out = line, []
    for kind, pattern in kinds:
        part = [every(rest, pattern, i) for i in range(1, 5)]
        zipped = F.arrays_zip(part[0].alias("d"), part[1].alias("t"), part[2].alias("p"), part[3].alias("v"))
        currency = F.lit("USD" if kind == "usd" else "BRL").alias("moeda")
        out.append(F.transform(zipped, lambda x: F.struct(x["d"].alias("dia"), F.trim(x["t"]).alias("texto"), F.nullif(x["p"], F.lit("")).alias("parcela"), currency, parse_br(x["v"]).alias("valor"))))  # noqa: B023
        rest = F.regexp_replace(rest, pattern, " | ")
    return F.concat(*out)


# ---- lines and words


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def words_of(line: Column) -> Column:
    return F.split(line, r"\s+")


def first_where(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def is_amount(word: Column) -> Column:
    return word.rlike(r"^[0-9][0-9.]*,[0-9]{2}$")


def numbered_lines(texts: DataFrame, *key: str) -> DataFrame:
    """(key..., n, line, words): one row a line."""
    lines = texts.select(*key, F.posexplode(lines_of(F.col("content"))).alias("n", "line"))
    return lines.withColumn("words", words_of(F.col("line")))


def energy_blocks(files: DataFrame) -> DataFrame:
    """(path, mes, ano, kwh, valor) of each month of an energy bill's text; a month without its date or value is none.

    Each line is a label or has a value: a line ``Mês`` begins a block, and of its lines the first one with a month, with a number
    before ``kWh`` and with an amount count. Without consumption it is 0.
    """
    label = F.lower("line").isin("mês", "mes")
    lines = numbered_lines(files, "path").withColumn("block", F.sum(label.cast("int")).over(Window.partitionBy("path").orderBy("n"))).filter("block > 0")
    month = first_where(F.col("words"), lambda w: w.rlike(r"^[0-9]{2}/[0-9]{4}$"))
    units = F.transform("words", lambda w: F.lower(w))
    used = F.when(F.array_position(units, "kwh") > 1, F.get("words", (F.array_position(units, "kwh") - 2).cast("int"))).otherwise(F.regexp_replace(first_where(units, lambda w: w.rlike("^[0-9]+kwh$")), "kwh", ""))
    amount = first_where(F.transform("words", lambda w: F.regexp_replace(w, r"^R[$]", "")), is_amount)
    marked = lines.select("path", "block", "n", month.alias("month"), used.try_cast("int").alias("kwh"), amount.alias("amount"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    blocks = marked.groupBy("path", "block").agg(first("month"), first("kwh"), first("amount")).filter("month is not null and amount is not null")
    return blocks.select("path", F.substring("month", 1, 2).cast("int").alias("mes"), F.substring("month", 4, 4).cast("int").alias("ano"), F.coalesce("kwh", F.lit(0)).alias("kwh"), parse_br(F.col("amount")).alias("valor"))


# ---- invoices and receipts

MARKERS = (r"NFC-?e", r"CONSUMIDOR", r"CHAVE DE ACESSO")


def split_invoices(files: DataFrame, mark: str, markers: tuple[str, ...] = MARKERS, least: int = 2) -> DataFrame:
    """(path, nota, content): one row for each invoice of a text, which begins at ``mark`` and holds enough markers."""
    parts = files.select("path", F.posexplode(F.split("content", rf"(?={mark})")).alias("n", "content"))
    hits = sum((F.col("content").rlike("(?iu)" + m).cast("int") for m in markers), F.lit(0))
    return parts.filter(F.col("content").rlike(mark) & (hits >= least)).select("path", F.col("n").alias("nota"), "content")


def invoice_head(content: Column) -> list[Column]:
    """Key, number, day and total of a consumer's invoice, each from the line that is made of it.

    The key's line has 44 digits and blanks; the number is the first one of the line that names the kind; the day stands before
    a time; the total ends the first line that begins with what is to be paid.
    """
    lines = lines_of(content)
    digits = F.transform(lines, lambda x: F.regexp_replace(x, r"\s", ""))
    kind = words_of(first_where(lines, lambda x: F.upper(x).startswith("NFC")))
    timed = words_of(first_where(lines, lambda x: F.exists(words_of(x), lambda w: w.rlike(r"^[0-9]{1,2}:[0-9]{2}")) & F.exists(words_of(x), lambda w: w.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"))))
    paid = words_of(first_where(lines, lambda x: F.regexp_replace(F.upper(x), r"\s+", " ").rlike("^VALOR (TOTAL|A PAGAR)")))
    day = first_where(timed, lambda w: w.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"))
    amounts = F.filter(F.transform(paid, lambda w: F.regexp_replace(w, r"^R[$]", "")), is_amount)
    return [
        first_where(digits, lambda x: x.rlike("^[0-9]{44}$")).alias("chave"), first_where(kind, lambda w: w.rlike("^[0-9]{1,9}$")).alias("numero"),
        F.try_to_timestamp(day, F.lit("dd/MM/yyyy")).cast("date").alias("data"), parse_br(F.try_element_at(amounts, F.lit(-1))).alias("total"),
    ]


def invoice_items(rows: DataFrame) -> DataFrame:
    """(path, nota, item, codigo, descricao, qtde, valor): the item lines between ``ITENS`` and the totals.

    A line is read from its right end: amount, price (a sign of times before it is skipped), unit, quantity; the first word is the
    code and what is left the description. A line that is none goes on with the description above it.
    """
    own = Window.partitionBy("path", "nota").orderBy("n")
    lines = numbered_lines(rows, "path", "nota")
    lines = lines.withColumns({"began": F.max(F.upper("line").startswith("ITENS").cast("int")).over(own), "ended": F.max(F.upper("line").rlike(r"^(QTD\. TOTAL|VALOR)").cast("int")).over(own)})
    lines = lines.filter((F.col("began") == 1) & (F.col("ended") == 0) & ~F.upper("line").startswith("ITENS"))
    w = F.when(F.lower(F.try_element_at("words", F.lit(-3))) == "x", F.concat(F.slice("words", 1, F.size("words") - 3), F.slice("words", -2, 2))).otherwise(F.col("words"))
    lines = lines.withColumn("w", w)
    end = lambda i: F.try_element_at("w", F.lit(-i))
    is_item = F.coalesce(
        (F.size("w") >= 6) & is_amount(end(1)) & is_amount(end(2)) & end(3).rlike("^[A-Za-z]{1,5}$") & end(4).rlike("^[0-9]+([.,][0-9]+)?$") & F.get("w", F.lit(0)).rlike("^[0-9][0-9A-Za-z]{5,14}$"), F.lit(False))
    lines = lines.withColumn("is_item", is_item).withColumn("item", F.sum(F.col("is_item").cast("int")).over(own)).filter("item > 0")
    text = F.when(F.col("is_item"), F.concat_ws(" ", F.slice("w", 2, F.size("w") - 5))).otherwise(F.concat_ws(" ", "words"))
    only = lambda c: F.max(F.when(F.col("is_item"), c))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), " ")
    items = lines.groupBy("path", "nota", "item").agg(only(F.get("w", F.lit(0))).alias("codigo"), whole.alias("descricao"), only(end(4)).alias("q"), only(end(1)).alias("v"))
    return items.select("path", "nota", F.col("item").cast("int").alias("item"), "codigo", "descricao", F.replace("q", F.lit(","), F.lit(".")).try_cast("decimal(18,3)").alias("qtde"), parse_br(F.col("v")).alias("valor"))


def receipt_layout(content: Column, layouts: list[tuple[str, str, dict[str, str]]]) -> tuple[Column, Column, dict[str, Column]]:
    """Name of the first layout whose mark the text holds, the share of its fields that were found, and the fields."""
    names = sorted({f for _, _, fields in layouts for f in fields})
    name, share, found = F.lit(None).cast("string"), F.lit(0.0), {f: F.lit(None).cast("string") for f in names}
    for n, mark, fields in reversed(layouts):
        hit = F.coalesce(content.rlike("(?i)" + mark), F.lit(False))
        got = sum((group(content, p).isNotNull().cast("double") for p in fields.values()), F.lit(0.0)) / max(1, len(fields))
        name, share = F.when(hit, n).otherwise(name), F.when(hit, got).otherwise(share)
        found = {f: F.when(hit, group(content, fields[f]) if f in fields else F.lit(None)).otherwise(c) for f, c in found.items()}
    return name, F.round(share, 4), found


# ---- payslips and tax


def payslip(files: DataFrame) -> DataFrame:
    """Payslips with ``P`` (paid) and ``D`` (deducted) lines: month, gross, deductions by kind, net.

    Net is what the slip says, else gross less deductions. A text without a month is no payslip.
    """
    c = F.col("content")
    paid = every(c, r"(?m)^P\s+(.+?)\s+" + MONEY + r"\s*$", 2)
    names = every(c, r"(?m)^P\s+(.+?)\s+" + MONEY + r"\s*$", 1)
    of = lambda kind: summed(every(c, rf"(?im)^D\s+[^\n]*?(?:{kind})[^\n]*?\s+{MONEY}\s*$", 1))
    kind = F.when(F.exists(names, lambda n: n.rlike("13.*Adiantado")), "13º Adiantamento").when(F.exists(names, lambda n: n.rlike("13.*Integral")), "13º Integral").otherwise("Folha Mensal")
    rows = files.select("path", F.nullif(month_ref(F.regexp_extract(c, r"(?imu)^Refer[eê]ncia:\s*(\S+)", 1)), F.lit("")).alias("mes_ref"), kind.alias("tipo"), summed(paid).alias("bruto"), of("INSS").alias("inss"), of("IRRF").alias("irrf"), of("VALE ALIMENTA|VALE REFEI").alias("vr_va"), parse_br(group(c, r"(?imu)^L[ií]quido:?\s+" + MONEY)).alias("l"))
    net = F.when(F.coalesce("l", F.lit(0)) != 0, F.col("l")).otherwise(F.col("bruto") - F.col("inss") - F.col("irrf") - F.col("vr_va"))
    return rows.filter("mes_ref is not null").select("path", "mes_ref", "tipo", "bruto", "inss", "irrf", "vr_va", net.cast("decimal(28,2)").alias("liquido"))


def without_copies(files: DataFrame) -> DataFrame:
    """Files whose name is not that of a downloaded copy, as in ``x (1).pdf``."""
    return files.filter(~F.col("path").rlike(r" \([12]\)\.[^.]+$"))


def tax_slip(files: DataFrame) -> DataFrame:
    """Tax slips: number, due date, principal, fine and interest summed over the composition, total, distinct months."""
    c = F.col("content")
    line = r"(?m)^(\d{4})\s+(.+?)\s+(\d{2}/\d{4})\s+" + MONEY + r"\s+" + MONEY + r"\s+" + MONEY + r"\s*$"
    col = lambda i: summed(every(c, line, i))
    return files.filter(c.rlike("(?i)documento de arrecada")).select(
        "path", group(c, r"(?i)n[uú]mero:?\s*([\d.-]+)").alias("numero"), F.try_to_timestamp(group(c, r"(?i)vencimento:?\s*(\d{2}/\d{2}/\d{4})"), F.lit("dd/MM/yyyy")).cast("date").alias("vencimento"),
        col(4).alias("principal"), col(5).alias("multa"), col(6).alias("juros"), (col(4) + col(5) + col(6)).cast("decimal(28,2)").alias("total"), F.size(F.array_distinct(every(c, line, 3))).alias("meses"))


def tax_return(files: DataFrame) -> DataFrame:
    """Header of a tax return: years, personal id and name at fixed places; a file named RETIF corrects an earlier one."""
    c = F.col("content")
    head = r"^IRPF\s+(\d{4})(\d{4})(\d{4})(\d{11})(.{60})"
    rows = files.filter(c.rlike("(?s)" + head))
    part = lambda i: F.regexp_extract(c, head, i)
    corrected = F.upper("path").contains("RETIF")
    key = F.concat(F.lit("DIRPF|"), part(4), F.lit("|"), part(2), F.when(corrected, "_RETIF").otherwise(""))
    return rows.select("path", part(1).alias("exercicio"), part(2).alias("ano_base"), part(4).alias("cpf"), F.trim(part(5)).alias("nome"), key.alias("chave"), corrected.alias("retificadora")).filter("nome <> ''")


# ---- health and warranties


def prescription(files: DataFrame, catalogue: dict[str, str]) -> DataFrame:
    """(path, registro, data, meses, medicamento, principio): one row a medicine, its active ingredient by the catalogue."""
    c = F.col("content")
    rows = files.filter(c.rlike(r"(?i)\bCRM\b")).select(
        "path", group(c, r"(?i)\bCRM\W{0,3}(\d{3,7})").alias("registro"), F.try_to_timestamp(group(c, r"(\d{2}/\d{2}/\d{4})"), F.lit("dd/MM/yyyy")).cast("date").alias("data"),
        F.coalesce(group(c, r"(?i)validade\D{0,10}(\d+)\s+m[eê]s").try_cast("int"), F.lit(1)).alias("meses"), F.explode(every(c, r"(?m)^\s*\d+[.)]\s*(.+?)\s*$")).alias("medicamento"))
    known = F.lit(None).cast("string")
    for name, ingredient in catalogue.items():
        known = F.when(F.lower("medicamento").contains(name.lower()), ingredient).otherwise(known)
    return rows.withColumn("principio", known)


def warranty(files: DataFrame) -> DataFrame:
    """Warranties: months, since when, who stands for them (the maker or the shop), until when."""
    c = F.col("content")
    rows = files.filter(c.rlike("(?i)garantia")).select("path", months_of(c).alias("meses"), F.try_to_timestamp(group(c, r"(\d{2}/\d{2}/\d{4})"), F.lit("dd/MM/yyyy")).cast("date").alias("inicio"), F.when(c.rlike("(?i)fabricante"), "fabricante").otherwise("varejo").alias("origem"))
    return rows.filter("meses is not null").withColumn("fim", F.add_months("inicio", F.col("meses")))


def split_policies(files: DataFrame) -> DataFrame:
    """(path, bilhete, premio, vigencia) of extended-warranty bills, several in a text; at least two of three markers."""
    parts = split_invoices(files, r"BILHETE N", (r"SEGURO", r"VIG[EÊ]NCIA", r"PR[EÊ]MIO"))
    c = F.col("content")
    return parts.select("path", group(c, r"BILHETE N\S*\s*(\d+)").alias("bilhete"), parse_br(group(c, r"(?iu)pr[eê]mio\D{0,10}" + MONEY)).alias("premio"), group(c, r"(?iu)vig[eê]ncia\D{0,5}(\d{2}/\d{2}/\d{4})").alias("vigencia"))


def cached_results(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, sha) with their external result (sha, resultado), and the requests for those that have none, each once."""
    joined = files.join(cache, "sha", "left")
    return joined.filter("resultado is not null"), joined.filter("resultado is null").select("sha").distinct()


def history_rows(rows: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Old records: rows without date or value go, classes are mapped, values are absolute."""
    mapped = F.col("classificacao")
    for old, new in classes.items():
        mapped = F.when(F.lower("classificacao") == old, new).otherwise(mapped)
    return rows.filter("data is not null and valor is not null").withColumns({"classificacao": mapped, "valor": F.abs("valor")})


def detected(header: Column) -> tuple[Column, Column]:
    """Bank and kind of a CSV file by its header line; null where none is known."""
    known = (("nubank", "cartao", r"^date,title,amount"), ("nubank", "conta", r"^Data,Valor,Identificador"), ("c6", "conta", r"(?i)entrada.*sa[ií]da"), ("itau", "conta", r"(?i)^lan[cç]amento"))
    bank, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for b, k, pattern in reversed(known):
        hit = header.rlike(pattern)
        bank, kind = F.when(hit, b).otherwise(bank), F.when(hit, k).otherwise(kind)
    return bank, kind


#: Endings of files that are read.
ENDINGS = ("csv", "xlsx", "xls", "pdf", "ofx", "xml", "png", "jpg", "jpeg", "heic", "zip", "eml")


def scan(files: DataFrame) -> DataFrame:
    """Files (path) of a known ending that are no downloaded copies."""
    return without_copies(files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*ENDINGS)))
