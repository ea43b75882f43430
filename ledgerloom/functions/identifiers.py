"""Identifiers, kinds and readings of document texts: Column -> Column, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import parse_br

#: Leading bytes (hex) of file kinds, and kinds by name ending.
MAGIC = (("25504446", "application/pdf"), ("504B0304", "application/zip"), ("FFD8FF", "image/jpeg"), ("89504E47", "image/png"))
ENDINGS = (("csv", "text/csv"), ("ofx", "application/x-ofx"), ("xml", "application/xml"), ("eml", "message/rfc822"), ("txt", "text/plain"))
COMPANY = r"([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/[0-9]{4}-?[0-9]{2})"
PERSON = r"\b([0-9]{3} ?\. ?[0-9]{3} ?\. ?[0-9]{3} ?- ?[0-9]{2})\b"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def company_ids(text: Column) -> Column:
    """All company ids of a text, digits only: those after the label first, then by appearance, each once."""
    labelled = F.regexp_extract_all(text, F.lit(r"(?i)CNPJ\W{0,3}" + COMPANY), F.lit(1))
    every = F.regexp_extract_all(text, F.lit(COMPANY), F.lit(1))
    return F.array_distinct(F.transform(F.concat(labelled, every), digits))


def person_id(text: Column) -> Column:
    """The first person id, also with spaces inside; null without."""
    return F.nullif(digits(F.regexp_extract(text, PERSON, 1)), F.lit(""))


def invoice_key_of(text: Column) -> Column:
    """The first 44 digits, in one piece or in groups of four; null without."""
    found = F.regexp_extract(text, r"(?<![0-9])((?:[0-9]{4} ?){10}[0-9]{4})(?![0-9])", 1)
    return F.nullif(digits(found), F.lit(""))


def bill_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)bilhete\W{0,3}([0-9]{6,})", 1), F.lit(""))


def natural_id(text: Column) -> Column:
    """What tells pages of one file apart: the invoice key, else the bill number, hashed."""
    return F.substring(F.sha2(F.coalesce(invoice_key_of(text), bill_number(text)), 256), 1, 16)


def page_identifiers(text: Column) -> Column:
    """The set of identifiers of a page."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(invoice_key_of(text), bill_number(text), person_id(text)), company_ids(text)))))


def mixed_kinds(kinds: Column) -> Column:
    """Whether an array of page kinds holds at least two that are known."""
    return F.size(F.array_distinct(F.array_compact(kinds))) >= 2


def mime_of(content: Column, name: Column) -> Column:
    """By the first bytes, else by the name's ending, else octets."""
    head, ending = F.hex(F.substring(content, 1, 4)), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for sign, kind in MAGIC:
        out = F.when(head.startswith(sign), kind) if out is None else out.when(head.startswith(sign), kind)
    for end, kind in ENDINGS:
        out = out.when(ending == end, kind)
    return out.otherwise("application/octet-stream")


def months_of(text: Column) -> Column:
    """A duration in years, months or days as months (30 days each, rounded down); null without."""
    pattern = r"(?i)\b([0-9]{1,4})\s*(anos?|meses|m[eê]s|dias?)\b"
    n, unit = F.regexp_extract(text, pattern, 1).try_cast("int"), F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(unit.startswith("ano"), n * 12).when(unit.startswith("m"), n).when(unit.startswith("dia"), F.floor(n / 30)).cast("int")


def receipt_items(text: Column) -> Column:
    """Items of a receipt: array<struct<codigo, descricao, qtde, valor>> from lines ``code text qty UN x unit total``."""
    line = r"(?m)^\s*([0-9]{3,14})\s+(.+?)\s+([0-9]+(?:,[0-9]{1,3})?)\s*(?:UN|KG|L|PC)\s*[xX]\s*[0-9.]+,[0-9]{2}\s+([0-9.]+,[0-9]{2})\s*$"
    part = lambda i: F.regexp_extract_all(text, F.lit(line), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("codigo"), part(2).alias("descricao"), part(3).alias("q"), part(4).alias("v"))
    return F.transform(zipped, lambda x: F.struct(x["codigo"].alias("codigo"), x["descricao"].alias("descricao"), F.replace(x["q"], F.lit(","), F.lit(".")).try_cast("decimal(18,3)").alias("qtde"), parse_br(x["v"]).alias("valor")))


def recall(items: Column, total: Column) -> Column:
    """Share of a receipt's total that its items account for; 0 without a positive total."""
    found = F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(x["valor"].cast("double"), F.lit(0.0)))
    return F.when(total > 0, F.round(found / total.cast("double"), 4)).otherwise(0.0)


def field_status(etl: Column, opus: Column, human: Column) -> Column:
    """State of a field that two readers and a person may have filled in."""
    both = etl.isNotNull() & opus.isNotNull()
    return (
        F.when(both & (etl == opus), "ok").when(both, "divergente").when(etl.isNotNull(), "apenas_etl")
        .when(opus.isNotNull(), "apenas_opus").when(human.isNotNull(), "so_humano").otherwise("vazio")
    )
