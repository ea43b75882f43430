"""Conforming of raw statement rows: counterparty, person, type and canonical names, all as native expressions.

What the tables below hold can be given as parameters; a table that is empty never matches anything.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import EXPENSE, INCOME, TAX, TRANSFER, TYPES

from . import expressions as X

# Patterns of descriptions, in the order in which they are asked.
OPERATIONAL = r"RESGATE RDB|APLICAÇÃO RDB|RESGATE CDB|APLICAÇÃO CDB|FATURA\s+DE\s+CART[ÃA]O|PAGAMENTO\s+DE\s+FATURA|PGTO\s+FAT\s+CARTAO"
TAXES = r"RECEITA.FED|DARF|DAS.*SIMPLES|DAS.*MEI"
EARNED = r"SALARIO|PAGTO.*SALARIO|REEMBOLSO|ESTORNO"
CHARGED = r"JUROS\s+POR\s+FATURA|IOF\s+POR\s+FATURA|MULTA\s+POR\s+FATURA|TRANSF\s+ENVIADA|TRANSFER[EÊ]NCIA\s+ENVIADA"
KEPT_TRANSFER = (
    r"PAGAMENTO\s+DE\s+FATURA|PGTO\s+FAT\s+CARTAO|PGTO\s+FATURA|FATURA\s+DE\s+CART[AÃ]O|PAGAMENTO\s+FATURA\s+NU|PAGTO\s+NU\s*PAGAMENT|"
    r"DEBITO\s+DE\s+CARTAO|DEB\s+CART|PIX\s+QRS\s+BANCO\s+SANTA|CDB\s+C6|LIM\.\s*GARANT|RESGATE\s+CDB|APLICA[CÇ][AÃ]O\s+CDB|"
    r"VALOR\s+ADICIONADO\s+NA\s+CONTA|PIX\s+NO\s+CR[EÉ]DITO"
)
SENT = r"^(?:Transferência enviada pelo Pix|Compra no débito|Pagamento de boleto efetuado)\s*-\s*(.+?)(?:\s*-\s*\d|$)"
RECEIVED = r"^Transferência Recebida\s*-\s*(.+?)(?:\s+\d{5,}|\s*-\s*\d)"
TECHNICAL = r"^\s*(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|[0-9a-fA-F]{16,}|\d{8,})\s*$"
#: Banks of the first person; all others that name a person are the second's.
FIRST, SECOND = ("Itaú", "C6", "Santander"), ("Nubank (PF)", "Nubank (PJ)")

FOLDS = {"A": "AÁÀÂÃÄ", "E": "EÉÈÊË", "I": "IÍÌÎÏ", "O": "OÓÒÔÕÖ", "U": "UÚÙÛÜ", "C": "CÇ", "N": "NÑ"}


@dataclass(frozen=True)
class Variant:
    """A short form of a name: at least ``least`` of the tokens, a marker if there are any, and a DD/MM date if asked."""

    banks: tuple[str, ...]
    tokens: tuple[str, ...]
    least: int = 1
    markers: tuple[str, ...] = ()
    dated: bool = False


@dataclass(frozen=True)
class Couple:
    """Names and personal ids of the two account holders, and short forms of their names.

    ``payers`` are names whose transfers are income, ``own_accounts`` patterns of the holders' own branches and accounts.
    """

    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    variants: tuple[Variant, ...] = field(default_factory=tuple)
    payers: tuple[str, ...] = ()
    own_accounts: tuple[str, ...] = ()


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def quoted(text: str) -> str:
    """``text`` as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def accented(text: str) -> str:
    """A pattern of ``text`` (plain capitals) with any accents."""
    return "".join(f"[{FOLDS[c]}]" if c in FOLDS else quoted(c) for c in text)


def of_couple(description: Column, couple: Couple) -> Column:
    """Does a holder's whole name, or all eleven digits of an id, stand in the description? Null is no."""
    text, digits = X.fold(F.upper(description)), F.regexp_replace(description, "[^0-9]", "")
    names = [text.rlike(rf"\b{quoted(n)}\b") for n in couple.names if n.strip()]
    ids = ["".join(filter(str.isdigit, i)) for i in couple.ids]
    return F.coalesce(_any(names + [digits.contains(i) for i in ids if len(i) == 11]), F.lit(False))


def of_variant(description: Column, bank: Column, couple: Couple) -> Column:
    """Does a short form of a name stand in the description, in a bank that uses it? Null is no."""
    text, found = X.fold(F.upper(description)), []
    for v in couple.variants:
        hits = reduce(lambda a, b: a + b, [text.rlike(rf"(?<!\w){quoted(t)}(?=\W|\d|$)").cast("int") for t in v.tokens], F.lit(0))
        ok = bank.isin(*v.banks) & (hits >= v.least)
        if v.markers:
            ok = ok & _any([text.contains(m) for m in v.markers])
        found.append(ok & description.rlike(r"\d{2}/\d{2}") if v.dated else ok)
    return F.coalesce(_any(found), F.lit(False))


def clean(description: Column) -> Column:
    return F.trim(F.replace(description, F.lit("&amp;"), F.lit("&")))


def counterparty(description: Column) -> Column:
    """The other side's name in a description: what a transfer names, what stands before an instalment, else 60 characters."""
    part = lambda p: F.nullif(F.trim(F.regexp_extract(description, p, 1)), F.lit(""))
    whole = F.when(description.contains(" - Parcela "), F.trim(F.substring_index(description, " - Parcela ", 1)))
    return F.coalesce(part(SENT), part(RECEIVED), whole, F.trim(F.substring(description, 1, 60)))


def subtype_of(path: Column) -> Column:
    """'pj' or 'pf' by the folder; 'pj' wins."""
    return F.when(F.lower(path).contains("/pj/"), "pj").when(F.lower(path).contains("/pf/"), "pf")


def person_of(bank: Column, subtype: Column) -> Column:
    return (
        F.when(bank.isin(*FIRST), "pessoa_a").when(bank.isin(*SECOND) | subtype.isin("pj", "pf"), "pessoa_b")
        .when(bank == "Nubank", "pessoa_a").otherwise("casal")
    )


def is_technical(name: Column) -> Column:
    """A company or personal id, a hash, or a long number."""
    return name.rlike(TECHNICAL)


def canonical_supplier(name: Column, companies: dict[str, str], words: dict[str, str]) -> Column:
    """Canonical name: ids stay, then the longest company key, then words with their accents, then SA as S/A.

    Keys are plain capitals.
    """
    norm = F.trim(X.fold(F.upper(name)))
    out = None
    for key in sorted(companies, key=lambda k: (-len(k), k)):
        value = companies[key]
        once = F.regexp_replace(name, rf"(?is)^(.*?){quoted(key)}(.*)$", rf"$1{value}$2")
        fixed = F.when(norm == key, F.lit(value)).when(F.upper(name).contains(key), once).otherwise(F.lit(value))
        out = F.when(norm.contains(key), fixed) if out is None else out.when(norm.contains(key), fixed)
    out = name if out is None else out.otherwise(name)
    for key in sorted(words, key=lambda k: (-len(k), k)):
        out = F.regexp_replace(out, rf"(?iu)\b{accented(key)}\b", words[key])
    out = F.regexp_replace(F.regexp_replace(out, r"\bSA\b(?![A-Za-z])", "S/A"), r"\bS\s+A\b(?![A-Za-z])", "S/A")
    return F.when(F.coalesce(is_technical(name), F.lit(False)), name).otherwise(out)


def type_of(description: Column, suggested: Column, signed: Column, bank: Column | None, couple: Couple) -> Column:
    """The type of a row by the first of eight tests that holds; without a bank short names are not asked."""
    text = F.upper(description)
    own = of_couple(description, couple)
    if bank is not None:
        own = own | of_variant(description, bank, couple)
    earned = text.rlike("|".join([EARNED, *(f"TRANSFERENCIA RECEBIDA.*{quoted(p.upper())}" for p in couple.payers)]))
    return (
        F.when(own | text.rlike(OPERATIONAL), TRANSFER).when(text.rlike(TAXES), TAX).when(suggested.isin(*TYPES), suggested)
        .when(earned, INCOME).when(text.rlike(CHARGED), EXPENSE).when(signed > 0, INCOME).otherwise(EXPENSE)
    )


def conform(rows: DataFrame, couple: Couple, companies: dict[str, str], words: dict[str, str]) -> DataFrame:
    """Raw rows -> ledger rows.

    Reads identificador, data, valor (signed), descricao, banco_origem, extrato, arquivo, sugerido and virtual.
    Mirror rows (virtual) are always transfers; a missing identifier is made from date, text and value.
    """
    text, signed = clean(F.col("descricao")), F.col("valor")
    kind = F.when(F.col("virtual"), TRANSFER).otherwise(type_of(F.col("texto"), F.col("sugerido"), signed, None, couple))
    person = person_of(F.col("banco_origem"), subtype_of(F.col("arquivo")))
    out = X.fenced(rows.withColumn("texto", text)).select(
        F.coalesce(F.col("identificador").cast("string"), X.key_hash(F.col("data"), F.col("texto"), signed)).alias("identificador"), "data",
        F.date_format("data", "yyyy-MM").alias("mes_ref"), F.abs(signed).alias("valor"), X.payment_method(F.col("texto"), F.col("extrato")).alias("forma_pagamento"),
        canonical_supplier(counterparty(F.col("texto")), companies, words).alias("local"), person.alias("quem"), "banco_origem", kind.alias("tipo"),
        F.col("texto").alias("descricao"), "virtual",
    )
    return X.fenced(out)


def demote_orphans(rows: DataFrame, couple: Couple) -> DataFrame:
    """Transfers that name neither a holder nor an operation become income or expense by their sign; mirrors stay."""
    text = F.coalesce(F.nullif(F.col("descricao"), F.lit("")), F.col("local"), F.lit(""))
    orphan = (F.col("tipo") == TRANSFER) & ~F.col("virtual") & ~of_couple(text, couple) & ~F.upper(text).rlike("|".join([KEPT_TRANSFER, *couple.own_accounts]))
    return rows.withColumns({"tipo_anterior": F.when(orphan, F.col("tipo")), "tipo": F.when(orphan, F.when(F.col("valor") > 0, INCOME).otherwise(EXPENSE)).otherwise(F.col("tipo"))})


def promote_holders(rows: DataFrame, couple: Couple) -> DataFrame:
    """Income and expenses that name a holder, in full or in short, become transfers; rows without a bank stay."""
    text = F.coalesce(F.nullif(F.col("descricao"), F.lit("")), F.col("local"), F.lit(""))
    bank = F.coalesce("banco_origem", F.lit(""))
    own = F.col("tipo").isin(INCOME, EXPENSE) & (bank != "") & (of_couple(text, couple) | of_variant(text, bank, couple))
    return rows.withColumn("tipo", F.when(own, TRANSFER).otherwise(F.col("tipo")))
