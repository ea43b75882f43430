"""Conforming expressions: Column -> Column, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and what they fold to, in equal places.
ACCENTED, PLAIN = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ", "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
# Legal suffixes of company names in the order of their stripping, units, and product synonyms in theirs.
SUFFIXES = (" S/A", " S.A.", " S A", " SA", " LTDA", " ME", " EIRELI", " EPP", " MEI")
UNITS = "ML|L|LT|G|GR|KG|UN|PC|PCT|CX|MG|MCG"
SYNONYMS = (
    ("DESODORANTE", ("DESOD", "DEODORANT", "DEO")),
    ("SABONETE", ("SABONET", "BAR SOAP", "SOAP", "SAB")),
    ("SHAMPOO", ("XAMPU", "XAMPUZINHO", "SHAMP")),
    ("CONDICIONADOR", ("COND", "CONDITIONER")),
    ("AMACIANTE", ("AMACI", "SOFTENER")),
    ("ROLLON", ("ROLL-ON", "ROL", "ROLON")),
    ("AEROSOL", ("AERO", "SPRAY")),
    ("ARROZ", ("ARROZINHO",)),
    ("FEIJAO", ("FEIJ",)),
)


def fenced(rows: DataFrame) -> DataFrame:
    """The same rows, each computed once: filters and rules that follow are not rewritten in terms of what made them.

    Long CASE expressions would else be copied into every place that reads their result.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def fold(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def payment_method(description: Column, kind: Column) -> Column:
    """Card statements are credit; else the first keyword decides, else the statement's default."""
    text = F.upper(description)
    return (
        F.when(kind == "cartao", "Crédito").when(text.contains("PIX"), "Pix").when(text.contains("DÉBITO") | text.contains("DEBITO"), "Débito")
        .when(text.contains("BOLETO"), "Boleto").when(text.contains("TED") | text.contains("DOC"), "Transferência")
        .otherwise(F.when(kind == "cc", "Débito").otherwise("Crédito"))
    )


def key_hash(date: Column, text: Column, signed: Column) -> Column:
    """First 16 hex digits of sha256 over date, normal text and signed value with two places."""
    parts = F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), F.lower(F.trim(text)), signed.cast("decimal(18,2)").cast("string"))
    return F.substring(F.sha2(parts, 256), 1, 16)


def ledger_key(date: Column, value: Column, local: Column, bank: Column) -> Column:
    """Identifier of a ledger row; null where the counterparty or the bank is blank."""
    parts = F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), value.cast("decimal(18,2)").cast("string"), local, bank)
    known = (F.trim(F.coalesce(local, F.lit(""))) != "") & (F.trim(F.coalesce(bank, F.lit(""))) != "")
    return F.when(known, F.upper(F.substring(F.sha2(parts, 256), 1, 16)))


def dedup_text(local: Column) -> Column:
    """What follows the first ' - ', trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(local, F.lit("")), r"^.*? - ", "")))


def parse_br(text: Column) -> Column:
    """'1.234,56' -> 1234.56; null if it is no number."""
    bare = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.cast("decimal(18,2)"))


def currency_br(value: Column) -> Column:
    """1234.5 -> 'R$ 1.234,50'."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(value, 2), ",.", ".,"))


def month_label(mes_ref: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat_ws("/", F.get(names, F.substring(mes_ref, 6, 2).cast("int") - 1), F.substring(mes_ref, 3, 2))


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def normal_supplier(name: Column) -> Column:
    """Capitals without legal suffixes (each stripped once, in order) and light punctuation; accents stay."""
    out = F.trim(F.upper(name))
    for suffix in SUFFIXES:
        out = F.regexp_replace(out, r"\s*" + suffix.replace(".", r"\.") + "$", "")
    return squeeze(F.regexp_replace(out, r"[.,;:\-()/]+", " "))


def synonyms(text: Column) -> Column:
    """Words that stand for others, replaced group by group, in the order of the table."""
    for chosen, others in SYNONYMS:
        for word in others:
            text = F.regexp_replace(text, rf"\b{word}\b", chosen)
    return text


def normal_product(text: Column) -> Column:
    """The supplier's normal form without accents, amounts, units and numbers, with one word for synonyms."""
    out = fold(normal_supplier(text))
    for pattern in (rf"\b[0-9]+([.,][0-9]+)?\s*({UNITS})\b", rf"\b({UNITS})\b", r"\b[0-9]+([.,][0-9]+)?\b"):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(synonyms(out))


def mask_pii(text: Column) -> Column:
    """Company ids, person ids and e-mail addresses."""
    out = F.regexp_replace(text, r"\b[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}\b", "**.***.***/****-**")
    out = F.regexp_replace(out, r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b", "***.***.***-**")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "***@***")


def slug(text: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(fold(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)


def invoice_key(raw: Column) -> Column:
    """The 44 digits of an invoice key, else null."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(digits) == 44, digits)


def check_digit(key: Column) -> Column:
    """Modulo-11 check digit of the first 43 digits of a key, weights 2 to 9 from the right, as text."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(42)), F.lit(0), lambda s, i: s + F.substring(key, 43 - i, F.lit(1)).cast("int") * (2 + i % 8))
    rest = F.pmod(total, F.lit(11))
    return F.when(rest < 2, 0).otherwise(11 - rest).cast("string")


def check_digit_ok(key: Column) -> Column:
    return F.substring(key, 44, 1) == check_digit(key)


def key_parts(key: Column) -> list[Column]:
    """Tax id, model, state, year and month, series and number of a 44-digit key."""
    places = {"cnpj": (7, 14), "modelo": (21, 2), "uf": (1, 2), "aamm": (3, 4), "serie": (23, 3), "numero": (26, 9)}
    return [F.substring(key, at, n).alias(name) for name, (at, n) in places.items()]


def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.lower(fold(text)), r"[^a-z0-9]+"), lambda t: F.length(t) >= least)


def first_date_br(text: Column) -> Column:
    """The first plausible DD/MM/YYYY of a text as a date."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]{2}/[0-9]{2}/[0-9]{4})"), F.lit(1)), lambda d: F.try_to_timestamp(d, F.lit("dd/MM/yyyy")).cast("date"))
    return F.get(F.filter(found, lambda d: d.isNotNull() & F.year(d).between(1990, 2100)), F.lit(0))


def known_words(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds, whatever its case."""
    low = F.lower(text)
    out = F.lit(0)
    for w in words:
        out = out + low.contains(w).cast("int")
    return out


def illegible(text: Column, min_alnum: int = 40, max_other: float = 0.5) -> Column:
    """Few letters and digits, or a long text with too many other signs."""
    n, alnum = F.length(text), F.length(F.regexp_replace(text, r"[^A-Za-z0-9À-ÿ]", ""))
    return (alnum < min_alnum) | ((n > 100) & ((n - alnum) > n * max_other))
