"""Readers of single files: text in, rows of named fields out. Each is a small line reader without state between files.

A reader that meets a file it cannot make sense of raises ``ValueError``; the registry then tries the next one.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from decimal import Decimal

Row = dict[str, str]
MONEY = re.compile(r"-?\d[\d.]*,\d{2}")
#: Month names.
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


def money(text: str) -> Decimal:
    """``1.234,56`` as a number."""
    return Decimal(text.replace(".", "").replace(",", "."))


def csv_rows(text: str, header: list[str], fields: dict[str, str]) -> Iterator[Row]:
    """Rows of a CSV whose first line is ``header``; a row with fewer cells is an error."""
    lines = csv.reader(io.StringIO(text))
    if next(lines, None) != header:
        raise ValueError("another header")
    for cells in lines:
        if cells:
            if len(cells) != len(header):
                raise ValueError(f"{len(cells)} cells instead of {len(header)}")
            own = dict(zip(header, cells))
            yield {name: own[column] for name, column in fields.items()}


def _payslip(month: str, kind: str, gross: Decimal, inss: Decimal, irrf: Decimal, meal: Decimal, net: Decimal, advance: Decimal = Decimal(0)) -> Row:
    net = net or (gross - advance - inss - irrf - meal if gross > 0 else net)
    return {"mes_ref": month, "tipo": kind, **{n: f"{v:.2f}" for n, v in (("bruto", gross), ("inss", inss), ("irrf", irrf), ("vr_va", meal), ("liquido", net))}}


def signed_payslip(text: str) -> Iterator[Row]:
    """A payslip whose lines begin with ``+`` or ``-``: description, reference, amount (deductions in brackets)."""
    month = re.search(r"(?i)pagamento de sal[aá]rio:\s*(\d\d)/(\d\d(?:\d\d)?)", text)
    if not month:
        raise ValueError("no month")
    kind, sums = "Folha Mensal", dict.fromkeys(("gross", "inss", "irrf", "meal"), Decimal(0))
    net = Decimal(0)
    for line in text.splitlines():
        amounts = MONEY.findall(line)
        sign, words = line[:2].strip(), line[1:].split()
        if line.lower().startswith(("valor líquido a receber", "valor liquido a receber")) and amounts:
            net = money(amounts[-1])
        if sign not in ("+", "-") or not amounts:
            continue
        # the description ends where the reference number begins
        cut = max((i for i, w in enumerate(words) if re.fullmatch(r"[\d.,]+", w)), default=len(words))
        about = " ".join(words[:cut])
        if sign == "+":
            sums["gross"] += money(amounts[-1])
            if "13" in about and ("Adiantado" in about or "Integral" in about):
                kind = "13º Adiantamento" if "Adiantado" in about else "13º Integral"
            continue
        target = next((t for t, marks in (("irrf", ("IRRF",)), ("inss", ("INSS",)), ("meal", ("VALE ALIMENTA", "VALE REFEI"))) if any(m in about.upper() for m in marks)), None)
        if target:
            sums[target] += money(amounts[-1])
    year = month[2] if len(month[2]) == 4 else f"20{month[2]}"
    yield _payslip(f"{year}-{month[1]}", kind, sums["gross"], sums["inss"], sums["irrf"], sums["meal"], net)


#: Codes of the lines of a monthly payslip, and words of those of a 13th salary.
LINE_CODES = {"8781": "gross", "998": "inss", "999": "irrf"}
BONUS_WORDS = (("gross", ("SALARIO INTEGRAL",)), ("advance", ("ADIANTAMENTO", "13")), ("inss", ("INSS", "13")), ("irrf", ("IRRF", "13")))


def coded_payslip(text: str) -> Iterator[Row]:
    """A payslip with one code or key word a line and the amount last; a 13th salary has its own words."""
    month = re.search(r"Mensalista\s+(\w+)\s+de\s+(\d{4})", text)
    if not month or month[1].lower() not in MONTHS:
        raise ValueError("no month")
    bonus = any(w in text.upper() for w in ("13 SALARIO", "SALARIO INTEGRAL"))
    sums = dict.fromkeys(("gross", "inss", "irrf", "advance", "net"), Decimal(0))
    for line in text.splitlines():
        amounts, upper = MONEY.findall(line), line.upper()
        if not amounts:
            continue
        first = re.match(r"\s*(\d{3,4})[|\]\s]", line)
        if bonus:
            target = next((t for t, words in BONUS_WORDS if all(w in upper for w in words)), None)
        else:
            target = LINE_CODES.get(first[1]) if first else None
        if target is None and "VALOR" in upper and ("LIQUIDO" in upper or "LÍQUIDO" in upper):
            target = "net"
        if target:
            sums[target] = money(amounts[-1])
    kind = "13º Integral" if bonus else "Folha Mensal"
    yield _payslip(f"{month[2]}-{MONTHS.index(month[1].lower()) + 1:02d}", kind, sums["gross"], sums["inss"], sums["irrf"], Decimal(0), sums["net"], sums["advance"])


def valid_key(text: str) -> str | None:
    """The first 44-digit key, in groups of four or not, whose last digit checks."""
    for found in re.finditer(r"(?:\d{4}\s*){10}\d{4}", text):
        key = re.sub(r"\s", "", found[0])
        rest = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(key[:43]))) % 11
        if key[43] == str(0 if rest < 2 else 11 - rest):
            return key
    return None


def printed_invoice(text: str) -> Iterator[Row]:
    """An invoice's print: a row for the header (item 0) and one for each item line.

    Item lines are read from the classification on: eight digits, four digits, a unit, then numbers; what stands before
    is code and description, and a line that is none goes on with the description above it.
    """
    key = valid_key(text)
    if key is None or key[20:22] != "55":
        raise ValueError("no key of model 55")
    find = lambda p: (m[1] if (m := re.search(p, text, re.I)) else "")
    day = find(r"DATA\s+DE\s+EMISS[ÃA]O\s*:?\s*(\d\d/\d\d/\d{4})")
    issuer = find(r"\b(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})\b")
    if not issuer:
        raise ValueError("no issuer")
    total = find(r"VALOR\s+TOTAL\s+DA\s+NOTA\s*:?\s*R?\$?\s*([\d.,]+)")
    items: list[Row] = []
    inside = False
    for line in text.splitlines():
        words, upper = line.split(), line.upper()
        if "NCM" in upper and "CFOP" in upper and upper.split()[:1] in (["CÓDIGO"], ["CODIGO"]):
            inside = True
            continue
        if inside and re.search(r"C[ÁA]LCULO DO IMPOSTO|VALOR TOTAL DOS PRODUTOS|DADOS ADICIONAIS", upper):
            break
        if not inside or not words:
            continue
        at = next((i for i in range(1, len(words) - 4) if re.fullmatch(r"\d{8}", words[i]) and re.fullmatch(r"\d{4}", words[i + 1]) and words[i + 2].isalpha()), None)
        numbers = words[at + 3 :] if at else []
        if at and at > 1 and len(numbers) >= 3 and all(re.fullmatch(r"[\d.]+(?:,\d+)?", n) for n in numbers):
            taxes = [money(n) for n in numbers[3:]] + [Decimal(0)] * 3
            items.append({
                "item": str(len(items) + 1), "codigo": words[0], "descricao": " ".join(words[1:at]), "ncm": words[at], "cfop": words[at + 1], "unidade": words[at + 2].upper(),
                "qtde": str(Decimal(numbers[0].replace(",", "."))), "valor_total": f"{money(numbers[2]):.2f}", "icms": f"{taxes[1]:.2f}", "ipi": f"{taxes[2]:.2f}",
            })
        elif items:
            items[-1]["descricao"] += " " + " ".join(words)
    cancelled = bool(re.search(r"(?i)(?:NFe|NOTA\s+FISCAL)\s+CANCELAD[AO]", text))
    yield {
        "item": "0", "chave": key, "cnpj_emitente": re.sub(r"\D", "", issuer), "numero": find(r"N[ºo°]\s*0*(\d{1,9})"), "serie": find(r"S[ÉE]RIE\s*0*(\d{1,3})"),
        "data_emissao": "-".join(reversed(day.split("/"))) if day else "", "total": f"{money(total):.2f}" if total else "", "cancelada": str(cancelled).lower(), "itens": str(len(items)),
    }
    yield from items


def is_printed_invoice(text: str) -> bool:
    """The title, and the subtitle or the recipient's block; a key, if there is one, of model 55."""
    key = valid_key(text)
    block = re.search(r"(?i)documento\s+auxiliar\s+da\s+nota\s+fiscal\s+eletr[ôo]nica|destinat[áa]rio\s*[/\\]\s*remetente", text)
    return bool(re.search(r"(?i)\bDANFE\b", text) and block and (key is None or key[20:22] == "55"))


#: Words that name the kind of shop, in the order in which they are looked for, and what its item lines must have.
SHOPS = (
    ("loja", ("AMERICANAS",), {"codigo", "preco"}), ("mercado", ("SUPERMERC", "MERCAD", "ATACAD", "CARREFOUR", "EXTRA", "PAO DE ACUCAR", "PÃO DE AÇÚCAR"), {"preco"}),
    ("farmacia", ("DROG", "FARMACIA", "FARMÁCIA", "PACHECO", "PAGUE MENOS", "RAIA"), {"codigo"}),
    ("posto", ("POSTO", "COMBUST", "SHELL", "IPIRANGA", "PETROBRAS", "RAIZEN"), {"preco", "combustivel"}), ("generico", (), {"preco"}),
)
FUELS = ("GASOLINA", "ETANOL", "ALCOOL", "DIESEL", "GNV")
#: The least share of a receipt's total that its items must make up, else a person looks at it.
LEAST_RECALL = Decimal("0.70")


def receipt_line(line: str) -> dict | None:
    """An item line from its right end: total, price, a sign of times, unit, quantity; a code at its left end; the rest is text."""
    words = line.split()
    if not words or not re.fullmatch(r"\d{1,7}[.,]\d{2}", words[-1]):
        return None
    number = lambda w: Decimal(w.replace(",", "."))
    out = {"valor_total": number(words.pop()), "preco": None, "unidade": "", "qtde": Decimal(1), "codigo": ""}
    if words and re.fullmatch(r"\d{1,7}[.,]\d{2,3}", words[-1]):
        out["preco"] = number(words.pop())
        if words and words[-1].lower() == "x":
            words.pop()
        if len(words) > 1 and words[-1].isalpha() and len(words[-1]) <= 6 and re.fullmatch(r"\d+(?:[.,]\d+)?", words[-2]):
            out["unidade"] = words.pop().upper()
        if words and re.fullmatch(r"\d+(?:[.,]\d{1,3})?", words[-1]):
            out["qtde"] = number(words.pop())
    if len(words) > 1 and re.fullmatch(r"\d{6,14}", words[0]):
        out["codigo"] = words.pop(0)
    out["descricao"] = " ".join(words)
    return out if len(out["descricao"]) >= 3 and out["descricao"][0].isalpha() else None


def thermal_receipt(text: str) -> Iterator[Row]:
    """A receipt's text: a row for the whole (item 0) and one for each item line that its shop's kind allows.

    ``conferir`` tells that the items make up less than ``LEAST_RECALL`` of the total; ``inconsistente``, that quantity times
    price is not the line's total. Items without a code are numbered.
    """
    upper = text.upper()
    name, _, needs = next(s for s in SHOPS if any(m in upper for m in s[1]) or not s[1])
    paid = next((r["valor_total"] for line in text.splitlines() if line.upper().strip().startswith("TOTAL") and (r := receipt_line(line))), None)
    items: list[Row] = []
    for line in text.splitlines():
        item = receipt_line(line)
        if item is None or item["descricao"].upper().startswith(("TOTAL", "SUBTOTAL", "TROCO")):
            continue
        if "codigo" in needs and not item["codigo"] or "preco" in needs and item["preco"] is None or "combustivel" in needs and not item["descricao"].upper().startswith(FUELS):
            continue
        wrong = item["preco"] is not None and abs(round(item["qtde"] * item["preco"], 2) - item["valor_total"]) > Decimal("0.01")
        code = item["codigo"] or f"SEMCOD{sum(i['codigo'].startswith('SEMCOD') for i in items) + 1:04d}"
        items.append({"item": str(len(items) + 1), "codigo": code, "descricao": item["descricao"], "qtde": str(item["qtde"]), "unidade": item["unidade"], "valor_total": f"{item['valor_total']:.2f}", "inconsistente": str(wrong).lower()})
    found = sum((Decimal(i["valor_total"]) for i in items), Decimal(0))
    recall = round(found / paid, 4) if paid else Decimal(0)
    yield {"item": "0", "emissor": name, "total": f"{paid:.2f}" if paid else "", "recall": f"{recall:.4f}", "conferir": str(recall < LEAST_RECALL).lower(), "itens": str(len(items))}
    yield from items
