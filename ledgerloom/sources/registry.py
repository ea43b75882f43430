"""The readers in their order, and one dispatcher over files of all kinds, as a table function.

Each file is taken by the first enabled reader that accepts it and does not raise. A reader that raises is
tolerated: its failure is a row of its own, and the next reader that accepts the file gets it. A file that none takes is
a row too, so every file ends in rows or in failures.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layouts as L

OFF = "LEDGERLOOM_READERS_OFF"


@dataclass(frozen=True)
class Reader:
    """``accepts(path, text)`` and ``read(text)``, which gives rows of named fields or raises."""

    name: str
    accepts: Callable[[str, str], bool]
    read: Callable[[str], Iterator[L.Row]]


CARD, ACCOUNT = ["date", "title", "amount"], ["Data", "Valor", "Identificador", "Descrição"]
READERS = (
    Reader("card_csv", lambda p, t: p.lower().endswith(".csv") and t.startswith(",".join(CARD)), lambda t: L.csv_rows(t, CARD, {"data": "date", "local": "title", "valor": "amount"})),
    Reader("account_csv", lambda p, t: p.lower().endswith(".csv") and t.startswith("Data,"), lambda t: L.csv_rows(t, ACCOUNT, {"data": "Data", "valor": "Valor", "identificador": "Identificador", "local": "Descrição"})),
    Reader("printed_invoice", lambda p, t: "danfe" in p.lower() or L.is_printed_invoice(t), L.printed_invoice),
    Reader("signed_payslip", lambda p, t: "sal" in t.lower() and "\n+ " in t, L.signed_payslip),
    Reader("coded_payslip", lambda p, t: "Mensalista" in t, L.coded_payslip),
    Reader("thermal_receipt", lambda p, t: "CUPOM FISCAL" in t.upper(), L.thermal_receipt),
    Reader("lines", lambda p, t: p.lower().endswith(".txt"), lambda t: ({"texto": x} for x in t.splitlines() if x.strip())),
)


def enabled(readers: tuple[Reader, ...] = READERS, off: set[str] | None = None) -> tuple[Reader, ...]:
    """The readers that are not in ``off``, by default the comma-separated names in the environment."""
    names = {x.strip() for x in os.environ.get(OFF, "").split(",")} if off is None else off
    return tuple(r for r in readers if r.name not in names)


def dispatch(files: DataFrame, readers: tuple[Reader, ...] | None = None) -> DataFrame:
    """(path, content) -> (path, reader, n, fields map<string, string>, error).

    Rows of a reader are numbered from 1; a failure has the reader's name and the error, a file that no reader takes
    neither name nor fields. A file's rows count only if its reader reads it to the end.
    """
    chosen = enabled() if readers is None else readers

    class Dispatch:
        def eval(self, path: str, content: str):
            for reader in chosen:
                try:
                    if content is None or not reader.accepts(path or "", content):
                        continue
                    rows = list(reader.read(content))
                except Exception as e:  # noqa: BLE001  any failure of a reader is a row
                    yield reader.name, None, None, f"{type(e).__name__}: {e}"
                    continue
                for n, row in enumerate(rows, 1):
                    yield reader.name, n, row, None
                return
            yield None, None, None, "no reader"

    read = F.udtf(Dispatch, returnType="reader string, n int, fields map<string, string>, error string")
    files.sparkSession.udtf.register("dispatch_files", read)
    view = "files_to_dispatch"
    files.select("path", "content").createOrReplaceTempView(view)
    return files.sparkSession.sql(f"SELECT f.path, d.* FROM {view} AS f, LATERAL dispatch_files(f.path, f.content) AS d")


#: What the first line of a file says, and where its rows have their date.
KINDS = (("date,title,amount", "cartao", r"(?m)^(\d{4}-\d{2})-\d{2}"), ("Data,Valor,Identificador", "cc", r"(?m)^\d{2}/(\d{2}/\d{4})"))


def _first(tests: list[tuple[Column, object]], other) -> Column:
    out = F.lit(other)
    for test, value in reversed(tests):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def detect(files: DataFrame, bank: str, owners: list[tuple[str, str, str, str, float]], fallback: tuple[str, str, float]) -> DataFrame:
    """(path, banco, tipo, pessoa, subtipo, periodo, formato, confianca) of files by content and path; unknown ones are left out.

    ``owners`` has, in order, (where: ``path`` or ``content``, text, person, subtype, confidence): the first whose text is found
    decides, ``fallback`` otherwise. The period is the month of the first dated row; of other texts, that of the
    period they name (``período de visualização``).
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    line = F.substring_index("content", "\n", 1)
    kinds = [((suffix == "csv") & F.startswith(line, F.lit(head)), kind) for head, kind, _ in KINDS]
    shown = F.regexp_extract("content", r"(?i)per[ií]odo de visualiza[cç][aã]o:\s*\d{2}/(\d{2}/\d{4})", 1)
    kinds.append(((suffix == "pdf") & (shown != ""), "cc"))
    month = F.lit("")
    for (test, _), pattern in zip(kinds, (*(p for _, _, p in KINDS), None)):
        month = F.when(test, shown if pattern is None else F.regexp_extract("content", pattern, 1)).otherwise(month)
    # mm/yyyy is turned around
    period = F.when(month.contains("/"), F.concat_ws("-", F.substring_index(month, "/", -1), F.substring_index(month, "/", 1))).otherwise(F.nullif(month, F.lit("")))
    tests = [(F.contains(F.lower("path") if where == "path" else F.col("content"), F.lit(text)), F.struct(F.lit(p), F.lit(s), F.lit(c))) for where, text, p, s, c in owners]
    owner = F.struct(*map(F.lit, fallback))
    for test, value in reversed(tests):
        owner = F.when(test, value).otherwise(owner)
    marked = files.select("path", _first(kinds, None).cast("string").alias("tipo"), period.alias("periodo"), suffix.alias("formato"), owner.alias("o")).filter("tipo is not null")
    return marked.select("path", F.lit(bank).alias("banco"), "tipo", F.col("o.col1").alias("pessoa"), F.col("o.col2").alias("subtipo"), "periodo", "formato", F.col("o.col3").alias("confianca"))
