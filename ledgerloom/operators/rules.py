"""Ordered rule tables: the first rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import fenced
from ledgerloom.schema import DOUBTFUL, EXPENSE, INCOME, NEEDED, TAX, TRANSFER


def first_match(conditions: list[tuple[Column, object]], default=None) -> Column:
    """One CASE expression; the order of the list is the order of the rules."""
    out = None
    for condition, value in conditions:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def value_rule(rule: Column, value: Column) -> Column:
    """'< 100' on the absolute value; a rule that is no comparison holds."""
    op, limit = F.regexp_extract(rule, r"^([<>=!]+)\s*(\d+\.?\d*)", 1), F.regexp_extract(rule, r"^([<>=!]+)\s*(\d+\.?\d*)", 2).try_cast("double")
    x = F.abs(value).cast("double")
    known = op.isin("<", "<=", ">", ">=", "==", "!=") & limit.isNotNull()
    return F.coalesce(
        F.when(~known, True).when(op == "<", x < limit).when(op == "<=", x <= limit).when(op == ">", x > limit)
        .when(op == ">=", x >= limit).when(op == "!=", x != limit).otherwise(x == limit),
        F.lit(True),
    )


@dataclass(frozen=True)
class Override:
    """A manual rule: its key stands in the text, or, with ``structural``, only its filters count. None does not filter."""

    key: str
    category: str | None = None
    class_: str | None = None
    kind: str | None = None
    tag: str | None = None
    value: str | None = None
    bank: str | None = None
    value_min: float | None = None
    value_max: float | None = None
    day_min: int | None = None
    day_max: int | None = None
    structural: bool = False

    def fits(self, text: Column, value: Column, bank: Column, date: Column) -> Column:
        ok, filters = F.lit(True), []
        if self.bank is not None:
            filters.append(F.upper(F.trim(F.coalesce(bank, F.lit("")))) == self.bank.strip().upper())
        if self.value_min is not None:
            filters.append(F.coalesce(value, F.lit(0)) >= self.value_min)
        if self.value_max is not None:
            filters.append(F.coalesce(value, F.lit(0)) <= self.value_max)
        if self.day_min is not None:
            filters.append(F.coalesce(F.dayofmonth(date) >= self.day_min, F.lit(False)))
        if self.day_max is not None:
            filters.append(F.coalesce(F.dayofmonth(date) <= self.day_max, F.lit(False)))
        if not (self.structural and filters):
            ok = F.upper(text).contains(self.key.upper())
        for f in filters:
            ok = ok & f
        return ok & value_rule(F.lit(self.value), value) if self.value else ok


@dataclass(frozen=True)
class Rule:
    """A pattern rule of the ordered table; what is None is not set by it."""

    pattern: str
    category: str | None = None
    class_: str | None = None
    kind: str | None = None
    tag: str | None = None
    value: str | None = None

    def fits(self, text: Column, value: Column, bank: Column, date: Column) -> Column:
        ok = text.rlike("(?i)" + self.pattern)
        return ok & value_rule(F.lit(self.value), value) if self.value else ok


def categorize(rows: DataFrame, overrides: list[Override], rules: list[Rule]) -> DataFrame:
    """Category, class, type and tag by the first override, else the first rule, that fits; one CASE each.

    Reads descricao, local, valor, banco_origem, data, categoria, classificacao, tipo and tag_irpf; adds ``regra``,
    the number of the deciding entry. A deciding entry stops the search even if it sets only some columns. A class is
    set on expenses and taxes alone; without a category a row is in 'Outros' and doubtful.
    """
    entries = [*overrides, *rules]
    text = F.concat_ws(" ", F.coalesce("descricao", F.lit("")), F.coalesce("local", F.lit("")))
    at = first_match([(e.fits(text, F.col("valor"), F.col("banco_origem"), F.col("data")), i) for i, e in enumerate(entries)])
    rows = fenced(rows.withColumn("regra", at))

    def said(name: str) -> Column:
        values = F.array(*[F.lit(getattr(e, name)).cast("string") for e in entries])
        return F.get(values, F.col("regra")) if entries else F.lit(None).cast("string")

    rows = rows.withColumns({"tipo": F.coalesce(said("kind"), "tipo"), "tag_irpf": F.coalesce(said("tag"), "tag_irpf"), "_c": F.coalesce(said("category"), "categoria")})
    spent = F.coalesce(F.col("tipo").isin(EXPENSE, TAX), F.lit(False))
    class_ = F.coalesce(F.when(spent, said("class_")), "classificacao")
    class_ = F.when(F.col("_c").isNull() & F.coalesce(F.col("tipo") == EXPENSE, F.lit(True)), DOUBTFUL).otherwise(class_)
    return fenced(rows.withColumns({"categoria": F.coalesce("_c", F.lit("Outros")), "classificacao": final_class(F.col("tipo"), class_)}).drop("_c"))


def final_class(kind: Column, class_: Column) -> Column:
    """No class for income and transfers; else what is set, needed for taxes, doubtful for the rest."""
    return F.when(kind.isin(INCOME, TRANSFER), F.lit(None).cast("string")).otherwise(F.coalesce(class_, F.when(kind == TAX, NEEDED).otherwise(DOUBTFUL)))


def coverage(rows: DataFrame) -> DataFrame:
    """total, categorized rows and their share in percent."""
    out = rows.agg(F.count("*").alias("total"), F.count_if(F.col("categoria") != "Outros").alias("categorizadas"))
    return out.withColumn("cobertura", F.round(F.when(F.col("total") > 0, F.col("categorizadas") / F.col("total") * 100).otherwise(0.0), 4))


def tagged(rows: DataFrame, tags: list[tuple[str, str]]) -> DataFrame:
    """Keeps a tag that is there, else the tag of the first pattern of (pattern, tag); adds the tax id of the text.

    The id is that of a company, else that of a person.
    """
    text = F.concat_ws(" ", "descricao", "local")
    found = first_match([(text.rlike("(?i)" + p), t) for p, t in tags])
    part = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    ident = F.coalesce(part(r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}"), part(r"\d{3}\.\d{3}\.\d{3}-\d{2}"))
    return fenced(rows.withColumns({"tag_irpf": F.coalesce(F.nullif("tag_irpf", F.lit("")), found), "cnpj_cpf": ident}))


def item_category(text: Column, overrides: list[tuple[str, str]], rules: list[tuple[str, str]], fallback: str) -> Column:
    """Category of an item: the first override whose key stands in the text, else the first pattern, else the fallback."""
    up = F.upper(text)
    return first_match([*((up.contains(k.upper()), c) for k, c in overrides), *((text.rlike("(?i)" + p), c) for p, c in rules)], fallback)


@dataclass(frozen=True)
class DocumentRule:
    """A document type: accepted kinds of file (none: all), patterns of which all or any must match, and sub-rules.

    A sub-rule is (name, least length, greatest length or None, patterns of which all, patterns of which any must match).
    """

    kind: str
    patterns: tuple[str, ...]
    mimes: tuple[str, ...] = ()
    every: bool = False
    sub: tuple[tuple[str, int, int | None, tuple[str, ...], tuple[str, ...]], ...] = ()


_WORD, _SPACE = r"[\pL\pN_\x{345}]", r"[\t\n\f\r ]"  # U+0345 is no letter, but its capital is
_PART = re.compile(r"\\[pP](?:\{\w+\}|\w)|\\.|\(\?[^:)]*[:)]|\[\^?\]?(?:\\.|[^\]\\])*\]|[iI]")


def by_line(pattern: str) -> str:
    """The pattern, ignoring case, line by line, as DuckDB reads it: letters and digits of any script are words, lines end
    at \\n only, a vertical tab is no blank, and of the letters i the dotted capital and the dotless small one are others.
    """

    def part(m: re.Match) -> str:
        t = m[0]
        if t in ("i", "I"):
            return f"(?-u:{t})"
        return re.sub(r"\\(.)", lambda e: {"w": _WORD, "s": _SPACE}.get(e[1], e[0]), t)

    return "(?imud)" + _PART.sub(part, pattern)


def matches(patterns: tuple[str, ...], text: Column, every: bool) -> Column:
    """All or any of the patterns, ignoring case, line by line; no pattern matches nothing."""
    if not patterns:
        return F.lit(False)
    out = None
    for p in patterns:
        hit = F.coalesce(text.rlike(by_line(p)), F.lit(False))
        out = hit if out is None else (out & hit if every else out | hit)
    return out


def sub_rule(rule: DocumentRule, text: Column) -> Column:
    """Name of the first sub-rule that holds, else null."""
    tests = []
    for name, least, most, all_, any_ in rule.sub:
        ok = F.length(text) >= least
        ok = ok & (F.length(text) <= most) if most is not None else ok
        ok = ok & matches(all_, text, True) if all_ else ok
        tests.append((ok & matches(any_, text, False) if any_ else ok, name))
    return first_match(tests) if tests else F.lit(None).cast("string")


def classify(mime: Column, text: Column, rules: list[DocumentRule]) -> tuple[Column, Column]:
    """Type and sub-rule of a document by the first rule, in order, whose file kind and patterns fit.

    A rule with sub-rules fits only if one of them holds.
    """
    tests, names = [], []
    for r in rules:
        ok = matches(r.patterns, text, r.every)
        ok = ok & mime.isin(*r.mimes) if r.mimes else ok
        name = sub_rule(r, text)
        ok = ok & name.isNotNull() if r.sub else ok
        tests.append((ok, r.kind))
        names.append((ok, name))
    return first_match(tests), first_match(names)


def route(hint: Column, kind: Column, detectors: dict[str, list[tuple[Column, str]]], default: str) -> Column:
    """A hint wins; else the first detector, in order, of the file's kind that accepts it; else the default."""
    tests = [((kind == k) & F.coalesce(c, F.lit(False)), name) for k, some in detectors.items() for c, name in some]
    return F.coalesce(hint, first_match(tests, default))


def search_routes(queries: DataFrame, tabs: list[str], suppliers: DataFrame, least: int = 4) -> DataFrame:
    """(q, rota, alvo): a tab's name, a supplier's name, the first supplier that contains a text of ``least`` letters, or free.

    A text is looked up by the rarest of its three-letter runs in an index of the names' runs, and then verified, so
    the index is as long as the names.
    """
    if least < 3:
        raise ValueError("texts of three letters at least")
    runs = lambda c: F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length({c}) - 2), i -> substring({c}, i, 3))")))
    index = suppliers.select("name").distinct().filter(F.length("name") >= least).select("name", runs("name").alias("run"))
    asked = queries.select("q").distinct().filter(F.length("q") >= least).select("q", runs("q").alias("run"))
    often = index.groupBy("run").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "run", "left").groupBy("q").agg(F.min_by("run", F.struct(F.coalesce("often", F.lit(0)).alias("o"), "run")).alias("run"))
    found = rarest.join(index, "run").filter(F.contains("name", "q")).groupBy("q").agg(F.min("name").alias("part"))
    exact = suppliers.select(F.col("name").alias("q"), F.col("name").alias("whole")).distinct()
    j = queries.join(exact, "q", "left").join(found, "q", "left")
    tab = F.col("q").isin(*tabs)
    kind = F.when(tab, "aba").when(F.col("whole").isNotNull(), "fornecedor").when(F.col("part").isNotNull(), "parcial").otherwise("livre")
    return j.select("q", kind.alias("rota"), F.when(tab, F.col("q")).otherwise(F.coalesce("whole", "part")).alias("alvo"))
