"""Intake of files and documents: envelopes, copies, queues, backfill, review, and their edges in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import first_match


def member_state(name: Column, link: Column) -> Column:
    """ok, or why a member of an archive is refused: an absolute path, one that leaves the folder, a link."""
    return F.when(name.rlike(r"^([/\\]|[A-Za-z]:)"), "absoluto").when(name.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "sobe").when(link, "ligacao").otherwise("ok")


def mixed_by_identifiers(pages: DataFrame) -> DataFrame:
    """(arquivo, misto, paginas): do at least two identifiers stand on different sets of a file's pages?

    ``pages`` has (arquivo, pagina, ids array<string>). A set of pages is compared by a hash that does not depend on order.
    """
    ids = pages.select("arquivo", "pagina", F.explode("ids").alias("id")).distinct()
    sets = ids.groupBy("arquivo", "id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pagina")).alias("h")).groupBy("arquivo").agg(F.count_distinct("n", "h").alias("k"))
    counts = pages.groupBy("arquivo").agg(F.count("*").alias("paginas"))
    return counts.join(sets, "arquivo", "left").select("arquivo", (F.coalesce("k", F.lit(0)) >= 2).alias("misto"), "paginas")


def duplicates(files: DataFrame) -> DataFrame:
    """(sha8, canonico, n): copies of equal bytes; a name without a number at its end is the canonical one."""
    numbered = F.col("nome").rlike(r"[_ -]\(?[0-9]+\)?\.[^.]+$")
    return files.groupBy("sha8").agg(F.min_by("nome", F.struct(numbered.alias("a"), F.length("nome").alias("b"), "nome")).alias("canonico"), F.count("*").alias("n"))


def queue(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Scanned files with their stored state: new ones are 'novo', stored ones that are no longer there 'sumido'."""
    j = scan.select("sha8", F.lit(True).alias("_seen")).join(stored.select("sha8", "estado"), "sha8", "full")
    return j.select("sha8", F.when(F.col("_seen").isNull(), "sumido").otherwise(F.coalesce("estado", F.lit("novo"))).alias("estado"))


def orphan_state(files: DataFrame, known: DataFrame, hours: int) -> DataFrame:
    """Files (path, horas) against the graph's (path, aresta): linked, without an edge, orphans beyond an age, or recent."""
    state = F.when(F.col("aresta"), "ligado").when(F.col("aresta").isNotNull(), "sem_aresta").when(F.col("horas") > hours, "orfao").otherwise("recente")
    return files.join(known, "path", "left").select("path", state.alias("estado"))


def backfill(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents (doc, sha, nome) with the file (sha, nome, path) of their hash, else of their name, else none."""
    by = lambda key, name: files.groupBy(key).agg(F.min("path").alias(name))
    j = docs.join(by("sha", "_s"), "sha", "left").join(by("nome", "_n"), "nome", "left")
    return j.select("doc", F.coalesce("_s", "_n").alias("path"), F.when(F.col("_s").isNotNull(), "sha256").when(F.col("_n").isNotNull(), "nome").otherwise("quebrado").alias("por"))


def review_queue(items: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """(item, prioridade, motivo): each item once, by the first reason that holds; items without a reason are not in it."""
    at = first_match([(c, i + 1) for i, (c, _) in enumerate(reasons)])
    out = items.select("item", at.alias("prioridade"), first_match(reasons).alias("motivo")).filter("prioridade is not null")
    return out.groupBy("item").agg(F.min("prioridade").alias("prioridade"), F.min_by("motivo", "prioridade").alias("motivo"))


def signed_days(a: Column, b: Column) -> Column:
    """Days from a to b (texts), 0 where either is no date."""
    day = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.datediff(day(b), day(a)), F.lit(0))


def match_name(days: Column, same_value: Column) -> Column:
    return F.when((days == 0) & same_value, "exato").when(days == 0, "mesmo_dia").when(same_value, "mesmo_valor").when(F.abs(days) <= 3, "proximo").otherwise("distante")


def payslip_month(meta: Column, name: Column) -> Column:
    return F.coalesce(meta, F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2})$", 1), F.lit("")))


def fixed(text: Column, fixes: list[tuple[str, str]]) -> Column:
    """Replacements of readings that are wrong only in a context, which the pattern states."""
    for pattern, right in fixes:
        text = F.regexp_replace(text, pattern, right)
    return text


def ingest_documents(docs: DataFrame) -> DataFrame:
    """(doc, fornecedor, periodo): documents with a key and a date, their supplier (made from the name without a tax id) and month."""
    made = F.concat(F.lit("BOLETO|"), F.substring(F.sha2("nome", 256), 1, 12))
    return docs.filter("chave is not null and data is not null").select("doc", F.coalesce("cnpj", made).alias("fornecedor"), F.date_format("data", "yyyy-MM").alias("periodo"))


def receipt_items(items: DataFrame) -> DataFrame:
    """Items (doc, ordem, codigo, qtde, total) numbered in their receipt, with a code by position and quantity 1 by default.

    Items without a total keep their number and go.
    """
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ordem"))
    rows = items.withColumn("n", n).filter("total is not null")
    return rows.select("doc", "n", F.coalesce("codigo", F.concat(F.lit("SEMCOD"), F.lpad(F.col("n").cast("string"), 4, "0"))).alias("codigo"), F.coalesce("qtde", F.lit(1.0)).alias("qtde"), "total")


def special_edges(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, src, dst): an edge for each column that has a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("dst")) for k in kinds]))
    return rows.select("src", pairs.alias("p")).select("p.kind", "src", "p.dst").filter("dst is not null")


def rewritten(rows: DataFrame, canonical: dict[str, str]) -> DataFrame:
    """Rows with ``novo``, the canonical type, and ``mudou``; the old type stays, so a run can be taken back."""
    new = F.col("tipo")
    for old, name in canonical.items():
        new = F.when(F.col("tipo") == old, name).otherwise(new)
    return rows.withColumn("novo", new).withColumn("mudou", F.col("novo") != F.col("tipo"))


def proposal_state(proposals: DataFrame, docs: DataFrame, txs: DataFrame) -> DataFrame:
    """(proposta, estado): alive with both ends there, partial with one, dead without."""
    j = proposals.join(docs.distinct().withColumn("_d", F.lit(True)), "doc", "left").join(txs.distinct().withColumn("_t", F.lit(True)), "tx", "left")
    both = F.coalesce("_d", F.lit(False)), F.coalesce("_t", F.lit(False))
    return j.select("proposta", F.when(both[0] & both[1], "viva").when(both[0] | both[1], "parcial").otherwise("morta").alias("estado"))
