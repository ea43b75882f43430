"""Linkers, drill-downs, merges and migrations over the property graph, and routing of files and searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import fenced
from ledgerloom.operators import graph as G
from ledgerloom.operators import linking as K
from ledgerloom.operators import nearest as N
from ledgerloom.operators import rules as R

from .catalogue import query
from .join_queries import DOCS, EDGES, PAIRS, TXS, documents, edges, transactions
from .ledger import SQL, ledger, table
from .ledger_queries import D

W = f"WITH {SQL}"
DOC = "CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"

# ---- linkers

PIX_TEXT = "CASE WHEN tx % 3 = 0 THEN 'PIX TRANSF supplier ' || tx % 7 WHEN tx % 3 = 1 THEN 'compra e' || lpad(CAST(tx AS STRING), 12, '0') || 'x' ELSE 'TED' END"
PIX_NAME = "CASE WHEN l_suppkey % 2 = 0 THEN 'Supplier de Sousa' ELSE 'De Sa' END"


@query(f"""WITH {DOCS}, {TXS}, {PAIRS}, t AS (SELECT *, {PIX_TEXT} AS texto, {PIX_NAME} AS nome, CASE WHEN l_suppkey % 5 = 0 THEN 'E' || lpad(CAST(tx AS VARCHAR), 12, '0') WHEN l_suppkey % 5 = 1 THEN 'E1' END AS e2e FROM pairs),
 s AS (SELECT *, round(greatest(0.0, least(1.0, 1 - delta * 0.05 - 0.5 * least(diff / greatest(CAST(total AS DOUBLE), 1.0), 1.0))), 4) AS base FROM t)
 SELECT doc, tx, coalesce(length(e2e) >= 8 AND contains(upper(texto), upper(e2e)), FALSE) AS literal, contains(upper(texto), 'PIX') AND contains(upper(nome), 'SUPPLIER') AND contains(upper(texto), 'SUPPLIER') AS nomeado,
 CASE WHEN coalesce(length(e2e) >= 8 AND contains(upper(texto), upper(e2e)), FALSE) THEN 1.0 ELSE round(least(1.0, base + CASE WHEN contains(upper(texto), 'PIX') AND contains(upper(nome), 'SUPPLIER') AND contains(upper(texto), 'SUPPLIER') THEN 0.1 ELSE 0.0 END), 4) END AS score FROM s""")
def pix_links(spark, d):
    """The literal id, else marker and name."""
    p = N.all_pairs(documents(spark, d), transactions(spark, d), 7, 0.02, ["doc", "l_suppkey", "total"]).withColumns({"texto": F.expr(PIX_TEXT), "nome": F.expr(PIX_NAME)})
    e2e = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("E"), F.lpad(F.col("tx").cast("string"), 12, "0"))).when(F.col("l_suppkey") % 5 == 1, "E1")
    literal, named = K.literal_id(e2e, F.col("texto")), K.marked_name(F.col("nome"), ("PIX", "TRANSF"), F.col("texto"))
    return p.select("doc", "tx", literal.alias("literal"), named.alias("nomeado"), K.pix_score(K.score(0.05, F.lit(False)), literal, named).alias("score"))


@query(f"""WITH docs AS (SELECT {DOC} AS doc, l_suppkey, CAST(l_shipdate AS DATE) AS doc_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS total FROM lineitem WHERE l_returnflag = 'A'), {TXS},
 p AS (SELECT doc, tx, CAST(abs(tx_date - doc_date) AS INTEGER) AS delta, abs(CAST(value AS DOUBLE) - CAST(total AS DOUBLE)) AS diff, total, l_suppkey, o_custkey FROM (SELECT *, doc_date + CAST(unnest(range(-30, 31)) AS INTEGER) AS tx_date FROM docs) JOIN txs USING (tx_date)
  WHERE abs(CAST(value AS DOUBLE) - CAST(total AS DOUBLE)) <= greatest(CAST(total AS DOUBLE) * 0.1, 0.01)),
 s AS (SELECT doc, tx, round(greatest(0.0, 1 - delta * 0.02::DOUBLE - least(diff / greatest(CAST(total AS DOUBLE), 1.0), 1.0) * 0.5 + (CASE WHEN l_suppkey % 7 = o_custkey % 7 THEN 0.2 WHEN l_suppkey % 3 = o_custkey % 3 THEN 0.1 ELSE 0.0 END + CASE WHEN o_custkey % 2 = 0 THEN 0.1 ELSE 0.0 END)), 4) AS score FROM p),
 b AS (SELECT doc, arg_min(tx, (-score, tx)) AS tx, max(score) AS score FROM s GROUP BY 1) SELECT *, least(1.0::DOUBLE, score) AS weight FROM b WHERE score >= 0.55""")
def medical_links(spark, d):
    """30 days, 10 %, bonuses for id, person and tag; documents of one kind."""
    docs = documents(spark, d, "l_returnflag").filter("l_returnflag = 'A'").drop("l_returnflag")
    s, c = F.col("l_suppkey"), F.col("o_custkey")
    odd = F.abs(c % 2)  # the tag is on even ones
    same, person = (c % 7) * 2, (c % 3) * 2
    tiers = [N.Tier(same + odd, (s % 7) * 2, 0.3), N.Tier(same + odd, (s % 7) * 2 + 1, 0.2), N.Tier(person + odd, (s % 3) * 2, 0.2), N.Tier(person + odd, (s % 3) * 2 + 1, 0.1), N.Tier(odd, F.lit(0), 0.1)]
    base = [1 - delta * 0.02 for delta in range(31)]
    best = lambda docs: N.best_two(docs, transactions(spark, d), 30, 0.1, base, tiers, ["doc"], most=None, second=False)
    once = lambda docs: best(docs).filter("score >= 0.55").select("doc", "tx", "score", F.least(F.lit(1.0), "score").alias("weight"))
    several = lambda docs: K.best_link(K.candidates(docs, transactions(spark, d), 30, 0.1).withColumn("score", K.medical_score(0.02, s % 7 == c % 7, s % 3 == c % 3, c % 2 == 0)), 0.55)
    return N.by_document(docs, once, several)


@query("""WITH r AS (SELECT p_partkey AS rx, string_split(p_name, ' ')[1] AS name, CAST(DATE '1994-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS DATE) AS since, CAST(p_size % 6 + 1 AS INTEGER) AS months FROM part),
 i AS (SELECT l_orderkey * 10 + l_linenumber AS item, p_name AS text, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT rx, min(item) AS item FROM r JOIN i ON upper(string_split(i.text, ' ')[1]) = upper(name) OR upper(string_split(i.text, ' ')[2]) = upper(name) OR upper(string_split(i.text, ' ')[3]) = upper(name) OR upper(string_split(i.text, ' ')[4]) = upper(name) OR upper(string_split(i.text, ' ')[5]) = upper(name)
 WHERE date BETWEEN since AND since + months * 30 GROUP BY 1""")
def pharmacy_items(spark, d):
    """The first item with the medicine's name while the prescription held."""
    p = table(spark, d, "part")
    rx = p.select(F.col("p_partkey").alias("rx"), F.substring_index("p_name", " ", 1).alias("name"), F.date_add(F.lit("1994-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("since"), (F.col("p_size") % 6 + 1).cast("int").alias("months"))
    items = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("p_name").alias("text"), F.to_date("l_shipdate").alias("date"))
    return K.within_validity(rx, items)


TWINS = """t AS (SELECT p_brand, p_size, p_name, min(p_partkey) AS id FROM part GROUP BY 1, 2, 3), p AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id WHERE levenshtein(a.p_name, b.p_name) <= 4),
 n AS (SELECT l_partkey AS id, count(*) AS v FROM lineitem WHERE l_quantity > 25 GROUP BY 1), x AS (SELECT a, b, coalesce(na.v, 0) AS va, coalesce(nb.v, 0) AS vb FROM p LEFT JOIN n na ON na.id = a LEFT JOIN n nb ON nb.id = b),
 e AS (SELECT CASE WHEN va >= vb THEN b ELSE a END AS loser, CASE WHEN va >= vb THEN a ELSE b END AS winner, greatest(va, vb) AS v FROM x), m AS (SELECT loser, arg_min(winner, (-v, winner)) AS winner FROM e GROUP BY 1)"""


def _merged(spark, d):
    valid = table(spark, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("v"))
    invoices = table(spark, d, "part").select("p_brand", "p_size", "p_name", F.col("p_partkey").alias("id")).join(valid, "id", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return K.twin_groups(invoices, ["p_brand", "p_size"], "p_name", "id", "v")


@query(f"WITH {TWINS} SELECT * FROM m")
def twin_merge(spark, d):
    """Which invoice goes into which; the one with most valid items (E24) wins."""
    return _merged(spark, d)


@query(f"""WITH {TWINS}, r AS (SELECT DISTINCT l_orderkey, coalesce(winner, l_partkey) AS dst FROM lineitem LEFT JOIN m ON loser = l_partkey) SELECT 'o' || l_orderkey AS src, 'p' || dst AS dst FROM r""")
def repointed_edges(spark, d):
    """Edges after the merge, each once."""
    m = _merged(spark, d).select(F.concat(F.lit("p"), F.col("loser").cast("string")).alias("loser"), F.concat(F.lit("p"), F.col("winner").cast("string")).alias("winner"))
    return G.repoint(edges(spark, d).filter("kind = 'contem'"), m).select("src", "dst")


@query()
def similar_files(spark, d):
    """J27 with E51 to E53: pages whose reading failed, and the most similar readable one of the language."""
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    docs = fenced(table(spark, d, "documents").filter("text is not null").select(
        F.col("doc_id").alias("file"), F.col("lang").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).alias("date"),
        words.alias("words"), (F.length("text") < 400).alias("falho"))).withColumn("phash", K.likeness_bits(F.col("words")))
    return K.similar_file(docs.filter("falho"), docs.filter("not falho"), 3, (0.5, 0.3, 0.2), 0.7)


# ---- drill-downs

NODES = """nodes AS (SELECT 'o' || o_orderkey AS id, 'transacao' AS kind, 'pedido ' || o_orderkey AS name FROM orders UNION ALL SELECT 'c' || c_custkey, 'fornecedor', c_name FROM customer UNION ALL SELECT 'p' || p_partkey, 'item', p_name FROM part UNION ALL SELECT 'n' || n_nationkey, 'pais', n_name FROM nation)"""


def nodes(spark, d):
    n = lambda t, p, key, kind, name: table(spark, d, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"))
    return (
        n("orders", "o", "o_orderkey", "transacao", F.concat(F.lit("pedido "), F.col("o_orderkey").cast("string"))).unionByName(n("customer", "c", "c_custkey", "fornecedor", F.col("c_name")))
        .unionByName(n("part", "p", "p_partkey", "item", F.col("p_name"))).unionByName(n("nation", "n", "n_nationkey", "pais", F.col("n_name"))))


@query(f"WITH {EDGES}, {NODES} SELECT src, e.kind, dst, name FROM edges e JOIN nodes ON dst = id WHERE e.kind <> 'de'")
def transaction_life(spark, d):
    """Out-edges of transactions with what they lead to."""
    return G.ends_of(edges(spark, d).filter("kind <> 'de'"), nodes(spark, d))


@query(f"WITH {EDGES}, {NODES} SELECT src, name FROM edges e JOIN nodes ON dst = id WHERE e.kind = 'contraparte'")
def counterparties(spark, d):
    """What one kind of edge leads to."""
    return G.ends_of(edges(spark, d), nodes(spark, d), "contraparte").select("src", "name")


@query(f"""WITH {EDGES} SELECT count(DISTINCT src) FILTER (kind = 'contem') AS com_itens, count(*) FILTER (kind = 'contem') AS itens, count(DISTINCT dst) FILTER (kind = 'contem') AS itens_distintos, count(DISTINCT dst) FILTER (kind = 'contraparte') AS fornecedores FROM edges""")
def drill_down_counts(spark, d):
    """J32."""
    k = lambda kind, c: F.count_distinct(F.when(F.col("kind") == kind, F.col(c)))
    return edges(spark, d).agg(k("contem", "src").alias("com_itens"), F.count_if(F.col("kind") == "contem").alias("itens"), k("contem", "dst").alias("itens_distintos"), k("contraparte", "dst").alias("fornecedores"))


@query(f"""WITH {EDGES}, i AS (SELECT src, count(*) AS itens, min(dst) AS primeiro FROM edges WHERE kind = 'contem' GROUP BY 1), c AS (SELECT src, min(dst) AS fornecedor FROM edges WHERE kind = 'contraparte' GROUP BY 1)
 SELECT 'o' || o_orderkey AS id, fornecedor, coalesce(itens, 0) AS itens, primeiro FROM orders LEFT JOIN i ON i.src = 'o' || o_orderkey LEFT JOIN c ON c.src = 'o' || o_orderkey""")
def drill_down_panel(spark, d):
    """J33, for every transaction: its supplier, items and first item."""
    e = edges(spark, d)
    g = e.groupBy("src").agg(F.count_if(F.col("kind") == "contem").alias("itens"), F.min(F.when(F.col("kind") == "contem", F.col("dst"))).alias("primeiro"), F.min(F.when(F.col("kind") == "contraparte", F.col("dst"))).alias("fornecedor"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"))
    return o.join(g, "src", "left").select(F.col("src").alias("id"), "fornecedor", F.coalesce("itens", F.lit(0)).alias("itens"), "primeiro")


@query(f"""WITH {EDGES}, v AS (SELECT * FROM edges WHERE kind <> 'contem'), g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM v UNION ALL SELECT dst FROM v) GROUP BY 1), t AS (SELECT id FROM g ORDER BY n DESC, id LIMIT 400) SELECT src, dst, kind FROM v WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""")
def visible_edges(spark, d):
    """Edges between the most linked nodes."""
    return G.visible(edges(spark, d).filter("kind <> 'contem'"), 400)[1]


@query("SELECT o_orderkey AS identificador FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def transactions_with_document(spark, d):
    """J29."""
    docs = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(docs, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("identificador"))


@query(f"""{W} SELECT "local", count(*) AS n FROM ledger WHERE categoria = 'BUILDING' GROUP BY 1 ORDER BY n DESC, "local" LIMIT 20""")
def uncategorized_suppliers(spark, d):
    """Suppliers of a category, the most frequent first."""
    return ledger(spark, d).filter("categoria = 'BUILDING'").groupBy("local").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "local").limit(20)


@query("""WITH x AS (SELECT l_orderkey AS doc, count(*) FILTER (l_returnflag = 'R') AS liga, count(*) FILTER (l_returnflag = 'A') AS conflita FROM lineitem GROUP BY 1) SELECT doc, CASE WHEN liga > 0 THEN 'Vinculado' WHEN conflita > 0 THEN 'Conflito' ELSE 'Sem transação' END AS status FROM x""")
def document_status(spark, d):
    """Derived from the edges of a document."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") == "A").alias("b"))
    return g.select("doc", F.when(F.col("a") > 0, "Vinculado").when(F.col("b") > 0, "Conflito").otherwise("Sem transação").alias("status"))


@query(f"""{W}, p AS (SELECT quem, count(*) AS n, count(*) FILTER (identificador IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS c FROM ledger GROUP BY 1) SELECT quem, n, c AS com_doc, round(c * 100.0::DOUBLE / n, 4) AS cobertura FROM p""")
def coverage_by_person(spark, d):
    """A57."""
    docs = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("identificador")).distinct().withColumn("doc", F.lit(1))
    g = ledger(spark, d).join(docs, "identificador", "left").groupBy("quem").agg(F.count("*").alias("n"), F.count("doc").alias("com_doc"))
    return g.withColumn("cobertura", F.round(F.col("com_doc") * 100.0 / F.col("n"), 4))


@query(f"""{W}, e AS (SELECT strftime(data, '%Y-%m') AS mes, banco_origem, valor, identificador FROM ledger WHERE identificador % 9 <> 0 UNION ALL SELECT 'sem data', banco_origem, valor, identificador FROM ledger WHERE identificador % 9 = 0)
 SELECT mes, count(*) AS n, array_to_string(list_sort(list(DISTINCT banco_origem)), '|') AS fornecedores, CAST(sum(valor) AS {D}) AS total FROM e GROUP BY 1""")
def documents_per_month(spark, d):
    """With the undated in a bucket of their own."""
    month = F.coalesce(F.when(F.col("identificador") % 9 != 0, F.date_format("data", "yyyy-MM")), F.lit("sem data"))
    g = ledger(spark, d).groupBy(month.alias("mes")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("banco_origem")), "|").alias("fornecedores"), F.sum("valor").cast("decimal(28,2)").alias("total"))
    return g


@query(f"""{W} SELECT identificador, data, regexp_replace("local", '[0-9]{{5}}', '*****', 'g') AS "local" FROM (SELECT identificador, CASE WHEN identificador % 4 = 0 THEN NULL ELSE data END AS data, "local" FROM ledger) WHERE contains(lower("local"), 'er#00000') ORDER BY data DESC NULLS LAST, identificador LIMIT 30""")
def supplier_statement(spark, d):
    """Literal containment, newest first, undated last, masked."""
    rows = ledger(spark, d).withColumn("data", F.when(F.col("identificador") % 4 != 0, F.col("data"))).filter(F.lower("local").contains("er#00000"))
    return rows.orderBy(F.desc_nulls_last("data"), "identificador").limit(30).select("identificador", "data", F.regexp_replace("local", "[0-9]{5}", "*****").alias("local"))


# ---- migration


@query(f"""{W} SELECT 'banco' AS kind, banco_origem AS name FROM ledger GROUP BY 2 UNION ALL SELECT 'categoria', categoria FROM ledger GROUP BY 2 UNION ALL SELECT 'pessoa', quem FROM ledger GROUP BY 2 UNION ALL SELECT 'periodo', mes_ref FROM ledger GROUP BY 2 UNION ALL SELECT 'fornecedor', "local" FROM ledger GROUP BY 2""")
def migration_nodes(spark, d):
    """One node for each value of five dimensions, in one pass."""
    return G.dimension_nodes(ledger(spark, d), DIMENSIONS)


DIMENSIONS = {"banco": "banco_origem", "categoria": "categoria", "pessoa": "quem", "periodo": "mes_ref", "fornecedor": "local"}


@query(f"""{W} SELECT identificador AS src, 'banco' AS kind, banco_origem AS dst FROM ledger UNION ALL SELECT identificador, 'categoria', categoria FROM ledger UNION ALL SELECT identificador, 'pessoa', quem FROM ledger UNION ALL SELECT identificador, 'periodo', mes_ref FROM ledger UNION ALL SELECT identificador, 'fornecedor', "local" FROM ledger""")
def migration_edges(spark, d):
    """Five edges a transaction."""
    return G.dimension_edges(ledger(spark, d), "identificador", DIMENSIONS)


@query(f"""{W} SELECT upper("local") AS name, count(*) AS n, array_to_string(list_sort(list(DISTINCT CASE WHEN identificador % 2 = 0 THEN "local" ELSE lower("local") END)), '|') AS aliases FROM ledger GROUP BY 1""")
def supplier_nodes(spark, d):
    """Canonical supplier, all forms of its name as aliases."""
    form = F.when(F.col("identificador") % 2 == 0, F.col("local")).otherwise(F.lower("local"))
    return ledger(spark, d).groupBy(F.upper("local").alias("name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(form)), "|").alias("aliases"))


# ---- items, types, routing

ITEM_OVERRIDES = [("blue green", "Azul"), ("Brand#99", "Nunca")]
ITEM_RULES = [(r"\bred\b|rose", "Vermelho"), (r"gr(e|a)y", "Cinza"), (r"^a", "Letra A")]


@query(r"""SELECT p_partkey AS id, CASE WHEN contains(upper(p_name), 'BLUE GREEN') THEN 'Azul' WHEN regexp_matches(p_name, '(?i)\bred\b|rose') THEN 'Vermelho' WHEN regexp_matches(p_name, '(?i)gr(e|a)y') THEN 'Cinza' WHEN regexp_matches(p_name, '(?i)^a') THEN 'Letra A' ELSE 'Outros' END AS categoria FROM part""")
def item_categories(spark, d):
    """Recomputed for all items, so each run replaces the edges of the last."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.item_category(F.col("p_name"), ITEM_OVERRIDES, ITEM_RULES, "Outros").alias("categoria"))


@query(r"""WITH c AS (SELECT p_name AS texto, CASE WHEN contains(upper(p_name), 'BLUE GREEN') OR regexp_matches(p_name, '(?i)\bred\b|rose|gr(e|a)y|^a') THEN 'x' ELSE 'Outros' END AS c FROM part) SELECT texto, count(*) AS n FROM c WHERE c = 'Outros' GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, texto""")
def recurring_items(spark, d):
    """Frequent uncategorized texts, the most frequent first."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("texto"), R.item_category(F.col("p_name"), ITEM_OVERRIDES, ITEM_RULES, "Outros").alias("c"))
    return rows.filter("c = 'Outros'").groupBy("texto").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "texto")


DOCUMENT_RULES = [
    R.DocumentRule("contato", (r"@", r"\.com"), ("text/en", "text/de"), every=True), R.DocumentRule("licenca", (r"license", r"copyright"), sub=(("longa", 2000, None, (), ()), ("curta", 0, 800, (r"license",), (r"the", r"of")))),
    R.DocumentRule("lista", (r"^\s*[-*] ",)), R.DocumentRule("prosa", (r"\w",), ("text/pt", "text/es", "text/fr", "text/de", "text/en")),
]


@query(r"""WITH t AS (SELECT doc_id, 'text/' || lang AS mime, text, length(text) AS n FROM documents), r AS (SELECT *, CASE WHEN n >= 2000 THEN 'longa' WHEN n <= 800 AND regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)the|of') THEN 'curta' END AS s FROM t),
 k AS (SELECT *, CASE WHEN regexp_matches(text, '(?im)@') AND regexp_matches(text, '(?im)\.com') AND mime IN ('text/en', 'text/de') THEN 1 WHEN regexp_matches(text, '(?im)license|copyright') AND s IS NOT NULL THEN 2 WHEN regexp_matches(text, '(?im)^\s*[-*] ') THEN 3
  WHEN regexp_matches(text, '(?im)[\pL\pN_]') AND mime IN ('text/pt', 'text/es', 'text/fr', 'text/de', 'text/en') THEN 4 END AS k FROM r)
 SELECT doc_id, CASE k WHEN 1 THEN 'contato' WHEN 2 THEN 'licenca' WHEN 3 THEN 'lista' WHEN 4 THEN 'prosa' END AS tipo, CASE WHEN k = 2 THEN s END AS sub FROM k""")
def document_types(spark, d):
    """R13 with F8 to F10: order, file kind, any or all patterns, sub-rules."""
    kind, sub = R.classify(F.concat(F.lit("text/"), "lang"), F.col("text"), DOCUMENT_RULES)
    return table(spark, d, "documents").select("doc_id", kind.alias("tipo"), sub.alias("sub"))


@query("""SELECT page_id, CASE WHEN url LIKE '%/m/%' OR page_id % 11 = 0 THEN 'movel' WHEN page_id % 5 = 0 THEN 'planilha_legado' WHEN page_id % 5 = 1 THEN CASE WHEN contains(lower(html), 'table') THEN 'ofx' ELSE 'regras' END
 WHEN page_id % 5 = 2 THEN CASE WHEN contains(lower(html), 'title') THEN 'holerite' ELSE 'regras' END ELSE 'regras' END AS rota FROM pages""")
def type_registry(spark, d):
    """A mobile hint wins, then each kind of file asks its detectors in order, rules come last."""
    k, html = F.col("page_id"), F.lower("html")
    detectors = {"planilha": [(F.lit(True), "planilha_legado")], "ofx": [(html.contains("table"), "ofx")], "pdf": [(html.contains("title"), "holerite")]}
    mime = F.when(k % 5 == 0, "planilha").when(k % 5 == 1, "ofx").when(k % 5 == 2, "pdf").otherwise("outro")
    hint = F.when(F.col("url").contains("/m/") | (k % 11 == 0), "movel")
    return table(spark, d, "pages").select("page_id", R.route(hint, mime, detectors, "regras").alias("rota"))


@query(f"""{W} SELECT identificador, CASE WHEN identificador % 6 = 0 THEN 'pessoa_a' WHEN contains("local", '77') THEN 'pessoa_b' WHEN identificador % 4 = 1 THEN 'pessoa_b' ELSE 'casal' END AS pessoa, CASE WHEN identificador % 6 = 0 THEN 'texto' WHEN contains("local", '77') THEN 'nome' WHEN identificador % 4 = 1 THEN 'pasta' ELSE 'padrão' END AS origem FROM ledger""")
def file_person(spark, d):
    """The person of a file by its text, its name, its folder, else the couple, and what said so."""
    k = F.col("identificador")
    said = [(k % 6 == 0, "pessoa_a", "texto"), (F.col("local").contains("77"), "pessoa_b", "nome"), (k % 4 == 1, "pessoa_b", "pasta")]
    return ledger(spark, d).select("identificador", R.first_match([(c, p) for c, p, _ in said], "casal").alias("pessoa"), R.first_match([(c, o) for c, _, o in said], "padrão").alias("origem"))


@query("""WITH q AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS q FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT 'extrato' UNION SELECT 'al' UNION SELECT 'inda' UNION SELECT 'nada disso'),
 n AS (SELECT lower(n_name) AS n FROM nation), s AS (SELECT q, min(n) AS n FROM q, n WHERE length(q) >= 4 AND contains(n, q) GROUP BY 1)
 SELECT q.q, CASE WHEN q.q IN ('extrato', 'contas') THEN 'aba' WHEN q.q IN (SELECT n FROM n) THEN 'fornecedor' WHEN s.n IS NOT NULL THEN 'parcial' ELSE 'livre' END AS rota, CASE WHEN q.q IN ('extrato', 'contas') THEN q.q WHEN q.q IN (SELECT n FROM n) THEN q.q ELSE s.n END AS alvo FROM q LEFT JOIN s ON s.q = q.q""")
def search_routes(spark, d):
    """Exact tab, exact supplier, part of a supplier of at least four letters, free."""
    first = F.lower(F.substring_index("p_name", " ", 1)).alias("q")
    q = table(spark, d, "part").select(first).unionByName(table(spark, d, "nation").select(F.lower("n_name").alias("q"))).unionByName(spark.createDataFrame([(x,) for x in ("extrato", "al", "inda", "nada disso")], "q string")).distinct()
    return R.search_routes(q, ["extrato", "contas"], table(spark, d, "nation").select(F.lower("n_name").alias("name")))


@query("""WITH g AS (SELECT string_split(p_name, ' ')[1] AS token, count(*) AS n, count(DISTINCT p_brand) AS r FROM part GROUP BY 1) SELECT token, n, round(0.4 * least(n / 10.0::DOUBLE, 1.0) + 0.6 * least(r / 3.0::DOUBLE, 1.0), 6) AS confianca FROM g WHERE n >= 2""")
def proposal_confidence(spark, d):
    """R24."""
    g = table(spark, d, "part").groupBy(F.substring_index("p_name", " ", 1).alias("token")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("r")).filter("n >= 2")
    return g.select("token", "n", F.round(0.4 * F.least(F.col("n") / 10.0, F.lit(1.0)) + 0.6 * F.least(F.col("r") / 3.0, F.lit(1.0)), 6).alias("confianca"))
