"""Text operators over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import text_ops as T
from ledgerloom.operators.rules import first_match

from .catalogue import query
from .ledger import table


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}\b', '**.***.***/****-**', 'g'),
 '\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b', '***.***.***-**', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '***@***', 'g') AS masked FROM documents""")
def pii_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mask_pii(F.col("text")).alias("masked"))


@query("""SELECT doc_id, (a < 40) OR (n > 100 AND n - a > n * 0.5) AS illegible FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^A-Za-z0-9À-ÿ]', '', 'g')) AS a FROM documents)""")
def legibility(spark, d):
    return table(spark, d, "documents").select("doc_id", X.illegible(F.col("text")).alias("illegible"))


@query("""WITH g AS (SELECT text, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1) SELECT keep AS doc_id, n FROM g""")
def exact_text_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("""SELECT doc_id, CASE WHEN text LIKE '%@%' THEN 'contato' WHEN length(text) < 300 THEN 'curto' WHEN lang = 'en' AND contains(text, 'the') THEN 'ingles' ELSE 'outro' END AS tipo FROM documents""")
def doc_classify(spark, d):
    rules = [(F.col("text").contains("@"), "contato"), (F.length("text") < 300, "curto"), ((F.col("lang") == "en") & F.col("text").contains("the"), "ingles")]
    return table(spark, d, "documents").select("doc_id", first_match(rules, "outro").alias("tipo"))


@query(r"""WITH t AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-zA-ZÀ-ÿ0-9]{2,}')) AS token FROM part)
 SELECT token, count(*) AS df, round(ln(CAST((SELECT count(*) FROM part) AS DOUBLE) / (1 + count(*))) + 1, 9) AS idf FROM t GROUP BY 1""")
def tfidf_idf(spark, d):
    part = table(spark, d, "part")
    return T.idf(T.term_counts(part, "p_partkey", "p_name"), part.count()).withColumn("idf", F.round("idf", 9))


@query(r"""WITH c AS (SELECT p_name AS text, p_brand AS label, min(p_partkey) AS id FROM part GROUP BY 1, 2), qs AS (SELECT p_name AS text, min(p_partkey) AS q FROM part GROUP BY 1),
 ct AS (SELECT id, token, count(*) AS c, any_value(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS token FROM (SELECT id, regexp_extract_all(lower(text), '[a-zA-ZÀ-ÿ0-9]{2,}') AS t FROM c)) GROUP BY 1, 2),
 i AS (SELECT token, ln(CAST((SELECT count(*) FROM c) AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM ct GROUP BY 1),
 qt AS (SELECT q, token, count(*) AS c, any_value(len) AS len FROM (SELECT q, len(t) AS len, unnest(t) AS token FROM (SELECT q, regexp_extract_all(lower(text), '[a-zA-ZÀ-ÿ0-9]{2,}') AS t FROM qs)) GROUP BY 1, 2),
 cv AS (SELECT id, token, c / len * idf AS w FROM ct JOIN i USING (token) WHERE idf > 0), qv AS (SELECT q, token, c / len * idf AS w FROM qt JOIN i USING (token) WHERE idf > 0),
 cw AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM cv), qw AS (SELECT q, token, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qv),
 s AS (SELECT q, id, sum(qw.w * cw.w) AS cosine FROM qw JOIN cw USING (token) GROUP BY 1, 2),
 top AS (SELECT q, id, cosine FROM s WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, id) <= 5),
 v AS (SELECT q, label, sum(cosine) AS vote FROM top JOIN c USING (id) GROUP BY 1, 2)
 SELECT q, arg_min(label, (-round(vote, 9), label)) AS label, round(max(vote) / sum(vote), 3) AS confidence FROM v GROUP BY 1""")
def tfidf_knn_vote(spark, d):
    part = table(spark, d, "part")
    corpus = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_brand").alias("label"))
    queries = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("q"))
    return T.knn_vote(queries, corpus, 5)


@query(r"""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) SELECT token, count(*) AS n FROM t WHERE length(token) >= 4 GROUP BY 1 HAVING count(*) >= 5""")
def shared_token_groups(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("token"))
    return p.filter(F.length("token") >= 4).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 5")


@query("""(SELECT 'part' AS kind, CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%re%' ORDER BY p_partkey LIMIT 50)
 UNION ALL (SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%re%' ORDER BY s_suppkey LIMIT 50)
 UNION ALL (SELECT 'nation', n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%re%' ORDER BY n_nationkey LIMIT 50)""")
def global_search(spark, d):
    out = None
    for kind, key, name in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name")):
        rows = table(spark, d, kind).filter(F.lower(name).contains("re")).orderBy(key).limit(50).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH u AS (SELECT n_name AS name, 1 AS prio FROM nation UNION ALL SELECT p_name, 2 FROM part), f AS (SELECT lower(name) AS k, min(prio) AS prio, min(name) AS name FROM u WHERE lower(name) LIKE 'b%' GROUP BY 1)
 SELECT name, prio FROM f ORDER BY prio, name LIMIT 10""")
def autocomplete(spark, d):
    u = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("prio")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit(2).alias("prio")))
    f = u.filter(F.lower("name").startswith("b")).groupBy(F.lower("name").alias("k")).agg(F.min("prio").alias("prio"), F.min("name").alias("name"))
    return f.orderBy("prio", "name").limit(10).select("name", "prio")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
 CAST(len(regexp_extract_all(html, '<a href="')) AS INTEGER) AS links FROM pages""")
def html_extract(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, r'<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit(r'(<a href=")'), F.lit(1))).alias("links"))


NAMES = ("concat_ws(' ', reverse(split(p_name, ' ')))", "upper(p_name) || ' LTDA'", "p_name || 'x'", "substring_index(p_name, ' ', 1)", "'novo ' || p_brand")
PRODUCTS = ("p_name", "concat_ws(' ', reverse(split(p_name, ' ')))", "p_name || ' 500 ML'", "p_name || 's SPRAY'", "p_name || ' ' || p_brand")


def _one_of(forms) -> str:
    return "case p_partkey % 5 " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"


def names_to_resolve(spark, d):
    """(names, canonical names): part names turned, with a suffix, with a typing error, cut, and others."""
    p = table(spark, d, "part")
    ident = lambda n: F.when(F.col("p_partkey") % n == 0, F.concat(F.lit("id"), F.col("p_size").cast("string")))
    canon = p.groupBy(F.col("p_name").alias("canonical")).agg(F.min(ident(2)).alias("tax_id"))
    return p.select(F.expr(_one_of(NAMES)).alias("name"), ident(7).alias("tax_id")), canon


@query()
def entity_resolution(spark, d):
    """J18."""
    return T.resolve_names(*names_to_resolve(spark, d))


def products(spark, d):
    """(id, name): part names turned, with amounts, with endings, with brands."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_one_of(PRODUCTS)).alias("name"))


@query()
def product_clusters(spark, d):
    """95 joins, 80 proposes."""
    return T.cluster_products(products(spark, d))


@query()
def product_groups(spark, d):
    """Clusters of two and more."""
    return T.shared_clusters(T.cluster_products(products(spark, d)))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(upper(p_name), '\b[0-9]+([.,][0-9]+)?\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM part""")
def product_names(spark, d):
    """P17 and P18 over names without units."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.normal_product(F.col("p_name")).alias("norm"))


def policies_and_items(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    rows = li.select(item.alias("item"), F.col("l_suppkey").alias("seller"), F.to_date("l_shipdate").alias("date"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    policies = rows.select(F.col("item").alias("policy"), "seller", F.date_add("date", 1).alias("date"), F.concat(F.substring_index("text", " ", 2), F.lit(" EX")).alias("text"))
    return policies, rows


@query()
def item_fuzzy_match(spark, d):
    """Seller, a day, 82, and no tie within 5; one policy for each item."""
    return T.match_items(*policies_and_items(spark, d))


@query(r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(c_name), '[.,;:\-()/]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm,
 substring(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM customer""")
def supplier_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.normal_supplier(F.col("c_name")).alias("norm"), X.slug(F.col("c_name")).alias("slug"))


@query("""SELECT conv_id, CASE WHEN max(CASE WHEN lower(text) LIKE '%password%' OR lower(text) LIKE '%secret%' THEN 1 ELSE 0 END) = 1 THEN 'ALTO' WHEN count(*) > 6 THEN 'MEDIO' ELSE 'BAIXO' END AS risco FROM conversations GROUP BY 1""")
def domain_risk(spark, d):
    bad = F.lower("text").contains("password") | F.lower("text").contains("secret")
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(bad.cast("int")).alias("b"), F.count("*").alias("n"))
    return g.select("conv_id", first_match([(F.col("b") == 1, "ALTO"), (F.col("n") > 6, "MEDIO")], "BAIXO").alias("risco"))
