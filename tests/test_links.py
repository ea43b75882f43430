"""Document types, links, prescriptions and similar files on odd rows, against SQL or plain code."""

import datetime as dt
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import linking as K
from ledgerloom.operators import nearest as N
from ledgerloom.plans import catalogue
from test_oracle import rows


def test_document_types_of_odd_letters_and_line_ends_equal_sql(spark, tmp_path):
    texts = ["é", "中文", "½", "٣", "_", "ͅ", "-", "a\r- x", "a\x0b- x", "\x0b- x", "a\x85- x", "a * x", "a\n\n - x", "a\r\n- x", "lİcense the", "lıcense of", "LICENſE the", "lıcense " + "x" * 2000, None]
    rows = [(10 * i + j, t, lang) for i, t in enumerate(texts) for j, lang in enumerate(("en", "pt", "zh", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["document_types"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.execute(catalogue.SQL["document_types"]).fetchall()) and len(got) == len(rows)


def test_an_invoice_is_parsed_once(spark, sf):
    for name in ("xml_invoices", "xml_items"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_xml(") == 1, name


def test_first_items_of_periods_equal_a_plain_search(spark):
    rng = np.random.default_rng(2)
    names = ["", "AB", "AB CD", "cd", "É", "AB  CD", None]
    items = [(int(i), " ".join(rng.choice(["ab", "cd", "ef", "é", "abcd"], rng.integers(1, 4))), dt.date(1969, 1, 1) + dt.timedelta(int(rng.integers(0, 800)))) for i in rng.permutation(600)]
    items += [(1000, None, dt.date(1969, 5, 5)), (1001, "ab", None), (-5, "ab", dt.date(1999, 1, 1)), (1002, "ab cd", dt.date(1990, 1, 1))]
    rx = [(i, names[rng.integers(0, len(names))], dt.date(1968, 10, 1) + dt.timedelta(int(rng.integers(0, 900))), int(rng.integers(-1, 8))) for i in range(300)]
    rx += [(300, "ab", dt.date(1960, 1, 1), 600), (301, "ab", dt.date(1975, 1, 1), 1), (302, "ab", None, 3)]
    want = {}
    for r, name, since, months in rx:
        if name is None or since is None:
            continue
        name = name.upper()
        fits = [i for i, t, d in items if t and d and name.split(" ")[0] in t.upper().split() and name in t.upper() and since <= d <= since + dt.timedelta(30 * months)]
        want |= {r: min(fits)} if fits else {}
    got = K.within_validity(spark.createDataFrame(rx, "rx int, name string, since date, months int"), spark.createDataFrame(items, "item int, text string, date date"))
    assert {r["rx"]: r["item"] for r in got.collect()} == want and len(want) > 100


def test_a_frequent_medicine_makes_no_pairs(spark):
    rx = spark.range(3000).selectExpr("id as rx", "'ab' as name", "date '2020-01-01' + cast(id % 500 as int) as since", "3 as months")
    items = spark.range(30000).selectExpr("id as item", "'ab cd' as text", "date '2020-01-01' + cast(id % 700 as int) as date")
    found = K.within_validity(rx, items)
    assert found.count() == 3000
    assert found.agg(F.max("item")).first()[0] == 499
    made = joined_rows(found)
    assert 0 < made < 30000


def joined_rows(df):
    """The most rows that a join of the run makes."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in name:
            todo.append(p.plan())
    return most


def near_rows(rng, n, m, values=400):
    day = lambda k: dt.date(1969, 11, 1) + dt.timedelta(int(k))
    money = lambda: Decimal(int(rng.integers(-20, values))) / (1 if rng.random() < 0.9 else 100)
    docs = [(f"d{i}", day(rng.integers(0, 90)), money(), int(rng.integers(-5, 40))) for i in range(n)] + [("n1", None, Decimal(5), 1), ("n2", day(3), None, 2), ("n3", day(40), Decimal(50), None)]
    txs = [(int(i) * 7, day(rng.integers(0, 90)), money(), int(rng.integers(-5, 40))) for i in rng.permutation(m)] + [(-1, None, Decimal(5), 1), (-2, day(3), None, 2), (-3, day(40), Decimal(50), None)]
    return docs, txs


def near_frames(spark, docs, txs):
    return spark.createDataFrame(docs, "doc string, doc_date date, total decimal(18,2), s long"), spark.createDataFrame(txs, "tx long, tx_date date, value decimal(18,2), c long")


@pytest.mark.parametrize("days, percent, most", [(7, 0.02, 1.0), (30, 0.1, None)])
def test_best_windows_and_pairs_equal_the_joined_ones(spark, days, percent, most):
    docs, txs = near_frames(spark, *near_rows(np.random.default_rng(days), 400, 900))
    pairs = K.candidates(docs, txs, days, percent).cache()
    listed = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = listed(pairs.select("doc", "tx", "delta", F.round("diff", 6)))
    assert listed(N.all_pairs(docs, txs, days, percent, ["doc"]).select("doc", "tx", "delta", F.round("diff", 6))) == want and len(want) > 500
    first = pairs.groupBy("doc").agg(F.min(F.struct("delta", "diff")).alias("m")).select("doc", "m.delta", F.round("m.diff", 6))
    assert listed(N.first_window(docs, txs, days, percent, ["doc"]).select("doc", "delta", F.round("diff", 6))) == listed(first)
    same, other = F.col("s") % 7 == F.col("c") % 7, F.col("s") % 3 == F.col("c") % 3
    tiers = [N.Tier(F.col("c") % 7, F.col("s") % 7, 0.3, 0.1), N.Tier(F.col("c") % 3, F.col("s") % 3, 0.1)]
    part = F.least(F.col("diff") / F.greatest(F.abs(F.col("total").cast("double")), F.lit(1.0)), F.lit(1.0))
    raw = 1 - F.col("delta") * 0.02 - 0.5 * part + F.when(same, F.when(F.col("delta") == 0, 0.4).otherwise(0.3)).when(other, 0.1).otherwise(0.0)
    scored = pairs.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(raw, F.lit(most or 9.0))), 4))
    base = [1 - delta * 0.02 for delta in range(days + 1)]
    decided = K.decide(scored, 0.02, 0.7)
    assert listed(K.verdicts(N.best_two(docs, txs, days, percent, base, tiers, ["doc"], most), 0.02, 0.7)) == listed(decided)
    one = N.best_two(docs, txs, days, percent, base, tiers, ["doc"], most, second=False)
    assert listed(one) == listed(decided.select("doc", "tx", "score", F.lit(None)))


def test_large_places_are_read_in_blocks(spark, monkeypatch):
    docs, txs = near_frames(spark, *near_rows(np.random.default_rng(4), 300, 300, 60))
    placed = N._placed(docs, txs, 7, 0.02, 0.01, [(F.lit(0), F.lit(0))], ["doc"])
    listed = [tuple(r) for r in placed.collect()]
    taken = []

    def run(place):
        taken.append(len(place.doc["day"]))
        for shift in range(-7, 8):
            for d, t, _ in place.pairs(0, np.arange(len(place.doc["day"])), shift):
                yield d, [pa.array(place.tx["tx"][t])]

    table = pa.Table.from_pylist([dict(zip(placed.columns, r[:-1] + ({"doc": r[-1]["doc"]} if r[-1] else None,))) for r in listed])
    answer = lambda: sorted((r["kept"]["doc"], r["tx"]) for b in N._batches(run, 1, 7, ["kept", "tx"])(iter(table.to_batches(16))) for r in b.to_pylist())
    whole = answer()
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "PAIRS", 20)
    taken.clear()
    assert answer() == whole and len(whole) > 200 and len(taken) > 10


def test_best_links_list_no_pairs(spark):
    docs = spark.range(1500).selectExpr("cast(id as string) doc", "date '2020-01-01' doc_date", "cast(1000 as decimal(18,2)) total", "id s")
    txs = spark.range(1500).selectExpr("id tx", "date '2020-01-02' tx_date", "cast(1001 as decimal(18,2)) value", "id c")
    found = N.best_two(docs, txs, 7, 0.02, [1.0] * 8, [N.Tier(F.col("c") % 7, F.col("s") % 7, 0.3)], ["doc"])
    assert joined_rows(found) == 0 and {r["tx"] for r in found.collect()} == {0, 1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("name", ["link_decision", "bulk_links", "link_diagnosis", "grid_min_window", "medical_links", "link_candidates", "pix_links"])
def test_links_join_no_pairs_and_hold_repeated_documents(spark, sf, tmp_path, name):
    assert "mapInArrow" in (plan := catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) or "MapInArrow" in plan
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    twice = li.filter("l_orderkey % 5 = 0").selectExpr("* except (l_extendedprice, l_shipdate)", "l_extendedprice * 1.001 as l_extendedprice", "l_shipdate + interval 1 day as l_shipdate")
    li.unionByName(twice).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{sf}/orders.parquet").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.execute(catalogue.SQL[name]).df())


def test_similar_files_equal_a_plain_search(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(300)]
    row = lambda i: (i, str(rng.choice(["a", "b"])), dt.date(2024, 1, 1) + dt.timedelta(int(rng.integers(0, 25))), int(rng.integers(0, 1 << 32)) & int(rng.integers(0, 1 << 32)), rng.choice(vocabulary, rng.integers(0, 150), replace=False).tolist())
    failed, good = [row(i) for i in range(120)] + [(120, "a", dt.date(2024, 1, 5), (1 << 32) - 1, ["w1"])], [row(1000 + i) for i in range(150)] + [(1150, "a", dt.date(2024, 1, 5), 0, ["w1", "w2"])]
    want = {}
    for f, k, d, h, w in failed:
        for g, k2, d2, h2, w2 in good:
            delta = abs((d - d2).days)
            if k == k2 and delta <= 3:
                bits, near, common = 1 - bin(h ^ h2).count("1") / 32, max(0.0, 1 - delta / 3), min(1.0, len(set(w) & set(w2)) / 3)
                score = round(0.5 * bits + 0.3 * near + 0.2 * common if bits > 0 else (0.3 * near + 0.2 * common) / 0.5, 6)
                if score >= 0.7 and (f not in want or (-score, g) < (-want[f][1], want[f][0])):
                    want[f] = (g, score)
    frame = lambda x: spark.createDataFrame(x, "file long, kind string, date date, phash long, words array<string>")
    got = {r["file"]: (r["similar"], r["score"]) for r in K.similar_file(frame(failed), frame(good), 3, (0.5, 0.3, 0.2), 0.7).collect()}
    assert got == want and len(want) > 30


def test_bits_of_words_are_voted_once(spark, sf):
    words = [["a", "b", "c"], [], None, ["x"] * 5 + ["y"] * 4, ["é", "b"]]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    got = [r[0] for r in df.select(K.likeness_bits(F.col("w"))).collect()]
    hashes = [r[0] for r in df.select(F.transform("w", lambda w: F.xxhash64(w))).collect()]
    assert got == [sum(1 << i for i in range(32) if 2 * sum(h >> i & 1 for h in hs or []) > len(hs or [])) for hs in hashes]
    assert catalogue.QUERIES["similar_files"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
