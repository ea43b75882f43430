"""URL filter, WARC, chat formatting, the queries with SQL, and the pipeline as a whole."""

import gzip
import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import chat, registry, url_filter, warc
from ledgerloom.llm.common import work_dir


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf), con.execute(registry.SQL[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert columns == sorted(names)
    rows = lambda it, order: sorted(tuple(str(r[order.index(c)]) for c in columns) for r in it)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), names)


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.NET/en/x"), (2, "https://example.net/de"), (3, "http://x.org/fr/"), (4, "http://example.com/de/?q"), (5, None), (6, "no scheme"),
         (7, "http://notnet/"), (8, "ftp://b.bad.example/p#f"), (8, "ftp://b.bad.example/p#f"), (9, "http://")],
        "page_id long, url string",
    ).selectExpr("*", "'x' as verdict", "1 as host")
    outcomes = spark.createDataFrame([(8, 1)] * 40 + [(7, 0)] * 40 + [(None, 1), (3, None)], "page_id long, bad int")
    rows = url_filter.filter_urls(pages.select("page_id", "url"), outcomes).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 10
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("org/fr/", "allow") and got[4][2:] == ("example.com/de/", "block")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][2:] == (None, "allow") and got[8] == ("b.bad.example", "/p", None, "block")


def test_sites_suffixes_and_domains(spark):
    hosts = [("a.b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("u@x.example.com:8080", "com", "example.com"), ("10.0.0.1:80", "10.0.0.1", "10.0.0.1"),
             ("[::1]:80", "[::1]", "[::1]"), ("localhost", "localhost", "localhost"), ("", "", ""), ("example.org.", "org", "example.org")]
    df = spark.createDataFrame([(h,) for h, _, _ in hosts], "host string").withColumn("site", url_filter.site_of(url_filter.F.col("host")))
    got = {r["host"]: (r["s"], r["d"]) for r in df.select("host", url_filter.suffix_of(url_filter.F.col("site")).alias("s"), url_filter.domain_of(url_filter.F.col("site")).alias("d")).collect()}
    assert got == {h: (s, d) for h, s, d in hosts}


def test_reputation_is_shared_by_domain_but_not_by_public_suffix(spark):
    pages = [(i, f"http://h{i % 7}.bad.co.uk/{i}") for i in range(70)] + [(100 + i, f"http://h{i}.good.co.uk:81/{i}") for i in range(70)]
    pages += [(300, "http://new.bad.co.uk/"), (301, "http://new.good.co.uk/"), (302, "http://other.co.uk/")]
    outcomes = [(i, int(i < 70)) for i in [*range(70), *range(100, 170)]] * 2
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int").distinct()
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(*frames).collect()}
    assert got[300] == "block" and got[301] == "allow" and got[302] == "allow" and got[5] == "block" and got[105] == "allow"
    assert url_filter.filter_urls(frames[0].limit(0), frames[1]).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(frames[0], frames[1].limit(0)).collect()} == {"allow"}


def test_bound_is_near_the_beta_quantile():
    rng = np.random.default_rng(2)
    for a, b in ((9, 1), (5, 5), (6.5, 3.5), (12, 4), (60, 40)):
        m = a / (a + b)
        lower = m - url_filter.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert abs(lower - np.quantile(rng.beta(a, b, 200_000), 0.05)) < 0.06


def test_warc_of_odd_pages(spark):
    rng = np.random.default_rng(1)
    big = bytes(rng.integers(97, 123, 5_000_000, dtype=np.uint8)).decode()
    huge = "WARC/1.1\r\n" + "z" * (17 << 20)  # its gzip member does not end with a zero byte
    rows = [(1, "http://a/\x01\x0b\x85 x", "k" * 200), (1, "http://a/", "k" * 200), (None, "n", "k" * 200), (None, None, "m" * 200), (5, "b", big), (6, "b", big), (7, "h", huge), (8, "t", "tail")]
    path = work_dir(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df.selectExpr("*", "1 as digest", "2 as first"), path, archive_bytes=1000)
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["target_uri"] or "", r["path"]) for r in warc.read_warc(spark, path, payloads=False).collect())
    assert [x[:4] for x in got] == [
        ("<urn:page:1>", "response", "", 200), ("<urn:page:1>", "response", "", 200), ("<urn:page:5>", "response", "", 5_000_000), ("<urn:page:6>", "revisit", "<urn:page:5>", 5_000_000),
        ("<urn:page:7>", "response", "", len(huge)), ("<urn:page:8>", "response", "", 4), ("<urn:page:none>", "response", "", 200), ("<urn:page:none>", "revisit", "<urn:page:1>", 200),
    ]
    assert "http://a/%01%0B%C2%85%20x" in {x[4] for x in got} and len({x[5] for x in got}) > 3
    first = sorted({x[5] for x in got})[0].removeprefix("file:")
    assert gzip.open(first).read().startswith(b"WARC/1.1")
    path = work_dir(spark, "warc-test")
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_round_trip_with_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", inner * 3), (2, "http://b/", "x" * 100), (3, None, "x" * 100), (4, "u\r\nv", None), (5, "http://c/", "x" * 99), (6, "http://d/", "x" * 99), (7, "e", "é\n日\r\n\r\n")]
    path = work_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[f"<urn:page:{i}>"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r["record_type"] == ("revisit" if i == 3 else "response")
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == raw
    assert got["<urn:page:3>"]["refers_to"] == "<urn:page:2>"


@pytest.mark.parametrize("name, pack", [("x.warc.gz", gzip.compress), ("part-1.warc", bytes)])
def test_warc_of_a_member_for_each_record_and_without_compression(spark, tmp_path, name, pack):
    body = b"".join(b"%09d" % i for i in range(9000))
    record = lambda i: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)
    (tmp_path / name).write_bytes(b"".join(pack(record(i)) for i in range(5)))
    assert sorted(r["record_id"] for r in warc.read_warc(spark, str(tmp_path)).collect()) == [f"<urn:page:{i}>" for i in range(5)]


def test_chat_is_reversible(spark):
    turns = [
        (1, 2, "assistant", "<|end|> \\ |\\> <\\| |>"), (1, 1, "user", "a<|next|>b"), (1, 3, "assistant", ""), (1, None, "system", None),
        (2, 1, None, "<|role:user|>"), (2, 1, None, "<|role:user|>"), (None, 1, "assistant", "\\"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    out = chat.format_chats(df).select("conv_id", chat.parse_chat(chat.F.col("formatted")).alias("t"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["t"]], r["loss"]) for r in out.collect()}
    assert got[1] == ([("system", ""), ("user", "a<|next|>b"), ("assistant", "<|end|> \\ |\\> <\\| |>"), ("assistant", "")], "<|end|> \\ |\\> <\\| |>")
    assert got[2] == ([("", "<|role:user|>")] * 2, "") and got[None] == ([("assistant", "\\")], "\\")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "simhash near-dedup", "substring dedup", "best-fit packing"]
    before = None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "stage-test")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            ids = [r[0] for r in docs.select("doc_id").collect()]
            assert ids and len(ids) == len(set(ids)) and (before is None or set(ids) <= before)
            before = set(ids)
    assert {r[0] for r in docs.select("doc_id").collect()} == before
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_takes_empty_and_null_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "x", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == 0
