"""Queries read all rows of their tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import catalogue
from ledgerloom.plans.ledger import ledger, table


def run(spark, sf, name):
    return catalogue.QUERIES[name](spark, sf)


@pytest.mark.parametrize("name, where", [("ofx_parse", "true"), ("statement_text_parse", "identificador % 3 <> 0"), ("card_bill_parse", "not (month(data) = 2 and day(data) = 29)"), ("boleto_parse", "true"), ("conform_rows", "true"), ("energy_bills", None)])
def test_readers_see_every_ledger_row(spark, sf, name, where):
    n = ledger(spark, sf).filter(where or "true").count()
    assert run(spark, sf, name).count() >= n if where is None else run(spark, sf, name).count() == n


def test_recall_sees_every_order(spark, sf):
    assert run(spark, sf, "receipt_recall").count() == table(spark, sf, "lineitem").select("l_orderkey").distinct().count()


@pytest.mark.parametrize("name", ["link_candidates", "link_decision", "grid_min_window"])
def test_links_reach_documents_of_every_quantity(spark, sf, name):
    li = table(spark, sf, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as doc", "l_quantity")
    assert run(spark, sf, name).join(li.filter("l_quantity < 49"), "doc", "left_semi").count() > 0


def test_two_hops_start_at_every_customer(spark, sf):
    buyers = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey").distinct().count()
    assert run(spark, sf, "two_hop_items").select("src").distinct().count() == buyers > 20
