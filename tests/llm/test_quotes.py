"""Quotation linking (3)."""

import os
import sys

from wartalens.llm import quote_links

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_same_rows(spark):
    assert compare(spark, connect(SF), "op3_quotation_links", SF).startswith("ok")


def answered(spark, rows):
    df = spark.createDataFrame(rows, "msg_id bigint, text string, body string, depth int")
    return {r["msg_id"]: r for r in quote_links.conversations(df).collect()}


def test_levels_and_order(spark):
    got = answered(spark, [
        (1, "Hello  there", "x", 0), (2, "> hello there\nHi", None, None), (3, ">> Hello there\n> hi\n\nFine", None, None),
        (4, "> > Hello there\n> unknown\nLate", None, None), (5, "On Monday A wrote:\n> Hi\nYes\n>\n> Hi\nNo", None, None),
        (6, None, None, None), (7, "> nobody said this\nNew", None, None), (8, "> Fine\n> Fine", None, None),
    ])
    assert {k: r["parent_id"] for k, r in got.items()} == {1: None, 2: 1, 3: 2, 4: 1, 5: 2, 6: None, 7: None, 8: None}
    assert {k: r["root_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8}
    assert [got[k]["depth"] for k in (1, 2, 3, 4, 5)] == [0, 1, 2, 1, 2]
    assert [got[k]["position"] for k in (1, 2, 4, 3, 5)] == [0, 1, 2, 3, 4]
    assert got[5]["body"] == "Yes\nNo" and got[3]["body"] == "Fine" and got[6]["body"] == "" and got[8]["body"] == ""


def test_copies_link_to_the_first_and_nulls_stay(spark):
    rows = [(1, "same", None, None), (2, "same", None, None), (3, "> same\nre", None, None)]
    got = answered(spark, rows)
    assert got[3]["parent_id"] == 1 and got[2]["root_id"] == 2
    df = spark.createDataFrame([(None, "> same\nx"), (None, None), (1, "same"), (1, "same")], "msg_id bigint, text string")
    assert quote_links.conversations(df).count() == 4
    assert quote_links.conversations(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(0, "m0", None, None)] + [(i, f"> m{i - 1}\nm{i}", None, None) for i in range(1, 70)]
    got = answered(spark, rows)
    assert all(got[i]["root_id"] == 0 and got[i]["depth"] == i == got[i]["position"] for i in range(70))
