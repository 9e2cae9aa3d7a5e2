"""The gram index gives what the expression gives."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from schemalign.operators.dictionary import search_src
from schemalign.operators.search import build_search_index, required_grams, search_index

NAMES = [
    "Order Date", "ORDER_DT", "order  date", "Customer Name", "customer.name", "cust (old) name", "Straße", "STRASSE", "STRA\u1e9eE",
    "\u212aelvin scale", "kelvin SCALE", "\u0130stanbul", "istanbul", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2 \u03b1", "mi\u017fs", "MISS", "ab", "", None, "aaab", "a{2}b", "Tot|al", "x" * 300 + "Date",
]
TERMS = [
    "order", "ORDER.?D", "^order date$", "cust.*name", "customer\\.name", "cust \\(old\\)", "(order|customer) (date|name)", "order|total", "[a-z]+er Na", "ord[^x]r",
    "stra\u00dfe", "strasse", "kelvin", "istanbul", "\u03bf\u03b4\u03bf\u03c3", "miss", "da?te", "date+", "dat*e", "ate{1}", "a{2}b", "a\\{2\\}b", "\\d", "ab", "", "tot\\|al", "(a)\\1", "name$", "e D", "colou?r|date", "x{10}date",
    "Dat.", "cust(omer)? ?name", "(?i)order", "\\bname", "na+me?", "o(rd)er",
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(n, f"t{k % 3}", k) for k, n in enumerate(NAMES)] + [("Order Date", "again", 99)]
    dictionary = spark.createDataFrame(rows, "src string, target string, description int")
    return dictionary, build_search_index(dictionary, f"search_{uuid.uuid4().hex[:8]}")


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_the_expression(index, term):
    dictionary, made = index
    want = sorted(map(tuple, search_src(dictionary, term).collect()), key=repr)
    assert sorted(map(tuple, search_index(made, term).select(*dictionary.columns).collect()), key=repr) == want


def test_required_grams():
    assert required_grams("order date") == [" DA", "ATE", "DAT", "DER", "ER ", "ORD", "R D", "RDE"]
    assert required_grams("da?te.*name") == ["AME", "NAM"]
    assert required_grams("date+s") == ["ATE", "DAT"]
    assert required_grams("a|bcd") == required_grams("x.y") == required_grams("(") == required_grams("[abc]{4}") == []


def test_grams_reach_the_scan_of_the_postings(index):
    _, made = index
    found = search_index(made, "customer.*name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [AME,CUS,MER" in plan and "src" in plan
    assert found.filter(F.lit(True)).count() == 2
