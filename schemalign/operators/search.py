"""Searching source names by a regular expression with an index of their grams.

An expression tells which runs of letters every name it matches must hold. Names are looked up by the grams of those runs
first, and only names that have them all are held against the expression. So a search reads a few buckets of the index and
the names found, not the whole dictionary. An expression that requires nothing of that length is searched for without it.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemalign.operators.dictionary import search_src

GRAM = 3

# Letters that stand for another one, case aside, but whose upper case is not that one's.
_ALIKE = ("\u0130\u0131\u212a\u212b\u2126\u03f4\u1e9e\u00df\u017f\u03c2", "IIK\u00c5\u03a9\u0398\u1e9e\u1e9eS\u03a3")


def _folded_text(text: str) -> str:
    text = text.translate(str.maketrans(*_ALIKE))
    return "".join(c.upper() if len(c.upper()) == 1 else c for c in text).translate(str.maketrans(*_ALIKE))


def _folded(name: Column) -> Column:
    """Letters alike but for their case made one; those whose upper case is several letters stay as they are."""
    replaced = F.translate(name, *_ALIKE)
    upper = F.transform(F.split(replaced, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.translate(F.array_join(upper, ""), *_ALIKE)


def required_grams(term: str) -> list[str]:
    """Grams that every text the expression matches must hold, folded; none where nothing can be told.

    Only plain parts are read: letters, digits, blanks and escaped signs in a row, outside of alternatives, classes and
    groups. A sign that may be missing or repeated ends a run and is no part of it; an expression with an alternative on
    its top level, a flag or a back reference tells nothing.
    """
    try:
        re.compile(term)
    except re.error:
        return []
    if "\\Q" in term or "(?" in term:
        return []
    runs, run, depth, at = [], "", 0, 0

    def cut() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while at < len(term):
        c = term[at]
        width, literal = 1, None
        if c == "\\":
            width = 2
            following = term[at + 1 : at + 2]
            if following.isdigit():
                return []
            if not following.isalnum():
                literal = following
            elif following in "xucpPkNkoG":
                return []
        elif c == "[":
            end = at + 1 + (term[at + 1 : at + 2] == "^")
            end += term[end : end + 1] == "]"
            while end < len(term) and term[end] != "]":
                if term[end] == "[" or term[end : end + 2] == "&&":
                    return []
                end += 2 if term[end] == "\\" else 1
            width = end + 1 - at
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return []
        elif c not in "^$.|?*+{}":
            literal = c
        after = term[at + width : at + width + 1]
        if literal is None or depth:
            cut()
        elif after and after in "?*{":
            cut()
        elif after == "+":
            run += literal
            cut()
        else:
            run += literal
        at += width
        if after and after in "?*{+":  # what follows a repeated part begins anew
            while at < len(term) and term[at] in "?*+":
                at += 1
            if at < len(term) and term[at] == "{":
                at = term.find("}", at) + 1 or len(term)
            while at < len(term) and term[at] in "?+":
                at += 1
    cut()
    folded = [_folded_text(r) for r in runs]
    return sorted({r[i : i + GRAM] for r in folded for i in range(len(r) - GRAM + 1)})


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    names: str
    grams: str


def build_search_index(dictionary: DataFrame, name: str, buckets: int | None = None) -> SearchIndex:
    """Write the index of the source names of a dictionary: rows bucketed by source name, postings bucketed by gram."""
    spark = dictionary.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = SearchIndex(spark, f"{name}_names_{uuid.uuid4().hex[:12]}", f"{name}_grams_{uuid.uuid4().hex[:12]}")
    dictionary.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").saveAsTable(made.names)
    folded = dictionary.select("src").filter("src IS NOT NULL").distinct().withColumn("folded", _folded(F.col("src")))
    starts = F.sequence(F.lit(1), F.length("folded") - GRAM + 1)
    each = F.array_distinct(F.transform(starts, lambda i: F.substring("folded", i, F.lit(GRAM))))
    postings = folded.filter(F.length("folded") >= GRAM).select(F.explode(each).alias("gram"), "src")
    postings.repartition(buckets, "gram").write.bucketBy(buckets, "gram").sortBy("gram").saveAsTable(made.grams)
    return made


def search_index(index: SearchIndex, term: str) -> DataFrame:
    """search_src over the indexed dictionary: its rows whose source name matches, case aside."""
    names = index.spark.table(index.names)
    grams = required_grams(term)
    if not grams:
        return search_src(names, term)
    found = index.spark.table(index.grams).filter(F.col("gram").isin(grams)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    holding = found.filter(F.col("n") == len(grams)).select("src")
    return search_src(names.join(holding, "src", "left_semi"), term)
