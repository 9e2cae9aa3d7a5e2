"""URL filter: rules by host and path, and for the rest the ratio of two character language models.

Urls that a rule allows and urls that a rule blocks are the examples of two variable-order Markov models: a character's
probability after a context is interpolated with that after the context without its first character (Witten-Bell), down
to an even share for every character. A url's score is the mean over its characters of log P(blocked) - log P(allowed);
the threshold lies between the mean scores of the two kinds of examples, as many standard deviations from either.
Everything is DataFrame expressions, joins and grouped sums.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up
from schemalign.operators.settle import settle

# Fixed values: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

ORDER = 4
_START, _END = "\x02", "\x03"
_ALPHABET = 256
BROADCAST_GRAMS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty for null and where there is no '://'."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _longest_first(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: -len(r[0]))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path the url's path starts with."""
    found = []
    for rule, _ in _longest_first(rules):
        domain, slash, start = rule.partition("/")
        under = (host == domain) | F.endswith(host, F.lit("." + domain))
        found.append(F.when(under & F.startswith(path, F.lit(slash + start)), rule))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _counts(texts: DataFrame) -> DataFrame:
    """texts (text, allowed, blocked) -> (gram, allowed, blocked): each character with up to ORDER before it."""
    gram = F.explode(
        F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: F.substring(_padded(F.col("text")), i, F.lit(ORDER + 1)))
    ).alias("gram")
    return (
        texts.select("allowed", "blocked", gram)
        .groupBy("gram")
        .agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    )


def _padded(text: Column) -> Column:
    return F.concat(F.lit(_START * ORDER), text, F.lit(_END))


def _log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, allowed, blocked) -> (gram, ratio): log P(last character | those before it), blocked minus allowed."""
    shorter: DataFrame | None = None
    for size in range(1, ORDER + 2):
        own = grams.groupBy(F.expr(f"right(gram, {size})").alias("g")).agg(
            *[F.sum(k).alias(k) for k in ("allowed", "blocked")]
        )
        context = own.groupBy(F.expr(f"left(g, {size - 1})").alias("before")).agg(
            *[F.sum(k).alias(f"n_{k}") for k in ("allowed", "blocked")],
            *[F.count_if(F.col(k) > 0).alias(f"kinds_{k}") for k in ("allowed", "blocked")],
        )
        joined = own.withColumn("before", F.expr(f"left(g, {size - 1})")).join(context, "before")
        if shorter is None:
            joined = joined.withColumns({f"p_{k}": F.lit(1.0 / _ALPHABET) for k in ("allowed", "blocked")})
        else:
            joined = joined.withColumn("tail", F.expr(f"right(g, {size - 1})")).join(shorter, "tail")

        def likely(k: str) -> Column:
            seen = F.col(f"n_{k}") + F.col(f"kinds_{k}")
            mixed = F.try_divide(F.col(k) + F.col(f"kinds_{k}") * F.col(f"p_{k}"), seen)
            return F.when(seen > 0, mixed).otherwise(F.col(f"p_{k}"))

        shorter = joined.select(F.col("g").alias("tail"), *[likely(k).alias(f"p_{k}") for k in ("allowed", "blocked")])
    return shorter.select(F.col("tail").alias("gram"), (F.log("p_blocked") - F.log("p_allowed")).alias("ratio"))


def _scores(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """texts (text) -> (text, score): the mean ratio of a text's characters, its end included."""
    each = texts.select(
        "text",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: F.substring(_padded(F.col("text")), i, F.lit(ORDER + 1)))
        ).alias("gram"),
    )
    if ratios.count() <= BROADCAST_GRAMS:  # rows of some 40 bytes
        met = each.join(F.broadcast(ratios), "gram")
    else:
        met = looked_up(each, ratios, ["gram"])
    return met.groupBy("text").agg(F.round(F.avg("ratio"), 9).alias("score"))


def _threshold(scores: DataFrame) -> Column:
    """One row (threshold) of (score, allowed, blocked), each text counted as often as it occurs."""
    kinds = {}
    for k in ("allowed", "blocked"):
        n = F.sum(k)
        mean = F.try_divide(F.sum(F.col(k) * F.col("score")), n)
        square = F.try_divide(F.sum(F.col(k) * F.col("score") * F.col("score")), n)
        kinds[k] = (mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))
    (low, low_spread), (high, high_spread) = kinds["allowed"], kinds["blocked"]
    spread = low_spread + high_spread
    between = F.when(spread > 0, F.try_divide(low * high_spread + high * low_spread, spread)).otherwise((low + high) / 2)
    return F.round(between, 9)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict), one row per row.

    verdict is that of the longest fitting rule, else block where the score is above the threshold, else allow. The
    models are made of all pages that a rule judges, copies counted; without any allowed or any blocked page there is
    no threshold and the rest is allowed. Null, malformed and empty urls have an empty host and path, whose score is that
    of a text which ends at once. Rules are few and become expressions.
    """
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = settle(parted.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules], F.lit(None).cast("string"))
    marked = ruled.withColumn("ruled", verdict).withColumn("text", F.concat("host", "path"))
    kinds = {"allowed": "allow", "blocked": "block"}
    texts = marked.groupBy("text").agg(*[F.count_if(F.col("ruled") == v).alias(k) for k, v in kinds.items()], F.count(F.lit(1)).alias("rows"))
    texts = settle(texts)
    ratios = settle(_log_ratios(settle(_counts(texts))))
    scored = settle(texts.join(_scores(texts, ratios), "text"))
    threshold = scored.agg(_threshold(scored).alias("t")).first()["t"]
    worse = F.col("score") > F.lit(threshold) if threshold is not None else F.lit(False)
    learned = scored.select("text", F.when(worse, "block").otherwise("allow").alias("learned"))
    done = looked_up(marked, learned, ["text"], texts.select("text", "rows"))
    return done.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"))


def oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same in SQL for DuckDB, over the table pages."""
    ordered = _longest_first(rules)

    def fits(rule: str) -> str:
        domain, slash, start = rule.partition("/")
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + start}')"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered)
    ruled = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in ordered)
    steps = []
    for size in range(1, ORDER + 2):
        tail = f"JOIN p{size - 1} s ON s.tail = right(o.g, {size - 1})" if size > 1 else ""
        base = (lambda k: f"s.p_{k}") if size > 1 else (lambda k: f"(1.0::DOUBLE / {_ALPHABET})")
        likely = ", ".join(
            f"CASE WHEN n_{k} + kinds_{k} > 0 THEN (o.{k} + kinds_{k} * {base(k)}) / (n_{k} + kinds_{k}) ELSE {base(k)} END AS p_{k}"
            for k in ("allowed", "blocked")
        )
        steps.append(f"""
    o{size} AS (SELECT right(gram, {size}) AS g, sum(allowed)::DOUBLE AS allowed, sum(blocked)::DOUBLE AS blocked FROM grams GROUP BY 1),
    c{size} AS (SELECT left(g, {size - 1}) AS before, sum(allowed) AS n_allowed, sum(blocked) AS n_blocked,
                count(*) FILTER (allowed > 0) AS kinds_allowed, count(*) FILTER (blocked > 0) AS kinds_blocked FROM o{size} GROUP BY 1),
    p{size} AS (SELECT o.g AS tail, {likely} FROM o{size} o JOIN c{size} c ON c.before = left(o.g, {size - 1}) {tail})""")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
    WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parted AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    marked AS (SELECT *, CASE {ruled} END AS ruled, host || path AS text
               FROM (SELECT *, CASE {rule} END AS rule FROM parted)),
    texts AS (SELECT text, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked
              FROM marked GROUP BY text),
    placed AS (SELECT text, allowed, blocked, repeat(chr(2), {ORDER}) || text || chr(3) AS padded,
                      unnest(range(1, length(text) + 2)) AS i FROM texts),
    each AS (SELECT text, allowed, blocked, substr(padded, i, {ORDER + 1}) AS gram FROM placed),
    grams AS (SELECT gram, sum(allowed) AS allowed, sum(blocked) AS blocked FROM each GROUP BY gram),
    {",".join(steps).strip()},
    scored AS (SELECT text, any_value(allowed) AS allowed, any_value(blocked) AS blocked,
                      round(avg(ln(p_blocked) - ln(p_allowed)), 9) AS score
               FROM each JOIN p{ORDER + 1} ON tail = gram GROUP BY text),
    means AS (SELECT sum(allowed * score) / sum(allowed) AS low, sum(blocked * score) / sum(blocked) AS high,
                     sum(allowed * score * score) / sum(allowed) AS low2, sum(blocked * score * score) / sum(blocked) AS high2 FROM scored),
    spreads AS (SELECT *, sqrt(greatest(low2 - low * low, 0)) AS ls, sqrt(greatest(high2 - high * high, 0)) AS hs FROM means),
    threshold AS (SELECT round(CASE WHEN ls + hs > 0 THEN (low * hs + high * ls) / (ls + hs) ELSE (low + high) / 2 END, 9) AS t FROM spreads)
    SELECT page_id, host, path, rule,
           coalesce(ruled, CASE WHEN score > (SELECT t FROM threshold) THEN 'block' ELSE 'allow' END) AS verdict
    FROM marked JOIN scored USING (text)
    """
