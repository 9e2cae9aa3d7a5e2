"""Prompts and answers of the model-assisted mapping; an answer is composed from every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.common import fresh_folder, table
from queries.matching import part_dictionary
from schemalign.operators import answers as a
from schemalign.operators.mapping import suggestion_for

NAMES = ("TS", "User", "props", "absent")

RESPONSE_SQL = """
CASE event_type
  WHEN 'error' THEN 'I cannot do that.'
  WHEN 'signup' THEN 'Here: {"ts": {"target": "When", "confidence"}'
  ELSE concat('Sure:', chr(10), '{"ts": {"target": "', event_type, '", "confidence": ', cast(user_id AS STRING),
              '}, "user": {"target": "', event_type, '", "confidence": "50"}, "props": "view", "none": "NONE", "props": "click",',
              ' "value": {"confidence": 1}, "odd": {"target": "view", "confidence": "high"}, "n": null}', chr(10), 'Done.')
END"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), F.expr(RESPONSE_SQL).alias("response"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("target")).filter("target <> 'purchase'").distinct()


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", "p_size").alias("source_id"), F.col("p_partkey").alias("position"), F.col("p_name").alias("src_col")
    )
    template = "Map {{these}}:\n{source_list}\nto:\n{target_list}\nEnd."
    return a.build_prompts(columns, part_dictionary(spark, sf_dir), template)


PROMPT_SQL = """
WITH t AS (SELECT string_agg('- ' || target, chr(10) ORDER BY target) AS l
           FROM (SELECT DISTINCT target FROM (SELECT max(p_type) AS target FROM part GROUP BY p_name)))
SELECT source_id, block, 'Map {these}:' || chr(10) || names || chr(10) || 'to:' || chr(10) || l || chr(10) || 'End.' AS prompt
FROM (SELECT p_brand || '/' || p_size AS source_id, 0 AS block,
             string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) AS names FROM part GROUP BY ALL), t"""


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model: it answers with the number of lines of the prompt and fails on some."""

    def answer(prompt: str) -> str:
        lines = len(prompt.splitlines())
        if lines % 5 == 0:
            raise ValueError(f"{lines} lines")
        return f"{lines} lines"

    return a.complete(build_prompts(spark, sf_dir), answer)


def complete_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with answers kept: the second run asks the failing prompts only, and they fail no more."""
    store = fresh_folder(spark)

    def first(prompt: str) -> str:
        lines = len(prompt.splitlines())
        if lines % 5 == 0:
            raise ValueError(f"{lines} lines")
        return f"{lines} lines"

    def second(prompt: str) -> str:
        return f"{len(prompt.splitlines())} lines at last"

    prompts = build_prompts(spark, sf_dir)
    a.complete_kept(prompts, first, store)
    return a.complete_kept(prompts, second, store)


def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.response_status(_responses(spark, sf_dir)).select("source_id", "status")


def parse_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.parse_mapping(_responses(spark, sf_dir))


def resolve_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.resolve_responses(_responses(spark, sf_dir), _targets(spark, sf_dir))


def answers_for_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers looked up for columns whose names are written otherwise than the answer has them."""
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("src_col")) for i, n in enumerate(NAMES)]))
    columns = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), names.alias("c")).select("source_id", "c.*")
    return suggestion_for(columns, resolve_responses(spark, sf_dir))


PARSED_SQL = """
WITH answered AS (SELECT * FROM events WHERE event_type NOT IN ('error', 'signup')),
parsed AS (
  SELECT event_id AS source_id, 0 AS position, 'ts' AS input_field, event_type AS target, user_id::DOUBLE AS score FROM answered
  UNION ALL SELECT event_id, 1, 'user', event_type, 50.0 FROM answered
  UNION ALL SELECT event_id, 2, 'props', 'click', 0.5 FROM answered
  UNION ALL SELECT event_id, 3, 'none', 'NONE', 0.5 FROM answered
  UNION ALL SELECT event_id, 5, 'value', 'NONE', 1.0 FROM answered
  UNION ALL SELECT event_id, 6, 'odd', 'view', 0.0 FROM answered
  UNION ALL SELECT event_id, 7, 'n', NULL, 0.5 FROM answered)"""

RESOLVED_SQL = """
, resolved AS (
  SELECT source_id, position, input_field, target, score, 'LLM' AS src_match FROM parsed
  WHERE target IN (SELECT event_type FROM events WHERE event_type <> 'purchase')
  QUALIFY row_number() OVER (PARTITION BY source_id, target ORDER BY score DESC, position) = 1)"""

QUERIES = {
    "build_prompts": build_prompts,
    "complete": complete,
    "complete_kept": complete_kept,
    "response_status": response_status,
    "parse_mapping": parse_mapping,
    "resolve_responses": resolve_responses,
    "answers_for_columns": answers_for_columns,
}
ORACLES = {
    "build_prompts": PROMPT_SQL,
    "complete": f"""
SELECT source_id, block, CASE WHEN n % 5 > 0 THEN n || ' lines' END AS response,
       CASE WHEN n % 5 = 0 THEN 'ValueError: ' || n || ' lines' END AS error
FROM (SELECT *, len(string_split(prompt, chr(10))) AS n FROM ({PROMPT_SQL}))""",
    "complete_kept": f"""
SELECT source_id, block, n || CASE WHEN n % 5 > 0 THEN ' lines' ELSE ' lines at last' END AS response, NULL::VARCHAR AS error
FROM (SELECT *, len(string_split(prompt, chr(10))) AS n FROM ({PROMPT_SQL}))""",
    "response_status": """
SELECT event_id AS source_id, CASE event_type WHEN 'error' THEN 'no_json' WHEN 'signup' THEN 'bad_json' ELSE 'ok' END AS status
FROM events""",
    "parse_mapping": PARSED_SQL + "SELECT * FROM parsed",
    "resolve_responses": PARSED_SQL + RESOLVED_SQL + "SELECT * FROM resolved",
    "answers_for_columns": PARSED_SQL + RESOLVED_SQL + f"""
SELECT c.source_id, c.position, c.src_col, r.target, r.score, r.src_match
FROM (SELECT event_id AS source_id, unnest(range({len(NAMES)}))::INT AS position, unnest({list(NAMES)}) AS src_col FROM events) c
LEFT JOIN resolved r ON r.source_id = c.source_id AND lower(r.input_field) = lower(c.src_col)""",
}
