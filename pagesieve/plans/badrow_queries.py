"""Problem 1: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesieve.operators.badrows import BOOL, FIELD, STRICT_CSV, TASKS, URL, separate
from pagesieve.plans.registry import Registry
from pagesieve.session import table

registry = Registry()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CSV3 = _quoted(f"^({FIELD}),({FIELD}),({FIELD})$")
_CSV4 = _quoted(f"^({FIELD}),({FIELD}),({FIELD}),({FIELD})$")
_unquote = "CASE WHEN {0} LIKE '\"%' THEN replace(substr({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"

DIAGNOSED = f"""
WITH r AS (
  SELECT row_id, file_name, lower(file_name) AS f, regexp_replace(raw, '\\r$', '') AS x FROM raw_rows
), shape AS (
  SELECT *,
    f IN ('textnodes.csv', 'goldlabels.csv') AND NOT regexp_matches(x, {_quoted(STRICT_CSV)}) AS broken,
    CASE WHEN f = 'inference_test.tsv' THEN length(x) - length(replace(x, chr(9), '')) + 1
         ELSE length(regexp_replace(x, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(x, '"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 END AS n
  FROM r
), fields AS (
  SELECT *,
    CASE WHEN f = 'inference_test.tsv' THEN split_part(x, chr(9), 1) WHEN f = 'textnodes.csv' THEN regexp_extract(x, {_CSV3}, 1) ELSE regexp_extract(x, {_CSV4}, 1) END AS a,
    CASE WHEN f = 'inference_test.tsv' THEN split_part(x, chr(9), 2) WHEN f = 'textnodes.csv' THEN regexp_extract(x, {_CSV3}, 2) ELSE regexp_extract(x, {_CSV4}, 2) END AS b,
    CASE WHEN f = 'inference_test.tsv' THEN split_part(x, chr(9), 3) WHEN f = 'textnodes.csv' THEN regexp_extract(x, {_CSV3}, 3) ELSE regexp_extract(x, {_CSV4}, 3) END AS c,
    CASE WHEN f = 'goldlabels.csv' THEN regexp_extract(x, {_CSV4}, 4) END AS d
  FROM shape
), plain AS (
  SELECT row_id, file_name, f, x, broken, n,
    {", ".join(f"CASE WHEN f = 'inference_test.tsv' THEN {k} ELSE {_unquote.format(k)} END AS {k}" for k in "abcd")}
  FROM fields
), judged AS (
  SELECT row_id, file_name, f, a, b, c, d, CASE
    WHEN x IS NULL OR f IS NULL OR f NOT IN ('inference_test.tsv', 'textnodes.csv', 'goldlabels.csv') THEN 'columns'
    WHEN broken THEN 'quoting'
    WHEN n <> CASE WHEN f = 'goldlabels.csv' THEN 4 ELSE 3 END THEN 'columns'
    WHEN NOT regexp_matches(a, {_quoted(URL)}) OR NOT regexp_matches(b, '^[0-9]+$') OR TRY_CAST(b AS HUGEINT) IS NULL OR TRY_CAST(b AS HUGEINT) > 2147483647 THEN 'value'
    WHEN f = 'inference_test.tsv' AND c NOT IN ({", ".join(map(_quoted, TASKS))}) THEN 'value'
    WHEN f = 'goldlabels.csv' AND NOT regexp_matches(d, {_quoted(BOOL)}) THEN 'value' END AS reason
  FROM plain
)"""


@registry.add(DIAGNOSED + " SELECT DISTINCT row_id, reason FROM judged WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty records with one reason each."""
    return separate(table(spark, sf_dir, "raw_rows"))[1].select("row_id", "reason").distinct()


@registry.add(
    DIAGNOSED
    + """ SELECT row_id, file_name, a AS url, CAST(b AS INT) AS node_id, CASE WHEN f = 'inference_test.tsv' THEN c END AS task,
    CASE WHEN f <> 'inference_test.tsv' THEN c END AS text, CASE WHEN f = 'goldlabels.csv' THEN lower(d) = 'true' END AS judgment
    FROM judged WHERE reason IS NULL"""
)
def p1_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound records as typed rows."""
    return separate(table(spark, sf_dir, "raw_rows"))[0]
