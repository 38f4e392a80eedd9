"""Queries of the text operators (problems 2, 7, 8, 9), with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm import leakage, lookalikes, mixing, residue
from ruleframe.operators.sizes import small
from ruleframe.session import table
from ruleframe.storage import cut

FIELDS = ["element_code", "element_name", "mapping_code"]


def _cells(rows: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    return rows.select(*keep, F.inline(pairs)).where("value is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    values = _cells(table(spark, d, "member_upload"), FIELDS, "upload_id")
    known = _cells(table(spark, d, "metadata"), FIELDS[:2]).unionByName(_cells(table(spark, d, "mapping_1t"), FIELDS[2:]))
    pairs = small(cut(lookalikes.match_registered(values, known, ["field_name"])))
    return values.join(pairs, ["field_name", "value"]).select("upload_id", "field_name", "registered_value")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value of ``member_upload`` that is not in its consistent form, with that form."""
    values = _cells(table(spark, d, "member_upload"), FIELDS).distinct()
    return lookalikes.with_form(values, "value").where("form <> value")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.where("distance = 0 and item_words >= 13").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with one word changed, added or left out, and items of fewer words that stand there whole."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id", "distance")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares_all(spark: SparkSession, d: str) -> DataFrame:
    """The same for as many tokens as the sources hold, where some are too small for their share."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_target"), "all")


def p8_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The natural shares under one exponent for all sources, bisected to the entropy of the target shares, at the
    largest total that the repetition limits allow: what temperature alone makes of the sources."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_target"), goal_entropy="target")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = residue.find_residue(table(spark, d, "documents"))
    return found.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_forms, p7_found, p7_near, p8_mix, p8_shares, p8_shares_all, p8_temperature, p9_found, p9_kinds)}

ORACLE = {
    "p7_found": r"""WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_item),
g AS (SELECT side, id, array_to_string(x[k:k + 12], ' ') AS words FROM (SELECT side, id, x, unnest(range(1, len(x) - 11)) AS k FROM w WHERE len(x) >= 13))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.words = i.words WHERE d.side = 'd' AND i.side = 'i'""",
}
