"""Fact payloads: JSON objects or arrays of candidate facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "struct<field string, value string, source string, confidence double, kind string, source_detail string, evidence string>"
# Names for fields that people use, and fields that identify a person.
ALIASES = {"company": "current_company", "role": "current_role", "title": "current_role", "job_title": "current_role"}
IDENTIFIERS = ("email", "linkedin_url", "phone", "handle")


def parse_payloads(df: DataFrame, row_id: str, payload: str) -> DataFrame:
    """(row_id, field, value, source, confidence, kind, source_detail, verdict), one row a fact.

    An object counts as an array of one. Unreadable payloads give one row with the verdict bad_json; a fact without a field,
    with a confidence outside 0..1 or an unknown kind is marked, the rest are ok. Evidence is folded into source_detail.
    """
    text = F.trim(F.col(payload))
    many = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    facts = df.select(row_id, F.explode_outer(F.from_json(many, f"array<{FACT}>")).alias("f"))
    field = F.col("f.field")
    for name, to in ALIASES.items():
        field = F.when(F.col("f.field") == name, to).otherwise(field)
    kind = F.coalesce(F.col("f.kind"), F.when(F.col("f.field").isin(*IDENTIFIERS), "identifier").otherwise("attribute"))
    detail = F.when(F.coalesce("f.source_detail", F.lit("")) == "", F.col("f.evidence")).when(F.coalesce("f.evidence", F.lit("")) == "", F.col("f.source_detail")).otherwise(F.concat_ws(" · ", "f.source_detail", "f.evidence"))
    verdict = (
        F.when(F.col("f").isNull(), "bad_json").when(F.coalesce("f.field", F.lit("")) == "", "no_field")
        .when((F.col("f.confidence") < 0) | (F.col("f.confidence") > 1), "bad_confidence").when(~kind.isin("attribute", "identifier"), "bad_kind").otherwise("ok")
    )
    return facts.select(row_id, field.alias("field"), F.col("f.value").alias("value"), F.col("f.source").alias("source"), F.col("f.confidence").alias("confidence"), kind.alias("kind"), detail.alias("source_detail"), verdict.alias("verdict"))
