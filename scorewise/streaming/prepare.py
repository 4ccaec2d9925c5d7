"""The stateless part of the preparation on a streaming source.

Labelling (status code -> response) and the applicant clean-up (filter and
clamps) are row-local expressions, so the same functions apply unchanged to a
``readStream`` DataFrame; no state, watermark or window is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewise.operators.clean import add_response, clean_applicant_columns
from scorewise.sources.tables import APPLICATION_SCHEMA, CREDIT_SCHEMA


def credit_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Labelled monthly status rows from files arriving under ``path``."""
    return add_response(spark.readStream.schema(CREDIT_SCHEMA).format(fmt).load(path))


def applicant_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cleaned applicant rows (children >= 0, clamped family size and income)."""
    return clean_applicant_columns(spark.readStream.schema(APPLICATION_SCHEMA).format(fmt).load(path))
