"""Case-surveillance analytics on Spark: DataFrame operators and MLlib pipelines."""

from caseloom.domain import CASE_SCHEMA, FeatureSpec

__all__ = ["CASE_SCHEMA", "FeatureSpec"]
