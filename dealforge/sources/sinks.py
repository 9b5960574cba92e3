"""CSV sinks (K8, K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_clicks_csv(clicks: DataFrame, path: str) -> None:
    """K8: quoted only where needed, quotes doubled."""
    clicks.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_issues_csv(issues: DataFrame, path: str) -> None:
    """K9: every field quoted."""
    issues.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
