"""The feature table of a crop classifier, by column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from furrow.columns import CLASSIFIER_IDS
from furrow.functions.temporal import add_season_shape
from furrow.operators.selection import coerce_numeric, drop_qa, select_families, select_months


def classifier_table(df: DataFrame, months: list[str] | None = None, families: list[str] | None = None,
                     temporal: bool = True) -> tuple[DataFrame, list[str]]:
    """Rows with QA columns dropped, months and families kept and season shapes added; and the feature names."""
    out = select_months(drop_qa(df), months or [])
    if temporal:
        out = add_season_shape(out, months)
    out = select_families(out, families or [])
    features = [c for c in out.columns if c not in CLASSIFIER_IDS]
    if not features:
        raise ValueError("No feature columns remain after month and family selection.")
    return coerce_numeric(out, features), features
