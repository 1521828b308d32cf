"""Reading the tables, and comparing doubles across engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Added before rounding, so that exact halves (common in averages of cents) do not
# round differently in two engines.
OFF_HALF = 3.7e-3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    shift = OFF_HALF * 10.0 ** -(digits + 1)
    return df.withColumns({f.name: F.round(F.col(f.name) + F.lit(shift), digits) + F.lit(0.0)
                           for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def rounded_sql(sql: str, doubles: list[str], digits: int = 6) -> str:
    shift = OFF_HALF * 10.0 ** -(digits + 1)
    parts = ", ".join(f'round("{c}" + {shift!r}, {digits}) + 0.0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({parts}) FROM ({sql.strip()}) AS __q"


def squeeze(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
