"""vintage — cohort retention and customer lifetime value as Spark DataFrame plans.

Layers:
  sources/    transaction table readers (Parquet/CSV, driver-table mapping)
  functions/  column-level helpers (numpy-style rounding, month arithmetic, LTV quotient)
  operators/  DataFrame -> DataFrame building blocks (profile, clean, cells,
              customers, matrix, impute, ranking, quantiles)
  plans/      the named query catalogue and its DuckDB oracle SQL
"""

from vintage.params import Params

__all__ = ["Params"]
