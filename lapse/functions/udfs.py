"""The few vectorised Python helpers (Arrow batches, never per row).

This module deliberately has no ``from __future__ import annotations``:
pandas UDF type hints must be real types.
"""

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("double")
def chi2_sf_1dof(x: pd.Series) -> pd.Series:
    """Survival function of a 1-dof chi-square: erfc(sqrt(x / 2))."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v == v and v >= 0 else float("nan"))
