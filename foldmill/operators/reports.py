"""Reports in one pass: counts, rates and quartiles by several groupings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, groupings: list[list[str]], value: str) -> DataFrame:
    """Count, negative count, rate of values that aren't negative (4 places), quartiles and 95th percentile (4 places, interpolated) of a whole-numbered column, by each of ``groupings``.

    Exact percentiles keep a count for each distinct value of a group, so values should be whole numbers.
    """
    keys = sorted({k for g in groupings for k in g})
    v = F.col(value)
    share = lambda p: F.round(F.percentile(v, F.lit(p)), 4).alias(f"p{int(p * 100)}")
    made = (F.count(v).alias("n"), F.count_if(v < 0).alias("n_negative"), F.round(F.avg((v >= 0).cast("double")), 4).alias("rate_ok"))
    return df.groupingSets([[F.col(k) for k in g] for g in groupings], *keys).agg(*made, share(0.25), share(0.5), share(0.75), share(0.95))
