"""Name a value inside an expression."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it on; lambdas do not share repeated sub-expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever is done with them later.

    The columns come out of a one-row generator. The optimizer pushes a later filter on them no
    further than that, where a plain projection would be copied into the filter again and again;
    filters on other columns still reach the scan.
    """
    kept = df.columns
    # the projection below the generator runs as generated code; an outer generator infers no filter
    return (df.select("*", F.array(F.struct(*columns)).alias("_computed"))
            .select(*kept, F.inline_outer("_computed")))
