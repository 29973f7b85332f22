"""Exact medians by counting (I1, I4): no sort, no row numbers.

Each group keeps an interval of values that holds its middle.  A round counts
the interval's values in ``BUCKETS`` equal parts (map-side, one row per part
and group), goes on with the part that the middle falls in, and takes that
part's own least and greatest value as the next interval.  A part is a run of
the sorted values, because the part number never falls as the value grows, so
counts alone decide; a group ends when its interval is one value.  The number
of rounds is the logarithm of the spread over the distance of values: one or
two for scores.  A last pass finds the next value up for even counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckscope.operators.ranking import BROADCAST_ROWS, materialize

BUCKETS = 4096


def _held(state: DataFrame):
    """(the groups' intervals, whether they are few, whether one is open): at
    most ``BROADCAST_ROWS`` groups stay with the driver, more are stored."""
    rows = state.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        return state.sparkSession.createDataFrame(rows, state.schema), rows, any(r["_lo"] < r["_hi"] for r in rows)
    state = materialize(state)
    return state, None, state.filter("_lo < _hi").limit(1).count() > 0


def medians(df: DataFrame, value_col: str, group_cols=(), out_col: str = "median", buckets: int = BUCKETS) -> DataFrame:
    """Median of ``value_col`` per group (mean of the two middle values for even counts), one row per group that has values.

    NULL and NaN are left out; NULL groups are a group; infinities count as
    the largest finite numbers.  ``df`` is read once; its value and group
    columns are stored, and every round reads those."""
    g = [f"_g{i}" for i in range(len(group_cols))]
    big = 1.7976931348623157e308
    x = F.greatest(F.least(F.col(value_col).cast("double"), F.lit(big)), F.lit(-big))
    vals = df.filter(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double"))) \
        .select(*[F.col(c).alias(n) for c, n in zip(group_cols, g)], x.alias("_v"))
    vals = materialize(vals)
    state = vals.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state, few, left = _held(state.filter("_n > 0").withColumn("_below", F.lit(0).cast("long")))  # _below: values under _lo
    k = F.floor((F.col("_n") + 1) / 2)

    def with_state(rows, st):
        """Values with their group's interval; groups may be NULL."""
        if not g:                                         # one row: as literals
            return rows.withColumns({c: F.lit(few[0][c] if few else None).cast(t) for c, t in st.dtypes})
        st = st.select(*[F.col(c).alias(f"{c}s") for c in g], *[c for c in st.columns if c not in g])
        if few is not None:
            st = F.broadcast(st)
        on = None
        for c in g:
            e = F.col(c).eqNullSafe(F.col(f"{c}s"))
            on = e if on is None else on & e
        return rows.join(st, on).drop(*[f"{c}s" for c in g])

    while left:
        inside = with_state(vals, state).filter("_lo < _hi AND _v >= _lo AND _v <= _hi")
        # halves, so that the width of the widest interval is still finite
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        part = F.least(F.floor(part * buckets), F.lit(buckets - 1))
        counts = inside.groupBy(*g, part.alias("_part"), "_n", "_below").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*g).orderBy("_part")     # at most ``buckets`` rows a group
        counts = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(w))
        nxt = counts.filter((F.col("_upto") >= k) & (F.col("_upto") - F.col("_c") < k)) \
            .select(*g, "_n", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below"))
        state, few, left = _held(state.filter("_lo = _hi").select(nxt.columns).unionByName(nxt))
    near = with_state(vals, state).groupBy(*g).agg(
        F.max("_n").alias("_n"), F.max("_lo").alias("_mid"), F.count_if(F.col("_v") <= F.col("_lo")).alias("_upto"),
        F.min(F.when(F.col("_v") > F.col("_lo"), F.col("_v"))).alias("_up"))
    upper = F.when(F.col("_upto") >= F.floor(F.col("_n") / 2) + 1, F.col("_mid")).otherwise(F.col("_up"))
    return near.filter("_n > 0").select(*[F.col(n).alias(c) for c, n in zip(group_cols, g)], ((F.col("_mid") + upper) / 2).alias(out_col))
