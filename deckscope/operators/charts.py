"""Chart-shaped datasets (O1-O5): the rows a chart would draw, no drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions.text import title_case_dim, truncate_label
from deckscope.operators.portfolio import at_least_rows, existing, landscape_quadrant
from deckscope.operators.ranking import top_k


def _min_rows(df: DataFrame, n: int) -> DataFrame:
    """Keep all rows only when the frame has at least ``n`` rows."""
    return at_least_rows(df, n)


def radar_rows(df: DataFrame, k: int = 5) -> DataFrame:
    """O1: top-k decks x dimensions, long form, first dimension repeated to
    close the shape; names over 25 chars cut to 22 + '...'."""
    dims = existing(df, L.DIMENSIONS)
    top = top_k(df, k)
    points = [(i, d) for i, d in enumerate(dims)] + [(len(dims), dims[0])]
    args = [x for i, d in points for x in (F.lit(i), F.lit(d), F.col(d))]
    return top.select(truncate_label("deck_name", 25, 22).alias("deck_label"), "deck_name",
                      F.stack(F.lit(len(points)), *args).alias("point", "dimension", "value"))


def scatter3d_rows(df: DataFrame) -> DataFrame:
    """O2: market (x), traction (y), team (z), marker size 2 x composite;
    at least two rows."""
    return _min_rows(df, 2).select(
        "deck_name", F.col("market_potential").alias("x"), F.col("traction_strength").alias("y"),
        F.col("team_experience").alias("z"), (F.col("composite_score") * F.lit(2.0)).alias("size"),
        F.col("composite_score").alias("color"))


def parallel_rows(df: DataFrame) -> DataFrame:
    """O3: the existing dimensions with the composite as line colour."""
    return df.select("deck_name", *existing(df, L.DIMENSIONS), F.col("composite_score").alias("color"))


def matrix_rows(df: DataFrame) -> DataFrame:
    """Deck x dimension cells (names cut at 20), at least two rows."""
    dims = existing(df, L.DIMENSIONS)
    long = _min_rows(df, 2).unpivot(["deck_name"], dims, "dimension", "value")
    return long.select(truncate_label("deck_name", 20).alias("deck_label"), "deck_name",
                       title_case_dim(F.col("dimension")).alias("dimension"), "value")


def landscape_rows(df: DataFrame) -> DataFrame:
    """Per category: market (x), traction (y), size 3 x composite and the
    quadrant; the category is 'All Decks' when the table has none; at least
    two rows."""
    d = df if "category" in df.columns else df.withColumn("category", F.lit("All Decks"))
    return _min_rows(d, 2).select(
        "category", "deck_name", F.col("market_potential").alias("x"), F.col("traction_strength").alias("y"),
        (F.col("composite_score") * F.lit(3.0)).alias("size"),
        landscape_quadrant(F.col("market_potential"), F.col("traction_strength")).alias("quadrant"))
