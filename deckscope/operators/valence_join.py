"""Lexicon sentiment from a valence table (C10, table-driven form).

Same rules as ``functions.sentiment``, whose literals are compiled into the
plan; here the lexicon is a table of any size.  Tokens are exploded with
their positions and joined to ``(token, valence, boost, negates)``, so only
tokens of the table go on; the look-back to the three tokens before is
``lag`` over the hits of a document in position order (at most three of them
can be that near); one aggregate gives a document's valences in order, and
the same closing formula its shares and compound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckscope.functions.sentiment import DEFAULT_LEXICON, SentimentLexicon, scores, token_key, tokens
from deckscope.operators.ranking import small_side

TABLE = "token string, valence double, boost double, negates boolean"


def lexicon_table(spark: SparkSession, lex: SentimentLexicon = DEFAULT_LEXICON) -> DataFrame:
    """A lexicon's entries, boosters and negators as table rows."""
    rows = [(t, float(v), None, None) for t, v in lex.entries]
    rows += [(t, None, s * lex.booster_step, None) for s, ts in ((1, lex.boosters_up), (-1, lex.boosters_down)) for t in ts]
    rows += [(t, None, None, True) for t in lex.negators]
    return spark.createDataFrame(rows, TABLE)


def table_sentiment(df: DataFrame, lexicon: DataFrame, text_col: str = "full_text", keep=("doc_id",), cleaned: bool = True,
                    lex: SentimentLexicon = DEFAULT_LEXICON) -> DataFrame:
    """``keep`` and ``pos, neg, neu, compound`` of every row's text.

    A token named twice in the table takes its largest valence and boost;
    NULL and empty tokens are ignored.  ``lex`` gives the scalars only.  The
    table is broadcast if its counted rows allow it, else joined by token."""
    table = lexicon.select(F.lower("token").alias("key"), "valence", "boost", "negates").filter("key <> ''")
    table = table.groupBy("key").agg(F.max("valence").alias("valence"), F.max("boost").alias("boost"), F.max("negates").alias("negates"))
    mark = df.sparkSession.createDataFrame([("", None, None, None)], "key string, valence double, boost double, negates boolean")
    toks = tokens(F.col(text_col), cleaned)
    keep = list(keep)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *keep, toks.alias("_toks"))
    # an empty token in front stands for the row itself: it is in every text and in the table, so texts without a hit stay
    rows = rows.select("_row", *keep, F.size("_toks").alias("_n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("_toks"))).alias("_pos", "_tok"))
    rows = rows.withColumn("key", token_key(F.col("_tok"))).drop("_tok")
    hits = rows.join(small_side(table.unionByName(mark)), "key")
    w = Window.partitionBy("_row").orderBy("_pos")
    before = F.struct("_pos", "boost", "negates")
    hits = hits.withColumns({f"_b{k}": F.lag(before, k).over(w) for k in (1, 2, 3)})

    def at(distance, field):
        return F.coalesce(*[F.when(F.col("_pos") - F.col(f"_b{k}")["_pos"] == distance, F.col(f"_b{k}")[field]) for k in (1, 2, 3)])

    v, sign = F.col("valence"), F.when(F.col("valence") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    for d in (1, 2, 3):
        v = v + F.coalesce(at(d, "boost"), F.lit(0.0)) * sign * F.lit(lex.booster_decay[d - 1])
    for d in (1, 2, 3):
        v = v * F.when(at(d, "negates"), F.lit(lex.negation_scalar)).otherwise(F.lit(1.0))
    valued = hits.select("_row", *keep, "_n", "_pos", v.alias("_v"))
    per = valued.groupBy("_row", *keep, "_n").agg(F.sort_array(F.collect_list(F.when(F.col("_v") != 0, F.struct("_pos", "_v")))).alias("_vs"))
    per = per.withColumn("_s", scores(F.transform("_vs", lambda x: x["_v"]), F.col("_n"), lex))
    return per.select(*keep, *[F.col("_s")[k].alias(k) for k in ("pos", "neg", "neu", "compound")])
