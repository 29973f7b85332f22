"""Line de-duplication across documents, DataFrame functions only.

Every line's key is the line without white space at its ends, A-Z in lower
case.  Keys are exploded as 128-bit hashes, distinct documents are counted per
hash, and a line whose key occurs in at least ``min_docs`` documents stays in
the largest id that holds it only.  What is exploded is one narrow row a line
(id, position, hash), never the line; documents are met again by id and a hash
of their text, and put together from the positions that stay.

Defined cases: null or empty text is one empty line; keys under ``min_chars``
code points always stay; rows of one id count as one document; a document
whose id is null is not counted and keeps its lines; other columns pass
through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, col, free_name, lower_ascii, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: Bound of the broadcast keys (24 bytes each); a key that is not among them has at most one line in so many.
HOT_KEYS = 4096


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``; the two counts if names are given.

    A null text without dropped lines stays null.
    """
    if not docs.columns:
        raise ValueError("documents need columns")
    fp, gone, lines = (free_name(docs.columns, x) for x in ("fp", "gone", "lines"))
    text, fp_of = F.coalesce(col(text_col), F.lit("")), F.xxhash64(F.coalesce(col(text_col), F.lit("")))
    long_keys = F.filter(
        F.transform(line_keys(col(text_col)), lambda k, i: F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), F.char_length(k).alias("n"))),
        lambda x: x["n"] >= min_chars)
    rows = stored(
        docs.where(col(id_col).isNotNull()).select(col(id_col).alias("id"), fp_of.alias("fp"), F.explode(long_keys).alias("k"))
        .select("id", "fp", "k.pos", "k.h1", "k.h2"), "lines")
    dup = stored(
        rows.groupBy("h1", "h2", "id").agg(F.count("*").alias("lines"))  # one row a document and key, so no key is a hot group
        .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs), "repeated")
    # a key of more than one line in HOT_KEYS is hot: there are fewer than HOT_KEYS of them, so they are broadcast, and no key of the shuffle is a large group
    hot = F.col("lines") * HOT_KEYS > rows.count()
    hot_keys, other_keys = (F.broadcast(dup.where(hot).select("h1", "h2", "keeper")), dup.where(~hot).select("h1", "h2", "keeper"))
    met = rows.join(hot_keys, ["h1", "h2"]).unionByName(rows.join(hot_keys.drop("keeper"), ["h1", "h2"], "left_anti").join(other_keys, ["h1", "h2"]))
    drop = (met.where(F.col("id") != F.col("keeper"))
            .groupBy(F.col("id").alias("drop_id"), F.col("fp").alias("drop_fp")).agg(F.collect_set("pos").alias("drop_pos")))
    drop = drop.select(F.col("drop_id").alias(free_name(docs.columns, "drop_id")), F.col("drop_fp").alias(fp), F.col("drop_pos").alias(gone))
    did = drop.columns[0]
    left = docs.withColumn(fp + "_", fp_of)
    both = left.join(drop, (col(id_col) == col(did)) & (col(fp + "_") == col(fp)), "left")
    split = F.split(text, "\n", -1)
    both = both.withColumn(lines, F.when(col(gone).isNotNull(), split))
    stay = F.array_except(F.sequence(F.lit(0), F.size(col(lines)) - 1), col(gone))
    kept = F.when(col(gone).isNull(), col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(col(lines), i)), "\n"))
    out = [kept.alias(c) if c == text_col else col(c) for c in docs.columns]
    if n_lines:
        out.append((F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).cast("long").alias(n_lines))
    if n_dropped:
        out.append(F.coalesce(F.size(col(gone)), F.lit(0)).cast("long").alias(n_dropped))
    return both.select(*out)
