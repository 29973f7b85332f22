"""Document sources (A1-A3).

* ``scan_documents``  : file facts of ``*.pdf`` in one directory (non-recursive)
                        through the ``binaryFile`` source, bytes not loaded.
* ``assemble_pages``  : page table -> one text per document, pages in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckscope.functions.text import deck_name_from_path, strip_ws

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan_documents(spark: SparkSession, directory: str, glob: str = "*.pdf") -> DataFrame:
    """A1 + A2: one row per matching file (``path``, ``length``,
    ``modificationTime``, ``deck_name``).  An empty or missing directory gives
    an empty frame.  Only metadata columns are selected, so file contents are
    not read."""
    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "false").load(directory))
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e).lower():
            return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp, deck_name string")
        raise
    return files.select("path", "length", "modificationTime", deck_name_from_path(F.col("path")).alias("deck_name"))


def assemble_pages(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text",
                   skip_empty: bool = False) -> DataFrame:
    """A3: page texts in page order, each followed by a newline, then the
    whole text stripped.  ``skip_empty`` drops empty pages first (the second
    extractor's variant).

    A document's pages are one group by nature (the output is that one
    document's text); pages are sorted inside the group with ``array_sort``
    rather than by a global sort."""
    p = pages.select(id_col, page_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    if skip_empty:
        p = p.filter(F.col("_t") != "")
    g = p.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(page_col, "_t"))).alias("_pages"))
    joined = F.array_join(F.transform("_pages", lambda x: F.concat(x["_t"], F.lit("\n"))), "")
    return g.select(id_col, strip_ws(joined).alias("text"))
