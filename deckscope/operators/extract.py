"""Document diagnosis and extraction choice (B1-B3), section preview.

Input is tabular: a page table ``(doc_id, page_no, text, n_images)`` (page
numbers from 0) and/or file facts ``(path, length, encrypted)``.  Parsing
PDF bytes is single-machine library work and is not part of this package;
an upstream job turns files into these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions import text as T
from deckscope.operators.ranking import np_round

TEXT_SAMPLE = 200
SECTION_LABELS = [
    ("problem", "Problem Statement"), ("solution", "Solution Description"), ("market", "Market Analysis"),
    ("traction", "Traction & Metrics"), ("team", "Team Information"), ("business_model", "Business Model"),
    ("ask", "Funding Ask"),
]


def diagnose_pages(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """B1 (content part): the first page whose stripped text is longer than 50
    sets ``has_text`` and a 200-char sample and ends the scan; a page with
    images *before* that stop sets ``has_images``.  Neither -> status
    'warning'.

    All pages count, in one scan and one aggregate; the state of a document is
    two page numbers and the sample."""
    t = T.strip_ws(F.coalesce("text", F.lit("")))
    p = pages.select(id_col, "page_no", "n_images", F.when(F.length(t) > 50, F.substring(t, 1, TEXT_SAMPLE)).alias("_t"))
    g = p.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("pages"),
        F.min(F.when(F.col("_t").isNotNull(), F.col("page_no"))).alias("_stop"),
        F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("page_no"))).alias("_sample"),
        F.min(F.when(F.col("n_images") > 0, F.col("page_no"))).alias("_image"))
    has_text = F.col("_stop").isNotNull()
    has_images = F.coalesce(F.col("_image") < F.col("_stop"), F.col("_image").isNotNull())
    out = g.select(
        id_col, "pages", F.lit(False).alias("encrypted"), has_text.alias("has_text"), has_images.alias("has_images"),
        F.when(has_text, F.concat("_sample", F.lit("..."))).otherwise(F.lit("")).alias("text_sample"))
    ok = F.col("has_text") | F.col("has_images")
    return out.withColumns({
        "status": F.when(ok, F.lit("ok")).otherwise(F.lit("warning")),
        "message": F.when(~ok, F.lit("No readable content detected")),
        "can_process": F.lit(True),
    })


def diagnose_files(files: DataFrame) -> DataFrame:
    """B1 (file part): size in MB = bytes / 2^20; encrypted -> error, not
    processable; over the size limit -> warning 'Large file (x.xMB) - may be
    slow', still processable."""
    mb = F.col("length") / F.lit(1024.0 * 1024.0)
    enc = F.coalesce(F.col("encrypted"), F.lit(False)) if "encrypted" in files.columns else F.lit(False)
    large = mb > L.MAX_FILE_SIZE_MB
    return files.select(
        "path", T.deck_name_from_path(F.col("path")).alias("deck_name"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), mb.alias("file_size_mb"),
        F.when(large, "warning").when(enc, "error").otherwise("ok").alias("status"),
        F.when(large, F.format_string("Large file (%.1fMB) - may be slow", np_round(mb, 1)))
        .when(enc, F.lit("PDF is password protected")).alias("message"),
        (large | ~enc).alias("can_process"))


def diagnose(files: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """B1, both halves in one row a document: file facts ``(id, path, length,
    encrypted, open_error)`` (the last two may be missing) joined with the page
    table's one aggregate.

    The first that holds decides: too large (warning, still processable), could
    not be opened (error, with its reason), encrypted (error), no readable page
    (warning), else ok; the first three say nothing of the pages.  A file
    without pages has none to read; pages without a file row have no name or
    size.  One row a file row: an id that several files share is joined to each."""
    for c, kind in (("encrypted", "boolean"), ("open_error", "string")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    f = files.select(id_col, "path", (F.col("length") / F.lit(1024.0 * 1024.0)).alias("file_size_mb"),
                     F.coalesce("encrypted", F.lit(False)).alias("_encrypted"), F.col("open_error").alias("_error"))
    p = diagnose_pages(pages, id_col).select(id_col, *(F.col(c).alias(f"_{c}") for c in ("pages", "has_text", "has_images", "text_sample")))
    j = f.join(p, id_col, "full")
    large = F.coalesce(F.col("file_size_mb") > L.MAX_FILE_SIZE_MB, F.lit(False))
    failed, locked = F.col("_error").isNotNull(), F.coalesce("_encrypted", F.lit(False))
    seen = ~(large | failed | locked)
    has_text, has_images = F.coalesce("_has_text", F.lit(False)), F.coalesce("_has_images", F.lit(False))
    blank = seen & ~has_text & ~has_images
    when = lambda c: F.when(seen, c)
    return j.select(
        id_col, T.deck_name_from_path(F.col("path")).alias("deck_name"), F.element_at(F.split("path", "/"), -1).alias("filename"), "file_size_mb",
        when(F.coalesce("_pages", F.lit(0).cast("long"))).alias("pages"), F.when(~large & ~failed, locked).alias("encrypted"),
        when(has_text).alias("has_text"), when(has_images).alias("has_images"), when(F.coalesce("_text_sample", F.lit(""))).alias("text_sample"),
        F.when(large | blank, "warning").when(failed | locked, "error").otherwise("ok").alias("status"),
        F.when(large, F.format_string("Large file (%.1fMB) - may be slow", np_round(F.col("file_size_mb"), 1)))
        .when(failed, F.concat(F.lit("Cannot open PDF: "), "_error")).when(locked, F.lit("PDF is password protected"))
        .when(blank, F.lit("No readable content detected")).alias("message"),
        (large | seen).alias("can_process"))


def diagnosis_summary(diag: DataFrame) -> DataFrame:
    """B2: processable / total and the status counts, one row."""
    return diag.agg(
        F.count_if(F.col("can_process")).alias("processable"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "warning").alias("warning"),
        F.count_if(F.col("status") == "error").alias("error"),
    ).withColumn("any_processable", F.col("processable") > 0)


def choose_extraction(df: DataFrame, c1: str = "c1", c2: str = "c2", c3: str = "c3",
                      has_images: str = "has_images") -> DataFrame:
    """First candidate with at least 50 characters wins and names the
    method; the third (OCR) candidate is only tried when images were seen."""
    n = L.MIN_TEXT_LENGTH
    ln = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    img = F.coalesce(F.col(has_images), F.lit(False))
    method = (F.when(ln(c1) >= n, "PyMuPDF").when(ln(c2) >= n, "pdfplumber")
              .when(img & (ln(c3) >= n), "OCR").otherwise("none"))
    text = (F.when(ln(c1) >= n, F.col(c1)).when(ln(c2) >= n, F.col(c2))
            .when(img, F.coalesce(F.col(c3), F.lit(""))).otherwise(F.coalesce(F.col(c2), F.lit(""))))
    return df.withColumns({"extraction_method": method, "text": text})


def section_preview(df: DataFrame, id_col: str = "deck_name") -> DataFrame:
    """Per document and section, a preview (500 chars + '...') and
    token count when the stripped section is longer than 20 chars; else the
    'no significant content' marker (``shown`` false).  Sections are built
    from cleaned text, whose only whitespace is ' ', so the token count is a
    count of non-space runs."""
    args = [x for key, label in SECTION_LABELS for x in (F.lit(key), F.lit(label), F.col(f"sections.{key}"))]
    long = df.select(id_col, F.stack(F.lit(len(SECTION_LABELS)), *args).alias("section", "title", "content"))
    c = F.coalesce(F.col("content"), F.lit(""))
    shown = F.length(T.strip_ws(c)) > 20
    return long.select(
        id_col, "section", "title", shown.alias("shown"),
        F.when(shown, F.when(F.length(c) > 500, F.concat(F.substring(c, 1, 500), F.lit("..."))).otherwise(c))
        .otherwise(F.concat(F.col("title"), F.lit(": No significant content detected"))).alias("preview"),
        F.when(shown, T.word_count(c).cast("int")).alias("word_count"))


def missing_sections(df: DataFrame, id_col: str = "deck_name") -> DataFrame:
    """(document, section) pairs with no significant content."""
    return section_preview(df, id_col).filter(~F.col("shown")).select(id_col, "section", "title")
