"""The registered queries: the operators over whole tables, and the contracts' digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_wrapper, importance_resampling, langid, line_dedup, ngram_join, periodic_runs, piece_viterbi, quality_cascade, secret_scan, source_mixing, string_tiling, token_files, token_prefix
from .shared import read_documents, stored


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(read_documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(read_documents(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["order"] < len(secret_scan.KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k[0]) for k in secret_scan.KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"))
    train = docs.where(F.col("doc_id").isNotNull() & ~out)
    model = langid.train(train.select("text", "lang"), calibrated=False)
    measured = stored(langid.measure(docs, model, "text", ["doc_id", "lang"]), "cross-entropies")  # each text once: to calibrate and to decide
    langid.calibrate(model, measured.where(F.col("doc_id").isNotNull() & ~out))
    return langid.decide(measured, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op5_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return piece_viterbi.encode_documents(read_documents(spark, sf_dir), model_bytes(path or tokenizer_path("piece_bpe_32k.model")), ids=False)


def op6_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    vocabulary = token_files.vocabulary_text(path or tokenizer_path("word_bpe_49k.json"))
    blocks, ids = token_files.write_files(read_documents(spark, sf_dir), vocabulary)
    return token_files.read_documents_ids(blocks, ids, token_files.digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that contaminates it."""
    return string_tiling.contaminated_pairs(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_prefix.count_tokens(read_documents(spark, sf_dir), token_files.vocabulary_text(path or tokenizer_path("byte_bpe_50k.json")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    out = quality_cascade.judge(docs)
    base = (F.col("n_words") < quality_cascade.MIN_WORDS) | (100 * F.col("n_repeat_words") > quality_cascade.MAX_REPEAT_PCT * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("rejected_by") == "").alias("kept"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = periodic_runs.detect(docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text")))
    most = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    found = found.withColumn("most", most)
    length, period = F.col("most.length"), -F.col("most.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.start")).alias("start"), length.alias("length"), period.alias("period"),
                        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resampling.resample(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.plan(read_documents(spark, sf_dir)).drop("copies")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_extraction, op3_secret_scan, op4_language_id, op5_sentencepiece, op6_token_files, op7_decontamination, op8_line_dedup, op9_token_counts, op10_quality_rules,
                                   op11_periodic_runs, op12_importance_resampling, op13_source_mixing)}

_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, pos, line, trim(translate(line, {_UP}, {_LOW}), {_SP}) AS key FROM l),
dup AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} AND doc_id IS NOT NULL
        GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
m AS (SELECT k.*, dup.key IS NOT NULL AND k.doc_id <> dup.keeper AS gone FROM k LEFT JOIN dup ON k.key = dup.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_Q = quality_cascade
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {_Q.WINDOW - 1}], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_Q.WINDOW - 2})) AS i FROM d WHERE len(w) >= {_Q.WINDOW})),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({_Q.WINDOW}, coalesce(nxt - i, {_Q.WINDOW}))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
lines AS (SELECT doc_id, sum(n - 1) AS n_dup, sum((n - 1) * length(l)) AS dup_chars
          FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE trim(l, {_SP}) <> '' GROUP BY doc_id, l) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n_dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.dup_chars, 0) AS dup_chars, length(t) AS n_chars,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letters
      FROM d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PCT} * n_words
            OR word_chars < {_Q.MIN_MEAN} * n_words OR word_chars > {_Q.MAX_MEAN} * n_words
            OR 100 * n_symbols > {_Q.MAX_SYMBOLS_PCT} * n_words OR 100 * dup_chars > {_Q.MAX_DUP_LINES_PCT} * n_chars
            OR 100 * n_letters < {_Q.MIN_LETTERS_PCT} * n_words) AS kept
FROM m
"""

#: CRC-32 of a text's UTF-8 bytes, a byte at a time over its hexadecimal digits.
_CRC = """
WITH RECURSIVE step(c, i, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
    SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM step WHERE k = 8)"""


def _crc_of(x: str) -> str:
    """Beside a join with ``crc_table``."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen({x}), 2), lambda p: ('0x' || substr(hex(encode({x})), p, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"""


_RUN = periodic_runs
OP11_SQL = f"""{_CRC},
h AS (SELECT doc_id, {_crc_of("id")} AS h, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, doc_id::VARCHAR AS id, text FROM documents), crc_table),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
x AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] ELSE w[i + 1] END AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM a)),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {_RUN.EXPONENT} * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM eq)
      GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({_RUN.SHORTEST}, {_RUN.EXPONENT} * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM s GROUP BY doc_id, s, len),
t AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -len, s := s, q := q)) AS most, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, most.s AS start, -most.l AS length, most.q AS period, 1000 * -most.l // most.q AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

_R = importance_resampling
OP12_SQL = f"""{_CRC},
f AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
      UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
w AS (SELECT word, {_crc_of("word")} % {_R.BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM f), crc_table),
n AS (SELECT bucket, (count(*) FILTER (WHERE side = 'd'))::DOUBLE AS s, (count(*) FILTER (WHERE side = 'b'))::DOUBLE AS t FROM f JOIN w USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + {_R.BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM n) + {_R.BUCKETS}))))::BIGINT AS gain FROM n),
d AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM f JOIN w USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
x AS (SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             ('0x' || substr(sha256('{_R.SEED}:' || documents.doc_id), 1, 8))::BIGINT AS h
      FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM y WHERE n_features >= {_R.MIN_WORDS})
SELECT y.doc_id, y.n_features, y.weight, y.score, CASE WHEN place <= {_R.DRAW_PCT} * eligible // 100 THEN place END AS rank
FROM y LEFT JOIN r ON y.doc_id = r.doc_id
"""

_M = source_mixing
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(sha256('{_M.SEED}:' || doc_id), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
v AS (SELECT *, (number % 3 + 1)::DOUBLE AS weight, {_M.MOST} * words AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight) AS place, sum(cap) OVER (ORDER BY cap / weight ROWS UNBOUNDED PRECEDING) - cap AS caps,
             sum(weight) OVER (ORDER BY cap / weight DESC ROWS UNBOUNDED PRECEDING) AS rest FROM v),
l AS (SELECT ((SELECT sum(words) FROM s) - caps) / rest AS lvl FROM o WHERE weight * (((SELECT sum(words) FROM s) - caps) / rest) <= cap ORDER BY place LIMIT 1),
t AS (SELECT source, number, words, least(weight * (SELECT lvl FROM l), cap::DOUBLE) AS target FROM v),
p AS (SELECT doc_id, d.size, words AS source_size, number, target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (SELECT sum(greatest(least(p.size, floor(target) - (e * source_size + before)), 0)) FROM range({_M.MOST}) AS r(e))::BIGINT AS taken,
             CASE WHEN target > 0 THEN before / target ELSE 0 END AS u FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE number % 3
           WHEN 0 THEN CASE WHEN u <= 0 THEN 0 ELSE 2 * u / (1 + 1) END
           WHEN 1 THEN CASE WHEN 2 * u <= 0 THEN 0 ELSE 2 * (2 * u) / (3 + sqrt(9 - 4 * (2 * u))) END
           ELSE CASE WHEN 3 * u < 1 THEN CASE WHEN 3 * u <= 0 THEN 0 ELSE 2 * (3 * u) / (2 + 2) END ELSE CASE WHEN 3 * u - 1 <= 0 THEN 0.5 ELSE 0.5 + 2 * (3 * u - 1) / (2 + sqrt(4 + 16 * (3 * u - 1))) END END END END AS position
FROM c
"""

ORACLE: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op10_quality_rules": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_source_mixing": OP13_SQL}
