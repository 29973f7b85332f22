"""Token files, prefix counts and piece encoding against the libraries."""

import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from deckscope.llm import piece_viterbi, token_files, token_prefix
from deckscope.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n  \t", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>x", "It's don't we'll I'D 'S ''s", "naïve café ÉÉ É", "İstanbul ΣΑΣ ſ K ﬁ", "a b c　d​e", "日本語 テスト 한국어", "😀😀 👩‍👩‍👧 x😀y",
       "1234 12.5 3rd ½ ²", "word. word, word.. word..... (word) 'word'. \"word\"!", "x" * 5000, "ab" * 3000 + " é" * 100, "***&&& a*** b&&&c $$$", "tab\tsep\x0b\x0c\r\nend", "\x00\x01 a\x00b", "   lead", "trail   ", "a  b   c    d", "é ́x ý", "_under_score__ ~!@#"]


def odd_texts(n=150, seed=0):
    rng = random.Random(seed)
    bits = ["the", "The", "THE", " ", "  ", "\n", "'s", "'", "é", "É", "ñ", "1", "23", ".", ",", "...", "***", "😀", "日本", "ing", "tion", "<|endoftext|>", "<|", "\t", " ", "é", "-", "_", "x", "ß", "'ll", "'re", "don't", "a" * 30]
    return ODD + ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(n)]


def sf_texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.encode_ranks(x)
        assert len(control) == -(-n // 4) and (token_files.decode_ranks(control, data, n) == x).all()


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(token_files.vocabulary_text(path))
    texts = odd_texts()
    for _ in range(2):  # anew, and from memory
        ids, begin = own([(x or "").encode() for x in texts])
        for i, x in enumerate(texts):
            assert ids[begin[i] : begin[i + 1]].tolist() == [*library.encode(x or "", add_special_tokens=False).ids, 1], x


@pytest.mark.parametrize("hard", [False, True])
def test_files(spark, hard):
    from tokenizers import Tokenizer

    rows = list(enumerate(odd_texts(), 5)) + [(None, "no id"), (None, None), (7, "again"), (7, "again")] if hard else sf_texts(spark)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    if hard:
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n_tokens").repartition(5)
        blocks, ids = token_files.write_files(df, token_files.vocabulary_text(tokenizer_path("word_bpe_49k.json")))
        got = token_files.read_documents_ids(blocks, ids, token_files.digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").collect()
    else:
        got = QUERIES["op6_token_files"](spark, SF).collect()
    want = [((i is not None, i or 0), np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]
    want.sort(key=lambda x: x[0])
    by_id = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got)
    assert by_id == sorted((k, len(x), zlib.crc32(x.tobytes())) for k, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # starts follow the order of ids without a gap
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id or 0 for r in got)


def test_files_empty(spark):
    blocks, ids = token_files.write_files(spark.createDataFrame([], "doc_id long, text string"), token_files.vocabulary_text(tokenizer_path("word_bpe_49k.json")))
    assert token_files.read_documents_ids(blocks, ids, token_files.digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").count() == 0


def test_files_stand_alone(spark, tmp_path):
    """Another session reads them from the path alone; damaged and foreign files are told."""
    path, schema = str(tmp_path / "files"), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.save_files(docs, token_files.vocabulary_text(tokenizer_path("word_bpe_49k.json")), path)
    other = spark.newSession()
    blocks, ids = token_files.load_files(other, path)
    assert sorted(token_files.read_documents_ids(blocks, ids, token_files.digest, schema).collect()) == sorted(QUERIES["op6_token_files"](spark, SF).collect())
    damaged = blocks.withColumn("data", F.concat(F.substring("data", 1, 5), F.lit("x").cast("binary"), F.expr("substring(data, 7)")))
    with pytest.raises(Exception, match="is not what was written"):
        token_files.read_documents_ids(damaged, ids, token_files.digest, schema).count()
    other.createDataFrame([(token_files.FORMAT + 1, len(ids), 0)], "version int, ids long, crc long").write.mode("overwrite").parquet(f"{path}/format")
    with pytest.raises(ValueError, match="version"):
        token_files.load_files(other, path)


def byte_counter():
    return token_prefix.Counter(token_prefix.Vocabulary(token_files.vocabulary_text(tokenizer_path("byte_bpe_50k.json"))))


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), byte_counter()
    rng = random.Random(3)
    texts = [x or "" for x in odd_texts(300, 1)] + ["".join(chr(c) for c in rng.choices([*range(32, 0x250), *range(0x370, 0x5FF), *range(0x4E00, 0x4F00)], k=60)) for _ in range(60)]
    texts += [" " * n + "x" for n in range(1, 200, 7)] + ["=" * n for n in range(1, 150, 5)] + [t[:3000] for _, t in sf_texts(spark)]
    got = own([x.encode() for x in texts])
    assert [(x, n) for x, n in zip(texts, got.n_tokens.tolist(), strict=True) if n != len(library.encode(x, add_special_tokens=False).ids)] == []


def test_every_prefix(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), byte_counter()
    texts = [t[:400] for _, t in sf_texts(spark)[:6]] + ["internationalization of unbelievably good" + "ab" * 40]
    got = own([x.encode() for x in texts])
    for i, x in enumerate(texts):
        counts = got.at_bytes(i)
        for n in range(len(x) + 1):
            if not x[:n].endswith((" ", "\n", "'")):  # where the prefix alone is cut into the same pre-tokens
                assert counts[len(x[:n].encode())] == len(library.encode(x[:n], add_special_tokens=False).ids)
        for limit in (0, 1, 5, 50, 10**6):
            n = got.fit(i, limit)
            assert counts[n] <= limit and (counts[n + 1 :][np.array([(b & 0xC0) != 0x80 for b in x.encode()[n + 1 :]] + [True] * (n < len(counts) - 1), bool)] > limit).all()


def test_token_counts_hard(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "<|endoftext|>" * 600), (4, "z" * 20000), (5, "the cat " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    vocabulary = token_files.vocabulary_text(tokenizer_path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit, r.fit_bytes) for r in token_prefix.count_tokens(df, vocabulary).collect()}
    assert got[(1, 0)] == got[(2, 0)] == (0, False, 0) and got[(None, 3)] == (2, False, 3) and got[(3, 7800)] == (600, True, 512 * 13)
    assert got[(5, 16000)][1:] == (True, 2045) or got[(5, 16000)][1]
    assert token_prefix.count_tokens(df.limit(0), vocabulary).count() == 0
    assert QUERIES["op9_token_counts"](spark, SF).count() == 200


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), piece_viterbi.Pieces.load(path)
    own, decoder = piece_viterbi.Encoder(pieces), piece_viterbi.Decoder(pieces)
    rng = random.Random(5)
    texts = [x or "" for x in odd_texts(300, 2)] + ["".join(chr(c) for c in rng.choices([*range(32, 0x250), *range(0x370, 0x5FF), *range(0x4E00, 0x4F00)], k=60)) for _ in range(60)]
    texts += [" " * n + "x" for n in range(1, 60)] + ["=" * n for n in range(1, 90)] + ["a▁b ▁▁c", "<s> </s> <unk> <0x41>", "▁"] + [t for _, t in sf_texts(spark)]
    for _ in range(2):  # anew, and from memory
        ids, begin = own([x.encode() for x in texts])
        assert [x for i, x in enumerate(texts) if ids[begin[i] : begin[i + 1]].tolist() != library.encode(x)] == []
    for x, y in zip(texts, decoder(ids, begin), strict=True):
        assert y.decode() == x.replace("▁", " ")


def test_pieces_hard(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "z" * 20000), (4, "the cat " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    model = open(tokenizer_path("piece_bpe_32k.model"), "rb").read()
    got = piece_viterbi.encode_documents(df, model).collect()
    assert len(got) == 6 and all(r.round_trip and len(r.ids) == r.n_tokens for r in got)
    assert piece_viterbi.encode_documents(df.limit(0), model).count() == 0
    assert QUERIES["op5_sentencepiece"](spark, SF).where("round_trip").count() == 200
