import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, IDS string"
ODD = ["", None, " ", "a" * 3000, "aaaa aaa aa a", "\n\n\n  x \t  y", "é" * 77, "日本語テキスト🙂🙂", "don't WE'LL 12345 $$$%%%&&&", "\x1c\x1d a\x85b​ c", "x" * 50 + " " * 500, "a\r\n b　c"]


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    with open(__file__) as own:
        texts = ODD + [own.read()]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", None), (0, "", "again")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encode = library().encode_ordinary
    out = bpe.unpack_ids(bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)).collect()
    few = bpe.unpack_ids(bpe.encode(df, PATH, P.PATTERN, decoded="decoded", frequent=30)).collect()
    none = bpe.unpack_ids(bpe.encode(df, PATH, P.PATTERN, decoded="decoded", frequent=0)).collect()
    assert len(out) == len(few) == len(none) == len(rows)
    for r in out + few + none:
        assert r["id_list"] == encode(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_digests(spark):
    df = spark.createDataFrame([(1, "To be, or not"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    ids = library().encode_ordinary("To be, or not")
    assert got[1]["n_tokens"] == len(ids)
    assert got[1]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert (got[2]["n_tokens"], got[2]["decoded_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_a_lower_rank_that_appears_late_comes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"xa": 258, b"bcd": 300, b"ab": 299}
    own = bpe.MergeReplay(ranks)
    other = tiktoken.Encoding("t", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    words = ["abcd", "xabcd", "ababab", "bcbcabc", "xaxaxabcbcd", "aab", "zz"]
    assert [np.frombuffer(p, "<u4").tolist() for p in own.encode([w.encode() for w in words])] == [other.encode_ordinary(w) for w in words]


def test_words_that_are_very_long():
    own, encode = bpe.MergeReplay(bpe.load_ranks(PATH)), library().encode_ordinary
    rng = np.random.default_rng(5)
    long = ["a" * 1_000_000, "ab" * 200_000, "".join(rng.choice(list("abcdefgh\u00e9\u65e5"), 300_000))]
    for word in long:
        assert np.frombuffer(own.encode([b"the", word.encode(), b"end"])[1], "<u4").tolist() == encode(word)


def test_what_the_rank_file_lacks(spark):
    with pytest.raises(ValueError, match="byte"):
        bpe.MergeReplay({b"a": 0}).encode([b"ab"])
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([(bytearray(b"\xff" * 4),)], "ids binary"), PATH).collect()


def test_frequent_words_are_counted_over_the_corpus(spark):
    df = spark.createDataFrame([(" common" * 3 + " rare",), (" common other other",), (None,)], "text string").repartition(3)
    replay = spark.sparkContext.broadcast(bpe.MergeReplay(bpe.load_ranks(PATH)))
    got = bpe.frequent_words(df, replay, P.PATTERN, most=1)
    assert list(got) == [" common"] and got[" common"] == replay.value.encode([b" common"])[0]
