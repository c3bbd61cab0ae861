import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as p
from millrace.llm import bpe, decontaminate, quality
from millrace.shared import written
from tests.llm.test_decontaminate import lcs
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as without_repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = sorted(((r["doc_id"], r["text"]) for r in judged.where("kept").select("doc_id", "text").collect()))
    kept = p.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == good
    less = without_repeats(good)
    two = p.drop_repeated_lines(spark, spark.createDataFrame(kept.collect(), kept.schema), SF).collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in two) == [(i, t, len(t)) for i, t in less]
    of = components(less)
    single = [(i, t) for i, t in less if of[i][1] == i]
    three = p.drop_near_duplicates(spark, spark.createDataFrame(two, docs.schema), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in three) == single
    four = p.drop_leaks(spark, spark.createDataFrame(three, docs.schema), SF).collect()
    left = {r["doc_id"] for r in four}
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in single:
        w = b" ".join(decontaminate.words_of(t))
        verbatim = any(b" ".join(own) in w for own in items)
        near = any(lcs(own, w.split()) >= decontaminate.WEAK * len(own) for own in items)
        assert not (verbatim and i in left), i
        assert i in left or near, i
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(p.RANKS), special_tokens={}).encode_ordinary
    texts = {r["doc_id"]: r["text"] for r in four}
    done = p.tokenize(spark, spark.createDataFrame(four, docs.schema), SF).collect()
    assert {r["doc_id"] for r in done} == left
    for r in done:
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in encode(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages(spark):
    """run() gives what the stages give one after the other, and its rows are tokens of what they kept."""
    assert [name for name, _ in p.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "tokenize"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted(map(tuple, p.run(spark, SF).select(columns).collect()))
    assert got == sorted(map(tuple, docs.select(columns).collect())) and len(got) > 50


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_odd_tables(spark, tmp_path, name):
    long = " ".join(f"word{i}" for i in range(40_000))
    texts = [(None, None), (None, ""), (1, "one two"), (1, "one two"), (2, "one two"), (3, long), (4, None), (5, "\n\n"), (6, "a b c d e f g\nh i j k\n" * 3)]
    rows = [(i, t, None if i == 1 else "en", None if i == 2 else "s", None, "x", 1, "y") for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, Leaks string, KEPT int, IDS string").repartition(3)
    spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "entirely other words than those there"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(p.STAGES)[name]
    got = stage(spark, df, str(tmp_path)).collect()
    gone = {"near_duplicates": [(2, "one two")]}.get(name, [])
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(i) for i, t in texts if (i, t) not in gone)
    if name != "tokenize":
        assert got[0].__fields__ == p.COLUMNS
        assert {r["text"] for r in got if r["doc_id"] == 4} == {None} and {r["text"] for r in got if r["doc_id"] == 3} == {long}
    else:
        assert {r["n_tokens"] for r in got if r["doc_id"] == 4} == {0}
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
