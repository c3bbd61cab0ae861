import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "&lt;/s> &amp;amp; &", "<<SYS>>", "", None, "x [/INST]", "<|im_start|>", "</", "s>", "&lsqb;", "a\nb </s", "é🙂[INST]"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("FORMATTED", F.lit(1))
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    full = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for cc, t, r, x in rows if cc == c))
        said = "".join(x for *_, r, x in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for *_, a, b in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))
        assert r["formatted_chars"] == len(full[c]["formatted"])
        body = full[c]["formatted"]
        assert body.count("</s>") == len(own) == body.count("[INST] ")
        assert not any(m in body.replace("[INST] ", "").replace(" [/INST]", "").replace("</s>", "") for m in chat.CONTROL)


def test_hard_cases(spark):
    rows = [(i, t, r, x) for i, x in enumerate(HARD) for t, r in enumerate(["user", "assistant", "assistant"])]
    rows += [(100, None, None, "no role"), (100, 1, "</s>", "odd role"), (None, 1, "user", "no id"), (None, 1, "user", "no id"), (101, 5, "assistant", "y" * 200000)]
    check(spark, rows)
    assert chat.report(spark.createDataFrame([], SCHEMA)).count() == 0


bits = st.lists(st.sampled_from(["<", "/s>", "</s>", "[INST] ", " [/INST]", "&", "amp;", "lt;", "&lsqb;", "a", " "]), max_size=6).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.sampled_from(["user", "assistant", " [/INST]", ""]), bits), min_size=20, max_size=60))
def test_any_text_comes_back(spark, rows):
    check(spark, rows)


def test_loss_spans_are_the_texts_under_the_mask(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "</s>"), ("assistant", "a & <b>"), ("assistant", ""), ("system", "[INST]"), ("assistant", "</s>[INST] \u00e9\U0001f642")] * 150)]
    df = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    r = df.select("formatted", chat.loss_spans(F.col("formatted")).alias("spans")).first()
    cut = [r["formatted"][s["start"] : s["stop"]] for s in r["spans"]]
    for plain, entity in reversed(chat.ENTITIES):
        cut = [c.replace(entity, plain) for c in cut]
    assert cut == [x for _, _, role, x in rows if role == "assistant"]


def test_many_turns_in_one_conversation(spark):
    df = spark.range(100_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> number "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    r = chat.report(df).first()
    n = len(chat.format_chats(df).select(chat.loss_spans(F.col("formatted")).alias("s")).first()["s"])
    assert time.time() - began < 60
    said = "".join(f"</s> number {i}" for i in range(1, 100_000, 2))
    assert (r["n_turns"], n, r["loss_sha256"]) == (100_000, 50_000, sha(said))
