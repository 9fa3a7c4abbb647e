"""The loss columns of the chat operator come from its mask; ties and odd rows."""

import hashlib

from pyspark.sql import functions as F

from helixion.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_loss_columns_follow_the_mask(spark):
    rows = [(1, 0, "user", "a<s>"), (1, 1, "assistant", "bé</s>c"), (1, 2, "assistant", ""), (1, 3, "assistant", "[INST]d"), (2, 0, "user", "x")]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    assert (got[1].loss_chars, got[1].loss_sha256) == (len("bé</s>c[INST]d"), hashlib.sha256("bé</s>c[INST]d".encode()).hexdigest())
    assert (got[2].loss_chars, got[2].loss_sha256) == (0, hashlib.sha256(b"").hexdigest())
    shifted = out.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["end"] + 1).alias("end"))))
    off = {r.conv_id: r for r in chat.digest(shifted).collect()}
    assert off[1].loss_sha256 != got[1].loss_sha256 and off[1].turns_sha256 == got[1].turns_sha256
    none = {r.conv_id: r for r in chat.digest(out.withColumn("loss_spans", F.slice("loss_spans", 1, 0))).collect()}
    assert none[1].loss_chars == 0 and none[1].n_turns == 4


def test_ties_are_by_the_raw_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "<s>"), (1, 0, "user", "<a"), (1, 0, "user", "<\\a")], SCHEMA)
    assert [t.text for t in chat.parse_chats(chat.format_chats(df)).first().turns] == sorted(["<s>", "<a", "<\\a"])


def test_extra_columns_and_long_texts(spark):
    long = "word <s> " * 40000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], SCHEMA)
    for c in ("_turns", "_pieces", "formatted", "loss", "before", "turns"):
        df = df.withColumn(c, F.lit(1))
    got = {r.conv_id: r for r in chat.op3(spark, df).collect()}
    assert got[1].loss_chars == len(long) and got[1].formatted_chars > 2 * len(long) and set(got) == {1, -1}
