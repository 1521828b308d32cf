from pyspark.sql import functions as F

from furrow.llm import chat_format


def test_query_reads_the_mask(spark, sf, monkeypatch):
    whole = {r.conv_id: r.loss_chars for r in chat_format.op10_chat_formatting(spark, sf).collect()}
    made = chat_format.format_chats
    monkeypatch.setattr(chat_format, "format_chats", lambda turns: made(turns).withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("skip", m["skip"] + m["take"]).withField("take", m["take"] * 0))))
    assert any(whole.values())
    assert {r.loss_chars for r in chat_format.op10_chat_formatting(spark, sf).collect()} == {0}


def test_learnt_text(spark):
    said = "50% <<SYS [INST] é😀 </s>"
    rows = [(1, 1, "user", "hm"), (1, 2, "assistant", said), (1, 3, "assistant", ""), (1, 4, "assistant", "b"), (1, 5, "tool", "x%3C"), (2, 1, "user", None), (3, 1, "assistant", None)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chats.select("conv_id", chat_format.learnt_text(F.col("formatted"), F.col("loss_mask")).alias("t")).collect()
    assert {r.conv_id: r.t for r in got} == {1: said + "b", 2: "", 3: ""}
