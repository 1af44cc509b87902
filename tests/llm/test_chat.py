"""Formatting and reading back: exact round trips."""

import pytest
from pyspark.sql import functions as F

from passagekit.llm import chat
from tests import oracle
from tests.llm.conftest import CHECKED


def test_query_equals_sql(spark):
    con = oracle.connect(CHECKED)
    result = chat.query(spark, CHECKED)
    assert oracle.spark_types(result) == oracle.sql_types(con, chat.CHECK)
    assert oracle.spark_rows(result) == oracle.sql_rows(con, chat.CHECK)


def test_plan_has_no_python(spark):
    plan = chat.query(spark, CHECKED)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|a", "<\\\\|", "<<||", "|<", "\\", "<\\", "é<|👍|>\n", "<|nl|>", "$1\\$2"])
def test_escaping_is_reversible(spark, text):
    both = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"))
    row = both.select("e", chat.unescaped(F.col("e")).alias("u")).first()
    assert row.u == text and "<|" not in row.e


def test_parts_are_flattened_in_order(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a", None), None, ("audio", "x", "b", 7), ("text", None, None, None), ("document", None, None, 0), ("odd", "kept", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (2, 0, None, [])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    done = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert "see <\\|image|><|image|><|audio|><|document|>kept<|im_end|>" in done[1].formatted
    assert [tuple(a) for a in done[1].attachments] == [("image", "s3://a", 1, 256), ("audio", "b", 2, 7), ("document", None, 4, 0)]
    assert (done[1].expanded_tokens, done[2].expanded_tokens) == (263, 0)


def test_odd_rows(spark):
    rows = [(1, 0, "assistant", "a<", "x"), (1, 0, "assistant", "a<", "x"), (1, None, "us\ner<|im_end|>", "|b", "y"), (None, 1, None, None, "z"), (2, 5, "assistant", "", "w"), (2, 4, "assistant", "é" * 100_000, "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.formatted(df.withColumn("parts", chat.text_parts(F.col("text"))))
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert [tuple(t) for t in back[1].turns] == [("us\ner<|im_end|>", "|b"), ("assistant", "a<"), ("assistant", "a<")]
    assert back[1].loss_texts == ["a<", "a<"]
    assert [tuple(t) for t in back[None].turns] == [("", "")] and back[None].loss_texts == []
    assert back[2].loss_texts == ["é" * 100_000, ""]
    assert chat.formatted(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).collect() == []
