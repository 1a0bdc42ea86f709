import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import chat

SCHEMA = "conv_id long, msg_id long, seq long, kind string, role string, text string"


def fold(spark, rows):
    return {(r.conv_id, r.msg_id): (r.role, r.text) for r in chat.reconstruct(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fold(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "message", "assistant", ""),
        (1, 2, 3, "delta", None, "a"),
        (1, 2, 4, "delta", None, "b"),
        (1, 2, 5, "regenerate", None, None),
        (1, 2, 6, "delta", None, "c"),
        (1, 2, 7, "delta", None, "d"),
        (1, 1, 8, "edit", None, "hello"),
        (1, 3, 9, "message", "user", "gone"),
        (1, 3, 10, "delete", None, None),
        (2, 1, 1, "delta", "assistant", "x"),
        (2, 1, 1, "delta", "assistant", "x"),
        (None, None, None, None, None, None),
    ]
    assert fold(spark, rows) == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "cd"), (2, 1): ("assistant", "xx"), (None, None): (None, "")}
    assert fold(spark, []) == {}


def test_round_trip(spark):
    odd = ["", "\\", "\\l", "<", "</turn>\n", "<turn:user>\n", "\\\\l<\\", "a\n\nb", "\\### Assistant: </turn> ok", "é😀<"]
    rows = [(i, t, t, ("user", "assistant", "a<b>\\g", None)[t % 4], x) for i, x in enumerate(odd) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, seq long, role string, text string").select("*", F.lit(1).alias("ROLE"))
    done = chat.render(df).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.masked(F.col("segments"))}).collect()
    assert len(done) == len(odd)
    for r in done:
        x = odd[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [("user", x), ("assistant", x), ("a<b>\\g", x), ("", x)]
        assert r.loss == x
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [s.text for s in r.segments if s.loss]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="\\<lg>/turn:\n é", max_size=30), min_size=1, max_size=20))
def test_escapes(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape(chat.escape_role(F.col("t")), role=True).alias("b"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.a == r.b and "<" not in r.e for r in got)


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", "a"), (5, 0, None, "x" * 200_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 5, -7}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"a").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\n\nassistant\na\n").hexdigest()
    assert got[5].formatted_chars == 200_000 + len("<turn:>\n</turn>\n")
    assert got[-7].loss_chars == len(chat._ODD)
