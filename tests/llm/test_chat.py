import hashlib

import duckdb
from pyspark.sql import functions as F

from relspark.llm import chat
from relspark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv long, node long, parent long, score double, role string, text string"


def read(out):
    return out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))


def test_branches(spark):
    rows = [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 0.0, "assistant", "bad"), (1, 3, 1, 9.0, "assistant", "<|im_end|>\\l[x"), (1, 4, 3, 5.0, "user\n", "more"), (1, 5, 3, 1.0, "user", None), (1, 6, 5, 0.0, "assistant", "é\n"), (2, 1, 7, None, None, "alone")]
    nodes = spark.createDataFrame(rows, SCHEMA)
    out = read(chat.format_paths(chat.reply_paths(nodes))).collect()
    paths = {(r.conv, r.leaf): [(t.role, t.text) for t in r.turns] for r in out}
    assert paths == {
        (1, 2): [("user", "q"), ("assistant", "bad")], (1, 4): [("user", "q"), ("assistant", "<|im_end|>\\l[x"), ("user\n", "more")],
        (1, 6): [("user", "q"), ("assistant", "<|im_end|>\\l[x"), ("user", ""), ("assistant", "é\n")], (2, 1): [("", "alone")],
    }
    assert {r.leaf: r.loss for r in out if r.conv == 1} == {2: "bad", 4: "<|im_end|>\\l[x", 6: "<|im_end|>\\l[xé\n"}
    best = chat.reply_paths(nodes, branches=1).select("conv", "leaf").distinct().collect()
    assert {(r.conv, r.leaf) for r in best} == {(1, 4), (2, 1)}


def test_long_chain_and_bad_parents(spark):
    rows = [(1, i, i - 1, 0.0, "user", str(i)) for i in range(1, 300)] + [(2, 5, 9, 0.0, "user", "forward"), (2, 9, 9, 0.0, "user", "self"), (2, 9, 9, 0.0, "user", "self")]
    out = read(chat.format_paths(chat.reply_paths(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert {(r.conv, r.leaf): r.n_turns for r in out} == {(1, 299): 299, (2, 5): 1, (2, 9): 1}
    assert [t.text for t in next(r for r in out if r.conv == 1).turns] == [str(i) for i in range(1, 300)]


def test_like_sql(spark, small, tmp_path):
    con = duckdb.connect()
    odd = spark.createDataFrame([(None, 0, "user", "x"), (None, None, None, None), (90001, 1, "assistant", "a\\s"), (90001, 1, "assistant", "a\\s"), (90001, 1, "user", "[INST]<"), (90002, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(odd)
    rows.withColumn("score", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op7_chat_formatting"]).fetchall()
    got = [tuple(r) for r in QUERIES["op7_chat_formatting"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    planted = next(r for r in got if r[0] == -1)
    assert planted[1:5] == (2, hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest(), 21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())


def test_null_and_a_conversation_named_null(spark):
    rows = [(None, 0, "user", "a"), ("null", 0, "user", "b"), ("1", 0, "user", "c")]
    out = read(chat.format_paths(chat.reply_paths(chat.from_turns(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")), branches=1))).collect()
    assert {(r.conv, r.turns[0].text) for r in out} == {(None, "a"), ("null", "b"), ("1", "c")}


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_paths(chat.reply_paths(chat.from_turns(none))).count() == 0


def test_escape_is_reversible(spark):
    texts = ["\\", "\\s", "\\l<", "[\\b", "<|im_start|>", "\\\\n\n", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for header in (False, True):
        rows = df.select("t", chat.escape(F.col("t"), header).alias("e"), chat.unescape(chat.escape(F.col("t"), header), header).alias("u")).collect()
        assert all(r.t == r.u and "<" not in r.e and "[" not in r.e for r in rows)
