import hashlib

from pyspark.sql import functions as F

from brassloom.llm import op4_chat
from brassloom.llm.op4_chat import formatted_text, read_back, segments


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip_with_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\[", "<<SYS>>\\<</SYS>>", "", None, "<s>a</s>\n[ROLE]x[:]", "é😀<"]
    rows = [(c, t, ("system", "user", "assistant", "user", "assistant", "tool", None, "user")[t], nasty[(t + c) % len(nasty)]) for c in range(8) for t in range(8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, no int, loss string")
    parts = segments(df)
    for r in read_back(parts).collect():
        mine = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert r.n_turns == 8 and r.turns_sha256 == _sha("".join(f"{a}\n{t}\n" for a, t in mine))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), _sha(loss)) and r.valid
    text = {r.conv_id: r.formatted for r in formatted_text(parts).collect()}
    assert {r.conv_id: r.formatted_chars for r in read_back(parts).collect()} == {k: len(v) for k, v in text.items()}


def test_order_ties_and_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "a"), (5, 0, "assistant", "x"), (5, 0, "assistant", "x"), (6, 0, "user", "q " * 60_000)], schema)
    got = {r.conv_id: r for r in read_back(segments(df)).collect()}
    assert got[None].turns_sha256 == _sha("user\na\nuser\nb\n") and not got[None].valid
    assert got[5].n_turns == 2 and got[5].loss_chars == 2 and not got[5].valid
    assert got[6].formatted_chars == 120_000 + 13
    assert read_back(segments(df.limit(0))).collect() == []


def test_given_conversation_minus_seven_clashing_columns_and_ties(spark, tmp_path):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 5, "user", "mine"), (1, 0, None, "b"), (1, 0, "user", "a"), (1, 0, None, "a"), (1, None, "assistant", None), (None, 1, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, True, 1, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, valid boolean, no int, last string, part int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op4_chat.op4_chat(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    # turns of one number stand by role (null is empty), then text; null turns come first
    assert got[1].turns_sha256 == sha("assistant\n\n" + "\na\n" + "\nb\n" + "user\na\n") and got[1].n_turns == 4 and not got[1].valid
    assert got[-7].n_turns == 3 and got[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\nuser\nmine\n")
    assert got[None].n_turns == 2 and got[None].turns_sha256 == sha("user\nx\n" * 2)


def test_a_very_long_conversation(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<"), F.col("id").cast("string")).alias("text"))
    (r,) = op4_chat.read_back(op4_chat.segments(turns)).collect()
    loss = "".join(f"<{k}" for k in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.valid) == (n, len(loss), True) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
