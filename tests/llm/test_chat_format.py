import hashlib
import random

from furrow.llm.chat_format import format_chats, op10_chat_formatting, read_chats

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["", "</s>[INST] ok [/INST]", "<|next|>", "%25%3C%5B%3E", "a % b", "<s> x </s>", "<<SYS:user>> y <</SYS>>", "[INST] ", " ", "\n", "é" * 5, None, "%", "%3", "<", "["]


def ordered(rows):
    """Turns of each conversation in order: null turns first, then role, then text."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {conv: [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)] for conv, turns in out.items()}


def rows_of(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["user", "assistant", "assistant", "system", "tool>> x", "s", "", None]), rng.choice(TRICKY)))
    return rows + rows[:7]


def test_round_trip(spark):
    rows = rows_of()
    want = ordered(rows)
    chats = format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_chats(chats).collect()}
    assert got == want
    assert {r.conv_id: r.n_turns for r in chats.collect()} == {k: len(v) for k, v in want.items()}


def test_loss_mask_takes_assistant_texts(spark):
    rows = rows_of(2)
    want = ordered(rows)
    for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect():
        taken, at = [], 0
        for part in r.loss_mask:
            taken.append(r.formatted[at + part.skip:at + part.skip + part.take])
            at += part.skip + part.take + part.after
        assert at == len(r.formatted)
        text = "".join(taken).replace("%3C", "<").replace("%5B", "[").replace("%25", "%")
        assert text == "".join(t for role, t in want[r.conv_id] if role == "assistant")


def test_long_hot_conversation_and_clashes(spark):
    many = spark.range(20_000).selectExpr("cast(1 as int) conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "repeat('word ', 20) text", "1 runs", "'x' formatted", "2 t")
    r = format_chats(many).collect()[0]
    assert r.n_turns == 20_000 and r.formatted.count("[INST]") == 6_667
    one = format_chats(spark.createDataFrame([(5, 0, "assistant", "z" * 500_000)], SCHEMA)).collect()[0]
    assert one.formatted == "<s> " + "z" * 500_000 + " </s>"
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_keeps_the_added_conversation(spark, sf):
    r = op10_chat_formatting(spark, sf).filter("conv_id = -7").collect()
    said = "</s>[INST] ok [/INST]"
    assert len(r) == 1 and r[0].n_turns == 2 and r[0].loss_chars == len(said)
    assert r[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r[0].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
