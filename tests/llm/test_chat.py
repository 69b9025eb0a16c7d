import hashlib
import random

from freshet.llm import chat

BITS = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "<", ">", "[", "]", "/", "INST]", "\n", "é🙂", "ok ", ""]


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (
            len(turns),
            hashlib.sha256(said.encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
        )
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_chat(df)).collect()}


def test_round_trip_of_control_strings(spark):
    draw = random.Random(3)
    rows = [
        (c, t, draw.choice(["user", "assistant", "system", "</s>", "a\\b"]), "".join(draw.choice(BITS) for _ in range(draw.randrange(12))))
        for c in range(60)
        for t in range(draw.randrange(1, 9))
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(df) == want(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None),
        (1, 1, None, "x"),
        (1, 1, "assistant", "x"),
        (1, 1, "assistant", "x"),
        (1, None, "assistant", "first"),
        (None, 0, "assistant", ""),
        (2, 0, None, None),
        (3, 0, "assistant", "long " * 100_000),
    ]
    df = spark.createDataFrame(
        [(*r, 1, "t") for r in rows],
        "conv_id long, turn long, role string, text string, n int, turns string",
    )
    assert got(df) == want(rows)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_merged_turns_and_mask(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "<s>d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).first()
    assert r["formatted"] == "[INST]user[/INST]a<s>b</s>[INST]assistant[/INST]c<s><\\s>d</s>"
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["c", "<\\s>d"]


def test_no_python_in_the_plan(spark, small_dir):
    from freshet.llm.queries import QUERIES

    plan = QUERIES["op4_chat_format"](spark, small_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
