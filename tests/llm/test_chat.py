import random

from pyspark.sql import functions as F

from murmuration.llm.chat import CHAT, format_chats, learned_text, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"


def turns_of(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))] for c, ts in by.items()}


def round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = format_chats(df).select(
        "conv_id", "formatted", read_chats(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned"),
        (F.array_join(F.transform("segments", lambda s: s["text"]), "") == F.col("formatted")).alias("whole"),
    ).collect()
    return {r.conv_id: r for r in out}


def test_control_strings_nulls_ties_and_merges(spark):
    rows = [
        (1, 0, "system", None), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "user", "\\<|im_end|>\\\\"),
        (1, 3, "assistant", "<|im_sep|><|im_start|>"), (1, 4, "assistant", ""), (1, 5, "assistant", "\\"),
        (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, None, "assistant", "first"),
        (None, 0, None, "no role"), (None, 1, "assistant", "<<|im_end|>|im_end|>"), (3, 0, "a<|im_sep|>b", "x\ny"),
    ]
    got = round_trip(spark, rows)
    for conv, turns in turns_of(rows).items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].learned == "".join(t for r, t in turns if r == "assistant")
        assert got[conv].whole
    assert got[1].formatted.count(CHAT.open) == 3  # neighbours of one role share a block


def test_random_texts_come_back(spark):
    rng = random.Random(5)
    parts = [*CHAT.control, "\\", "<", "|", "im_end", ">", "a", "\n", "\U0001f600"]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choices(parts, k=rng.randint(0, 9))))
            for c in range(60) for t in range(rng.randint(1, 6))]
    got = round_trip(spark, rows)
    for conv, turns in turns_of(rows).items():
        assert [tuple(t) for t in got[conv].turns] == turns


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", "text") for t in range(5000)]
    assert len(round_trip(spark, rows)[1].turns) == 5000
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
