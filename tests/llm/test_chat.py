from lumenfold.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.format_chats(df).collect()}


def test_snapshots_collapse_to_the_longest(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(10 + n, k, *turns[k]) for n in (1, 2, 4) for k in range(n)] + [(30, 0, "user", "z")]
    out = run(spark, rows)
    assert set(out) == {14, 30}
    assert out[14].n_turns == 4 and out[14].chat.startswith("<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n")


def test_equal_conversations_and_diverging_ones(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "x"), (2, 0, "user", "a"), (2, 1, "assistant", "x"), (3, 0, "user", "a"), (3, 1, "assistant", "y")]
    out = run(spark, rows)
    assert set(out) == {1, 3} and out[1].n_copies == 2 and out[3].n_copies == 1


def test_nulls_ties_and_empty(spark):
    rows = [(None, 0, None, None), (5, None, "user", ""), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, "user", None), (7, 0, "user", "")]
    out = run(spark, rows)
    # 6 has a null text, which is another turn than an empty one; 7 is a prefix of 5
    assert set(out) == {None, 5, 6}
    assert out[None].chat == "<|unknown|>\n<|end|>\n"
    assert out[5].n_turns == 4 and out[5].chat.count("a<|end|>") == 2
    assert run(spark, []) == {}


def test_very_long_conversation(spark):
    out = run(spark, [(1, k, "user", "t" * (k % 50)) for k in range(3000)] + [(2, k, "user", "t" * (k % 50)) for k in range(2999)])
    assert list(out) == [1] and out[1].n_turns == 3000


def test_main_path_is_native(spark, sf_dir):
    df = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_what_goes_is_not_rendered(spark, sf_dir):
    """The anti-join and the join with its survivors lie below the aggregate that renders."""
    df = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.index("collect_list") < plan.index("LeftAnti") and plan.index("collect_list") < plan.index("Join")
