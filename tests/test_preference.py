import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.messages import MESSAGES_TYPE
from textloom.operators import preference
from textloom.plans import posttrain

PAIR = f"i int, chosen {MESSAGES_TYPE}, rejected {MESSAGES_TYPE}"
SCORED = "i int, prompt string, response_1 string, response_2 string, preference_strength int, split string"
U = ("user", "How deep is the lake?")


def rows(df):
    return {r.i: r for r in df.collect()}


def test_shared_prompt_is_removed(spark):
    df = spark.createDataFrame(
        [(0, [U, ("assistant", "40 m")], [U, ("assistant", "wet")])], PAIR
    )
    row = rows(preference.explicit_preference(df))[0]
    assert [tuple(m) for m in row.prompt] == [U]
    assert row.chosen[0].content == "40 m" and row.rejected[0].content == "wet"


def test_no_shared_prompt_fails_or_drops(spark):
    df = spark.createDataFrame([(0, [U, ("assistant", "a")], [("user", "x"), ("assistant", "b")])], PAIR)
    with pytest.raises(Exception, match="first message"):
        preference.explicit_preference(df).collect()
    assert preference.explicit_preference(df, "drop").count() == 0
    assert preference.without_prompt(df).first()[0] == 1


def test_prefix_against_plain_python(spark):
    generator = random.Random(3)
    pool = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", None)]
    data = []
    for i in range(300):
        chosen = generator.choices(pool, k=generator.randint(0, 5))
        rejected = chosen[: generator.randint(0, 5)] + generator.choices(pool, k=generator.randint(0, 3))
        data.append((i, chosen, rejected))
    found = rows(preference.explicit_preference(spark.createDataFrame(data, PAIR), "drop"))
    for i, chosen, rejected in data:
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        if n == 0:
            assert i not in found
            continue
        plain = lambda ms: [tuple(m) for m in ms]
        assert plain(found[i].prompt) == chosen[:n]
        assert plain(found[i].chosen) == chosen[n:]
        assert plain(found[i].rejected) == rejected[n:]


def test_strict_prefix_is_not_a_complete_pair(spark):
    whole = [U, ("assistant", "a"), ("user", "b"), ("assistant", "c")]
    df = spark.createDataFrame([(0, whole, whole[:2]), (1, whole, [*whole[:3], ("assistant", "d")])], PAIR)
    assert set(rows(preference.explicit_pairs(df))) == {1}


def scored(spark, data):
    return spark.createDataFrame(data, SCORED)


def test_sign_picks_the_response(spark):
    df = scored(
        spark,
        [
            (0, "How deep is the lake?", "forty", "no idea", -2, "validation"),
            (1, "How deep is the lake?", "forty", "no idea", 2, "validation"),
            (2, "How deep is the lake?", "forty", "no idea", 1, None),
        ],
    )
    found = rows(preference.normalize_scored(df, ["i"]))
    assert found[0].chosen[0].content == "forty" and found[1].chosen[0].content == "no idea"
    assert found[0].rejected[0].content == "no idea"
    assert found[1].source_split == "validation" and found[2].source_split == "train"
    assert found[0].preference_strength == 2
    assert [m.role for m in found[0].prompt] == ["system", "user"]


def test_scored_filter_edges(spark):
    df = scored(
        spark,
        [
            (0, "p", "a", "b", 0, None),
            (1, None, "a", "b", 1, None),
            (2, "p", " ", "b", 1, None),
            (3, "p", "a", None, 1, None),
            (4, "p", "a", "b", 1, None),
            (5, "p", "a", "b", None, None),
        ],
    )
    assert set(rows(preference.scored_filter(df))) == {4}


def test_older_response_names(spark):
    df = scored(spark, [(0, "p", "a", "b", -1, "train")])
    old = df.withColumnRenamed("response_1", "response1").withColumnRenamed("response_2", "response2")
    assert rows(preference.normalize_scored(old, ["i"]))[0].chosen[0].content == "a"


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"\['preference_strength', 'prompt'\]"):
        preference.scored_filter(spark.range(1))
    with pytest.raises(ValueError, match=r"\['chosen', 'rejected'\]"):
        preference.valid_pairs(spark.range(1))


def test_unique_prompts_keep_the_first_and_survive_a_hot_prompt(spark):
    data = [(i, "hot" if i % 3 else f"p{i % 20}\n\"é", "a", "b", 1, "train" if i % 4 else "test") for i in range(3000)]
    reward = posttrain.reward_collection(scored(spark, data), "i", 1)
    found = preference.unique_prompts(reward, "i").collect()
    first = {}
    for i, prompt, *_rest, split in data:
        first.setdefault(("train" if split == "train" else "validation", prompt), i)
    assert {(r.split, r.prompt[1].content): r.i for r in found} == first
    apart = preference.unique_prompts(reward, "i", across_splits=True).collect()
    train = {r.prompt[1].content for r in apart if r.split == "train"}
    assert not train & {r.prompt[1].content for r in apart if r.split != "train"}


def test_collections(spark):
    talks = spark.createDataFrame(
        [(i, [U, ("assistant", f"a{i}")]) for i in range(250)], f"i int, messages {MESSAGES_TYPE}"
    )
    pairs = spark.createDataFrame(
        [(i, [U, ("assistant", "x")], [U, ("assistant", f"y{i}")]) for i in range(150)], PAIR
    )
    ratings = scored(spark, [(i, f"p{i % 7}", "a", "b", i % 3 - 1, None) for i in range(90)])
    made = posttrain.collections(talks, pairs, ratings, "i")
    counts = {
        name: dict(frame.groupBy("split").count().collect()) for name, frame in made.items()
    }
    assert counts["sft"] == {"train": 248, "validation": 2}
    assert counts["dpo"] == {"train": 149, "validation": 1}
    assert counts["reward"] == {"train": 54, "validation": 6}
    assert counts["rlhf"]["train"] == 7
    assert made["sft"].filter(F.col("split").isNull()).count() == 0


def test_from_files_to_one_data_set(spark, tmp_path):
    talks = spark.createDataFrame(
        [([U, ("assistant", f"a{i}")],) for i in range(120)] + [([U],)], f"messages {MESSAGES_TYPE}"
    )
    pairs = spark.createDataFrame(
        [([U, ("assistant", "x")], [U, ("assistant", f"y{i}")]) for i in range(40)],
        f"chosen {MESSAGES_TYPE}, rejected {MESSAGES_TYPE}",
    )
    ratings = scored(spark, [(i, f"p{i % 5}", "a", "b", 1, "train" if i else "test") for i in range(30)])
    talks.write.parquet(str(tmp_path / "talks"))
    pairs.write.parquet(str(tmp_path / "pairs"))
    ratings.drop("i").write.json(str(tmp_path / "scored" / "preference.jsonl"))
    inputs = [str(tmp_path / p) for p in ("talks", "pairs", "scored")]
    counts = posttrain.prepare_posttrain(spark, *inputs, str(tmp_path / "out"))
    assert {(r.collection, r.split): r.rows for r in counts.collect()} == {
        ("sft", "train"): 119,
        ("sft", "validation"): 1,
        ("dpo", "train"): 39,
        ("dpo", "validation"): 1,
        ("reward", "train"): 29,
        ("reward", "validation"): 1,
        ("rlhf", "train"): 5,
        ("rlhf", "validation"): 1,
    }


def test_conversation_files_are_routed_by_name(spark, tmp_path):
    for name, n in (("train-0", 5), ("test-0", 3)):
        frame = spark.createDataFrame([([U, ("assistant", "a")],)] * n, f"messages {MESSAGES_TYPE}")
        folder = tmp_path / f"tmp-{name}"
        frame.coalesce(1).write.parquet(str(folder))
        (tmp_path / "raw").mkdir(exist_ok=True)
        part = next(folder.glob("*.parquet"))
        (tmp_path / "raw" / f"{name}.parquet").write_bytes(part.read_bytes())
    rows = posttrain.load_conversations(spark, str(tmp_path / "raw"))
    assert dict(rows.groupBy("split").count().collect()) == {"train": 5, "validation": 3}


def test_stored_columns_are_required(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="messages"):
        posttrain.load_conversations(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="chosen"):
        posttrain.load_pairs(spark, str(tmp_path / "p"))
    (tmp_path / "preference.jsonl").write_text('{"prompt": "x"}')
    with pytest.raises(ValueError, match="preference_strength"):
        posttrain.load_scored(spark, str(tmp_path))
