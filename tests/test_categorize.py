"""Categories found by rounds and joins against one state in order."""

import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import categorize as C


def in_order(rows, spark, by_count=False, words=frozenset()):
    """(partition, key) -> category of rows (partition, key, text), in order of key."""
    tokens = spark.createDataFrame(rows, "p string, k long, t string").select("k", "p", C.tokens_of(F.col("t")).alias("x")).orderBy("k", "p").collect()
    first, states, out = {}, {}, {}
    for r in tokens:
        first.setdefault((r["p"], tuple(r["x"])), r["k"])
    for p, x in sorted(first, key=lambda f: (first[f], f)):
        state = states.setdefault(p, C.Categorizer(words, by_count=by_count))
        first[p, x] = state.category(list(x), 0)
    for r in tokens:
        out[r["p"], r["k"]] = first[r["p"], tuple(r["x"])]
    return out


def by_joins(rows, spark, window, words=frozenset()):
    df = spark.createDataFrame(rows, "p string, k long, t string").repartition(3)
    return {(r["partition"], r["key"]): r["category"] for r in C.categorize(df, "k", "t", ["k"], partition="p", words=words, window=window).collect()}


def logs(n, seed, shapes=30):
    rng = random.Random(seed)
    word = lambda: rng.choice(["disk", "host", "node", "failed", "volume", "retry", "user", "login", "from", "to", "the", "closed", "timeout", "cache", "miss"])
    base = [[word() for _ in range(rng.randrange(1, 14))] for _ in range(shapes)]
    out = []
    for i in range(n):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            line[rng.randrange(len(line))] = rng.choice([word(), f"h{rng.randrange(50)}x"])
        out.append((rng.choice(["a", "a", "a", "b"]), i, " ".join(line)))
    return out + [("a", n, None), ("a", n + 1, ""), ("b", n + 2, "12:30 0xff"), ("a", n + 3, "w" + " w" * 400), ("a", n + 4, "w" + " w" * 399 + " z"), ("a", n + 5, out[0][2])]


@pytest.mark.parametrize("seed, window", [(1, 150), (2, 16_384)])
def test_same_as_one_state(spark, monkeypatch, seed, window):
    monkeypatch.setattr(C, "LISTS", min(window, 64))
    rows = logs(500, seed)
    assert by_joins(rows, spark, window) == in_order(rows, spark)


def test_dictionary_words(spark):
    rows, words = logs(200, 3), frozenset(["disk", "host", "node", "failed", "volume"])
    assert by_joins(rows, spark, 50, words) == in_order(rows, spark, words=words)


def test_one_very_common_message_and_global_numbers(spark):
    rows = [("a", i, "disk full on node") for i in range(3000)] + [("b", 5000 + i, f"user u{i}x logged in from somewhere far") for i in range(40)] + [("a", 9000, "other thing")]
    df = spark.createDataFrame(rows, "p string, k long, t string").repartition(4)
    got = {r["key"]: (r["category"], r["global_category"]) for r in C.categorize(df, "k", "t", ["k"], partition="p").collect()}
    assert len(got) == len(rows) and got[0] == got[2999] == (1, 1) and {got[5000 + i] for i in range(40)} == {(1, 2)} and got[9000] == (2, 3)


def test_conversations_as_with_counts(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    rows = [tuple(r) for r in m.collect()]
    got, want = by_joins(rows, spark, 16_384), in_order(rows, spark, by_count=True)
    assert got == want


def test_empty_table(spark):
    assert C.categorize(spark.createDataFrame([], "k long, t string"), "k", "t", ["k"]).count() == 0


def test_long_distance():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(25, 40))] for _ in range(2))
        wa, wb = ([rng.randrange(1, 9) for _ in x] for x in (a, b))
        row = [0]
        for w in wb:
            row.append(row[-1] + w)
        for t, w in zip(a, wa):
            above, row = row, [row[0] + w]
            for j, (u, v) in enumerate(zip(b, wb), 1):
                row.append(min(above[j] + w, row[j - 1] + v, above[j - 1] + (0 if t == u else max(w, v))))
        assert C.weighted_distance(a, b, wa, wb) == row[-1]


def test_examples_and_status(spark):
    rows = [("a", i, f"disk full on node{'x' * (i % 7)}") for i in range(50)] + [("a", 100, "user login " + "y " * 700)]
    df = spark.createDataFrame(rows, "p string, k long, t string")
    got = C.category_definitions(C.categorize(df, "k", "t", ["k"], partition="p"), df, "k", "t").orderBy("category").collect()
    assert len(got[0]["examples"]) == 4 and len(got[1]["examples"][0]) == 1000 and got[0]["count"] == 50
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([90, 9, 1, 1])], "category int, count long")
    r = C.categorization_status(counts).first()
    assert (r["messages"], r["categories"], r["rare"], r["frequent"], r["status"]) == (101, 4, 2, 2, "ok")


def test_few_lists_of_common_words_meet(spark):
    rng = random.Random(6)
    rows = [("a", i, " ".join(f"w{rng.randrange(300)}x" for _ in range(12))) for i in range(2000)]
    df = spark.createDataFrame(rows, "partition string, at long, t string").select("partition", "at", C.tokens_of(F.col("t")).alias("tokens"))
    lists = C.token_lists(df, frozenset(), frozenset()).select("pos", F.explode("rare").alias("t"))
    met = lists.groupBy("t").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < 20_000


def test_similar_lists_share_a_rare_pair():
    rng = random.Random(7)
    for n in range(1, 40):
        for _ in range(60):
            a = [rng.choice("abc") for _ in range(n)]
            b = list(a)
            for _ in range(rng.randrange(0, 1 + n // 2)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = [rng.choice("abcd")] * rng.randrange(2)
            if b and C.similarity(a, b, [1] * len(a), [1] * len(b)) > C.LOWER:
                f = {"a\x1fb": 5, "b\x1fa": 3, "\x1fa": 9}
                assert set(C.rare_pairs(a, f)) & set(C.rare_pairs(b, f))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_meet_without_broadcast(spark):
    rows = spark.createDataFrame(logs(300, 9), "p string, k long, t string").select(F.col("p").alias("partition"), F.col("k").alias("at"), C.tokens_of(F.col("t")).alias("tokens"))
    lists = C.token_lists(rows, frozenset(), frozenset())
    near = C.alike(lists, lists)
    assert "SortMergeJoin" in plan_of(near) and "Broadcast" not in plan_of(near)
    held = {r["pos"]: r for r in lists.collect()}
    like = lambda a, b: C.similarity(list(a["tokens"]), list(b["tokens"]), list(a["weights"]), list(b["weights"]))
    want = {(x, y) for x, a in held.items() for y, b in held.items() if y < x and a["partition"] == b["partition"] and like(a, b) > C.LOWER}
    got = [(r["pos"], r["category_pos"]) for r in near.collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_texts_and_tokens_are_not_broadcast(spark):
    df = spark.createDataFrame(logs(60, 9), "p string, k long, t string")
    plan = plan_of(C.category_definitions(C.categorize(df, "k", "t", ["k"], partition="p"), df, "k", "t"))
    # only the keys of common lists, skew.HOT at most, are known to every task
    sent = [x for x in plan.split("\n") if "BroadcastHashJoin" in x]
    assert "SortMergeJoin" in plan and all("_hot_tokens" in x for x in sent)
