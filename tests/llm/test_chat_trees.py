"""Reply trees against plain path enumeration; the template against an exact round trip."""

import random

import pytest
from pyspark.sql import functions as F

from manylabel.llm import chat_trees

SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, node string, jump int"
TEXTS = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "<\\\\|<|", "\\n\\s<", "a\n\nb ü 😀", "<|" * 9]
ROLES = ["user", "assistant", "assistant", "system", None, "we\\ird\n<|role"]


def forest(seed=4, trees=30):
    rng = random.Random(seed)
    rows = []
    for tree in [None, *range(trees)]:
        size = rng.choice([1, 2, 9, 40])
        for m in range(size):
            parent = None if m == 0 else rng.choice([m - 1, rng.randrange(m), 999 if rng.random() < 0.1 else m - 1])
            score = rng.choice([None, 0.0, 1.0, rng.random()])
            rows.append((tree, m, parent, rng.choice(ROLES), rng.choice(TEXTS), score, "clash", 1))
    rows += [(77, 0, 1, "user", "cycle", 1.0, "", 1), (77, 1, 0, "user", "cycle", 1.0, "", 1), (77, 2, 1, "user", "behind", 1.0, "", 1)]
    rows += [(78, 0, None, "user", "x", 1.0, "", 1)] * 2 + [(78, None, 0, "user", "no id", 1.0, "", 1)]
    return rows + [(79, m, m - 1 if m else None, "assistant", str(m), 0.0, "", 1) for m in range(130)]


def paths_of(rows):
    """``{tree: [(mean score, leaf, [messages])]}``, best first."""
    trees = {}
    for r in rows:
        if r[1] is not None:
            trees.setdefault(r[0], {})[r[1]] = r
    out = {}
    for tree, messages in trees.items():
        found = []
        parents = {r[2] for r in messages.values()}
        for leaf in set(messages) - parents:
            path, at = [], leaf
            while at is not None and at not in path and at in messages:
                path.append(at)
                at = messages[at][2]
            if at is None or at not in messages:
                path.reverse()
                mean = sum(messages[m][5] or 0.0 for m in path) / len(path)
                found.append((-mean, leaf, [messages[m] for m in path]))
        if found:
            out[tree] = sorted(found, key=lambda x: (round(x[0], 12), x[1]))
    return out


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths_and_template(spark, branches):
    rows = forest()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = chat_trees.format_trees(df, branches=branches).select(
        "*", chat_trees.read_turns(F.col("formatted")).alias("turns"), chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    want = paths_of(rows)
    assert {r.tree for r in out} == set(want)
    for tree, found in want.items():
        got = sorted((r for r in out if r.tree == tree), key=lambda r: r.branch)
        chosen = found[:branches]
        assert [r.branch for r in got] == list(range(1, len(chosen) + 1))
        for r, (score, _, path) in zip(got, chosen):
            turns = [(m[3] or "", m[4] or "") for m in path]
            assert r.score == pytest.approx(-score)
            assert [(t.role, t.text) for t in r.turns] == turns and r.n_turns == len(turns)
            assert r.loss == [t for role, t in turns if role == "assistant"]
            assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(turns)


def test_long_chain_and_long_text(spark):
    rows = [(1, m, m - 1 if m else None, "user" if m % 2 else "assistant", "<|" * 50_000 if m == 3 else f"t{m}", 0.0, "", 1) for m in range(300)]
    r = chat_trees.format_trees(spark.createDataFrame(rows, SCHEMA)).select(
        chat_trees.read_turns(F.col("formatted")).alias("turns")
    ).first()
    assert [t.text for t in r.turns] == [row[4] for row in rows]


def test_empty_and_chains(spark):
    assert chat_trees.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 2, "assistant", "c", 0), (1, None, None, None, 0), (1, 2, "user", "b", 0), (None, 1, "user", "z", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree_id int")
    out = chat_trees.format_trees(chat_trees.as_chains(df), score=None, unique=True)
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in out.select("tree", chat_trees.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("assistant", "c"), ("user", "b"), ("user", "b")], None: [("user", "z")]}


def test_plan_runs_no_python(spark):
    df = spark.createDataFrame(forest(), SCHEMA)
    plan = chat_trees.format_trees(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
