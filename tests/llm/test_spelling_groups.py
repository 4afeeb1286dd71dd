"""Spelling groups against plain edit distance, with tries cut into few-word ranges."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from manylabel.llm import spelling_groups

SCHEMA = "doc_id long, text string, word string, n int, id string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(count, ratio=2):
    forms, out = {}, {}
    for w in count:
        others = [v for v in count if near(w, v)]
        best = min(others, key=lambda v: (-count[v], v), default=None)
        forms[w] = (best if best and count[best] >= ratio * count[w] else None, len(others))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out[w] = (form, root, count[w], n_near, count[form] if form else None)
    return out


def vocabulary(seed=2, n=300):
    rng = random.Random(seed)
    letters = "abÿé"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n)}
    words |= {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "aaaaa", "aaaa", "aaaaaa", "漢字😀a", "漢字😀", "漢字a", "a", "b", "ab"}
    return {w: rng.choice([1, 1, 2, 3, 5, 9, 40]) for w in words}


@pytest.mark.parametrize("letters", [40, 4_000_000])
def test_near_words_and_forms(spark, monkeypatch, letters):
    monkeypatch.setattr(spelling_groups, "RANGE_LETTERS", letters)
    count = vocabulary()
    df = spark.createDataFrame([(w, n, "clash") for w, n in count.items()], "word string, n int, id string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups.group_words(df).collect()}
    assert got == grouped(count)


def test_node_numbers_are_prefixes():
    words = sorted({"a", "ab", "abc", "abd", "b", "ba", "bab", "baba", "cc"})
    import pyarrow as pa

    codes, offsets = spelling_groups._codes(pa.array(words))
    nodes, shared = spelling_groups.number_nodes(codes, offsets, 7)
    seen = {}
    for i, w in enumerate(words):
        for d in range(1, len(w) + 1):
            seen.setdefault(w[:d], set()).add(int(nodes[offsets[i] + d - 1]))
        most = max(len(common) for v in words if v != w for common in [w[: next((k for k in range(min(len(v), len(w))) if v[k] != w[k]), min(len(v), len(w)))]])
        assert shared[i] == most
    assert all(len(x) == 1 for x in seen.values()) and len({*map(tuple, seen.values())}) == len(seen)


def test_words_of_documents(spark):
    rng = random.Random(1)
    base = ["letter", "Letter", "größer", "naïveté", "×signs÷", "banana", "x1y", "wörter"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(200)), "clash", 1, "") for i in range(40)]
    rows += [(50, None, "", 1, ""), (51, "", "", 1, ""), (52, "a" * 30_000 + " " + "b" * 10, "", 1, ""), (None, "letter " * 300, "", 1, "")] + rows[:3]
    count = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    want = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = spelling_groups.count_words(df, noise=7)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 8
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups.group_words(words).collect()} == grouped(want)


def test_empty(spark):
    assert spelling_groups.group_words(spelling_groups.count_words(spark.createDataFrame([], SCHEMA), 97)).count() == 0


def test_shared_lengths():
    import pyarrow as pa

    codes, offsets = spelling_groups._codes(pa.array(["", "abc", "abd", "x"]))
    assert spelling_groups.shared_with_next(codes, offsets).tolist() == [0, 2, 0]
    assert spelling_groups.shared_with(codes, offsets, "abdz").tolist() == [0, 2, 3, 0]
    assert np.array_equal(spelling_groups.shared_with(codes, offsets, None), np.zeros(4))
