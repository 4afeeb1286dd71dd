"""Each operator against a brute-force version on a small fixture with awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from manylabel.llm import (
    language_filters, line_dedup, near_documents, packing, simhash, stable_hashing, suffix_dedup, toxicity, tree_search,
    viterbi, window_dedup,
)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, id string, kept_text string"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéßo") for _ in range(rng.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(40) for _ in range(4)] + ["license line", "x", line(12)]
    out = [None, "", "  \n\t ", "one", "ä", "\n", "\n\n", None, "x" * 5000, " ".join("abcdefghi"[i % 7] for i in range(4000))]
    for _ in range(90):
        parts = [line(rng.randint(1, 30)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(parts))
    for i in range(12, 40, 3):
        out.append(out[i])
        words = out[i].split(" ")
        if len(words) > 12:
            words[5] = "changed"
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    return [
        (i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", len(t or ""), i, "clash", "clash")
        for i, t in enumerate(texts())
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(3)
    for trial in range(20):
        codes = rng.integers(trial % 2, 2 + trial % 4, rng.integers(1, 300)).astype(np.uint8)
        if trial % 4 == 0:
            codes = np.tile(codes[:15], 20)
        data = codes.tobytes()
        order = sorted(range(len(data)), key=lambda i: data[i:])
        suffixes = suffix_dedup.suffix_array(codes)
        assert suffixes.tolist() == order
        prefix = suffix_dedup.common_prefixes(codes, suffixes)
        for i, j in zip(order[:-1], order[1:]):
            shared = 0
            while max(i, j) + shared < len(data) and data[i + shared] == data[j + shared]:
                shared += 1
            assert prefix[j] == shared


def strings_left(rows, length):
    seen, out = {}, {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            seen.setdefault(data[p : p + length], i)
    for i, t, *_ in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes", [800, 1_000_000])
def test_repeated_strings(docs, rows, shard_bytes):
    got = collected(suffix_dedup.remove_repeated_strings(docs, shard_bytes=shard_bytes))
    want = strings_left(rows, 50)
    assert {i: tuple(r)[1:] for i, r in got.items()} == want


def test_repeated_windows(docs, rows):
    got = collected(window_dedup.remove_repeated_windows(docs))
    count = collections.Counter()
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    for w in split.values():
        count.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert tuple(got[i])[1:] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("least", [1, 2, 3])
def test_repeated_lines(docs, rows, least):
    got = collected(line_dedup.remove_repeated_lines(docs, least, with_text=True))
    seen = set()
    for i, t, *_ in rows:
        lines = t.split("\n") if t else []
        gone = [False] * len(lines)
        for p in range(len(lines) - least + 1):
            run = tuple(lines[p : p + least])
            if run in seen:
                gone[p : p + least] = [True] * least
            seen.add(run)
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        assert (got[i].n_lines, got[i].n_removed) == (len(lines), sum(gone))
        assert got[i].kept_text == (None if t is None else kept)


def test_repeated_rows_stay_alike(spark, rows):
    twice = spark.createDataFrame(rows[10:20] * 2, DOCS).repartition(2)
    for out in (suffix_dedup.remove_repeated_strings(twice), line_dedup.remove_repeated_lines(twice)):
        seen = collections.defaultdict(set)
        for r in out.collect():
            seen[r.doc_id].add(tuple(r))
        assert {len(v) for v in seen.values()} == {1} and len(seen) == 10


def simple_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows):
    got = {r.key: r for r in simhash.near_components(simhash.fingerprints(docs)).collect()}
    prints = [simple_print(t) for _, t, *_ in rows]
    assert [got[i].print & (1 << 64) - 1 for i in range(len(rows))] == prints
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert [got[i].component for i in range(len(rows))] == components_of(len(rows), links)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 256, 300).astype(np.uint64)[:, None]
    tree = rng.integers(0, 3, 300)
    forest = simhash.Forest(prints, tree)
    root = np.array([forest.roots[t] for t in tree.tolist()])
    found = {(q, n) for a, b, _ in forest.within(prints, root, 2) for q, n in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(300) for j in range(300) if tree[i] == tree[j] and (int(prints[i, 0]) ^ int(prints[j, 0])).bit_count() <= 2}
    assert found == want


def test_near_documents(docs, rows):
    got = {r.key: r.component for r in near_documents.near_documents(docs).collect()}
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert [got[i] for i in range(len(rows))] == components_of(len(rows), links)


def family(similarity, n, words=400, seed=11):
    """``n`` pages on one template, any two about ``similarity`` alike; a run of each is its own."""
    rng = random.Random(seed)
    fresh = lambda k: [f"{rng.getrandbits(40):x}" for _ in range(k)]
    template, own = fresh(words), round(words * (1 - similarity) / (2 * (1 + similarity))) - 4
    pages = []
    for _ in range(n):
        at = rng.randrange(words // 2 - own)
        pages.append(template[:at] + fresh(own) + template[at + own :])
    return pages, fresh


def shingle_sets(pages):
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in pages]


def near_components_of(spark, pages):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(pages)], "doc_id long, text string")
    got = {r.key: r.component for r in near_documents.near_documents(df).collect()}
    return [got[i] for i in range(len(pages))]


def test_true_links_among_noisy_ones_of_a_template(spark):
    pages, fresh = family(0.7, 240)
    for w in pages[:40]:
        pages.append(w[:330] + fresh(26) + w[356:])  # 0.86 alike
    sets = shingle_sets(pages)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = components_of(len(pages), links)
    assert len(set(want)) < len(pages) - 30
    assert near_components_of(spark, pages) == want


def test_nearest_looking_pair_of_a_template_is_checked(spark):
    pages, _ = family(0.77, 250)
    prints = np.array([near_documents.wide_print(simhash.shingle_hashes(" ".join(w).encode(), 5), 2) for w in pages])
    sets = shingle_sets(pages)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) < 0.79 * len(sets[i] | sets[j])]
    i, j = np.array(pairs).T
    best = np.argmin(simhash.distance(prints[i], prints[j]))
    assert near_components_of(spark, [pages[i[best]], pages[j[best]]]) == [0, 1]


def test_alike_counts_common_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 1, 40, 50, 60, 60)]
    a, b = (x.ravel() for x in np.meshgrid(range(6), range(6), indexing="ij"))
    want = [len({*sets[i]} & {*sets[j]}) >= 0.5 * len({*sets[i]} | {*sets[j]}) for i, j in zip(a, b)]
    assert near_documents.alike(sets, a, b, 0.5).tolist() == want


VECTORS = "vec_id long, embedding array<float>, label int, copies int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(260, 16))
    base[100:140] = base[:40] + rng.normal(size=(40, 16)) * 0.05
    base[140:180] = base[7]
    out = [(i, [float(np.float32(x)) for x in v], 1, 9) for i, v in enumerate(base)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    return out + [(300 + i, v, None, 9) for i, v in enumerate(odd)]


def test_near_vectors(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = collected(stable_hashing.near_vectors(df), "vec_id")
    x = np.array([v for _, v, *_ in vectors[:260]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    component = components_of(260, [(i, j) for i in range(260) for j in range(i) if link[i, j]])
    for i in range(260):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum() - 1, component[i], component[i] == i)
    for i in range(300, 305):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_tree_search(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = collections.defaultdict(list)
    for r in tree_search.search(df, df.filter("vec_id % 10 = 0"), branching=4, leaf_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v, *_ in vectors[:260]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in range(0, 260, 10):
        scores = np.round(x @ x[q], 9)
        scores[q] = -2
        best = np.lexsort([np.arange(260), -scores])[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in got[q]], [x[v] @ x[q] for _, v, _ in got[q]])
        found += len({v for _, v, _ in got[q]} & set(best.tolist()))
    assert found >= 0.9 * 130 and set(got) == set(range(0, 260, 10))
    assert [v for _, v, _ in got[140]] == [7, 141, 142, 143, 144]


def test_repeated_query_rows_count_once(spark, vectors):
    df = spark.createDataFrame(vectors + vectors[:40], VECTORS).repartition(3)
    got = collections.defaultdict(list)
    for r in tree_search.search(df, df.filter("vec_id % 10 = 0"), branching=4, leaf_rows=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 260, 10))
    for found in got.values():
        assert sorted(r for r, _ in found) == [1, 2, 3, 4, 5] and len({v for _, v in found}) == 5


def test_each_vector_length_is_searched_by_itself(spark, vectors):
    rng = np.random.default_rng(9)
    short = [(400 + i, [float(v) for v in rng.normal(size=3)], None, 9) for i in range(4)] + [(450, [1.0, 2.0], None, 9)]
    df = spark.createDataFrame(vectors + short, VECTORS).repartition(3)
    got = collections.defaultdict(list)
    for r in tree_search.search(df, df.filter("vec_id % 50 = 0"), branching=4, leaf_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    x = np.array([v for _, v, *_ in short[:4]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got.pop(400) == [400 + int(i) for i in np.argsort(-(x @ x[0])) if i]  # all there are, nearest first
    assert set(got) == set(range(0, 260, 50))  # 450 has no other row of its length
    assert all(len(v) == 5 and max(v) < 260 for v in got.values())


def test_viterbi_equals_plain_search_and_round_trips(docs, rows):
    vocabulary = viterbi.load_vocabulary(VOCABULARY)
    rng = random.Random(1)
    samples = ["▁a ▁ b", "naïve 漢字😀 " + "x" * 200, " x▁" * 9] + ["".join(rng.choice("abth ▁é漢\n") for _ in range(60)) for _ in range(40)]
    for text in samples:
        marked = ["\0" if c == "▁" else "▁" if c == " " else c for c in text]
        best, back = [0.0], [None]
        for i in range(1, len(marked) + 1):
            choice = None
            for n in range(1, min(i, vocabulary.max_length) + 1):
                piece = vocabulary.ids.get("".join(marked[i - n : i]))
                if piece is None and n > 1:
                    continue
                score = best[i - n] + (vocabulary.unknown if piece is None else float(vocabulary.scores[piece]))
                if choice is None or score > choice[0]:
                    choice = (score, n, piece)
            best.append(choice[0])
            back.append(choice[1:])
        want, i = [], len(marked)
        while i:
            n, piece = back[i]
            raw = text[i - 1].encode()
            want = ([piece] if piece is not None else vocabulary.byte_ids[list(raw)].tolist()) + want
            i -= n
        streamed = [x for out in viterbi.encode_stream(vocabulary, [text[:9], text[9:]]) for x in out]
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = viterbi.encode_texts(vocabulary, data, np.array([0, len(data)]))
        assert streamed == ids.tolist() == want
    encoded = viterbi.encode_documents(docs, vocabulary)
    assert encoded.filter("not round_trip").count() == 0
    back = collected(viterbi.decode_documents(encoded, vocabulary))
    assert {i: r.text for i, r in back.items()} == {r[0]: r[1] for r in rows}


def test_packing(docs, rows):
    out = packing.pack_documents(docs, F.xxhash64("text"), capacity=64, per_source=1, group_rows=50).collect()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    bins, total = collections.defaultdict(list), collections.Counter()
    for r in out:
        total[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert {i: len((t or "").split()) for i, t in text.items()} == {i: total[i] for i in text}
    for rows_ in bins.values():
        assert sum(r.n_words for r in rows_) <= 64
        ends = 0
        for r in sorted(rows_, key=lambda r: r.bin_offset):
            assert r.bin_offset == ends
            ends += r.n_words
        named = [source[r.doc_id] for r in rows_ if source[r.doc_id] is not None]
        assert len(named) == len(set(named)) and len({text[r.doc_id] for r in rows_}) == len(rows_)


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, offsets = packing.best_fit([6, 5, 3, 3, 2], ["c", "a", "a", "b", None], [3, 1, 2, 1, None], 8)
    assert bins == [0, 1, 2, 2, 0] and offsets == [0, 0, 0, 3, 6]


def test_language_filters(spark, sf_dir, empty, docs):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = language_filters.fit_filters(real.filter("doc_id % 5 != 0"))
    scored = language_filters.predict_language(real, fitted, keep=("doc_id", "lang")).filter("doc_id % 5 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in scored]) > 0.9
    odd = collected(language_filters.predict_language(docs, fitted))
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 5, 6, 7)) and odd[4].lang_pred != "und"
    nothing = language_filters.fit_filters(empty)
    assert {r.lang_pred for r in language_filters.predict_language(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, empty, docs):
    sf = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(real, labels.filter("doc_id % 3 != 1"))
    scored = toxicity.score_toxicity(real, model).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    bad, good = ([r.score for r in scored if r.toxic == y] for y in (1, 0))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.85
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.0}


def test_empty_tables(spark, empty):
    vectors = spark.createDataFrame([], VECTORS)
    vocabulary = viterbi.load_vocabulary(VOCABULARY)
    for out in (
        suffix_dedup.remove_repeated_strings(empty), window_dedup.remove_repeated_windows(empty),
        line_dedup.remove_repeated_lines(empty), simhash.near_components(simhash.fingerprints(empty)),
        near_documents.near_documents(empty), packing.pack_documents(empty, F.xxhash64("text")),
        stable_hashing.near_vectors(vectors), tree_search.search(vectors, vectors), viterbi.encode_documents(empty, vocabulary),
    ):
        assert out.count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c " * 30, "en", "s", 1, 1, "", ""), (None, "a b c " * 30, "en", "s", 1, 1, "", ""), (4, "a b c " * 30, "en", "s", 1, 1, "", "")], DOCS)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_strings(df).collect()} == {None: 180, 4: 0}
    assert sorted(str(r.component) for r in simhash.near_components(simhash.fingerprints(df)).collect()) == ["4", "None", "None"]


@pytest.mark.parametrize("least", [2, 3])
def test_long_lines_count_alone(docs, rows, least):
    got = collected(line_dedup.remove_repeated_lines(docs, least, with_text=True, long_line=30))
    runs, alone = set(), set()
    for i, t, *_ in rows:
        lines = t.split("\n") if t else []
        gone = [False] * len(lines)
        for p in range(len(lines) - least + 1):
            run = tuple(lines[p : p + least])
            if run in runs:
                gone[p : p + least] = [True] * least
            runs.add(run)
        for p, x in enumerate(lines):
            if len(x.encode()) >= 30:
                gone[p] |= x in alone
                alone.add(x)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        assert (got[i].n_lines, got[i].n_removed, got[i].n_spans) == (len(lines), sum(gone), spans)
        assert got[i].kept_text == (None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g))


def test_copies_of_one_line_leave_one(spark):
    line = " ".join(f"w{i}" for i in range(80))
    rows = [(i, line) for i in range(50)] + [(100 + i, f"own {i}\n{line}\nother {i}") for i in range(50)]
    out = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collected(line_dedup.remove_repeated_lines(out, long_line=line_dedup.LONG_LINE))
    assert [got[i].n_removed for i, _ in rows] == [0] + [1] * 99


def test_toxicity_without_common_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = [(i, " ".join(word() for _ in range(20)), i % 2) for i in range(200)] + [(1000 + i, "tied words of one long text", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(docs.drop("toxic"), docs.drop("text"))
    scored = toxicity.score_toxicity(docs, model, keep=("doc_id", "toxic")).collect()
    assert min(r.score for r in scored if r.toxic) > max(r.score for r in scored if not r.toxic)
