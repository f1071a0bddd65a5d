import random
from collections import defaultdict

import pytest

from relspark.llm import jaccard_join as J


def shingles(text):
    words = [("".join(c for c in w.lower() if c.isalnum()) or w.lower()) for w in (text or "").split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def brute(rows):
    """{place: (class's places, number of links)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a | b and len(a & b) / len(a | b) >= 0.8):
                near[i].add(j)
                near[j].add(i)
    out, seen = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for n in near[todo.pop()] - group:
                    group.add(n)
                    todo.append(n)
            for g in group:
                seen[g] = group
        ids = [rows[g][0] for g in seen[i] if rows[g][0] is not None]
        out[i] = (min(ids) if ids else None, len(near[i]))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 12, 60, 150]))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return [(i, d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("leaf", [512, 6])
def test_like_brute_force(spark, monkeypatch, leaf):
    for name in ("LEAF", "RARE", "HOME", "BLOCK"):
        monkeypatch.setattr(J, name, leaf)
    monkeypatch.setattr(J, "BLOCK_BYTES", 400 * leaf)
    rows = corpus(leaf)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: v for i, v in brute(rows).items()}


def test_testdata(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: v for i, v in brute(rows).items()}


def test_awkward_rows(awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    want = sorted(map(repr, [(rows[i].doc_id, *v) for i, v in brute([tuple(r) for r in rows]).items()]))
    assert sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in J.near_duplicates(awkward).collect()) == want
    kept = J.deduplicate(awkward)
    assert kept.columns == awkward.columns
    # Documents 1, 2 and 1 again; 3, 4 and one without an id; 5 and 6 are groups.
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 3, 5, None, 7, 8, 9]))
    assert J.near_duplicates(nothing).count() == 0 and J.deduplicate(nothing).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.comp for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups of more than LEAF copies of one body with an ending of their own each: their large buckets have the same members."""
    for name in ("LEAF", "RARE", "HOME"):
        monkeypatch.setattr(J, name, 16)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(20):
        body = " ".join(word() for _ in range(140))
        rows += [(24 * g + i, f"{body} {word()}") for i in range(24)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i // 24 * 24, 23) for i, _ in rows}


def test_short_texts_in_large_groups(spark, monkeypatch):
    """Texts of eight words, each with more than LEAF copies that have a ninth word: linked pairs share four of five runs, all in large buckets."""
    for name in ("LEAF", "RARE", "HOME"):
        monkeypatch.setattr(J, name, 16)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(40):
        head = " ".join(word() for _ in range(8))
        rows += [(50 * g + i, f"{head} {word()}" if i else head) for i in range(50)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i // 50 * 50, 1 if i % 50 else 49) for i, _ in rows}


def test_near_copies_without_ids_keep_one(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{body} {end}") for end in ("a", "b", "c")] + [(None, "something else"), (4, "and more")]
    kept = J.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 3 and {r.text for r in kept} > {"something else", "and more"}


def test_runs_are_added_until_the_recall_is_met(spark, monkeypatch):
    """With a third of a run at a time most links are missed at first; the measured recall brings more runs."""
    monkeypatch.setattr(J, "RUNS", 0.3)
    seen = []
    measured = J.measured_recall
    monkeypatch.setattr(J, "measured_recall", lambda *a, **k: seen.append(measured(*a, **k)) or seen[-1])
    monkeypatch.setattr(J, "MOST_RUNS", 40)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(40):
        body = " ".join(word() for _ in range(90))
        rows += [(3 * g + i, f"{body} {word()}") for i in range(3)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i // 3 * 3, 2) for i, _ in rows} and seen[0] < 0.9 and seen[-1] >= J.RECALL and seen == sorted(seen)


def test_measured_recall_by_hand(spark):
    sketch = list(range(100))
    rows = [(i, 100, sketch) for i in range(4)] + [(9, 100, list(range(1000, 1100)))]
    classes = spark.createDataFrame(rows, "sig long, n long, sketch array<int>")
    comps = lambda found: spark.createDataFrame(found, "node long, comp long")
    assert J.measured_recall(classes, comps([(0, 0), (1, 0), (2, 0), (3, 0)])) == 1.0
    assert J.measured_recall(classes, comps([(0, 0), (1, 0)])) == 2 / 12
    assert J.measured_recall(classes, comps([(7, 7), (8, 7)])) == 0.0
