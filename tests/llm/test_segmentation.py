import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from relspark.llm import segmentation as G

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return G.Vocabulary(MODEL)


def every(vocab, word):
    """All segmentations of a word and their probabilities, straight from the vocabulary."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = {}

    def go(at, ids, score):
        if at == len(word):
            out[tuple(ids)] = score
        for end in range(at + 1, len(word) + 1):
            i = sp.piece_to_id(word[at:end])
            if i != sp.unk_id():
                go(end, [*ids, i], score + vocab.score[i])

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: float(np.exp(v - z)) for k, v in out.items()}


def test_distribution_without_replacement(vocab):
    probs = every(vocab, "▁thor")
    n = 6000
    keys = G.mix(np.arange(n, dtype=np.uint64)).tolist()
    got = G.sample(vocab, ["thor"] * n, keys, 3)
    for row in got:
        assert len({tuple(p[0].tolist()) for p in row}) == 3 and row[0][2] >= row[1][2] >= row[2][2]
        assert all(abs(np.exp(p[1]) - probs[tuple(p[0].tolist())]) < 1e-9 and 0 < p[3] <= 1 for p in row)
    first = Counter(tuple(r[0][0].tolist()) for r in got)
    top = max(probs, key=probs.get)
    for s, p in probs.items():
        assert abs(first[s] / n - p) < 4 * np.sqrt(p / n) + 2e-4
    second = Counter(tuple(r[1][0].tolist()) for r in got if tuple(r[0][0].tolist()) == top)
    for s, p in probs.items():
        if s != top:
            q = p / (1 - probs[top])
            assert abs(second[s] / first[top] - q) < 4 * np.sqrt(q / first[top]) + 2e-3
    # Weighted by inclusion, samples stand for all segmentations.
    assert abs(np.mean([sum(np.exp(p[1]) / p[3] for p in r) for r in got]) - 1) < 0.02


def test_chains_of_words(vocab):
    """Over several words the probabilities multiply, and so do the samples' frequencies."""
    a, b = every(vocab, "▁th"), every(vocab, "▁er")
    n = 4000
    got = G.sample(vocab, ["th er"] * n, G.mix(np.arange(n, dtype=np.uint64)).tolist(), 4)
    total = Counter(tuple(p[0].tolist()) for r in got for p in r)
    best = sorted(((pa * pb, sa + sb) for sa, pa in a.items() for sb, pb in b.items()), reverse=True)
    assert all(abs(np.exp(p[1]) - dict((s, q) for q, s in best)[tuple(p[0].tolist())]) < 1e-9 for r in got[:200] for p in r)
    assert total[best[0][1]] > 0.98 * n and total[best[1][1]] > 0.8 * n


@pytest.mark.parametrize("text", ["", "a", " a", "a ", "a  b", "   ", "\n", "\n\n a", "▁x ▁", "é\x00 b", "中文 ok  yes\tz", "a \n b", "x" * 300, "😀 😀", "\x00", "\U0010fffe ▁ a", " \x00a \x00 \x00b\n\x00", "a\n \x00 b  "])
def test_round_trip(vocab, text):
    for row in G.sample(vocab, [text, "between", text], [1, 2, 1], 3)[::2]:
        assert row and all(vocab.decode(G.expand(vocab, p[0])) == text.encode() for p in row)
        sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        if "▁" not in text and "\x00" not in text:
            assert all(sp.decode([int(i) for i in G.expand(vocab, p[0])]) == text for p in row)


def test_a_zero_byte_changes_no_other_word(vocab):
    (with_zero,) = G.sample(vocab, ["thor \x00 thor"], [5], 1)
    words = every(vocab, "▁thor")
    pieces = [int(p) for p in with_zero[0][0]]
    at = next(i for i, p in enumerate(pieces) if p >= vocab.size)
    blank = pieces[at - 1]
    assert tuple(pieces[: at - 1]) in words and tuple(pieces[at + 1 :]) in words and vocab.spelling[blank] == b" "


def test_batches_do_not_matter(vocab):
    texts = ["the cat", "sat on", "the mat", ""]
    whole = G.sample(vocab, texts, [1, 2, 3, 4], 3)
    for i, t in enumerate(texts):
        (alone,) = G.sample(vocab, [t], [i + 1], 3)
        assert [(p[0].tolist(), p[1:]) for p in alone] == [(p[0].tolist(), p[1:]) for p in whole[i]] or all(a[0].tolist() == b[0].tolist() and np.allclose(a[1:], b[1:]) for a, b in zip(alone, whole[i], strict=True))


def test_words_are_looked_up_once(vocab, monkeypatch):
    """A worker's later texts find the lattices of words that it has seen, whichever chunk those came in."""
    seen, find = [], G.Table.find
    monkeypatch.setattr(G.Table, "find", lambda self, h: seen.append(len(h)) or find(self, h))
    text = "words unheardof before, \n\nthen heard again"
    (first,) = G.sample(vocab, [text], [3], 2)
    looked_up = len(seen)
    (again,) = G.sample(vocab, [text], [3], 2)
    assert looked_up and len(seen) == looked_up
    assert [(p[0].tolist(), p[1:]) for p in first] == [(p[0].tolist(), p[1:]) for p in again]


@pytest.mark.parametrize("kept", [0, 40, 400, 4000])
def test_kept_words_do_not_matter(monkeypatch, kept):
    """Whatever is kept of earlier words, samples are those of a new worker, and memory is bounded."""
    monkeypatch.setattr(G, "KEPT_EDGES", kept)
    used = G.Vocabulary(MODEL)
    texts = [f"w{i} thor the\n\n\nof {'ab' * (i % 9)} {i}x{i} \x00  é中 the thor \n▁{i % 4}" for i in range(60)] + ["\n\n", "x" * 500, "", "the thor " * 20, "\n"]
    dropped = False
    for i in range(0, len(texts), 5):
        known = len(used.lattice.codes)
        got = G.sample(used, texts[i : i + 5], list(range(i, i + 5)), 3)
        dropped |= len(used.lattice.codes) < known
        assert used.lattice.edges <= kept and len(used.lattice.piece) <= 2 * kept + 1
        new = G.Vocabulary.__new__(G.Vocabulary)
        new.__dict__.update(used.__dict__, lattice=None)
        new.lattice = G.Lattice(new)
        for own, text, row in zip(got, texts[i : i + 5], G.sample(new, texts[i : i + 5], list(range(i, i + 5)), 3), strict=True):
            assert [p[0].tolist() for p in own] == [p[0].tolist() for p in row] and np.allclose([p[1:] for p in own], [p[1:] for p in row])
            assert all(used.decode(G.expand(used, p[0])) == text.encode() for p in own)
    assert dropped or kept in (0, 4000)


def test_memory_of_a_worker():
    """Two workers and their executor's JVM share its memory: a worker full of different words takes little of it."""
    letters = np.random.default_rng(1).integers(97, 123, (10, 40_000, 7), np.uint8)
    texts = [" ".join(w.tobytes().decode() for w in words) for words in letters]
    G.Vocabulary.get(MODEL, 0.9)
    tracemalloc.start()
    try:
        out = [b.num_rows for b in G._run(MODEL, 2, 0.9, 11)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": texts})]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(out) == 20 and peak < 260e6, peak


def test_awkward_rows(awkward, nothing):
    rows = G.segment(awkward, MODEL, samples=2).collect()
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in rows)
    by = Counter((r.doc_id, r.sample) for r in rows)
    assert by[3, 1] == by[4, 1] == 1 and by[3, 2] == by[4, 2] == 0 and by[1, 1] == by[1, 2] == 2 and by[None, 1] == 2
    assert len({tuple(r.pieces) for r in rows if r.doc_id == 1 and r.sample == 1}) == 1
    assert G.segment(nothing, MODEL).count() == 0
