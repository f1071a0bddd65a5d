"""A quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are indicators of n-grams, hashed to ``DIM`` places: its words, and one to three successive word shapes. A
shape keeps a word's digits, punctuation and case as runs (``Thre***`` is ``Aa***``) and whether the three words that begin there
occurred before in the text. The vector is divided by the root of the number of its n-grams, so long texts don't weigh
more, and scaled by the log-count ratios of the two classes. A linear hinge-loss model on it is fitted by dual coordinate descent;
a sigmoid, fitted on margins of rows that a first fit left out, maps margins to (0, 1).

The model is fitted on at most ``sample`` labelled texts (whole ones, at most ``features`` indicators in all), those with the smallest
hash of doc_id, so its cost doesn't grow; every whole text is scored. Only the text is an input.

Defined cases: a null or empty text has no n-grams and gets the bias's score; null doc_ids are scored, never learnt from; a doc_id
labelled twice counts with its smaller label; without labels of both classes the score is the share of label 1 (0.5
without labels); repeated rows get the same score; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relspark.llm.common import by_place, checkpoint, named_again, placed, spread
from relspark.llm.units import byte_chunks, release, worker_cache

BITS = 18
DIM = 1 << BITS
SAMPLE = 10_000
#: Indicators that the sampled rows may have in all; rows are taken in order of hash up to this bound.
SAMPLE_FEATURES = 40_000_000
EPOCHS = 12
COST = 1.0
SMOOTH = 1.0
KEPT_WORDS = 200_000
#: Bytes of texts handled at a time; it bounds memory, not results.
CHUNK_BYTES = 1_500_000
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEATS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    def run(m: re.Match) -> str:
        s = m[0]
        return "a" if s.islower() else "A" if s.isupper() else "Aa" if s[:1].isupper() and s[1:].islower() else "x"

    return _REPEATS.sub(r"\1\1", re.sub(r"\d+", "0", _LETTERS.sub(run, word)))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class _Words(dict):
    """word -> number, with the hashes of the word and its shape by number."""

    def __init__(self):
        super().__init__()
        self.new: list[tuple[int, int]] = []
        self.done = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append((_hash(word), _hash(shape(word))))
        return n

    def hashes(self) -> np.ndarray:
        if self.new:
            self.done = np.concatenate([self.done, np.array(self.new, np.uint64)])
            self.new = []
        return self.done


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each indicator, sorted, each once."""
    cache = worker_cache("quality")
    words: _Words = cache.get("words")
    if words is None or len(words) > KEPT_WORDS:
        words = cache["words"] = _Words()
    flat: list[str] = []
    n = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        flat += own
        n[i] = len(own)
    codes = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes()[codes]
    word, form = h[:, 0], h[:, 1]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    # Three words that occurred before in the same text.
    seen = np.zeros(len(word), np.uint64)
    if len(word) >= 3:
        same = np.flatnonzero(doc[2:] == doc[:-2])
        three = _mix(doc[same], word[same], word[same + 1], word[same + 2])
        order = np.argsort(three, kind="stable")
        again = order[1:][three[order][1:] == three[order][:-1]]
        seen[same[again]] = 1
    token = _mix(form, seen)
    found = [(doc, word), (doc, _mix(token, np.uint64(1) + np.zeros_like(token)))]
    for k in (2, 3):
        if len(token) >= k:
            same = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
            found.append((doc[same], _mix(*[token[same + j] for j in range(k)])))
    keys = np.concatenate([(d << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for d, h in found])
    keys = np.unique(keys).astype(np.int64)
    return keys >> BITS, keys & (DIM - 1)


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights per place (the log-count ratios included) and bias. ``rows``: the places of each text; ``y``: 1 or 0."""
    counts = [np.full(DIM, SMOOTH), np.full(DIM, SMOOTH)]
    for places, label in zip(rows, y.tolist(), strict=True):
        counts[label][places] += 1
    known = counts[0] + counts[1] > 2 * SMOOTH
    ratio = np.where(known, np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())), 0.0)
    sign = np.where(y == 1, 1.0, -1.0)
    # Both classes weigh the same in all.
    most = cost * len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))[y]
    values = [ratio[p] / np.sqrt(max(len(p), 1)) for p in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, p = values[i], rows[i]
            gradient = sign[i] * (w[p] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[p] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * ratio, bias


def margins(rows: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[p].sum() / np.sqrt(max(len(p), 1)) + bias for p in rows])


def sigmoid_of(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, the classes weighing the same, by Newton's method; the slope stays positive."""
    a, b = 1.0, 0.0
    weight = (len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1)))[y]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(weight * (p - y) * m).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        r = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(r * m * m).sum() + 1e-2, (r * m).sum()], [(r * m).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], y: np.ndarray, **how) -> dict:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return {"w": np.zeros(DIM, np.float32), "bias": 0.0, "a": 1.0, "b": float(np.log(share / (1 - share)))}
    out = np.arange(len(y)) % 5 == 0
    if len(set(y[~out].tolist())) == 2 and len(set(y[out].tolist())) == 2:
        w, bias = fit([r for r, o in zip(rows, out, strict=True) if not o], y[~out], **how)
        a, b = sigmoid_of(margins([r for r, o in zip(rows, out, strict=True) if o], w, bias), y[out])
    else:
        a, b = 2.0, 0.0
    w, bias = fit(rows, y, **how)
    return {"w": w.astype(np.float32), "bias": float(bias), "a": a, "b": b}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _featurizer(batches):
    for batch in batches:
        for i, j in byte_chunks(batch.column("text"), CHUNK_BYTES):
            doc, place = features(["" if t is None else t for t in batch.column("text")[i:j].to_pylist()])
            ends = np.searchsorted(doc, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("draw", "doc_id", "th", "quality")], lists], names=["draw", "doc_id", "th", "quality", "places"])
            release()


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, features: int = SAMPLE_FEATURES, **how) -> dict:
    """Fit on at most ``sample`` labelled texts, and as many as have ``features`` indicators in all (one at least), that aren't held out.

    The sample is drawn by ids and hashes alone; its texts are read where they are, and only their indicators, which ``features`` bounds, leave the executors.
    Rows with equal doc_id and text count once.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    draw = F.xxhash64(F.lit(17), "doc_id")
    own = F.struct("draw", "doc_id", "th")
    known = F.broadcast(known.select("doc_id", "quality", draw.alias("draw")).orderBy("draw", "doc_id").limit(sample))
    texts = spread(docs.select("doc_id", "text")).join(known, "doc_id").withColumn("th", F.xxhash64("text"))
    rows = texts.select("draw", "doc_id", "th", "quality", "text").mapInArrow(_featurizer, "draw long, doc_id long, th long, quality int, places array<int>")
    rows = checkpoint(rows.groupBy("draw", "doc_id", "th").agg(F.first("quality").alias("quality"), F.first("places").alias("places")))
    sizes = [(tuple(r[0]), r[1]) for r in rows.select(own.alias("own"), F.size("places")).orderBy("own").limit(sample).collect()]
    within = max(int(np.searchsorted(np.cumsum([n for _, n in sizes]), features, "right")), 1)
    if sizes:
        last = sizes[min(within, len(sizes)) - 1][0]
        rows = rows.filter(own <= F.struct(*[F.lit(x).cast("long") for x in last]))
    got = rows.toArrow()
    order = np.lexsort([np.asarray(got.column(c).combine_chunks()) for c in ("th", "doc_id", "draw")])
    y = np.asarray(got.column("quality").combine_chunks())[order].astype(np.int64)
    lists = got.column("places").combine_chunks()
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    return train([flat[ends[i] : ends[i + 1]] for i in order], (y > 0).astype(np.int64), **how)


def _scorer(model: dict, at: int, name: str):
    def run(batches):
        for batch in batches:
            for i, j in byte_chunks(batch.column(at), CHUNK_BYTES):
                doc, place = features(["" if t is None else t for t in batch.column(at)[i:j].to_pylist()])
                n = np.bincount(doc, minlength=j - i)
                m = np.bincount(doc, weights=model["w"][place].astype(np.float64), minlength=j - i) / np.sqrt(np.maximum(n, 1)) + model["bias"]
                score = 1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])
                release()

    return run


def with_scores(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` of scores; it has no column of that name so far."""
    from pyspark.sql import types as T

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(name, T.DoubleType())])
    return spread(docs).mapInArrow(_scorer(model, docs.columns.index(text), name), schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = with_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The rows that the model doesn't reject, unchanged, whatever their columns' names."""
    return named_again(with_scores(by_place(docs), model, placed(docs, "text")).filter("score >= 0.5"), docs)
