"""N-gram Jaccard self-join by chosen paths, and the near-duplicate groups that its links make.

A text's set holds its runs of five successive words (case and punctuation aside), hashed to 32 bits; a shorter text is one run.
Two texts link if the Jaccard similarity of their sets is at least 0.8.

1. Equal sets are one class; from here on only classes are compared. A class is known by its 128 smallest hashes (its sketch).
2. Chosen paths: each class follows the sampled tokens of its sketch, those whose hash lies below RUNS / (BASE * size). These are ``RUNS``
   repetitions at once, and the only draw: a linked pair shares no sampled token with probability below
   exp(-RUNS * 0.8 / BASE) < 2e-6. A bucket holds the classes that follow one token. Buckets of at most ``LEAF`` classes are compared by
   brute force. The classes of larger ones are divided without loss: two that share a token which at most ``RARE`` of them have are
   compared in the bucket of the rarest one; two that share none can be a possible link only if common tokens are at least ``POSSIBLE`` of
   both their sketches, and such classes are compared in pairs of blocks, all blocks that meet in a larger bucket. So 2e-6 holds for all buckets, whatever
   their size. Besides, comparing sketches (``POSSIBLE``) can miss a pair of sets larger than sketches: by the binomial tail with probability
   1e-4 at worst, for a set with exactly 0.8 of the tokens of another that holds it all. Comparing sketches leaves a spanning forest of possible links, never all pairs.
   The recall is measured, too: ``PROBES`` classes are compared with all classes, and runs with other draws are added until a share ``RECALL`` of their possible links is found.
3. Components of possible links (star contraction on DataFrames) are candidates. Their whole sets are read again and compared
   exactly, in pairs of blocks; each comparison gives counts of links and a spanning forest of the true links.

So the result has each document's class and number of links; no list of pairs exists anywhere, and no group is held in one
task. Sets are compared by 32-bit hashes, which can change a similarity by about 1e-6.

Defined cases: null and empty texts have the empty set and link with each other only; repeated rows link; a null doc_id is no class id
unless all of a group's are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relspark.llm.common import by_place, checkpoint, fresh_path, maybe_broadcast, named_again, placed, spread
from relspark.llm.units import byte_chunks, gather, release, worker_cache

NGRAM, SIMILARITY = 5, 0.8
SKETCH = 128
RUNS, BASE = 12, 0.7
#: Classes of a bucket of a sampled token, of a bucket of a rare token, and of a block.
LEAF, RARE, HOME = 96, 512, 1024
#: Classes of a component, and bytes of their whole sets, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Share of the larger sketch that two sketches must have in common to be a possible link; linked sets share 0.8 at least, give or take 0.035.
POSSIBLE = 0.66
#: After the runs, links of ``PROBES`` classes with all others are looked up; runs are added until a share ``RECALL`` of them is found.
PROBES, RECALL, MOST_RUNS = 256, 0.999, 10
#: Tasks for components, and edges that make one more.
LEAST_TASKS, TASK_EDGES = 8, 250_000
KEPT_WORDS = 200_000
#: Groups of more classes give memory back when they are done.
RELEASE = 200
#: Bytes of texts handled at a time; it bounds memory, not results.
CHUNK_BYTES = 1_500_000


class _Words(dict):
    """word -> number; ``hashes`` by number, of letters and digits in lower case (of the word itself if it has none)."""

    def __init__(self):
        super().__init__()
        self.new: list[int] = []
        self.done = np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        import xxhash

        low = word.lower()
        bare = low if low.isalnum() else "".join(filter(str.isalnum, low)) or low
        n = self[word] = len(self)
        self.new.append(xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")))
        return n

    def hashes(self) -> np.ndarray:
        if self.new:
            self.done = np.concatenate([self.done, np.array(self.new, np.uint64)])
            self.new = []
        return self.done


def sets_of(texts: list[str], ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(ends of each text's tokens, sorted unsigned 32-bit tokens of all texts, each once in its text)."""
    cache = worker_cache("shingles")
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
    h = words.hashes()[codes] if len(codes) else np.zeros(0, np.uint64)
    # Padding after each text, so that each has its runs only.
    at = np.arange(len(h)) + np.repeat(np.arange(len(texts)), n) * (ngram - 1)
    padded = np.zeros(len(h) + len(texts) * (ngram - 1), np.uint64)
    padded[at] = h
    runs = np.maximum(n - (ngram - 1), np.minimum(n, 1))
    first = np.cumsum(n + ngram - 1) - (n + ngram - 1)
    place = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    mixed = np.zeros(len(place), np.uint64)
    for k in range(ngram):
        mixed = (mixed ^ padded[place + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), runs)
    keys = np.unique((doc << np.uint64(32)) | (mixed >> np.uint64(32)))
    ends = np.searchsorted(keys, (np.arange(1, len(texts) + 1, dtype=np.uint64)) << np.uint64(32))
    return ends, keys.astype(np.uint32)


def _texts(batch):
    for i, j in byte_chunks(batch.column("text"), CHUNK_BYTES):
        yield i, j, ["" if t is None else t for t in batch.column("text")[i:j].to_pylist()]
        release()


def _sketches(batches):
    import xxhash

    for batch in batches:
        for i, j, texts in _texts(batch):
            ends, tokens = sets_of(texts)
            starts = np.concatenate([[0], ends[:-1]])
            n = ends - starts
            sig = np.array([xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
            k = np.minimum(n, SKETCH)
            at = np.repeat(starts - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), pa.array(tokens[at].view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("th")[i:j], pa.array(sig), pa.array(n), lists], names=["doc_id", "th", "sig", "n", "sketch"])


def _sets(batches):
    for batch in batches:
        for i, j, texts in _texts(batch):
            ends, tokens = sets_of(texts)
            starts = np.concatenate([[0], ends[:-1]])
            data = pa.array([tokens[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("sig", "comp", "blocks", "copies")], data], names=["sig", "comp", "blocks", "copies", "tokens"])


def common_counts(lists: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Tokens that each two lists have in common. Tokens of one list alone count only on the diagonal; columns go by ``width``."""
    m = len(lists)
    sizes = np.array([len(x) for x in lists])
    out = np.zeros((m, m), np.float32)
    if sizes.sum():
        owner = np.repeat(np.arange(m), sizes)
        _, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        shared = count[place] > 1
        owner, place = owner[shared], column[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        total = int(column[-1]) + 1
        for a in range(0, total, width):
            i, j = np.searchsorted(place, [a, a + width])
            block = np.zeros((m, min(width, total - a)), np.float32)
            block[owner[i:j], place[i:j] - a] = 1
            out += block @ block.T
    np.fill_diagonal(out, sizes)
    return out


def forest(near: np.ndarray) -> np.ndarray:
    """For each place, the first place of its component of the symmetric matrix ``near``."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            todo = np.zeros(len(near), bool)
            todo[i] = True
            while todo.any():
                root[todo] = i
                todo = near[todo].any(axis=0) & (root < 0)
    return root


def _possible(key, table):
    """Star edges of possible links in a bucket or in two blocks of one."""
    sig, n = np.asarray(table.column("sig")), np.asarray(table.column("n"))
    order = np.argsort(sig, kind="stable")
    order = order[np.concatenate([[True], sig[order][1:] != sig[order][:-1]])]
    sig, n = sig[order], n[order]
    lists = table.column("sketch").combine_chunks()
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    both = common_counts([flat[ends[i] : ends[i + 1]] for i in order])
    large = np.maximum(n[:, None], n[None, :])
    near = (both >= POSSIBLE * np.minimum(large, SKETCH)) & (np.minimum(n[:, None], n[None, :]) >= SIMILARITY * large)
    root = forest(near)
    hit = np.flatnonzero(root != np.arange(len(root)))
    del both, near
    if len(root) > RELEASE:
        release()
    return pa.table({"a": sig[root[hit]], "b": sig[hit]})


def _exact(key, table):
    """In two blocks of a component (or one): links of each class with the other block's documents, and a star forest of links."""
    comp, bi, bj = (k.as_py() for k in key)
    block = np.asarray(table.column("block"))
    sig, first = np.unique(np.asarray(table.column("sig")), return_index=True)
    block, copies = block[first], np.asarray(table.column("copies"))[first]
    data = table.column("tokens")
    both = common_counts([np.frombuffer(data[int(i)].as_buffer(), np.uint32) for i in first])
    n = np.diag(both)
    union = n[:, None] + n[None, :] - both
    near = both >= SIMILARITY * union - 1e-6
    np.fill_diagonal(near, False)
    root = forest(near)
    # Pairs within a block count where the block meets itself.
    counted = near & ((block[:, None] != block[None, :]) if bi != bj else True)
    links = counted @ copies
    del both, union, near, counted
    if len(root) > RELEASE:
        release()
    return pa.table({"sig": sig, "root": sig[root], "links": links.astype(np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of undirected ``edges`` a, b, by alternating stars (large star, small star).

    Each round points every node's larger neighbours, then its smaller ones, to its smallest neighbour, and adds no edges; rounds
    number as the logarithm of the nodes. Tasks follow the number of edges, so that small graphs don't leave thousands of tiny files each round.
    """
    edges = checkpoint(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, rows = None, edges.count()
    while True:
        tasks = max(LEAST_TASKS, rows // TASK_EDGES)
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").coalesce(tasks).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpoint(small.coalesce(tasks))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    roots = edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))


def _prober(sample: list[tuple[int, int, np.ndarray]]):
    """For each class the places in ``sample`` (sig, n, sketch) of the others that it possibly links with."""
    sizes = np.array([n for _, n, _ in sample])
    tokens = np.concatenate([t for _, _, t in sample])
    owner = np.repeat(np.arange(len(sample)), [len(t) for _, _, t in sample])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sigs = {s: i for i, (s, _, _) in enumerate(sample)}

    def run(batches):
        for batch in batches:
            sig, n, lists = np.asarray(batch.column("sig")), np.asarray(batch.column("n")), batch.column("sketch")
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            flat = flat[ends[0] : ends[-1]]
            row = np.repeat(np.arange(len(sig)), np.diff(ends))
            a, b = np.searchsorted(tokens, flat, "left"), np.searchsorted(tokens, flat, "right")
            hit = np.flatnonzero(b > a)
            pair = np.repeat(row[hit] * len(sample), (b - a)[hit]) + owner[gather(a[hit], (b - a)[hit])]
            pair, both = np.unique(pair, return_counts=True)
            row, asked = pair // len(sample), pair % len(sample)
            large = np.maximum(n[row], sizes[asked])
            near = (both >= POSSIBLE * np.minimum(large, SKETCH)) & (np.minimum(n[row], sizes[asked]) >= SIMILARITY * large)
            near &= np.array([sigs.get(s, -1) for s in sig.tolist()], np.int64)[row] != asked
            row, asked = row[near], asked[near]
            count = np.bincount(row, minlength=len(sig))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(asked.astype(np.int32)))
            some = pa.array(count > 0)
            yield pa.RecordBatch.from_arrays([batch.column("sig").filter(some), out.filter(some)], names=["sig", "asked"])

    return run


def measured_recall(classes: DataFrame, comps: DataFrame, sample: int = PROBES) -> float:
    """Share of the possible links of ``sample`` classes (those of smallest hash) that ``comps`` (node, comp) holds in one component; found by comparing the sample with all classes."""
    drawn = classes.filter("n > 0").orderBy(F.xxhash64(F.lit(9), "sig"), "sig").limit(sample).select("sig", "n", "sketch").collect()
    if not drawn:
        return 1.0
    hits = classes.select("sig", "n", "sketch").mapInArrow(_prober([(r.sig, r.n, np.array(r.sketch, np.int32)) for r in drawn]), "sig long, asked array<int>")
    asked = classes.sparkSession.createDataFrame([(i, r.sig) for i, r in enumerate(drawn)], "i int, node long").join(comps, "node")
    own = asked.groupBy("comp").agg(F.collect_set("i").alias("own"))
    found = hits.join(comps, hits.sig == comps.node, "left").select("comp", "asked").join(F.broadcast(own), "comp", "left")
    total, hit = found.agg(F.sum(F.size("asked")), F.sum(F.size(F.array_intersect("asked", F.coalesce("own", F.array().cast("array<int>")))))).first()
    return hit / total if total else 1.0


def _bucket_edges(classes: DataFrame, seed: int = 0) -> DataFrame:
    """Possible links (a, b) from the buckets of sampled tokens over ``classes`` (sig, n, sketch)."""
    unit = lambda *parts: F.xxhash64(*parts).cast("double") / F.lit(float(1 << 64)) + 0.5
    size = F.greatest(F.size("sketch"), F.lit(1))
    chosen = F.explode(F.filter("sketch", lambda t: unit(F.lit(seed), t) < F.lit(RUNS / BASE) / size))
    level = checkpoint(classes.filter("n > 0").select("sig", "n", chosen.alias("t")).select(F.xxhash64(F.lit(1), "t").alias("path"), "sig", "n"))
    sketches = classes.select("sig", "sketch")

    def sizes(rows: DataFrame) -> DataFrame:
        return checkpoint(rows.groupBy("path").agg(F.count("*").alias("m"), F.sum(F.xxhash64("sig").cast("decimal(20,0)")).alias("who")).filter("m > 1"))

    def distinct(counts: DataFrame) -> DataFrame:
        """Buckets with the same members are one, as all pairs of each are compared."""
        return counts.groupBy("who", "m").agg(F.min("path").alias("path")).select("path", "m")

    def leaves(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
        small = distinct(counts.filter(F.col("m") <= most)).select("path")
        return rows.join(small, "path").join(sketches, "sig").groupBy("path").applyInArrow(_possible, "a long, b long")

    counts = sizes(level)
    edges = leaves(level, counts, LEAF)
    large = counts.filter(F.col("m") > LEAF).select("path")
    if large.isEmpty():
        return edges
    held = checkpoint(level.join(maybe_broadcast(large), "path"))
    # Tokens of the classes in larger buckets, rarest first. Two classes that share ``need`` tokens have the first of these among the
    # first size - need + 1 of both; tokens of one class alone come before ``shared``.
    tokens = held.select("sig").distinct().join(sketches, "sig").select("sig", F.size("sketch").alias("size"), F.explode("sketch").alias("t"))
    often = checkpoint(tokens.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1"))
    shared = tokens.join(maybe_broadcast(often), "t").groupBy("sig").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "t"))).alias("shared"))
    shared = shared.withColumn("need", F.ceil(F.lit(POSSIBLE) * F.col("size")).cast("int")).withColumn("rare", F.filter("shared", lambda x: x.c <= RARE))
    shared = checkpoint(shared.filter(F.size("shared") >= F.col("need")))
    first = F.slice("rare", F.lit(1), F.size("shared") - F.col("need") + 1)
    rows = checkpoint(shared.select("sig", F.explode(first.getField("t")).alias("t")).select(F.xxhash64(F.lit(2), "t").alias("path"), "sig"))
    edges = edges.union(leaves(rows.join(classes.select("sig", "n"), "sig"), sizes(rows), RARE))
    # Pairs that share no rare token: classes with enough common ones, within the larger buckets. Each class is in one block, of its largest
    # bucket, and blocks that meet in a bucket are compared once.
    held = checkpoint(held.join(shared.filter(F.size("shared") - F.size("rare") >= F.col("need")).select("sig"), "sig"))
    counts = held.groupBy("path").agg(F.count("*").alias("m"))
    home = held.join(maybe_broadcast(counts), "path").groupBy("sig").agg(F.first("n").alias("n"), F.max(F.struct("m", "path")).alias("home")).select("sig", "n", F.col("home.path").alias("home"))
    blocks = home.groupBy("home").agg(F.ceil(F.count("*") / HOME).alias("blocks"))
    home = checkpoint(home.join(maybe_broadcast(blocks), "home").select("sig", "n", F.xxhash64("home", F.pmod(F.xxhash64(F.lit(5), "sig"), F.col("blocks"))).alias("block")))
    at = checkpoint(held.select("path", "sig").join(home.select("sig", "block"), "sig").select("path", "block").distinct())
    pairs = checkpoint(at.select("path", F.col("block").alias("bi")).join(at.select("path", F.col("block").alias("bj")), "path").filter("bi <= bj").select("bi", "bj").distinct())
    ends = pairs.select(F.col("bi").alias("block"), "bi", "bj").union(pairs.filter("bi < bj").select(F.col("bj").alias("block"), "bi", "bj"))
    rows = home.join(ends, "block").join(sketches, "sig")
    return edges.union(rows.groupBy("bi", "bj").applyInArrow(_possible, "a long, b long"))


def _pair_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Each row once for each pair of blocks (bi <= bj) that its block is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("_o", other).withColumn("bi", F.least("block", "_o")).withColumn("bj", F.greatest("block", "_o")).drop("_o")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (xxhash64 of the text), comp (number of its group), class_id (smallest doc_id of its group) and n_links (documents linked with it)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    path = fresh_path(spark, "sketches")
    spread(base).mapInArrow(_sketches, "doc_id long, th long, sig long, n long, sketch array<int>").write.parquet(path)
    rows = spark.read.schema("doc_id long, th long, sig long, n long, sketch array<int>").parquet(path)
    one = F.struct("doc_id", "th")
    classes = rows.groupBy("sig").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min(one).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = checkpoint(classes)
    comps = checkpoint(components(_bucket_edges(classes)))
    # Runs with other draws are added until the links of a sample are found, but for 1 - ``RECALL``.
    for more in range(1, MOST_RUNS):
        if measured_recall(classes, comps) >= RECALL:
            break
        edges = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(_bucket_edges(classes, 10 * more))
        comps = checkpoint(components(edges))
    wanted = comps.withColumnRenamed("node", "sig").join(classes.select("sig", "copies", "one", "n"), "sig")
    wanted = checkpoint(wanted.select("sig", "comp", "n", "copies", F.col("one.doc_id").alias("doc_id"), F.col("one.th").alias("th")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(4 * F.sum("n") / BLOCK_BYTES)).cast("int")
    wanted = wanted.join(wanted.groupBy("comp").agg(blocks.alias("blocks")), "comp")
    same = base.alias("d").join(maybe_broadcast(wanted).alias("w"), F.expr("d.th = w.th AND d.doc_id <=> w.doc_id"))
    path = fresh_path(spark, "sets")
    same.select("w.sig", "w.comp", "w.blocks", "w.copies", "d.text").mapInArrow(_sets, "sig long, comp long, blocks int, copies long, tokens binary").write.parquet(path)
    sets = spark.read.schema("sig long, comp long, blocks int, copies long, tokens binary").parquet(path)
    sets = sets.withColumn("block", F.pmod(F.xxhash64(F.lit(6), "sig"), F.col("blocks")).cast("int"))
    found = _pair_blocks(sets, "comp").select("comp", "bi", "bj", "sig", "block", "copies", "tokens").groupBy("comp", "bi", "bj").applyInArrow(_exact, "sig long, root long, links long")
    found = checkpoint(found)
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("root").alias("a"), F.col("sig").alias("b"))).withColumnRenamed("node", "sig")
    reps = groups.join(classes.select("sig", "rep"), "sig")
    smallest = reps.groupBy("comp").agg(F.min("rep").alias("smallest"))
    grouped = groups.join(smallest, "comp").join(links, "sig").select("sig", "comp", "smallest", "links")
    by_class = classes.select("sig", "copies", "rep").join(grouped, "sig", "left")
    by_class = by_class.select("sig", F.coalesce("comp", "sig").alias("comp"), F.coalesce("smallest", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "rep").isNull().alias("_no_id"))
    return rows.select("doc_id", "th", "sig").join(checkpoint(by_class), "sig").select("doc_id", "th", "comp", "class_id", "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest doc_id (null last; then the smallest hash of text), with all its columns, whatever their names."""
    near = checkpoint(near_duplicates(docs))
    key = F.when(F.col("class_id").isNull(), F.concat(F.lit("s"), F.col("comp").cast("string"))).otherwise(F.col("class_id").cast("string"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = near.groupBy(key.alias("g")).agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"))
    many = near.groupBy("doc_id", "th").count().filter("count > 1")
    doc_id, text = placed(docs, "doc_id"), placed(docs, "text")
    d = by_place(docs).withColumn("_own", F.xxhash64(text))
    out = d.join(kept, (F.col("_own") == F.col("_th")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_id")), "left_semi")
    if not many.isEmpty():
        out = out.dropDuplicates([doc_id, "_own"])
    return named_again(out, docs)
