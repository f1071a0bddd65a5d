"""SentencePiece segmentations sampled without replacement: Gumbel top-k by perturbed A* search over the lattice.

The vocabulary file gives pieces and ranks; a piece's probability is taken as proportional to 1 / (rank + ``FLAT``) ** alpha, and a
segmentation's to the product of its pieces'. (The file has no probabilities; nothing is trained.) A character that is no
piece is written in byte pieces.

Searching the lattice of a whole text: a state is a prefix of a segmentation; its weight, the sum over all completions, is
known exactly from the backward sums, so the perturbed search never turns back. The first path is the lattice sampled
forward; at each of its steps the states beside it get one perturbed value for all of them, drawn below the path's own
(a truncated Gumbel at their total weight). The best such value names the step at which the next path leaves, and so on: the
paths come in the order of their perturbed values, all distinct, and only k + 1 values are kept. The value after the last path is
the threshold of the inclusion probabilities 1 - exp(-exp(log_prob - threshold)).

No piece crosses the border from a visible character to a blank, or a line feed, so a text's lattice is a chain of its
words' lattices; equal words share one, which a worker keeps for later texts while there is room. Draws are hashes of the row key
(doc_id), path, word and step, so they don't depend on the batch, and rows with equal keys and texts agree.

Defined cases: a null or empty text has one segmentation, without pieces; a text with fewer than k segmentations has as many rows,
with inclusion 1; null doc_ids have one key; texts with the blank mark itself keep it, as bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from relspark.llm.common import spread
from relspark.llm.units import byte_chunks, gather, release, strings, worker_cache

SAMPLES = 2
ALPHA = 1.0
FLAT = 10.0
BLANK = "▁"
#: A blank mark that the text itself has gets this number, which is no character's; a blank gets the mark's.
OWN_BLANK = 0x110000
RAW = "\x00"
FAR = -1e300
#: Bytes of texts handled at a time; it bounds memory, not results.
CHUNK_BYTES = 300_000
#: Edges of words' lattices kept for the next texts, 4 bytes each and 16 for each character; it bounds memory, not results.
KEPT_EDGES = 5_000_000
#: New words whose lattices are made at a time; it bounds memory, not results.
NEW_WORDS = 10_000
TINY = 1e-300
SCHEMA = "doc_id long, sample int, n_pieces int, log_prob double, perturbed double, inclusion double, round_trip boolean, pieces array<int>"
_WORD = re.compile(r" *[^ ]+| +$")
#: Texts that ``cut`` must see: empty ones, and blanks that begin, end or follow each other.
CAREFUL = r"^$|^ | $|  |\x{00}"


def cut(text: str) -> list[str]:
    """Keys of the words of a non-empty text: a word without its first blank, or RAW and the word as it is (it has no blank first, or RAW after it)."""
    if RAW not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.replace("\n", " \n \x00").split(" ")
    keys = []
    for i, line in enumerate((" " + text).split("\n")):
        keys += ["\n"] * bool(i)
        keys += [w[1:] if w[0] == " " and w[1:2] != RAW else RAW + w for w in _WORD.findall(line)]
    return keys


class _Codes(dict):
    """word -> number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts (keys as ``cut`` gives them), the place in this list of each word, and the words of each text. Arrow cuts what only blanks and line feeds divide."""
    column = pa.array(texts, pa.string())
    odd = np.asarray(pc.match_substring_regex(column, CAREFUL))
    lists = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~odd)), "\n", f" \n {RAW}"), " ")
    coded = lists.flatten().dictionary_encode()
    words = strings(coded.dictionary)
    n = np.zeros(len(texts), np.int64)
    n[~odd] = np.asarray(pc.list_value_length(lists))
    code, own = _Codes(zip(words, range(len(words)), strict=True)) if odd.any() else {}, {}
    for i in np.flatnonzero(odd).tolist():
        own[i] = [code[w] for w in cut(texts[i])] if texts[i] else []
        n[i] = len(own[i])
    start = np.cumsum(n) - n
    codes = np.empty(int(n.sum()), np.int64)
    codes[gather(start[~odd], n[~odd])] = np.asarray(coded.indices)
    for i, found in own.items():
        codes[start[i] : start[i] + n[i]] = found
    return list(code) or words, codes, n


class Table:
    """Numbers by 64-bit hashes: an open-addressing table a quarter full, probed for all keys at once."""

    FREE = -2

    def __init__(self, items: dict[int, int]):
        self.shift = np.uint64(64 - max(4, (4 * len(items)).bit_length()))
        self.mask = (1 << int(np.uint64(64) - self.shift)) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.values = np.full(self.mask + 1, self.FREE, np.int32)
        for h, value in items.items():
            at = int(self._place(np.array([h], np.uint64))[0])
            while self.values[at] != self.FREE:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = h, value

    def _place(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, FREE where there is none."""
        at = self._place(h)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != h) & (out != self.FREE))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            own = at[todo]
            out[todo] = self.values[own]
            todo = todo[(self.keys[own] != h[todo]) & (out[todo] != self.FREE)]
        return out


class Vocabulary:
    """Pieces by the hashes of their prefixes."""

    B = np.uint64(0x100000001B3)

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        rank = -np.array([sp.get_score(i) for i in range(n)])
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = np.where(rank > 1e8, 0, rank)
        weight = np.zeros(n)
        weight[usable] = 1 / (rank[usable] + FLAT) ** alpha
        self.score = np.full(n + 1, -1e3)
        self.score[usable] = np.log(weight[usable] / weight.sum())
        #: Of a character written in bytes: it has no other reading, so this weighs on nothing.
        self.score[n] = np.log(weight[usable].min() / weight.sum()) - 2
        #: Characters of each piece; of a character written in bytes: one.
        self.length = np.ones(n + 1, np.int64)
        self.byte = np.full(256, -1, np.int32)
        self.spelling: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte[value] = i
                self.spelling[i] = bytes([value])
        longest: dict[int, dict[int, int]] = {}
        for i in usable:
            piece = sp.id_to_piece(i)
            self.spelling[i] = piece.replace(BLANK, " ").encode()
            h = 0
            for k, c in enumerate(piece, 1):
                h = (h * int(self.B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                longest.setdefault(k, {}).setdefault(h, -1)
            longest[len(piece)][h] = i
            self.length[i] = len(piece)
        #: By length: prefixes' hashes, and the piece that each is, or -1.
        self.tables = [Table(longest[k]) for k in range(1, max(longest) + 1)]
        self.spellings = pa.array(self.spelling, pa.large_binary())
        #: Of the words seen so far.
        self.lattice = Lattice(self)

    @staticmethod
    def get(path: str, alpha: float) -> Vocabulary:
        cache = worker_cache("pieces")
        if (path, alpha) not in cache:
            cache[path, alpha] = Vocabulary(path, alpha)
            release()
        return cache[path, alpha]

    def bytes_of(self, char: int) -> list[int]:
        return self.byte[list((BLANK if char == OWN_BLANK else chr(char)).encode("utf-8", "surrogatepass"))].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of pieces as UTF-8, without the blank that encoding puts first."""
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The same for several texts, whose pieces follow each other."""
        _, ends, out = self.spellings.take(pa.array(ids)).buffers()
        ends = np.frombuffer(ends, np.int64)[np.concatenate([[0], np.cumsum(counts)])].tolist() if len(ids) else [0] * (len(counts) + 1)
        out = out.to_pybytes() if ends[-1] else b""
        return [out[a + (out[a : min(a + 1, b)] == b" ") : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Lattice:
    """The lattices of distinct words. A word's characters are nodes that follow each other, and its end is one more, without edges; a node's edges follow each other, too.
    An edge is its piece alone: where it leads and its probability are worked out when they are asked for, from the piece's length and score and from the nodes' backward sums.
    Words stay from call to call while there is room; then those that came often do. What a word's lattice holds doesn't depend on the others."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first, self.back = np.zeros(1, np.int64), np.zeros(0)
        self.piece = np.zeros(0, np.int32)
        self.root, self.length, self.hits = (np.zeros(0, np.int64) for _ in range(3))

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word (keys as ``cut`` gives them); new ones are added."""
        found = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found < 0)
        if len(at):
            new = [words[i] for i in at.tolist()]
            found[at] = np.arange(len(self.codes), len(self.codes) + len(new))
            self.codes.update(zip(new, found[at].tolist(), strict=True))
            for i in range(0, len(new), NEW_WORDS):
                self._add([w[1:] if w[:1] == RAW else w if w == "\n" else " " + w for w in new[i : i + NEW_WORDS]])
        return found

    def trim(self) -> None:
        """Keep at most KEPT_EDGES edges: when there are more, the words that came most often stay, with half as many."""
        if self.edges <= KEPT_EDGES:
            return
        size = self.first[self.root + self.length] - self.first[self.root]
        least = 2
        while size[self.hits >= least].sum() > KEPT_EDGES // 2:
            least *= 2
        keep = self.hits >= least
        if not keep.any():
            self.forget()
            return
        # Words lie in the order of their numbers, so what stays moves up.
        stay, edges = np.repeat(keep, self.length + 1), int(size[keep].sum())
        nodes = int(np.count_nonzero(stay))
        self.piece[:edges] = self.piece[: self.edges][np.repeat(keep, size)]
        self.back[:nodes] = self.back[: self.nodes][stay]
        np.cumsum(np.diff(self.first[: self.nodes + 1])[stay], out=self.first[1 : nodes + 1])
        self.nodes, self.edges = nodes, edges
        if len(self.piece) > 2 * KEPT_EDGES:
            self.piece, self.back, self.first = self.piece[:edges].copy(), self.back[:nodes].copy(), self.first[: nodes + 1].copy()
        words = list(self.codes)
        self.codes = {words[i]: n for n, i in enumerate(np.flatnonzero(keep).tolist())}
        self.length, self.hits = self.length[keep], self.hits[keep] // 2
        self.root = np.cumsum(self.length + 1) - self.length - 1

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        """Put values behind the used part of an array, which grows by halves."""
        old, need = getattr(self, name), used + len(values)
        if need > len(old):
            grown = np.empty(max(need, len(old) * 3 // 2), old.dtype)
            grown[:used] = old[:used]
            setattr(self, name, grown)
        getattr(self, name)[used:need] = values

    def _add(self, words: list[str]) -> None:
        vocab = self.vocab
        length = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars[chars == ord(BLANK)] = OWN_BLANK
        chars[chars == ord(" ")] = ord(BLANK)
        n = len(chars)
        ends = np.cumsum(length)
        left = np.repeat(ends, length) - np.arange(n)
        sources, pieces = [], []
        degree = np.zeros(n, np.int64)
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        for k, table in enumerate(vocab.tables, 1):
            if k > 1:
                long = np.flatnonzero(left[alive] >= k)
                alive, h = alive[long], h[long]
            if not len(alive):
                break
            h = h * vocab.B + chars[alive + (k - 1)] + np.uint64(1)
            piece = table.find(h)
            hit = np.flatnonzero(piece != Table.FREE)
            alive, piece, h = alive[hit], piece[hit], h[hit]
            real = np.flatnonzero(piece >= 0)
            src, piece = alive[real], piece[real]
            if k == 1:
                # Characters in bytes: vocab.size plus the character.
                single = vocab.size + chars.astype(np.int32)
                single[src] = piece
                src, piece = np.arange(n), single
            sources.append(src)
            pieces.append(piece)
            degree[src] += 1
        # Edges in order of their source, then length: each list has a source once, so edges go straight to their places.
        first = np.cumsum(degree) - degree
        total = int(degree.sum())
        target, piece = np.empty(total, np.int32), np.empty(total, np.int32)
        free = first.copy()
        for k, (src, found) in enumerate(zip(sources, pieces, strict=True), 1):
            at, to = free[src], src + k
            to[left[src] == k] = -1
            target[at], piece[at] = to, found
            free[src] = at + 1
        del sources, pieces, alive, h, free
        # From the words' ends backward: all nodes at one distance from an end at once.
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        size = degree[order]
        edges = gather(first[order], size)
        begin = np.cumsum(size) - size
        bounds = np.cumsum(np.bincount(left)) if n else np.zeros(1, np.int64)
        score = vocab.score.take(piece[edges], mode="clip")
        to = target[edges]
        back = np.zeros(n + 1)  # the last is the end's
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e0, e1 = int(begin[a]), int(begin[b]) if b < n else total
            value, at, own = score[e0:e1], begin[a:b] - e0, size[a:b]
            value += back[to[e0:e1]]
            top = np.maximum.reduceat(value, at)
            back[order[a:b]] = whole = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, own)), at))
            value -= np.repeat(whole, own)
        log_p = np.empty(total)
        # 0 says that there is no other edge.
        log_p[edges] = np.minimum(score, -TINY)
        del score, to, edges, order, begin, size
        log_p[first[degree == 1]] = 0.0
        # Each node's likeliest edge goes before its others, where a draw most often ends.
        best, most, node, j = first.copy(), log_p[first], np.flatnonzero(degree > 1), 1
        while len(node):
            at = first[node] + j
            value = log_p[at]
            more = np.flatnonzero(value > most[node])
            best[node[more]], most[node[more]] = at[more], value[more]
            j += 1
            node = node[degree[node] > j]
        moved = np.flatnonzero(best != first)
        one, other = first[moved], best[moved]
        piece[one], piece[other] = piece[other], piece[one]
        # Each word's end comes after its characters.
        number = np.arange(len(words))
        whole, at = np.zeros(n + len(words)), np.arange(n) + np.repeat(number, length)
        whole[at] = back[:n]
        after = np.zeros(n + len(words), np.int64)
        after[at] = degree
        self._append("piece", self.edges, piece)
        self._append("back", self.nodes, whole)
        self._append("first", self.nodes + 1, self.edges + np.cumsum(after))
        self.root = np.concatenate([self.root, self.nodes + ends - length + number])
        self.length = np.concatenate([self.length, length])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])
        self.nodes, self.edges = self.nodes + n + len(words), self.edges + total

    def source(self, edge: int) -> int:
        return int(np.searchsorted(self.first[: self.nodes + 1], edge, "right")) - 1

    def follow(self, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where edges of the nodes lead, and the logarithms of their probabilities if their nodes have others (else they are 0)."""
        # Characters in bytes, whose numbers are beyond the vocabulary, have its last entry.
        piece = self.piece.take(edge)
        to = self.vocab.length.take(piece, mode="clip")
        to += node
        log_p = self.vocab.score.take(piece, mode="clip")
        log_p += self.back.take(to)
        log_p -= self.back.take(node)
        # 0 says that there is no other edge.
        return to, np.minimum(log_p, -TINY, out=log_p)

    def descend(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward samples from the nodes to their words' ends: (edges of each, in order and joined, number of each, the edges' log probabilities)."""
        count = np.zeros(len(node), np.int64)
        edge, end = self.first[node], self.first[node + 1]
        at = np.flatnonzero(edge < end)
        node, key, edge, end = node[at], key[at], edge[at], end[at]
        steps = []
        s = 0
        while len(at):
            to, log_p = self.follow(node, edge)
            end -= 1
            log_p[edge == end] = 0.0
            u = draw(key, s)
            cum = np.exp(log_p)
            more = np.flatnonzero((u >= cum) & (edge < end))
            cum = cum[more]
            while len(more):
                edge[more] = beyond = edge[more] + 1
                to[more], log_p[more] = self.follow(node[more], beyond)
                cum += np.exp(log_p[more])
                go = np.flatnonzero((u[more] >= cum) & (beyond < end[more]))
                more, cum = more[go], cum[go]
            steps.append((at, edge, log_p))
            count[at] += 1
            edge, end = self.first.take(to), self.first.take(to + 1)
            go = np.flatnonzero(edge < end)
            at, node, key, edge, end = at[go], to[go], key[go], edge[go], end[go]
            s += 1
        start = np.cumsum(count) - count
        edges, logs = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()))
        for s, (at, edge, log_p) in enumerate(steps):
            where = start[at] + s
            edges[where], logs[where] = edge, log_p
        return edges, count, logs


_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


def draw(key: np.ndarray, step) -> np.ndarray:
    """Uniform in (0, 1) by key and step."""
    with np.errstate(over="ignore"):
        x = mix(key + (np.asarray(step).astype(np.uint64) + np.uint64(1)) * _C1)
    x = (x >> np.uint64(12)).astype(np.float64)
    x *= 2.0**-52
    x += 2.0**-53
    return x


def _below(bound, mu, u):
    """A Gumbel value at weight exp(mu), truncated at bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - mu)


def sample(vocab: Vocabulary, texts: list[str], keys: list[int], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples in order: (piece ids, log probability, perturbed log probability, inclusion probability)."""
    words, codes, n = words_of(texts)
    lat = vocab.lattice
    place = lat.places(words)
    lat.hits[place] += np.bincount(codes, minlength=len(words))
    root = lat.root[place][codes]
    last = np.cumsum(n)
    first = last - n
    row = np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64)
    word = (np.arange(len(root)) - np.repeat(first, n)).astype(np.uint64) * _C3
    doc = np.repeat(np.arange(len(texts)), n)
    row_of = np.repeat(row, n)

    def word_keys(path: int, occurrences: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((row_of[occurrences] + np.uint64(path) * _C2) ^ word[occurrences])

    with np.errstate(over="ignore"):
        doc_key = mix(row ^ _C1)
    # Per text: samples so far, and the pool of the best values beside them: (value, path, step, excluded edges, log prob before, occurrence).
    paths: list[list] = [[] for _ in texts]
    pools: list[list] = [[] for _ in texts]

    def beside(path: int, edges: np.ndarray, step: np.ndarray, occurrence: np.ndarray, sizes: np.ndarray, before: np.ndarray, bound: np.ndarray, shift: np.ndarray, most: int) -> np.ndarray:
        """Put the best values beside the given steps into the pools. Returns the log probability before each step and, last of all, of each path."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        lp = np.zeros(len(step) + 1)
        np.cumsum(step, out=lp[1:])
        prefix = lp[:-1] - np.repeat(lp[starts] - before, sizes)
        open_ = np.flatnonzero(step)
        own = np.repeat(np.arange(len(sizes)), sizes)[open_]
        rest = np.log1p(-np.minimum(np.exp(step[open_]), 1 - 1e-16))
        key = word_keys(path + 1000, occurrence[open_])
        # What a value is before it's held below the bound; that changes no order.
        g = prefix[open_] + rest - np.log(-np.log(draw(key, open_ - starts[own])))
        if len(open_):
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.concatenate([begins, [len(own)]]))
            who = own[begins]
            for _ in range(most):
                top = np.maximum.reduceat(g, begins)
                hit = np.flatnonzero(g == np.repeat(top, size))
                hit = hit[np.concatenate([[True], own[hit][1:] != own[hit][:-1]])]
                for d, value, free, at in zip(who.tolist(), (-np.logaddexp(-bound[who], -top)).tolist(), top.tolist(), hit.tolist(), strict=True):
                    if free > FAR:
                        e = int(open_[at])
                        pools[live[d]].append((value, path, int(e - starts[d] + shift[d]), (int(edges[e]),), float(prefix[e]), int(occurrence[e])))
                g[hit] = -np.inf
        return lp[ends] - lp[starts] + before

    live = np.arange(len(texts))
    all_words = np.arange(len(root))
    edges, count, step = lat.descend(root, word_keys(0, slice(None)))
    occurrence = np.repeat(all_words, count)
    sizes = np.bincount(doc[occurrence], minlength=len(texts)) if len(occurrence) else np.zeros(len(texts), np.int64)
    top = -np.log(-np.log(draw(doc_key, 0)))
    total = beside(0, edges, step, occurrence, sizes, np.zeros(len(texts)), top, np.zeros(len(texts), np.int64), k)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(len(texts)):
        paths[d].append((edges[bounds[d] : bounds[d + 1]], float(total[d]), float(top[d])))
    for j in range(1, k):
        live = np.array([d for d in range(len(texts)) if pools[d]], np.int64)
        if not len(live):
            break
        heads, nodes, occs, before, values, shift, residue = [], [], [], [], [], [], []
        picks = draw(doc_key[live], j)
        for d, u in zip(live.tolist(), picks.tolist(), strict=True):
            pool = pools[d]
            best = max(range(len(pool)), key=lambda i: pool[i][0])
            value, path, step, out, prefix, occ = pool.pop(best)
            node = lat.source(out[0])
            a, b = lat.first[node], lat.first[node + 1]
            to, log_p = lat.follow(node, np.arange(a, b))
            p = np.exp(log_p)
            p[[x - a for x in out]] = 0.0
            c = np.cumsum(p)
            e = int(a + min(np.searchsorted(c, u * c[-1], "right"), np.flatnonzero(p)[-1]))
            heads.append(np.concatenate([paths[d][path][0][:step], [e]]))
            nodes.append(to[e - a])
            occs.append(occ)
            before.append(prefix + float(log_p[e - a]))
            values.append(value)
            shift.append(step + 1)
            rest = c[-1] - p[e - a]
            residue.append((path, step, (*out, e), prefix, occ, rest) if rest > 1e-14 and len(out) + 1 < b - a else None)
        occs = np.array(occs, np.int64)
        sizes = last[live] - occs
        span = gather(occs, sizes)
        node = root[span]
        node[np.cumsum(sizes) - sizes] = nodes
        key = word_keys(j, span)
        edges, count, step = lat.descend(node, key)
        occurrence = np.repeat(span, count)
        owner = np.repeat(np.arange(len(live)), sizes)
        steps = np.bincount(np.repeat(owner, count), minlength=len(live))
        before, values = np.array(before), np.array(values)
        total = beside(j, edges, step, occurrence, steps, before, values, np.array(shift), k - j)
        left = draw(doc_key[live], 1000 + j)
        bounds = np.concatenate([[0], np.cumsum(steps)])
        for i, d in enumerate(live.tolist()):
            paths[d].append((np.concatenate([heads[i], edges[bounds[i] : bounds[i + 1]]]), float(total[i]), float(values[i])))
            if residue[i]:
                path, step, out, prefix, occ, rest = residue[i]
                pools[d].append((float(_below(values[i], prefix + np.log(rest), left[i])), path, step, out, prefix, occ))
            pools[d] = sorted(pools[d], key=lambda g: -g[0])[: k - j]
    result = []
    for d in range(len(texts)):
        threshold = max((g[0] for g in pools[d]), default=-np.inf)
        own = []
        for edge, lp, value in paths[d]:
            inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(lp - threshold, 700.0))))
            own.append((lat.piece[edge], lp, value, inclusion))
        result.append(own)
    lat.trim()
    return result


def expand(vocab: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    """Ids of the vocabulary: characters in bytes become their byte pieces."""
    return expand_all(vocab, pieces, np.array([len(pieces)]))[0]


def expand_all(vocab: Vocabulary, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for several texts, whose pieces follow each other: (ids, number of each text's)."""
    odd = np.flatnonzero(pieces >= vocab.size)
    if not len(odd):
        return pieces.astype(np.int32), counts
    kinds, which = np.unique(pieces[odd] - vocab.size, return_inverse=True)
    spelled_ = [vocab.bytes_of(int(c)) for c in kinds]
    size = np.array([len(s) for s in spelled_], np.int64)
    table = np.array([x for s in spelled_ for x in s], np.int32)
    count = np.ones(len(pieces), np.int64)
    count[odd] = size[which]
    out = np.repeat(pieces, count).astype(np.int32)
    ends = np.cumsum(count)
    out[gather((ends - count)[odd], count[odd])] = table[gather((np.cumsum(size) - size)[which], size[which])]
    return out, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


def _rows(vocab: Vocabulary, ids: pa.Array, texts: list[str | None], k: int, seed: int) -> pa.RecordBatch:
    import xxhash

    ids, texts = ids.to_pylist(), ["" if t is None else t for t in texts]
    found = sample(vocab, texts, [xxhash.xxh3_64_intdigest(str(x), seed) for x in ids], k)
    rows = [(x, text, s, *own) for x, text, paths in zip(ids, texts, found, strict=True) for s, own in enumerate(paths, 1)]
    doc, text, number, pieces, log_prob, value, inclusion = zip(*rows, strict=True)
    out, sizes = expand_all(vocab, np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces)))
    same = [a == b.encode("utf-8") for a, b in zip(vocab.decode_all(out, sizes), text, strict=True)]
    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(out))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
    cols = (doc, number, sizes, log_prob, value, inclusion, same)
    return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], column], names=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "pieces"])


def _run(path: str, k: int, alpha: float, seed: int):
    def run(batches):
        vocab = Vocabulary.get(path, alpha)
        for batch in batches:
            for i, j in byte_chunks(batch.column("text"), CHUNK_BYTES):
                yield _rows(vocab, batch.column("doc_id")[i:j], batch.column("text")[i:j].to_pylist(), k, seed)
                release()
            # Else it stays until the next one is there.
            del batch

    return run


def segment(docs: DataFrame, model: str, *, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """A row for each sampled segmentation of each document, best perturbed value first; ``pieces`` are ids of the vocabulary and ``round_trip`` says that they decode to the text."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_run(model, samples, alpha, seed), SCHEMA)
