"""Encoding whole texts with the tokenizers library, once for each distinct unit.

The library first takes its added tokens (``<|endoftext|>``) out of a text and encodes what lies between them on its own. The byte-level
pre-tokenizer always starts a new piece at a blank that a visible character follows, around a line feed between visible
characters, and between letters and punctuation marks that end a word; merges never cross pieces. So a text may be cut there into units, and
equal units have equal ids wherever they stand: the ids and offsets are those of the library's own call for the whole text. A batch is cut
and its units are numbered by Arrow; distinct new units are encoded, and ids (and character offsets) are gathered with
numpy. Units that came more than once outlive a task. Texts are never shortened.
"""

from __future__ import annotations

import re
import string
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than blanks and line feeds, and the mark used below: texts with it are cut more carefully.
ODD = r"[\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{00}]"
CUT = re.compile(r" (?=\S)")
#: Units kept in memory, and bytes of texts handled at a time. They bound memory, not results.
KEPT_UNITS = 400_000
CHUNK_BYTES = 4_000_000
#: Units joined to one text for the tokenizer.
JOINED = 1000
#: First character of the key of a unit that has no blank before it. Other keys but the line feed's lack their unit's first blank.
RAW = "\x00"
#: Marks that are neither letters, digits nor white space: a run of them after letters is a piece of its own.
MARKS = string.punctuation
#: Latin letters beyond ASCII; these are letters in any version of Unicode.
LATIN = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha())
#: Letters and the marks that end a word, which have a piece of their own.
ENDED = f"^(?P<stem>[A-Za-z{LATIN}]+)(?P<marks>[{re.escape(MARKS)}]+)$"


def byte_chunks(column, most: int = CHUNK_BYTES):
    """(first, last + 1) of runs of a string column's rows of about ``most`` bytes, found without making strings; a longer row is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def strings(column: pa.Array) -> list[str]:
    """A string column's values; several times faster than ``to_pylist`` for short ones."""
    return column.to_numpy(zero_copy_only=False).tolist()


def release() -> None:
    """Give freed memory back to the system, where Arrow and the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start .. start + length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def unit(key: str) -> str:
    return key[1:] if key[:1] == RAW else key if key == "\n" else " " + key


def unit_lengths(keys: list[str]) -> np.ndarray:
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    short = np.fromiter((k[:1] == RAW for k in keys), bool, len(keys))
    feed = np.fromiter((k == "\n" for k in keys), bool, len(keys))
    return np.where(short, n - 1, np.where(feed, 1, n + 1))


def worker_cache(kind: str) -> dict:
    """What lives as long as a Python worker, whose tasks each get their own copy of this module. Holds things of one kind: another kind's asking drops them, so that stages don't add up."""
    kept = sys.modules.setdefault("relspark_worker_cache", types.ModuleType("relspark_worker_cache")).__dict__.setdefault("kept", {})
    if kind not in kept:
        kept.clear()
        release()
    return kept.setdefault(kind, {})


class _Codes(dict):
    """key -> number; new keys get the next number and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class UnitEncoder:
    """``encode(texts)`` gives flat ids, tokens per text and, with ``offsets``, the first character and the end of each token in its text."""

    def __init__(self, path: str, offsets: bool = False):
        from tokenizers import Tokenizer, processors

        self.tok = Tokenizer.from_file(path)
        # Added tokens as the library finds them; where one takes blanks or whole words only, a text that holds it is one unit.
        added = self.tok.get_added_tokens_decoder().values()
        named = sorted((t.content for t in added), key=lambda c: (-len(c), c))
        self.added = re.compile("(" + "|".join(map(re.escape, named)) + ")") if named else None
        self.plain_added = self.tok.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.odd = "|".join([ODD, *map(re.escape, named)])
        self.model = self.tok.model
        self.offsets = offsets
        if offsets:
            self.tok.post_processor = processors.ByteLevel(trim_offsets=False)
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1
        # How the pre-tokenizer writes the bytes of Latin letters beyond ASCII.
        self.letters = {}
        for c in LATIN:
            self.letters.update(zip(c.encode("utf-8"), self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0], strict=True))
        self.alone = re.compile("[A-Za-z]+" if offsets else f"[A-Za-z{LATIN}]+")
        self.blank = self.tok.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.forget()

    @staticmethod
    def get(path: str, offsets: bool = False) -> UnitEncoder:
        """This worker's encoder."""
        cache = worker_cache("units")
        if (path, offsets) not in cache:
            cache[path, offsets] = UnitEncoder(path, offsets)
        return cache[path, offsets]

    def forget(self) -> None:
        self.codes = _Codes()
        self.ids, self.begin, self.end = (np.zeros(0, np.int32) for _ in range(3))
        self.start, self.count, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        for key in ("", RAW, "\n", ".", ","):
            self.codes[key]
            self.codes[RAW + key]
        self._encode_new()

    def _trim(self) -> None:
        """Keep what came more than once (or more often, if that's still much)."""
        least = 2
        while np.count_nonzero(self.hits >= least) > KEPT_UNITS // 2:
            least *= 2
        keep = self.hits >= least
        keep[:10] = True
        number = np.cumsum(keep) - 1
        codes = _Codes()
        codes.update((k, int(number[n])) for k, n in self.codes.items() if keep[n])
        self.codes = codes
        count = self.count[keep]
        at = gather(self.start[keep], count)
        self.ids = self.ids[at]
        if self.offsets:
            self.begin, self.end = self.begin[at], self.end[at]
        self.start, self.count, self.hits = np.cumsum(count) - count, count, self.hits[keep] // 2

    def _encode_new(self) -> None:
        new, self.codes.new, first = self.codes.new, [], len(self.count)
        self.start, self.count, self.hits = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.start, self.count, self.hits))
        self.made, self.size = [], len(self.ids)
        words, blanks, raws = [], [], []
        # Letters alone are one piece, which the model takes as it is.
        alone = self.alone.fullmatch
        for i, key in enumerate(new, first):
            (words if alone(key) else raws if key[:1] == RAW or key == "\n" else blanks).append(i)
        if words:
            tokenize, blank, spell = self.model.tokenize, self.blank, self._spell
            found = [tokenize(blank + spell(new[i - first])) for i in words]
            flat = [t for ts in found for t in ts]
            # The model counts bytes, of which the blank's stand-in has two.
            at = np.maximum(np.array([t.offsets for t in flat] if self.offsets else [], np.int32).reshape(-1, 2) - 1, 0)
            count = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(np.array(words), np.fromiter((t.id for t in flat), np.int32, len(flat)), np.cumsum(count) - count, count, at, 0)
        lone = []
        for keys, lead in ((blanks, " "), (raws, "")):
            groups = [keys[i : i + JOINED] for i in range(0, len(keys), JOINED)]
            plain, texts = [], []
            for group in groups:
                bare = [new[i - first][0 if lead else 1 :] for i in group]
                text = lead + ("\n" + lead).join(bare)
                if self.feed >= 0 and text.split() == bare and not (self.added and self.added.search(text)):
                    plain.append((group, np.fromiter(map(len, bare), np.int64, len(bare)) + len(lead) + 1))
                    texts.append(text)
                else:
                    lone += group
            for (group, length), enc in zip(plain, self._run(texts), strict=True):
                flat = np.array(enc.ids, np.int32)
                ends = np.concatenate([np.flatnonzero(flat == self.feed), [len(flat)]])
                if len(ends) != len(group):
                    lone += group
                    continue
                starts = np.concatenate([[0], ends[:-1] + 1])
                shift = np.repeat(np.cumsum(length) - length, np.diff(np.concatenate([starts, [len(flat)]]))) if self.offsets else 0
                self._keep(np.array(group), flat, starts, ends - starts, np.array(enc.offsets, np.int32).reshape(-1, 2) if self.offsets else None, shift)
        for i, enc in zip(lone, self._run([unit(new[i - first]) for i in lone]), strict=True):
            self._keep(np.array([i]), np.array(enc.ids, np.int32), np.array([0]), np.array([len(enc.ids)]), np.array(enc.offsets, np.int32).reshape(-1, 2) if self.offsets else None, 0)
        self.ids = np.concatenate([self.ids, *[x[0] for x in self.made]])
        if self.offsets:
            self.begin = np.concatenate([self.begin, *[x[1] for x in self.made]])
            self.end = np.concatenate([self.end, *[x[2] for x in self.made]])

    def _spell(self, word: str) -> str:
        """The word as the model reads it: a character for each byte."""
        return word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)

    def _run(self, texts: list[str]):
        return (self.tok.encode_batch if self.offsets else self.tok.encode_batch_fast)(texts, add_special_tokens=False)

    def _keep(self, which: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, spans: np.ndarray | None, shift) -> None:
        self.start[which], self.count[which] = self.size + starts, counts
        self.made.append((flat, (spans[:, 0] - shift).astype(np.int32), (spans[:, 1] - shift).astype(np.int32)) if self.offsets else (flat,))
        self.size += len(flat)

    def _cut(self, text: str) -> list[str]:
        """The keys of the units of any text."""
        parts = [text]
        if self.added is not None and self.added.search(text):
            if not self.plain_added:
                return [RAW + text]
            parts = self.added.split(text)
        keys = []
        for i, part in enumerate(parts):
            own = [part] if i % 2 else CUT.split(part)
            own[0] = RAW + own[0]
            # A key may begin with the mark only where it stands for it.
            keys += own if i % 2 or not any(k[:1] == RAW for k in own[1:]) else [RAW + part]
        return keys

    def _numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units of a string column's texts: their codes, their characters (with offsets), and how many each text has."""
        odd = np.asarray(pc.match_substring_regex(column, self.odd))
        lists = pc.split_pattern(pc.binary_join_element_wise(RAW, pc.replace_substring(column, "\n", f" \n {RAW}"), ""), " ")
        words_in = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        text_of = np.repeat(np.arange(len(words_in)), words_in)
        coded = lists.flatten().dictionary_encode()
        own, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        # Blanks that follow each other or end a line, too, need the careful way.
        bare = np.asarray(pc.is_in(words, pa.array(["", RAW])))
        odd = odd | (np.bincount(text_of, weights=bare[own], minlength=len(odd)) > 0)
        if odd.any():
            plain = ~odd[text_of]
            own, text_of = own[plain], text_of[plain]
            used, own = np.unique(own, return_inverse=True)
            words = words.take(pa.array(used))
        parts = pc.extract_regex(words, ENDED)
        ended = np.asarray(pc.is_valid(parts))
        stems = pc.coalesce(pc.struct_field(parts, "stem"), words)
        marks = pc.binary_join_element_wise(RAW, pc.struct_field(parts.filter(pa.array(ended)), "marks"), "")
        both = pa.concat_arrays([stems, marks]).dictionary_encode()
        keys = strings(both.dictionary)
        code = np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))
        place = np.asarray(both.indices)
        second = np.zeros(len(words), np.int64)
        second[ended] = place[len(words) :]
        # Each word's one or two units, in order.
        two = ended[own].astype(np.int64)
        ends = np.cumsum(1 + two)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        flat[ends - 1 - two] = place[own]
        flat[ends[two > 0] - 1] = second[own[two > 0]]
        codes = code[flat]
        length = unit_lengths(keys)[flat] if self.offsets else np.zeros(0, np.int64)
        count = np.bincount(text_of, weights=1 + two, minlength=len(odd)).astype(np.int64)
        if odd.any():
            ends = np.cumsum(count)
            parts, lengths, at = [], [], 0
            for i in np.flatnonzero(odd).tolist():
                keys = self._cut(column[i].as_py())
                parts += [codes[at : ends[i]], np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))]
                if self.offsets:
                    lengths += [length[at : ends[i]], unit_lengths(keys)]
                count[i], at = len(keys), ends[i]
            codes = np.concatenate([*parts, codes[at:]])
            if self.offsets:
                length = np.concatenate([*lengths, length[at:]])
        return codes, length, count

    def encode(self, texts: list[str] | pa.Array):
        if len(self.codes) > KEPT_UNITS:
            self._trim()
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
        codes, length, per_text = self._numbers(column)
        if self.codes.new:
            self._encode_new()
        self.hits += np.bincount(codes, minlength=len(self.hits))
        count = self.count[codes]
        at = gather(self.start[codes], count)
        ends = np.concatenate([[0], np.cumsum(count)])
        last = np.cumsum(per_text)
        tokens = ends[last] - ends[last - per_text]
        if not self.offsets:
            return self.ids[at], tokens
        where = np.cumsum(length) - length
        where = np.repeat(where - np.repeat(where[last - per_text], per_text), count)
        return self.ids[at], tokens, where + self.begin[at], where + self.end[at]
