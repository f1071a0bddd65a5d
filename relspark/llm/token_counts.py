"""Token counts by section, attributed by character offsets.

A whole document is encoded once (in units at whose borders the library's own pre-tokenizer cuts, see ``units``, so its tokens and offsets are those of one call). Its sections (lines with their line feeds, given starts, or the document's fields, joined) and its tokens are
intervals of characters; both are in order, so the interval join is one merge of sorted starts for a batch of documents. A token that crosses
a boundary goes to one section by an explicit rule: ``first`` (that of its first character), ``last`` (that of its last
character) or ``most`` (that holding most of its characters among these two; on a tie the first).

Defined cases: a null or empty text has one empty section and no tokens; a text that ends in a line feed has an empty last section;
given starts are taken sorted, once each, within the text, and 0 is always one;
characters of several tokens (parts of UTF-8) count for each of them; null and repeated doc_ids are rows like others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relspark.llm.common import spread
from relspark.llm.units import UnitEncoder, byte_chunks, release

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>, section_chars array<long>"


def line_lengths(text: str) -> list[int]:
    parts = text.split("\n")
    return [len(p) + 1 for p in parts[:-1]] + [len(parts[-1])]


def given_lengths(text: str, starts: list[int] | None) -> list[int]:
    """Lengths of the sections that begin at ``starts``."""
    at = sorted({0, *(s for s in starts or () if s is not None and 0 < s <= len(text))})
    return [b - a for a, b in zip(at, [*at[1:], len(text)], strict=True)]


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (by place) and whether it crosses a boundary. ``starts``: of the sections, ascending from 0."""
    a = np.searchsorted(starts, begin, "right") - 1
    b = np.maximum(np.searchsorted(starts, np.maximum(end - 1, begin), "right") - 1, a)
    if rule == "first":
        return a, a != b
    if rule == "last":
        return b, a != b
    in_a = np.where(a == b, 0, starts[np.minimum(a + 1, len(starts) - 1)] - begin)
    return np.where((a != b) & (end - starts[b] > in_a), b, a), a != b


def _counter(path: str, rule: str):
    def run(batches):
        encoder = UnitEncoder.get(path, offsets=True)
        for batch in batches:
            starts_of = batch.column("starts").to_pylist() if "starts" in batch.schema.names else None
            for i, j in byte_chunks(batch.column("text")):
                column = batch.column("text")[i:j]
                _, count, begin, end = encoder.encode(column)
                part = ["" if t is None else t for t in column.to_pylist()]
                lines = [line_lengths(t) for t in part] if starts_of is None else [given_lengths(t, s) for t, s in zip(part, starts_of[i:j], strict=True)]
                n = np.array([len(x) for x in lines], np.int64)
                length = np.array([x for y in lines for x in y], np.int64)
                # One more character between documents keeps empty sections at their ends apart from the next document.
                chars = np.array([len(t) + 1 for t in part], np.int64)
                base = np.cumsum(chars) - chars
                last = np.cumsum(n)
                inside = np.cumsum(length) - length
                begins = inside - np.repeat(inside[last - n], n) + np.repeat(base, n)
                shift = np.repeat(base, count)
                where, crosses = attribute(begin + shift, end + shift, begins, rule)
                per_section = np.bincount(where, minlength=len(begins)).astype(np.int64)
                crossing = np.bincount(np.repeat(np.arange(len(part)), count), weights=crosses, minlength=len(part)).astype(np.int64)
                offsets = pa.array(np.concatenate([[0], last]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(count), pa.array(n), pa.array(crossing), pa.ListArray.from_arrays(offsets, pa.array(per_section)), pa.ListArray.from_arrays(offsets, pa.array(length))],
                    names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "section_chars"],
                )
                release()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", starts: str | None = None) -> DataFrame:
    """One row per document: n_tokens, n_sections, n_crossing (tokens over a boundary), section_tokens and section_chars in order.

    ``starts``: a column with the character offsets at which sections begin; by default lines are sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    if starts is not None:
        columns.append(F.col(starts).cast("array<int>").alias("starts"))
    return spread(docs.select(*columns)).mapInArrow(_counter(tokenizer, rule), SCHEMA)


def count_field_tokens(docs: DataFrame, tokenizer: str, fields: list[str], rule: str = "first", joint: str = "\n") -> DataFrame:
    """The same with the document's ``fields`` (null: empty), joined by ``joint``, as its sections, each with the joint after it."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends, at = [], F.lit(0)
    for v in values[:-1]:
        at = at + F.length(v) + len(joint)
        ends.append(at)
    whole = docs.select("doc_id", F.concat_ws(joint, *values).alias("text"), F.array(F.lit(0), *ends).alias("starts"))
    return count_tokens(whole, tokenizer, rule, "starts")
