import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, processors

from relspark.llm import token_counts, token_output
from relspark.llm.common import fresh_path
from relspark.llm.units import UnitEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    """The library's tokenizer, as it is."""
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(3)
    fixed = ["", "  ", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb \n", "\n", "it's  don't 's", "x<|endoftext|>y", "<|endoftext|>", "<|endoftext|>a", "a <|endoftext|>", " <|endoftext|><|endoftext|> ", "a\n<|endoftext|>\n b <|endoftext|", "\x00<|endoftext|> \x00b", "é 中文  ok b\x1c d \x1c e", "12 34  56\t\t7 \t8", "😀 😀😀  a", "well... yes!! (no), 'so'.", "ª µm \x00 z", "Ünïcödé!!! ñandú,"]
    bits = [*" \n\tab'.,!1é　<Z\x00", "<|endoftext|>", "word ", " it's"]
    return fixed + ["".join(rng.choice(bits) for _ in range(40)) for _ in range(2000)]


@pytest.mark.parametrize("offsets", [False, True])
def test_units_like_the_library(tok, offsets):
    texts = odd_texts()
    encoder = UnitEncoder(PATH, offsets)
    got = encoder.encode(texts)
    whole = Tokenizer.from_file(PATH)
    whole.post_processor = processors.ByteLevel(trim_offsets=False)
    want = whole.encode_batch(texts, add_special_tokens=False)
    plain = tok.encode_batch(texts, add_special_tokens=False)
    assert got[0].tolist() == [i for w in plain for i in w.ids] and got[1].tolist() == [len(w.ids) for w in plain]
    if offsets:
        assert np.column_stack(got[2:]).tolist() == [list(o) for w in want for o in w.offsets]


def test_trimmed_cache_stays_right(tok, monkeypatch):
    monkeypatch.setattr("relspark.llm.units.KEPT_UNITS", 50)
    encoder, texts = UnitEncoder(PATH), odd_texts()
    for i in range(0, len(texts), 20):
        part = texts[i : i + 20]
        assert encoder.encode(part)[0].tolist() == [x for t in part for x in tok.encode(t, add_special_tokens=False).ids]


def test_output_files(spark, tok, awkward, nothing):
    path = fresh_path(spark, "tokens")
    rows = token_output.write_token_ids(awkward, path, PATH)
    got = sorted(rows.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    texts = {r.doc_id: r.text or "" for r in awkward.filter("doc_id is not null").collect()}
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        if r.doc_id is not None:
            assert r.ids == [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
    d = {(r.doc_id, r.start): r.ids_crc32 for r in token_output.digests(rows).collect()}
    assert d == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert token_output.write_token_ids(nothing, fresh_path(spark, "tokens"), PATH).count() == 0


def test_files_have_dictionaries_and_page_indexes(spark, awkward):
    import glob

    import pyarrow.parquet as pq

    path = fresh_path(spark, "tokens")
    token_output.write_token_ids(awkward, path, PATH).count()
    for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        for i in range(group.num_columns):
            c = group.column(i)
            assert c.has_offset_index and (c.path_in_schema != "ids.list.element" or any("DICTIONARY" in e for e in c.encodings))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_by_section(spark, awkward, nothing, rule):
    encoder = UnitEncoder(PATH, True)
    for r in token_counts.count_tokens(awkward, PATH, rule).collect():
        texts = [x.text or "" for x in awkward.collect() if x.doc_id == r.doc_id]
        assert sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
        if len(set(texts)) == 1:
            lines = [s + "\n" for s in texts[0].split("\n")]
            lines[-1] = lines[-1][:-1]
            assert r.section_chars == [len(s) for s in lines]
            enc = encoder.tok.encode(texts[0], add_special_tokens=False)
            owner = [i for i, s in enumerate(lines) for _ in s]
            want = [0] * len(lines)
            for a, b in enc.offsets:
                i, j = owner[a], owner[max(b - 1, a)]
                if rule == "most" and i != j:
                    i = j if sum(owner[c] == j for c in range(a, b)) > sum(owner[c] == i for c in range(a, b)) else i
                want[j if rule == "last" else i] += 1
            assert r.section_tokens == want
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_counts_by_field_and_starts(spark):
    df = spark.createDataFrame([(1, "ab cd", "xyz", None), (2, None, "", "é é")], "doc_id long, title string, body string, tail string")
    got = {r.doc_id: r for r in token_counts.count_field_tokens(df, PATH, ["title", "body", "tail"]).collect()}
    assert got[1].section_chars == [6, 4, 0] and sum(got[1].section_tokens) == got[1].n_tokens and got[1].section_tokens[2] == 0
    assert got[2].section_chars == [1, 1, 3] and got[2].section_tokens[2] >= 2
    given = spark.createDataFrame([(1, "hello world again", [6, 12, 12, 99, -1]), (2, "x", None)], "doc_id long, text string, at array<int>")
    rows = {r.doc_id: r for r in token_counts.count_tokens(given, PATH, starts="at").collect()}
    # The blank before a word belongs to its token, which so begins in the section before.
    assert rows[1].section_chars == [6, 6, 5] and rows[1].section_tokens == [2, 1, 0] and rows[1].n_crossing == 2 and rows[2].section_chars == [1]
    last = {r.doc_id: r for r in token_counts.count_tokens(given, PATH, "most", "at").collect()}
    assert last[1].section_tokens == [1, 1, 1]
