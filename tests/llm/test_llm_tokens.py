"""Simple-8b and token files: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import LONG, ROWS, odd
from tokenizers import Tokenizer

from logsluice.llm import simple8b
from logsluice.llm.token_files import TokenizerFile, encode_texts, pack, read_token_files, unpack, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
FILE = TokenizerFile(PATH, True, r"[.,;:!?#*$%&|]+")
TRICKY = ["A\x0bB\x0cC\x1cD x̀ ×", "<|endoftext|> THE<|endoftext|>END <|ENDOFTEXT|>", "it's. DON'T, 3½ Σς İ a.b. ok!!", "﻿zero​width nb sp"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([3, 64, 1024]))
def test_round_trip(values, block):
    words, offsets = simple8b.encode(np.array(values, np.uint64), block)
    assert simple8b.decode(words, offsets, len(values), block).tolist() == values


def test_words_are_packed_and_blocks_decode_alone():
    values = np.arange(5000, dtype=np.uint64) % np.uint64(8)
    words, offsets = simple8b.encode(values)
    assert len(words) <= 5000 / 20 + 10
    some = simple8b.decode(words, offsets[1:4], 2 * simple8b.BLOCK)
    assert (some == values[simple8b.BLOCK : 3 * simple8b.BLOCK]).all()
    widest = np.array([2**60 - 1, 2**60, 2**64 - 1, 15 << 60], np.uint64)
    words, offsets = simple8b.encode(widest)
    assert len(words) == 7 and (simple8b.decode(words, offsets, 4) == widest).all()


def test_file_format():
    with pytest.raises(ValueError):
        unpack(b"something else")
    none = np.zeros(0, np.int64)
    assert [len(x) for x in unpack(pack(none, none.astype(bool), none, none))] == [0, 0, 0, 0]


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_the_ids_of_whole_texts(spark, tmp_path):
    rows = [(k, t, "en", "a") for k, t in enumerate([*TRICKY, LONG, None, "", "  ", *[r[1] for r in ROWS]])]
    files = write_token_files(odd(spark, rows), str(tmp_path), FILE)
    got = sorted(tuple(r) for r in read_token_files(files).collect())
    assert got == expected([r[:2] for r in rows])


def test_null_and_repeated_keys_and_no_rows(spark, tmp_path):
    files = write_token_files(odd(spark), str(tmp_path / "a"), FILE)
    got = read_token_files(files).collect()
    assert len(got) == len(ROWS)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert read_token_files(write_token_files(odd(spark, []), str(tmp_path / "b"), FILE)).count() == 0


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "İ", "EKONOMİSİ", "\u0958", "\u0915\u093c", "i\u0307", "e\u0301", "Σ", "ΟΔΟΣ", "ﬁ", "ß", "ŉ", "日本", "don't", "'S", "3", "²"]
MARKS = list(".,;:!?#*$%&|<>'-_\"()") + ["\u0307", "\u0301", "\u200b", "\u00a0", " ", "\n", "\t"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SPECIAL), st.sampled_from(MARKS), st.characters(exclude_categories=["Cs"])), max_size=14))
def test_any_text_has_the_ids_of_the_whole(parts):
    text = "".join(parts)
    ids, lengths = encode_texts(FILE, pa.array([text, "İ. " + text + ".", None]))
    whole = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in (text, "İ. " + text + ".", "")]
    assert lengths.tolist() == list(map(len, whole)) and ids.tolist() == [i for x in whole for i in x]


def test_letters_before_marks():
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    texts = [f"a{x}. {x}!? {x}" for x in letters]
    ids, lengths = encode_texts(FILE, pa.array(texts))
    whole = TOKENIZER.encode_batch(texts, add_special_tokens=False)
    assert lengths.tolist() == [len(e.ids) for e in whole] and ids.tolist() == [i for e in whole for i in e.ids]
