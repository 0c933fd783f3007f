"""Word-aligned coding and the files around it: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from railweave.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_256), st.integers(2**59, 2**64 - 1)), max_size=1500))
def test_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = tf.encode(ids)
    assert (tf.decode(words, escapes) == ids).all()
    for k in range(len(offsets) - 1):
        assert (tf.decode_block(words, offsets, escapes, k) == ids[k * tf.BLOCK:(k + 1) * tf.BLOCK]).all()


def test_words_hold_what_the_selectors_promise():
    assert len(tf.encode(np.zeros(512, np.uint64))[0]) <= 8
    assert len(tf.encode(np.full(500, 7))[0]) == 25
    words, _, escapes = tf.encode(np.array([2**63, 1], np.uint64))
    assert len(words) == 2 and escapes.tolist() == [2**63]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(alphabet=" \n\tab'sé1.!<|endoftext|>\x85\x1c", max_size=40), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids, lengths = tf.tokens_of(PATH).encode(texts)
    want = [[*x.ids, 0] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_forgetting_changes_nothing():
    small = tf.PieceTokens(PATH)
    small.LIMIT = 3
    for _ in range(3):
        ids, _ = small.encode(["some words here", "and more of them"])
        assert ids.tolist() == tf.tokens_of(PATH).encode(["some words here", "and more of them"])[0].tolist()


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for doc_id, ids in sorted(((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(make, odd_rows):
    got = sorted((tuple(r) for r in tf.write_and_read(make(odd_rows)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    want = brute([r[:2] for r in odd_rows])
    assert sorted(r[0:1] + r[2:] for r in got if r[0]) == sorted(r[0:1] + r[2:] for r in want if r[0])
    assert [(r[0], r[2]) for r in got if r[0] != 11 and r[0]] == [(r[0], r[2]) for r in want if r[0] != 11 and r[0]]
    ends = [r[1] + r[2] for r in got]
    assert [r[1] for r in got] == [0, *ends[:-1]] and [r[0] is None for r in got] == [r[0] is None for r in want]


def test_empty_table(make):
    assert tf.write_and_read(make([])).collect() == []


END = "<|endoftext|>"


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.sampled_from([END, "<|endof", "text|>", " ", "\n", "\t", "a", " b", "c  d", "é", "'s", "<", ">", "1."]), max_size=12).map("".join), max_size=6))
def test_added_tokens_have_the_ids_of_the_library(texts):
    plain = Tokenizer.from_file(PATH)
    ids, lengths = tf.tokens_of(PATH).encode(texts)
    want = [[*plain.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_files_with_added_tokens(make):
    plain = Tokenizer.from_file(PATH)
    rows = [(1, f"a {END} b"), (2, END), (3, f"{END}{END} x"), (4, "after them")]
    got = sorted((tuple(r) for r in tf.write_and_read(make(rows)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    start = 0
    for (doc_id, text), row in zip(rows, got, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert row == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_added_tokens_that_take_spaces(tmp_path):
    from tokenizers import AddedToken

    for k, token in enumerate((AddedToken("<x>", lstrip=True, rstrip=True), AddedToken("two words"), AddedToken("word", single_word=True))):
        plain = Tokenizer.from_file(PATH)
        plain.add_tokens([token])
        plain.save(str(tmp_path / f"{k}.json"))
        texts = ["a <x> b", "has two words here", "two", "words two", "a word b", "words", f"x {END} word"]
        ids, _ = tf.PieceTokens(str(tmp_path / f"{k}.json")).encode(texts)
        assert ids.tolist() == [i for x in texts for i in [*plain.encode(x, add_special_tokens=False).ids, 0]]
