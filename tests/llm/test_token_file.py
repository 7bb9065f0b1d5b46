import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import query_tokens as Q
from plumbline.llm import token_file as T
from plumbline.llm import word_encoder
from plumbline.llm.word_encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=600))
def test_blocks_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert (T.decode_block(T.encode_block(a)) == a).all()


def test_every_selector_is_used():
    parts = [np.full(c * 2, (1 << b) - 1, np.uint64) for c, b in T.SELECTORS]
    a = np.concatenate(parts)
    data = T.encode_block(a)
    assert (T.decode_block(data) == a).all() and len(data) < 8 * 60
    assert len(T.encode_block(np.zeros(240 * 50, np.uint64))) == 12 + 8 * 50


@pytest.mark.parametrize("sizes", [[], [0, 0], [5, 0, 200_000, 1, 70_000], [T.BLOCK, T.BLOCK, 3]])
def test_files_round_trip(sizes):
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 49_408, n).astype(np.uint32) for n in sizes]

    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    out = Kept()
    w = T.TokenFileWriter(out)
    for d in docs:
        w.add(d)
    w.name(pa.array([f"d{k}" for k in range(len(docs))], pa.string()))
    assert w.close() == len(out.data)

    class In(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    file = T.TokenFile(In(out.data))
    got = [ids for _, ids in file.documents()]
    assert file.names.to_pylist() == [f"d{k}" for k in range(len(docs))]
    assert len(got) == len(docs) and all((a == b).all() for a, b in zip(got, docs, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_words_encode_as_whole_texts(texts):
    t = Tokenizer.from_file(PATH)
    texts = [x.encode("utf-8", "ignore").decode() for x in texts] + ["a b", "don't  stop", "<|endoftext|> x<|endoftext|>y", "é ́x y\x1cz Σ"]
    got = WordEncoder(PATH).encode([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_capitals_beside_special_tokens():
    t = Tokenizer.from_file(PATH)
    texts = ["Hello World <|x|> The USA", "Hello, USA! <|endoftext|> The<|endoftext|>End", "hello The USA"]
    got = WordEncoder(PATH).encode([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_library_gets_batches_of_many_texts(monkeypatch):
    monkeypatch.setattr(word_encoder, "TEXT", 100)
    encoder = WordEncoder(PATH)
    sizes = []

    class Spy:
        def encode_batch_fast(self, texts, **kw):
            sizes.append(len(texts))
            return real.encode_batch_fast(texts, **kw)

    real = encoder.parted
    monkeypatch.setattr(encoder, "parted", Spy())
    words = [f"{a}{b}{c}zq" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"] * 3
    text = " ".join(words)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == want and max(sizes) > 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aZx'sTrevmlLd09.,-<|>/w!\x1c\x01éñ¨ \t", max_size=40), max_size=8))
def test_parts_of_words_are_the_library_s(texts):
    t = Tokenizer.from_file(PATH)
    got = WordEncoder(PATH).encode([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_every_byte_has_its_character():
    t = Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(0x80, 0x3000)) if c.isalpha() and c.lower() == c]
    words = [f"{c}q{c}zq" for c in letters] + [f"{c}zq{c}.," for c in letters]
    got = WordEncoder(PATH).encode([x.encode() for x in words])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in words]


def test_no_words():
    encoder = WordEncoder(PATH)
    assert encoder.encode([]) == [] and encoder.encode([b"", b" \n\v "]) == [b"", b""]
    assert [len(x) > 0 for x in encoder.encode([b"", b"a", b"  ", b"\tb\r\n"])] == [False, True, False, True]


def test_words_with_digits_and_signs_share_texts(monkeypatch):
    encoder = WordEncoder(PATH)
    want = Tokenizer.from_file(PATH)

    class Unused:
        def encode_batch_fast(self, texts, **kw):
            raise AssertionError(texts)

    monkeypatch.setattr(encoder, "tokenizer", Unused())
    text = " ".join(f"555-{k} pass{k}=c{k}D, it's{k}'ll (a{k}.b) Zo{k}@x.y" for k in range(3000, 4000))
    got = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
    assert got == want.encode(text, add_special_tokens=False).ids


def test_a_word_is_looked_up_once_for_all_texts(monkeypatch):
    encoder = WordEncoder(PATH)
    asked = []

    class Spied(dict):
        def __getitem__(self, w):
            asked.append(w)
            return super().__getitem__(w)

    real = encoder.cache.fill
    monkeypatch.setattr(encoder.cache, "fill", lambda words, encode: Spied(real(words, encode)))
    got = encoder.encode([b"one two one ", b"two one"] * 500)
    assert sorted(set(asked)) == [b"one", b"two"] and len(asked) <= 4 and len(set(got)) == 2


def test_shares_of_texts():
    assert T.shares(np.array([], np.int32)) == [] and T.shares(np.array([0, 0], np.int32)) == [0, 2]
    sizes = np.array([5, T.SHARE, 0, 3 * T.SHARE, 1, 2**31 - 1, 2**31 - 1, *[1000] * 30_000], np.int32)
    at = T.shares(sizes)
    assert at[0] == 0 and at[-1] == len(sizes) and all(a < b for a, b in zip(at, at[1:], strict=False))
    assert all(sizes[a:b].sum(dtype=np.int64) - sizes[a:b].max() <= T.SHARE for a, b in zip(at, at[1:], strict=False))


def test_own_ids_are_read_from_the_files(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y z"), (None, "w"), ("a", "a")], "doc_id string, text string")
    manifest = T.write_token_files(df, PATH, 1)
    assert manifest.columns == ["part", "path", "n_ids", "n_bytes"]
    assert sorted((str(r.id), r.start) for r in T.token_index(manifest, "string").collect()) == [("None", 0), ("a", 2), ("a", 4), ("b", 7)]


def test_query_against_plain_encoding(spark, tmp_path):
    t = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello world", "x" * 5000, "ab cd " * 60_000, "same", "same", "  \n "]
    rows = [(7 * i % 50, x, "c") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    start, want = 0, set()
    for i, x, _ in sorted(rows):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.add((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in Q.op10_token_files(spark, str(tmp_path)).collect()} == want
    (tmp_path / "none").mkdir()
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert Q.op10_token_files(spark, str(tmp_path / "none")).count() == 0
