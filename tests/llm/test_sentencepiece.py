import struct

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import sentencepiece_tokens as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
REF = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", " a", "a ", "a  b", "Hello world", "tab\there\nline", "é ñ 漢字 😀", "▁x", "a▁ b", "<s> </s> <unk> <0x41>", "x" * 3000, "\u0000a", "the the  the   the    the", "ﬁ ①"]


def ids(codec, texts):
    found, same = codec.encode(texts)
    assert all(same)
    return [np.frombuffer(b, "<u4").tolist() for b in found]


def test_parity_on_odd_texts():
    codec = S.SentencePieceCodec(PATH)
    assert ids(codec, ODD) == REF.encode(ODD)
    assert all(codec.normalized(t) == codec.normalizer.normalize_str(t) for t in ODD if t)
    for t in ODD:
        assert codec.decode(REF.encode(t)).decode() == t.replace("▁", " ")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("abe th in \n▁", max_size=60)), min_size=1, max_size=4))
def test_parity_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(S.SentencePieceCodec(PATH), texts) == REF.encode(texts)


def test_parts_that_differ_are_told():
    with open(PATH, "rb") as f:
        codec = S.SentencePieceCodec.of(f.read())
    merges = [m for m in S.build_merges(codec.model) if m != ("▁t", "he")]
    codec.tokenizer.model = type(codec.tokenizer.model)({p: i for i, (p, _, _) in enumerate(codec.model.pieces)}, [m for m in merges if "".join(m) != "▁the"], unk_token="<unk>", fuse_unk=True, byte_fallback=True)
    found, same = codec.encode(["in the end", "no such word"])
    assert same == [False, True]
    got = [np.frombuffer(b, "<u4").tolist() for b in found]
    assert got[1] == REF.encode("no such word") and got[0] != REF.encode("in the end")
    # the rebuilt model's own ids, which the broken merges make others than sentencepiece's
    assert got[0] == [i for w in ("▁in", "▁the", "▁end") for i in codec.tokenizer.encode(w, add_special_tokens=False).ids]


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram(extra_spaces: int) -> bytes:
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -1.0 - i / 3, 1) for i, p in enumerate(["▁", "▁the", "the", "▁a", "ab", "abc", "b", "c", "a", "t", "h", "e", "he", "bc"])]
    body = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces]
    return message(*body, (2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, extra_spaces), (5, 1))))


def test_unigram_parity():
    for extra in (0, 1):
        data = unigram(extra)
        codec, ref = S.SentencePieceCodec.of(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        texts = ["the abc", "abcabc the", "  a  b ", "the zoo é", "", "thethe"]
        assert ids(codec, texts) == ref.encode(texts)


def test_operator(spark):
    texts = [None, "", "a b", "a b", "x " * 50_000, "é\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' AS ids", "1 AS parity")
    rows = {r.doc_id: r for r in S.encode_sentencepiece(df, PATH).collect()}
    assert all(r.parity and r.round_trip for r in rows.values())
    assert [rows[i].ids for i in range(6)] == [REF.encode(t or "") for t in texts]
    assert S.encode_sentencepiece(df.limit(0), PATH).count() == 0
