"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, metaspace marker, scores or merges and byte fallback are rebuilt
as parts of the tokenizers library. Texts are cut where no piece can lie across, and each distinct part is encoded
once. Parity with the sentencepiece library is tested on every distinct part, which decides it for whole texts; where
the two differ, the result is sentencepiece's.
"""

from __future__ import annotations

import array
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.word_encoder import TEXT, TOGETHER, Cache, cut, library

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stands between parts that are encoded in one call, and is none of Unicode's characters.
JOINT = "\uffff"


@dataclass
class Model:
    """What the protobuf says of pieces, trainer and normaliser; the defaults are the format's."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def wire(data: bytes):
    """(field number, value) of a protobuf message: ints, 4-byte and length-delimited fields as they stand."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            m.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire(value))
            m.kind, m.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(wire(value))
            m.charsmap = spec.get(2, b"")
            m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def build_normalizer(m: Model):
    t = library()
    n = t.normalizers
    steps = [n.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [n.Strip(), n.Replace(t.Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(n.Prepend(" "))
    if m.escape_whitespaces:
        steps.append(n.Replace(" ", MARK))
    return n.Sequence(steps)


def build_merges(m: Model) -> list[tuple[str, str]]:
    """All pairs of pieces that join to a piece, best score first, as the merges of a BPE model take place."""
    usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, s in usable.items():
        found += [(-s, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    return [(a, b) for _, _, a, b in sorted(found)]


def build_tokenizer(m: Model):
    """The whole model as a Tokenizer, without its normaliser. The character JOINT parts the parts of a text."""
    t = library()
    unknown = next(i for i, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN)
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = t.models.BPE(vocab, build_merges(m), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = t.models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
    out = t.Tokenizer(model)
    out.pre_tokenizer = t.pre_tokenizers.Split(JOINT, "removed")
    defined = [t.AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if defined:
        out.add_tokens(defined)
    return out


class SentencePieceCodec:
    """Encoder and decoder for one model file."""

    _loaded: dict = {}

    def __new__(cls, path: str):
        if path not in cls._loaded:
            with open(path, "rb") as f:
                cls._loaded[path] = cls.of(f.read())
        return cls._loaded[path]

    @classmethod
    def of(cls, data: bytes) -> SentencePieceCodec:
        import sentencepiece

        self = super().__new__(cls)
        self.model = parse_model(data)
        self.normalizer, self.tokenizer = build_normalizer(self.model), build_tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cache = Cache(150_000)
        self.differ: set[str] = set()
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.marked = np.array([p.endswith(MARK) for p, _, _ in self.model.pieces])
        # a run of marks begins a part where no piece has a mark behind another character: no merge crosses that border
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.model.pieces if kind not in (CONTROL, UNKNOWN))
        self.part = None if whole else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.bytes_of = [
            b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, kind in self.model.pieces
        ]
        return self

    def normalized(self, text: str) -> str:
        if not text:
            return ""
        m = self.model
        if m.charsmap or m.remove_extra_whitespaces:
            return self.normalizer.normalize_str(text)
        text = " " + text if m.add_dummy_prefix else text
        return text.replace(" ", MARK) if m.escape_whitespaces else text

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids as little-endian u32 bytes by the tokenizers library, and whether sentencepiece agrees on each text.

        No piece crosses the borders of a text's parts, so that its ids are those of its parts: both libraries encode
        every distinct part, once while the cache holds it. The tokenizers library's ids stand, whatever the other says.
        """
        texts = [self.normalized(t) for t in texts]
        parts = [self.part.findall(t) if self.part else [t] if t else [] for t in texts]
        known = self.cache.fill(set().union(*parts), self._new)
        same = [not self.differ or self.differ.isdisjoint(ws) for ws in parts]
        return [b"".join(map(known.__getitem__, ws)) for ws in parts], same

    def _new(self, parts: list[str]) -> list[bytes]:
        """New parts go to the tokenizers library in batches of texts of TEXT parts, over which its threads share: a part
        begins with a mark behind something else. Other parts, and all of a batch whose ids differ from sentencepiece's
        or whose borders cannot be told, are texts of their own."""
        plain = [p for p in parts if p[0] == MARK and p[-1] != MARK and JOINT not in p] if self.part else []
        found = {}
        for k in range(0, len(plain), TOGETHER):
            self._joined(plain[k : k + TOGETHER], found)
        rest = [p for p in parts if p not in found] if len(found) < len(parts) else []
        for k in range(0, len(rest), TOGETHER):
            some = rest[k : k + TOGETHER]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[p] = np.array(e.ids, "<u4").tobytes()
                if found[p] != self._reference(p):
                    self.differ.add(p)
        return [found[p] for p in parts]

    def _joined(self, plain: list[str], found: dict[str, bytes]) -> None:
        if plain:
            texts = [JOINT.join(plain[k : k + TEXT]) for k in range(0, len(plain), TEXT)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            if ids.tobytes() == self._reference("".join(plain)):
                begins = np.flatnonzero(self.opens[ids[1:]] & ~self.marked[ids[:-1]]) + 1
                if len(begins) + 1 == len(plain):
                    found.update(zip(plain, cut(ids, np.append(begins, len(ids))), strict=True))

    def _reference(self, normalized: str) -> bytes:
        """sentencepiece's ids of what is normalised already. Marks alone stand behind a letter, since a text without
        characters gets no prefix."""
        behind = self.part is not None and not normalized.strip(MARK)
        text = ("a" if behind else "") + normalized[self.model.add_dummy_prefix and not behind :]
        text = text.replace(MARK, " ") if self.model.escape_whitespaces else text
        ids = self.reference.encode(text)
        return array.array("I", ids[len(self.reference.encode("a")) if behind else 0 :]).tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes: pieces joined, marks as spaces, the dummy prefix taken off."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if self.model.add_dummy_prefix and out[:1] == b" " else out


def encode_sentencepiece(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(id, ids array<int>, n_tokens, parity, round_trip) for every text.

    ids are the tokenizers library's. parity: sentencepiece gives the same ones. round_trip: the ids decode to the text as it was normalised.
    Nulls: a null text is an empty one, with no ids; a null id is kept. Repeated rows give equal results. Very long
    texts are encoded whole. Empty table: no rows. Other columns are not read.
    """

    def run(batches):
        codec = SentencePieceCodec(model_path)
        for whole in batches:
            for s in range(0, whole.num_rows, batch):
                part = whole.slice(s, batch)
                texts = part.column(1).to_pylist()
                found, same = codec.encode(texts)
                arrays = [np.frombuffer(f, "<u4").astype(np.int32) for f in found]
                back = [codec.decode(a.tolist()) for a in arrays]
                lossless = [b == codec.normalized(t).replace(MARK, " ")[codec.model.add_dummy_prefix :].encode() for b, t in zip(back, texts, strict=True)]
                offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), listed, pa.array(np.diff(offsets).astype(np.int64)), pa.array(same), pa.array(lossless)],
                    names=["id", "ids", "n_tokens", "parity", "round_trip"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, parity boolean, round_trip boolean").withColumnRenamed("id", id_col)
