"""Token-id files: Simple-8b words in blocks that are found by their offsets and decoded as vectors.

File: magic, blocks, footer, footer length (u64), magic. A block holds up to BLOCK ids: three u32 (ids, words,
escapes), the escapes (u32 places, then u64 values), the 64-bit words. The top four bits of a word are its selector:
how many ids it packs, and in how many bits each. Ids of 2^60 or more are escapes and stand as 0 among the words. The
footer lists for each block its first id's number and byte offset, and for each document its first id's number; the
documents' own ids end it, as a column in Arrow's stream format.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.word_encoder import WordEncoder
from plumbline.runtime import materialize, scratch_path
from plumbline.sources.store import open_input, open_output

MAGIC = b"PLBTOK01"
BLOCK = 1 << 16
#: Bytes of texts that are encoded together.
SHARE = 8 << 20
#: (ids in a word, bits of each) by selector.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([c for c, _ in SELECTORS])
BITS = np.array([b for _, b in SELECTORS])
ESCAPE = 60


SMALL = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    if v.max(initial=0) < len(SMALL):
        return SMALL[v]
    out = np.zeros(len(v), np.uint8)
    for b in (32, 16, 8, 4, 2, 1):
        high = (v >> np.uint64(b)) > 0
        out += (high * b).astype(np.uint8)
        v = np.where(high, v >> np.uint64(b), v)
    return out + (v > 0)


def encode_block(ids: np.ndarray) -> bytes:
    """Pack ids (unsigned). Each word takes as many of the next ids as any selector can hold."""
    v = ids.astype(np.uint64)
    n = len(v)
    out = np.flatnonzero(v >> np.uint64(ESCAPE))
    escaped = v[out]
    v[out] = 0
    bits = np.concatenate([_bit_lengths(v), np.zeros(240, np.uint8)])
    # the widest id among the next c, by doubling
    widest, runs = bits, {1: bits}
    c = 1
    while c < 128:
        widest = np.maximum(widest[: len(widest) - c], widest[c:])
        c *= 2
        runs[c] = widest
    choice = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        count, width = SELECTORS[s]
        low = 1 << (count.bit_length() - 1)
        over = np.maximum(runs[low][:n], runs[low][count - low : count - low + n])
        np.putmask(choice, over <= width, s)
    # where words begin: each says where the next does, so that every 32nd can be found by itself, then those between
    jump = np.minimum(np.append(np.arange(n) + COUNTS[choice], n), n)
    jumps = [jump]
    for _ in range(5):
        jumps.append(jumps[-1][jumps[-1]])
    far, place, places = jumps.pop(), 0, []
    while place < n:
        places.append(place)
        place = far.item(place)
    places = np.array(places, np.int64)
    for jump in reversed(jumps):
        places = np.stack([places, jump[places]], axis=1).ravel()
    places = places[places < n]
    chosen = choice[places]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([v, np.zeros(240, np.uint64)])
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        if width:
            own = np.flatnonzero(chosen == s)
            at, part = places[own], words[own]
            for k in range(count):
                part |= padded[at + k] << np.uint64(k * width)
            words[own] = part
    head = struct.pack("<III", n, len(words), len(out))
    return head + out.astype("<u4").tobytes() + escaped.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block as u64, selector by selector."""
    n, n_words, n_out = struct.unpack_from("<III", data)
    places = np.frombuffer(data, "<u4", n_out, 12)
    escaped = np.frombuffer(data, "<u8", n_out, 12 + 4 * n_out)
    words = np.frombuffer(data, "<u8", n_words, 12 + 12 * n_out)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        if width:
            own = np.flatnonzero(chosen == s)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            out[starts[own][:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
    out = out[:n]
    out[places] = escaped
    return out


class TokenFileWriter:
    """Writes documents' ids one after the other; holds one block and the footer."""

    def __init__(self, stream):
        self.stream, self.at, self.n_ids = stream, len(MAGIC), 0
        self.blocks, self.docs, self.names, self.held, self.n_held = [], [], [], [], 0
        stream.write(MAGIC)

    def name(self, names: pa.Array) -> None:
        """The own ids of the next documents."""
        self.names.append(names)

    def add(self, ids: np.ndarray) -> None:
        """The token ids of the next document."""
        self.docs.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._write(ids[k : k + BLOCK])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _write(self, ids):
        data = encode_block(ids)
        self.blocks.append((self.blocks[-1][0] + self.blocks[-1][2] if self.blocks else 0, self.at, len(ids), len(data)))
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> int:
        """Bytes of the file."""
        if self.n_held:
            self._write(np.concatenate(self.held))
        footer = struct.pack("<QQQ", len(self.blocks), len(self.docs), self.n_ids)
        footer += np.array(self.blocks, "<u8").tobytes() + np.array(self.docs, "<u8").tobytes()
        names = pa.RecordBatch.from_arrays([pa.concat_arrays(self.names or [pa.nulls(0)])], names=["id"])
        if names.num_rows != len(self.docs):
            raise ValueError("every document needs a name")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, names.schema) as out:
            out.write_batch(names)
        footer += sink.getvalue().to_pybytes()
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.stream.close()
        return self.at + len(footer) + 16


class TokenFile:
    """A file's footer: names, an Arrow array of the documents' own ids, and what documents() needs."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 16)
        (length,), end = struct.unpack("<Q", file.read(8)), file.read(8)
        if end != MAGIC:
            raise ValueError("not a whole token file")
        file.seek(size - 16 - length)
        footer = file.read(length)
        n_blocks, n_docs, n_ids = struct.unpack_from("<QQQ", footer)
        self.blocks = np.frombuffer(footer, "<u8", 4 * n_blocks, 24).reshape(-1, 4)
        docs = np.frombuffer(footer, "<u8", n_docs, 24 + 32 * n_blocks)
        self.starts, self.ends = docs.tolist(), (np.r_[docs[1:], np.uint64(n_ids)] if n_docs else docs).tolist()
        self.names = pa.ipc.open_stream(footer[24 + 32 * n_blocks + 8 * n_docs :]).read_all().column(0).combine_chunks()

    def documents(self):
        """(number of the first id, token ids) of each document, in order; one block is decoded at a time."""
        held, first, b = np.empty(0, np.uint64), 0, 0
        for start, end in zip(self.starts, self.ends, strict=True):
            parts = [held[start - first :]]
            have = first + len(held) if len(held) else start
            while have < end:
                self.file.seek(int(self.blocks[b][1]))
                parts.append(decode_block(self.file.read(int(self.blocks[b][3]))))
                have += len(parts[-1])
                b += 1
            held, first = np.concatenate(parts), start
            yield start, held[: end - start]


def shares(sizes: np.ndarray) -> list[int]:
    """Where shares of the texts begin, and the end: each has about SHARE bytes, or one text above that."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SHARE)) + 1
    return [0, *cuts.tolist(), len(sizes)] if len(sizes) else []


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write their ids, an end id after each, in ascending order of id: one row for a file.

    Documents are dealt out by ranges of the id, before they are encoded, so that texts and not ids move; each range
    is written by its task into a file of its own, whose name belongs to the attempt. The result, which is written
    too, is the manifest: (part, path, n_ids, n_bytes).

    Nulls: a null text is an empty one and has the end id alone; null ids come first. Rows with equal ids are ordered
    by text. Empty table: no file. A very long text runs over many blocks. Other columns are not read.
    """
    folder = scratch_path(docs.sparkSession, "tokens")

    def run(batches):
        encoder, writer, path = WordEncoder(tokenizer), None, None
        for batch in batches:
            for s, end in pairwise(shares(pc.binary_length(batch.column(1)).to_numpy())):
                part = batch.slice(s, end - s)
                if writer is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                    writer = TokenFileWriter(open_output(path))
                for data in encoder.encode([x.as_py() for x in part.column(1)]):
                    writer.add(np.append(np.frombuffer(data, "<u4"), np.uint32(end_id)))
                writer.name(part.column(0))
        if writer is not None:
            n_bytes = writer.close()
            rows = [[TaskContext.get().partitionId()], [path], [writer.n_ids], [n_bytes]]
            arrays = [pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "path", "n_ids", "n_bytes"])

    dealt = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    dealt = dealt.repartitionByRange("id").sortWithinPartitions("id", "t")
    return materialize(dealt.mapInArrow(run, "part int, path string, n_ids long, n_bytes long"), "token-manifest")


def token_index(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files; ids are of the type kind. start
    counts from the first file. An empty manifest gives no rows."""
    # a row for a file, of three numbers: all that a single task puts in order
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = manifest.select("part", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    files = manifest.select("part", "path").join(places.select("part", "before"), "part")

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as stream:
                    file = TokenFile(stream)
                    out = [(before + start, len(own), zlib.crc32(own.astype("<u4").tobytes())) for start, own in file.documents()]
                    cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([file.names, *cols], names=["id", "start", "n_tokens", "ids_crc32"])

    # a number of its own, since the small manifest would else be read by one task
    spread = files.select("path", "before").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
