import hashlib
import math
import zlib

import numpy as np
import pytest

from plumbline.llm import media as M
from plumbline.llm import query_media as Q


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_round_trips(kind):
    data = np.random.default_rng(kind).integers(0, 256, 192 * 7, dtype=np.uint8).tobytes()
    png = M.encode_png(data, kind)
    assert M.decode_png(png).tobytes() == data


def test_mixed_filters_round_trip():
    rows = np.random.default_rng(9).integers(0, 256, (40, M.ROW), dtype=np.uint8)
    lines = np.concatenate([M.filtered(rows[: i + 1], i * 7 % 5)[i:] for i in range(40)])
    assert (M.unfiltered(lines, 3) == rows).all()


def test_every_row_has_a_filter_of_its_own():
    rnd = np.random.default_rng(2)
    noise = rnd.integers(0, 256, M.ROW, dtype=np.uint8)
    slope = np.repeat(np.arange(64, dtype=np.uint8) * 5, 3)
    rows = np.stack([noise, noise, slope, (noise // 2 + 3), np.full(M.ROW, 32, np.uint8)])
    lines = M.filtered(rows)
    assert lines[:, 0].tolist()[:3] == [0, 2, 1] and (M.unfiltered(lines, 3) == rows).all()
    text = M.pad(("many lines of plain words, " * 60 + "a" * 500).encode())
    png = M.encode_png(text)
    assert M.decode_png(png).tobytes() == text
    walk = np.cumsum(rnd.integers(0, 2, (40, M.ROW), dtype=np.uint8), axis=0, dtype=np.uint8)
    lines = M.filtered(walk)
    assert len(set(lines[:, 0].tolist())) > 1 and (M.unfiltered(lines, 3) == walk).all()


def plain_hash(samples):
    """The transform by its definition, pixel by pixel."""
    grey = [[int(v) for v in row] for row in samples.reshape(len(samples), -1)]
    h, w = len(grey), len(grey[0])
    cells = lambda n: [range(k * n // 32, max((k + 1) * n // 32, k * n // 32 + 1)) for k in range(32)]
    tall = [[sum(grey[y][x] for y in ys) * 256 // len(ys) for x in range(w)] for ys in cells(h)]
    small = [[sum(row[x] for x in xs) * 256 // len(xs) for xs in cells(w)] for row in tall]
    cos = [[round(4096 * math.cos(math.pi / 32 * u * (x + 0.5))) for x in range(32)] for u in range(8)]
    low = [sum(cos[u][y] * cos[v][x] * small[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return int("".join("1" if x > middle else "0" for x in low), 2).to_bytes(8, "big")


def test_cosine_hash_against_its_definition():
    rnd = np.random.default_rng(5)
    for h in (1, 2, 7, 33, 70):
        samples = rnd.integers(0, 256, (h, 64, 3), dtype=np.uint8)
        assert M.cosine_hash(samples) == plain_hash(samples)


def test_damage_is_found():
    png = bytearray(M.encode_png(M.pad(b"hello")))
    png[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        M.decode_png(bytes(png))


def test_documents_round_trip(spark, tmp_path):
    texts = ["", None, "a", "é" * 96, "x" * 192, "x" * 193, "long " * 200_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'c' AS media", "1 AS n_bytes")
    (tmp_path / "in").mkdir()
    df.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    rows = {r.doc_id: r for r in Q.op9_media_png(spark, str(tmp_path / "in")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(full))
        png = M.encode_png(full, None, 1)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == M.cosine_hash(np.frombuffer(full, np.uint8).reshape(-1, 64, 3)).hex()
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-16:])
    assert rows[7][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:] and len(rows[6].feature) == 16
    assert M.to_media(df.limit(0)).count() == 0


def test_damaged_images_are_value_errors():
    png = M.encode_png(b"abc " * 96)
    for k in range(len(png)):
        with pytest.raises(ValueError):
            M.decode_png(png[:k])
    head = M._chunk(b"IHDR", png[16:29])
    body = png[8 + len(head) :]
    for bad in (png[:8] + body, png[:8] + head + head + body, png[:8] + head + M._chunk(b"IEND", b""), png[:8] + head + M._chunk(b"IDAT", b"junk") + body, png[:8] + M._chunk(b"IHDR", png[16:25] + b"\x03" + png[26:29]) + body):
        with pytest.raises(ValueError):
            M.decode_png(bad)
    assert M.decode_png(png).size == 384
