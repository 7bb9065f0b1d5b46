"""Encoding with the tokenizers library, word by word, for tokenizers that never join what white space parts."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

#: Threads of the library in one Python worker; it reads the setting once, at its first batch.
THREADS = "2"
#: Words that the cache keeps in each of its two generations, and the longest word that it keeps.
KEEP, LONGEST = 500_000, 64
#: Words of one text, and of the texts of one batch: what the library returns takes many times their bytes.
TEXT, TOGETHER = 1_250, 5_000
#: Characters that are neither letters nor digits nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: ASCII white space to spaces; the same with capital ASCII letters to small ones.
SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
SMALL = SPACED.lower()
#: Words of visible ASCII characters without <, and the parts that the library's pattern makes of their small letters.
VISIBLE = re.compile(rb"[!-;=-~]+")
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def library():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    import tokenizers

    return tokenizers


class Cache:
    """Two generations of a dictionary: what the old one holds and is asked for again moves to the young one."""

    def __init__(self, keep: int = KEEP):
        self.young, self.old, self.keep, self.long = {}, {}, keep, []

    def fill(self, words: set, encode) -> dict:
        """A dictionary that holds all words; encode gives the ids of a list of words as bytes. Long words go with the
        next call."""
        for w in self.long:
            del self.young[w]
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = words.difference(young)
        again = new.intersection(old)
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        new = list(new.difference(again))
        self.long = [w for w in new if len(w) > LONGEST]
        young.update(zip(new, encode(new), strict=True) if new else ())
        return young


def cut(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The pieces of an id array up to each of the ends, as bytes."""
    raw, at = data.tobytes(), [0, *(4 * ends).tolist()]
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level tokenizers, where it is not the one of that number."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + k) for k, b in enumerate(others) if b != 32}


class WordEncoder:
    """Texts to ids as little-endian u32 bytes, by encode(), without special tokens being added.

    For byte-pair tokenizers of lower-case words whose last token is marked, and which part words at white space and
    between letters and other characters. ASCII white space is a boundary that no token, normalisation or match
    crosses in them: each distinct word is encoded by the library once and looked up later. New words of ASCII or of
    small letters, with signs behind or not, go to the library in texts of TEXT words, parted already, in the
    characters that stand for their bytes and without the normaliser, which leaves them as they are; the marked tokens
    show where each ends. Other words are a text each. All texts go in batches, over which the library's threads share.
    """

    _cached: dict = {}
    ALPHABET = alphabet()

    def __init__(self, path: str):
        if path not in self._cached:
            tokenizer = library().Tokenizer.from_file(path)
            suffix = tokenizer.model.end_of_word_suffix or ""
            marked = np.zeros(tokenizer.get_vocab_size(), bool)
            marked[[i for t, i in tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
            same = [tokenizer.encode(w, add_special_tokens=False).ids for w in ("AZ", "az")]
            if same[0] != same[1] or not all("<|" in t.content for t in tokenizer.get_added_tokens_decoder().values()):
                raise ValueError("a tokenizer of lower-case words is needed, with special tokens that hold <|")
            parted = library().Tokenizer.from_file(path)
            parted.normalizer, parted.pre_tokenizer = None, library().pre_tokenizers.WhitespaceSplit()
            self._cached[path] = (tokenizer, parted, Cache(), marked)
        self.tokenizer, self.parted, self.cache, self.marked = self._cached[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # small and capital ASCII letters give the same ids; only the strings of special tokens must stay as they are
        raw = b" ".join([b"", *(t.translate(SPACED if b"<|" in t else SMALL) for t in texts), b""])
        gaps = np.frombuffer(raw, np.uint8) == 32
        begins = np.flatnonzero(gaps[:-1] > gaps[1:]) + 1
        # a word goes on to the next one's begin, so that nothing is copied; split takes off what follows it
        buffers = [None, pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw)]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
        distinct = _content(coded.dictionary)[0].tobytes().split()
        known = self.cache.fill(set(distinct), self._new)
        values = list(map(known.__getitem__, distinct))
        buffers = [None, pa.py_buffer(np.cumsum([0, *map(len, values)])), pa.py_buffer(b"".join(values))]
        ids, ends = _content(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), buffers).take(coded.indices))
        firsts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        at = ends[np.searchsorted(begins, firsts)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def _new(self, words: list[bytes]) -> list[bytes]:
        found: dict[bytes, bytes] = {}
        plain = [w for w in words if w.isalpha() and w.islower()]  # ASCII letters; texts with <| may hold capital ones
        self._parted(plain, plain, [1] * len(plain), found)
        visible = [w for w in words if w not in found and VISIBLE.fullmatch(w)]
        parts = [PARTS.findall(w.lower()) for w in visible]
        self._parted(visible, list(map(b" ".join, parts)), list(map(len, parts)), found)
        rest = [w for w in words if w not in found]
        texts = [w.decode() for w in rest]
        cores = [w.rstrip(SIGNS) for w in texts]
        parts = [(1 + (len(c) < len(w))) * (c.isalpha() and c.lower() == c) for w, c in zip(texts, cores, strict=True)]
        apart = [(c if n == 1 else f"{c} {w[len(c) :]}").encode() for w, c, n in zip(texts, cores, parts, strict=True) if n]
        self._parted([w for w, n in zip(rest, parts, strict=True) if n], apart, [n for n in parts if n], found)
        rest = [w for w in rest if w not in found]
        if rest:
            single = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            found.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in single), strict=True))
        return list(map(found.__getitem__, words))

    def _parted(self, words: list[bytes], apart: list[bytes], parts: list[int], found: dict) -> None:
        """Encode words in batches of texts, each as many marked tokens as parts says; those of a batch are left out if
        a normaliser could change them."""
        for s in range(0, len(words), TOGETHER):
            own = slice(s, s + TOGETHER)
            raw = [b" ".join(apart[own][k : k + TEXT]) for k in range(0, len(apart[own]), TEXT)]
            if not all(t.isascii() or unicodedata.is_normalized("NFC", t.decode()) for t in raw):
                continue
            texts = [t.decode() if t.isascii() else t.decode("latin-1").translate(self.ALPHABET) for t in raw]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.parted.encode_batch_fast(texts, add_special_tokens=False)])
            ends, last = np.flatnonzero(self.marked[ids]) + 1, np.cumsum(parts[own])
            if len(ends) == last[-1]:
                found.update(zip(words[own], cut(ids, ends[last - 1]), strict=True))


def _content(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array without nulls, and where each value begins, with the end of the last."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
