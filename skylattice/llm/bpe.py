"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer.

A pre-token's symbols form a doubly linked list. A heap holds the mergeable neighbours by merge rank
and position; a popped entry whose symbols have changed meanwhile is stale and skipped. Decoding
concatenates the vocabulary's byte strings of the ids, for all texts of a batch at once.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import sliced

#: How byte-level tokenizers split text before merging (fixed pattern of that format).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without characters on which the standard library's classes differ; faster.
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-&(-\/:-@\[-`{-~¡-©«-´¶-¹»¿×÷']+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏ]")
#: Letters and numbers of the regex module (2026.9) that the tokenizers library (Unicode 16) takes for signs.
_NEWER_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96
1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F"""
_NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
_NEWER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in (_NEWER_LETTERS + " " + _NEWER_NUMBERS).split()) + "]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, byte level)."""

    def __init__(self, path: str, cache: int = 300_000):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[s] for s, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        #: left id and right id in one integer -> merge rank and made id in one integer
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.limit = cache
        self.known = _Known(self)
        every = range(max(self.bytes_of, default=-1) + 1)
        self.spelled = _Strings([self.bytes_of.get(i, b"") for i in every])
        self.numbers = _Strings([b"%d," % i for i in every])

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token. A heap entry is merge rank and position of the left symbol in one integer."""
        first, find = self.first, self.merges.get
        ids = [first[b] for b in word]
        n = len(ids)
        heap, left = [], -1
        for i, right in enumerate(ids, -1):
            if (m := find(left << 32 | right)) is not None and i >= 0:
                heap.append(m >> 32 << 32 | i)
            left = right
        if not heap:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or (left := ids[i]) < 0 or (m := find(left << 32 | ids[j])) is None or (m ^ top) >> 32:
                continue  # stale: one of the two symbols has been merged since
            ids[i] = made = m & 0xFFFFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := find(made << 32 | ids[k])) is not None:
                    heappush(heap, m >> 32 << 32 | i)
            if (h := before[i]) >= 0 and (m := find(ids[h] << 32 | made)) is not None:
                heappush(heap, m >> 32 << 32 | h)
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens stand by themselves."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Pre-tokens as the library cuts them; characters newer than its tables are signs to it."""
        if not _UNUSUAL.search(text):
            return _PLAIN_SPLIT.findall(text)
        if not _NEWER.search(text):
            return SPLIT.findall(text)
        ends = [m.end() for m in SPLIT.finditer(_NEWER.sub("\u2603", text))]  # a sign of the same length
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids_of(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        known = self.known
        out = b"".join([known[p] for p in self.pieces(text)])
        if len(known) > self.limit:
            known.age()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids_of(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.spelled.of(np.asarray(ids, dtype=np.int32))[0].tobytes().decode("utf-8", errors="replace")

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """For each text: number of ids, sha256 of the ids' text, sha256 of what the ids decode to."""
        parts = [self.ids_of(t) for t in texts]
        counts = np.array([len(x) // 4 for x in parts], dtype=np.int64)
        ids = np.frombuffer(b"".join(parts), dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        (said, said_at), (back, back_at) = self.numbers.of(ids), self.spelled.of(ids)
        said_sha, back_sha = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            said_sha.append(hashlib.sha256(said[said_at[i] : max(said_at[j] - 1, said_at[i])]).hexdigest())  # without the last comma
            decoded = back[back_at[i] : back_at[j]].tobytes()
            back_sha.append(hashlib.sha256(decoded.decode("utf-8", errors="replace").encode()).hexdigest())
        return counts, said_sha, back_sha


class _Strings:
    """The byte string of each id, all in one array, so that the strings of many ids are concatenated at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated strings of ``ids``, and where each begins (and the end)."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[ids] - at[:-1], size)
        where += np.arange(at[-1])
        return self.data[where], at


class _Known(dict):
    """Pre-token -> ids as 32-bit integers, in two generations, so that each new pre-token is merged once."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        if (got := self.old.get(piece)) is None:
            bpe = self.bpe
            ids = [bpe.special[piece]] if piece in bpe.special else bpe.merge(piece.encode())
            got = array("i", ids).tobytes()
        if len(piece) <= 64:
            self[piece] = got
        return got


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the encoded texts themselves (null text: no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for b in sliced(batches):
            ids = [bpe.encode(t or "") if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _two(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text: the texts of encoded rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for b in batches:
            texts = [bpe.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids; repeated rows each get a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for b in sliced(batches, limit=1 << 20):
            counts, ids, back = bpe.digests([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _two(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
