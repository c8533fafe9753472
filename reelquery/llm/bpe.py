"""BPE encoding and decoding.

Encoding runs a priority queue of merge ranks over a doubly linked list of
symbols.  Queue entries are never removed when a neighbour merges: an entry
is stale when the two symbols it names no longer stand side by side at its
position, and is skipped when popped.  Decoding concatenates vocabulary
strings.

The vocabulary file is a public `tokenizers` JSON whose path is a parameter.
Supported: BPE with an optional end-of-word suffix, byte-level alphabet, NFC,
white-space folding, lower case, and a removed-inverse split pattern, which
is what the file `word_bpe_49k.json` declares.

White space never lies inside a piece, so a text's ids are the concatenation
of the ids of its white-space-delimited chunks; chunks repeat, so their ids
are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_bytes

#: Entries kept by the chunk and piece tables of one Python worker (about 250 bytes each).
TABLE_ENTRIES = 400_000

#: Fixed value: the characters that \s stands for in the vocabulary's patterns (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else 256 onwards in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    known = set(plain)
    return [chr(b) if b in known else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge rules and text rules of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + suffix] for c in letters]
        #: rules[rank] = (left id, right id, merged id); rank_of[left << 16 | right] = rank
        self.rules: list[tuple[int, int, int]] = []
        self.rank_of: dict[int, int] = {}
        for left, right in model["merges"]:
            a, b = ids[left], ids[right]
            self.rank_of.setdefault(a << 16 | b, len(self.rules))
            self.rules.append((a, b, ids[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        if size > 1 << 16:
            raise ValueError("pairs of ids are kept in 32 bits: at most 65,536 ids")
        self.strings = [b""] * size
        for s, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = s.encode()
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._piece = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}"))
        self._pieces: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merge rules, lowest rank first and leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, rules, push, pop = self.rank_of.get, self.rules, heapq.heappush, heapq.heappop
        # A queue entry is rank * n + position: one small integer.
        queue = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            rank = rank_of(left << 16 | right)
            if rank is not None:
                queue.append(rank * n + i - 1)
            left = right
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        while queue:
            rank, i = divmod(pop(queue), n)
            left, right, merged = rules[rank]
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(merged << 16 | symbols[k])
                if rank is not None:
                    push(queue, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 16 | merged)
                if rank is not None:
                    push(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def piece_ids(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            raw = piece.encode()
            symbols = list(map(self.inner.__getitem__, raw))
            symbols[-1] = self.final[raw[-1]]
            merged = self.merge(symbols)
            found = struct.pack(f"<{len(merged)}I", *merged)
            if len(self._pieces) >= TABLE_ENTRIES:
                self._pieces.clear()
            if len(raw) <= 64:
                self._pieces[piece] = found
        return found

    @staticmethod
    def _folded(text: str) -> str:
        # Case is folded character by character, so a final sigma stays a plain one.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids, self._piece.findall(self._folded(text))))

    def pieces_of(self, chunks: list[bytes]) -> list[list[bytes]]:
        """The pieces of each chunk; chunks hold no white space and no special token."""
        if not chunks:
            return []
        # One pass over all of them: a line feed lies in no chunk and joins none to its neighbour.
        lines = self._folded(b"\n".join(chunks).decode("utf-8", "replace")).split("\n")
        return [[p.encode() for p in found] for found in map(self._piece.findall, lines)]

    def text_ids(self, text: str) -> bytes:
        """Ids of a text without a table of chunks, as little-endian unsigned 32-bit integers."""
        if self._special is None or "<" not in text:
            return self._plain(text)
        return b"".join(
            struct.pack("<I", self.special[part]) if part in self.special else self._plain(part)
            for part in self._special.split(text)
        )


class ChunkTable(dict):
    """chunk (bytes) -> ids (bytes); misses are encoded, and the table starts anew when full."""

    def __init__(self, encode, entries: int = TABLE_ENTRIES) -> None:
        self.encode, self.entries = encode, entries

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.encode(chunk.decode("utf-8", "replace"))
        if len(chunk) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[chunk] = found
        return found


class Codec:
    """Encodes and decodes whole texts for one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._chunks = ChunkTable(self.vocabulary.text_ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self._chunks.__getitem__, text.split()))

    def decode(self, ids: bytes) -> bytes:
        """Vocabulary strings joined by one space: the file names no decoder."""
        return b" ".join(map(self.vocabulary.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One codec per Python worker and file."""
    path = path or default_vocabulary()
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


ENCODED = "doc_id long, ids binary"
ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit).

    One row per input row, in no order; null or empty text gives no ids, null
    doc_id stays null, repeated rows repeat, extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([encode(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"]
            )

    return docs_bytes(docs).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text: ids back to text; null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary).decode
        for b in batches:
            texts = [decode(t or b"").decode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode, decode, and return digests of both; same cases as `encode_documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for scalar in b.column(1):
                ids = c.encode(scalar.as_py() or b"")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs_bytes(docs).mapInArrow(run, ROUND_TRIP)
