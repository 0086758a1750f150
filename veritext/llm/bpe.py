"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string is determined by one token per prefix: the last
token of that prefix's encoding.  It is unique: of the tokens that end at a
position, exactly one forms, with the last token of the prefix before it, a
pair that the merges leave apart.  The table of these tokens is filled from
left to right, so bytes can be appended exactly, and after an edit only the
entries near it change: the table is filled again from the edit on until its
entries have agreed with the old ones over the longest token's length.

Text is first cut into pieces by the vocabulary's split pattern; merges never
cross pieces.  ``encode_documents`` runs over a DataFrame, Arrow batches in
and out, whole texts, with a bounded memo of pieces in each worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import by_batch
from .tokens import chunks

PAIRS = 2_000_000  # pairs a worker remembers
MEMO = 2_000_000  # pieces a worker remembers (about 0.5 GB); long ones are not kept
MEMO_BYTES = 64
KEY = 4
CHUNK = 1 << 22  # characters handled at a time
# fixed value: the split pattern that ``cut`` restates; others go through regex
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                       ("decoded_sha256", pa.string())])


class Vocabulary:
    """Tokens by rank, the merge each came from, and the pair test."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # the two tokens whose merge made a token; None: one byte, or a token
        # that the merges never make
        self.halves = {i: self._merge(t, i) for t, i in ranks.items()}
        self.made = {t: i for t, i in ranks.items() if len(t) == 1 or self.halves[i]}
        # lengths of the tokens that end with the given last bytes (at most
        # KEY of them), longest first; filled as keys are met
        self.long_ends: dict[bytes, set[int]] = {}
        for t in self.made:
            if len(t) > KEY:
                self.long_ends.setdefault(t[-KEY:], set()).add(len(t))
        self.lengths: dict[bytes, list[int]] = {}
        self.apart: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def _merge(self, data: bytes, below: int) -> tuple[int, int] | None:
        """Merge ``data`` with the ranks under ``below``; the last two parts."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def sizes(self, key: bytes) -> list[int]:
        """Lengths of the tokens that can end where ``key`` ends."""
        if len(self.lengths) > PAIRS:
            self.lengths.clear()
        short = {n for n in range(1, len(key) + 1) if key[-n:] in self.made}
        out = self.lengths[key] = sorted(self.long_ends.get(key, set()) | short, reverse=True)
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is these two tokens."""
        if len(self.apart) > PAIRS:
            self.apart.clear()
        out = self.apart[left << 32 | right] = self._stays(left, right)
        return out

    def _stays(self, a: int, b: int) -> bool:
        """Take both tokens apart again, latest merge first; if at any moment
        the two tokens at the border could merge before the merge that is
        undone, that merge would have come first."""
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.token[a] + self.token[b])
            if joined is not None and joined < limit:
                return False
            if a > b or (a == b and self.halves[a] is None):
                limit, parts = a, self.halves[a]
                if parts is None:
                    limit, parts = b, self.halves[b]
                    if parts is None:
                        return True
                    b = parts[0]
                    limit += 1
                else:
                    a = parts[1]
            else:
                limit, parts = b, self.halves[b]
                if parts is None:
                    limit, parts = a, self.halves[a]
                    if parts is None:
                        return True
                    a = parts[1]
                else:
                    b = parts[0]
                    limit += 1


def fill(v: Vocabulary, data: bytes, last: list[int], stop: int) -> None:
    """Append the last tokens of the prefixes of ``data`` that ``last`` lacks,
    up to the prefix of length ``stop``."""
    made, lengths, apart = v.made.get, v.lengths.get, v.apart.get
    for end in range(len(last) + 1, stop + 1):
        key = data[end - KEY if end > KEY else 0:end]
        for size in lengths(key) or v.sizes(key):
            start = end - size
            if start < 0:
                continue
            token = made(data[start:end])
            if token is None:
                continue
            if start == 0:
                break
            stays = apart(last[start - 1] << 32 | token)
            if stays or (stays is None and v.stays(last[start - 1], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last.append(token)


class PrefixTable:
    """Last token of every prefix of a byte string that may change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        fill(self.v, self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of bytes [start, stop); the number of
        entries that were filled again."""
        tail = self.last[stop:]
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        same, shift = 0, start + len(data)
        while len(self.last) < len(self.data):
            fill(self.v, self.data, self.last, len(self.last) + 1)
            after = len(self.last) - shift
            if after > 0:
                # an entry depends on the longest token's length of entries
                # before it: once these agree, all later ones do
                same = same + 1 if self.last[-1] == tail[after - 1] else 0
                if same >= self.v.longest:
                    filled = len(self.last) - start
                    self.last += tail[after:]
                    return filled
        return len(self.last) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.token[out[-1]])
        return out[::-1]


LETTER, NUMBER, WHITE, OTHER = range(4)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point in the split pattern, from the regex
    module's own tables."""
    if not _CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts (in code points of the joined texts, with the end added)
    and first code point of every text: what ``SPLIT`` matches one after the
    other in each text, found for all texts at once.

    Pieces are runs of one class; a space before a run that is not white
    belongs to that run, other white space stays apart, the last of it by
    itself; an apostrophe that begins a piece takes a contraction's letters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = len(codes)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if n == 0:
        return np.zeros(1, np.int64), first
    kind = classes()[codes]
    edge = np.zeros(n + 1, bool)  # a run or a text begins here
    edge[1:n] = kind[1:] != kind[:-1]
    edge[first] = True
    start = edge.copy()
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    # a run that is not white, after white space of the same text
    after = np.flatnonzero(edge[1:n] & (kind[1:] != WHITE) & (kind[:-1] == WHITE) & ~text_start[1:n]) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    # contractions
    at = np.flatnonzero(start[:n] & (codes == 39))
    at = at[(at + 1 < n)]
    at = at[edge[at + 1] & ~text_start[at + 1]]
    one = codes[at + 1]
    two = np.where(at + 2 < n, codes[np.minimum(at + 2, n - 1)], 0)
    two = np.where(text_start[np.minimum(at + 2, n)], 0, two)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for pair in ("re", "ve", "ll"):
        long |= (one == ord(pair[0])) & (two == ord(pair[1]))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    start[n] = True
    return np.flatnonzero(start), first


class Codec:
    """Texts to ids and back; remembers short pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memo = vocabulary, {}
        size = max(vocabulary.token) + 1
        self.names = pa.array([str(i) for i in range(size)])
        self.bytes = pa.array([vocabulary.token.get(i, b"") for i in range(size)], pa.binary())

    def piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.v.ranks.get(data)
        # a piece that is itself a token is that token, whatever the merges say
        ids = (whole,) if whole is not None else tuple(PrefixTable(self.v, data).tokens())
        if len(data) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[data] = ids
        return ids

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts as one binary array, and the first piece
        of every text."""
        if self.v.pattern.pattern != SPLIT:
            found = [self.v.pattern.findall(t) for t in texts]
            first = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            return pa.array([p.encode() for f in found for p in f], pa.binary()), first
        starts, first = cut(texts)
        joined = "".join(texts)
        data = joined.encode()
        if len(data) == len(joined):
            at = starts
        else:  # code points to bytes
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            at = np.concatenate(([0], np.cumsum(width)))[starts]
        if len(starts) < 2:
            return pa.array([], pa.binary()), np.zeros(len(first), np.int64)
        buffers = [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]
        array = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers)
        return array.cast(pa.binary()), np.searchsorted(starts, first)

    def encode_batch(self, texts: list[str]) -> tuple[pa.DictionaryArray, pa.ListArray, np.ndarray]:
        """Pieces as a dictionary array, ids of every distinct piece, first
        piece of every text."""
        pieces, first = self.pieces(texts)
        coded = pieces.dictionary_encode()
        memo, piece = self.memo.get, self.piece
        ids = [memo(p) or piece(p) for p in coded.dictionary.to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
        return coded, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), first

    def encode(self, text: str) -> list[int]:
        coded, ids, _ = self.encode_batch([text])
        return ids.take(coded.indices).flatten().to_pylist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.token.__getitem__, ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the ids joined by commas and
        of the bytes they decode to."""
        coded, ids, first = self.encode_batch(texts)
        counts = np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy())[coded.indices.to_numpy()])))
        docs = pa.array(first.astype(np.int32))

        def joined(tokens: pa.Array, by: str | bytes) -> pa.Array:
            each = pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values))
            whole = pc.binary_join(each, by).take(coded.indices)
            return pc.binary_join(pa.ListArray.from_arrays(docs, whole), by)

        written, decoded = joined(self.names, ","), joined(self.bytes, b"")
        for i, n in enumerate(counts[first[1:]] - counts[first[:-1]]):
            yield (int(n), hashlib.sha256(written[i].as_buffer()).hexdigest(),
                   hashlib.sha256(decoded[i].as_buffer()).hexdigest())


@lru_cache(1)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once in each Python process; memos of pieces are each task's own."""
    return Vocabulary.from_file(path, pattern)


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, number of tokens, SHA-256 of the decimal ids
    joined by commas and of the decoded bytes.  A null text counts as empty
    (no ids, hash of nothing); repeated rows each give a row; an empty table
    gives an empty result; other columns are not read.  The vocabulary file
    is read once in every Python worker and must lie on the workers' path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(vocabulary(vocabulary_path, pattern))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [r for a, b in chunks(texts, CHUNK) for r in codec.digests(texts[a:b])]
            columns = [batch.column(0).to_pylist(), *(list(zip(*rows, strict=True)) or [[]] * 3)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, OUT_ARROW, strict=True)],
                                  schema=OUT_ARROW)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text"
                           ).mapInArrow(by_batch(run), OUT)
