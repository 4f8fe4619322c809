"""Operator 3, byte-level BPE encoding and decoding.

The tokens go into an Aho-Corasick automaton, bytes written as Latin-1 characters so that one byte is one
character. A piece is encoded from left to right: take the longest token that matches at the position;
while it is not compatible with the token before, take the next shorter one, and when none is left step
back over the token before. Two adjacent tokens are compatible when encoding their concatenation by the
merges gives just these two; that answer is memoised per pair. A chain of pairwise compatible tokens is
the one sequence that the merges produce, and a bit per position that has failed keeps the search linear.

Texts are cut into pieces by the tokenizer's pattern first. Encoded chunks (a space and what follows up
to the next) are memoised in a bounded table.

Cases: null text counts as empty (no ids); texts of any length are read whole; repeated rows are encoded
one by one; other columns are ignored; an empty table gives an empty result; bytes are those of the UTF-8
text, so that decoding gives back the text exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch

#: Entries of a worker's table of encoded chunks; it starts anew when full.
MEMO = 400_000

#: Patterns of which every match ends before a space that stands between two other characters: those of byte-level
#: vocabularies whose words may begin with one space.
PARTS_AT_SPACES = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"})

#: White space that may part pieces otherwise than at single spaces.
_ODD = re.compile(r"\s\s|\s | \s|^\s|\s$")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of "base64 rank" lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all 256 single bytes")
        self._auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self._rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        for token, rank in self._rank_of.items():
            self._auto.add_word(token, rank)
        self._auto.make_automaton()
        self._sizes = [len(t) for t in self.tokens]
        self._most = max(self._sizes)
        self._shorter = [-1] * len(self.tokens)  # the longest token that is a proper prefix
        for token, rank in self._rank_of.items():
            self._shorter[rank] = next((r for k in range(len(token) - 1, 0, -1) if (r := self._rank_of.get(token[:k])) is not None), -1)
        self._compatible: dict[int, bool] = {}
        self._spines: dict[int, dict[int, tuple[int, ...]]] = {0: {}, -1: {}}

    def _merge(self, piece: bytes, below: float = float("inf")) -> list[int]:
        """The merges by their definition, those of rank under ``below``: the lowest rank first, the
        leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, side: int) -> tuple[int, ...]:
        """The tokens that stand at the left (0) or right (-1) edge of ``token`` while it is merged, from
        the single byte to itself; empty if it isn't made of two tokens of lower rank."""
        known = self._spines[side].get(token)
        if known is None:
            known = (token,)
            if len(self.tokens[token]) > 1:
                halves = self._merge(self.tokens[token], token)
                below = self._spine(halves[side], side) if len(halves) == 2 and max(halves) < token else ()
                known = (*below, token) if below else ()
            self._spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Follow both edges in the order of the merges: the pair stays apart unless the two tokens that
        meet at some time merge before either of them grows."""
        a, b = self._spine(left, -1), self._spine(right, 0)
        if not a or not b:
            return self._merge(self.tokens[left] + self.tokens[right]) == [left, right]
        tokens, ranks, i, j, never = self.tokens, self.ranks, 0, 0, len(self.tokens)
        while True:
            grows_a = a[i + 1] if i + 1 < len(a) else never
            grows_b = b[j + 1] if j + 1 < len(b) else never
            across = ranks.get(tokens[a[i]] + tokens[b[j]])
            if across is not None and across < grows_a and across <= grows_b:
                return False
            if grows_a == never == grows_b:
                return True
            if grows_a <= grows_b:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        s = piece.decode("latin-1")
        n, sizes, shorter, known = len(s), self._sizes, self._shorter, self._compatible
        out: list[int] = []
        failed: set[int] = set()  # positions from which no chain reaches the end
        pos, token = 0, self._longest(s, 0)
        while pos < n:
            while token >= 0:
                end = pos + sizes[token]
                if end not in failed:
                    if not out:
                        break
                    fits = known.get(out[-1] << 32 | token)
                    if self.compatible(out[-1], token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                if pos < n:
                    token = self._longest(s, pos)
            else:
                failed.add(pos)
                token = out.pop()
                pos -= sizes[token]
                token = shorter[token]
        return out

    def _longest(self, s: str, pos: int) -> int:
        """The longest token that matches at ``pos``."""
        head = s[pos : pos + self._most]
        k = self._auto.longest_prefix(head)  # of the trie; it may end inside a longer token
        rank = self._rank_of.get(head[:k])
        while rank is None:
            k -= 1
            rank = self._rank_of.get(head[:k])
        return rank

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder(dict):
    """Whole texts: a memo from chunk to the little-endian ids of its pieces."""

    def __init__(self, bpe: BytePairEncoder, pattern: str):
        import regex

        super().__init__()
        self.bpe = bpe
        self._split = regex.compile(pattern).findall
        # with this pattern, a space between two characters that aren't white space always starts a piece; texts are
        # taken apart there for the memo, but not with a pattern that isn't known to do so
        self._parts_at_spaces = pattern in PARTS_AT_SPACES
        self._pieces: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        got = []
        pieces = self._pieces
        for p in self._split(chunk):
            ids = pieces.get(p)
            if ids is None:
                if len(pieces) >= MEMO:
                    pieces.clear()
                ids = np.array(self.bpe.encode_piece(p.encode()), "<u4").tobytes()
                if len(p) <= 64:
                    pieces[p] = ids
            got.append(ids)
        return b"".join(got)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._ids(" " + chunk)
        if len(self) >= MEMO:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self._parts_at_spaces:
            return self._ids(text)
        if _ODD.search(text):
            # lone spaces between other characters still part the text; only the odd stretches stay whole
            return b"".join(map(self._stretch, re.split(r"(?<=\S)(?= \S)", text)))
        head, *rest = text.split(" ")
        return self._ids(head) + b"".join(map(self.__getitem__, rest))

    def _stretch(self, chunk: str) -> bytes:
        if chunk[:1] == " " and not chunk[1:2].isspace():
            return self[chunk[1:]]
        return self._ids(chunk)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(ranks_key: str, ranks: dict[bytes, int], pattern: str) -> TextEncoder:
    """This worker's encoder for a vocabulary and a pattern; built once for all its tasks."""
    key = (ranks_key, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(BytePairEncoder(ranks), pattern)
    return _ENCODERS[key]


def _key(ranks: dict[bytes, int]) -> str:
    """Tells vocabularies apart by their content, wherever they were read from."""
    h = hashlib.sha256()
    for token, rank in ranks.items():
        h.update(b"%d %d " % (rank, len(token)) + token)
    return h.hexdigest()


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row. The vocabulary is read on the driver
    and broadcast: its size is the file's, 50,000 entries."""
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = _key(ranks)

    def run(batches):
        enc = encoder(name, shared.value, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = enc.encode(text.as_py())
                ids = np.frombuffer(raw, "<u4")
                rows.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(enc.bpe.decode(ids.tolist())).hexdigest()))
            yield batch(_OUT, *(zip(*rows) if rows else [[]] * 4))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with a column ``ids``, array of integers; one of that name is replaced."""
    docs = docs.drop("ids")
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = _key(ranks)
    at = docs.columns.index("text")
    schema = docs.select("*", F.array().cast("array<int>").alias("ids")).schema

    def run(batches):
        enc = encoder(name, shared.value, pattern)
        for b in batches:
            ids = [np.frombuffer(enc.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The inverse: ``text`` from ``ids``; ids that aren't UTF-8 give replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rest = [c for c in encoded.columns if c not in ("ids", "text")]
    schema = encoded.select(*rest, F.lit("").alias("text")).schema

    def run(batches):
        tokens = {rank: token for token, rank in shared.value.items()}
        for b in batches:
            texts = [b"".join(tokens[i] for i in ids or ()).decode(errors="replace") for ids in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    return encoded.mapInArrow(run, schema)
