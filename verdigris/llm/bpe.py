"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton and backtracking."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm._common import bound_batches, hold, tidied

#: Entries that each of a memo's two generations holds: a bound of a worker's memory.
MEMO = 250_000
LONG_PIECE = 64  # longer pieces are not remembered
#: Unicode's white space. The split pattern never joins a character with white space after it, so a text
#: may be cut wherever white space begins and the parts encoded apart.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Bpe:
    """Exact BPE for one rank table.

    Bytes stand as Latin-1 characters in the automaton, which finds in one pass over a piece of text the longest
    token that begins at each byte. Encoding walks from token to token: the longest that may follow the token
    before it, else the next shorter prefix that is a token, else a step back. A pair of tokens may be
    adjacent if merging their bytes by rank gives back these two tokens; this is found by undoing the merges at
    their border, and remembered. A place from which the walk had to step back is never tried again, so the work is
    linear in the piece's length.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import ahocorasick
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.prefix = self._prefixes()
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.memo_pairs: dict[tuple[int, int], bool] = {}
        self._split_tokens()
        self.texts = [str(rank) for rank in range(len(self.bytes_of))]
        self.cut = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.words = _Memo(self._encode_word)

    def _prefixes(self) -> list[int]:
        """For each token the longest token that is a proper prefix of it, or -1."""
        prefix = [-1] * len(self.bytes_of)
        for token, rank in self.ranks.items():
            for size in range(len(token) - 1, 0, -1):
                if (shorter := self.ranks.get(token[:size])) is not None:
                    prefix[rank] = shorter
                    break
        return prefix

    def _split_tokens(self) -> None:
        """The last merge of each token: the two halves, both of lower rank, that may be adjacent."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            left = self.prefix[rank]
            while left >= 0:
                right = self.ranks.get(token[len(self.bytes_of[left]) :])
                if right is not None and left < rank and right < rank and self.adjacent(left, right):
                    self.pairs[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.prefix[left]
        self.memo_pairs.clear()  # answers given before all pairs were known

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` stay as they are when their joined bytes are merged."""
        key = (a, b)
        if (known := self.memo_pairs.get(key)) is not None:
            return known
        # A merge across the border counts only if it comes before the one that made the half it would take from.
        limit, answer = len(self.bytes_of), True
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < limit:
                answer = False
                break
            later_left = a > b
            if (a if later_left else b) not in self.halves and (b if later_left else a) not in self.halves:
                break
            if later_left:
                if a in self.halves:
                    limit, a = a, self.halves[a][1]
                else:
                    limit, b = b + 1, self.halves[b][0]
            elif b in self.halves:
                limit, b = b + 1, self.halves[b][0]
            else:
                limit, a = a, self.halves[a][1]
        if len(self.memo_pairs) >= MEMO:
            self.memo_pairs.clear()
        self.memo_pairs[key] = answer
        return answer

    def _encode_word(self, word: str) -> list[int]:
        """The tokens of all matches of the pattern in a run of white space and what follows it up to the next."""
        found = self.find(word)
        if len(found) == 1:
            return self.encode_piece(word.encode("utf-8", "surrogatepass"))
        return [t for piece in found for t in self.words[piece]]  # a match is its own only match

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece of text."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        adjacent = self.adjacent
        text = piece.decode("latin-1")
        greedy = [rank for _, (rank, _) in self.automaton.iter_long(text)]
        if all(map(adjacent, greedy, greedy[1:])) and sum(map(len, map(self.bytes_of.__getitem__, greedy))) == len(piece):
            return greedy  # longest matches that may all be adjacent: nothing to step back from
        n = len(piece)
        longest = [-1] * n
        for last, (rank, back) in self.automaton.iter(text):
            longest[last - back] = rank  # matches come by their ends, so the longest is the last to stay
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        prefix, bytes_of = self.prefix, self.bytes_of
        while at < n:
            while token >= 0:
                end = at + len(bytes_of[token])
                if not dead[end] and (not out or adjacent(out[-1], token)):
                    break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(bytes_of[token])
                token = prefix[token]
        return out

    def encode(self, text: str) -> list[int]:
        """The tokens of a whole text: each match of the pattern separately, without special tokens."""
        out: list[int] = []
        for ids in map(self.words.__getitem__, self.cut(text)):
            out += ids
        return out

    def forget(self) -> None:
        """Drop what the memos hold."""
        self.words.clear()
        self.words.older = {}
        self.memo_pairs.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """What ``make`` gave for the short strings seen before, in two generations: what the older one still gives moves on."""

    def __init__(self, make):
        self.make = make
        self.older: dict = {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.make(piece))  # tuples of ints: the garbage collector leaves them alone
        if len(piece) <= LONG_PIECE:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def bpe_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode each whole text; nothing is shuffled.

    The rank file (under 2 MB) is read on the driver and broadcast; each worker builds the automaton once.

    Defined results: a null text counts as empty and has no tokens; ids may be null or repeated; other columns are
    neither read nor returned; a text without spaces is one long piece and takes linear time; an empty table gives an empty result.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and with ``ids`` the tokens as ``array<int>``.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared, pattern)
        try:
            for batch in batches:
                yield encoded_batch(bpe, batch)
        finally:
            bpe.forget()  # the worker stays, and what runs in it next needs the memory

    def encoded_batch(bpe: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, encoded, decoded, tokens = [], [], [], []
        for value in batch.column(1):
            found = bpe.encode(value.as_py() or "")
            counts.append(len(found))
            encoded.append(hashlib.sha256(" ".join(map(bpe.texts.__getitem__, found)).encode()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(found)).hexdigest())
            if ids:
                tokens.append(pa.array(found, pa.int32()))
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            ends = np.cumsum([0, *counts]).astype(np.int32)
            values = pa.concat_arrays(tokens) if tokens else pa.array([], pa.int32())
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), values))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)


_built: dict[tuple, Bpe] = {}


def _bpe(shared, pattern: str) -> Bpe:
    """One table for each worker process and rank table."""
    key = (len(shared.value), pattern, hash(frozenset(shared.value.items())))
    hold("bpe", _built.clear)
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(shared.value, pattern)
    return _built[key]
