"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so one Aho-Corasick automaton over the whole vocabulary finds all tokens
in a piece. The encoder walks from left to right with the longest token that is compatible with the token before
it and backtracks from dead ends; each position is given up at most once. Two tokens are compatible if merging
their joined bytes gives just these two; this is memoised. A sequence whose neighbours are all compatible is the
one that greedy merging by rank gives: the first merge across a border would have been made in the pair alone too.
"""

from __future__ import annotations

import base64
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm import kernels as K
from urbanloom.session import ship

#: Entries kept by the memos of a Python worker before they are emptied (memory only; results don't depend on it).
PIECES_KEPT, PAIRS_KEPT = 300_000, 500_000
_CODECS: dict[tuple[bytes, str], Codec] = {}


class Codec:
    """Encoder and decoder for one vocabulary of ranks (lines of base64 token and rank) and one split pattern."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import ahocorasick

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}  # of late; when full it becomes the older one
        self.older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Greedy merging as it is defined: again and again the leftmost pair of the least rank."""
        get, none = self.ranks.get, len(self.tokens)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        choices: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(data.decode("latin-1")):
            choices[end + 1 - found[0]].append(found)  # shorter ones come first
        dead, known, compatible = set(), self.pairs.get, self.compatible
        out: list[int] = []
        open_: list[tuple[int, list]] = []  # the positions behind, and what is still to be tried there
        pos, last, here = 0, -1, choices[0]
        while pos < n:
            while here:
                size, rank = here.pop()
                to = pos + size
                if to in dead:
                    continue
                if last >= 0:
                    fits = known(last << 32 | rank)
                    if not (compatible(last, rank) if fits is None else fits):
                        continue
                out.append(rank)
                open_.append((pos, here))
                pos, last, here = to, rank, choices[to][:]
                break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(pos)
                out.pop()
                pos, here = open_.pop()
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """The ids, as native 32-bit integers."""
        ids = bytearray()
        more = iter([self.split(text)]) if len(text) < 1 << 22 else self._slices(text)
        for pieces in more:
            kept, older = self.pieces, self.older
            for piece in pieces:
                got = kept.get(piece)
                if got is None:
                    got = older.get(piece)
                    if got is None:
                        got = array("i", self.encode_piece(piece.encode())).tobytes()
                    if len(piece) <= 64:
                        kept[piece] = got
                        if len(kept) >= PIECES_KEPT:
                            self.older = older = kept
                            self.pieces = kept = {}
                ids += got
        return bytes(ids)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _slices(self, text: str):
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, 100_000)]:
            yield part

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The worker's codec; a Python worker builds it once."""
    key = (vocabulary, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, pattern)
    return _CODECS[key]


def encode_decode(df: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and ``decoded`` (binary, from the ids) for each row.

    Each match of ``pattern`` is encoded by itself; no special tokens. ``vocabulary`` has the lines of a rank file
    (a megabyte or so, sent to each executor once). A null text is empty: no ids, no bytes. Null, repeated and
    tied ids are kept as rows of their own; an empty table gives an empty one; further columns, whatever their
    names, are not read. Very long texts are split by the pattern piece by piece.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def run(batches):
        own = codec(*sent.value)
        for batch in batches:
            for a, data, offs in K.chunks(batch.column(1)):
                flat, sizes, decoded = bytearray(), [0], []
                for i in range(len(offs) - 1):
                    ids = own.encode(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8"))
                    flat += ids
                    sizes.append(len(flat) // 4)
                    decoded.append(own.decode(array("i", ids)))
                lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.frombuffer(bytes(flat), np.int32)))
                yield pa.record_batch([batch.column(0).slice(a, len(offs) - 1), lists, pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    kept = df.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return kept.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(df: DataFrame) -> DataFrame:
    """What the query returns of ``encode_decode``: counts and digests in place of the ids and bytes."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
