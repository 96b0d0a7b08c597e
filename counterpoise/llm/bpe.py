"""Byte-level BPE encoding and decoding by backtracking over Aho-Corasick matches.

A text is split into pieces by the tokenizer's pattern, exactly as a rank-file
tokenizer does before it merges. Each piece is then encoded without replaying
the merges:

* every byte is mapped to the code point of the same value (Latin-1), so that
  one Aho-Corasick automaton over all tokens finds every token that occurs in a
  piece, at every position;
* from the start of the piece the longest token is taken whose pair with the
  token before it is *compatible* (byte pair encoding of the two tokens'
  bytes gives exactly those two tokens); when no token fits at a position the
  search steps back and takes the next shorter token there;
* compatibility is decided once per pair of tokens and memoised; a dead end is
  remembered by (position, token before), so each state is visited once and the
  work is linear in the piece for a bounded token length.

A sequence of tokens whose neighbours are all compatible is the byte pair
encoding of its bytes; tokens that byte pair encoding of their own bytes does
not produce can never occur and are left out of the automaton.

Spark reads the documents, ships the rank file once as a broadcast (its size is
the vocabulary's, a fixed parameter, never the corpus's) and runs the encoder
in Arrow batches inside the scan's tasks: no shuffle, nothing collected.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from counterpoise.llm import common

# Pieces already encoded in one worker; words repeat, so most pieces are found here.
PIECE_CACHE = 500_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a rank file: one ``base64(token) rank`` per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


def merge_pairs(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Reference byte pair encoding of a short byte string: merge the lowest-ranked neighbours, leftmost first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encoder and decoder of one vocabulary of ranks and one splitting pattern.

    ``encode`` returns the ids of a text and ``decode`` the bytes of ids. A text
    of ``None`` is encoded as the empty text (no ids). Ids outside the vocabulary
    raise ``KeyError`` when decoded.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or merge_pairs(token, ranks) == [token]:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Byte pair encoding of the two tokens' bytes yields exactly these two tokens."""
        key = (left, right)
        known = self.compatible_pairs.get(key)
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            known = self.compatible_pairs[key] = merge_pairs(a + b, self.ranks) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the split: the longest compatible tokens, stepping back at dead ends."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        # Matches come by end position, so those of one start arrive shortest first: options are read from the back.
        starting: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            starting.setdefault(end - found[1] + 1, []).append(found)
        known = self.compatible_pairs
        path: list[tuple[int, int, int]] = []  # (position, option taken, token)
        dead: set[tuple[int, int]] = set()
        at, option, before = 0, 0, -1
        while at < n:
            options = starting[at]
            last = len(options) - 1
            while option <= last:
                rank, length = options[last - option]
                if before >= 0:
                    fits = known.get((before, rank))
                    if fits is None:
                        fits = self.compatible(before, rank)
                    if not fits:
                        option += 1
                        continue
                if at + length == n or (at + length, rank) not in dead:
                    break
                option += 1
            if option <= last:
                path.append((at, option, rank))
                at, option, before = at + length, 0, rank
            else:
                dead.add((at, before))
                at, taken, _ = path.pop()
                option = taken + 1
                before = path[-1][2] if path else -1
        return tuple(rank for _, _, rank in path)

    def encode_into(self, text: str | None, out: array) -> None:
        """Append the ids of ``text`` to ``out``; null or empty text adds none."""
        if not text:
            return
        pieces = self.pieces
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(pieces) >= PIECE_CACHE:
                    pieces.clear()
                pieces[piece] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("I")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, dict[int, bytes]] = {}


def _key(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _encoder(raw: bytes, pattern: str) -> Encoder:
    key = (_key(raw), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(raw), pattern)
    return _encoders[key]


def _decoder(raw: bytes) -> dict[int, bytes]:
    key = _key(raw)
    if key not in _decoders:
        _decoders[key] = {rank: token for token, rank in read_ranks(raw).items()}
    return _decoders[key]


def _shipped(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _packed(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _unpacked(data: bytes) -> array:
    ids = array("I")
    ids.frombytes(data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def encode(df: DataFrame, text: str, rank_file: str, pattern: str, out: str = "ids", packed: bool = False) -> DataFrame:
    """``df`` with ``out``: the token ids of column ``text``; null or empty text has no ids.

    ``out`` is array<int>, or with ``packed`` the binary of little-endian unsigned
    32-bit ids (the layout of token files for training). Other columns pass
    through unchanged; an existing column called ``out`` is replaced.
    """
    shipped = _shipped(df, rank_file)
    kept = df.drop(out) if out in df.columns else df
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for batch in batches:
            coded = []
            for t in batch.column(text).to_pylist():
                ids = array("I")
                encoder.encode_into(t, ids)
                coded.append(ids)
            column = pa.array([_packed(i) for i in coded], pa.binary()) if packed else pa.array([i.tolist() for i in coded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return common.map_batches(kept, run, schema)


def decode(df: DataFrame, ids: str, rank_file: str, out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes of the token ids in column ``ids`` (array<int> or packed binary; null: empty bytes).

    An id outside the vocabulary fails the task with ``KeyError``.
    """
    shipped = _shipped(df, rank_file)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)
    kept = df.drop(out) if out in df.columns and out != ids else df
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _decoder(shipped.value)
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            decoded = [b"".join(map(tokens.__getitem__, _unpacked(r) if packed else r)) if r else b"" for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, out])

    return common.map_batches(kept, run, schema)


def round_trip(df: DataFrame, text: str, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with packed ids of ``text`` and the bytes decoded from those ids, in one pass over the rows."""
    shipped = _shipped(df, rank_file)
    kept = df.drop(*[c for c in (ids, decoded) if c in df.columns])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType(), False), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        tokens = encoder.tokens
        for batch in batches:
            packed, back = [], []
            for t in batch.column(text).to_pylist():
                coded = array("I")
                encoder.encode_into(t, coded)
                packed.append(_packed(coded))
                back.append(b"".join(map(tokens.__getitem__, coded)))
            columns = [pa.array(packed, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, ids, decoded])

    return common.map_batches(kept, run, schema)


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)
