"""Packing token sequences into windows by minimum bin slack.

Documents longer than a window give whole windows; the rest of each, shorter than a window, is packed
with others. For each window the longest remaining piece is set, and a bitset (bit s: some choice of
the remaining lengths sums up to s) finds the choice that fills the window closest to its capacity.
Lengths enter the bitset with their counts, in binary shares, and walking back through the steps gives
how many of each length the choice takes. The same choice is then used as often as the counts allow.

Each task packs what it reads, in blocks of a bounded number of pieces, so nothing is shuffled and
memory does not grow with the input; a block ends with at most one window that is not full.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
#: Pieces packed together; each holds its ids, of 4 bytes, until it is placed.
BLOCK_PIECES = 16384
#: Words whose ids a task remembers; it forgets all of them when it has seen more.
_MEMORY = 400_000
#: Fixed value: the pre-token pattern of byte-level BPE files of this kind.
_PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _byte_ranks(spec: dict) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file as ranks of byte strings.

    Such files write each byte as a printable character: itself where it is one, else the next free
    character from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    extra = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in extra}


class Encoder:
    """Ids of whole texts by a `tokenizers` file with a GPT-2 style pre-tokenizer, as little-endian bytes.

    A pre-token that begins with a space begins at every space before a letter, a digit or a sign, so a
    text may be cut there and its pieces encoded alone; most pieces are words seen before. New ones go
    through `tiktoken` with the file's own vocabulary, which gives the same ids in a fifth of the time;
    pieces with one of the file's special tokens go through `tokenizers` itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = tiktoken.Encoding("file", pat_str=_PRE_TOKENS, mergeable_ranks=_byte_ranks(spec), special_tokens={})._core_bpe.encode_ordinary
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        if any(t in piece for t in self.special):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(piece)).tobytes()

    @staticmethod
    def _cuts(piece: str) -> bool:
        return bool(piece) and (piece[0].isalnum() or "!" <= piece[0] <= "~")

    def encode(self, text: str) -> bytes:
        head, *pieces = text.split(" ")
        ids = list(map(self.known.get, pieces))
        if None in ids:
            lacking = {p for p, x in zip(pieces, ids, strict=True) if x is None}
            if not all(map(self._cuts, lacking)):
                merged = [head]
                for p in pieces:
                    if self._cuts(p):
                        merged.append(p)
                    else:
                        merged[-1] += " " + p
                head, *pieces = merged
                ids = list(map(self.known.get, pieces))
                lacking = {p for p, x in zip(pieces, ids, strict=True) if x is None}
            new = {p: self._ids(" " + p) for p in lacking}
            ids = [new[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
            if len(self.known) > _MEMORY:
                self.known.clear()
            self.known.update((p, x) for p, x in new.items() if len(p) <= 40)
        return (self._ids(head) if head else b"") + b"".join(ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The choice of at most ``counts`` of each length with the largest sum up to ``room``."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left > 0:
            share = min(share, left)
            steps.append((length, share, bits))
            bits |= (bits << length * share) & mask
            left, share = left - share, share * 2
        if bits >> room:
            break
    at, taken = bits.bit_length() - 1, {}
    for length, share, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + share
            at -= length * share
    return taken


def pack_block(pieces: list[tuple[int, int, bytes, int]], window: int, slack: int) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """Sequences of pieces (doc_id, start, ids, doc_tokens), all shorter than ``window``.

    Where no choice leaves at most ``slack`` of a window empty, the longest piece left is cut to fill
    it; that comes up when few pieces are left. Only the last sequence can be emptier.
    """
    by: dict[int, list] = {}
    for p in pieces:
        by.setdefault(len(p[2]) // 4, []).append(p)
    while by:
        longest = max(by)
        counts = {n: len(x) for n, x in by.items()}
        counts[longest] -= 1
        choice = fullest(counts, window - longest)
        choice[longest] = choice.get(longest, 0) + 1
        empty = window - sum(n * k for n, k in choice.items())
        for _ in range(min(len(by[n]) // k for n, k in choice.items()) if empty <= slack else 1):
            sequence = [by[n].pop() for n, k in choice.items() for _ in range(k)]
            by = {n: x for n, x in by.items() if x} if empty > slack else by
            if empty > slack and by:
                doc, start, ids, total = by[n := max(by)].pop()
                sequence.append((doc, start, ids[: 4 * empty], total))
                by.setdefault(n - empty, []).append((doc, start + empty, ids[4 * empty :], total))
            yield sequence
        by = {n: x for n, x in by.items() if x}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, block_pieces: int = BLOCK_PIECES, slack: int = 8, end_id: int = 0) -> DataFrame:
    """Packs the ids of all texts, each ended by ``end_id``, into sequences of at most ``window`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id of a
    row lies in one piece; null texts are empty and have the end id alone; repeated rows and null ids
    are packed like others; an empty table gives no rows. ``tokenizer`` is a path that the executors
    can read. Sequence ids hold the task's number, so a task that runs again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, made = Encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        kept: list[tuple[int, int, bytes, int]] = []
        rows: list[tuple] = []

        def put(sequence: list[tuple[int, int, bytes, int]]) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in sequence:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + made, offset))
                offset += len(ids) // 4
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total, whole = len(ids) // 4, len(ids) // (4 * window) * window
                for start in range(0, whole, window):
                    put([(doc, start, ids[4 * start : 4 * (start + window)], total)])
                if whole < total:
                    kept.append((doc, whole, ids[4 * whole :], total))
                if len(kept) >= block_pieces:
                    for sequence in pack_block(kept, window, slack):
                        put(sequence)
                    kept = []
                if len(rows) >= 65536:
                    yield flush()
        for sequence in pack_block(kept, window, slack):
            put(sequence)
        yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
