"""Hierarchical multi-length packing of tokenised documents.

Documents go to tiers of power-of-two contexts by their length. Each tier packs sequences
of exactly its own size: a base document first, then the largest fitting pieces of the same
or shorter tiers, and at last a cut piece that closes the gap. What a task has left over is
cut into powers of two, so no sequence needs padding. Sequences of one tier are dealt into
step groups of near-equal attention cost.

Tasks work on their own partition in bounded windows of documents, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import spread

CONTEXT = 1024
TIERS = (1024, 512, 256, 128, 64)
#: Sequences of one tier that a training step takes together.
STEP_SEQUENCES = 32
#: Characters from which a text's ids don't become a list of Python's.
LONG = 1_000_000
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of whole texts as packed little-endian uint32.

    Ordinary text goes through a faster encoder with the tokenizer's vocabulary, merges and
    pattern. Texts with special tokens, and those with runs of white space beyond what its
    pattern can look ahead over, go to the tokenizer itself.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        self._fast = self._plain(definition)

    @staticmethod
    def _plain(definition: str):
        import json

        import tiktoken

        vocab = json.loads(definition)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in printable}
        of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(of[c] for c in word): i for word, i in vocab.items() if word != _SPECIAL}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL not in text:
            try:
                return _packed(self._fast.encode_ordinary(text)) if len(text) < LONG else self._fast.encode_to_numpy(text).astype("<u4").tobytes()
            except ValueError:  # the pattern ran out of its stack
                pass
        return self.whole(text)


def definition_of(tokenizer_file: str) -> str:
    """The text of a tokenizer file, read by the driver: executors need no copy of the file."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return f.read()


def _packed(ids: list[int]) -> bytes:
    return pack_ids(f"<{len(ids)}I", *ids)


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens); ids are packed uint32, tokens are 4 bytes."""

    def __init__(self, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS):
        self.context, self.tiers = context, tuple(sorted(tiers, reverse=True))
        self._lengths: list[int] = []  # sorted lengths that wait
        self._waiting: dict[int, list] = {}
        self._total = 0

    def add(self, doc, ids: bytes):
        """Yield the full sequences of a long document; its rest waits."""
        total, size = len(ids) // 4, self.context
        full = total - total % size
        for start in range(0, full, size):
            yield size, [(doc, start, ids[4 * start : 4 * (start + size)], total)]
        if full < total:
            self._wait((doc, full, ids[4 * full :], total))

    def _wait(self, piece) -> None:
        n = len(piece[2]) // 4
        if n not in self._waiting:
            self._waiting[n] = []
            bisect.insort(self._lengths, n)
        self._waiting[n].append(piece)
        self._total += n

    def _pop(self, at: int):
        n = self._lengths[at]
        piece = self._waiting[n].pop()
        if not self._waiting[n]:
            del self._waiting[n], self._lengths[at]
        self._total -= n
        return piece

    def _fill(self, size: int) -> list:
        """Pieces of `size` tokens in all: the longest that fits, again and again, and at
        last one cut from the shortest longer piece, whose remainder waits on."""
        parts, gap = [], size
        while gap:
            at = bisect.bisect_right(self._lengths, gap)
            if at:
                piece = self._pop(at - 1)
            else:
                doc, start, ids, total = self._pop(0)
                piece = (doc, start, ids[: 4 * gap], total)
                self._wait((doc, start + gap, ids[4 * gap :], total))
            parts.append(piece)
            gap -= len(piece[2]) // 4
        return parts

    def pack(self):
        """Yield full sequences, longest tier first; what can't fill one more stays waiting."""
        for tier, floor in zip(self.tiers, (*self.tiers[1:], 0)):
            while self._total >= tier and self._lengths[-1] > floor:
                yield tier, self._fill(tier)

    def rest(self):
        """Yield all that waits, in sequences of powers of two."""
        while self._total:
            size = min(1 << (self._total.bit_length() - 1), self.context)
            yield size, self._fill(size)


def step_groups(costs: list[int], size: int) -> list[int]:
    """Group of each sequence: dealt by falling cost, back and forth, into groups of `size`."""
    n = -(-len(costs) // size)
    group = [0] * len(costs)
    for rank, i in enumerate(sorted(range(len(costs)), key=lambda i: (-costs[i], i))):
        lap, at = divmod(rank, n)
        group[i] = at if lap % 2 == 0 else n - 1 - at
    return group


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, tiers: tuple[int, ...] = TIERS, window: int = 4096, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Null text is empty; a document's ids end with id 0, so each has a piece. Repeated rows
    are packed as often as they come; an empty table gives no rows. Columns: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (tokens of the sequence), step_group. `extra` names columns of
    docs that go along; others are not read.
    """
    kept = {c: docs.schema[c].dataType for c in dict.fromkeys((id_col, *extra))}
    own = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    schema = T.StructType([T.StructField(c, t) for c, t in kept.items()] + [T.StructField(c, T.LongType()) for c in own])
    names, tiers, definition = list(kept), tuple(t for t in tiers if t <= context), definition_of(tokenizer_file)

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        encode, packer = Encoder(definition), Packer(context, tiers)
        state = {"sequence": 0, "group": 0}

        def emit(sequences, arrow):
            by_tier: dict[int, list] = {}
            for tier, parts in sequences:
                by_tier.setdefault(tier, []).append(parts)
            docs_out, columns = [], [[] for _ in own]
            for tier in sorted(by_tier, reverse=True):
                costs = [sum((len(p[2]) // 4) ** 2 for p in parts) for parts in by_tier[tier]]
                groups = step_groups(costs, STEP_SEQUENCES)
                for parts, group in zip(by_tier[tier], groups):
                    offset = 0
                    for doc, start, ids, total in parts:
                        n = len(ids) // 4
                        docs_out.append(doc)
                        for column, value in zip(columns, (start, n, zlib.crc32(ids), total, base + state["sequence"], offset, tier, base + state["group"] + group)):
                            column.append(value)
                        offset += n
                    state["sequence"] += 1
                state["group"] += max(groups) + 1
            if docs_out:
                own_columns = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs_out], arrow.field(k).type) for k in range(len(names))] + own_columns, names=[*names, *own])

        arrow = None
        for batch in batches:
            arrow = batch.schema
            for at in range(0, batch.num_rows, window):
                part = batch.slice(at, window)
                rows = list(zip(*(part.column(c).to_pylist() for c in range(len(names)))))
                sequences = []
                for row, text in zip(rows, part.column(len(names)).to_pylist()):
                    sequences += packer.add(row, encode(text or "") + b"\0\0\0\0")
                sequences += packer.pack()
                yield from emit(sequences, arrow)
        if arrow is not None:
            yield from emit(list(packer.rest()), arrow)

    return spread(docs.select(*names, F.col(text_col).alias("_text_to_pack"))).mapInArrow(run, schema)
