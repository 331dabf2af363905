"""Packing of tokenized examples into sequences by vector bin packing.

A sequence is a bin with three capacities: tokens, segments and loss-bearing tokens.
An example goes to the open bin whose free capacities point most in the direction of
its demands (largest dot product) among those with room in every dimension.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tideline.llm.common import utf8
from tideline.llm.tokens import encoder

END_ID = 2
TOKENS = 4096
SEGMENTS = 256
#: Bins a task keeps open; bounds its memory and the time an example takes.
OPEN_BINS = 32
#: Sequence numbers of a task follow its number in these upper bits.
TASK_BITS = 32


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length`` of an example; ``loss`` of them bear loss."""

    example: object
    start: int
    length: int
    loss_from: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.example, self.start, n, self.loss_from)
        return head, Piece(self.example, self.start + n, self.length - n, self.loss_from)


@dataclass
class Limits:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS

    def fit(self, piece: Piece, tokens: int, loss: int) -> int:
        """How many leading tokens of ``piece`` have room in so much free capacity."""
        before = max(0, min(piece.length, piece.loss_from - piece.start))
        return min(piece.length, tokens, before + loss)


@dataclass
class Packer:
    """Takes examples one by one; ``closed`` collects finished sequences."""

    limits: Limits
    open_bins: int = OPEN_BINS
    bins: list[list[Piece]] = field(default_factory=list)
    closed: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        full = (self.limits.tokens, self.limits.segments, self.limits.loss)
        self.scale = np.array(full, float)
        self.free = np.zeros((0, 3), np.int64)

    def add(self, piece: Piece) -> None:
        while piece.length:
            whole = self.limits.fit(piece, self.limits.tokens, self.limits.loss)
            if whole < piece.length or whole == self.limits.tokens:
                head, piece = piece.cut(whole)
                self._close([head])
                continue
            need = np.array((piece.length, 1, piece.loss))
            room = (self.free >= need).all(1)
            if room.any():
                fit = (self.free / self.scale) @ (need / self.scale)
                self._put(int(np.where(room, fit, -1).argmax()), piece)
                return
            if len(self.bins) < self.open_bins:
                self.bins.append([])
                self.free = np.vstack([self.free, np.array(self.scale, np.int64)])
                self._put(len(self.bins) - 1, piece)
                return
            # no bin has room for all of it: top up the fullest one
            at = int(self.free[:, 0].argmin())
            n = self.limits.fit(piece, int(self.free[at, 0]), int(self.free[at, 2]))
            if n:
                head, piece = piece.cut(n)
                self._put(at, head)
            else:
                self._drop(at)

    def _put(self, at: int, piece: Piece) -> None:
        self.bins[at].append(piece)
        self.free[at] -= (piece.length, 1, piece.loss)
        if self.free[at, 0] == 0 or self.free[at, 1] == 0:
            self._drop(at)

    def _drop(self, at: int) -> None:
        self._close(self.bins.pop(at))
        self.free = np.delete(self.free, at, 0)

    def _close(self, pieces: list[Piece]) -> None:
        """Sequences of the pieces: one if full, else of as many tokens as powers of two."""
        left = sum(p.length for p in pieces)
        if left == self.limits.tokens:
            self.closed.append(pieces)
            return
        queue = pieces[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            row = []
            while size:
                piece = queue.pop()
                if piece.length > size:
                    piece, rest = piece.cut(size)
                    queue.append(rest)
                size -= piece.length
                row.append(piece)
            self.closed.append(row)

    def finish(self) -> None:
        """Fills sequences from the open bins one after another; only the last has a rest."""
        pieces = [p for b in self.bins for p in b]
        self.bins, self.free = [], self.free[:0]
        row, tokens, loss = [], 0, 0
        for piece in pieces:
            while piece.length:
                n = 0
                if len(row) < self.limits.segments:
                    n = self.limits.fit(piece, self.limits.tokens - tokens, self.limits.loss - loss)
                if not n:
                    self._close(row)
                    row, tokens, loss = [], 0, 0
                    continue
                head, piece = piece.cut(n)
                row.append(head)
                tokens, loss = tokens + n, loss + head.loss
        if row:
            self._close(row)


SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, n_loss bigint,"
    " sequence_id bigint, offset bigint"
)


def pack(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    limits: Limits | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: where it stands in its example and in its sequence.

    An example is ``prompt`` (without loss; if such a column is named), ``text`` and an
    end id. Null texts count as empty, so each row has at least its end id. Examples
    longer than a sequence are cut; others are cut only where no open bin has room.
    Full sequences have ``limits.tokens`` ids; the rests left at a task's end or by the
    other limits are cut into powers of two, which need no padding. ``with_ids`` adds
    the ids of each piece.

    Each task packs the rows it reads in their order, with ``OPEN_BINS`` bins open, and
    numbers its sequences below its own upper bits: a task that runs again gives the
    same rows. Repeated rows are packed as often as they occur.
    """
    limits = limits or Limits()
    columns = [key, text, *([prompt] if prompt else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(limits)
        number = TaskContext.get().partitionId() << TASK_BITS

        def flush() -> pa.RecordBatch | None:
            nonlocal number
            rows = []
            for sequence in packer.closed:
                offset = 0
                for p in sequence:
                    name, ids = p.example
                    part = ids[4 * p.start : 4 * (p.start + p.length)]
                    rows.append((name, p.start, p.length, zlib.crc32(part), len(ids) // 4, p.loss, number, offset, part))
                    offset += p.length
                number += 1
            packer.closed.clear()
            if not rows:
                return None
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cols[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            kind = batch.schema.field(0).type
            heads = utf8(batch.column(2)) if prompt else [None] * len(batch)
            for name, t, head in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), heads):
                before = encode(head or b"")
                ids = before + encode(t or b"") + np.array([END_ID], "<u4").tobytes()
                packer.add(Piece((name, ids), 0, len(ids) // 4, len(before) // 4))
                if len(packer.closed) >= 256 and (out := flush()):
                    yield out
        packer.finish()
        if out := flush():
            yield out

    names = [key, *(f.split()[0] for f in SCHEMA.split(", ")), *(["ids"] if with_ids else [])]
    schema = f"`{key}` {dict(df.dtypes)[key]}, {SCHEMA}" + (", ids array<int>" if with_ids else "")
    return df.select(*columns).mapInArrow(run, schema)
