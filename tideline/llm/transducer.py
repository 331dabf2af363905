"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Whether a token that ends at some place is final depends only on so many bytes after
it, a number that the merge list fixes (:func:`sufficient_lookahead`). So a pretoken of
any length is encoded in a window: tokens with that many bytes behind them are emitted,
the rest waits for more bytes. Decoding turns ids into bytes, and bytes into text by an
incremental decoder that holds at most an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import Generations, map_batches

#: Characters that the pretokens' pattern counts as white space (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: The pattern of this family of byte-level vocabularies (fixed value).
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Pretokens never cross from a word into the blank after it, so these units hold whole ones.
UNIT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
EDGE = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Characters of a text that are worked on together.
BLOCK = 65_536
#: Longer units are not kept in the cache.
CACHED_CHARS = 64
NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files.

    Visible Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a boundary that settle whether any merge crosses it.

    A merge (a, b) across it needs b to stand there when its turn comes. That depends
    on b's own bytes, and on merges of higher rank that would take b, or the parts it
    is made of, together with what follows. Going through the merges in order,
    ``reach[t]`` is how many bytes from its start settle whether token t stands, as far
    as the merges before say.
    """
    reach: dict[bytes, int] = {}
    most = 1
    for a, b in merges:
        of_a, of_b = reach.get(a, len(a)), reach.get(b, len(b))
        most = max(most, of_b)
        through = len(a) + of_b
        reach[a] = max(of_a, through)
        whole = a + b
        reach[whole] = max(reach.get(whole, 0), len(whole), of_a, through)
    return most


class Merges:
    """Ids, ranks and lookahead of a merge list over bytes."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = tokens
        self.of_byte = [tokens.get(bytes([b])) for b in range(256)]
        self.rank = {(tokens[a], tokens[b]): i for i, (a, b) in enumerate(merges)}
        self.made = [tokens[a + b] for a, b in merges]
        self.size = {i: len(t) for t, i in tokens.items()}
        self.lookahead = sufficient_lookahead(merges)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pretoken: the merge of the best rank, leftmost first, until none applies."""
        ids = [self.of_byte[b] for b in data]
        rank, made = self.rank.get, self.made
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]  # only the pairs beside the new token change
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def stream(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one pretoken that comes in parts, each emitted once it is settled."""
        held = b""
        for part in parts:
            held += part
            if len(held) <= 2 * self.lookahead:
                continue
            at, out = 0, []
            for i in self.encode(held):
                if at + self.size[i] + self.lookahead > len(held):
                    break
                at += self.size[i]
                out.append(i)
            held = held[at:]
            yield out
        yield self.encode(held)


class Codec:
    """Encoder and decoder of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_symbols()
        raw = lambda t: bytes(byte_of[c] for c in t)
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(
            {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)},
            [(raw(a), raw(b)) for a, b in pairs],
        )
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_of = {i: t for t, i in self.merges.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.window = max(64, 2 * self.merges.lookahead)
        self.units = Generations(self._unit)
        self.pretokens = Generations(self._pretoken)

    def _unit(self, unit: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of the pretokens of a short unit."""
        return b"".join(map(self.pretokens.__getitem__, PRETOKEN.findall(unit)))

    def _pretoken(self, pretoken: str) -> bytes:
        ids = self.merges.encode(pretoken.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _long(self, unit: str) -> Iterator[bytes]:
        """The same for one of any length, in bounded parts."""
        for m in PRETOKEN.finditer(unit):
            a, b = m.span()
            parts = (unit[i : min(i + self.window, b)].encode() for i in range(a, b, self.window))
            for ids in self.merges.stream(parts):
                yield np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, in parts."""
        for piece in self.apart.split(text) if self.apart else [text]:
            if piece in self.special:
                yield np.array([self.special[piece]], "<u4").tobytes()
                continue
            start = 0
            while start < len(piece):
                cut = EDGE.search(piece, start + BLOCK) if len(piece) - start > BLOCK else None
                end = cut.start() if cut else len(piece)
                units = UNIT.findall(piece[start:end])
                if max(map(len, units)) <= CACHED_CHARS:
                    yield b"".join(map(self.units.__getitem__, units))
                else:
                    for u in units:
                        if len(u) <= CACHED_CHARS:
                            yield self.units[u]
                        else:
                            yield from self._long(u)
                start = end

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Text of ids that come in parts; malformed bytes become U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        token = self.bytes_of.__getitem__
        for ids in parts:
            yield decoder.decode(b"".join(map(token, np.frombuffer(ids, "<u4").tolist())))
        yield decoder.decode(b"", final=True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids and of the decoded text, without keeping either."""
        count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def passing() -> Iterator[bytes]:
            nonlocal count
            for ids in self.encode(text):
                count += len(ids) // 4
                of_ids.update(ids)
                yield ids

        for s in self.decode(passing()):
            of_text.update(s.encode())
        return count, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of this process, with what it remembers from earlier tasks."""
    return Codec(path)


def encode_column(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` of every row; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = [np.frombuffer(b"".join(c.encode(t or "")), "<u4") for t in batch.column(1).to_pylist()]
        return {key: batch.column(0), "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))}

    return map_batches(df.select(key, text), run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode_column(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of every row; null ids give null."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        texts = [
            None if i is None else "".join(c.decode([np.array(i, "<u4").tobytes()])) for i in batch.column(1).to_pylist()
        ]
        return {key: batch.column(0), "text": pa.array(texts, pa.string())}

    return map_batches(df.select(key, ids), run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    Null texts count as empty. Ids and decoded text pass through the digests in parts
    and are never held whole. Repeated rows give the same row again.
    """

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        rows = [c.digest(t or "") for t in batch.column(1).to_pylist()]
        kinds = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
        return {key: batch.column(0)} | {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)}

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(df.select(key, text), run, schema)
