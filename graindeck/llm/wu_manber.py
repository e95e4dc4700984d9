"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of an item (SIZE words in a row, or the whole of a shorter item) is a pattern. Patterns of one length
share a shift table over hashed blocks of two words; where it allows no shift, the last block's hash selects a bucket,
whose patterns are compared with the text directly. Equal windows are one pattern with several owners. Tables are
packed arrays.

Items are dealt to blocks of about TABLE_BYTES of text. A block's tables are built by one task, once, and broadcast;
a task searches each batch of documents with one block after the other, so it holds one block at a time, and a row is
judged where it stands when all blocks have been searched, whatever their number.

Defined results: null texts and texts without words have no words, no hits and are not contaminated; a null item has
no pattern; items may repeat (each id counts once); repeated documents are each searched; ties do not arise; a text of
any length is searched whole; an empty benchmark hits nothing; columns other than the ids and texts are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.llm.common import arrow_map, runs_of

#: Words in a window, bytes of item texts in a block, and slots of a shift table for each pair of words in it.
SIZE, TABLE_BYTES, SLOTS = 13, 4 << 20, 16

_LETTERS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    r"""Lower-case A-Z, then the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _digest(block: bytes) -> int:
    return xxhash.xxh3_64_intdigest(block)


@dataclass
class WuManber:
    """Patterns of ``m`` words. text: the items' words; begin, end: a pattern's place there; last: hashes of the
    patterns' last blocks, sorted; owners of pattern i are owners[owned[i]:owned[i + 1]]."""

    m: int
    shift: bytes
    text: bytes
    begin: np.ndarray
    end: np.ndarray
    last: np.ndarray
    owners: np.ndarray
    owned: np.ndarray

    @classmethod
    def build(cls, m: int, items: list[tuple[int, list[bytes]]], slots: int = SLOTS) -> WuManber:
        """items: number and words, at least ``m`` of them."""
        b, default = min(2, m), m - min(2, m) + 1
        lines, offsets, at = [], [], 0
        for _, w in items:
            lines.append(b" ".join(w))
            sizes = np.array([len(x) for x in w])
            offsets.append(at + np.cumsum(sizes + 1) - sizes - 1)
            at += len(lines[-1]) + 1
        size = 1 << max(8, int(slots * sum(len(w) for _, w in items)).bit_length())
        shift = np.full(size, min(default, 255), dtype=np.uint8)
        begins, ends, lasts, owners, whole = [], [], [], [], []
        for (owner, w), line, offset in zip(items, lines, offsets, strict=True):
            blocks = np.array([_digest(b" ".join(w[i - b + 1 : i + 1])) for i in range(b - 1, len(w))], dtype=np.uint64)
            # the nearest end of a window at or behind a block that ends at word i
            steps = np.maximum(0, m - 1 - np.arange(b - 1, len(w)))
            np.minimum.at(shift, (blocks & np.uint64(size - 1)).astype(np.int64), np.minimum(steps, 255).astype(np.uint8))
            first, last = offset[: len(w) - m + 1], offset[m - 1 :]
            stop = last + np.array([len(x) for x in w[m - 1 :]])
            begins.append(first)
            ends.append(stop)
            lasts.append(blocks[m - b :])
            owners.append(np.full(len(first), owner))
            start = int(offset[0])
            whole += [line[x - start : y - start] for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
        begin, end, last, owner = (np.concatenate(x) for x in (begins, ends, lasts, owners))
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(x, len(number)) for x in whole])
        _, one = np.unique(which, return_index=True)
        order = np.argsort(last[one], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[which], owner], axis=1), axis=0)
        owned = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        one = one[order]
        return cls(m, shift.tobytes(), b"\n".join(lines), begin[one], end[one], last[one], pairs[:, 1], owned)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Start and owners of each occurrence."""
        m, n, b, shift, text, last = self.m, len(words), min(2, self.m), self.shift, self.text, self.last
        mask, i = len(shift) - 1, m - 1
        while i < n:
            h = _digest(words[i] if b == 1 else words[i - 1] + b" " + words[i])
            s = shift[h & mask]
            if s:
                i += s
                continue
            at = bisect_left(last, h)
            if at < len(last) and last[at] == h:
                here = b" ".join(words[i - m + 1 : i + 1])
                while at < len(last) and last[at] == h:
                    if text[self.begin[at] : self.end[at]] == here:
                        yield i - m + 1, self.owners[self.owned[at] : self.owned[at + 1]]
                    at += 1
            i += 1


def matchers(items: list[tuple[object, str]], size: int = SIZE) -> tuple[list[WuManber], list[str]]:
    """A matcher for each pattern length, and the item ids as text that the owners number."""
    names = sorted({str(k) for k, _ in items})
    number = {k: i for i, k in enumerate(names)}
    by: dict[int, list[tuple[int, list[bytes]]]] = {}
    for k, text in items:
        if w := words_of(text):
            by.setdefault(min(size, len(w)), []).append((number[str(k)], w))
    return [WuManber.build(n, by[n]) for n in sorted(by)], names


def find(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit stretches of words (start, end) and the numbers of the items found."""
    stretches, owners = [], set()
    for t in tables:
        for start, own in t.search(words):
            stretches.append((start, start + t.m))
            owners.update(own.tolist())
    return stretches, owners


def covered(stretches: list[tuple[int, int]]) -> int:
    total, at = 0, 0
    for s, e in sorted(stretches):
        total += max(0, e - max(s, at))
        at = max(at, e)
    return total


def _blocks(benchmark: DataFrame, size: int, table_bytes: int) -> list[Broadcast]:
    """The matchers of each block of items, built by a task each. The driver passes them on one at a time; a block's size
    is bounded by ``table_bytes`` and its longest item."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length(F.encode("text", "UTF-8"))), F.lit(0))).first()[0]
    if not total:
        return []
    blocks = -(-total // table_bytes)
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks))).select("block", "item_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches):
            table = pickle.dumps(matchers(list(zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True)), size))
            yield pa.RecordBatch.from_arrays([pa.array([table], type=pa.binary())], names=["table"])

    built = arrow_map(dealt.repartition("block").sortWithinPartitions("block"), build, "table binary")
    return [spark.sparkContext.broadcast(bytes(r[0])) for r in built.toLocalIterator()]


def _judged(blocks: list[Broadcast], share: int):
    """A function from texts to rows: words, hit words, sorted ids of the items found, whether contaminated."""
    kept: list[tuple[list[WuManber], list[str]]] = []

    def tables() -> Iterator[tuple[list[WuManber], list[str]]]:
        """One block stays in memory; of several, one at a time is there."""
        if len(blocks) > 1:
            for b in blocks:
                yield pickle.loads(b.value)
                b.__dict__.pop("_value", None)
        else:
            if not kept and blocks:
                kept.append(pickle.loads(blocks[0].value))
            yield from kept

    def of(texts: list[str | None]) -> list[tuple[int, int, list[str], bool]]:
        words = [words_of(t) for t in texts]
        stretches, names = [[] for _ in texts], [set() for _ in texts]
        for matcher, ids in tables():
            for i, w in enumerate(words):
                found, owners = find(w, matcher)
                stretches[i] += found
                names[i].update(ids[x] for x in owners)
        hits = [covered(x) for x in stretches]
        return [(len(w), h, sorted(x), h > 0 and share * h >= len(w)) for w, h, x in zip(words, hits, names, strict=True)]

    return of


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, table_bytes: int = TABLE_BYTES, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit of at least a ``share``-th of the words)."""
    kind = dict(docs.dtypes)["doc_id"]
    blocks = _blocks(benchmark, size, table_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _judged(blocks, share)
        for b in batches:
            rows = of(b.column(1).to_pylist())
            digests = [hashlib.sha256(",".join(names).encode()).hexdigest() for _, _, names, _ in rows]
            numbers = [pa.array(x, type=pa.int64()) for x in ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows])]
            columns = [b.column(0), *numbers, pa.array(digests, type=pa.string()), pa.array([r[3] for r in rows], type=pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return (
        arrow_map(
            docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, table_bytes: int = TABLE_BYTES, share: int = 20) -> DataFrame:
    """The documents, with all their columns, that are not contaminated. A row is judged where it stands, whatever its
    id and whatever the number of blocks."""
    at, blocks = docs.columns.index("text"), _blocks(benchmark, size, table_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _judged(blocks, share)
        for b in batches:
            yield b.filter(pa.array([not r[3] for r in of(b.column(at).to_pylist())], type=pa.bool_()))

    return arrow_map(docs, run, docs.schema)
