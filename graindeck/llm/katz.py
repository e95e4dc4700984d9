"""LM scoring: a Katz back-off model of any order with Good-Turing discounts and exactly normalised back-off weights.

The model covers the words of the training texts, the end of a text and one event for all unknown words; over these
the probabilities after any history sum to 1. A token is evaluated recursively: by its discounted count if its n-gram
was seen, else by the back-off weight of the words before it times its probability after one word less, down to the
discounted unigram. The first word of a text follows an end; histories never reach over the start of a text.

Counts of counts are smoothed by a line through their logarithms, so the Good-Turing discounts lie between 0 and 1 on
any corpus. Counts are exact and of the whole corpus. Texts are tokenised once into chunks of a bounded number of
tokens. For each order a chunk sends its n-grams, dealt by the hash of their context (those of very frequent contexts
by the word too), as sorted columns of word ids, and gets their counts and the sums of their contexts back. A context
that occurs in one chunk only is worked out there and not sent. These answers, by n-gram and chunk, are the model's
tables. Words get their ids in the first exchange: small ones for frequent words, so that sorted columns pack well.

A chunk deals to FAN realms, so rows grow in proportion to the input. Beyond GROUP chunks the exchange has more
levels: what GROUP chunks sent to a realm is merged, dealt to FAN realms of its own, and the answers come back the
same way; every task then still holds a bounded number of n-grams. Only totals, counts of counts and the sums of at
most HEAVY frequent contexts reach the driver.

Defined results: a null text is empty and has one token, its end; repeated rows are each scored, and counted if in
the training fold; ties do not arise, as nothing is ranked; a text of any length is part of one chunk; columns other
than doc_id and text are ignored, whatever their names; an empty table gives an empty result; without training texts
all tokens are unknown and the score is 0 (the one event has probability 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.llm.common import Run, arrow_map, fold_of, released, runs_of, trimmed

#: Words of the longest n-gram, and counts that Good-Turing discounts reach to.
ORDER, REACH = 3, 5
#: Tokens of a chunk, realms that a chunk deals to, and chunks whose n-grams meet in one step (a task holds those of
#: GROUP / FAN chunks, at any number of levels).
CHUNK_TOKENS, FAN, GROUP = 500_000, 64, 320
#: Contexts whose n-grams are dealt by their word too: those with more than this share of the tokens, so at most HEAVY.
HEAVY = 65_536
#: Slopes of the line through the counts of counts: what a corpus of words can have.
STEEPEST, FLATTEST = -6.0, -1.1

_END = b""
_ZSTD = pa.Codec("zstd", compression_level=1)


def tokens_of(text: str | None) -> list[bytes]:
    r"""Lower-case A-Z, the words `[^\x20\x09-\x0D]+` as UTF-8, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(_END)
    return words


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the number of words of each: ``tokens_of`` less the ends, by batch."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(plain)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)] = 0  # split to one empty word
    flat = lists.flatten()
    return flat.filter(pc.greater(pc.binary_length(flat), 0)), sizes


def packed(a: np.ndarray) -> bytes:
    """Numbers of eight bytes as compressed planes of bytes; planes of small or sorted numbers take little room."""
    a = a if a.dtype == np.float64 else a.astype(np.int64)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpacked(b: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(b[8:], 8 * n), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def mixed(a: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def good_turing(of: list[int], reach: int = REACH) -> np.ndarray:
    """Discounts (index r for a count of r, 1 beyond ``reach``) from the numbers of n-grams seen 1, 2, ... times.

    With n_r smoothed to a r^b, Turing's r* = (r + 1) n_(r+1) / n_r gives r* / r = (1 + 1/r)^(b+1). Katz's correction
    keeps the mass that is freed that of the n-grams seen once, though counts beyond ``reach`` stay as they are.
    """
    r, n = np.arange(1, reach + 2), np.array(of, dtype=np.float64)
    slope = -2.0
    if (n > 0).sum() > 1:
        slope = float(np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)[0])
    power = min(max(slope, STEEPEST), FLATTEST) + 1
    d, cut = np.ones(reach + 2), (reach + 1.0) ** power
    d[1 : reach + 1] = ((1 + 1 / r[:reach]) ** power - cut) / (1 - cut)
    return d


@dataclass
class Sums:
    """Of contexts by key: n-grams seen 1..REACH times, summed counts of the others, summed lower probabilities."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rare: np.ndarray = field(default_factory=lambda: np.zeros((0, REACH), np.int64))
    more: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.rare[at], self.more[at], self.below[at]


@dataclass
class Model:
    """What all chunks share: totals, discounts by order, sums of heavy contexts by order.

    seen: by order, the numbers of n-grams seen 1..REACH+1 times.
    """

    total: int = 0
    types: int = 0
    seen: list[list[int]] = field(default_factory=lambda: [[0] * (REACH + 1)])
    heavy: dict[int, Sums] = field(default_factory=dict)

    def ready(self) -> Model:
        self.d = [good_turing(n) for n in self.seen]
        lost = sum((1 - self.d[0][r]) * r * self.seen[0][r - 1] for r in range(1, REACH + 1)) / max(1, self.total)
        # without any rare word nothing is freed: then all counts give way to one more event
        self.base_total = max(1, self.total) + (lost <= 0 and self.total > 0)
        self.unknown = lost if lost > 0 else 1 / (self.total + 1)
        self.bar = max(1, self.total // HEAVY)
        return self

    def discounted(self, order: int, counts: np.ndarray, base: np.ndarray | int) -> np.ndarray:
        """Probabilities of seen n-grams; ``base``: the count of the context, and 1 if that context has no rare ones."""
        return self.d[order - 1][np.minimum(counts, REACH + 1)] * counts / base

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with these training counts; 0 is the event of all unknown words."""
        return np.where(c > 0, self.discounted(1, c, self.base_total), self.unknown)

    def backoff(self, order: int, count: np.ndarray, rare: np.ndarray, more: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-off weights of contexts, and which of them have no rare n-gram: their counts give way to one event."""
        full = rare.sum(axis=1) == 0
        kept = ((rare * np.arange(1, REACH + 1)) @ self.d[order - 1][1 : REACH + 1] + more) / (np.maximum(count, 1) + full)
        return (1 - kept) / np.maximum(1 - below, 1e-300), full

    def flat(self, c: np.ndarray) -> np.ndarray:
        """Add-one unigrams."""
        return np.log10((c + 1) / (self.total + (self.types + 1)))


#: Rows of all exchanges. kind: _OWN (a chunk), _SLICE (n-grams), _SPREAD (counts of counts), _MAP (how slices were
#: merged), _FOUND (answers), _HEAVY (sums of a part of a context).
_ROW = "grp bigint, realm bigint, src bigint, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["grp", "realm", "src", "kind", "a", "b", "c", "d", "e", "f"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
_OWN, _SLICE, _SPREAD, _MAP, _FOUND, _HEAVY = range(6)


def _batch(*row) -> pa.RecordBatch:
    """One row: grp, realm, src, kind and up to six binaries."""
    row = (*row, *[None] * (len(_KINDS) - len(row)))
    return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, _KINDS, strict=True)], names=_NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal grp together, in the order of kind, realm and source.

    Here and where they are read, what belongs to a group is let go of before the next one comes.
    """
    for _, t in runs_of(batches):
        rows = sorted(t.to_pylist(), key=lambda r: (r["kind"], r["realm"], r["src"]))
        del t
        yield rows
        del rows
        trimmed(cycles=False)
    trimmed()


def _chunks(docs: DataFrame, modulus: int, held_out: int, chunk_tokens: int) -> DataFrame:
    """Chunks: a = lengths and folds, b = places of the tokens' words, c = sorted word hashes, d = the words' places in
    that order, e = ids of the documents as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, words, number, size = [], [], [], 0, 0
        home = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays(words).dictionary_encode()
            distinct = [*coded.dictionary.cast(pa.binary()).to_pylist(), _END]
            lens = np.concatenate(sizes) + 1
            flat = np.full(int(lens.sum()), len(distinct) - 1)
            word = np.ones(len(flat), dtype=bool)
            word[np.cumsum(lens) - 1] = False
            flat[word] = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(flat, minlength=len(distinct)), kind="stable")  # frequent words get small places
            to = np.empty_like(order)
            to[order] = np.arange(len(order))
            hashes = np.array([xxhash.xxh3_64_intdigest(distinct[i]) for i in order], dtype=np.uint64).view(np.int64)
            by_hash = np.argsort(hashes)
            held = np.array([fold_of(i, modulus) == held_out for i in ids])
            names = pa.RecordBatch.from_arrays([pa.array(ids, type=id_type)], names=["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, names.schema) as out:
                out.write_batch(names)
            columns = (lens * 2 + held, to[flat], np.diff(hashes[by_hash], prepend=0), by_hash)
            return _batch(home + number, 0, home + number, _OWN, *[packed(x) for x in columns], sink.getvalue().to_pybytes())

        for b in batches:
            id_type = b.schema.field(0).type
            flat, n = split_words(b.column(1))
            keys, tokens, begin, at = b.column(0).to_pylist(), np.cumsum(n + 1), 0, 0
            while begin < len(keys):
                # as many texts as fill the chunk; a text is not cut
                before = int(tokens[begin - 1]) if begin else 0
                end = min(len(keys), int(np.searchsorted(tokens, before + chunk_tokens - size)) + 1)
                count = int(n[begin:end].sum())
                ids += keys[begin:end]
                sizes.append(n[begin:end])
                words.append(flat.slice(at, count))
                size, at, begin = size + int(tokens[end - 1]) - before, at + count, end
                if size >= chunk_tokens:
                    yield flush()
                    ids, sizes, words, number, size = [], [], [], number + 1, 0
                    trimmed(cycles=False)
        if ids:
            yield flush()
        trimmed()

    return arrow_map(docs.select("doc_id", "text"), run, _ROW)


# n-grams on their way: sorted by realm, context and word. A context is the ids of its words (of single words, the hash
# of the word, which is its own context). low: the count of the n-gram less its first word, base: that of its context's


def _key(context: list[np.ndarray]) -> np.ndarray:
    """A hash of the context's ids; of one id, the id."""
    key = context[0]
    for ids in context[1:]:
        key = _longer(key, ids)
    return key


def _longer(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed(key * np.int64(0x1000193) + ids).view(np.int64)


def _realms(keys: np.ndarray, words: np.ndarray, heavy: np.ndarray | None, level: int, fan: int) -> np.ndarray:
    h = mixed(keys)
    if heavy is not None and heavy.any():
        h ^= np.where(heavy, mixed(words.astype(np.uint64) + np.uint64(77)), np.uint64(0))
    return ((h >> np.uint64(3)) // np.uint64(fan**level) % np.uint64(fan)).astype(np.uint16 if fan <= 1 << 16 else np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def _ranges(sorted_realms: np.ndarray, fan: int) -> Iterator[tuple[int, int, int]]:
    """Realm, begin and end of each that occurs."""
    ends = np.cumsum(np.bincount(sorted_realms, minlength=fan))
    for r, end in enumerate(ends):
        begin = ends[r - 1] if r else 0
        if end > begin:
            yield r, int(begin), int(end)


def _slice(realm: int, src: int, context: list[np.ndarray], owner: np.ndarray, words, low, seen, shared, base, heavy) -> pa.RecordBatch:
    """context, base and heavy are by context, the rest by n-gram; owner: the place of its context, ascending."""
    at = _starts(owner)
    own = owner[at]
    first, *more = [c[own] for c in context]
    steps = np.diff(words, prepend=0)
    steps[at] = words[at]
    columns = (np.diff(np.r_[at, len(owner)]), steps, low, seen * 2 + shared, base[own] * 2 + heavy[own])
    names = b"".join(len(x).to_bytes(8, "little") + x for x in (packed(np.diff(first, prepend=0)), *map(packed, more)))
    return _batch(0, realm, src, _SLICE, names, *[packed(x) for x in columns])


def _opened(row: dict) -> list:
    """Context ids, numbers of n-grams, words, low, seen, base of a slice."""
    context, at = [], 0
    while at < len(row["a"]):
        size = int.from_bytes(row["a"][at : at + 8], "little")
        context.append(unpacked(row["a"][at + 8 : at + 8 + size]))
        at += 8 + size
    context[0] = np.cumsum(context[0])
    sizes, steps, low, seen, base = (unpacked(row[c]) for c in "bcdef")
    words, begin = np.cumsum(steps), np.cumsum(sizes) - sizes
    words -= np.repeat(words[begin] - steps[begin], sizes)
    return [context, sizes, words, low, seen, base]


def _numbered(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs among the distinct ones in their order, and a pair for each place."""
    low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    many = int(row.max()) + 1 if len(row) else 1
    if many * (high - low + 1) < 1 << 62:
        code = row * (high - low + 1) + (ids - low)
    else:
        values, place = np.unique(ids, return_inverse=True)
        code = row * len(values) + place
    _, at = np.unique(code, return_inverse=True)
    one = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
    one[at] = np.arange(len(at))
    return at, one


class _Slices:
    """The slices of a realm, together: distinct n-grams in the order of context and word, and where each slice's are."""

    def __init__(self, rows: list[dict]):
        rows = [r for r in rows if r["kind"] == _SLICE]
        parts = [_opened(r) for r in rows]
        self.sources = [r["src"] for r in rows]
        self.contexts_of = [len(p[1]) for p in parts]
        self.grams_of = [len(p[2]) for p in parts]
        none = np.zeros(0, np.int64)
        context = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)] or [none]
        sizes, words, low, seen, base = (np.concatenate([none, *(p[i] for p in parts)]) for i in range(1, 6))
        del parts
        self.context_at = np.zeros(len(sizes), np.int64)
        for ids in context:
            self.context_at, first = _numbered(self.context_at, ids)
        self.context = [ids[first] for ids in context]
        self.base, self.heavy = base[first] >> 1, (base[first] & 1) == 1
        row = np.repeat(self.context_at, sizes)
        self.gram_at, one = _numbered(row, words)
        self.owner, self.words, self.low = row[one], words[one], low[one]
        self.counts = np.bincount(self.gram_at, weights=seen >> 1, minlength=len(one)).astype(np.int64)
        self.shared = (np.bincount(self.gram_at, minlength=len(one)) > 1) | (np.bincount(self.gram_at, weights=seen & 1, minlength=len(one)) > 0)

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Source, places of its contexts, places of its n-grams."""
        c = g = 0
        for src, n, m in zip(self.sources, self.contexts_of, self.grams_of, strict=True):
            yield src, self.context_at[c : c + n], self.gram_at[g : g + m]
            c, g = c + n, g + m


def _spread(rows: list[dict]) -> np.ndarray:
    """Counts of counts that chunks found on their own."""
    return sum((unpacked(r["a"]) for r in rows if r["kind"] == _SPREAD), np.zeros(REACH + 1, np.int64))


def _merge(level: int, fan: int):
    """What a group of sources sent to a realm as one source that deals to the realm's own realms. _MAP rows say where a
    slice's n-grams are (a), where its contexts begin in it (b) and where in the merged one (c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            realm, group, s = rows[0]["realm"], rows[0]["grp"] & 0xFFFFFFFF, _Slices(rows)
            part = _realms(_key(s.context)[s.owner], s.words, s.heavy[s.owner], level, fan)
            order = np.argsort(part, kind="stable")
            to, first = np.empty_like(order), np.empty(len(s.base), np.int64)
            to[order] = np.arange(len(order))
            first[s.owner[order][::-1]] = np.arange(len(order))[::-1]
            for p, lo, hi in _ranges(part[order], fan):
                own = order[lo:hi]
                yield _slice(realm * fan + p, group, s.context, s.owner[own], s.words[own], s.low[own], s.counts[own], s.shared[own], s.base, s.heavy)
            for src, contexts, at in s.each():
                yield _batch(0, realm, src, _MAP, packed(to[at]), packed(_starts(s.owner[at])), packed(first[contexts]))
            yield _batch(0, realm * fan, group, _SPREAD, packed(_spread(rows)))
            del rows, s, part, order, to, first

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to a merged source, back to the sources it was merged of."""
    for rows in _rows(batches):
        answers = [r for r in rows if r["kind"] == _FOUND]
        if not answers:
            continue
        counts, ids, asked, rare, more = (np.concatenate([unpacked(r[c]) for r in answers]) for c in "abfcd")
        below = np.concatenate([unpacked(r["e"], np.float64) for r in answers])
        rare, place = rare.reshape(-1, REACH), np.cumsum(asked) - 1
        for r in rows:
            if r["kind"] == _MAP:
                at, begin, first = (unpacked(r[c]) for c in "abc")
                with_sums, flags = asked[first] == 1, np.zeros(len(at), np.int64)
                mine = place[first[with_sums]]
                flags[begin[with_sums]] = 1
                sums = (packed(rare[mine].ravel()), packed(more[mine]), packed(below[mine]))
                yield _batch(0, r["realm"], r["src"], _FOUND, packed(counts[at]), packed(ids[at]), *sums, packed(flags))


def _count(order: int, model: Model, realms: int):
    """Answers by n-gram: a = counts and whether several sources have it, b = ids of single words, f = which n-grams come with the sums of their context, c, d,
    e = those sums (see Sums). Of the n-grams of a context one brings them, and only if one of them was never seen or
    none is rare. Sums of heavy contexts come by key; the total of a realm is its kinds of words, their counts and
    counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            realm, s = rows[0]["realm"], _Slices(rows)
            there = s.counts > 0
            owner, c = s.owner[there], s.counts[there]
            n = len(s.base)
            ids = np.zeros(len(s.counts), np.int64)
            rare = more = below = full = None
            if order == 1:
                # ids are small for frequent words and distinct over realms
                ids[np.argsort(-s.counts, kind="stable")] = np.arange(len(ids)) * realms + realm
            else:
                rare = np.stack([np.bincount(owner[c == r], minlength=n) for r in range(1, REACH + 1)], axis=1)
                more = np.bincount(owner, weights=np.where(c > REACH, c, 0), minlength=n).astype(np.int64)
                lower = model.discounted(order - 1, s.low[there], s.base[owner])
                below = np.bincount(owner, weights=lower, minlength=n)
                full = rare.sum(axis=1) == 0
            for src, contexts, at in s.each():
                columns = [packed(s.counts[at] * 2 + s.shared[at]), packed(ids[at])]
                if order == 1:
                    yield _batch(0, realm, src, _FOUND, *columns, *[packed(np.zeros(0, np.int64))] * 3, packed(np.zeros(len(at), np.int64)))
                    continue
                begin = _starts(s.owner[at])
                unseen = np.add.reduceat((s.counts[at] == 0).astype(np.int64), begin) > 0 if len(at) else np.zeros(0, bool)
                ask = (unseen | full[contexts]) & ~s.heavy[contexts]
                asked, mine = np.zeros(len(at), np.int64), contexts[ask]
                asked[begin[ask]] = 1
                yield _batch(0, realm, src, _FOUND, *columns, packed(rare[mine].ravel()), packed(more[mine]), packed(below[mine]), packed(asked))
            if order > 1 and s.heavy.any():
                h = s.heavy
                yield _batch(0, realm, 0, _HEAVY, packed(_key(s.context)[h]), packed(rare[h].ravel()), packed(more[h]), packed(below[h]))
            totals = np.bincount(c[c <= REACH + 1], minlength=REACH + 2)[1:] + _spread(rows)
            yield _batch(0, realm, 0, _SPREAD, packed(np.r_[len(c), c.sum(), totals]))
            del rows, s, there, owner, c, ids, rare, more, below, full

    return run


def _exchange(run: Run, sends: DataFrame, order: int, model: Model, sources: int, fan: int, group: int) -> DataFrame:
    """Answers to the slices that sources sent, by realm and source."""
    least = int(run.spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.col("kind")

    def gathered(df: DataFrame, grp: Column) -> DataFrame:
        return df.withColumn("grp", grp.cast("bigint")).repartition(max(least, fan), "grp").sortWithinPartitions("grp")

    levels, most = [], group
    while sources > most:
        sources, most = -(-sources // most), fan  # what is merged is dealt to fan realms, so fan of them are as much again
        met = F.col("realm") * F.lit(1 << 32) + F.pmod(F.xxhash64("src"), F.lit(sources))
        merged = run.stored(arrow_map(gathered(sends, met), _merge(len(levels) + 1, fan), _ROW), f"merged{order}")
        sends = merged.where(kind != _MAP)
        levels.append((merged, met))
    answers = run.stored(arrow_map(gathered(sends, F.col("realm")), _count(order, model, fan ** (len(levels) + 1)), _ROW), f"counted{order}")
    found, rest = answers.where(kind == _FOUND), answers.where(kind != _FOUND)
    for merged, met in reversed(levels):
        back = found.withColumn("grp", F.floor(F.col("realm") / fan) * F.lit(1 << 32) + F.col("src"))
        both = back.unionByName(merged.where(kind == _MAP).withColumn("grp", met))
        found = run.stored(arrow_map(gathered(both, F.col("grp")), _split, _ROW), f"split{order}")
        run.discarded(merged)
    return found.unionByName(rest) if levels else answers


@dataclass
class _Grams:
    """Distinct n-grams of a chunk: place of prefix and suffix among those of the order below, training counts here and
    in all, place of the last word, key as a context, and whether no other chunk has it. which: of each token, -1 where
    the text has begun too late."""

    which: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    own: np.ndarray
    last: np.ndarray
    key: np.ndarray
    counts: np.ndarray | None = None
    alone: np.ndarray | None = None
    p: np.ndarray | None = None


class _Chunk:
    """A chunk and what it knows of its n-grams up to an order, from the answers to the orders that were exchanged."""

    def __init__(self, rows: list[dict], model: Model, fan: int):
        self.model, self.fan = model, fan
        own = next(r for r in rows if r["kind"] == _OWN)
        self.src, self.names = own["src"], own["e"]
        self.lens = unpacked(own["a"])
        self.sizes = self.lens >> 1
        self.held = np.repeat(self.lens & 1, self.sizes) == 1
        starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(self.sizes.sum()) - np.repeat(starts, self.sizes)  # of a token in its text
        self.answers: dict[int, list[dict]] = {}
        for r in rows:
            if r["kind"] == _FOUND:
                self.answers.setdefault(r["order"], []).append(r)
        tokens, self.ids, found = unpacked(own["b"]), np.cumsum(unpacked(own["c"])), unpacked(own["d"])
        counts, alone = found >> 1, (found & 1) == 0
        seen = np.bincount(tokens[~self.held], minlength=len(counts))
        words = np.arange(len(counts))
        self.orders = [_Grams(tokens, words, words, seen, words, self.ids, counts, alone, model.unigram(counts))]
        self.full = np.zeros(len(counts), dtype=bool)  # of the words, as contexts

    def grow(self) -> None:
        """The n-grams of the next order."""
        low, n = self.orders[-1], len(self.orders) + 1
        there = self.place >= n - 2
        before = np.roll(low.which, 1)  # the word before a text's first is the end
        pair = before[there] * len(low.own) + low.which[there]
        pairs, at = np.unique(pair, return_inverse=True)
        which = np.full(len(there), -1, dtype=np.int64)
        which[there] = at
        prefix, suffix = np.divmod(pairs, max(1, len(low.own)))
        last = low.last[suffix]
        key = _longer(low.key[prefix], self.ids[last])
        self.orders.append(_Grams(which, prefix, suffix, np.bincount(at[~self.held[there]], minlength=len(pairs)), last, key))

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the highest order the n-grams to send, by realm, and those: the ones after known contexts that other chunks have
        too. Places of n-grams are in the order of their words' ids."""
        g, low = self.orders[-1], self.orders[-2]
        out = np.flatnonzero((~low.alone & (low.counts > 0))[g.prefix])
        heavy = low.counts > self.model.bar
        part = _realms(low.key[g.prefix[out]], self.ids[g.last[out]], heavy[g.prefix[out]], 0, self.fan)
        order = np.argsort(part, kind="stable")
        return out[order], part[order]

    def slices(self) -> Iterator[pa.RecordBatch]:
        g, low, n = self.orders[-1], self.orders[-2], len(self.orders)
        out, part = self.sent()
        if n == 2:
            base = np.full(len(low.own), self.model.base_total)
        else:  # an n-gram less its first word follows the context's suffix
            base = (self.orders[-3].counts + self.full)[low.suffix]
        context, at = [], np.arange(len(low.own))
        for grams in reversed(self.orders[:-1]):
            context.insert(0, self.ids[grams.last[at]])
            at = grams.prefix[at]
        heavy = low.counts > self.model.bar
        for p, lo, hi in _ranges(part, self.fan):
            own = out[lo:hi]
            yield _slice(p, self.src, context, g.prefix[own], self.ids[g.last[own]], low.counts[g.suffix[own]], g.own[own], 0, base, heavy)
        alone = g.own[low.alone[g.prefix] & (g.own > 0)]
        yield _batch(0, self.src % self.fan, self.src, _SPREAD, packed(np.bincount(alone[alone <= REACH + 1], minlength=REACH + 2)[1:]))

    def learn(self) -> None:
        """Counts and probabilities of the highest order, from the answers."""
        g, low, n, model = self.orders[-1], self.orders[-2], len(self.orders), self.model
        out, _ = self.sent()
        g.counts, g.alone = g.own.copy(), low.alone[g.prefix]  # right where the context is in this chunk only, or unknown
        weight, full = np.ones(len(low.own)), np.zeros(len(low.own), dtype=bool)
        found = self.answers.get(n, [])
        if len(out):
            counts = np.concatenate([unpacked(r["a"]) for r in found])
            g.counts[out], g.alone[out] = counts >> 1, (counts & 1) == 0
            asked = np.concatenate([unpacked(r["f"]) for r in found]) == 1
            rare, more = (np.concatenate([unpacked(r[c]) for r in found]) for c in "cd")
            below = np.concatenate([unpacked(r["e"], np.float64) for r in found])
            contexts = g.prefix[out[asked]]
            weight[contexts], full[contexts] = model.backoff(n, low.counts[contexts], rare.reshape(-1, REACH), more, below)
            heavy = low.counts > model.bar
            there = np.zeros(len(heavy), dtype=bool)
            there[g.prefix[out]] = True
            heavy = np.flatnonzero(heavy & there)
            if len(heavy):
                weight[heavy], full[heavy] = model.backoff(n, low.counts[heavy], *model.heavy[n].of(low.key[heavy]))
        alone = np.flatnonzero(low.alone[g.prefix] & (g.own > 0))
        if len(alone):
            begin, c = _starts(g.prefix[alone]), g.own[alone]
            contexts, owner = g.prefix[alone[begin]], np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(alone)]))
            rare = np.stack([np.bincount(owner[c == r], minlength=len(contexts)) for r in range(1, REACH + 1)], axis=1)
            more = np.bincount(owner, weights=np.where(c > REACH, c, 0)).astype(np.int64)
            below = np.bincount(owner, weights=low.p[g.suffix[alone]])
            weight[contexts], full[contexts] = model.backoff(n, low.counts[contexts], rare, more, below)
        base = np.maximum(low.counts, 1) + full
        g.p = np.where(g.counts > 0, model.discounted(n, g.counts, base[g.prefix]), weight[g.prefix] * low.p[g.suffix])
        self.full = full

    def scores(self) -> pa.RecordBatch:
        words = self.orders[0]
        log = np.log10(words.p)[words.which]
        for g in self.orders[1:]:
            there = g.which >= 0
            log[there] = np.log10(g.p)[g.which[there]]
        starts = np.cumsum(self.sizes) - self.sizes
        total = lambda x: np.add.reduceat(x, starts)
        flat, known = total(self.model.flat(words.counts)[words.which]), total((words.counts > 0)[words.which].astype(np.int64))
        ids = pa.ipc.open_stream(self.names).read_all().column(0).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        n = pa.array(np.full(len(self.lens), self.model.total))
        columns = [ids, pa.array((self.lens & 1) == 1), pa.array(self.sizes), pa.array(known), n, pa.array(flat), pa.array(total(log))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _word_order(hash_steps: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, realms and the order in which a chunk sends its words: by realm, and within it by hash."""
    hashes = np.cumsum(hash_steps)
    realms = _realms(hashes, hashes, None, 0, fan)
    return hashes, realms, np.argsort(realms, kind="stable")


def _send_words(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lens, tokens, steps, by_hash = (unpacked(r[c]) for c in "abcd")
                train = np.repeat(lens & 1, lens >> 1) == 0
                counts = np.bincount(tokens[train], minlength=len(by_hash))[by_hash]
                hashes, realms, order = _word_order(steps, fan)
                none = np.zeros(len(order), np.int64)
                for p, lo, hi in _ranges(realms[order], fan):
                    own = order[lo:hi]
                    yield _slice(p, r["src"], [hashes], own, none[own], none[own], counts[own], 0, none, none)

    return run


def _settle(fan: int):
    """Chunks with what was found of their words: a = lengths and folds, b = places of the tokens' words in the order of
    their ids, c = those ids, d = counts and whether other chunks have the word, e = ids of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            own, *found = rows
            _, _, order = _word_order(unpacked(own["c"]), fan)
            counts, ids = (np.concatenate([unpacked(r[c]) for r in found]) for c in "ab")
            by_id, place = np.argsort(ids), np.empty(len(ids), np.int64)
            place[unpacked(own["d"])[order][by_id]] = np.arange(len(ids))
            columns = (place[unpacked(own["b"])], np.diff(ids[by_id], prepend=0), counts[by_id])
            yield _batch(own["src"], 0, own["src"], _OWN, own["a"], *[packed(x) for x in columns], own["e"])

    return run


def _known(rows: Iterator[pa.RecordBatch], model: Model, upto: int, fan: int) -> Iterator[_Chunk]:
    """Chunks with all they know of the orders below ``upto``, and its n-grams."""
    for group in _rows(rows):
        for r in group:
            r["order"], r["realm"] = r["realm"] >> 32, r["realm"] & 0xFFFFFFFF
        chunk = _Chunk(sorted(group, key=lambda r: (r["kind"], r["order"], r["realm"])), model, fan)
        for n in range(2, upto + 1):
            chunk.grow()
            if n in chunk.answers or n < upto:
                chunk.learn()
        yield chunk
        del group, chunk


def _send(model: Model, order: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _known(batches, model, order, fan):
            yield from chunk.slices()
            del chunk

    return run


def _score(model: Model, order: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _known(batches, model, order, fan):
            if chunk.orders[-1].counts is None:  # all contexts are of this chunk only
                chunk.learn()
            yield chunk.scores()
            del chunk

    return run


def _heavy_sums(answers: DataFrame) -> Sums:
    """Sums of the heavy contexts over realms; at most HEAVY rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                columns = [unpacked(r["a"]), *unpacked(r["b"]).reshape(-1, REACH).T, unpacked(r["c"]), unpacked(r["d"], np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", *[f"r{i}" for i in range(REACH)], "more", "below"])

    parts = arrow_map(
        answers.where(F.col("kind") == _HEAVY), run, "key bigint, " + ", ".join(f"r{i} bigint" for i in range(REACH)) + ", more bigint, below double"
    )
    # in the order of the values, so that a sum of doubles does not depend on partitions
    sums = parts.groupBy("key").agg(*[F.sum(f"r{i}") for i in range(REACH)], F.sum("more"), F.array_sort(F.collect_list("below")))
    rows = sorted(sums.collect())
    if not rows:
        return Sums()
    return Sums(
        np.array([r[0] for r in rows]), np.array([r[1 : REACH + 1] for r in rows]), np.array([r[REACH + 1] for r in rows]),
        np.array([sum(r[REACH + 2]) for r in rows])
    )


def score(
    docs: DataFrame, modulus: int = 7, held_out: int = 2, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, fan: int = FAN, group: int = GROUP
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (Katz), log10."""
    with Run(docs.sparkSession) as run:
        model, known = learned(run, docs, modulus, held_out, order, chunk_tokens, fan, group)
        schema = (
            f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        )
        return run.result(arrow_map(known, _score(model, order, fan), schema), "katz")


def learned(run: Run, docs: DataFrame, modulus: int, held_out: int, order: int, chunk_tokens: int, fan: int, group: int) -> tuple[Model, DataFrame]:
    """The model, and chunks with the answers to all their n-grams."""
    chunks = run.stored(_chunks(docs, modulus, held_out, chunk_tokens), "chunks")
    sources, least = chunks.count(), int(run.spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, sources // 4)
    model, answers, known = Model().ready(), None, chunks
    for n in range(1, order + 1):
        sends = arrow_map(known, _send(model, n, fan) if n > 1 else _send_words(fan), _ROW)
        found = _exchange(run, sends, n, model, sources, fan, group)
        totals = [unpacked(r[0]) for r in found.where(F.col("kind") == _SPREAD).select("a").collect()]
        s = np.sum(totals, axis=0).tolist() if totals else [0] * (REACH + 3)
        if n == 1:
            model.types, model.total, model.seen = s[0], s[1], [s[2:]]
        else:
            model.seen, model.heavy[n] = [*model.seen, s[2:]], _heavy_sums(found)
        model.ready()
        by_order = F.col("realm") + F.lit(n << 32)
        own = found.where(F.col("kind") == _FOUND).withColumn("grp", F.col("src")).withColumn("realm", by_order)
        answers = own if answers is None or n == 2 else answers.unionByName(own)
        known = chunks.withColumn("e", F.lit(None).cast("binary")) if 1 < n < order else chunks
        known = known.unionByName(answers).repartition(tasks, "grp").sortWithinPartitions("grp")
        if n == 1:
            known = run.stored(arrow_map(known, _settle(fan), _ROW), "settled")
            run.discarded(chunks)
            chunks = known
        released(run.spark)
    return model, known
