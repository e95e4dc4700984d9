"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles (five words). Documents with equal sets are one class from the start. Classes
are split recursively on sampled shared tokens: a path is a sequence of minimum hashes, each sampling one shingle of
the set, and two classes stay in one bucket as long as they sample the same one, which similar sets do with a
probability of their similarity. Buckets that are small are compared by brute force on sketches; others are split
again, into as many children as keeps a similar pair together. RUNS independent recursions bring the recall to
``recall()``. What the sketches hold possible is verified exactly on the whole sets.

No task holds a large bucket. It is cut by salt into parts of about SMALL rows; in a part, rows close to a pivot are
linked to it, and only pivots, with the distance of the farthest row they stand for, go on to be compared with those
of the other parts. So a bucket of near copies shrinks to a few pivots where it stands. A bucket with more than
PIVOTS of them holds unlike rows and is split by the next samples; after the last ones, its pivots are compared in
pairs of blocks.

Defined results: a document without words is in a class of its own with no links; of one to four words, its set is
the run of them all. A null doc_id has copies and links like any other; a class of null ids only has a null class_id.
Repeated rows share a class, and a text of any length is one set. Ties: of equal ids the set with the smaller hash
comes first. An empty table gives an empty result; columns other than doc_id and text are ignored, whatever their
names. Words are those of the decontamination contract (A-Z lowered).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from graindeck.llm.common import Run, arrow_map, runs_of
from graindeck.llm.license_minhash import WordHashes, mixed, shingles
from graindeck.llm.wu_manber import words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Independent recursions, their depth, and the children a bucket's row goes to from the second level on.
RUNS, DEPTH, CHILDREN = 8, 3, 2
#: Rows of a bucket, or of a salted part of one, that are compared by one task; pivots of a bucket that is not split any
#: further; pivots in a block after the last split.
SMALL, PIVOTS, BLOCK = 256, 1024, 1024
#: Coordinates of a sketch, and the share of equal ones from which a pair is verified: 4.6 deviations below 0.8.
SKETCH, CANDIDATE = 128, 0.64
#: Shingles and sets of a component that one task verifies; larger components are verified in pairs of blocks.
BLOCK_SHINGLES, BLOCK_SETS = 4_000_000, 512
#: Bits of the map that picks the texts to verify.
FILTER_BITS = 1 << 25

_TOKENS = RUNS + RUNS * (DEPTH - 1) * CHILDREN
_rng = np.random.default_rng(414)
_FACTORS = _rng.integers(0, 2**63, _TOKENS + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(j: float, depth: int = DEPTH, runs: int = RUNS, children: int = CHILDREN) -> float:
    """Probability that a pair of similarity j shares a last bucket of this depth in some run."""
    once = j
    for _ in range(depth - 1):
        once *= 1 - (1 - j) ** children
    return 1 - (1 - once) ** runs


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(words), SHINGLE))


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minima(s: np.ndarray) -> np.ndarray:
    """One sampled shingle, as a mixed hash, for each factor."""
    out = np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (s[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    return mixed(out)


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


#: Equal coordinates from which a row is linked to a pivot that then stands for it.
NEAR = int(0.75 * SKETCH)
#: Deviation of the share of equal coordinates of sets of similarity 0.8.
DEVIATION = (SIMILARITY * (1 - SIMILARITY) / SKETCH) ** 0.5


def close_pairs(a: np.ndarray, b: np.ndarray, far_a: np.ndarray, far_b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``a`` the rows of ``b`` for which either may stand for a row of a similar pair.

    Jaccard distance is a metric: if x and y are within 0.2 of each other, and x within ``far`` of its pivot, the pivots
    are within 0.2 and both distances. 4.6 deviations are allowed for each distance that was estimated.
    """
    far_b = far_b / SKETCH
    for i in range(len(a)):
        f = far_a[i] / SKETCH
        least = SIMILARITY - f - far_b - 4.6 * DEVIATION * np.sqrt(1 + (f > 0) + (far_b > 0))
        yield i, np.flatnonzero((b == a[i]).sum(axis=1) >= np.ceil(least * SKETCH))


def bucket_edges(ids: list[bytes], sketches: np.ndarray, far: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A forest that connects all pairs of the bucket that are close."""
    forest = Forest(len(ids))
    for i, near in close_pairs(sketches, sketches, far, far):
        for j in near:
            if j > i:
                forest.join(i, int(j))
    return [(ids[i], ids[forest.root(i)]) for i in range(len(ids)) if forest.root(i) != i]


def pivots(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's pivot, the rows that are pivots, and how many coordinates their farthest row differs in."""
    of, chosen, far = np.arange(len(sketches)), [], []
    for i in range(len(sketches)):
        alike = (sketches[chosen] == sketches[i]).sum(axis=1) if chosen else np.zeros(0, int)
        if len(alike) and alike.max() >= NEAR:
            k = int(alike.argmax())
            of[i] = chosen[k]
            far[k] = max(far[k], SKETCH - int(alike[k]))
        else:
            chosen.append(i)
            far.append(0)
    return of, np.array(chosen, dtype=np.int64), np.array(far, dtype=np.int64)


#: Rows of buckets: side is 1 of whole ones, far is null but of pivots. Links found are rows with other.
_ROW = "grp bigint, path bigint, id binary, sketch binary, far int, side int, other binary"
_NAMES = ["grp", "path", "id", "sketch", "far", "side", "other"]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.nulls(len(found), k) for k in _KINDS]
    columns[2], columns[6] = (pa.array([x[i] for x in found], type=pa.binary()) for i in (0, 1))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _matrix(t: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return t["id"].to_pylist(), np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets that are whole (side 1): links. Salted parts of larger ones: links to pivots, and the pivots."""
    for _, t in runs_of(batches):
        t = t.sort_by("id")
        ids, sketches = _matrix(t)
        if t["side"][0].as_py() == 1:
            yield _links(bucket_edges(ids, sketches, np.zeros(len(ids), np.int64)))
            continue
        of, chosen, far = pivots(sketches)
        yield _links([(ids[i], ids[j]) for i, j in enumerate(of.tolist()) if i != j])
        kept = t.take(pa.array(chosen)).set_column(4, "far", pa.array(far, type=pa.int32())).combine_chunks()
        yield from (pa.RecordBatch.from_arrays(b.columns, names=_NAMES) for b in kept.to_batches())


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the pivots of a bucket: all of one block, or those of a block (side 0) with those of another (1)."""
    for _, t in runs_of(batches):
        t = t.sort_by("id")
        ids, sketches = _matrix(t)
        far, side = t["far"].to_numpy(), t["side"].to_numpy()
        if side.min() == side.max():
            yield _links(bucket_edges(ids, sketches, far))
            continue
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = close_pairs(sketches[a], sketches[b], far[a], far[b])
        yield _links([(ids[a[i]], ids[b[j]]) for i, found in near for j in found])


def _children(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The paths that rows (path, run, id, tokens) go on by: for each child one more sampled token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            path = b.column(0).to_numpy().astype(np.uint64)
            first = b.column(1).to_numpy().astype(np.int64) * (DEPTH - 1) * CHILDREN + (level - 1) * CHILDREN
            deep = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint32).reshape(n, -1)
            for c in range(CHILDREN):
                token = deep[np.arange(n), first + c].astype(np.uint64) << np.uint64(20)
                child = mixed(path * np.uint64(31) + np.uint64(c + 1) + token).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), b.column(1), b.column(2)], names=["path", "run", "id"])

    return run


def _gathered(df: DataFrame, *by: Column | str) -> DataFrame:
    nothing = {"far": "int", "side": "int", "other": "binary"}
    df = df.withColumns({c: F.lit(None).cast(k) for c, k in nothing.items() if c not in df.columns}).withColumn("grp", F.xxhash64(*by))
    return df.select(*_NAMES).repartition("grp").sortWithinPartitions("grp")


def _candidates(run: Run, paths: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets whose sketches are close and that share a last bucket in any of the runs.

    Paths (path, run, id) carry no sketches and tokens; sets get theirs where they are compared or go on. Sizes of
    buckets are written first, so joins with them are of two tables and Spark can split a path that has many rows.
    """
    sketches, tokens, found = reps.select("id", "sketch"), reps.select("id", "tokens"), None
    for depth in range(DEPTH):
        sizes = run.stored(paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{depth}")
        level = run.stored(paths.join(sizes, "path").withColumn("side", (F.col("size") <= SMALL).cast("int")), f"level{depth}")
        salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / SMALL))
        done = run.stored(arrow_map(_gathered(level.join(sketches, "id"), "path", salt), _parts, _ROW), f"parts{depth}")
        left = done.where("far is not null")
        most = run.stored(left.groupBy("path").agg(F.count("*").alias("most")), f"pivots{depth}")
        last = depth == DEPTH - 1
        # all pivots of a bucket meet, in blocks if there are many
        blocks = F.ceil(F.col("most") / BLOCK)
        block = F.pmod(F.xxhash64("id", F.lit(5)), blocks)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
        met = left.join(most if last else most.where(F.col("most") <= PIVOTS), "path").withColumn("block", block).withColumn("p", F.explode(pairs))
        met = met.withColumn("side", (F.col("block") != F.col("p.i")).cast("int"))
        across = run.stored(arrow_map(_gathered(met, "path", "p.i", "p.j"), _across, _ROW), f"across{depth}")
        for links in (done, across):
            links = links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
            found = links if found is None else found.union(links)
        wide = most.where(F.col("most") > PIVOTS)
        if last or wide.isEmpty():
            return found
        on = level.join(wide.select("path"), "path", "left_semi").join(tokens, "id").select("path", "run", "id", "tokens")
        paths = run.stored(arrow_map(on, _children(depth + 1), "path bigint, run int, id binary"), f"paths{depth + 1}")
    return found


def _sketched(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, sizes, paths, tokens, sketches = [], [], [], [], []
            for t in b.column(1):
                s = shingle_set(words_of(t.as_py()), hashes)
                if not len(s):
                    for c in (ids, sizes, paths, tokens, sketches):
                        c.append(None)
                    continue
                m = minima(s)
                ids.append(set_id(s))
                sizes.append(len(s))
                paths.append(mixed(m[:RUNS] + np.arange(RUNS, dtype=np.uint64)).astype(np.int64).tolist())
                tokens.append((m[RUNS:_TOKENS] >> np.uint64(32)).astype(np.uint32).tobytes())
                sketches.append((m[_TOKENS:] >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(ids, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(paths, type=pa.list_(pa.int64())),
                    pa.array(tokens, type=pa.binary()), pa.array(sketches, type=pa.binary())
                ],
                names=["doc_id", "id", "size", "paths", "tokens", "sketch"]
            )

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, id binary, size bigint, paths array<bigint>, tokens binary, sketch binary")


def components(run: Run, edges: DataFrame) -> DataFrame:
    """id and label, the smallest id connected to it, of all ids of the edges (a, b).

    Each round contracts every id into the smallest of its neighbours and itself; the rounds needed grow with the
    logarithm of a component's diameter. Rounds are cut by written tables.
    """
    edges = run.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("label", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = run.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "low")
        labels = run.stored(labels.join(low, labels["label"] == low["u"], "left").select("id", F.coalesce("m", "label").alias("label")), "labels")
        to_a, to_b = low.select(F.col("u").alias("a"), F.col("m").alias("ma")), low.select(F.col("u").alias("b"), F.col("m").alias("mb"))
        edges = edges.join(to_a, "a").join(to_b, "b").where("ma <> mb").select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")).distinct()
        edges = run.stored(edges, "edges")
    return labels


def links_within(sets: list[np.ndarray], sides: np.ndarray | None, similarity: float = SIMILARITY) -> tuple[np.ndarray, Forest]:
    """Links of each set to the others with an exact Jaccard similarity of at least ``similarity``, and their forest.

    sides: if given, only pairs of different sides count. Sets are distinct and sorted. Tokens that more than half of the
    sets have are counted by who lacks them, so near copies, which share most tokens, cost what they differ in: shared
    tokens are the pair's rare ones, the common ones, less those that one of them lacks, plus those that both lack.
    """
    n, forest = len(sets), Forest(len(sets))
    counts, sizes = np.zeros(n, dtype=np.int64), np.array([len(s) for s in sets])
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(token, minlength=len(tokens))
    row = np.repeat(np.arange(n), sizes)
    common = np.flatnonzero(2 * df > n)
    # which common tokens a set lacks: all of them, less those it has
    rank = np.full(len(tokens), -1)
    rank[common] = np.arange(len(common))
    has = rank[token] >= 0
    held = np.bincount(row[has], minlength=n)
    gaps = [np.zeros(0, np.int64)] * n
    if len(common):
        ends = np.cumsum(held)
        have = rank[token[has]]
        for i in range(n):
            if held[i] < len(common):
                lacking = np.ones(len(common), dtype=bool)
                lacking[have[ends[i] - held[i] : ends[i]]] = False
                gaps[i] = common[lacking]
    lacks = len(common) - held
    keys = np.r_[token[~has], np.concatenate(gaps)] if n else token
    owner = np.r_[row[~has], np.repeat(np.arange(n), lacks)]
    order = np.argsort(keys, kind="stable")
    owners, times = owner[order], np.bincount(keys, minlength=len(tokens))  # sets of each token, token by token
    begin = np.cumsum(times) - times
    by_set = np.argsort(owner, kind="stable")
    mine, upto = keys[by_set], np.cumsum(np.bincount(owner, minlength=n))
    for i in range(n):
        own = mine[upto[i - 1] if i else 0 : upto[i]]
        own = own[times[own] > 1]
        lens = times[own]
        ends = np.cumsum(lens)
        both = len(common) - lacks - lacks[i]
        if len(own):
            both = both + np.bincount(owners[np.arange(ends[-1]) + np.repeat(begin[own] - (ends - lens), lens)], minlength=n)
        # similarity as a ratio of whole numbers, compared without rounding at 0.8 = 4 / 5
        hit = both * 5 >= 4 * (sizes[i] + sizes - both) if similarity == 0.8 else both >= similarity * (sizes[i] + sizes - both)
        hit[i] = False
        if sides is not None:
            hit &= sides != sides[i]
        counts[i] = hit.sum()
        for j in np.flatnonzero(hit[i + 1 :]):
            forest.join(i, i + 1 + int(j))
    return counts, forest


def _among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that may have a wanted key, by a bitmap of hashes of FILTER_BITS bits (4 MB), which is broadcast.

    It spares the shuffle rows that no join needs; where hashes coincide a row stays, and the join decides.
    """
    bits = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("long")
    maps = wanted.select(bits(key).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")
    )
    place = F.bitmap_bit_position(bits(key))
    found = rows.withColumn("bucket", F.bitmap_bucket_number(bits(key))).withColumn("place", place).join(F.broadcast(maps), "bucket")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(*rows.columns)


def _verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """id, links and label (an id) by members (rid, id, comp, size), for each block pair of each component."""
    sums = members.groupBy("comp").agg(
        F.greatest(F.ceil(F.sum("size") / F.lit(float(BLOCK_SHINGLES))), F.ceil(F.count("*") / F.lit(float(BLOCK_SETS)))).alias("blocks")
    )
    members = members.join(sums, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    texts = _among(docs.select(F.col("doc_id").alias("rid"), "text"), members, "rid").join(members.select("rid", "id", "comp", "blocks", "block"), "rid")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [shingle_set(words_of(t.as_py()), hashes) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(i) for i in (2, 3, 4, 5)],
                    pa.array([s.tobytes() if set_id(s) == i.as_py() else None for s, i in zip(found, b.column(2), strict=True)], type=pa.binary())
                ],
                names=["id", "comp", "blocks", "block", "shingles"]
            )

    # an id may have two rows in docs; those whose set is not this one are left out, and of equal ones one stays
    rows = arrow_map(
        texts.select("rid", "text", "id", "comp", "blocks", "block"), sets, "id binary, comp binary, blocks bigint, block bigint, shingles binary"
    ).where("shingles is not null")
    nameless = members.where("rid is null").select("id", "comp", "blocks", "block")
    if not nameless.isEmpty():  # sets of null ids only have no row to fetch by id: their rows are found by the set

        def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                found = [s for t in b.column(0) if len(s := shingle_set(words_of(t.as_py()), hashes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(s) for s in found], type=pa.binary()), pa.array([s.tobytes() for s in found], type=pa.binary())],
                    names=["id", "shingles"]
                )

        own = arrow_map(docs.where("doc_id is null").select("text"), own_sets, "id binary, shingles binary")
        own = _among(own, nameless, "id").groupBy("id").agg(F.any_value("shingles").alias("shingles"))
        rows = rows.union(own.join(nameless, "id").select("id", "comp", "blocks", "block", "shingles"))
    pairs = F.explode(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))
        )
    )
    rows = rows.withColumn("p", pairs).select(
        F.xxhash64("comp", "p.i", "p.j").alias("task"), F.col("comp"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "id", "shingles", "blocks"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches):
            seen: dict[tuple, dict[bytes, tuple]] = {}
            for comp, i, j, block, key, s, blocks in zip(*[t.column(c).to_pylist() for c in range(1, 8)], strict=True):
                seen.setdefault((comp, i, j, blocks), {})[key] = (block, s)
            for (_, i, j, blocks), by in seen.items():
                ids = sorted(by)
                sides = np.array([by[k][0] for k in ids]) if i != j else None
                counts, forest = links_within([np.frombuffer(by[k][1], dtype=np.uint64) for k in ids], sides)
                labels = [ids[forest.root(x)] for x in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, type=pa.binary()), pa.array(counts), pa.array(labels, type=pa.binary()), pa.array([blocks] * len(ids), type=pa.int64())],
                    names=["id", "links", "label", "blocks"]
                )

    return arrow_map(rows.repartition("task").sortWithinPartitions("task"), verify, "id binary, links bigint, label binary, blocks bigint")


def _classes(run: Run, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and id (of the set) of every row; id, copy_id, n_copies, n_links, class_id and label of every set."""
    rows = run.stored(_sketched(docs), "sketched")
    # one row a set; equal sets have equal sketches, so any of them will do
    first = [F.any_value(c).alias(c) for c in ("paths", "tokens", "sketch")]
    reps = run.stored(
        rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("rid"), F.count("*").alias("n_copies"), F.max("size").alias("size"), *first),
        "reps"
    )
    edges = _candidates(run, reps.select("id", F.posexplode("paths").alias("run", "path")), reps)
    near = components(run, edges)
    members = near.join(reps.select("id", "rid", "size"), "id").select("rid", "id", F.col("label").alias("comp"), "size")
    checked = run.stored(_verified(docs, run.stored(members, "members")), "verified")
    counts = checked.groupBy("id").agg(F.sum("links").alias("n_links"), F.max("blocks").alias("blocks"), F.min("label").alias("own"))
    wide = components(
        run, checked.where("blocks > 1 and id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    ).withColumnRenamed("label", "joined")
    label = F.coalesce(F.when(F.col("blocks") > 1, F.coalesce("joined", "id")), "own").alias("label")
    counts = counts.join(wide, "id", "left").select("id", "n_links", label)
    every = reps.select("id", "rid", "n_copies").join(counts, "id", "left").select(
        "id", "rid", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "id").alias("label")
    )
    every = run.stored(every, "classes")
    classes = every.groupBy("label").agg(F.min("rid").alias("class_id"))
    return rows.select("doc_id", "id"), every.join(classes, "label").select("id", F.col("rid").alias("copy_id"), "n_copies", "n_links", "class_id", "label")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the documents linked to it, over any number of links), copy_id (the
    smallest doc_id with the same set), n_copies and n_links (different sets of similarity 0.8 or more) of every row."""
    with Run(docs.sparkSession) as run:
        return run.result(_joined(docs, *_classes(run, docs)), "jaccard")


def _joined(docs: DataFrame, rows: DataFrame, every: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.select("doc_id", "id").join(every, "id", "left")
    own = lambda c: F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col(c)).cast(kind).alias(c)
    more = lambda c, n: F.coalesce(c, F.lit(n)).cast("long").alias(c)
    return out.select("doc_id", own("class_id"), own("copy_id"), more("n_copies", 1), more("n_links", 0))


def _with_set(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the id of each row's set, null without words."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(words_of(t.as_py()), hashes) for t in b.column(at)]
            ids = pa.array([set_id(s) if len(s) else None for s in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, name])

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _one_a_class(odd: DataFrame, every: DataFrame) -> DataFrame:
    """Of rows whose doc_id does not tell them apart: one of each class whose class_id is theirs, the one with the
    smallest set and text, and all rows without words."""
    columns, name = odd.columns, "_set"
    while name in columns:
        name = "_" + name
    rows = _with_set(odd, name)
    classes = every.select(F.col("id").alias(f"{name}_id"), F.col("label").alias(f"{name}_label"), F.col("class_id").alias(f"{name}_class"))
    found = rows.join(classes, F.col(name) == F.col(f"{name}_id")).where(F.col("doc_id").eqNullSafe(F.col(f"{name}_class")))
    one = found.groupBy(f"{name}_label").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(name, "text")).alias(name))
    return rows.where(F.col(name).isNull()).select(*columns).union(one.select(f"{name}.*"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which one of each class stays: the one with the smallest doc_id.

    Rows are told apart by doc_id. Where that is null, or the same for several rows, each row is judged by its own set:
    of the rows of a class that have its smallest doc_id (or of a class of null ids only) one stays.
    """
    with Run(docs.sparkSession) as run:
        rows, every = _classes(run, docs)
        copies = _joined(docs, rows, every).where("doc_id <> class_id").select("doc_id").distinct()
        again = run.result(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
        gone = run.result(copies.union(again).distinct(), "gone")
        out = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns)
        odd = docs.where("doc_id is null").union(docs.join(again, "doc_id", "left_semi").select(*docs.columns))
        if odd.isEmpty():
            return out
        return out.union(run.result(_one_a_class(odd, every), "odd").select(*docs.columns))
