"""Deterministic selection: seeded top-k, caps, splits, greedy quotas, batch plans."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.functions.hashing import priority
from graindeck.functions.text import normalized
from graindeck.schema import ConstraintError


def hash_top(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """The k rows whose key has the smallest priority; ties by key. Planned as a top-k, not a full sort."""
    return df.withColumn("priority", priority(seed, F.col(key))).orderBy("priority", key).limit(k)


def cap_per_group(df: DataFrame, group: Column, key: str, most: int, seed: int) -> DataFrame:
    """Of each group the ``most`` rows of smallest priority.

    A group is first reduced within parts of itself, so a hot group is not ranked by one task as a whole.
    """
    p = df.withColumn("group_key", group).withColumn("priority", priority(seed, F.col(key)))
    part = p.withColumn("part", F.pmod(F.xxhash64(key), F.lit(32)))
    part = part.withColumn("rn", F.row_number().over(Window.partitionBy("group_key", "part").orderBy("priority", key))).where(F.col("rn") <= most)
    whole = part.withColumn("rn", F.row_number().over(Window.partitionBy("group_key").orderBy("priority", key)))
    return whole.where(F.col("rn") <= most).drop("rn", "part")


def capped_top(df: DataFrame, group: Column, key: str, most: int, k: int, seed: int, exact: bool = False) -> DataFrame:
    """Cap each group, then the k smallest priorities overall; ``exact``: fewer than k is an error."""
    out = cap_per_group(df, group, key, most, seed).orderBy("priority", key).limit(k)
    if exact and (n := out.count()) < k:
        raise ConstraintError(f"{n} rows are left of the {k} asked for")
    return out


def least_per_group(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Of each group the row that comes first; map-side combinable, unlike a window."""
    rest = [c for c in df.columns if c != group]
    first = df.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.select(group, "row.*")


def split_by_group(df: DataFrame, group: Column, validation: int, seed: int) -> DataFrame:
    """H1 split: the ``validation`` groups of smallest priority go to val, all rows of a group together; a null group stays
    in train. A group is known by its priority, a digest of its name, so long names are not shuffled."""
    keyed = df.withColumn("group_priority", priority(seed, group))
    held = keyed.select("group_priority").where("group_priority is not null").distinct().orderBy("group_priority").limit(validation)
    marked = keyed.join(held.withColumn("held", F.lit(True)), "group_priority", "left")
    return marked.withColumn("split", F.when(F.col("held"), "val").otherwise("train")).drop("held", "group_priority")


def prefix(df: DataFrame, order: str, n: int, rule: Column | None = None) -> DataFrame:
    """L1: the first n rows in the table's declared order (a 0-based number); ``rule`` has to hold for all of them."""
    out = df.where(F.col(order) < n)
    if rule is not None and (bad := out.where(~F.coalesce(rule, F.lit(False))).limit(1).count()):
        raise ConstraintError(f"{bad} of the first {n} rows break the rule")
    return out


def restored_order(df: DataFrame, reference_order: str, representative: str, path: str) -> DataFrame:
    """By reference, its representative first, then by path."""
    return df.orderBy(reference_order, ~F.col(representative), path)


def one_split_only(df: DataFrame, key: str, split: str) -> DataFrame:
    """F8: rows whose key occurs in one split only."""
    crossing = df.groupBy(key).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").select(key)
    return df.join(crossing, key, "left_anti")


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """the name of the first rule that holds; later rules are not counted for the row."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(reasons):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def in_prefixes(path: Column, prefixes: Iterable[str]) -> Column:
    """the first part of the path is one of these."""
    return F.element_at(F.split(path, "/"), 1).isin(list(prefixes))


class Claims:
    """What accepted rows hold, by kind: no value of a kind may be held twice."""

    def __init__(self) -> None:
        self.held: defaultdict[str, set[str]] = defaultdict(set)

    def refusal(self, wanted: dict[str, list[str]]) -> str | None:
        """The first kind of which a value is held already, or wanted twice."""
        return next((k for k, v in wanted.items() if len({*v}) < len(v) or not self.held[k].isdisjoint(v)), None)

    def take(self, wanted: dict[str, list[str]]) -> None:
        for k, v in wanted.items():
            self.held[k].update(v)


def greedy_quota(
    candidates: DataFrame, targets: dict[str, int], splits: tuple[str, ...] = ("train", "val"), most: int = 1_000_000
) -> tuple[list[dict], Counter]:
    """Fill each split's places, half of them for short captions and then half for detailed ones, with the next
    candidates (split, priority, path, object, group, short, detail) that claim nothing an accepted one holds.

    A claim is the object, the group and both normalised captions, over all splits; refusals are counted by the first
    kind. Every decision depends on all before it, so this folds ranked rows on the driver, read in order as long as
    places are left; more than ``most`` rows read, or too few to fill the places, are errors.
    """
    claims, refused, accepted, read = Claims(), Counter(), [], 0
    keyed = candidates.withColumn("short_key", normalized(F.col("short"))).withColumn("detail_key", normalized(F.col("detail")))
    for split in splits:
        rows = keyed.where(F.col("split") == split).orderBy("priority", "path").toLocalIterator()
        places = [k for k in ("short", "detail") for _ in range(targets[split] // 2)]
        while places:
            row = next(rows, None)
            if row is None:
                raise ConstraintError(f"not enough candidates for {split}: {dict(Counter(places))} places are left")
            if (read := read + 1) > most:
                raise ConstraintError(f"more than {most} candidates for a sequential selection")
            wanted = {"duplicate_object": [row["object"]], "duplicate_group": [row["group"]], "caption_collision": [row["short_key"], row["detail_key"]]}
            if why := claims.refusal(wanted):
                refused[why] += 1
            else:
                claims.take(wanted)
                accepted.append(row.asDict() | {"caption_kind": places.pop(0)})
    return accepted, refused


def rank_in_group(df: DataFrame, group: str, digest: str, key: str, name: str = "rn") -> DataFrame:
    """0-based rank within a group in the order of a hexadecimal digest, ties by key.

    A group is ranked in 256 ranges of digests, and ranges are counted, so a hot group is not sorted by one task.
    """
    part = df.withColumn("part", F.substring(digest, 1, 2))
    sizes = part.groupBy(group, "part").agg(F.count("*").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy(group, "part").orderBy(digest, key)) - 1
    return part.withColumn("here", here).join(
        sizes.select(group, "part", ahead.alias("ahead")), [group, "part"]
    ).withColumn(name, F.col("ahead") + F.col("here")).drop("part", "here", "ahead")


def chunked_epoch(df: DataFrame, group: str, key: str, per_group: int, seed: int, epoch: int = 0) -> DataFrame:
    """Rows in a seeded order within their group, cut to chunks, chunks in a seeded order: column pos.

    The global position is a rank over chunks, whose number is the rows' by ``per_group`` at least.
    """
    rows = rank_in_group(
        df.withColumn("at", priority(f"{seed}:{epoch}", F.col(key))), group, "at", key
    ).drop("at").withColumn("chunk", F.floor(F.col("rn") / per_group).cast("long"))
    chunks = rows.groupBy(group, "chunk").agg(F.count("*").alias("size")).withColumn(
        "place", priority(f"{seed}:{epoch}:chunk", F.concat_ws("\0", F.col(group).cast("string"), F.col("chunk").cast("string")))
    )
    chunks = running_sum(chunks, "place", "size", "before")
    out = rows.join(chunks.select(group, "chunk", "before"), [group, "chunk"])
    return out.withColumn("pos", F.col("before") + F.col("rn") - F.col("chunk") * per_group).drop("rn", "before")


def range_part(df: DataFrame, key: str, name: str = "range") -> DataFrame:
    """``df`` with the number of the range that its key falls in; ranges hold about equally many rows, in key order.

    Bounds come from a sample that is chosen by hash, so that two evaluations agree; it has 64 rows a range at most.
    """
    parts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(64 * parts).collect())
    bounds = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col(key))))


def running_sum(df: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """Sum of ``size`` over the rows before, in the order of a unique column: within ranges, and over their sums."""
    part = range_part(df, order)
    sums = part.groupBy("range").agg(F.sum(size).alias("range_size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select("range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return part.withColumn(
        "inside", F.coalesce(F.sum(size).over(inside), F.lit(0))
    ).join(F.broadcast(offsets), "range").withColumn(name, F.col("offset") + F.col("inside")).drop("range", "inside", "offset")


def batches(df: DataFrame, pos: str, size: int, drop_last: bool) -> DataFrame:
    """Batch number and slot of each position; a short last batch is dropped if asked."""
    out = df.withColumn("batch_no", F.floor(F.col(pos) / size).cast("long")).withColumn("slot", (F.col(pos) % size).cast("long"))
    if not drop_last:
        return out
    return out.where((F.col("batch_no") + 1) * size <= df.agg(F.count("*")).scalar())


def rotating_plan(sizes: np.ndarray, order: np.ndarray, cursors: np.ndarray, batch_size: int, per_group: int, drop_last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Batches in which each group in turn gives its next rows, at most ``per_group``, wrapping around.

    Returns runs (batch, first slot, group, first row, rows) and the groups' new cursors, which move for emitted batches
    only. A group offers min(size, per_group) rows; a batch ends with the group whose offer fills it, what that group
    offers beyond is not carried over. So batch ends follow from prefix sums of the offers, by binary search.
    """
    offer = np.minimum(sizes[order], per_group)
    upto = np.cumsum(offer)
    ends, before = [], 0
    while (end := int(np.searchsorted(upto, before + batch_size))) < len(upto):
        ends.append(end)
        before = int(upto[end])
    last = np.array(ends, dtype=np.int64)
    batch = np.searchsorted(last, np.arange(len(order)))
    base = np.r_[0, upto[last]][batch]
    slot = upto - offer - base
    rows = np.minimum(offer, batch_size - slot)
    on = (batch < len(last)) | (not drop_last)
    group = order[on]
    runs = np.stack([batch[on], slot[on], group, cursors[group], rows[on]], axis=1)
    moved = cursors.copy()
    moved[group] = (cursors[group] + rows[on]) % sizes[group]
    return runs, moved


def rotating_epochs(sizes: np.ndarray, orders: Iterable[np.ndarray], batch_size: int, per_group: int, drop_last: bool) -> Iterator[np.ndarray]:
    """The runs of one epoch after the other, (epoch, batch, first slot, group, first row, rows)."""
    cursors = np.zeros(len(sizes), dtype=np.int64)
    for epoch, order in enumerate(orders):
        runs, cursors = rotating_plan(sizes, order, cursors, batch_size, per_group, drop_last)
        yield np.insert(runs, 0, epoch, axis=1)


@dataclass(frozen=True)
class EpochPosition:
    """ST3: where a run is in its seeded epochs, by batches consumed; what is read ahead moves nothing."""

    rows: int
    batch_size: int
    seed: int
    drop_last: bool = True
    epoch: int = 0
    offset: int = 0

    def __post_init__(self) -> None:
        numbers = (self.rows, self.batch_size, self.seed, self.epoch, self.offset)
        if any(
            type(x) is not int for x in numbers
        ) or type(self.drop_last) is not bool or min(self.rows, self.batch_size) < 1 or self.epoch < 0 or not 0 <= self.offset <= self.batches:
            raise ValueError(f"no position of a run: {self}")

    @property
    def batches(self) -> int:
        """Of an epoch."""
        return (self.rows if self.drop_last else self.rows + self.batch_size - 1) // self.batch_size

    def after(self, consumed: int = 1) -> EpochPosition:
        """The position after that many more batches."""
        if not self.batches:
            raise RuntimeError("an epoch has no batch")
        epochs, offset = divmod(self.offset + consumed, self.batches)
        return replace(self, epoch=self.epoch + epochs, offset=offset)

    def resumed(self, state: dict) -> EpochPosition:
        """The position that a saved state (``dataclasses.asdict``) names, if it is one of this run."""
        own = ("rows", "batch_size", "seed", "drop_last")
        if bad := [k for k in own if state.get(k) != getattr(self, k)]:
            raise ValueError(f"the state is of another run: {bad}")
        return replace(self, epoch=state["epoch"], offset=state["offset"])


def epoch_batches(df: DataFrame, key: str, at: EpochPosition) -> DataFrame:
    """ST3: the rows that are left of the position's epoch, with batch_no and slot: a seeded order of a unique key, ranked
    over ranges."""
    ranked = running_sum(df.withColumn("order_key", priority(f"{at.seed}:{at.epoch}", F.col(key))).withColumn("one", F.lit(1)), "order_key", "one", "pos")
    out = ranked.drop("order_key", "one").withColumn(
        "batch_no", F.floor(F.col("pos") / at.batch_size).cast("long")
    ).withColumn("slot", (F.col("pos") % at.batch_size).cast("long"))
    return out.drop("pos").where((F.col("batch_no") >= at.offset) & (F.col("batch_no") < at.batches))


def seeded_shuffle(items: list, seed: int, most: int = 1_000_000) -> list:
    """H3, L3: a list in the order that ``random.Random(seed)`` shuffles it to; the generator is sequential, so this is for
    lists that fit the driver, and longer ones are an error (there, ``hash_top`` is the seeded order)."""
    if len(items) > most:
        raise ConstraintError(f"more than {most} rows for a sequential shuffle")
    out = list(items)
    random.Random(seed).shuffle(out)
    return out
