import dataclasses
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.functions.hashing import blake2b_hex, priority, tensor_sha256
from graindeck.functions.stats import warmup_cosine
from graindeck.operators import decide, drift, loss, quality, runlog, select
from graindeck.plans import gates, verify
from graindeck.queries import quality as quality_queries
from graindeck.queries import selection
from graindeck.schema import ConstraintError


def one(spark, expr, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(expr.alias("y")).collect()]


def test_normalized_equals_python(spark):
    texts = ["  A  b\x1fC ", "Straße\tX", " Q\u0085r", "", "cafÉ"]
    assert one(spark, T.normalized(F.col("x")), *texts) == [" ".join(t.split()).casefold() for t in texts]
    assert one(spark, T.casefold_key(F.col("x")), *texts) == [" ".join(t.split()).casefold() for t in texts]


def test_sentence_and_fit(spark):
    assert one(
        spark, T.first_sentence(F.col("x")), "One, two. Three.", "No end", "A! B?", "\tA b. C", "A b.\u00a0C", " \x1fD. \u2003"
    ) == ["One, two.", "No end", "A!", "A b.", "A b.", "D."]
    assert one(spark, T.fit_words(F.col("x"), 5), "one two three, four five six. Second sentence.", "one two") == ["one two three", "one two"]
    with pytest.raises(Exception):
        one(spark, T.fit_words(F.col("x"), 4), "; , : words")
    fit = T.fit_words_with(lambda s: len(s.split()) + 2, 5)
    assert one(spark, fit(F.col("x")), "one two three four five six. Second sentence.") == ["one two three"]


def test_captions(spark):
    x = "A field. It shows: Lake near  town. it SHOWS : a"
    assert one(spark, T.caption_from(F.col("x"), "summary"), x) == ["Lake near town. it SHOWS : a"]
    assert one(spark, T.caption_from(F.col("x")), x, "plain") == ["An aerial image. It shows: Lake near town. it SHOWS : a", "plain"]
    assert one(spark, T.caption_from(F.col("x"), "summary"), "plain") == [None]
    assert one(spark, T.country(F.col("x")), "a_US_20", "a_b") == ["US", "unknown"]
    assert one(spark, T.object_key(F.col("x")), "d/a12_US.jpg", "d/b12_US.jpg") == ["a12", None]
    assert one(spark, T.plain_path(F.col("x")), " ././a\\b.jpg") == ["a/b.jpg"]
    assert one(
        spark, T.safe_path(F.col("x")), "a/b.jpg", "/a.jpg", "a/../b.jpg", "a.gif", ".jpg", "a/.png", "a..jpg"
    ) == [True, False, False, False, False, False, True]


def test_meaningful_difference(spark):
    pairs = [("a lake", "a lake with trees, boats and houses."), ("a lake", "the lake. trees"), ("same text", "Same  text")]
    got = one(spark, T.meaningfully_differs(F.col("a"), F.col("b")), *pairs, schema="a string, b string")
    assert got == [True, False, False]


def test_seeded_orders(spark):
    assert one(spark, priority(7, F.col("x")), "k") == [hashlib.sha256(b"7\0k").hexdigest()[:32]]
    assert one(spark, blake2b_hex(7)(F.col("x")), "k") == [hashlib.blake2b(b"7\0k", digest_size=16).hexdigest()]
    assert one(spark, F.crc32(F.encode("x", "UTF-8")), "k") == [zlib.crc32(b"k")]


@pytest.mark.parametrize("n,f,index", [(2, 0.5, 0), (4, 0.5, 2), (6, 0.5, 2), (11, 0.95, 10)])
def test_rounded_percentile(spark, n, f, index):
    df = spark.createDataFrame([(i * 10,) for i in range(n)], "v long")
    assert quality.rounded_percentiles(df, "v", {"p": f}).collect()[0].p == index * 10


def test_audits(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "ord long, k string")
    assert [r.value for r in quality.most_common(df, F.col("k"), "ord", 2).collect()] == ["b", "a"]
    assert quality.duplicate_rate(df, F.col("k")).collect()[0][:3] == (5, 3, 2)
    files = spark.createDataFrame([("d/a.jpg",), ("e/a.jpg",), ("d/b.jpg",)], "path string")
    refs = spark.createDataFrame([("d/a.jpg",), ("a.jpg",), ("b.jpg",), ("z.jpg",)], "ref string")
    got = {r.ref: (r.status, r.file) for r in quality.resolve_references(refs, files, "ref", "path").collect()}
    assert got == {"d/a.jpg": ("resolved", "d/a.jpg"), "a.jpg": ("ambiguous", None), "b.jpg": ("resolved", "d/b.jpg"), "z.jpg": ("missing", None)}
    with pytest.raises(ConstraintError):
        quality.missing(refs.withColumnRenamed("ref", "path"), files, "path")
    assert quality.missing(refs.withColumnRenamed("ref", "path"), files, "path", allow=True) == (3, ["a.jpg", "b.jpg", "z.jpg"])
    with pytest.raises(ConstraintError):
        quality.require_no_leak(files, files, "path")


def test_split_and_caps(spark):
    df = spark.createDataFrame([(i, f"g{i}") for i in range(10)], "id long, g string")
    s = select.split_by_group(df, F.col("g"), 2, 23)
    val = {r.id for r in s.where("split = 'val'").collect()}
    assert len(val) == 2 and val == set(sorted(range(10), key=lambda i: hashlib.sha256(f"23\0g{i}".encode()).hexdigest()[:32])[:2])
    rows = spark.createDataFrame([(0, "w"), (1, "w"), (2, "s")], "id long, g string")
    assert sorted(r.g for r in select.capped_top(rows, F.col("g"), "id", 1, 2, 3, exact=True).collect()) == ["s", "w"]
    with pytest.raises(ConstraintError):
        select.capped_top(rows, F.col("g"), "id", 1, 3, 3, exact=True)


def loop_rotation(sizes, orders, batch_size, per_group, drop_last):
    """Batches of (group, row), group by group and row by row."""
    at, out = [0] * len(sizes), []
    for epoch, order in enumerate(orders):
        batches, cursors = [[]], [dict()]
        for g in order:
            for _ in range(min(per_group, sizes[g])):
                if len(batches[-1]) < batch_size:
                    row = cursors[-1].get(g, at[g])
                    batches[-1].append((int(g), row))
                    cursors[-1][g] = (row + 1) % sizes[g]
            if len(batches[-1]) == batch_size:
                batches.append([])
                cursors.append({})
        for b, (batch, moved) in enumerate(zip(batches, cursors, strict=True)):
            if len(batch) == batch_size or (batch and not drop_last):
                out += [(epoch, b, s, *x) for s, x in enumerate(batch)]
                for g, c in moved.items():
                    at[g] = c
    return out


def test_rotation_equals_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 9, rng.integers(1, 12))
        orders = [rng.permutation(len(sizes)) for _ in range(4)]
        batch, per, drop = int(rng.integers(1, 10)), int(rng.integers(1, 6)), bool(rng.integers(2))
        runs = np.concatenate(list(select.rotating_epochs(sizes, orders, batch, per, drop)))
        got = [(e, b, slot + k, g, (first + k) % sizes[g]) for e, b, slot, g, first, n in runs.tolist() for k in range(n)]
        assert got == loop_rotation(sizes.tolist(), orders, batch, per, drop)


def test_rotating_query_equals_plain_loop(spark, data):
    docs = [(r.doc_id, r.source or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    names = sorted({s for _, s in docs})
    rows = [sorted((i for i, s in docs if s == n), key=lambda i: hashlib.sha256(f"9\0{i}".encode()).hexdigest()[:32]) for n in names]
    want = loop_rotation([len(x) for x in rows], selection.epoch_orders(len(names)), 16, 3, True)
    got = selection.rotating_batches(spark, data).collect()
    assert sorted(map(tuple, got)) == sorted((e, b, s, rows[g][i]) for e, b, s, g, i in want) and len(want) >= 64


def test_positions_resume(spark):
    start = select.EpochPosition(10, 3, 5)
    df = spark.range(10)
    whole = {(r.batch_no, r.slot): r.id for r in select.epoch_batches(df, "id", start).collect()}
    order = sorted(range(10), key=lambda i: hashlib.sha256(f"5:0\0{i}".encode()).hexdigest()[:32])
    assert whole == {(i // 3, i % 3): x for i, x in enumerate(order[:9])} and start.batches == 3
    saved = dataclasses.asdict(start.after())
    rest = {(r.batch_no, r.slot): r.id for r in select.epoch_batches(df, "id", start.resumed(saved)).collect()}
    assert rest == {k: v for k, v in whole.items() if k[0] > 0}
    later = start.after(4)
    assert (later.epoch, later.offset) == (1, 1) and select.EpochPosition(10, 3, 5, False).batches == 4
    for bad in (saved | {"rows": 11}, saved | {"offset": 9}, saved | {"epoch": True}):
        with pytest.raises(ValueError):
            start.resumed(bad)
    with pytest.raises(RuntimeError):
        select.EpochPosition(2, 3, 5).after()


def test_seeded_shuffle():
    want = list(range(50))
    random.Random(7).shuffle(want)
    assert select.seeded_shuffle(list(range(50)), 7) == want
    with pytest.raises(ConstraintError):
        select.seeded_shuffle([1, 2], 7, most=1)


def test_greedy(spark):
    rows = [("train", f"{i:02d}", f"p{i}", f"o{i % 5}", f"g{i}", f"short {i}", f"detail {i % 7}") for i in range(12)] + [
        ("val", "00", "v0", "o0", "gv", "s", "d"), ("val", "01", "v1", "ov", "gw", "s1", "d1"), ("val", "02", "v2", "ow", "gx", "s2", "d2")
    ]
    df = spark.createDataFrame(rows, "split string, priority string, path string, object string, `group` string, short string, detail string")
    got, rejected = select.greedy_quota(df, {"train": 4, "val": 2})
    assert [(r["path"], r["caption_kind"]) for r in got] == [
        ("p0", "short"), ("p1", "short"), ("p2", "detail"), ("p3", "detail"), ("v1", "short"), ("v2", "detail")
    ]
    assert rejected == {"duplicate_object": 1}
    with pytest.raises(ConstraintError):
        select.greedy_quota(df, {"train": 40, "val": 2})
    with pytest.raises(ConstraintError):
        select.greedy_quota(df, {"train": 4, "val": 2}, most=3)


def test_greedy_query_equals_plain_loop(spark, data):
    """Every decision by looking through all rows accepted before."""
    rows = sorted((r.asDict() for r in selection.quota_candidates(spark, data).collect()), key=lambda r: (r["priority"], r["path"]))
    norm = lambda t: " ".join(t.split()).casefold()
    kept = []
    for split, half in (("train", 4), ("val", 1)):
        for kind in ["short"] * half + ["detail"] * half:
            for r in (
                x for x in rows if x["split"] == split and (
                    not kept or kept[-1][0]["split"] != split or (x["priority"], x["path"]) > (kept[-1][0]["priority"], kept[-1][0]["path"])
                )
            ):
                own = {norm(r["short"]), norm(r["detail"])}
                clash = any(r["object"] == k["object"] or r["group"] == k["group"] or own & {norm(k["short"]), norm(k["detail"])} for k, _ in kept)
                if len(own) == 2 and not clash:
                    kept.append((r, kind))
                    break
    want = [(r["split"], r["path"], kind, i) for i, (r, kind) in enumerate(kept)]
    assert [tuple(r) for r in selection.greedy_quota(spark, data).orderBy("place").collect()] == want and len(want) == 10


def test_hashes_of_the_table_equal_python(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    crc = {r.doc_id: r.crc for r in quality_queries.content_checksums(spark, data).collect()}
    assert crc == {i: zlib.crc32(r.text.encode()) for i, r in docs.items()}
    first = {}
    for i, r in docs.items():
        at = hashlib.blake2b(f"5\0{i}".encode(), digest_size=16).hexdigest()
        first[r.source] = min(first.get(r.source, (at, i)), (at, i))
    assert {r.source: (r.priority, r.doc_id) for r in selection.argmin_per_group_blake2b(spark, data).collect()} == first


def test_tensor_digest(spark):
    data = bytes(range(24))
    header = json.dumps({"dtype": "torch.float32", "shape": [2, 3]}, sort_keys=True, separators=(",", ":")).encode()
    want = hashlib.sha256(len(header).to_bytes(8, "big") + header + data).hexdigest()
    df = spark.createDataFrame([("torch.float32", [2, 3], bytearray(data))], "dtype string, shape array<int>, data binary")
    assert df.select(tensor_sha256(F.col("dtype"), F.col("shape"), F.col("data"))).first()[0] == want


def test_losses(spark):
    rows = spark.createDataFrame(
        [(0, i, [1.0, 0.0], [0.0, 0.0], g) for i, g in enumerate("aab")], "batch long, pos long, a array<double>, b array<double>, g string"
    )
    masked = loss.group_losses(rows, "batch", "pos", "a", "b", "g", 1.0, "mask_same_caption").collect()[0].loss
    assert masked == pytest.approx((2 * math.log(2) + math.log(3)) / 3)
    same = rows.withColumn("g", F.lit("a"))
    assert loss.group_losses(same, "batch", "pos", "a", "b", "g", 1.0).collect()[0].loss == pytest.approx(math.log(3))
    assert loss.group_losses(same, "batch", "pos", "a", "b", "g", 1.0, "mask_same_caption").collect()[0].loss == pytest.approx(0)


def test_drift(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    r = drift.drift_summary(df, "a", "b").collect()[0]
    assert r.cosine_distance_mean == 0.5 and r.above_2 == 0.5
    near = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0055524]), ([1.0, 0.0], [1.0, 0.0055524])], "a array<double>, b array<double>")
    want = 1 - 1 / math.sqrt(1 + 0.0055524**2)
    assert abs(drift.drift_summary(near, "a", "b").collect()[0].cosine_distance_mean - want) < 1e-9 and 1.5e-5 < want < 1.6e-5


def test_run_log(spark):
    log = spark.createDataFrame([("r", 0, 3.0), ("r", 250, 2.5), ("r", 500, 2.0)], "run string, step long, loss double")
    assert runlog.argmin_step(log, "run", "step", "loss").collect()[0].best_step == 500
    assert runlog.change_from_start(log, "run", "step", "loss").collect()[0].relative_change == pytest.approx(-1 / 3, abs=1e-6)
    gaps = {(r.step, r.kind) for r in runlog.step_gaps(log, "run", "step", 600, 250).collect()}
    assert gaps == {(600, "missing")}
    assert runlog.monotone_decline(log, "run", "step", "loss").collect()[0].declines
    assert one(spark, warmup_cosine(F.col("x"), 10, 110), 0, 5, 60, 110, schema="x long") == pytest.approx([0.1, 0.5, 0.5, 0.0])


def test_pareto_and_diff(spark):
    rows = [(1, 1.0, 0.5), (2, 1.0, 0.6), (3, 2.0, 0.6), (4, 2.0, 0.7), (5, 0.5, 0.1), (6, 1.0, 0.6)]
    df = spark.createDataFrame(rows, "id int, loss double, recall double")
    beats = lambda a, b: a[1] <= b[1] and a[2] >= b[2] and (a[1] < b[1] or a[2] > b[2])
    want = {r[0] for r in rows if not any(beats(q, r) for q in rows)}
    assert {r.id for r in decide.pareto_frontier(df, "loss", "recall").collect()} == want
    decide.approved_difference({"a": {"x": 1, "y": 2}}, {"a": {"x": 1, "y": 3}}, {"a.y"})
    with pytest.raises(ConstraintError):
        decide.approved_difference({"a": {"x": 1}}, {"a": {"x": 2}}, set())
    with pytest.raises(ConstraintError):
        decide.approved_difference({"a": {"x": 1}}, {"a": {"z": 1}}, {"a.x"})


def test_strict_pairs(spark):
    a, b = (spark.createDataFrame(r, "k int, v double") for r in ([(1, 0.5), (2, 0.4)], [(1, 0.2)]))
    with pytest.raises(ConstraintError):
        decide.paired(a, b, ["k"], "v")
    assert decide.delta_points(decide.paired(a.where("k = 1"), b, ["k"], "v")).collect()[0].mean_pp == 30.0


def test_final_gate_and_parity(spark):
    stages = spark.createDataFrame(
        [("a", True, "x"), ("a", True, "x"), ("b", True, "x"), ("b", None, "x"), ("c", True, "x"), ("c", True, "y")], "run string, ok boolean, digest string"
    )
    assert {r.run: r.passed for r in verify.final_gate(stages, "run", "ok", "digest").collect()} == {"a": True, "b": False, "c": False}
    a = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0)], "name string, i int, v double")
    assert verify.init_parity(a, a.withColumn("v", F.col("v") + 1e-9), "name", "i", "v", 1e-6, 0.0).collect()[0].close
    with pytest.raises(ConstraintError):
        verify.init_parity(a, a.where("i = 0"), "name", "i", "v", 1e-6, 0.0)


def test_report_fields():
    report = {"steps": 100, "completed": True, "left": {"sha": "a"}, "best": 25}
    gates.require_fields(report, {"steps": 100, "completed": True, "left.sha": "a", "best": {0, 25}})
    for bad in ({"steps": 99}, {"completed": 1}, {"left.none": "a"}, {"best": {0, 50}}):
        with pytest.raises(ConstraintError):
            gates.require_fields(report, bad)


def test_stage_gate(spark):
    """Each broken rule fails its own check."""
    losses = {"ok": [3.0, 2.0, 1.0], "best": [1.0, 2.0, 0.5], "worse": [1.0, 2.0, 3.0], "short": [3.0, 2.0], "nan": [3.0, float("nan"), 1.0]}
    v = spark.createDataFrame([(k, i * 50, x) for k, xs in losses.items() for i, x in enumerate(xs)], "run string, step long, loss double")
    recalls = [("own", 0, 0.2), ("own", 100, 0.3), ("other", None, 0.5), ("other", 0, 0.5), ("other", 100, 0.495)]
    e = spark.createDataFrame([(k, *x) for k in losses for x in recalls], "run string, task string, step long, mean_recall double")
    best = {"ok": 100, "best": 0, "worse": 0, "short": 50, "nan": 100}
    reports = (
        spark.createDataFrame(
            [(k, 100, False, 0, b, [50]) for k, b in best.items()],
            "run string, steps int, completed boolean, final_queue_size int, best_step long, resume_steps array<bigint>"
        )
    )
    got = {r.run: r for r in gates.stage_gate(reports, v, e, "run", 100, 50, 500, [50]).collect()}
    assert got["ok"].passed and not got["best"].best_step_agrees and not got["worse"].validation_improves and got["worse"].valid
    assert not got["short"].validation_complete and not got["nan"].validation_complete and [k for k, r in got.items() if r.passed] == ["ok"]
    low = e.withColumn("mean_recall", F.when((F.col("task") == "other") & (F.col("step") == 100), 0.48).otherwise(F.col("mean_recall")))
    assert not gates.stage_gate(reports, v, low, "run", 100, 50, 500, [50]).where("run = 'ok'").first().other_recall_holds
    assert not gates.stage_gate(reports, v, e, "run", 100, 50, 100, [50]).where("run = 'ok'").first().valid  # the last stage has to be complete
