import json
import zipfile

import pytest
from pyspark.sql import functions as F

from graindeck.plans import publish, verify
from graindeck.schema import CANONICAL, GROUPED, ConstraintError
from graindeck.sources import files, manifests
from graindeck.streaming import queue


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" if r is not None else "\n" for r in rows), encoding="utf-8")
    return str(path)


def row(i, **more):
    return {"id": f"r{i}", "image": f"{i}.jpg", "caption": f"Cap {i}", "split": "val", "source": "s"} | more


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "m.jsonl", [row(0), None, row(1, extra=3)])
    assert [(r.ord, r.id) for r in manifests.read_jsonl(spark, p).orderBy("ord").collect()] == [(0, "r0"), (2, "r1")]
    with pytest.raises(ConstraintError):
        manifests.read_jsonl(spark, p, blank="error")
    with pytest.raises(ConstraintError):
        manifests.read_jsonl(spark, write(tmp_path / "e.jsonl", []))
    with pytest.raises(ConstraintError):
        manifests.read_jsonl(spark, write(tmp_path / "n.jsonl", [{"id": "x"}]))
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(row(0)) + "\n{broken\n")
    with pytest.raises(Exception):
        manifests.read_jsonl(spark, str(bad)).collect()
    assert manifests.read_jsonl_tolerant(spark, str(bad), CANONICAL).where("error is not null").count() == 1


def test_manifest_rules(spark, tmp_path):
    rows = manifests.read_jsonl(spark, write(tmp_path / "m.jsonl", [row(0), row(1)]))
    assert manifests.one_to_one(rows, "val", "s").count() == 2
    assert manifests.captions_only(rows).columns == ["id", "caption"]
    again = manifests.read_jsonl(spark, write(tmp_path / "d.jsonl", [row(0), row(1, caption=" CAP  0")]))
    with pytest.raises(ConstraintError):
        manifests.one_to_one(again, "val", "s")
    with pytest.raises(ConstraintError):
        manifests.one_to_one(rows, "train", "s")
    grouped = [row(0, caption="Airport", group_id="airport"), row(1, caption="  airport ", group_id="airport"), row(2, caption="Forest", group_id="forest")]
    _, texts = manifests.caption_groups(manifests.read_jsonl(spark, write(tmp_path / "g.jsonl", grouped), GROUPED))
    assert [r.caption for r in texts.orderBy("first").collect()] == ["Airport", "Forest"]
    multi = spark.createDataFrame(
        [("b", "i2", "y"), ("a", "i2", "y"), ("c", "i1", "x")], "id string, image_id string, image string"
    ).withColumns({"caption": F.lit("t"), "split": F.lit("test"), "source": F.lit("s")})
    images, captions = manifests.multi_caption(multi, "test")
    assert {r.image_id: r.idx for r in images.collect()} == {"i1": 0, "i2": 1} and {r.id: r.idx for r in captions.collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ConstraintError):
        manifests.multi_caption(multi.withColumn("image", F.col("id")), "test")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿filepath,title\na.jpg,"x, y"\nb.jpg,z\n', encoding="utf-8")
    assert [tuple(r) for r in manifests.read_csv(spark, str(p), ["filepath", "title"], exact=True).collect()] == [("a.jpg", "x, y"), ("b.jpg", "z")]
    p3 = tmp_path / "c.csv"
    p3.write_text('"a, b","c"\n1,"two\nlines"\n')
    assert [tuple(r) for r in manifests.read_csv(spark, str(p3), ["a, b", "c"], exact=True).collect()] == [("1", "two\nlines")]
    p2 = tmp_path / "b.csv"
    p2.write_text("filepath,title\na.jpg,x,extra\n")
    with pytest.raises(ConstraintError):
        manifests.read_csv(spark, str(p2), ["filepath"])
    with pytest.raises(ConstraintError):
        manifests.read_csv(spark, str(p), ["nothing"])


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for name, lo, hi in (("b.txt", 700, 1000), ("a.txt", 0, 700)):
        (tmp_path / name).write_text("".join(f"line {i}\r\n" if i % 3 else f"line {i}\n" for i in range(lo, hi)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = manifests.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert sorted(map(tuple, rows.collect())) == [(i, f"line {i}") for i in range(1000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_nested(spark, tmp_path):
    kind = "filename string, sentences array<struct<raw: string, tokens: array<string>>>"
    p = tmp_path / "n.json"
    p.write_text(json.dumps({"images": [{"filename": "a.jpg", "sentences": [{"raw": "A cat."}, {"raw": " ", "tokens": ["b", "dog"]}]}]}))
    rows = manifests.annotation_captions(manifests.nested_records(spark, str(p), kind))
    assert [r.caption for r in rows.orderBy("number").collect()] == ["A cat.", "b dog"]
    other = spark.createDataFrame([([(" ", "cap", "t"), (None, None, "\u00a0text ")],)], "sentences array<struct<raw: string, caption: string, text: string>>")
    assert [r.caption for r in manifests.annotation_captions(other).orderBy("number").collect()] == ["cap", "text"]
    with pytest.raises(Exception):
        manifests.annotation_captions(spark.createDataFrame([([("  ", ["", " "])],)], "sentences array<struct<raw: string, tokens: array<string>>>")).collect()
    p.write_text(json.dumps([{"filename": "b.jpg", "sentences": []}]))
    assert manifests.nested_records(spark, str(p), kind).collect()[0].filename == "b.jpg"


def test_files_and_archives(spark, tmp_path):
    for n in ("x/A/1.JPG", "x/A/2.png", "x/B/3.jpg", "x/B/no.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"data")
    found = files.class_directories(files.list_files(spark, str(tmp_path / "x")), 3)
    assert sorted((r.path, r.label) for r in found.collect()) == [("A/1.JPG", "A"), ("A/2.png", "A"), ("B/3.jpg", "B")]
    assert {r.suffix: r.n_files for r in verify.asset_inventory(found).collect()} == {".jpg": 2, ".png": 1}
    with pytest.raises(ConstraintError):
        files.class_directories(files.list_files(spark, str(tmp_path / "x")), 4)
    z = str(tmp_path / "images1.zip")
    files.write_archive(z, [("wrap/a.jpg", b"aa"), ("b.jpg", b"bbb")], [("meta.txt", "m")])
    both = [sorted(map(tuple, files.archive_members(spark, z, n).select("member", "size", "crc").collect())) for n in (1 << 20, 0)]
    assert both[0] == both[1] and [m for m, _, _ in both[0]] == ["b.jpg", "meta.txt", "wrap/a.jpg"]  # read whole, and only its directory
    members = files.archive_members(spark, z).where("member <> 'meta.txt'")
    names = files.member_names(F.col("member"), "images1", ["images1"])
    asked = spark.createDataFrame(
        [("wrap/a.jpg",), (".\\\\wrap//a.jpg",), ("images1/c.jpg",), ("d.jpg",)], "member string"
    ).select(files.member_names(F.col("member"), "images1", ["r2", "r1"]).alias("n")).collect()
    assert [r.n for r in asked] == [["wrap/a.jpg", "a.jpg", "images1/wrap/a.jpg"]] * 2 + [
        ["images1/c.jpg", "c.jpg"], ["d.jpg", "images1/d.jpg", "r1/d.jpg", "r2/d.jpg"]
    ]
    with pytest.raises(ConstraintError):  # no suffix of a path is a name under the archive's
        files.match_members(members, spark.createDataFrame([("images1/a.jpg",)], "path string"), names, "path", 10)
    wanted = spark.createDataFrame([("images1/wrap/a.jpg",), ("images1/b.jpg",)], "path string")
    got = {r.path: r for r in files.match_members(members, wanted, names, "path", 10).collect()}
    assert {k: v.member for k, v in got.items()} == {"images1/wrap/a.jpg": "wrap/a.jpg", "images1/b.jpg": "b.jpg"}
    with pytest.raises(ConstraintError):
        files.match_members(members, wanted, names, "path", 2)
    r = got["images1/wrap/a.jpg"]
    out = str(tmp_path / "out/a.jpg")
    assert [files.extract_member(z, r.member, out, r.size, r.crc) for _ in range(2)] == ["written", "reused"]
    (tmp_path / "out/a.jpg").write_bytes(b"zz")
    with pytest.raises(ConstraintError):
        files.extract_member(z, r.member, out, r.size, r.crc)
    assert zipfile.ZipFile(z).getinfo("b.jpg").compress_type == zipfile.ZIP_STORED


def test_settings_and_references():
    settings = [files.Setting("train.lr", float, 0.1), files.Setting("data.root", str), files.Setting("train.amp", bool, False)]
    assert files.load_settings('[data]\nroot="$BASE/x"\n', settings, {"BASE": "/b"}) == {"train.lr": 0.1, "data.root": "/b/x", "train.amp": False}
    with pytest.raises(ConstraintError):
        files.load_settings("[train]\nlr=true\n", settings, {})
    assert files.read_pairs("a=1\n\nb = 2") == {"a": "1", "b": "2"}
    with pytest.raises(ConstraintError):
        files.read_pairs("a=1\na=2")
    tree = {
        "x": [{"file_name": "a.jpg"}, {"images": ["b.png", 3]}, "d.jpg"], "note": "c.jpg", "Path": {"image": "e.WEBP"}, "filename": ".jpg",
        "image_path": ["f.png", {"path": "g.bmp"}]
    }
    assert list(files.image_strings(tree)) == ["a.jpg", "e.WEBP", "g.bmp"] and list(files.image_strings("a.jpg")) == []
    text = 'a = "$HOMEX/y ${HOME}/z $NONE"\nb = "~/w"\nc = "$HOME-$HOME"\n'
    found = files.load_settings(text, [files.Setting(n, str) for n in "abc"], {"HOME": "/h", "X": "x"})
    assert found == {"a": "$HOMEX/y /h/z $NONE", "b": "/h/w", "c": "/h-/h"}


def test_publish(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    at = str(tmp_path / "out")
    assert [publish.publish_immutable(df, at) for _ in range(2)] == ["written", "reused"]
    with pytest.raises(ConstraintError):
        publish.publish_immutable(df.where("id < 4"), at)
    bad = df.withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        publish.publish({"a": df, "b": bad}, str(tmp_path / "half"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("half")]
    f = str(tmp_path / "r.json")
    assert [publish.write_bytes(f, b"1", True) for _ in range(2)] == ["written", "reused"]
    with pytest.raises(ConstraintError):
        publish.write_bytes(f, b"2", True)
    assert publish.write_jsonl(df, str(tmp_path / "m.jsonl"), "id") == 5
    assert publish.markdown_table(df.limit(1), "id").splitlines()[0] == "| id | v |"


def test_resume(tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("".join(json.dumps({"step": s}) + "\n" for s in (0, 250, 500)))
    assert publish.truncate_log(str(log), str(tmp_path / "old.jsonl"), 250) == (2, 1)
    assert json.loads((tmp_path / "old.jsonl").read_text())["step"] == 500
    assert publish.compare_identity({"a": 1, "b": 2}, {"a": 2, "b": 3}, {"b"}) == ({"a": (1, 2)}, {"b": (2, 3)})
    assert publish.run_state(str(tmp_path / "none")) == "fresh"
    with pytest.raises(ConstraintError):
        publish.run_state(str(tmp_path))
    r = {"r1": 0.1, "r5": 0.2, "r10": 0.3}
    report = {"metrics": {"image_to_text": r, "text_to_image": r, "mean_recall": 0.2}}
    assert publish.check_report(report) and not publish.check_report({"metrics": report["metrics"] | {"mean_recall": 0.3}})
    f = str(tmp_path / "rep.json")
    assert [publish.reuse_or_build(f, {"seed": s}, lambda: dict(report))[1] for s in (1, 1, 2)] == ["built", "reused", "built"]


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(10).select(F.lit("k").alias("key"), "id", (F.col("id") * 10).alias("item"))
    rows.where("id < 6").coalesce(1).write.parquet(src)
    run = lambda: queue.run_to_end(queue.queue_stream(queue.table_stream(spark, src), "key", "id", "item", 3), out, state)
    run()
    rows.where("id >= 6").coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r.id: (r.queue_size, r.oldest) for r in spark.read.parquet(out).collect()}
    assert got == {i: (min(i, 3), None if i == 0 else max(0, i - 3) * 10) for i in range(10)}


def test_markdown_table_refuses_long_results(spark):
    assert len(publish.markdown_table(spark.range(1000), "id").splitlines()) == 1002
    with pytest.raises(ConstraintError):
        publish.markdown_table(spark.range(1001), "id")
