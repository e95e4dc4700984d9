import pytest
from pyspark.sql import functions as F

from graindeck.operators import select
from graindeck.plans import manifest
from graindeck.schema import ConstraintError


def test_canonical_and_audit(spark):
    rows = spark.createDataFrame(
        [("./i2/a1_US_20.jpg", "A lake. It shows: a lake"), ("i2/a2_US_18.jpg", "a  LAKE"), ("i2/a3_CH_21.jpg", "Forest")], "filepath string, title string"
    )
    c = manifest.canonical(rows, "filepath", "title", "train", "src", "auto")
    assert {r.id: r.caption for r in c.collect()}["src:i2/a1_US_20.jpg"] == "An aerial image. It shows: a lake"
    a = manifest.audit(c)
    assert a["countries"] == {"US": 2, "CH": 1} and a["zooms"] == {"18": 1, "20": 1, "21": 1} and a["records"] == 3
    with pytest.raises(ConstraintError):
        manifest.canonical(rows, "filepath", "title", "train", "src", "summary")
    with pytest.raises(ConstraintError):
        manifest.canonical(rows.withColumn("filepath", F.lit("../x.jpg")), "filepath", "title", "train", "src")
    assert manifest.of_split(spark.createDataFrame([("Train ",), ("val",)], "split string"), "train").count() == 1


def test_audit_counts_every_zoom(spark):
    rows = spark.range(1100).select(
        F.col("id").cast("string").alias("id"), F.format_string("a_DE_%d.jpg", "id").alias("image"), F.lit("a field").alias("caption")
    )
    a = manifest.audit(rows)
    assert a["countries"] == {"DE": 1100} and len(a["zooms"]) == 1100


def test_text_audit(spark):
    rows = spark.createDataFrame([("a", "One two"), ("b", " one  TWO "), ("c", "one two three four five six seven")], "id string, caption string")
    a = manifest.text_audit(rows, 8)
    assert (a["unique"], a["duplicates"], a["overflow"]) == (2, 1, 1) and a["examples"][0]["id"] == "c"
    with pytest.raises(ConstraintError):
        manifest.text_audit(rows.limit(0), 8)
    f = {r.id: (r.caption, r.changed) for r in manifest.fitted(rows, 5).collect()}
    assert f["c"] == ("one two three", True)


def test_restore_groups(spark):
    refs = spark.createDataFrame(
        [(0, "r0", "p1/a.jpg", "Airport", "airport"), (1, "r1", "p1/f.jpg", "Forest", "forest")],
        "ord long, id string, image string, caption string, group_id string"
    )
    rows = spark.createDataFrame(
        [("p1/b.jpg", "airport"), ("p1/a.jpg", " Airport"), ("p1/f.jpg", "forest"), ("p1/g.jpg", "FOREST"), ("p9/z.jpg", "forest"), ("p1/u.jpg", "unknown")],
        "path string, caption string"
    )
    out, n = manifest.restored(rows, refs, ["p1"])
    assert n == {"eligible": 4, "excluded_prefix": 1, "unknown_group": 1}
    assert [(r.path, r.reference_representative) for r in out.collect()] == [("p1/a.jpg", True), ("p1/b.jpg", False), ("p1/f.jpg", True), ("p1/g.jpg", False)]
    with pytest.raises(ConstraintError):
        manifest.restored(rows.where("path <> 'p1/a.jpg'"), refs, ["p1"])


def test_mixed_selection(spark):
    long = "a wide lake with many small boats beside tall green trees and houses {}"
    rows = [(f"i/a{i}_x.jpg", f"lake {i}", long.format(i)) for i in range(8)] + [
        ("i/a90_x.jpg", "lake 90", ""), ("i/a91_x.jpg", "w " * 21, long), ("i/a92_x.jpg", "lake 92", "too few"), ("i/a93_x.jpg", "a lake", "the lake " * 8)
    ]
    df = spark.createDataFrame(rows, "path string, short string, detail string")
    splits = spark.createDataFrame([(f"lake {i}", "val" if i > 5 else "train") for i in range(8)], "`group` string, split string")
    c, why = manifest.mixed_candidates(df, splits, 3)
    assert {r.reason: r.n for r in why.collect()} == {
        "missing_detail": 1, "short_over_20_words": 1, "detail_outside_12_50_words": 1, "detail_not_meaningfully_different": 1
    }
    got, _ = select.greedy_quota(c, {"train": 4, "val": 2})
    assert [r["caption_kind"] for r in got] == ["short", "short", "detail", "detail", "short", "detail"]
    short, detail = df.select("path", "short"), df.select("path", "detail").where("detail <> ''")
    assert manifest.paired_captions(short, detail, "path").where("detail is null").count() == 1
    p = manifest.prompts(spark.createDataFrame([("Forest",)], "label string"), "label", ["a photo of {}.", "{} from above"]).orderBy("template_no")
    assert [r.prompt for r in p.collect()] == ["a photo of Forest.", "Forest from above"]
