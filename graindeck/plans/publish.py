"""Publishing: atomic, immutable and multi-part results with an audit (SK1 to SK6, SK10), provenance."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.schema import ConstraintError


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def content_digest(df: DataFrame) -> str:
    """A digest of the rows, in any order: count, and the sums of two independent row hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    r = df.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(7), row).cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1] or 0}:{r[2] or 0}"


def publish(parts: dict[str, DataFrame], target: str, audit: dict[str, Any] | None = None, kind: str = "parquet") -> str:
    """SK1, SK5: write all parts and the audit below a staging folder, then rename it: all or nothing, never partial.

    The folder must not exist. Works on any Hadoop file system whose rename of a folder is atomic.
    """
    spark = next(iter(parts.values())).sparkSession
    fs, to = _fs(spark, target)
    if fs.exists(to):
        raise ConstraintError(f"{target} exists")
    staging = f"{target}.part-{uuid.uuid4().hex}"
    try:
        for name, df in parts.items():
            df.write.format(kind).save(f"{staging}/{name}")
        spark.createDataFrame([(json.dumps(audit or {}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/audit")
        if not fs.rename(_fs(spark, staging)[1], to):
            raise ConstraintError(f"{target} could not be published")
    finally:
        if fs.exists(p := _fs(spark, staging)[1]):
            fs.delete(p, True)
    return target


def publish_immutable(df: DataFrame, target: str) -> str:
    """SK3: publish once. The same rows again are a no-op ("reused"), other rows an error."""
    spark = df.sparkSession
    fs, to = _fs(spark, target)
    if fs.exists(to):
        if content_digest(spark.read.parquet(f"{target}/data")) == content_digest(df):
            return "reused"
        raise ConstraintError(f"{target} has other content")
    publish({"data": df}, target, {"digest": content_digest(df)})
    return "written"


def write_bytes(path: str, data: bytes, immutable: bool = False) -> str:
    """SK2, SK3, SK4: one small file by a part file and a rename; immutable: other content or a stale part is an error."""
    to, part = Path(path), Path(f"{path}.part")
    if immutable and part.exists():
        raise ConstraintError(f"{part} is left over from another writer")
    if immutable and to.exists():
        if to.read_bytes() == data:
            return "reused"
        raise ConstraintError(f"{path} has other content")
    to.parent.mkdir(parents=True, exist_ok=True)
    part.write_bytes(data)
    os.replace(part, to)
    return "written"


def write_jsonl(df: DataFrame, path: str, order: str) -> int:
    """SK1 for a manifest in its order, row by row through the driver, never held as a whole."""
    part, n = Path(f"{path}.part"), 0
    with part.open("w", encoding="utf-8") as out:
        for r in df.orderBy(order).drop(order).toLocalIterator(prefetchPartitions=True):
            out.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")
            n += 1
    os.replace(part, path)
    return n


def write_csv(rows: list[dict[str, str]], fields: list[str], path: str) -> str:
    """SK4: quoted where needed, refusing other content."""
    import csv
    import io

    out = io.StringIO()
    w = csv.DictWriter(out, fields, lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return write_bytes(path, out.getvalue().encode(), immutable=True)


def append_log(df: DataFrame, path: str) -> None:
    """SK6."""
    df.write.mode("append").json(path)


def markdown_table(df: DataFrame, order: str) -> str:
    """SK10: a table of a small result, more than 1,000 rows are an error; floats with six digits."""
    rows = df.orderBy(order).limit(1001).collect()
    if len(rows) > 1000:
        raise ConstraintError("a table of more than 1,000 rows")
    show = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]]
    return "\n".join(lines) + "\n"


def truncate_log(path: str, archive: str, at: int, step: str = "step") -> tuple[int, int]:
    """ST4: keep steps up to ``at`` in a JSON-lines log; the rest is archived before the log is replaced."""
    lines = [x for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]
    steps = [json.loads(x)[step] for x in lines]
    if any(type(s) is not int for s in steps) or any(b <= a for a, b in zip(steps, steps[1:], strict=False)):
        raise ConstraintError("steps are not increasing whole numbers")
    keep, rest = [x for x, s in zip(lines, steps, strict=True) if s <= at], [x for x, s in zip(lines, steps, strict=True) if s > at]
    if rest:
        write_bytes(archive, ("\n".join(rest) + "\n").encode(), immutable=True)
        write_bytes(path, ("".join(x + "\n" for x in keep)).encode())
    return len(keep), len(rest)


def compare_identity(old: dict[str, Any], new: dict[str, Any], advisory: set[str]) -> tuple[dict, dict]:
    """Fields that differ, those that block a resume apart from those that only advise."""
    diff = {k: (old.get(k), new.get(k)) for k in sorted(old.keys() | new.keys()) if old.get(k) != new.get(k)}
    return {k: v for k, v in diff.items() if k not in advisory}, {k: v for k, v in diff.items() if k in advisory}


def run_state(folder: str, summary: str = "summary.json", checkpoint: str = "last.ckpt") -> str:
    """Fresh, resume or complete, by what a run has left; anything else is an error."""
    root = Path(folder)
    if not root.exists() or not any(root.iterdir()):
        return "fresh"
    if (root / summary).exists():
        done = json.loads((root / summary).read_text())
        if done.get("completed") is True and done.get("steps") == done.get("target_steps"):
            return "complete"
    if (root / checkpoint).exists():
        return "resume"
    raise ConstraintError(f"{folder} holds neither a checkpoint nor a finished run")


def reuse_or_build(path: str, identity: dict[str, Any], build: Callable[[], dict[str, Any]]) -> tuple[dict[str, Any], str]:
    """A stored report of this identity whose mean recall follows from its recalls is reused, else built."""
    at = Path(path)
    if at.exists():
        report = json.loads(at.read_text())
        if report.get("identity") == identity and check_report(report):
            return report, "reused"
        shutil.move(at, f"{path}.stale")
    report = build() | {"identity": identity}
    write_bytes(path, json.dumps(report, sort_keys=True).encode())
    return report, "built"


def check_report(report: dict[str, Any]) -> bool:
    """0 <= r1 <= r5 <= r10 <= 1 in both directions and their mean within 1e-12."""
    values = []
    for d in ("image_to_text", "text_to_image"):
        r = [report["metrics"][d][k] for k in ("r1", "r5", "r10")]
        if any(isinstance(x, bool) or not isinstance(x, int | float) for x in r) or not 0 <= r[0] <= r[1] <= r[2] <= 1:
            return False
        values += r
    return abs(sum(values) / 6 - report["metrics"]["mean_recall"]) <= 1e-12
