"""Files, archives, settings (SC11 to SC15, SC17, SC18, SK7 to SK9)."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import tomllib
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.schema import IMAGE_SUFFIXES, REFERENCE_SUFFIXES, ConstraintError

#: Bytes of an archive that a task reads as a whole; of larger ones only the directory is read.
MOST_INLINE = 256 << 20


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """SC11: path relative to the root, name, length. Contents are not read: only listing columns are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    out = files.withColumn("path", F.expr(f"substring(path, instr(path, '{base}') + {len(base)})"))
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.lower("path").endswith(s)
    return out.where(ok).withColumn("name", F.element_at(F.split("path", "/"), -1))


def class_directories(files: DataFrame, expected: int | None = None) -> DataFrame:
    """SC12: the label of a file is its directory's name; ``expected`` files in all or an error."""
    out = files.withColumn("label", F.element_at(F.split("path", "/"), -2))
    if expected is not None and (n := out.count()) != expected:
        raise ConstraintError(f"{n} files; {expected} expected")
    return out


class HadoopFile(io.RawIOBase):
    """A file of any Hadoop file system, read by the driver where it is asked for: seeking reads nothing."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size, self.stream, self.at = fs.getFileStatus(p).getLen(), fs.open(p), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def readinto(self, buffer) -> int:
        self.stream.seek(min(self.at, self.size))
        data = bytes(self.stream.readNBytes(max(0, min(len(buffer), self.size - self.at))))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def _listed(path: str, archive) -> list[tuple]:
    with zipfile.ZipFile(archive) as z:
        return [(path, m.filename, m.file_size, m.CRC) for m in z.infolist() if not m.is_dir()]


def archive_members(spark: SparkSession, paths: str, most_inline: int = MOST_INLINE) -> DataFrame:
    """SC13: archive, member, size, crc of every file in ZIP archives. Tasks read archives of up to ``most_inline`` bytes; of
    larger ones, which a row cannot hold, the driver reads the directories at their ends, one archive after the other."""
    schema = "archive string, member string, size bigint, crc bigint"

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = [x for path, content in zip(pdf["path"], pdf["content"], strict=True) for x in _listed(path, io.BytesIO(content))]
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "crc"])

    files = spark.read.format("binaryFile").load(paths)
    out = files.where(F.col("length") <= most_inline).select("path", "content").mapInPandas(run, schema)
    large = [r[0] for r in files.where(F.col("length") > most_inline).select("path").orderBy("path").collect()]
    for path in large:
        with io.BufferedReader(HadoopFile(spark, path), 1 << 20) as f:
            out = out.union(spark.createDataFrame(_listed(path, f), schema))
    return out


def member_names(member: Column, stem: str, roots: Iterable[str]) -> Column:
    """SC14: the names a member may be asked for by, best first: its path and all suffixes of it, its whole path under the
    archive's name if it does not begin with that, and a bare name under each root in order."""
    parts = F.filter(F.split(F.replace(member, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    whole = F.array_join(parts, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    none = F.array().cast("array<string>")
    under = F.when(F.element_at(parts, 1) != stem, F.array(F.concat(F.lit(f"{stem}/"), whole))).otherwise(none)
    bare = F.when(F.size(parts) == 1, F.array(*[F.concat(F.lit(f"{r}/"), whole) for r in sorted(set(roots))])).otherwise(none)
    return F.when(F.size(parts) > 0, F.array_distinct(F.concat(suffixes, under, bare))).otherwise(none)


def match_members(members: DataFrame, wanted: DataFrame, names: Column, path: str, most_bytes: int) -> DataFrame:
    """SC13: wanted paths with their member. Missing, ambiguous and oversized ones are errors."""
    by_name = members.select("*", F.posexplode(names).alias("place", path))
    best = by_name.join(wanted.select(path).distinct(), path).groupBy(path, "archive", "member", "size", "crc").agg(F.min("place").alias("place"))
    top = best.groupBy(path).agg(F.min("place").alias("place"))
    found = best.join(top, [path, "place"])
    if bad := found.groupBy(path).count().where("count > 1").limit(1).collect():
        raise ConstraintError(f"more than one member for {bad[0][0]}")
    if bad := wanted.join(found, path, "left_anti").limit(1).collect():
        raise ConstraintError(f"no member for {bad[0][path]}")
    if bad := found.where(F.col("size") > most_bytes).limit(1).collect():
        raise ConstraintError(f"member too large: {bad[0][path]}")
    return found.drop("place")


def bundle_matches(members: DataFrame, listed: DataFrame, path: str) -> None:
    """SC15: the members are exactly the listed paths."""
    from graindeck.operators.quality import set_difference

    if bad := set_difference(members.select(F.col("member").alias(path)), listed.select(path)).limit(3).collect():
        raise ConstraintError(f"members and list differ: {[tuple(r) for r in bad]}")


def extract_member(archive: str, member: str, target: str, size: int, crc: int) -> str:
    """SK8: write a member unless the same content is there (size and CRC); other content there is an error."""
    to = Path(target)
    if to.exists():
        data = to.read_bytes()
        if len(data) == size and zlib.crc32(data) == crc:
            return "reused"
        raise ConstraintError(f"{target} has other content")
    with zipfile.ZipFile(archive) as z:
        data = z.read(member)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ConstraintError(f"{member} is not what the index says")
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    part.write_bytes(data)
    os.replace(part, to)
    return "written"


def write_archive(target: str, files: Iterable[tuple[str, bytes]], texts: Iterable[tuple[str, str]]) -> None:
    """SK7: images stored as they are, metadata deflated; fixed times, so equal input gives equal bytes."""
    part = f"{target}.part"
    with zipfile.ZipFile(part, "w") as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED)
        for name, text in texts:
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    os.replace(part, target)


def package(target: str, root: str, suffixes: tuple[str, ...] = (".csv", ".json", ".jsonl", ".log", ".md", ".toml", ".txt")) -> list[str]:
    """SK9: a tar.gz of the reports below a folder, sorted, by a list of suffixes, so never weights; links are left out."""
    names = sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and not p.is_symlink() and p.suffix in suffixes)
    with tarfile.open(f"{target}.part", "w:gz") as t:
        for n in names:
            t.add(Path(root, n), n, filter=lambda i: i.replace(mtime=0, uid=0, gid=0, uname="", gname=""))
    os.replace(f"{target}.part", target)
    return names


_NAME = re.compile(r"\$(\w+|\{[^}]*\})", re.ASCII)


@dataclass(frozen=True)
class Setting:
    """A typed setting of a configuration file with its default."""

    name: str
    kind: type
    default: Any = None


def load_settings(text: str, settings: Iterable[Setting], environment: dict[str, str] | None = None) -> dict[str, Any]:
    """SC17: TOML to a flat dict of dotted names; ~, $NAME and ${NAME} are expanded in strings, a name being as long as it
    can be and unknown ones staying as they are; a bool is no number."""
    env = os.environ if environment is None else environment
    tree = tomllib.loads(text)
    out = {}

    def expanded(v: Any) -> Any:
        if not isinstance(v, str):
            return v
        if v == "~" or v.startswith("~/"):
            v = env.get("HOME", "~") + v[1:]
        return _NAME.sub(lambda m: env.get(m[1].strip("{}"), m[0]), v)

    for s in settings:
        at: Any = tree
        for part in s.name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        v = s.default if at is None else expanded(at)
        if v is not None and (type(v) is not s.kind and not (s.kind is float and type(v) is int)):
            raise ConstraintError(f"{s.name} is {type(v).__name__}, not {s.kind.__name__}")
        out[s.name] = v
    return out


def read_pairs(text: str) -> dict[str, str]:
    """SC18: name=value lines; a blank line is skipped, an empty or repeated name is an error."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if line.strip():
            k, sep, v = line.partition("=")
            if not sep or not k.strip() or k.strip() in out:
                raise ConstraintError(f"bad line: {line!r}")
            out[k.strip()] = v.strip()
    return out


# Names of fields that hold an image's path.
REFERENCE_FIELDS = ("file_name", "filename", "filepath", "image", "image_path", "path")


def image_strings(value: Any) -> Iterator[str]:
    """texts with an image's suffix in fields that hold a path, anywhere in a JSON value."""
    pending = [value] if isinstance(value, dict | list) else []
    while pending:
        at = pending.pop()
        if isinstance(at, dict):
            named = [(k.lower() in REFERENCE_FIELDS, v) for k, v in at.items()]
        elif isinstance(at, list):
            named = [(False, v) for v in at]
        elif isinstance(at, str):  # was found in such a field
            yield at
            continue
        else:
            continue
        wanted = lambda v: isinstance(v, str) and Path(v).suffix.lower() in REFERENCE_SUFFIXES
        pending += [v for field, v in reversed(named) if isinstance(v, dict | list) or (field and wanted(v))]


def image_references(df: DataFrame, json_text: str, *keep: str) -> DataFrame:
    """F14 over a column of JSON texts: one row a reference, with the columns to keep."""
    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else list(image_strings(json.loads(t))))

    return df.select(*keep, F.explode(found(json_text)).alias("reference"))
