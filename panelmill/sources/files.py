"""Sources and sinks: typed text scans, Parquet, CSV, JSON, appending logs, folders, integrity manifests."""

from __future__ import annotations

import json
import os
import platform
import re
import tempfile
import uuid
from dataclasses import dataclass, field
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.columns import month_of, normalise_names, number, snake_case


def _store(path: str):
    """Hadoop's file system and path for ``path``: any store that Spark reads."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(path: str) -> str:
    """A small UTF-8 text file."""
    fs, at = _store(path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(text: str, path: str) -> None:
    fs, at = _store(path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def _flat(tree: dict, at: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in tree.items():
        out |= _flat(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": v}
    return out


_YAML = re.compile(r"""^(\s*)([^\s#:][^:]*?)\s*:(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^#\s'"](?:(?!\s#).)*))?(?:\s+#.*)?\s*$""")


def read_yaml(text: str) -> dict[str, str]:
    """Scalars of nested ``key: value`` lines, keys joined by dots; quotes and comments as in YAML. Lists are refused."""
    out: dict[str, str] = {}
    nest: list[tuple[int, str]] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        m = _YAML.match(line)
        if m is None:
            raise ValueError(f"not a key and a value: {line!r}")
        depth, key, value = len(m[1]), m[2].strip("'\""), m[3]
        while nest and nest[-1][0] >= depth:
            nest.pop()
        name = ".".join([*(k for _, k in nest), key])
        if value is None:
            nest.append((depth, key))
        elif value[0] in "'\"":
            out[name] = json.loads(value) if value[0] == '"' else value[1:-1].replace("''", "'")
        else:
            out[name] = value.strip()
    return out


_OWN_DIR: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``; in a local session without it, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="panelmill-"))
        base = _OWN_DIR[0]
    return f"{base}/panelmill-{uuid.uuid4().hex}"


def exists(path: str) -> bool:
    fs, at = _store(path)
    return fs.exists(at)


def stamp(path: str) -> tuple:
    """Names, sizes and times of the files at ``path``, a file or a folder."""
    fs, at = _store(path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def fresh_folder(path: str) -> str:
    """An empty folder at ``path``; what was there goes."""
    fs, at = _store(path)
    fs.delete(at, True)
    fs.mkdirs(at)
    return path


def move(path: str, to: str) -> None:
    """Move a file or folder; fails if ``to`` exists."""
    fs, at = _store(path)
    if fs.exists(_store(to)[1]) or not fs.rename(at, _store(to)[1]):
        raise FileExistsError(to)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that later steps start from files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions of what the library runs on, and the session's size."""
    names = ("pyspark", "numpy", "pandas", "pyarrow")
    return {"python": platform.python_version(), "spark": spark.version, "default_parallelism": str(spark.sparkContext.defaultParallelism)} | {n: metadata.version(n) for n in names}


def require_versions(spark: SparkSession, least: dict[str, str]) -> None:
    """Raise if something is older than wanted."""
    have, number = environment(spark), lambda v: tuple(int(x) for x in re.findall(r"\d+", v)[:3])
    if old := {n: have.get(n) for n, v in least.items() if n not in have or number(have[n]) < number(v)}:
        raise RuntimeError(f"too old or absent: {old}")


@dataclass(frozen=True)
class Source:
    """A CSV table: where it is, its text keys; every other column is a measure."""

    path: str
    keys: tuple[str, ...] = ()
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class Paths:
    """Named paths, relative ones resolved against the configuration's folder."""

    base: str
    tables: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Paths":
        """From JSON, or YAML of nested ``key: value`` lines; nested keys are joined by dots."""
        text = read_text(path).removeprefix("\ufeff")
        tables = _flat(json.loads(text)) if path.endswith(".json") else read_yaml(text)
        return cls(os.path.dirname(os.path.abspath(path)), tables)

    def __getitem__(self, name: str) -> str:
        p = self.tables[name]
        return p if "://" in p or os.path.isabs(p) else os.path.normpath(os.path.join(self.base, p))


def scan_csv(spark: SparkSession, source: Source) -> DataFrame:
    """All columns as text, names normalised; keys stay text, months parse, measures are coerced."""
    raw = normalise_names(spark.read.option("header", True).option("encoding", "UTF-8").csv(source.path))
    if lost := sorted({snake_case(c) for c in (*source.keys, *source.required)} - set(raw.columns)):
        raise ValueError(f"{source.path} lacks {lost}")
    return raw.select(*(month_of(c).alias(c) if c == "month" else F.col(c) if c in source.keys else number(c).alias(c) for c in raw.columns))


def scan_parquet(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A panel written by year: month bounds prune partitions too."""
    df = spark.read.parquet(path)
    for bound, low in ((since, True), (until, False)):
        if bound:
            month, year = F.col("month"), F.lit(int(bound[:4]))
            df = df.where(month >= F.lit(bound).cast("date") if low else month <= F.lit(bound).cast("date"))
            if "year" in df.columns:
                df = df.where(F.col("year") >= year if low else F.col("year") <= year)
    return df


def scan_many(spark: SparkSession, *paths: str) -> DataFrame:
    """Union by name of files that match globs, with the file each row came from."""
    frames = [spark.read.option("mergeSchema", True).parquet(p).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet by year (S6); one shuffle by year and month, so files don't multiply by tasks."""
    df.withColumn("year", F.year("month")).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_single(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One file, for small reports."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    """Append to a log."""
    df.write.mode("append").format(kind).save(path)


def write_json(report: dict, path: str) -> None:
    """A nested report."""
    write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str), path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown (S10); refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files at ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def extract_text(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """(found) of every match in text files."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("found"))
