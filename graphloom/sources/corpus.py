"""Files of a corpus, its state and logs, as DataFrames."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never part of a corpus.
SKIPPED = (".git", ".venv", "__pycache__", "node_modules")


@dataclass(frozen=True)
class CorpusConfig:
    name: str
    root: str
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    granularity: str = "file"
    heading_min_level: int = 2
    heading_max_level: int = 4
    node_aliases: dict[str, str] = field(default_factory=dict)
    patterns: list[dict] = field(default_factory=list)

    def __post_init__(self):
        if not re.fullmatch(r"[\w.-]+", self.name):
            raise ValueError(f"bad corpus name {self.name!r}")
        if self.granularity not in ("file", "section"):
            raise ValueError("granularity is file or section")
        if not 1 <= self.heading_min_level <= self.heading_max_level <= 6:
            raise ValueError("heading levels go from 1 to 6, the lowest first")

    @classmethod
    def load(cls, text: str, defaults: dict | None = None) -> CorpusConfig:
        """From TOML over defaults, tables merged key by key; unknown keys are an error."""
        found = merged(defaults or {}, tomllib.loads(text))
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown setting {', '.join(sorted(unknown))}")
        return cls(**found)


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: * and ? also match slashes, and **/ also nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?s)^{out}$"


def any_glob(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, g: a | path.rlike(glob_regex(g)), globs, F.lit(False))


def in_corpus(path: Column, config: CorpusConfig) -> Column:
    """Whether a path lies under the root, matches an include, no exclude, and no skipped folder below the root."""
    root = config.root.rstrip("/") + "/"
    below = F.substring(path, len(root) + 1, 1 << 30)
    skipped = F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, SKIPPED)))
    return path.startswith(root) & any_glob(below, config.include) & ~any_glob(below, config.exclude) & ~skipped


def described(files: DataFrame) -> DataFrame:
    """path, name, type, hash, size and text of files (path, content): md5 of the bytes, text with bad bytes replaced."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return files.select(
        "path", name.alias("name"), F.when(suffix == "", "unknown").otherwise(suffix).alias("type"), F.md5("content").alias("hash"), F.length("content").cast("long").alias("size"), F.decode("content", "UTF-8").alias("text")
    )


def scan(spark: SparkSession, config: CorpusConfig) -> DataFrame:
    """The corpus's files with their texts, each path once. Any store that Spark reads will do."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(config.root)
    plain = found.withColumn("path", F.regexp_replace("path", r"^file:/*(?=/)", ""))
    return described(plain.where(in_corpus(F.col("path"), config)).dropDuplicates(["path"])).withColumn("corpus", F.lit(config.name))


def by_format(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown files, which have sections, and all others."""
    return files.where("type = '.md'"), files.where("type <> '.md'")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are not valid."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    return rows.where("_bad IS NULL").drop("_bad"), rows.where("_bad IS NOT NULL").select("_bad")


USAGE = "provider string, model string, call_site string, input_tokens long, output_tokens long, timestamp string"


def log_usage(rows: DataFrame, path: str) -> None:
    """Append usage records to the folder of their day."""
    rows.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(path)


def costs(usage: DataFrame, since: str | None = None) -> DataFrame:
    """Tokens by provider of usage records with timestamp, from a day (YYYY-MM-DD) on."""
    rows = usage if since is None else usage.where(F.substring("timestamp", 1, 10) >= since)
    return rows.groupBy("provider").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def token_estimate(files: DataFrame, text: str = "text") -> DataFrame:
    """Files and a quarter of their characters, rounded down: what indexing would read."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).cast("long").alias("tokens"))


class Checkpoint:
    """How far a phase came, in a JSON file that is replaced whole."""

    def __init__(self, path: str):
        self.path = Path(path)

    def save(self, phase: str, batch: int, file: str | None = None) -> None:
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"phase": phase, "last_committed_batch": batch, "last_committed_file": file}), encoding="utf-8")
        part.replace(self.path)

    def load(self) -> dict | None:
        if not self.path.exists():
            return None
        found = json.loads(self.path.read_text(encoding="utf-8"))
        phase, batch, file = (found.get(k) for k in ("phase", "last_committed_batch", "last_committed_file"))
        if not isinstance(phase, str) or isinstance(batch, bool) or not isinstance(batch, int) or not isinstance(file, str | None):
            raise ValueError("the checkpoint is malformed")
        return found
