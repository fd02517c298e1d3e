"""Parquet cache of embeddings, one folder per model, keyed by a text hash.

Every save adds a generation: a folder written aside and renamed into place, so
readers see all of it or none, and unchanged vectors are never rewritten. A generation
holds a manifest of what the write saw: vectors, their length, whether all are sound,
the range of hashes, its files and their sizes. A load reads the manifests, no vector;
only a generation whose files are not those of its manifest is looked through again.
``merge`` writes the last vector of each text of all generations as one, which names
those it replaces; ``vacuum`` deletes them.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, env_value
from ..schemas import EMBEDDING_CACHE
from ..session import runs_locally, shared_dir

log = logging.getLogger("siftmark")

_GENERATION = "gen-"
_MANIFEST = "_manifest.json"


def cache_path(cfg: Config, spark: SparkSession | None = None) -> str:
    """Folder for the configured model.

    Setting, then environment, then the platform cache folder; on a cluster, whose
    executors cannot see the driver's home, the shared folder takes its place.
    """
    base = cfg.cache_dir or env_value("CACHE_DIR")
    if base is None and spark and not runs_locally(spark):
        base = f"{shared_dir(spark)}/siftmark-embeddings"
    if base is None:
        home = os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")
        base = os.path.join(home, "siftmark")
    slug = cfg.model_repo.replace("/", "__")
    if cfg.model_dir:  # a local model must not share vectors with the named one
        where = os.path.abspath(cfg.model_dir).encode()
        slug = f"{slug}@{hashlib.sha256(where).hexdigest()[:16]}"
    return f"{base.rstrip('/')}/{slug}"


@F.arrow_udf(T.BooleanType())
def _is_sound(vectors: pa.Array, dims: pa.Array) -> pa.Array:
    """Per row: present, as long as its ``dim`` says, and finite throughout."""
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    finite = np.isfinite(vectors.flatten().to_numpy(zero_copy_only=False))  # null reads as NaN
    rows = np.repeat(np.arange(len(sizes)), sizes)
    broken = np.bincount(rows[~finite], minlength=len(sizes)) > 0
    expected = dims.fill_null(-1).to_numpy(zero_copy_only=False)
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(present & (sizes == expected) & ~broken)


def is_consistent(entries: DataFrame) -> bool:
    """All vectors are as long as the one cache dimension and finite throughout."""
    seen = entries.select("*", _is_sound("embedding", "dim").alias("_sound")).agg(*_measures())
    return Manifest.of(seen.first().asDict()).sound


def _measures() -> list[Column]:
    """What a manifest says, over rows with the column ``_sound``."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bool_and("_sound"), F.lit(True)).alias("sound"),
        F.min("dim").alias("low"),
        F.max("dim").alias("high"),
        F.min("text_hash").alias("first"),
        F.max("text_hash").alias("last"),
    ]


@dataclass(frozen=True)
class Manifest:
    rows: int
    dim: int | None
    sound: bool
    first: str | None
    last: str | None
    files: dict[str, int] = field(default_factory=dict)
    replaces: tuple[str, ...] = ()

    @classmethod
    def of(cls, seen: dict, files: dict | None = None, replaces: Sequence[str] = ()) -> Manifest:
        one = seen["low"] == seen["high"]
        return cls(
            seen["rows"], seen["low"] if one else None, bool(seen["sound"] and one),
            seen["first"], seen["last"], files or {}, tuple(replaces),
        )

    def may_hold(self, key: str) -> bool:
        return self.first is not None and self.first <= key <= self.last


@dataclass(frozen=True)
class EmbeddingCache:
    spark: SparkSession
    path: str

    @classmethod
    def at(cls, spark: SparkSession, cfg: Config) -> EmbeddingCache:
        return cls(spark, cache_path(cfg, spark))

    def empty(self) -> DataFrame:
        none = self.spark.createDataFrame([], EMBEDDING_CACHE)
        return none.withColumn("generation", F.lit(""))

    def load(self) -> DataFrame:
        """Cached entries; empty when missing, unreadable or inconsistent. Never fails."""
        return self._load()

    def _load(self, key: str | None = None) -> DataFrame:
        """The entries, or of a single text's key those generations that may hold it."""
        try:
            known = self.manifests()
            dims = {m.dim for m in known.values() if m.rows}
            if not all(m.sound for m in known.values()) or len(dims) > 1:
                log.warning("ignoring %s: its vectors differ in length or are not finite", self.path)
                return self.empty()
            names = [n for n, m in known.items() if m.rows and (key is None or m.may_hold(key))]
            return self._rows(names) if names else self.empty()
        except (PySparkException, Py4JError, ValueError) as err:
            log.warning("ignoring %s, which cannot be read: %s", self.path, err)
            return self.empty()

    def _rows(self, names: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/{name}" for name in names]
        return self.spark.read.schema(EMBEDDING_CACHE).parquet(*paths).select(
            "*",
            F.regexp_extract("_metadata.file_path", f"/{_GENERATION}([^/]+)/", 1).alias("generation"),
        )

    def get(self, text: str) -> list[float] | None:
        """Vector of a text, the one written last."""
        key = hashlib.sha256(text.encode()).hexdigest()
        found = self._load(key).where(F.col("text_hash") == key)
        rows = found.orderBy(F.desc("generation"), F.desc("embedding")).select("embedding").take(1)
        return list(rows[0].embedding) if rows else None

    def insert(self, text: str, vector: Sequence[float]) -> None:
        """Set the vector of one text; it replaces an earlier one."""
        row = (hashlib.sha256(text.encode()).hexdigest(), len(vector), [float(x) for x in vector])
        self.save(self.spark.createDataFrame([row], EMBEDDING_CACHE))

    def save(self, entries: DataFrame) -> None:
        """Add (text_hash, dim, embedding) rows as one new generation, the newest."""
        self._add(entries)

    def merge(self) -> None:
        """Replace all generations by one with the last vector of each text, by key ranges."""
        names = list(self.manifests())
        if len(names) < 2:
            return
        last = F.max(F.struct("generation", "dim", "embedding")).alias("last")
        unique = self.load().groupBy("text_hash").agg(last).select("text_hash", "last.*")
        laid_out = unique.repartitionByRange("text_hash").sortWithinPartitions("text_hash")
        self._add(laid_out, replaces=names)

    def vacuum(self) -> None:
        """Delete replaced generations; no earlier load may still be read."""
        fs, path_of = self._filesystem()
        for name in self._generations().keys() - self.manifests().keys():
            fs.delete(path_of(f"{self.path}/{name}"), True)

    def manifests(self) -> dict[str, Manifest]:
        """The generations in force, oldest first."""
        found = {name: self._manifest(name, files) for name, files in self._generations().items()}
        gone = {old for m in found.values() for old in m.replaces}
        return {name: found[name] for name in sorted(found) if name not in gone}

    def _add(self, entries: DataFrame, replaces: Sequence[str] = ()) -> None:
        staged, seen = f"{self.path}/.staging-{uuid.uuid4().hex}", Observation()
        rows = entries.select(*EMBEDDING_CACHE.names)
        checked = rows.select("*", _is_sound("embedding", "dim").alias("_sound"))
        checked.observe(seen, *_measures()).drop("_sound").write.parquet(staged)
        fs, path_of = self._filesystem()
        made = Manifest.of(seen.get, self._files(fs, path_of(staged)), replaces)
        out = fs.create(path_of(f"{staged}/{_MANIFEST}"))
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        final = f"{self.path}/{_GENERATION}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        if not fs.rename(path_of(staged), path_of(final)):
            raise OSError(f"could not move {staged} to {final}")
        log.info("new vectors are in %s", final)

    def _manifest(self, name: str, files: dict[str, int]) -> Manifest:
        """As written with the generation; one without, or with other files, is read through."""
        fs, path_of = self._filesystem()
        at = path_of(f"{self.path}/{name}/{_MANIFEST}")
        if fs.exists(at):
            stream = fs.open(at)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            told = json.loads(text)
            made = Manifest(**{**told, "replaces": tuple(told["replaces"])})
            if made.files == files:
                return made
        checked = self._rows([name]).select("*", _is_sound("embedding", "dim").alias("_sound"))
        return Manifest.of(checked.agg(*_measures()).first().asDict(), files)

    def _filesystem(self):
        jvm = self.spark.sparkContext._jvm
        path_of = jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path_of(self.path).getFileSystem(conf), path_of

    @staticmethod
    def _files(fs, folder) -> dict[str, int]:
        """Data files of a generation and their sizes."""
        found = fs.listStatus(folder)
        named = {f.getPath().getName(): f.getLen() for f in found if f.isFile()}
        return {n: size for n, size in named.items() if not n.startswith(("_", "."))}

    def _generations(self) -> dict[str, dict[str, int]]:
        fs, path_of = self._filesystem()
        found = fs.globStatus(path_of(f"{self.path}/{_GENERATION}*")) or []
        return {f.getPath().getName(): self._files(fs, f.getPath()) for f in found}
