"""What the operators share: reading tables, Arrow batches, bounded word caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Text handed to one step of a Python worker; bounds its memory whatever the rows hold.
STEP_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = STEP_BYTES):
    """Cut batches into runs of rows whose ``text`` holds about ``most`` bytes.

    What Arrow keeps of a step's freed memory goes back to the system before the next one:
    workers stay alive between tasks and would hold the peak of every step they ever did.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        part = np.cumsum(size.to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
            pool.release_unused()


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column, null as empty."""
    return pc.fill_null(column, "").to_pylist()


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns called ``names``, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def append_columns(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """Add columns computed from the ``text`` column alone, row by row, no shuffle.

    Only the text goes to Python. ``make`` runs once per task and gives a function
    from an array of texts to one array per field. Columns of ``df`` that have the
    name of a field are replaced.
    """
    out = T.StructType([T.StructField(n, t) for n, t in fields])
    names, empty = [n for n, _ in fields], to_arrow_type(out)

    @F.arrow_udf(out)
    def appended(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for column in columns:
            batch = pa.record_batch([column], ["t"])
            parts = [
                pa.StructArray.from_arrays(work(s.column("t")), names)
                for s in slices([batch], "t")
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], empty)

    # Not deterministic: else a later filter would run the function a second time.
    call = appended.asNondeterministic()(F.col(text).alias("t"))
    held = without(df, names)
    return held.withColumn("_made", call).select(
        *[F.col(f"`{c}`") for c in held.columns], *[F.col(f"_made.{n}").alias(n) for n in names]
    )


class WordCache(dict):
    """Results by word, emptied when the words hold more than ``most`` characters."""

    def __init__(self, most: int = 6_000_000):
        super().__init__()
        self.most, self.held = most, 0

    def grow(self, words: Iterable, values: Iterable) -> None:
        words = list(words)
        self.update(zip(words, values, strict=True))
        self.held += sum(map(len, words)) + 8 * len(words)

    def make_room(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


class WordGenerations:
    """Results with a length by word, in two generations of about ``most`` bytes each.

    Words move to the younger when they are used; when it is full, it becomes the older
    and that is dropped. So frequent words are never forgotten.
    """

    def __init__(self, most: int = 16_000_000):
        self.most, self.held = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, words: Iterable[str]) -> Iterator[bytes]:
        """Results of words that are known."""
        return map(self.young.__getitem__, words)

    def missing(self, words: Iterable[str]) -> list[str]:
        """The words that are not known; the others are now in the younger generation."""
        absent = [w for w in words if w not in self.young]
        known = [w for w in absent if w in self.old]
        self.grow(known, [self.old[w] for w in known])
        return [w for w in absent if w not in self.old] if known else absent

    def grow(self, words: list[str], values: list[bytes]) -> None:
        self.young.update(zip(words, values, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, values)) + 8 * len(words)

    def make_room(self) -> None:
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(key: Column) -> Column:
    """The fifth of the rows that no model is trained on."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """text and label of at most ``most`` labelled documents, by smallest hash of the key.

    ``labels`` has the key and ``label``; the largest label of a key counts, null labels
    do not. Only the sampled labels (bounded by ``most``) are sent to the documents.
    """
    known = (
        labels.where(F.col("label").isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col("label").cast("int")).alias("label"))
    )
    taken = known.orderBy(F.xxhash64("_key"), "_key").limit(most)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(taken), "_key").select("text", "label")
