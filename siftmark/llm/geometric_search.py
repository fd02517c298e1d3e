"""Ranked lexical search over posting lists in geometric blocks.

The documents are indexed in shards of neighbouring rows; no posting is shuffled. In a
shard, the posting list of every term of the stated queries is clustered by document
similarity: pivots spread over the list, every document to the pivot its sketch (a
random projection of its weights) is most alike. Each block stores, for every term that
shares a query with the list's term, the maximum over its documents, so its inner
product with a query is an upper bound of all their scores. Summaries are rounded up to
multiples of ``GRAIN``, hence still bounds.

A query visits a shard's lists by bound: documents only in lists whose maxima together
stay below the threshold are out (they cannot reach it), and of the other lists the
blocks are opened from the largest bound down until one falls below the threshold. What
is opened is scored exactly. A first round opens one block of each shard and query; the
k-th best score found anywhere is a threshold no result can be below, which the second
round starts from. Skipping is by exact bounds only, so the results are those of scoring
every document.

Scores are integers, see :func:`rank`. Null and empty texts have no terms and are not
counted. A query without terms, or with none that occurs, has no results. Repeated
queries are answered each, repeated documents ranked each; equal scores are ordered by
key, null keys first. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import materialize
from .common import mix64, slices, texts_of

#: Documents of a shard, and the cells (documents x query terms) it may hold densely.
SHARD_DOCS, SHARD_CELLS = 4096, 1 << 24
#: Postings a block holds about, and the most blocks of a list of a shard.
BLOCK, MOST_BLOCKS = 64, 16
#: Maxima are stored as multiples of this, rounded up (weights of a document < 2**20).
GRAIN = 16
#: Distinct terms of the queries answered in one pass over the documents' weights, and
#: characters of the queries whose terms are counted in one pass over the texts.
TERMS_EACH, CHARACTERS_EACH = 4096, 32_000_000
SKETCH = 16

_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z lowered."""
    return (text or "").encode().translate(_WORD).split()


class Queries(NamedTuple):
    """Queries over their own ``vocabulary``: ids, distinct terms, repeats."""

    keys: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: list[bytes]

    @classmethod
    def of(cls, keys: list, counted: list[Counter]) -> Queries:
        vocabulary = sorted(set().union(*counted))
        at = {t: i for i, t in enumerate(vocabulary)}
        found, times = [], []
        for count in counted:
            ids = sorted(at[t] for t in count)
            found.append(np.array(ids, np.int64))
            times.append(np.array([count[vocabulary[i]] for i in ids], np.int64))
        return cls(keys, found, times, vocabulary)

    def partners(self) -> list[np.ndarray]:
        """For each term the terms of all queries that hold it, itself included."""
        out: list[list] = [[] for _ in self.vocabulary]
        for ids in self.terms:
            for t in ids.tolist():
                out[t].append(ids)
        return [np.unique(np.concatenate(x)) for x in out]


def _query_groups(rows: Iterable[Row], most: int) -> Iterator[tuple[list, list[Counter]]]:
    keys, counted, held = [], [], 0
    for key, text in rows:
        keys.append(key)
        counted.append(Counter(terms(text)))
        held += len(text or "")
        if held >= most:
            yield keys, counted
            keys, counted, held = [], [], 0
    if keys:
        yield keys, counted


def _query_blocks(keys: list, counted: list[Counter], most: int) -> Iterator[Queries]:
    """Runs of queries of at most ``most`` distinct terms (or of one query)."""
    first, seen = 0, set()
    for i, count in enumerate(counted):
        if i > first and len(seen | count.keys()) > most:
            yield Queries.of(keys[first:i], counted[first:i])
            first, seen = i, set()
        seen |= count.keys()
    yield Queries.of(keys[first:], counted[first:])


# --- weights of the documents ----------------------------------------------------


def forward(docs: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """key, n (terms with repeats), terms (places in ``vocabulary``) and tfs, row by row."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(vocabulary)}
        for rows in slices(batches, "text"):
            n, ids, tfs, stops = [], [], [], [0]
            for value in texts_of(rows.column("text")):
                counted = Counter(terms(value))
                n.append(counted.total())
                for term in counted.keys() & at.keys():
                    ids.append(at[term])
                    tfs.append(counted[term])
                stops.append(len(ids))
            offsets = pa.array(stops, pa.int32())
            yield pa.record_batch(
                [
                    rows.column("key"),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                ["key", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(count, f"key {kind}, n long, terms array<int>, tfs array<int>")
    return materialize(made.where("n > 0"), "search_forward")


class Corpus(NamedTuple):
    """Documents with a term, their terms, and documents holding each query term."""

    documents: int
    length: int
    df: dict[int, int]

    @classmethod
    def of(cls, rows: DataFrame) -> Corpus:
        total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        # At most one row per distinct term of the queries.
        held = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        return cls(total.n, total.l, {r.t: r.df for r in held.collect()})

    def weight(self, term: int) -> int:
        df = self.df.get(term, 0)
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


# --- the index -------------------------------------------------------------------


class Shard(NamedTuple):
    """Documents of a shard by rows (``cols``, ``impacts`` from ``ptr``) and by blocks.

    Term t has the blocks ``lists[t]:lists[t+1]``; block b the documents
    ``members[blocks[b]:blocks[b+1]]``; the summaries of t are ``maxima`` from
    ``rows[t]``, one row of its partners' maxima per block.
    """

    ptr: np.ndarray
    cols: np.ndarray
    impacts: np.ndarray
    lists: np.ndarray
    blocks: np.ndarray
    members: np.ndarray
    rows: np.ndarray
    maxima: np.ndarray


_KINDS = Shard("<i4", "<i4", "<i4", "<i4", "<i4", "<u2", "<i8", "<u2")


def _clusters(sketch: np.ndarray, wanted: int) -> np.ndarray:
    """Of each row the pivot, spread evenly over the rows, that it is most alike."""
    at = np.linspace(0, len(sketch) - 1, wanted).astype(np.int64)
    return (sketch @ sketch[at].T).argmax(1)


def build_shard(ptr, cols, impacts, partners: list[np.ndarray]) -> Shard:
    """Posting lists of all terms in blocks of similar documents, with their maxima."""
    n, width = len(ptr) - 1, len(partners)
    row = np.repeat(np.arange(n), np.diff(ptr))
    dense = np.zeros((n, width), np.uint16)
    dense[row, cols] = -(-impacts // GRAIN)
    signs = mix64(np.arange(width * SKETCH, dtype=np.uint64)).reshape(width, SKETCH)
    signs = (signs & np.uint64(1)).astype(np.float32) * 2 - 1
    sketch = np.zeros((n, SKETCH), np.float32)
    some = np.flatnonzero(np.diff(ptr))
    if len(some):
        sketch[some] = np.add.reduceat(signs[cols] * impacts[:, None].astype(np.float32), ptr[some])
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

    by_term = np.argsort(cols, kind="stable")
    begin = np.searchsorted(cols[by_term], np.arange(width + 1))
    lists, blocks, members, rows, maxima = [0], [0], [], [0], []
    for t in range(width):
        docs = row[by_term[begin[t] : begin[t + 1]]]
        made = 0
        if len(docs):
            cuts = np.zeros(1, np.int64)
            wanted = min(MOST_BLOCKS, -(-len(docs) // BLOCK))
            if wanted > 1:
                pivot = _clusters(sketch[docs], wanted)
                order = np.argsort(pivot, kind="stable")
                docs, pivot = docs[order], pivot[order]
                cuts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
            made = len(cuts)
            blocks += (cuts[1:] + blocks[-1]).tolist() + [blocks[-1] + len(docs)]
            members.append(docs)
            held = dense[docs] if 2 * len(partners[t]) > width else dense[np.ix_(docs, partners[t])]
            top = np.maximum.reduceat(held, cuts, axis=0)
            maxima.append((top if top.shape[1] == len(partners[t]) else top[:, partners[t]]).ravel())
        lists.append(lists[-1] + made)
        rows.append(rows[-1] + made * len(partners[t]))
    none = np.zeros(0, np.int64)
    parts = Shard(
        ptr, cols, impacts, lists, blocks, np.concatenate([none, *members]), rows,
        np.concatenate([none, *maxima]),
    )
    return Shard(*(np.asarray(x).astype(k) for x, k in zip(parts, _KINDS, strict=True)))


def build_index(rows: DataFrame, corpus: Corpus, places: np.ndarray, queries: Queries) -> DataFrame:
    """Written table of shards: keys of the documents and the arrays of :class:`Shard`.

    ``places`` are the ids that the queries' vocabulary has in ``rows``.
    """
    kind, arrow = rows.schema["key"].dataType.simpleString(), to_arrow_type(rows.schema["key"].dataType)
    partners, width = queries.partners(), len(queries.vocabulary)
    local = np.full(int(places.max(initial=0)) + 1, -1, np.int64)
    local[places] = np.arange(width)
    most = max(1, min(SHARD_DOCS, SHARD_CELLS // max(width, 1)))
    documents, length = corpus.documents, corpus.length

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").chunk(0)
        ids = lists.flatten().to_numpy()
        tfs = table.column("tfs").chunk(0).flatten().to_numpy().astype(np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        n = table.column("n").to_numpy()
        m = 25 + (75 * n * documents) // length
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes))
        cols = np.where(ids < len(local), local[np.minimum(ids, len(local) - 1)], -1)
        owner, known = np.repeat(np.arange(len(n)), sizes), cols >= 0
        ptr = np.r_[0, np.cumsum(np.bincount(owner[known], minlength=len(n)))]
        made = build_shard(ptr, cols[known], impacts[known], partners)
        keys = pa.ListArray.from_arrays(
            pa.array([0, len(n)], pa.int32()), table.column("key").chunk(0).cast(arrow)
        )
        return pa.record_batch(
            [keys, *[pa.array([x.tobytes()], pa.binary()) for x in made]], ["keys", *Shard._fields]
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                if count + part.num_rows > most:
                    yield shard(held)
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield shard(held)

    schema = f"keys array<{kind}>, " + ", ".join(f"{f} binary" for f in Shard._fields)
    return materialize(rows.mapInArrow(build, schema), "search_shards")


# --- queries ---------------------------------------------------------------------


class _Best:
    """The k best (score, key) of one query met by one task."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, least, []

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        if len(at) > 4 * self.k:  # all that equal the k-th stay
            cut = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] >= cut]
        self.rows += zip(scores[at].tolist(), keys.take(pa.array(at)).to_pylist(), strict=True)
        self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = max(self.least, self.rows[-1][0])


def search_shard(
    shard: Shard, keys: pa.Array, queries: Queries, weights: list[np.ndarray],
    places: list[list[np.ndarray]], best: list[_Best], first_only: bool,
) -> int:
    """Answer all queries on one shard; returns how many blocks were opened."""
    n, opened = len(shard.ptr) - 1, 0
    dense = np.zeros(len(queries.vocabulary), np.int64)
    used = np.flatnonzero(np.diff(shard.lists))
    tops = np.zeros(len(dense), np.int64)  # largest weight of a list, as a bound
    np.maximum.at(tops, shard.cols, shard.impacts)
    present = np.zeros(len(dense), bool)
    present[used] = True
    for q, (ids, w) in enumerate(zip(queries.terms, weights, strict=True)):
        have = np.flatnonzero(present[ids] & (w > 0))
        if not len(have):
            continue
        reach = tops[ids[have]] * w[have]
        order = np.argsort(reach, kind="stable")
        # Lists that cannot reach the threshold even together need no visit.
        needed = have[order[np.cumsum(reach[order]) >= best[q].least]]
        bounds, found = [], []
        for i in needed.tolist():
            t = ids[i]
            a, b = int(shard.lists[t]), int(shard.lists[t + 1])
            width = (int(shard.rows[t + 1]) - int(shard.rows[t])) // (b - a)
            top = shard.maxima[shard.rows[t] : shard.rows[t + 1]].reshape(b - a, width)
            bounds.append((top[:, places[q][i]].astype(np.int64) * GRAIN) @ w)
            found.append(np.arange(a, b))
        if not bounds:
            continue
        bound, block = np.concatenate(bounds), np.concatenate(found)
        order = np.argsort(-bound, kind="stable")
        dense[ids] = w
        seen = np.zeros(n, bool)
        for i in order.tolist():
            if bound[i] < best[q].least:
                break
            docs = shard.members[shard.blocks[block[i]] : shard.blocks[block[i] + 1]].astype(np.int64)
            docs = docs[~seen[docs]]
            opened += 1
            if len(docs):
                seen[docs] = True
                sizes = (shard.ptr[docs + 1] - shard.ptr[docs]).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                flat = np.arange(int(sizes.sum())) + np.repeat(shard.ptr[docs] - starts, sizes)
                scores = np.add.reduceat(dense[shard.cols[flat]] * shard.impacts[flat], starts)
                best[q].add(scores, keys.take(pa.array(docs)))
            if first_only:
                break
        dense[ids] = 0
    return opened


def _answers(index: DataFrame, queries: Queries, corpus: Corpus, ids: np.ndarray, k: int,
             least: list[int], first_only: bool) -> DataFrame:
    """query (its place), score, key: at most k rows of every query and task."""
    kind = index.schema["keys"].dataType.elementType
    weights = [
        np.array([corpus.weight(int(ids[t])) for t in found], np.int64) * times
        for found, times in zip(queries.terms, queries.times, strict=True)
    ]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners = queries.partners()
        places = [
            [np.searchsorted(partners[t], found) for t in found.tolist()] for found in queries.terms
        ]
        best = [_Best(k, x) for x in least]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(
                    *(
                        np.frombuffer(batch.column(f)[i].as_buffer(), t)
                        for f, t in zip(Shard._fields, _KINDS, strict=True)
                    )
                )
                keys = batch.column("keys")[i].values
                search_shard(shard, keys, queries, weights, places, best, first_only)
        rows = [(q, s, key) for q, b in enumerate(best) for s, key in b.rows]
        yield pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], to_arrow_type(kind)),
            ],
            ["query", "score", "key"],
        )

    return index.mapInArrow(answer, f"query int, score long, key {kind.simpleString()}")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item, rank (from 1), key, score: the ``k`` best documents of every query.

    N documents have a term, L terms in all, n of them in one document; df documents
    hold a term, tf times. A query term counts floor(1000 ln((2N+2)/(2df+1))) times
    10^9 tf div (1000 tf + 8 m) with m = 25 + 75 n N div L, repeats included. Scores
    are above zero. The queries pass through the driver in groups of bounded size; the
    distinct terms of a group go to the tasks.
    """
    spark = docs.sparkSession
    item_kind = items.schema[item].dataType
    out = spark.createDataFrame(
        [],
        f"`{item}` {item_kind.simpleString()}, rank int,"
        f" `{key}` {docs.schema[key].dataType.simpleString()}, score long",
    )
    asked = items.select(F.col(item), F.col(item_text)).toLocalIterator()
    for keys, counted in _query_groups(asked, CHARACTERS_EACH):
        vocabulary = sorted(set().union(*counted))
        rows = forward(docs, key, text, vocabulary)
        corpus = Corpus.of(rows)
        if not corpus.documents:
            continue
        at = {t: i for i, t in enumerate(vocabulary)}
        for queries in _query_blocks(keys, counted, TERMS_EACH):
            places = np.array([at[t] for t in queries.vocabulary], np.int64)
            index = build_index(rows, corpus, places, queries)
            least = [1] * len(queries.keys)
            first = _top(_answers(index, queries, corpus, places, k, least, True), k)
            for r in first.where(F.col("rank") == k).select("query", "score").collect():
                least[r.query] = max(1, r.score)  # a row per query
            found = _top(_answers(index, queries, corpus, places, k, least, False), k)
            named = spark.createDataFrame(
                pa.table(
                    [
                        pa.array(range(len(queries.keys)), pa.int32()),
                        pa.array(queries.keys, to_arrow_type(item_kind)),
                    ],
                    ["query", "item"],
                )
            )
            found = found.join(F.broadcast(named), "query")  # a row per query of the block
            part = found.select(
                F.col("item").alias(item), "rank", F.col("key").alias(key), "score"
            )
            out = out.unionByName(materialize(part, "search_results"))
    return out
