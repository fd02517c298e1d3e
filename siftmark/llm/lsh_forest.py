"""Near-duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Documents with equal shingle sets are one class from the start. Each class has ``TREES``
labels of ``DEPTH`` minima. In every tree the labels are sorted (range-partitioned, ties
by id, so no region is one task's); candidates are the neighbours with the longest
common prefix. A region is a run of labels that share the least depth at which a link
can hardly be missed; where a region is crowded the ``NEAREST`` neighbours on either
side go deeper by themselves, as sorted order puts the longest prefixes next to each
other. Candidates are confirmed on the full sets, links are joined to components.

In crowded regions nearer labels can hide a link. Their members are therefore joined once
more, by a prefix filter on the full sets: shingles are ordered by how often the members
hold them, and of two similar sets the rarest few of one must meet the rarest of the
other. Only shingles that several components share make groups, in which the members
outside the most frequent component are compared with the others, in blocks, by sizes,
places and minima; what is left is confirmed on the full sets.

Null, empty and blank texts have empty sets: linked with nothing, their own component.
Fewer words than a shingle make one shingle of the whole sequence. Repeated rows are
reported each; the smallest id of a component is the one kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, partitions_for
from .common import mix64, slices, texts_of

TREES = 16
DEPTH = 8
NEAREST = 6
#: Bits of the filter that picks the texts of candidates, for each of them and at most. A
#: fuller filter lets more other texts pass, never fewer candidates.
FILTER_EACH, FILTER_BITS = 16, 1 << 26
#: Counts by which the crowded members order their shingles (a power of two).
COUNTS = 1 << 20
#: Members of a block: of the most frequent component of a group, and of the others.
MAIN_EACH, OTHERS_EACH = 1_000, 400
#: Text whose shingles are made at once; they take about sixty times its bytes.
SHINGLE_BYTES = 1 << 20
#: Chance to miss a link at the threshold in all trees, which sets the least depth.
MISS = 2e-5
ROWS_EACH = 50_000
#: Rows a task should have at least of pairs with texts, of links, of region members.
PAIRS_EACH, LINKS_EACH, MEMBERS_EACH = 1_000, 10_000, 5_000

_TABLE = 4096
_FACTORS = mix64(np.arange(1, _TABLE + 1, dtype=np.uint64)) | np.uint64(1)
_MINIMA = TREES * DEPTH
_XORS = mix64(np.arange(10_001, 10_001 + _MINIMA, dtype=np.uint64))
_ODDS = mix64(np.arange(20_001, 20_001 + _MINIMA, dtype=np.uint64)) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Rule(NamedTuple):
    """Shingle length in words and least similarity in percent."""

    words: int = 3
    percent: int = 85

    @property
    def least_depth(self) -> int:
        return max(
            [1] + [d for d in range(1, DEPTH) if (1 - (self.percent / 100) ** d) ** TREES <= MISS]
        )


# --- shingles --------------------------------------------------------------------


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (runs without ASCII white space, A-Z lowered), its text."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)]
    blank = _BLANK[data]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - begin
    solid = np.flatnonzero(~blank)
    inside = np.arange(len(solid)) - np.repeat(np.cumsum(size) - size, size)
    value = (data[solid].astype(np.uint64) + np.uint64(1)) * _FACTORS[inside % _TABLE]
    if len(size) and size.max() > _TABLE:
        value *= (inside // _TABLE * 2 + 1).astype(np.uint64)
    hashed = np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64)
    starts = np.cumsum([1] + [len(r) + 1 for r in raw])
    return mix64(hashed), np.searchsorted(starts, begin, "right") - 1


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, in order of text, and where each text's begin."""
    hashed, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    n = len(hashed) - words + 1
    made, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        mixed = np.zeros(n, np.uint64)
        for k in range(words):
            mixed += hashed[k : n + k] * _FACTORS[k]
        whole = owner[:n] == owner[words - 1 :]
        made, of = mix64(mixed[whole]), owner[:n][whole]
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        first = np.cumsum(count) - count
        short = [
            int(np.sum(hashed[a : a + c] * _FACTORS[100 : 100 + c], dtype=np.uint64)) + int(c)
            for a, c in zip(first[few].tolist(), count[few].tolist(), strict=True)
        ]
        made = np.r_[made, mix64(np.array([s % 2**64 for s in short], np.uint64))]
        of = np.r_[of, few]
    order = np.lexsort((made, of))
    made, of = made[order], of[order]
    if len(made):
        fresh = np.r_[True, (made[1:] != made[:-1]) | (of[1:] != of[:-1])]
        made, of = made[fresh], of[fresh]
    return made, np.searchsorted(of, np.arange(len(texts) + 1))


def labels_of(made: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """All labels of each set, 16 bits a minimum, most significant byte first."""
    size = np.diff(starts)
    out = np.zeros((len(size), _MINIMA), ">u2")
    some = np.flatnonzero(size)
    if len(some):
        for k in range(_MINIMA):
            least = np.minimum.reduceat((made ^ _XORS[k]) * _ODDS[k], starts[some])
            out[some, k] = mix64(least) >> np.uint64(48)
    return [row.tobytes() for row in out]


def _set_hashes(made: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever the order of its shingles."""
    sums = [
        np.r_[np.uint64(0), np.cumsum(mix64(made + salt))] for salt in (np.uint64(11), np.uint64(12))
    ]
    both = np.stack([s[starts[1:]] - s[starts[:-1]] for s in sums], 1)
    return [row.tobytes() for row in both]


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, n_shingles, set_hash, labels of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SHINGLE_BYTES):
            made, starts = shingle_sets(texts_of(rows.column("text")), words)
            yield pa.record_batch(
                [
                    rows.column("id"),
                    pa.array(np.diff(starts)),
                    pa.array(_set_hashes(made, starts), pa.binary()),
                    pa.array(labels_of(made, starts), pa.binary()),
                ],
                ["id", "n_shingles", "set_hash", "labels"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, f"id {kind}, n_shingles long, set_hash binary, labels binary")


# --- the sorted trees ------------------------------------------------------------


def _neighbours(label: np.ndarray, tree, size, depth: int, percent: int):
    """Index pairs of the nearest rows of a sorted run that share ``depth`` minima.

    Also which rows lie in crowded regions, where nearer rows hide farther ones.
    """
    n = len(tree)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, np.zeros(n, bool)
    split = np.r_[
        True, (tree[1:] != tree[:-1]) | (label[1:, :depth] != label[:-1, :depth]).any(1)
    ]
    edges = np.r_[np.flatnonzero(split), n]
    stop = np.repeat(edges[1:], np.diff(edges))  # end of each row's region
    row, left, right = np.arange(n), [none], [none]
    for step in range(1, NEAREST + 1):  # looking forward meets every pair once
        row = row[row + step < stop[row]]
        at = row + step
        alike = 100 * np.minimum(size[row], size[at]) >= percent * np.maximum(size[row], size[at])
        left.append(row[alike])
        right.append(at[alike])
    crowded = np.repeat(np.diff(edges) > NEAREST + 1, np.diff(edges))
    return np.concatenate(left), np.concatenate(right), crowded


_PAIR, _HEAD, _TAIL, _CROWDED = range(4)
_RECORD = "kind int, a {id}, b {id}, part long, tree int, label binary, size long"


def _walk(depth: int, percent: int):
    """Over one sorted partition: pairs, crowded rows, and the rows at both edges."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if head is None or head.num_rows < NEAREST:
                head = table if head is None else pa.concat_tables([head, table])
                head = head.slice(0, NEAREST)
            before = 0 if kept is None else kept.num_rows
            table = table if kept is None else pa.concat_tables([kept, table])
            yield from _records(table, before, depth, percent)
            kept = table.slice(max(0, table.num_rows - NEAREST - 2))
        for kind, edge in ((_HEAD, head), (_TAIL, kept)):
            if edge is not None:
                edge = edge.slice(max(0, edge.num_rows - NEAREST)) if kind == _TAIL else edge
                yield _record(kind, edge.column("id"), None, part + (kind == _TAIL), edge)

    return walk


def _records(table: pa.Table, before: int, depth: int, percent: int):
    label = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u2")
    left, right, crowded = _neighbours(
        label.reshape(-1, DEPTH),
        table.column("tree").to_numpy(),
        table.column("size").to_numpy(),
        depth,
        percent,
    )
    new = right >= before  # pairs among the carried rows are out already
    ids = table.column("id")
    a, b = ids.to_numpy()[left[new]], ids.to_numpy()[right[new]]
    if len(a):
        low, high = pa.array(np.minimum(a, b), ids.type), pa.array(np.maximum(a, b), ids.type)
        yield _record(_PAIR, low, high, None, None)
    if crowded.any():
        yield _record(_CROWDED, ids.filter(pa.array(crowded)), None, None, None)


def _record(kind: int, a, b, part: int | None, edge: pa.Table | None) -> pa.RecordBatch:
    n = len(a)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    kinds = {"tree": pa.int32(), "label": pa.binary(), "size": pa.int64()}
    return pa.record_batch(
        [
            pa.array(np.full(n, kind, np.int32)),
            a,
            pa.nulls(n, a.type) if b is None else b,
            pa.array([part] * n, pa.int64()),
            *[
                pa.nulls(n, t) if edge is None else edge.column(c).combine_chunks()
                for c, t in kinds.items()
            ],
        ],
        ["kind", "a", "b", "part", *kinds],
    )


def _trees(nodes: DataFrame, *columns: str) -> DataFrame:
    """tree, label and the columns named: a row per tree of every node."""
    each = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(
            t.cast("int").alias("tree"),
            F.substring("labels", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("label"),
        ),
    )
    return nodes.select(*columns, F.explode(each).alias("e")).select("e.tree", "e.label", *columns)


def candidates(nodes: DataFrame, rule: Rule, rows: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b, ids in crowded regions) of nodes (id, size, labels)."""
    spark = nodes.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    order = ["tree", "label", "id"]
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    parts = max(1, min(most, rows * TREES // ROWS_EACH))
    sorted_rows = (
        _trees(nodes, "id", "size").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    )
    depth, percent = rule.least_depth, rule.percent
    walked = materialize(
        sorted_rows.mapInArrow(_walk(depth, percent), _RECORD.format(id=kind)), "forest_walk"
    )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a row per boundary, of at most 2 * NEAREST entries
            a, b = [], []
            for held in batch.column("held").to_pylist():
                held = sorted(held, key=lambda h: (h["tree"], h["label"], h["id"]))
                label = np.frombuffer(b"".join([h["label"] for h in held]), ">u2")
                tree, size = (np.array([h[c] for h in held]) for c in ("tree", "size"))
                x, y, _ = _neighbours(label.reshape(-1, DEPTH), tree, size, depth, percent)
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    low, high = sorted([held[i]["id"], held[j]["id"]])
                    a.append(low)
                    b.append(high)
            kind = batch.schema.field("held").type.value_type.field("id").type
            yield pa.record_batch([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    entry = F.struct(F.col("a").alias("id"), "tree", "label", "size")
    bridged = (
        walked.where(F.col("kind").isin(_HEAD, _TAIL))
        .groupBy("part")
        .agg(F.collect_list(entry).alias("held"))
        .select("held")
        .mapInArrow(across, f"a {kind}, b {kind}")
    )
    pairs = walked.where(F.col("kind") == _PAIR).select("a", "b").unionByName(bridged).distinct()
    crowded = walked.where(F.col("kind") == _CROWDED).select(F.col("a").alias("id")).distinct()
    return pairs, crowded


# --- crowded regions -------------------------------------------------------------


def prefixes(made: np.ndarray, starts: np.ndarray, counts: np.ndarray, percent: int):
    """(token, owner, place, early): each set's rarest shingles that others can share.

    Shingles are ordered by ``counts`` of their bucket, then by hash. Two sets that are
    similar enough share one of the first ``n - ceil(percent n / 100) + 1`` of the larger
    and of the first ``n - ceil(2 percent n / (100 + percent)) + 1`` (early) of the smaller.
    """
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    often = counts[made >> np.uint64(64 - COUNTS.bit_length() + 1)]
    order = np.lexsort((made, often, owner))
    place = np.arange(len(made)) - starts[:-1][owner]
    late = n + (-percent * n) // 100 + 1
    early = n + (-2 * percent * n) // (100 + percent) + 1
    keep = (place < late[owner]) & (often[order] > 1)
    return (
        made[order][keep].view(np.int64), owner[keep], place[keep], (place < early[owner])[keep]
    )


def _counted(crowd: DataFrame, rule: Rule) -> np.ndarray:
    """How often the members hold the shingles of each of ``COUNTS`` buckets."""
    words = rule.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for rows in slices(batches, "text", SHINGLE_BYTES):
            made, _ = shingle_sets(texts_of(rows.column("text")), words)
            bucket = (made >> np.uint64(64 - COUNTS.bit_length() + 1)).astype(np.int64)
            total += np.bincount(bucket, minlength=COUNTS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = crowd.select("text").mapInArrow(count, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # COUNTS rows at most
    counts = np.zeros(COUNTS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _tokens(crowd: DataFrame, rule: Rule) -> DataFrame:
    """token, id, comp, size, place, early: the prefixes of the crowded members."""
    kind = crowd.schema["id"].dataType.simpleString()
    words, percent = rule.words, rule.percent
    counts = crowd.sparkSession.sparkContext.broadcast(_counted(crowd, rule))  # COUNTS longs

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SHINGLE_BYTES):
            made, starts = shingle_sets(texts_of(rows.column("text")), words)
            token, owner, place, early = prefixes(made, starts, counts.value, percent)
            at = pa.array(owner)
            yield pa.record_batch(
                [
                    pa.array(token),
                    rows.column("id").take(at),
                    rows.column("comp").take(at),
                    pa.array(np.diff(starts)[owner].astype(np.int32)),
                    pa.array(place.astype(np.int32)),
                    pa.array(early),
                ],
                ["token", "id", "comp", "size", "place", "early"],
            )

    out = f"token long, id {kind}, comp {kind}, size int, place int, early boolean"
    made = crowd.select("id", "comp", "text").mapInArrow(emit, out)
    return materialize(made, "forest_tokens")


def able_pairs(held: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray, percent: int):
    """Index pairs of members of a group (first x second) that can be similar enough.

    ``held`` has id, comp, size, place, early and minima (rows of ``TREES * DEPTH``). Of
    different components, alike in size, with room for the overlap behind the shared
    shingle, which must be an early one of the smaller, and with minima agreeing within
    four standard deviations of the threshold.
    """
    share = percent / 100
    least = share - 4 * (share * (1 - share) / _MINIMA) ** 0.5
    ids, comp, size, place, early, minima = (
        held[c] for c in ("id", "comp", "size", "place", "early", "minima")
    )
    left, right = [], []
    for i in first.tolist():
        j = second[comp[second] != comp[i]]
        small, large = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        smaller = (size[i] < size[j]) | ((size[i] == size[j]) & (ids[i] < ids[j]))
        room = np.minimum(size[i] - place[i], size[j] - place[j])  # from the shared one on
        able = (
            (100 * small >= percent * large)
            & np.where(smaller, early[i], early[j])
            & ((100 + percent) * room >= percent * (small + large))
        )
        j = j[able]
        j = j[(minima[j] == minima[i]).mean(1) >= least]
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def crowd_pairs(near: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of crowded members of different components that can be links.

    ``near`` has id, labels and comp of the members. A hot shingle's group is cut into
    blocks: those of its most frequent component meet those of the others.
    """
    kind = near.schema["id"].dataType.simpleString()
    percent = rule.percent
    crowd = materialize(near.select("id", "comp").join(texts, "id"), "forest_crowd")
    tokens = _tokens(crowd, rule)
    by_comp = tokens.groupBy("token", "comp").agg(
        F.count("*").alias("n"), F.max("early").alias("early")
    )
    active = (
        by_comp.groupBy("token")
        .agg(
            F.sum("n").alias("total"),
            F.max(F.struct("n", "comp")).alias("most"),
            F.count("*").alias("comps"),
            F.max("early").alias("early"),
        )
        .where((F.col("comps") > 1) & F.col("early"))
    )
    mains = F.ceil(F.col("most.n") / MAIN_EACH)
    others = F.ceil((F.col("total") - F.col("most.n")) / OTHERS_EACH)
    active = active.select(
        F.col("token"), F.col("most.comp").alias("main"), mains.alias("mains"), others.alias("others")
    )
    members = tokens.withColumnRenamed("early", "soon").join(active, "token")
    members = materialize(members, "forest_members")
    tasks = partitions_for(near.sparkSession, members.count(), MEMBERS_EACH)
    members = members.join(near.select("id", "labels"), "id")

    # (side, i, j): block i of the others meets block j of the main component (side 0) or of
    # the others (side 1, i <= j).
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    to_mains = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("mains") - 1),
        lambda j: F.struct(F.lit(0).alias("side"), F.col("own").alias("i"), j.alias("j")),
    )
    to_others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("others") - 1),
        lambda j: F.struct(
            F.lit(1).alias("side"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")
        ),
    )
    from_mains = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("others") - 1),
        lambda i: F.struct(F.lit(0).alias("side"), i.alias("i"), F.col("own").alias("j")),
    )
    meets = F.when(is_main, from_mains).otherwise(F.concat(to_mains, to_others))
    entry = F.struct(
        "id", "comp", "size", "place", F.col("soon").alias("early"), "labels",
        F.when(F.col("meet.side") == 0, ~F.col("is_main")).otherwise(F.col("own") == F.col("meet.i"))
        .alias("few"),
    )
    groups = (
        members.withColumn("is_main", is_main)
        .withColumn("own", own)
        .withColumn("meet", F.explode(meets))
        .groupBy("token", "meet")
        .agg(F.collect_list(entry).alias("held"))
        .select("held", (F.col("meet.side") * F.when(F.col("meet.i") == F.col("meet.j"), 1).otherwise(0)).alias("within"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = batch.schema.field("held").type.value_type.field("id").type
            for held, within in zip(batch.column("held"), batch.column("within").to_pylist(), strict=True):
                rows = held.values
                columns = {
                    c: rows.field(c).to_numpy(zero_copy_only=False)
                    for c in ("id", "comp", "size", "place", "early", "few")
                }
                minima = np.frombuffer(b"".join(rows.field("labels").to_pylist()), ">u2")
                columns["minima"] = minima.reshape(-1, _MINIMA).astype(np.uint16)
                few, ids = columns["few"].astype(bool), columns["id"]
                second = np.arange(len(ids)) if within else np.flatnonzero(~few)
                x, y = able_pairs(columns, np.flatnonzero(few), second, percent)
                low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                yield pa.record_batch([pa.array(low, arrow), pa.array(high, arrow)], ["a", "b"])

    return groups.coalesce(tasks).mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def texts_among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Written table of the rows of ``texts`` whose id is in ``ids``, and few others.

    The ids become a bitset of a bounded size, so no text is shuffled to be left out.
    """
    rows = materialize(ids.distinct(), "forest_ids")
    wanted = FILTER_EACH * max(rows.count(), 64)
    bits = min(FILTER_BITS, 1 << (wanted - 1).bit_length())
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = (
        rows.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
        .toArrow()  # bits / 64 rows at most
    )
    held = np.zeros(bits // 64, np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def known(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        bit = shared.value[at >> 6] >> (at & 63).astype(np.uint64)
        return pa.array((bit & np.uint64(1)).astype(bool))

    return materialize(texts.where(known(place)), "forest_texts")


# --- confirmation and components -------------------------------------------------


def confirm(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b), a written table, whose full shingle sets are similar enough.

    A document is in at most ``2 * TREES * NEAREST`` pairs of the trees, and in those of
    crowded regions that no filter tells from links.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    words, percent = rule.words, rule.percent

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(slices(batches, "text_b", SHINGLE_BYTES), "text_a", SHINGLE_BYTES):
            n = rows.num_rows
            both = texts_of(rows.column("text_a")) + texts_of(rows.column("text_b"))
            made, starts = shingle_sets(both, words)
            good = []
            for i in range(n):
                x, y = made[starts[i] : starts[i + 1]], made[starts[n + i] : starts[n + i + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    held = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    held = held.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    tasks = partitions_for(pairs.sparkSession, pairs.count(), PAIRS_EACH)
    held = held.select("a", "b", "text_a", "text_b").coalesce(tasks)
    return held.mapInArrow(check, f"a {kind}, b {kind}")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition of edges (a < b), all edges of a ``b`` together.

    Yields (a, b, loose): every id under the smallest one it is joined to here, and how
    many ids came in with several parents. Memory follows the partition, not a component.
    """
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.concat_tables(tables)
    kind = table.schema.field("a").type
    pairs = np.unique(np.stack([table.column(c).to_numpy() for c in "ab"], 1), axis=0)
    ids, index = np.unique(pairs, return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in index.reshape(pairs.shape).tolist():
        low, high = sorted((root(x), root(y)))
        parent[high] = low
    top = np.array([root(x) for x in range(len(ids))])
    below = np.flatnonzero(top != np.arange(len(ids)))
    loose = np.zeros(len(below), np.int64)
    loose[0] = len(pairs) - len(np.unique(pairs[:, 1]))
    yield pa.record_batch(
        [pa.array(ids[top[below]], kind), pa.array(ids[below], kind), pa.array(loose)],
        ["a", "b", "loose"],
    )


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest reachable id) of every id in links (a, b).

    Each round deals the edges out by their larger end, contracts every partition by
    itself and writes what is left, until no id has two parents; then parents are
    replaced by their parents until all are roots. No component is ever gathered.
    """
    kind = links.schema["a"].dataType.simpleString()
    tasks = partitions_for(links.sparkSession, links.count(), LINKS_EACH)
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = edges.where(F.col("a") < F.col("b"))
    loose = 1
    while loose:
        left = edges.select("a", "b").repartition("b").coalesce(tasks)
        made = left.mapInArrow(_contracted, f"a {kind}, b {kind}, loose long")
        edges = materialize(made, "component_edges")
        loose = edges.agg(F.sum("loose").alias("n")).first().n
    above = 1
    while above:
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("higher"))
        moved = edges.join(up, "a", "left").select(
            F.coalesce("higher", "a").alias("a"), "b", F.col("higher").isNotNull().alias("moved")
        )
        edges = materialize(moved.coalesce(tasks), "component_edges")
        above = edges.where("moved").count()
    roots = edges.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("comp"))
    return edges.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(roots)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()
) -> DataFrame:
    """key, n_shingles, component_id, kept of every row with a key."""
    docs = docs.where(F.col(key).isNotNull())
    signed = materialize(signatures(docs, key, text, rule.words), "forest_signatures")
    classes = materialize(
        signed.where(F.col("n_shingles") > 0)
        .groupBy("set_hash")
        .agg(
            F.min("id").alias("id"),
            F.max("n_shingles").alias("size"),
            F.min("labels").alias("labels"),  # equal sets have equal labels
        ),
        "forest_classes",
    )
    rows = classes.count()
    nodes = classes.select("id", "size", "labels")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    pairs, crowded = candidates(nodes, rule, rows)
    few = partitions_for(docs.sparkSession, rows, LINKS_EACH)
    pairs = materialize(pairs.coalesce(few), "forest_pairs")
    crowded = materialize(crowded.coalesce(few), "forest_crowded")
    ends = [pairs.select(F.col(end).alias("id")) for end in "ab"]
    texts = texts_among(texts, ends[0].unionByName(ends[1]).unionByName(crowded))
    links = materialize(confirm(pairs, texts, rule), "forest_links")
    of = materialize(components(links), "forest_components")
    near = nodes.select("id", "labels").join(crowded, "id").join(of, "id", "left")
    near = materialize(near.withColumn("comp", F.coalesce("comp", "id")).coalesce(few), "forest_near")
    more = materialize(crowd_pairs(near, texts, rule).coalesce(few), "forest_pairs")
    found = confirm(more, texts, rule)
    # Links between components: only what they join is contracted again.
    for end in "ab":
        comp = near.select(F.col("id").alias(end), F.col("comp").alias(f"comp_{end}"))
        found = found.join(comp, end)
    joined = materialize(
        found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), "forest_links"
    )
    merged = components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("whole"))
    merged = materialize(merged, "forest_components")

    of_class = classes.join(of, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    of_class = of_class.join(merged, "comp", "left").select(
        "set_hash", F.coalesce("whole", "comp").alias("comp")
    )
    joined = signed.select("id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )
