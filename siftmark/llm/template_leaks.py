"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers turn into ``<num>``, numbers with a unit into ``<qty>``
and capitalised words inside a sentence into ``<name>``; other words lose their case
and outer punctuation. Windows of ``WINDOW`` template words are hash-joined: the
benchmark's windows, in blocks of at most ``BLOCK_ITEMS`` items, are the build side in
every task, the documents' windows the probe side, so documents are never shuffled.
Joined windows are lined up; a document leaks an item when they cover enough of the
item's template and the slot values agree: each value of the item stands for one value
of the document throughout (the same: ``exact``; another: ``reparameterised``).
A window needs two words that are no placeholders; joined ones are lengthened word by
word, so parts without such windows (numbers, names) count as well.

Exact copies are also found by their words as they stand (without case and outer
punctuation): any run of ``RUN`` words of an item, and the whole of a shorter item.
One of fewer than ``ALONE`` words must stand alone, as a sentence or line.

Null and empty texts leak nothing and are leaked by nothing.
Equal items are each reported; repeated documents get equal findings.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, append_columns, mix64, texts_of

WINDOW = 5
LEAST_WORDS = 2
LEAST_COVERAGE = 0.5
LEAST_COVERED = 8
LEAST_AGREEING = 0.75
#: How far apart (in template words) joined windows of one leak may be out of line.
SHIFT = 8
BLOCK_ITEMS = 20_000
#: Words of an item that are a leak wherever they stand, whatever the share of the item.
RUN = 13
#: An item of fewer words is a leak only as a sentence or line of its own.
ALONE = 3

# Units and number words.
UNITS = frozenset(
    "% cm m km mm in ft mi g kg mg lb oz l ml s ms min h hr hours hour minutes minute seconds "
    "second days day weeks week months month years year usd eur dollars dollar euros euro cents "
    "cent meters metres miles mile feet foot inches inch grams kilograms pounds pound liters "
    "litres gallons gallon degrees percent mph kmh km/h m/s kb mb gb tb hz khz mhz ghz w kw v".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion".split()
)

_WORD, _NUM, _TITLE, _UNIT, _QTY, _NONE, _NAME = range(7)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)-?([a-z%/]+)")
_OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_STOPS = (".", "!", "?", ":", ";", '."', '!"', '?"', ".)", "\x00")
_FACTORS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_HASHES = mix64(np.arange(101, 108, dtype=np.uint64))


def _classify(word: str) -> tuple[int, int, bool]:
    """Hash, kind and whether a sentence ends with it, of a raw word."""
    ends = word.endswith(_STOPS)
    core = _OUTER.sub("", word)
    core = core if core.endswith("%") and core[:-1].strip("+-$€£.,:/").isdigit() else core.rstrip("%")
    if not core or not any(map(str.isalnum, core)):
        return 0, _NONE, ends
    low = core.lower()
    kind = _WORD
    glued = _GLUED.fullmatch(low)
    if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        kind = _NUM
    elif glued and glued.group(2) in UNITS:
        kind = _QTY
    elif low in UNITS:
        kind = _UNIT
    elif len(core) > 1 and core[0].isupper() and core[1:].islower() and core.isalpha():
        kind = _TITLE
    value = int.from_bytes(blake2b(low.encode(), digest_size=8).digest(), "little")
    return value, kind, ends


class _Templates:
    """Turns texts into template words, with a cache of classified raw words."""

    def __init__(self) -> None:
        self.at: WordCache = WordCache(9_000_000)
        self.reset()

    def reset(self) -> None:
        self.at.clear()
        self.at.held = 0
        self.value, self.kind, self.ends = (np.zeros(0, t) for t in (np.uint64, np.int8, bool))

    def split(self, texts: list[str]) -> list[list[str]]:
        return [t.replace("\n", " \x00 ").split() for t in texts]

    def __call__(self, words: list[list[str]]) -> tuple[np.ndarray, ...]:
        """hash, owner (text), place (raw word), kind of every template word.

        ``plain`` then has hash, owner and place of every raw word, and whether a
        sentence or line begins or ends with it.
        """
        if self.at.held > self.at.most:
            self.reset()
        new = list(set().union(*words) - self.at.keys())
        if new:
            made = [_classify(w) for w in new]
            self.at.grow(new, range(len(self.value), len(self.value) + len(new)))
            self.value = np.r_[self.value, np.array([m[0] for m in made], np.uint64)]
            self.kind = np.r_[self.kind, np.array([m[1] for m in made], np.int8)]
            self.ends = np.r_[self.ends, np.array([m[2] for m in made], bool)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.at[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stops = np.r_[0, np.cumsum(self.ends[at])]  # ends among the words before
        real = np.flatnonzero(self.kind[at] != _NONE)
        own = owner[real]
        first = np.r_[True, own[1:] != own[:-1]][: len(own)]
        begins = first | np.r_[True, stops[real[1:]] > stops[real[:-1]]][: len(own)]
        self.plain = self.value[at[real]], own, place[real], begins, np.r_[begins[1:], True][: len(own)]
        if not len(real):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none.astype(np.int8)
        kind, own = self.kind[at[real]].copy(), owner[real]
        first = np.r_[True, own[1:] != own[:-1]]
        opens = first | np.r_[True, stops[real[1:]] > stops[real[:-1]]]
        kind[(kind == _TITLE) & ~opens] = _NAME
        kind[kind == _TITLE] = _WORD
        # A number and its unit are one slot, as is a run of names.
        after_number = np.r_[False, kind[:-1] == _NUM] & ~first
        unit = (kind == _UNIT) & after_number
        kind[np.flatnonzero(unit) - 1] = _QTY
        kind[(kind == _UNIT) & ~unit] = _WORD
        again = (kind == _NAME) & np.r_[False, kind[:-1] == _NAME] & ~opens
        stay = ~(unit | again)
        kind, own, real = kind[stay], own[stay], real[stay]
        hashed = np.where(kind == _WORD, self.value[at[real]], _HASHES[kind])
        return hashed, own, place[real], kind


def _windows(hashed: np.ndarray, owner: np.ndarray, kind: np.ndarray):
    """Hash of the window at every place that has one, and these places."""
    n = len(hashed) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    words = np.zeros(n, np.int64)
    for k in range(WINDOW):
        mixed += mix64(hashed[k : n + k]) * _FACTORS[k]
        words += kind[k : n + k] == _WORD
    at = np.flatnonzero((owner[:n] == owner[WINDOW - 1 :]) & (words >= LEAST_WORDS))
    return mixed[at], at


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


class _Runs:
    """Hashes of all runs of raw words of one length, by sums of powers."""

    def __init__(self, plain: tuple) -> None:
        self.hashed, self.owner, self.place, self.begins, self.ends = plain
        n = len(self.hashed)
        self.sums = np.r_[np.uint64(0), np.cumsum(mix64(self.hashed) * _powers(_ODD, n)[:n])]
        self.back = _powers(_INVERSE, n)

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run at every place that has one of ``size`` words, and these places."""
        n = max(0, len(self.hashed) - size + 1)
        whole = self.owner[:n] == self.owner[size - 1 : size - 1 + n]
        if size < ALONE:
            whole = whole & self.begins[:n] & self.ends[size - 1 : size - 1 + n]
        at = np.flatnonzero(whole)
        return mix64((self.sums[at + size] - self.sums[at]) * self.back[at] + np.uint64(size)), at


class Index(NamedTuple):
    """One block of the benchmark: the build side of the join."""

    hashes: np.ndarray  # sorted
    items: np.ndarray
    places: np.ndarray
    ids: list
    words: list  # template hashes of each item
    values: list  # slot value (text) of each template word, None for words
    runs: np.ndarray  # sorted hashes of runs of raw words
    run_items: np.ndarray
    run_places: np.ndarray
    run_sizes: list  # lengths of these runs
    sizes: np.ndarray  # raw words of each item


def _slot_values(words: list[str], place: np.ndarray, kind: np.ndarray) -> list:
    """The raw text behind each slot: up to the next template word, lower-cased."""
    stop = np.r_[place[1:], len(words)] if len(place) else place
    return [
        None if k == _WORD else _value(words[a:b])
        for k, a, b in zip(kind.tolist(), place.tolist(), stop.tolist(), strict=True)
    ]


def _value(raw: list[str]) -> str:
    cores = [_OUTER.sub("", w) for w in raw]
    return " ".join([c.lower() for c in cores if c and c != "\x00"])


def build_index(ids: list, texts: list[str]) -> Index:
    make = _Templates()
    split = make.split(texts)
    hashed, owner, place, kind = make(split)
    mixed, at = _windows(hashed, owner, kind)
    order = np.argsort(mixed, kind="stable")
    # Sentences inside an item do not matter: a short item is one run.
    runs = _Runs((*make.plain[:3], *(np.ones(len(make.plain[0]), bool) for _ in range(2))))
    sizes = np.bincount(runs.owner, minlength=len(ids))
    begin = np.cumsum(sizes) - sizes
    each = sorted(set(np.minimum(sizes[sizes > 0], RUN).tolist()))
    found = []
    for size in each:
        value, spot = runs(size)
        fits = np.minimum(sizes, RUN)[runs.owner[spot]] == size
        found.append((value[fits], spot[fits]))
    value, spot = (np.concatenate([f[k] for f in found]) if found else mixed[:0] for k in (0, 1))
    spot = spot.astype(np.int64)
    by_run = np.argsort(value, kind="stable")
    starts = np.searchsorted(owner, np.arange(len(ids) + 1))
    per = [slice(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return Index(
        mixed[order],
        owner[at][order],
        (at - starts[owner[at]])[order],
        ids,
        [hashed[p] for p in per],
        [_slot_values(split[i], place[p], kind[p]) for i, p in enumerate(per)],
        value[by_run],
        runs.owner[spot][by_run],
        (spot - begin[runs.owner[spot]])[by_run],
        each,
        sizes,
    )


def _agreement(pairs: list[tuple[str, str]]) -> tuple[float, bool]:
    """Share of slot pairs that agree with one value-to-value mapping; whether all equal."""
    if not pairs:
        return 1.0, True
    forward: dict[str, Counter] = defaultdict(Counter)
    backward: dict[str, Counter] = defaultdict(Counter)
    for a, b in pairs:
        forward[a][b] += 1
        backward[b][a] += 1
    best = {a: max(c.items(), key=lambda x: (x[1], x[0]))[0] for a, c in forward.items()}
    home = {b: max(c.items(), key=lambda x: (x[1], x[0]))[0] for b, c in backward.items()}
    good = sum(best[a] == b and home[b] == a for a, b in pairs)
    return good / len(pairs), all(a == b for a, b in pairs)


def _lengthened(pairs: dict[int, int], words: np.ndarray, others: np.ndarray) -> None:
    """Add pairs of equal template words next to those given, in place."""
    for step in (-1, 1):
        for p, q in sorted(pairs.items(), reverse=step < 0):
            p, q = p + step, q + step
            while p not in pairs and 0 <= p < len(words) and 0 <= q < len(others) and words[p] == others[q]:
                pairs[p] = q
                p, q = p + step, q + step


def _exact_runs(runs: _Runs, index: Index, marked: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """text, item, share of the item, place: the longest run of each text and item."""
    spots, entries = [], []
    for size in index.run_sizes:
        value, at = runs(size)
        near = marked[(value & np.uint64(len(marked) - 1)).astype(np.int64)]
        value, at = value[near], at[near]
        low, high = (np.searchsorted(index.runs, value, side) for side in ("left", "right"))
        count = high - low
        spots.append(np.repeat(at, count))
        entries.append(np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum()))
    if not spots or not sum(map(len, spots)):
        return
    spot, entry = np.concatenate(spots), np.concatenate(entries)
    text, item = runs.owner[spot], index.run_items[entry]
    line = spot - index.run_places[entry]
    order = np.lexsort((spot, line, item, text))
    text, item, line, spot = text[order], item[order], line[order], spot[order]
    same = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (line[1:] == line[:-1])
    fresh = np.r_[True, ~(same & (np.diff(spot) == 1))]
    edges = np.r_[np.flatnonzero(fresh), len(spot)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        size = int(index.sizes[item[a]])
        yield int(text[a]), int(item[a]), (b - a - 1 + min(RUN, size)) / size, int(runs.place[spot[a]])


def filled_slots(hashes: np.ndarray) -> np.ndarray:
    """Which low bits of a hash occur at all."""
    filled = np.zeros(1 << 22, bool)
    filled[(hashes & np.uint64(len(filled) - 1)).astype(np.int64)] = True
    return filled


def leaks_of(
    texts: list[str], index: Index, make: _Templates, filled: np.ndarray, marked: np.ndarray
) -> list[list[dict]]:
    """Leaks of each text: item_id, kind, coverage, place (raw word) of the best one."""
    out: list[list[dict]] = [[] for _ in texts]
    split = make.split(texts)
    hashed, owner, place, kind = make(split)
    best: dict[tuple[int, int], dict] = {}
    for t, i, share, spot in _exact_runs(_Runs(make.plain), index, marked):
        if (t, i) not in best or best[t, i]["coverage"] < round(share, 6):
            best[t, i] = {
                "item_id": index.ids[i], "kind": "exact", "coverage": round(share, 6), "place": spot
            }
    mixed, at = _windows(hashed, owner, kind)
    near = filled[(mixed & np.uint64(len(filled) - 1)).astype(np.int64)]
    mixed, at = mixed[near], at[near]
    low = np.searchsorted(index.hashes, mixed, "left")
    high = np.searchsorted(index.hashes, mixed, "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        for (t, _), leak in best.items():
            out[t].append(leak)
        return out
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    count = high[found] - low[found]
    entry = np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
    spot = np.repeat(at[found], count)
    text, item = owner[spot], index.items[entry]
    doc_place = spot - starts[text]
    shift = doc_place - index.places[entry]
    order = np.lexsort((shift, item, text))
    text, item, shift = text[order], item[order], shift[order]
    in_item, in_doc = index.places[entry][order], doc_place[order]
    # Windows of one text and item belong together while their lines are close.
    fresh = np.r_[
        True,
        (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(shift) > SHIFT),
    ]
    groups = np.r_[np.flatnonzero(fresh), len(text)]
    values: dict[int, list] = {}
    for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
        t, i = int(text[a]), int(item[a])
        size = len(index.words[i])
        pairs = {}
        for p, q in zip(in_item[a:b].tolist(), in_doc[a:b].tolist(), strict=True):
            for k in range(WINDOW):
                pairs.setdefault(p + k, q + k)
        _lengthened(pairs, index.words[i], hashed[starts[t] : starts[t + 1]])
        coverage = len(pairs) / size
        if coverage < LEAST_COVERAGE or len(pairs) < min(LEAST_COVERED, size):
            continue
        if t not in values:
            own = slice(int(starts[t]), int(starts[t + 1]))
            values[t] = _slot_values(split[t], place[own], kind[own])
        slots = [
            (index.values[i][p], values[t][q])
            for p, q in sorted(pairs.items())
            if index.values[i][p] is not None and values[t][q] is not None
        ]
        share, same = _agreement(slots)
        if share < LEAST_AGREEING:
            continue
        leak = {
            "item_id": index.ids[i],
            "kind": "exact" if same else "reparameterised",
            "coverage": round(coverage, 6),
            "place": int(place[starts[t] + min(pairs.values())]),
        }
        if (t, i) not in best or best[t, i]["coverage"] < leak["coverage"]:
            best[t, i] = leak
    for (t, _), leak in best.items():
        out[t].append(leak)
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, kind, coverage, place), empty if clean."""
    key_type = benchmark.schema[item_key].dataType
    leak = T.StructType(
        [
            T.StructField("item_id", key_type),
            T.StructField("kind", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("place", T.LongType()),
        ]
    )
    items = benchmark.select(F.col(item_key).alias("id"), F.col(item_text).alias("t"))
    blocks = -(-items.count() // block_items) or 1
    arrow = pa.list_(
        pa.struct(
            [("item_id", _arrow_type(key_type)), ("kind", pa.string()), ("coverage", pa.float64()), ("place", pa.int64())]
        )
    )
    out, names = docs, []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).collect()
        rows = sorted(rows, key=lambda r: (str(r.id), r.t or ""))  # about ``block_items`` rows
        index = docs.sparkSession.sparkContext.broadcast(
            build_index([r.id for r in rows], [r.t or "" for r in rows])
        )

        def make(index=index):
            held, templates = index.value, _Templates()
            filled, marked = filled_slots(held.hashes), filled_slots(held.runs)

            def work(column: pa.Array) -> list[pa.Array]:
                return [pa.array(leaks_of(texts_of(column), held, templates, filled, marked), arrow)]

            return work

        names.append(f"_leaks_{block}")
        out = append_columns(out, text, [(names[-1], T.ArrayType(leak))], make)
    return out.withColumn("leaks", F.concat(*names)).drop(*names)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
