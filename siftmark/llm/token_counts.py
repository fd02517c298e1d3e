"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

A text is cut into units (white space and what follows it), units into pre-tokens by
the tokenizer's pattern. The pre-tokens not met before in this worker are held as one
ragged numpy array of symbols; in each round every pre-token applies its own
lowest-ranked pair at all places at once, and what survives is counted.

Null text counts as empty: 0 bytes, 0 tokens. Very long pre-tokens take the pairs in
rank order over a linked array instead, so their cost follows their length. Repeated
rows are counted each. Input columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, append_columns, texts_of

#: Pre-tokens of more symbols than this leave the common rounds.
LONG = 512
_NONE = np.int64(1) << np.int64(40)
# Unicode White_Space, and the pattern of the byte-level pre-tokenizer.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029]
_SPACES += [0x202F, 0x205F, 0x3000]
_SPACE = "".join(map(chr, _SPACES))
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Merges of a vocabulary file, applied to batches of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab = held["model"]["vocab"]
        self.specials = sorted(
            (t["content"] for t in held["added_tokens"]), key=len, reverse=True
        )
        self.split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.first = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right, self.joined = left, right, joined

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece (none empty)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        short = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        if len(short):
            joined = b"".join([pieces[i] for i in short.tolist()])
            out[short] = self._rounds(joined, lengths[short])
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._by_rank(pieces[i])
        return out

    def _rounds(self, joined: bytes, lengths: np.ndarray) -> np.ndarray:
        sym = self.first[np.frombuffer(joined, np.uint8)]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        counts = lengths.copy()
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < _NONE
            counts[owner[starts]] = sizes
            if not live.all():  # finished pre-tokens leave the arrays
                stay = np.repeat(live, sizes)
                sym, owner, rank = sym[stay], owner[stay], rank[stay]
                sizes, lowest = sizes[live], lowest[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, sizes)
            # Of overlapping places ("aaa") every second one counts, from the left.
            run_at = np.flatnonzero(hit)
            if len(run_at) > 1 and (np.diff(run_at) == 1).any():
                fresh = np.r_[True, np.diff(run_at) != 1]
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(run_at)), 0))
                run_at = run_at[(np.arange(len(run_at)) - head) % 2 == 0]
            sym[run_at] = self.joined[rank[run_at]]
            keep = np.ones(len(sym), bool)
            keep[run_at + 1] = False
            new_at = np.cumsum(keep)[run_at] - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            near = np.zeros(len(sym), bool)
            near[new_at] = near[np.maximum(new_at - 1, 0)] = True
            touched = np.flatnonzero(near)
            after = np.minimum(touched + 1, len(sym) - 1)
            same = (after > touched) & (owner[after] == owner[touched])
            found = self.pair_ranks(sym[touched], sym[after])
            rank[touched] = np.where(same, found, _NONE)
        return counts

    def _by_rank(self, piece: bytes) -> int:
        """One long pre-token: pop the lowest rank, apply it everywhere, queue new pairs."""
        sym = self.first[np.frombuffer(piece, np.uint8)].copy()
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray) -> None:
            ranks = self.pair_ranks(sym[places], sym[after[places]])
            places, ranks = places[ranks < _NONE], ranks[ranks < _NONE]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for group in np.split(np.arange(len(ranks)), cuts):
                if len(group):
                    rank = int(ranks[group[0]])
                    if rank not in waiting:
                        waiting[rank] = []
                        heapq.heappush(queue, rank)
                    waiting[rank].append(places[group])

        add(np.arange(n - 1))
        left = n
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (after[at] < n)]
            at = at[(sym[at] == self.left[rank]) & (sym[after[at]] == self.right[rank])]
            if self.left[rank] == self.right[rank] and len(at) > 1:
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            alive[gone] = False
            sym[at] = self.joined[rank]
            after[at] = after[gone]
            follow = after[at]
            before[follow[follow < n]] = at[follow < n]
            left -= len(at)
            around = np.unique(np.r_[before[at], at])
            around = around[around >= 0]
            add(around[after[around] < n])
        return left


_mergers: dict[str, RankMerger] = {}
_seen: dict[str, WordCache] = {}
_split_unit = regex.compile(_PATTERN)


def _counter(path: str):
    """Counts of a list of texts, with this worker's cache of units."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
        _seen[path] = WordCache(14_000_000)
    merger, units = _mergers[path], _seen[path]

    def counts(texts: list[str]) -> list[int]:
        units.make_room()
        found: list[list[str]] = []
        owner: list[int] = []
        out = [0] * len(texts)
        for row, text in enumerate(texts):
            plain = [text]
            if merger.split and any(s in text for s in merger.specials):
                plain = merger.split.split(text)
                out[row] = len(plain) - 1  # a special string is one token
            for part in plain:
                found.append(_UNIT.findall(part))
                owner.append(row)
        new_units = list(set().union(*found) - units.keys())
        cut = [_split_unit.findall(u) for u in new_units]
        pieces = list(set().union(*cut))
        sizes = dict(zip(pieces, merger.count([p.encode() for p in pieces]).tolist(), strict=True))
        units.grow(new_units, [sum([sizes[p] for p in ps]) for ps in cut])
        for row, us in zip(owner, found, strict=True):
            out[row] += sum([units[u] for u in us])
        return out

    return counts


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text."""

    def make():
        counts = _counter(path)

        def work(column: pa.Array) -> list[pa.Array]:
            size = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
            return [size, pa.array(counts(texts_of(column)), pa.int64())]

        return work

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]
    return append_columns(docs, text, fields, make).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
