"""Toxicity by noisy-channel deobfuscation and a classifier of the restored text.

1. A character trigram model is counted over all texts of the corpus.
2. Words that look disguised (digits or signs among letters, letters spelled apart,
   runs of one letter) become lattices: every sign may stand for the letters it
   imitates, separators and repeated letters may be dropped, each at a channel cost.
   A Viterbi search over the lattice finds the likeliest reading under the model.
3. Words, restored words and their openings (three to seven letters) are the
   features of a logistic regression, fitted on a bounded sample of labelled rows. An
   opening counts only if ``LEAST_WORDS`` different toxic words begin with it; else the
   word it comes from must be met as a whole. Scores depend on the text alone.

Null and empty texts have no features and get the model's base score. Labels that are
null are not used; repeated rows get equal scores. Without both classes among the
labels every score is the share of toxic labels (0 without labels). Texts are read
whole; a word is worked out once per worker.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordGenerations, append_columns, labelled_sample, mix64, slices, texts_of

#: Labelled documents a fit uses at most, and features it keeps at most.
MOST_ROWS = 8000
MOST_FEATURES = 4096
LEAST_SEEN = 4
SURE = 0.7
#: Odds of a feature over the odds of all rows: to be kept, and to be sure at any base.
LEAST_ODDS, SURE_ODDS = 2.0, 10.0
PULL = 1.0
#: Text whose trigrams are counted at once; they take about thirty times its bytes.
COUNTED_BYTES = 1 << 20
OPENINGS = (3, 4, 5, 6, 7)
#: Different words of toxic rows that must begin with an opening.
LEAST_WORDS = 3
#: Letters of a reading that may be a feature; longer readings are none.
LONGEST = 64

# The letters of the model, what a sign may stand for, what separates.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
IMITATES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
    "¥": "y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ο": "o", "ι": "i",
}
SEPARATORS = ".-_*~'`´^·,:;/\\ "
SIGN_COST, DROP_COST, REPEAT_COST, OTHER_COST = 1.0, 0.5, 0.7, 12.0

_SIZE = len(LETTERS) + 2  # 0: edge of a word, last: any other letter
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_ENDS = re.compile(r"^[^\w$@!|+(<€£¥]+|[^\w$@!|+(<€£¥]+$")
_EDGE_SIGNS = re.compile(r"^[^\w$@!|+(<€£¥]+|[^\w$@€£¥]+$")
_SIGN_TAIL = re.compile(r"([^\w])\1+$|[^\w]{2,}$")
_APART = re.compile(r"(?<!\S)(?:\S[^\w\s]* +){2,}\S(?!\w)")
_ALIKE = re.compile("[" + "".join(c for c in IMITATES if c.isalpha()) + "]")
_LATIN = re.compile("[a-z]", re.IGNORECASE)
_TRIPLE = re.compile(r"(.)\1\1")


# --- the character model ---------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    table = np.zeros(0x300, np.int64)
    for c, i in _INDEX.items():
        table[ord(c)] = i
    codes = table[np.minimum(points, 0x2FF)]
    codes[points > 0x2FF] = _SIZE - 1
    return codes


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: letter trigrams of all texts, summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for rows in slices(batches, text, COUNTED_BYTES):
            code = _codes("  ".join(["", *texts_of(rows.column(text)), ""]))
            gram = (code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:]
            total += np.bincount(gram, minlength=_SIZE**3)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["gram", "n"])

    found = docs.select(F.col(text)).mapInArrow(count, "gram long, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative logs) of a letter after two letters, backed off to one and none.

    There are at most ``_SIZE``**3 counts, whatever the corpus.
    """
    n3, found = np.zeros(_SIZE**3), counts.toArrow()
    n3[found["gram"].to_numpy()] = found["n"].to_numpy()
    return model_of_counts(n3)


def model_of_counts(n3: np.ndarray) -> np.ndarray:
    n3 = n3.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
    n3[0, 0, 0] = 0  # between words
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + _SIZE)
    p2 = (n2 + 50 * p1[None, :]) / (n2.sum(1, keepdims=True) + 50)
    p3 = (n3 + 20 * p2[None, :, :]) / (n3.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


# --- the channel and the search --------------------------------------------------


def is_disguised(word: str) -> bool:
    """Whether a word may hide another: signs among letters, or a letter three times."""
    letters = sum(map(str.isalpha, word))
    if letters and letters < len(word):
        return True
    return bool(_TRIPLE.search(word)) or _mixes(word)


def _mixes(word: str) -> bool:
    """Whether look-alikes of another script stand among Latin letters."""
    if word.isascii():
        return False
    alike = _ALIKE.search(word)
    return bool(alike and _LATIN.search(word))


def restore(word: str, model: np.ndarray) -> str:
    """Likeliest reading of a disguised word (lower case), by Viterbi over its lattice.

    A state is the last two letters read; steps either emit a letter that the sign may
    stand for or drop a separator or a repeated letter.
    """
    return _search(word, model, len(word))[-1]


def _search(word: str, model: np.ndarray, least: int, repeats: bool = True) -> list[str]:
    """Likeliest readings of the first ``least`` characters, of one more, up to all.

    Without ``repeats`` every letter is read as often as it stands there. Readings of more
    than ``LONGEST`` letters come out cut behind the next, and equal ones once. Memory and
    time stay linear: ways too costly to win are given up, and a tail that repeats one or
    two signs is left as soon as two more of them change nothing but the costs.
    """
    edge, word, found = 0, word.lower(), {}
    lengthy = len(word) > LONGEST  # else nothing is worth giving up
    # No context makes up for more than this.
    far = 4 * (float(model.max()) + SIGN_COST + REPEAT_COST) if lengthy else 0.0

    def best() -> str:
        ends = ((cost + float(model[a, b, edge]), text) for (a, b), (cost, text) in states.items())
        return min(ends, default=(0.0, ""))[1]

    def relative() -> dict:
        low = min(cost for cost, _ in states.values())
        return {k: (round(cost - low, 5), text) for k, (cost, text) in states.items()}

    same = len(word)  # from here on the word repeats its last two characters
    while lengthy and same > 2 and word[same - 1] == word[same - 3]:
        same -= 1
    states: dict[tuple[int, int], tuple[float, str]] = {(edge, edge): (0.0, "")}
    n, before = 0, [{}, {}]  # what one and two characters ago was left of the costs
    while n < len(word):
        if n >= least:
            found[best()] = None
        if lengthy and n >= max(same, least):
            now = relative()
            if now == before[1]:
                n += 2 * ((len(word) - n - 1) // 2)
            before = [now, before[0]]
        c = word[n]
        steps: list[tuple[str, float]] = []
        if c.isalpha():
            steps.append((c, 0.0))
        for letter in IMITATES.get(c, ""):
            steps.append((letter, SIGN_COST))
        drop = DROP_COST if c in SEPARATORS else None if c.isalpha() else OTHER_COST
        following: dict[tuple[int, int], tuple[float, str]] = {}

        def offer(state, cost, text, into=following):
            if state not in into or (cost, text) < into[state]:
                into[state] = (cost, text)

        for (a, b), (cost, text) in states.items():
            for letter, paid in steps:
                at = _INDEX.get(letter, _SIZE - 1)
                longer = text + letter if len(text) <= LONGEST else text
                offer((b, at), cost + paid + float(model[a, b, at]), longer)
                if repeats and at == b and text:  # the same letter once more: read it once
                    offer((a, b), cost + paid + REPEAT_COST, text)
            if drop is not None:
                offer((a, b), cost + drop, text)
        states = following or states
        if lengthy:
            low = min(cost for cost, _ in states.values()) + far
            states = {k: v for k, v in states.items() if v[0] <= low}
        n += 1
    # The reading of the whole word comes last, even if a shorter part was read alike.
    last = best()
    found.pop(last, None)
    return [*found, last]


def readings(word: str, model: np.ndarray) -> list[str]:
    """What a word may say: its letters, and its restored form if it looks disguised.

    Signs at the end may decorate the word or stand for letters, so it is read without
    them, and with the first one, the first two, up to all of them as letters.
    """
    core = _SIGN_TAIL.sub("", word.lower())
    core = _EDGE_SIGNS.sub("", core)
    if core.isalpha() and not _TRIPLE.search(core) and not _mixes(core):
        found = [core]
    else:
        found = [w for w in re.split(r"[\W\d_]+", core) if w]
        if is_disguised(core):
            found.append(restore(core, model))
    whole = _ENDS.sub("", word.lower())
    says = any(map(str.isalpha, whole)) or (len(set(whole)) > 1 and not any(map(str.isdigit, whole)))
    if says and len(whole) > len(core) and whole.startswith(core):
        for repeats in (True, False):
            found += _search(whole, model, len(core) + 1, repeats)
    return [w for w in dict.fromkeys(found) if w and len(w) <= LONGEST]


def spelled_apart(text: str) -> list[str]:
    """Runs of three or more single characters ("i d i o t"), joined.

    A one-letter word may stand beside the run, so it is also read without its ends.
    """
    out = []
    for found in _APART.finditer(text):
        run = found.group().replace(" ", "")
        out += [run, run[1:], run[:-1]] if len(run) > 4 else [run]
    return out


# --- features and the classifier -------------------------------------------------


def features(word: str) -> list[int]:
    """Hashes of a restored word (first) and of its openings."""
    made = [zlib.crc32(("=" + word).encode())]
    made += [zlib.crc32(word[:k].encode()) for k in OPENINGS if len(word) >= k]
    return made


class ToxicModel(NamedTuple):
    characters: np.ndarray
    bias: float
    weights: dict[int, float]


def _words(text: str) -> set[str]:
    found = set(text.split())
    found.update(spelled_apart(text))
    return found


def _document_pairs(texts: list[str], characters: np.ndarray) -> list[np.ndarray]:
    """Of each text the features and the words they come from, as two sorted columns."""
    out, known = [], {}
    for text in texts:
        found: set[tuple[int, int]] = set()
        for word in _words(text):
            if word not in known:
                made = map(features, readings(word, characters))
                known[word] = [(h, m[0]) for m in made for h in m]
            found.update(known[word])
        out.append(np.array(sorted(found), "<u4").reshape(-1, 2).T)
    return out


def _document_features(texts: list[str], characters: np.ndarray) -> list[bytes]:
    return [np.unique(p[0]).tobytes() for p in _document_pairs(texts, characters)]


def _rare_openings(names: np.ndarray, pairs: list[bytes]) -> np.ndarray:
    """Which features (sorted) are openings of fewer than ``LEAST_WORDS`` different words."""
    held = [np.frombuffer(p, "<u4").reshape(2, -1) for p in pairs]
    both = np.concatenate([np.zeros((2, 0), "<u4"), *held], axis=1)
    both = np.unique(both[0].astype(np.uint64) << np.uint64(32) | both[1])
    feature = (both >> np.uint64(32)).astype(np.uint32)
    whole = np.isin(names, feature[feature == both.astype(np.uint32)])
    words = np.searchsorted(feature, names, "right") - np.searchsorted(feature, names)
    return ~whole & (words < LEAST_WORDS)


def _thinned(flat: list[np.ndarray]) -> list[int]:
    """Rows left when near copies of earlier rows go: eight shared minima of hashes.

    A group of copies must not make the words of its one text look like evidence.
    """
    salts = mix64(np.arange(1, 49, dtype=np.uint64))
    seen: set[tuple] = set()
    out = []
    for i, found in enumerate(flat):
        if len(found):
            hashed = (found.astype(np.uint64)[None, :] + np.uint64(1)) * (salts[:, None] | np.uint64(1))
            least = (hashed >> np.uint64(20)).min(1).reshape(6, 8)
            keys = {(k, row.tobytes()) for k, row in enumerate(least)}
            if keys & seen:
                continue
            seen |= keys
        out.append(i)
    return out


def _lower_bound(hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Wilson's lower bound (95 percent) of a share."""
    share, z2 = hits / seen, 1.96**2
    spread = np.sqrt(share * (1 - share) * z2 / seen + z2 * z2 / (4 * seen * seen))
    return (share + z2 / (2 * seen) - spread) / (1 + z2 / seen)


def fit_rows(
    rows: list[bytes],
    labels: list[int],
    characters: np.ndarray,
    pairs: list[bytes | None] | None = None,
) -> ToxicModel:
    """Logistic regression over the features that go with toxic labels.

    The prior mean of a feature that is surely toxic on its own is the weight that
    lets it decide alone; of the others it is zero. ``pairs`` has of the toxic rows the
    features with their words; without it every opening may be a feature.
    """
    flat = [np.frombuffer(r, "<u4") for r in rows]
    left = _thinned(flat)
    flat, y = [flat[i] for i in left], np.array([labels[i] for i in left], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return ToxicModel(characters, math.log(share / (1 - share)), {})
    # Only features seen often enough are looked at: few of the many different ones.
    every = np.sort(np.concatenate(flat))
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else []
    often = np.diff(np.r_[starts, len(every)]) >= LEAST_SEEN
    names = every[starts][often] if len(every) else every
    del every
    held = []
    for found in flat:
        at = np.searchsorted(names, found)
        known = at < len(names)
        known[known] = names[at[known]] == found[known]
        held.append(at[known].astype(np.int32))
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    index = np.concatenate(held)
    seen = np.bincount(index, minlength=len(names)).astype(np.float64)
    toxic = np.bincount(index, y[owner], len(names))
    base = y.mean()
    # Evidence of a feature: log-likelihood ratio of its toxic share to the base.
    share = np.clip(toxic / seen, 1e-9, 1 - 1e-9)
    gain = toxic * np.log(share / base) + (seen - toxic) * np.log((1 - share) / (1 - base))
    usual = base / (1 - base)
    good = (toxic >= LEAST_SEEN) & (share / (1 - share) > LEAST_ODDS * usual)
    if pairs is not None:
        good &= ~_rare_openings(names, [pairs[i] for i in left if labels[i]])
    order = np.lexsort((names, -np.where(good, gain, -np.inf)))
    chosen = order[: min(MOST_FEATURES, int(good.sum()))]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    of, at = owner[place[index] >= 0], place[index][place[index] >= 0]
    surely = max(SURE, SURE_ODDS * usual / (1 + SURE_ODDS * usual))
    sure = _lower_bound(toxic[chosen], seen[chosen]) >= surely
    odds = np.log((toxic[chosen] + 0.5) / (seen[chosen] - toxic[chosen] + 0.5))
    b = math.log(base / (1 - base)) - 3
    prior = np.where(sure, np.maximum(odds - b, 0.0), 0.0)
    w = prior.copy()
    m, s = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, 301):
        z = b + np.bincount(of, w[at], len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        pull = PULL * (w - prior) / len(y)
        grad = np.r_[np.bincount(at, error[of], len(chosen)) / len(y) + pull, error.mean()]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
        w, b = np.maximum(w - move[:-1], 0.0), b - move[-1]
    used = w > 1e-3
    weights = dict(zip(names[chosen][used].tolist(), w[used].tolist(), strict=True))
    return ToxicModel(characters, float(b), weights)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    most: int = MOST_ROWS,
) -> ToxicModel:
    """Count the character model over all of ``docs`` and fit on labelled ones.

    ``labels`` has the key and ``label`` (1 toxic, 0 not); at most ``most`` labelled
    documents are used, those with the smallest hash of the key.
    """
    characters = character_model(trigram_counts(docs, text))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            pairs = _document_pairs(texts_of(column), characters)
            rows = [np.unique(p[0]).tobytes() for p in pairs]
            return [pa.array(rows, pa.binary()), pa.array([p.tobytes() for p in pairs], pa.binary())]

        return work

    taken = labelled_sample(docs, labels, key, text, most)
    fields = [("x", T.BinaryType()), ("pairs", T.BinaryType())]
    sparse = append_columns(taken, "text", fields, make)
    toxic = F.when(F.col("label") == 1, F.col("pairs")).alias("pairs")
    held = sparse.select("x", "label", toxic).toArrow()  # bounded by ``most`` rows
    return fit_rows(
        held["x"].to_pylist(), held["label"].to_pylist(), characters, held["pairs"].to_pylist()
    )


def scorer(model: ToxicModel):
    """Scores of texts: words without a weighted feature are remembered as empty."""
    weights, characters, known = model.weights, model.characters, WordGenerations(4_000_000)

    def telling(word: str) -> tuple[int, ...]:
        found = [h for r in readings(word, characters) for h in features(r) if h in weights]
        return tuple(dict.fromkeys(found))

    def score(texts: list[str]) -> list[float]:
        words = [_words(t) for t in texts]
        new = known.missing(set().union(*words))
        known.grow(new, list(map(telling, new)))
        out, told = [], known.young
        known.make_room()
        for of_text in words:
            found = {h for w in of_text for h in told[w]}
            z = model.bias + math.fsum([weights[h] for h in found])
            out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
        return out

    return score


def score_documents(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from a score of 0.5)."""

    def make():
        score = scorer(model)
        return lambda column: [pa.array(score(texts_of(column)), pa.float64())]

    scored = append_columns(docs, text, [("score", T.DoubleType())], make)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
