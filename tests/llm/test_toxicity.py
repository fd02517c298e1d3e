"""Toxicity: the search against all readings, held-out accuracy, obfuscated words."""

import itertools

import numpy as np
import pytest

from siftmark.llm import toxicity as X
from siftmark.llm.queries import op5_toxicity, toxic_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return toxic_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_trigram_counts(spark, odd_docs, no_docs):
    texts = [r.text or "" for r in odd_docs.collect()]
    wanted = {}
    for text in texts:
        code = X._codes(f"  {text}  ").tolist()
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            wanted[a, b, c] = wanted.get((a, b, c), 0) + 1
    size = X._SIZE
    found = {
        (r.gram // size**2, r.gram // size % size, r.gram % size): r.n
        for r in X.trigram_counts(odd_docs).collect()
    }
    assert {g: n for g, n in found.items() if any(g)} == {g: n for g, n in wanted.items() if any(g)}
    assert X.trigram_counts(no_docs).count() == 0


def reading_cost(word, picks, characters):
    """Cost of one way to read a word: per sign a letter, a repeat or a drop."""
    cost, state, out = 0.0, (0, 0), ""
    for c, pick in zip(word, picks, strict=True):
        if pick == "drop":
            cost += X.DROP_COST if c in X.SEPARATORS else X.OTHER_COST
            continue
        letter, repeat = pick
        paid = 0.0 if c.isalpha() and letter == c else X.SIGN_COST
        at = X._INDEX.get(letter, X._SIZE - 1)
        if repeat:
            if at != state[1] or not out:
                return None
            cost += paid + X.REPEAT_COST
        else:
            cost += paid + float(characters[state[0], state[1], at])
            state, out = (state[1], at), out + letter
    return cost + float(characters[state[0], state[1], 0]), out


@pytest.mark.parametrize("word", ["1d10t", "m.o.r", "sc00m", "a--b", "tr@ssh", "l0o0", "x!|1"])
def test_search_finds_the_cheapest_reading(model, word):
    choices = []
    for c in word:
        letters = ([c] if c.isalpha() else []) + list(X.IMITATES.get(c, ""))
        picks = [(x, r) for x in letters for r in (False, True)]
        choices.append(picks + ([] if c.isalpha() else ["drop"]))
    costs = [reading_cost(word, picks, model.characters) for picks in itertools.product(*choices)]
    best = min(c for c in costs if c is not None)
    assert X.restore(word, model.characters) == best[1]


def test_disguises_of_learned_words(model):
    score = X.scorer(model)
    plain = score(["you are an idiot", "such a moron he was", "what a clown that is"])
    hidden = score(
        ["you are an 1d10t", "such a m.o.r.o.n he was", "what a c l o w n that is", "an idiooooot!!"]
    )
    clean = score(["The onou and ersh ntedly esha, onerbleretion.", "Room 101, 3.5 km", ""])
    assert min(plain) >= 0.5 and min(hidden) >= 0.5 and max(clean) < 0.5


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op5_toxicity(spark, SF).where("held_out").join(labels, "doc_id").collect()
    right = np.array([r.predicted == r.toxic for r in rows])
    assert len(rows) > 50 and right.mean() >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows_and_labels(spark, model, odd_docs, no_docs):
    rows = X.score_documents(odd_docs, model).collect()
    assert len(rows) == 9 and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert X.score_documents(no_docs, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, label int")
    for labels in (none, spark.createDataFrame([(4, 0), (7, None)], "doc_id long, label int")):
        flat = X.fit(odd_docs, labels)
        assert X.scorer(flat)(["an idiot", ""])[0] < 0.01


def test_labels_lang_and_source_are_no_inputs(spark, model):
    docs = spark.createDataFrame([(1, "a text", "en"), (2, "a text", "fr")], "doc_id long, text string, lang string")
    assert len({r.score for r in X.score_documents(docs, model).collect()}) == 1


@pytest.mark.parametrize("percent", [5, 45, 60, 90])
def test_any_share_of_toxic_labels(percent):
    pick = np.random.default_rng(4)
    plain = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ara", "eno", "ilu", "omi") for c in "nrstv"]
    bad = ["idiot", "moron", "clown", "trash"]
    labels = [int(i % 100 < percent) for i in range(1500)]
    texts = [[*pick.choice(plain, 20), *([bad[i % 4]] if y else [])] for i, y in enumerate(labels)]
    characters = X.model_of_counts(np.zeros(X._SIZE**3))
    rows = X._document_features([" ".join(t) for t in texts], characters)
    score = X.scorer(X.fit_rows(rows, labels, characters))
    clean = [" ".join(pick.choice(plain, 20)) for _ in range(300)]
    assert np.mean(np.array(score(clean)) < 0.5) > 0.97 and score([""])[0] < 0.5
    assert np.mean(np.array(score([f"{t} {bad[i % 4]}" for i, t in enumerate(clean)])) >= 0.5) > 0.97


# Everyday words, many of which begin like the words of the labels.
EVERYDAY = """
idiom idiomatic ideal idea idle idiosyncratic idol moratorium morale morocco morning mortar moral more clover cloud
clock clothes clone close transport trap tradition train travel traffic transparent trash-can tray scuba sculpture
scurry pathos pathology patient path pathway worthy worth worthwhile stupendous studio student stumble study loserville
lost lose loom loan garden garage gardener garland crane craft creature crater dumbbell dump duplicate duke fools-gold
football food foot jerkin jersey jerky jewel pigeon pigment piglet pine ratio rational rather rate snake snack snail
toaster toad today tomorrow ugliest uglier umbrella useful usage usual wretch wren wrench wrestle vermilion vertical
verse filter film filth-free final find monster-truck monument month mobile creep-feed cream credit
idiome idéal idiosyncrasie morale moratoire morue clôture clown-fish clos traduction trahison train transport trace
scution sculpteur pathétique pathologie patience stupeur studieux nul nulle nullement null nuage ordures ordre orange
idee idiomatisch morgen moor moral klausel kloster tradition trost traum schulter schule patenschaft pathos wortlaut
wurzel studium stupide-frei stunde abfall abend mull mulde dumm-dumm dumpf durst null nummer narzisse narbe
idea idioma ideal moral moreno morir clase claro cloro trabajo tradicion tren traje escudo escuela patio patria
estudio estupendo basura-cero basta barco tonto-hermano tonel toalla nulo nube feo-lindo fecha feria paloma paleta
""".split()


def test_everyday_words_are_clean(model):
    score = X.scorer(model)
    assert len(EVERYDAY) >= 200
    texts = [f"the {w} is here" for w in EVERYDAY] + [
        "An idiom is a short phrase.", "his idiosyncratic style", "a moratorium in Morocco",
        "the clover and the cloud", "the transport trap", "pathos and pathology", "worthy",
    ]
    toxic = [t for t, s in zip(texts, score(texts), strict=True) if s >= 0.5]
    # What remains are compounds of a learned word itself.
    assert [t for t in toxic if "-" not in t] == []


def test_an_opening_needs_several_words():
    texts = [["idiot", "fine"], ["idiots", "nice"], ["idiotic", "sun"], ["moron", "sea"], ["calm", "idea"]]
    pairs = [p.tobytes() for p in X._document_pairs([" ".join(t) for t in texts[:4]], X.model_of_counts(np.zeros(X._SIZE**3)))]
    names = np.unique(np.concatenate([np.frombuffer(p, "<u4").reshape(2, -1)[0] for p in pairs]))
    rare = dict(zip(names.tolist(), X._rare_openings(names, pairs).tolist(), strict=True))
    assert not rare[X.features("idiot")[0]] and not rare[X.features("moron")[0]]
    assert not rare[X.features("idi")[1]] and not rare[X.features("idiot")[3]]
    assert rare[X.features("mor")[1]] and rare[X.features("idioti")[4]]


def longhand(word, model, least, repeats):
    """Readings of every tail by a search of its own."""
    out = []
    for n in range(least, len(word) + 1):
        out += X._search(word[:n], model, n, repeats)
    last = out[-1]
    return [*dict.fromkeys(r for r in out if r != last), last]


@pytest.mark.parametrize("longest", [64, 5])
def test_tails_are_read_as_one_by_one(model, monkeypatch, longest):
    monkeypatch.setattr(X, "LONGEST", longest)
    draw = np.random.default_rng(8)
    for _ in range(60):
        word = "".join(draw.choice(list("aeiost"), 3)) + "".join(draw.choice(list("!$+|1"), draw.integers(1, 3)))
        word += "".join(draw.choice(["!", "$", "!$", "+", "||"], 1)) * int(draw.integers(1, 9))
        for repeats in (True, False):
            assert X._search(word, model.characters, 4, repeats) == longhand(word, model.characters, 4, repeats), word


def test_long_tails_of_signs(model):
    import tracemalloc

    tracemalloc.start()
    for tail in ("!" * 1_000_000, "$!" * 500_000, "!$+" * 20_000):
        found = X.readings("a" + tail, model.characters)
        assert found[0] == "a" and all(len(w) <= X.LONGEST for w in found)
    assert tracemalloc.get_traced_memory()[1] < 150_000_000  # linear in the word
    tracemalloc.stop()
    assert X.scorer(model)(["idiot" + "!" * 100_000])[0] >= 0.5


def test_look_alikes_of_other_scripts(model):
    assert "idiot" in X.readings("іdiоt", model.characters)
    assert X.readings("идиот", model.characters) == ["идиот"]
    assert X.scorer(model)(["such an іdiоt"])[0] >= 0.5


def test_disguised_endings(model):
    """Signs at the end are read as letters too, also before a comma or full stop."""
    wanted = {
        "a$$": "ass", "a$$.": "ass", "a$$!": "ass", "dumba$$,": "dumbass", "sh!+": "shit",
        "Sh!+!!": "shit", "kis$,": "kiss", "idio+": "idiot", "idio+.": "idiot", "1d!0+!": "idiot", "@$$": "ass",
    }
    for word, said in wanted.items():
        assert said in X.readings(word, model.characters), word
    for word in ("word$$$", "word!!", "word!", "word,", "word+"):
        assert X.readings(word, model.characters)[0] == "word"
    for word in ("$$$", "!!", "+", ""):
        assert X.readings(word, model.characters) == []
    hidden = X.scorer(model)(["such an idio+.", "you are an 1d!0+!", "that moron!! is here"])
    assert min(hidden) >= 0.5
