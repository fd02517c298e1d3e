"""File walks, ignore globs, embedding cache, model files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark import Config, SearchEngine
from siftmark.functions.globs import InvalidGlob, glob_to_regex, ignore_regex, ignore_test
from siftmark.operators.embedding import attach_vectors, copies_per_text, get_or_embed
from siftmark.session import local_rows
from siftmark.sources import embedding_cache as C
from siftmark.sources.files import list_files, load_documents
from siftmark.sources.markdown_source import MarkdownReader, read_markdown
from siftmark.sources.model import OnnxEmbedder, resolve_files
from siftmark.sources.sinks import to_text


def write(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {name}\ntext of {name}\n")
    return str(root)


def listed(spark, *roots, ignore=(), inline_entries=10_000):
    cfg = Config(roots=roots, ignore=ignore)
    return sorted(r.path for r in list_files(spark, cfg, inline_entries).collect())


WALK = [
    "tea.md", "pots/green.markdown", "pots/list.csv", ".cache/c.md", "node_modules/pkg/r.md",
    "pots/target/o.md", "_u.md", "_drafts/x.mdx", "TEA.MD", "pots/.dot.md", "pots/far/away/z.md",
    "target", "pots/node_modules/q.md",
]
FOUND = ["_drafts/x.mdx", "_u.md", "pots/far/away/z.md", "pots/green.markdown", "tea.md"]


@pytest.mark.parametrize("inline_entries", [10_000, 0, 3])
def test_walk(spark, tmp_path, inline_entries):
    root = write(tmp_path / ".root", WALK)
    os.symlink(tmp_path / ".root" / "tea.md", tmp_path / ".root" / "link.md")
    os.symlink(tmp_path / ".root" / "pots", tmp_path / ".root" / "linked")
    assert listed(spark, root, inline_entries=inline_entries) == FOUND
    os.symlink(root, tmp_path / "alias")
    assert listed(spark, str(tmp_path / "alias"), inline_entries=inline_entries) == FOUND


def test_order_and_ids(spark, tmp_path):
    root = write(tmp_path, ["a-b.md", "a/b.md", "a/B.md", "a.md", "a/b/c.md"])
    engine = SearchEngine.build(spark, Config(roots=[root], lexical_only=True))
    rows = engine.chunks.orderBy("id").collect()
    assert [r.path for r in rows] == ["a/B.md", "a/b/c.md", "a/b.md", "a-b.md", "a.md"]
    assert [r.id for r in rows] == [0, 1, 2, 3, 4]
    assert {r.root for r in rows} == {root}


def test_ignore_globs_and_their_limits(spark, tmp_path):
    root = write(tmp_path, ["menu.md", "tea/menu.md", "tea/oolong.md", "old/list.md"])
    assert listed(spark, root, ignore=("menu.md",)) == ["old/list.md", "tea/menu.md", "tea/oolong.md"]
    assert "old/list.md" in listed(spark, root, ignore=("old",))
    assert "old/list.md" not in listed(spark, root, ignore=("old/**",))
    assert listed(spark, root, ignore=("*.md",)) == []
    assert len(listed(spark, root, ignore=("[z", "{a"))) == 4  # invalid: logged, dropped


GLOBS = [
    ("*.md", "a/b.md", True),
    ("?.md", "/.md", True),
    ("**/drafts/*.md", "drafts/x.md", True),
    ("**/drafts/*.md", "a/b/drafts/x.md", True),
    ("**/drafts/*.md", "xdrafts/x.md", False),
    ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True),
    ("a/**/b", "axb", False),
    ("log/**", "log", False),
    ("log/**", "log/x/y", True),
    ("**", "any/thing", True),
    ("[!a-c]x", "dx", True),
    ("[!a-c]x", "bx", False),
    ("[^a]x", "ax", False),
    ("[]]x", "]x", True),
    ("{a,b*}.md", "bcd.md", True),
    ("{a,b*}.md", "c.md", False),
    ("{**/a,b/**}", "x/a", True),
    (r"a\*", "a*", True),
    (r"a\*", "ab", False),
    ("A.md", "a.md", False),
    ("a+b(1)|$.md", "a+b(1)|$.md", True),
    ("x", "x\n", False),
]


def test_glob_table(spark):
    for glob, path, expected in GLOBS:
        row = local_rows(spark, p=[path]).select(F.col("p").rlike(glob_to_regex(glob)).alias("m"))
        assert row.collect()[0].m is expected, (glob, path)
    for bad in ("[a", "{a", "a}", "a\\", "[z-a]"):
        with pytest.raises(InvalidGlob):
            glob_to_regex(bad)
    assert ignore_regex([]) is None


def test_unreadable_inputs_are_skipped(spark, tmp_path):
    root = write(tmp_path / "r", ["ok.md"])
    (tmp_path / "r" / "bad.md").write_bytes(b"# x\n\xff\xfe\n")
    cfg = Config(roots=[root, str(tmp_path / "missing")])
    assert [r.path for r in load_documents(spark, cfg).collect()] == ["ok.md"]


def test_newlines_survive_reading(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\r\nx\ry\r\n")
    (only,) = load_documents(spark, Config(roots=[str(tmp_path)])).collect()
    assert only.source == "# A\r\nx\ry\r\n"
    (file_root,) = load_documents(spark, Config(roots=[str(tmp_path / "a.md")])).collect()
    assert file_root.path == ""


# --- the data source ------------------------------------------------------------


def scanned(spark, roots, where=None, **options):
    df = read_markdown(spark, roots, schema="path string, _seq int, bytes long, source string", **options)
    return df if where is None else df.where(where)


def test_data_source_reads_what_the_schema_names(spark, tmp_path):
    root = write(tmp_path / "r", ["a.md", "b/c.md"])
    (tmp_path / "r" / "bad.md").write_bytes(b"\xff")
    rows = {r.path: r for r in scanned(spark, [root, root]).where("_seq = 1").collect()}
    assert set(rows) == {"a.md", "b/c.md"}
    assert rows["b/c.md"].source == "# b/c.md\ntext of b/c.md\n"
    assert rows["b/c.md"].bytes == len(rows["b/c.md"].source)
    # Without the text nothing is opened, so an unreadable file is listed.
    os.chmod(tmp_path / "r" / "a.md", 0)
    listing = read_markdown(spark, [root], schema="path string")
    assert sorted(r.path for r in listing.collect()) == ["a.md", "b/c.md", "bad.md"]
    os.chmod(tmp_path / "r" / "a.md", 0o600)
    with pytest.raises(Exception, match="no such columns"):
        read_markdown(spark, [root], schema="path string, mood string").collect()
    assert scanned(spark, []).count() == 0


def test_data_source_partitions_follow_the_bytes(tmp_path):
    root = write(tmp_path / "r", [f"{i}.md" for i in range(20)])
    (tmp_path / "r" / "big.md").write_text("x" * 400_000)
    options = {"roots": json.dumps([root]), "partition_bytes": "300000"}
    parts = MarkdownReader(options, ["path", "source"]).partitions()
    sizes = [sum(f.size + 65_536 for f in p.files) for p in parts]
    assert sum(len(p.files) for p in parts) == 21 and len(parts) > 4
    assert all(size <= 300_000 or len(p.files) == 1 for size, p in zip(sizes, parts, strict=True))
    assert len(MarkdownReader(options, ["path"]).partitions()) == 1  # a listing costs little
    left = MarkdownReader(options | {"inline_entries": "0"}, ["path"]).partitions()
    assert [p.folder.path for p in left] == [""] and not left[0].files


CONDITIONS = [
    ("path = 'b/c.md'", {"b/c.md"}),
    ("path IN ('a.md', 'b/d/e.md', 'none')", {"a.md", "b/d/e.md"}),
    ("path LIKE 'b/d%'", {"b/d/e.md"}),
    ("path LIKE '%c.md'", {"b/c.md", "x/c.md"}),
    ("path LIKE '%/d/%' AND _seq = 0", {"b/d/e.md"}),
    ("path > 'b'", {"b/c.md", "b/d/e.md", "x/c.md"}),
    ("path = 'a.md' OR path LIKE 'x/%'", {"a.md", "x/c.md"}),
    ("NOT path LIKE 'b/%'", {"a.md", "x/c.md"}),
    ("path IS NULL", set()),
]


@pytest.mark.parametrize("inline_entries", [10_000, 0])
def test_conditions_are_pushed_into_the_walk(spark, tmp_path, inline_entries):
    root = write(tmp_path / "r", ["a.md", "b/c.md", "b/d/e.md", "x/c.md"])
    for condition, expected in CONDITIONS:
        found = scanned(spark, [root], condition, inline_entries=inline_entries)
        assert {r.path for r in found.collect()} == expected, condition


def test_pushed_conditions_spare_folders_and_files(tmp_path):
    from pyspark.sql import datasource as D

    root = write(tmp_path / "r", ["a.md", "b/c.md", "b/d/e.md", "x/c.md"])

    def kept(*conditions):
        reader = MarkdownReader({"roots": json.dumps([root])}, ["path", "source"])
        left = reader.pushFilters(list(conditions))
        walked = []
        real = reader._grown
        reader._grown = lambda folder: walked.append(folder.path) or real(folder)
        files = {f.path for p in reader.partitions() for f in p.files}
        return list(left), walked, files

    equal = D.EqualTo(("path",), "b/c.md")
    assert kept(equal) == ([], ["", "b"], {"b/c.md"})
    assert kept(D.StringStartsWith(("path",), "b/d"))[1:] == (["", "b", "b/d"], {"b/d/e.md"})
    assert kept(D.EqualTo(("root",), "elsewhere"))[1:] == ([], set())
    greater = D.GreaterThan(("path",), "b")
    assert kept(greater)[0] == [greater]


def test_ignore_test_agrees_with_the_pattern():
    for glob, path, expected in GLOBS:
        assert ignore_test([glob])(path) is expected, (glob, path)
    assert not ignore_test(["**"])("") and not ignore_test(["[z"])("z")


# --- embedding cache ----------------------------------------------------------


class LetterEmbedder:
    """Deterministic stand-in: letter counts, unit length."""

    model_id = "letters"

    def __init__(self, log=None, dim=8):
        self.log, self.dim = log, dim

    def embed(self, texts):
        if self.log:
            with open(self.log, "a") as out:
                out.writelines(json.dumps(t) + "\n" for t in texts)
        rows = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for ch in text.lower():
                if ch.isalpha():
                    rows[i, ord(ch) % self.dim] += 1
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norms, out=rows, where=norms > 0)

    def embed_query(self, query):
        return self.embed([query])[0]


def entries(spark, rows):
    schema = C.EMBEDDING_CACHE
    return spark.createDataFrame(rows, schema)


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_cache_round_trip(spark, tmp_path):
    cfg = Config(cache_dir=str(tmp_path))
    assert C.cache_path(cfg) == f"{tmp_path}/BAAI__bge-small-en-v1.5"
    cache = C.EmbeddingCache.at(spark, cfg)
    assert cache.load().count() == 0
    cache.save(entries(spark, [(sha("hello"), 2, [0.0, 1.0])]))
    assert cache.get("hello") == [0.0, 1.0] and cache.get("other") is None
    cache.save(entries(spark, [(sha("more"), 2, [1.0, 0.0])]))
    assert cache.load().count() == 2
    assert not [n for n in os.listdir(cache.path) if n.startswith(".staging")]


def test_cache_last_write_wins(spark, tmp_path):
    cache = C.EmbeddingCache(spark, str(tmp_path / "c"))
    cache.insert("kettle", [9.0, 0.0])
    cache.save(entries(spark, [(sha("kettle"), 2, [1.0, 0.0]), (sha("teapot"), 2, [5.0, 5.0])]))
    cache.insert("teapot", [0.0, 2.0])
    assert cache.get("kettle") == [1.0, 0.0] and cache.get("teapot") == [0.0, 2.0]
    texts = spark.createDataFrame([(1, "kettle"), (2, "teapot")], "chunk_id long, text string")
    found = get_or_embed(texts, cache.load(), None)
    assert (found.hits, found.misses) == (2, 0)
    assert {r.chunk_id: list(r.embedding) for r in found.vectors.collect()} == {
        1: [1.0, 0.0],
        2: [0.0, 2.0],
    }


def test_cache_path_precedence(monkeypatch, tmp_path):
    monkeypatch.setenv("SIFTMARK_CACHE_DIR", "/from/env")
    assert C.cache_path(Config(model_repo="o/m")) == "/from/env/o__m"
    assert C.cache_path(Config(model_repo="o/m", cache_dir="/c")) == "/c/o__m"
    local = C.cache_path(Config(model_repo="o/m", cache_dir="/c", model_dir="/models/x"))
    assert local.startswith("/c/o__m@") and local != C.cache_path(
        Config(model_repo="o/m", cache_dir="/c", model_dir="/models/y")
    )
    monkeypatch.delenv("SIFTMARK_CACHE_DIR")
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    assert C.cache_path(Config(model_repo="o/m")) == f"{tmp_path}/siftmark/o__m"


@pytest.mark.parametrize(
    "rows",
    [
        [("a", 2, [1.0, 2.0]), ("b", 1, [1.0])],
        [("a", 2, [1.0, 2.0]), ("b", 2, [1.0])],
        [("a", 2, [1.0, float("nan")])],
        [("a", 2, [1.0, float("inf")])],
        [("a", 2, [1.0, None])],
        [("a", 2, None)],
    ],
)
def test_inconsistent_cache_starts_empty(spark, tmp_path, rows):
    cache = C.EmbeddingCache(spark, str(tmp_path / "c"))
    cache.save(entries(spark, rows))
    assert cache.load().count() == 0


def test_loads_open_manifests_only(spark, tmp_path):
    cache = C.EmbeddingCache(spark, str(tmp_path / "c"))
    cache.save(entries(spark, [(sha("one"), 2, [0.0, 1.0]), (sha("two"), 2, [1.0, 1.0])]))
    cache.insert("three", [2.0, 0.0])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("load", "load")
    loaded = cache.load()
    assert len(tracker.getJobIdsForGroup("load")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert loaded.count() == 3
    known = list(cache.manifests().values())
    assert [(m.rows, m.dim, m.sound) for m in known] == [(2, 2, True), (1, 2, True)]
    assert known[1].first == known[1].last == sha("three")
    assert len(cache._load(sha("three")).inputFiles()) < len(loaded.inputFiles())
    # Files that are not those of the manifest are read through.
    folder = sorted(n for n in os.listdir(cache.path) if n.startswith("gen-"))[1]
    for name in os.listdir(f"{cache.path}/{folder}"):
        if name.startswith("part-"):
            (tmp_path / "c" / folder / name).write_bytes(b"cut short")
    assert cache.load().count() == 0 and cache.get("one") is None


def test_generations_without_manifests_are_read_through(spark, tmp_path):
    cache = C.EmbeddingCache(spark, str(tmp_path / "c"))
    rows = entries(spark, [(sha("old"), 2, [1.0, 2.0])])
    rows.write.parquet(f"{cache.path}/gen-0")
    assert cache.get("old") == [1.0, 2.0]
    cache.insert("new", [1.0, 2.0, 3.0])
    assert cache.load().count() == 0  # two lengths


def test_merge_keeps_the_last_vectors(spark, tmp_path):
    cache = C.EmbeddingCache(spark, str(tmp_path / "c"))
    cache.merge()
    expected = {}
    for step in range(4):
        rows = [(sha(f"t{i}"), 2, [float(step), float(i)]) for i in range(0, 30, step + 1)]
        cache.save(entries(spark, rows))
        expected |= {h: v for h, _, v in rows}
    before = cache.load()
    cache.merge()
    (only,) = cache.manifests().values()
    assert only.rows == 30 and len(only.replaces) == 4
    assert before.count() > 30  # replaced generations stay until they are vacuumed
    assert {r.text_hash: list(r.embedding) for r in cache.load().collect()} == expected
    cache.insert("t0", [9.0, 9.0])
    assert cache.get("t0") == [9.0, 9.0] and cache.get("t1") == expected[sha("t1")]
    cache.vacuum()
    assert len([n for n in os.listdir(cache.path) if n.startswith("gen-")]) == 2
    assert cache.get("t0") == [9.0, 9.0] and cache.get("t2") == expected[sha("t2")]
    cache.merge()
    assert cache.load().count() == 30


def test_corrupt_cache_starts_empty(spark, tmp_path):
    cache = C.EmbeddingCache(spark, str(tmp_path / "c"))
    folder = tmp_path / "c" / "gen-0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"garbage")
    assert cache.load().count() == 0


def test_each_missing_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    embedder = LetterEmbedder(str(log))
    texts = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb"])], "chunk_id long, text string"
    )
    known = entries(spark, [(sha("cc"), 8, [float(i == 3) for i in range(8)])])
    found = get_or_embed(texts, known, embedder)
    assert (found.hits, found.misses, found.dim) == (1, 4, 8)
    assert sorted(map(json.loads, log.read_text().splitlines())) == ["aa", "bb"]
    rows = {r.chunk_id: list(r.embedding) for r in found.vectors.collect()}
    assert rows[0] == rows[2] == pytest.approx(embedder.embed(["aa"])[0].tolist())
    assert rows[3] == [float(i == 3) for i in range(8)] and len(rows) == 5


def test_frequent_texts_take_the_broadcast_route(spark, monkeypatch):
    from siftmark.operators import embedding

    monkeypatch.setattr(embedding, "_HOT_MINIMUM", 3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(60)]
    hashed = spark.createDataFrame(rows, "chunk_id long, text_hash string")
    names = sorted({t for _, t in rows})
    cached = entries(spark, [(t, 1, [float(i)]) for i, t in enumerate(names)])
    cached = cached.unionByName(cached)  # duplicate entries count once
    found = attach_vectors(hashed, copies_per_text(hashed), cached, 60).collect()
    assert sorted((r.chunk_id, r.embedding[0]) for r in found) == [
        (i, float(names.index(t))) for i, t in rows
    ]


def test_engine_reuses_cached_vectors(spark, tmp_path):
    root = write(tmp_path / "docs", ["alpha.md", "zulu.md", "kilo/lima.md"])
    log = tmp_path / "log"
    cfg = Config(roots=[root], cache_dir=str(tmp_path / "cache"), per_page=0)
    engine = SearchEngine.build(spark, cfg, LetterEmbedder(str(log)))
    first = engine.search("zulu", 2).collect()
    assert first[0].path == "zulu.md" and len(first) == 2
    assert engine.stats()["dense"] is True and engine.stats()["dim"] == 8
    embedded = len(log.read_text().splitlines())
    write(tmp_path / "docs", ["new.md"])
    again = SearchEngine.build(spark, cfg, LetterEmbedder(str(log)))
    again.vectors
    assert len(log.read_text().splitlines()) == embedded + 1  # the new chunk only
    # Every query has hits with a dense list, however unrelated.
    assert len(again.search("qqqq", 2).collect()) == 2


def test_failed_cache_save_is_only_a_warning(spark, tmp_path, monkeypatch):
    root = write(tmp_path / "docs", ["alpha.md"])
    monkeypatch.setattr(C.EmbeddingCache, "save", lambda *a: (_ for _ in ()).throw(OSError("full")))
    cfg = Config(roots=[root], cache_dir=str(tmp_path / "cache"))
    engine = SearchEngine.build(spark, cfg, LetterEmbedder())
    assert engine.search("alpha", 1).count() == 1


# --- model files --------------------------------------------------------------


def test_model_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        resolve_files(Config(model_dir=str(tmp_path)))
    with pytest.raises(ValueError):
        resolve_files(Config(model_repo="noslash"))
    for name in ("model.onnx", "tokenizer.json"):
        (tmp_path / name).write_bytes(b"")
    assert resolve_files(Config(model_dir=str(tmp_path))) == (
        str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"),
    )


def _field(number, payload):
    """One length-delimited or varint protobuf field."""

    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def _value_info(name, elem_type, dims):
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    tensor = _field(1, elem_type) + _field(2, shape)
    return _field(1, name) + _field(2, _field(1, tensor))


def write_model(folder, table):
    """A minimal encoder: looks every token id up in ``table`` (float [vocab, dim])."""
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "hidden") + _field(4, "Gather")
    dims = b"".join(_field(1, d) for d in table.shape)
    weights = dims + _field(2, 1) + _field(8, "table") + _field(9, table.tobytes())
    inputs = b"".join(
        _field(11, _value_info(n, 7, ["b", "s"]))
        for n in ("input_ids", "attention_mask", "token_type_ids")
    )
    graph = _field(1, node) + _field(2, "g") + _field(5, weights) + inputs
    graph += _field(12, _value_info("hidden", 1, ["b", "s", table.shape[1]]))
    model = _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))
    (folder / "model.onnx").write_bytes(model)
    words = ["[PAD]", "[UNK]", "alpha", "beta", "gamma"]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(folder / "tokenizer.json"))


def test_onnx_embedder(spark, tmp_path):
    table = np.array([[0, 0], [3, 4], [1, 0], [0, 2], [0, 0]], np.float32)
    write_model(tmp_path, table)
    cfg = Config(model_dir=str(tmp_path))
    embedder = OnnxEmbedder.load(spark, cfg)
    found = embedder.embed(["alpha beta gamma", "beta", "other", "gamma"] * 20)
    assert found.shape == (80, 2)
    assert np.allclose(found[:4], [[1, 0], [0, 1], [0.6, 0.8], [0, 0]])
    assert np.allclose(embedder.embed_query("alpha"), [0.6, 0.8])  # instruction comes first
    texts = local_rows(spark, chunk_id=[0, 1], text=["alpha x", "beta"])
    vectors = get_or_embed(texts, entries(spark, []), embedder).vectors.collect()
    assert {r.chunk_id: list(r.embedding) for r in vectors} == {0: [1.0, 0.0], 1: [0.0, 1.0]}


def test_text_output():
    from pyspark.sql import Row

    hit = Row(path="a.md", line_start=1, line_end=3, heading_path=["A", "B"], score=0.016393,
              snippet="first\nsecond")
    assert to_text([hit]) == " 1. [0.0164] a.md:1-3  A > B\n    first"
