"""End-to-end searches over markdown files."""

import io
import json

import pytest

from siftmark import Config, SearchEngine, cli
from siftmark.functions.markdown import pieces
from siftmark.operators.dense import VectorIndex
from siftmark.operators.fusion import fuse
from siftmark.session import local_rows

CORPUS = {
    "bees/hives.md": "# Hives\n\n## Winter cover\n\nWrap each hive in felt before frost comes.\n\n"
    "## Splitting\n\nCall `hive::split` in May, and a strong colony becomes two. "
    "Feed both with syrup afterwards.\n",
    "bees/stings.md": "# Stings\n\nA cold spoon and a little vinegar calm the skin within minutes.\n",
    "pond/pumps.md": "# Pond pumps\n\n## Cleaning\n\nRinse the pump filter in pond water, "
    "never under the tap.\n",
    "soil/lime.md": "# Liming\n\nSpread lime in autumn on beds where `Brassica oleracea` failed.\n",
    "yard/todo.md": "# Todo\n\nMend the gate and oil both of its hinges.\n",
}
MARSH = {
    "m.md": "# Upper\nsalt marsh\n\n## Middle\nsalt marsh\n\n### Lower\nsalt marsh\n",
    "n.md": "# Dune\nsalt grass\n",
}


def write_files(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8", newline="")
    return str(root)


@pytest.fixture(scope="module")
def corpus_root(tmp_path_factory):
    return write_files(tmp_path_factory.mktemp("corpus"), CORPUS)


@pytest.fixture(scope="module")
def corpus(spark, corpus_root):
    return SearchEngine.build(spark, Config(roots=[corpus_root], lexical_only=True))


@pytest.fixture(scope="module")
def marsh_root(tmp_path_factory):
    return write_files(tmp_path_factory.mktemp("marsh"), MARSH)


def test_chunk_ids_paths_and_lines(corpus):
    rows = corpus.chunks.orderBy("id").collect()
    assert [(r.id, r.path, list(r.heading_path), r.line_start, r.line_end) for r in rows] == [
        (0, "bees/hives.md", ["Hives"], 1, 1),
        (1, "bees/hives.md", ["Hives", "Winter cover"], 3, 5),
        (2, "bees/hives.md", ["Hives", "Splitting"], 7, 9),
        (3, "bees/stings.md", ["Stings"], 1, 3),
        (4, "pond/pumps.md", ["Pond pumps"], 1, 1),
        (5, "pond/pumps.md", ["Pond pumps", "Cleaning"], 3, 5),
        (6, "soil/lime.md", ["Liming"], 1, 3),
        (7, "yard/todo.md", ["Todo"], 1, 3),
    ]


def test_relevance(corpus):
    best = corpus.search("splitting a colony", 3).collect()[0]
    assert (best.chunk_id, best.line_start) == (2, 7)
    assert corpus.search("rinsing the pump's filter", 2).collect()[0].chunk_id == 5


def test_lookups_and_stats(corpus):
    assert corpus.get_document("bees//hives.md") == "\n\n".join(
        corpus.get_chunk(i).text for i in range(3)
    )
    assert corpus.get_document("attic.md") is None
    assert corpus.get_chunk(2).text.startswith("## Splitting")
    assert corpus.get_chunk(8) is None and corpus.get_chunk(-1) is None
    stats = corpus.stats()
    assert (stats["files"], stats["chunks"], stats["dense"], stats["dim"]) == (5, 8, False, 0)
    assert stats["lexical_terms"] == corpus.lexical.term_count() > 20


def test_empty_queries(corpus):
    for query, k in (("   ", 5), ("\u3000\t", 5), ("hive", 0), ("qqzunseen", 5)):
        assert corpus.search(query, k).collect() == []
    assert corpus.search("...", 5).collect() == []


def test_phrase_bonus_is_added_once_per_chunk(corpus):
    plain = {r.chunk_id: r.score for r in corpus.search("cover winter", 8).collect()}
    phrase = {r.chunk_id: r.score for r in corpus.search("Winter COVER", 8).collect()}
    assert phrase[1] - plain[1] == pytest.approx(0.02)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_come_from_pruned_slabs_at_any_k(corpus):
    small = corpus.search("the hive in frost", 8)
    large = corpus.search("the hive in frost", 2000)
    for hits in (small, large):
        assert "dynamicpruningexpression(_slab" in executed(hits)
    assert large.collect()[: small.count()] == small.collect()


def test_collapse_and_matched_counts(spark, marsh_root):
    engine = SearchEngine.build(spark, Config(roots=[marsh_root], lexical_only=True))
    rows = engine.search("salt", 2).collect()
    assert {r.path: r.chunks_matched for r in rows} == {"m.md": 3, "n.md": 1}
    engine = SearchEngine.build(spark, Config(roots=[marsh_root], lexical_only=True, per_page=0))
    rows = engine.search("salt", 4).collect()
    assert sorted((r.path, r.chunks_matched) for r in rows) == [("m.md", 3)] * 3 + [("n.md", 1)]


def test_close_deletes_the_tables(spark, marsh_root, monkeypatch):
    gone = []
    monkeypatch.setattr("siftmark.plans.engine.drop_tables", gone.append)
    with SearchEngine.build(spark, Config(roots=[marsh_root], lexical_only=True)) as engine:
        assert engine.table.count == 4 and not gone
    assert gone == [spark]


def test_same_path_under_two_roots_merges(spark, tmp_path):
    roots = [write_files(tmp_path / d, {"x.md": f"# {d}\n{d} words\n"}) for d in ("two", "one")]
    engine = SearchEngine.build(spark, Config(roots=roots, lexical_only=True))
    assert [r.text[:5] for r in engine.chunks.orderBy("id").collect()] == ["# one", "# two"]
    assert engine.stats()["files"] == 1
    assert engine.get_document("x.md") == "# one\none words\n\n# two\ntwo words"
    twice = SearchEngine.build(spark, Config(roots=[roots[0]] * 2, lexical_only=True))
    assert twice.table.count == 2


def test_empty_corpus(spark, tmp_path):
    engine = SearchEngine.build(spark, Config(roots=[str(tmp_path / "none")], lexical_only=True))
    assert engine.search("anything", 3).collect() == []
    assert engine.stats() == {
        "files": 0, "chunks": 0, "lexical_terms": 0, "dense": False, "dim": 0,
    }
    assert engine.get_chunk(0) is None and engine.get_document("a.md") is None


def run_cli(spark, *argv):
    out = io.StringIO()
    cli.run(spark, cli.parser().parse_args(list(argv)), out)
    return out.getvalue()


def test_cli(spark, corpus_root):
    base = ("--root", corpus_root, "--lexical-only")
    assert json.loads(run_cli(spark, *base, "index"))["chunks"] == 8
    hits = json.loads(run_cli(spark, "search", "splitting colony", "--json", "-k", "2", *base))
    assert list(hits[0]) == [
        "chunk_id", "path", "heading_path", "line_start", "line_end", "score", "snippet",
        "chunks_matched",
    ]
    text = run_cli(spark, *base, "search", "splitting colony", "-k", "1").splitlines()
    assert text[0].startswith(" 1. [0.") and text[0].endswith(
        "bees/hives.md:7-9  Hives > Splitting"
    )
    assert text[1] == "    ## Splitting"
    assert json.loads(run_cli(spark, *base, "show", "--chunk", "7"))["path"] == "yard/todo.md"
    assert run_cli(spark, *base, "show", "--path", "yard/todo.md") == CORPUS["yard/todo.md"]
    for bad in (("show", "--chunk", "99"), ("show", "--path", "attic.md")):
        with pytest.raises(LookupError):
            run_cli(spark, *base, *bad)


def test_cli_version(capsys):
    with pytest.raises(SystemExit) as stopped:
        cli.parser().parse_args(["--version"])
    assert stopped.value.code == 0 and capsys.readouterr().out.startswith("siftmark ")


def test_cli_errors(monkeypatch):
    monkeypatch.delenv("SIFTMARK_ROOTS", raising=False)
    assert cli.main(["index"]) == 1
    for bad in (["--root", "x", "show"], ["show", "--chunk", "1", "--path", "p"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_cli_config_from_environment(monkeypatch):
    monkeypatch.setenv("SIFTMARK_ROOTS", "/a:/b")
    monkeypatch.setenv("SIFTMARK_IGNORE", "x.md:log/**")
    monkeypatch.setenv("SIFTMARK_MODEL", "o/m")
    cfg = cli.config_from(cli.parser().parse_args(["search", "q", "--per-page", "0"]))
    assert cfg.roots == ("/a", "/b") and cfg.ignore == ("x.md", "log/**")
    assert (cfg.model_repo, cfg.per_page, cfg.default_top_k) == ("o/m", 0, 8)
    cfg = cli.config_from(cli.parser().parse_args(["--root", "c:d", "--root", "e", "index"]))
    assert cfg.roots == ("c", "d", "e")


def test_search_equals_composition_on_chunk_table(spark, corpus):
    """The engine's single list equals fusing by hand with an empty dense list."""
    lexical = corpus.lexical.search("splitting a colony", 12)
    none = VectorIndex.build(
        local_rows(spark, chunk_id=[0], embedding=[[1.0, 0.0]]).selectExpr(
            "chunk_id", "cast(embedding as array<float>) embedding"
        )
    ).search([0.0, 1.0], 12).where("false")
    fused = fuse(lexical, none, k=12, at_most=12).collect()
    found = corpus.search("splitting a colony", 3).collect()
    assert found[0].chunk_id == fused[0].chunk_id
    assert found[0].score == pytest.approx(1 / 61)


def test_pieces_join_is_document_text(corpus):
    for path, source in CORPUS.items():
        expected = "\n\n".join(p.text for p in pieces(source, 256, 32))
        assert corpus.get_document(path) == expected


def test_posting_lists_are_laid_out_for_the_second_search(spark, corpus_root):
    engine = SearchEngine.build(spark, Config(roots=[corpus_root], lexical_only=True))
    engine.stats()
    first = engine.search("splitting a colony", 5).collect()
    assert engine.lexical.inverted is None
    assert engine.search("splitting a colony", 5).collect() == first and first
    assert engine.lexical.inverted is not None
