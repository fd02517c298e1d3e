"""The engine's operators as queries over the given tables.

``documents`` stands in for a corpus in two ways: each row as one chunk
(``row_chunks``), or each row as a markdown file put through the chunker
(``document_chunks``). ``conversations`` rows become small markdown files with
headings and a fence. Every query reads its whole tables.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Weights
from ..functions import text as X
from ..functions.stemming import stem_values
from ..operators.chunking import build_chunks, order_documents, path_components
from ..operators.clustered import ClusteredIndex
from ..operators.dense import VectorIndex, l2_normalize
from ..operators.documents import document_parts, document_text
from ..operators.embedding import attach_vectors, copies_per_text, get_or_embed, hit_counts
from ..operators.fusion import candidate_pool, collapse, fuse, with_phrase_bonus
from ..operators.lexical import (
    Bm25Index,
    corpus_stats,
    forward,
    idf,
    postings,
)
from ..operators.ordering import NumberedTable, with_rank
from ..session import local_rows, materialize, table_path
from ..sources.embedding_cache import EmbeddingCache, is_consistent
from ..sources.markdown_source import read_markdown
from ..sources.tables import documents_from_table, drop_ignored
from .engine import SearchEngine

QUERY = "the onering of thtion ereat mail3.example.com"
REPEATED_QUERY = "the thtion the onering thtion the"
HEADING_QUERY = "turn user the 3"
PHRASE = "of the"
K = 8
LARGE_K = 200
POOL = candidate_pool(K)
WEIGHTED = Weights(lexical=0.3, dense=1.0)
IGNORED = ("src1/**", "*7.md", "src{2,3}/[0-4]*.md", "**/?.md")
ONE_PATH = "src3/3.md"
ONE_CHUNK = 3
SHARED_PATH = "conv-7/turn-0.md"
TWO_ROOTS_QUERY = "le the die de thtion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def _file_path() -> Column:
    return F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def row_chunks(spark: SparkSession, sf_dir: str, path: Column | None = None) -> DataFrame:
    """Each document as one heading-less chunk; by default one path per source."""
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        (path if path is not None else F.col("source")).alias("path"),
        F.lit("documents").alias("root"),
        F.array().cast("array<string>").alias("heading_path"),
        "text",
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return documents_from_table(docs, _file_path(), F.col("text"), F.lit("documents"))


def document_chunks(spark: SparkSession, sf_dir: str) -> NumberedTable:
    return build_chunks(order_documents(document_files(spark, sf_dir)), Config())


def conversation_chunks(spark: SparkSession, sf_dir: str) -> NumberedTable:
    """One file per turn: a heading with a fenced ``#`` line, then the turn's section."""
    turns = table(spark, sf_dir, "conversations")
    markdown = F.format_string(
        "# conv %d\n\n```\n# code %d\n```\n## turn %d %s\n%s",
        "conv_id", "turn", "turn", "role", "text",
    )
    path = F.format_string("conv-%d/turn-%d.md", "conv_id", "turn")
    files = documents_from_table(turns, path, markdown, F.lit("conversations"))
    return build_chunks(order_documents(files), Config(chunk_tokens=0))


def _index(chunks: DataFrame, stem: bool = False, inverted: bool = False) -> Bm25Index:
    return Bm25Index.build(chunks, stem=stem, inverted=inverted)


def _scored(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round("score", 6))


# --- text analysis ------------------------------------------------------------


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = _documents(spark, sf_dir).select(F.explode(X.tokens("text")).alias("term"))
    return exploded.groupBy("term").agg(F.count("*").alias("n"))


def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct token and its stem."""
    found = _documents(spark, sf_dir).select(F.explode(X.tokens("text")).alias("term")).distinct()
    marked = X.mark_verbatim(F.array("term"))[0]
    return found.select("term", F.arrow_udf("string")(stem_values)(marked).alias("stem"))


def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc_id", F.explode(X.words("text")).alias("word"))
    return (
        found.where(X.has_internal_separator(F.col("word")))
        .select("doc_id", "word", F.explode(X.identifier_parts(F.col("word"))).alias("part"))
        .groupBy("doc_id", "word", "part")
        .agg(F.count("*").alias("n"))
    )


def alphabetic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc_id", X.words("text").alias("w"))
    return found.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.filter("w", X.all_alphabetic)).cast("long").alias("n_alphabetic"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet("text").alias("snippet"))


def indexable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    trail = F.when(
        F.col("turn") > 0, F.array(F.concat(F.lit("conv "), F.col("conv_id")), F.col("role"))
    ).otherwise(F.array().cast("array<string>"))
    return turns.select("conv_id", "turn", X.indexable_text(trail, F.col("text")).alias("indexable"))


# --- sources and chunking -----------------------------------------------------


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_ignored(document_files(spark, sf_dir), IGNORED).select("path")


def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every file path in component order (``a/b`` before ``a-b``)."""
    docs = table(spark, sf_dir, "documents")
    mixed = F.when(F.col("doc_id") % 2 == 0, F.lit("/")).otherwise(F.lit("-"))
    path = F.concat("source", mixed, F.col("doc_id").cast("string"), F.lit(".md"))
    order = [path_components("path"), F.col("doc_id")]
    ranked = with_rank(docs.select("doc_id", path.alias("path")), order, "position", None)
    return ranked.select("path", "position")


_INSIDE = "node_modules/%s.md", "src/.draft/%s.md", "%s.txt", "part/old/%s.md"


def _write_files(rows: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below ``root``, from the tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                place = os.path.join(root, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as out:
                    out.write(content)
                written += 1
        yield pa.record_batch([pa.array([written], pa.int64())], ["n"])

    rows.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversations as two roots of files, found and read by the data source.

    Of ten documents four have places or names that are passed over, one is not UTF-8 and
    one shares its path with the opening turn of a conversation in the other root.
    """
    base = table_path(spark, "corpus").removeprefix("file://").removeprefix("file:")
    name, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 10
    path = F.concat("source", F.lit("/"), name, F.when(kind == 4, F.lit(".mdx")).otherwise(F.lit(".md")))
    for i, form in enumerate(_INSIDE):
        path = F.when(kind == i, F.format_string(form, name)).otherwise(path)
    path = F.when(kind == 6, F.format_string("shared/%s.md", name)).otherwise(path)
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(kind == 5, F.concat(F.unhex(F.lit("FF")), text)).otherwise(text)
    _write_files(_documents(spark, sf_dir).select(path.alias("path"), content.alias("content")), f"{base}/a")
    turns = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    path = F.when(F.col("turn") == 0, F.format_string("shared/%s.md", conv)).otherwise(
        F.format_string("talk/%s/%s.markdown", conv, F.col("turn").cast("string"))
    )
    _write_files(turns.select(path.alias("path"), F.col("text").cast("binary").alias("content")), f"{base}/b")
    found = read_markdown(
        spark,
        [f"{base}/a", f"{base}/missing", f"{base}/b"],
        ["*/old/**"],
        "path string, _seq int, bytes long, source string",
        partition_bytes=1 << 20,
    )
    return found.select(
        F.col("_seq").cast("long").alias("root_number"),
        "path",
        "bytes",
        F.md5(F.col("source").cast("binary")).alias("digest"),
    )


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "id", "path", X.heading_line("heading_path").alias("headings"), "text",
        "line_start", "line_end",
    )


def chunk_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(document_chunks(spark, sf_dir).rows())


def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(conversation_chunks(spark, sf_dir).rows())


def fenced_markdown() -> Column:
    """Markdown of one turn: fences of both marks, nested and left open, deep headings."""
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    opened = F.when(F.col("turn") % 2 == 1, F.lit("```\nto the end\n# not a heading\n")).otherwise(F.lit(""))
    return F.concat(
        F.lit("before "), F.col("role"), F.lit("\n# conv "), F.col("conv_id").cast("string"),
        F.lit("\n```py\n# no heading\n~~~\nstill open here\n````\n"), body,
        F.lit("\n### deep C#  ##\n~~~~ x\n```\n~~~\n"), body, F.lit("\n~~~~~\n\n \n"), body,
        F.lit("\n####### seven\n#### "), F.col("role"), F.lit("\n\n"), body,
        F.lit("\n## back\n"), opened, body, F.lit("\n"),
    )


def chunk_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splitter at work around fences and under headings: 12 tokens, overlap 4."""
    turns = table(spark, sf_dir, "conversations")
    path = F.format_string("conv-%d/turn-%d.md", "conv_id", "turn")
    files = documents_from_table(turns, path, fenced_markdown(), F.lit("conversations"))
    cfg = Config(chunk_tokens=12, chunk_overlap=4)
    return _chunk_rows(build_chunks(order_documents(files), cfg).rows())


# --- lexical index ------------------------------------------------------------


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of every chunk, a row each."""
    return postings(forward(row_chunks(spark, sf_dir), stem=False))


def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(row_chunks(spark, sf_dir))
    value = F.round(idf(F.lit(index.n_docs), F.col("df")), 6)
    return index.terms.select("term", "df", value.alias("idf"))


def doc_len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forward(conversation_chunks(spark, sf_dir).rows(), stem=False)
    return corpus_stats(rows).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = Config(lexical_only=True, stem=False)
    stats = SearchEngine.from_documents(document_files(spark, sf_dir), cfg).stats()
    return local_rows(spark, **{name: [value] for name, value in stats.items()})


def index_stats_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an embedder: the dense index is built through the cache and has its length."""
    cfg = Config(stem=False, cache_dir=table_path(spark, "cache"))
    engine = SearchEngine.from_documents(document_files(spark, sf_dir), cfg, LetterCounts())
    return local_rows(spark, **{name: [value] for name, value in engine.stats().items()})


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(row_chunks(spark, sf_dir)).search(QUERY, POOL))


def bm25_inverted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(row_chunks(spark, sf_dir), inverted=True).search(QUERY, POOL))


def _by_blocks(spark: SparkSession, sf_dir: str, query: str, hot_list: int) -> DataFrame:
    """Terms in more than ``hot_list`` chunks are hot, blocks of 32 chunks."""
    index = Bm25Index.build(
        row_chunks(spark, sf_dir), stem=False, hot_list=hot_list, block_chunks=32
    )
    return _scored(index.search(query, POOL))


def bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_blocks(spark, sf_dir, QUERY, 100)


def bm25_block_max_hot_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_blocks(spark, sf_dir, REPEATED_QUERY, 1)


def bm25_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(row_chunks(spark, sf_dir)).search(REPEATED_QUERY, POOL))


def bm25_heading_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = conversation_chunks(spark, sf_dir).rows()
    return _scored(_index(chunks).search(HEADING_QUERY, POOL))


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(row_chunks(spark, sf_dir), stem=True).search(QUERY, POOL))


# --- dense index --------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding"
    )


def _query_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.orderBy("chunk_id").select("embedding").first().embedding)


def l2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of rescaled vectors after normalisation."""
    rows = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: (x * (F.col("label") + 2)).cast("float"))
    dim = F.size("embedding")
    width = rows.select(dim.alias("n")).first().n
    unit = rows.select("vec_id", l2_normalize(scaled, width).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _scored(VectorIndex.build(vectors).search(_query_vector(vectors), POOL))


def cosine_topk_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through cells and shells, opening those that can hold a result."""
    vectors = _vectors(spark, sf_dir)
    index = ClusteredIndex.build(vectors, cells=16)
    return _scored(index.search(_query_vector(vectors), POOL))


# --- fusion -------------------------------------------------------------------


def _both_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, sf_dir)
    lexical = _index(row_chunks(spark, sf_dir)).search(QUERY, POOL)
    return lexical, VectorIndex.build(vectors).search(_query_vector(vectors), POOL)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(fuse(*_both_lists(spark, sf_dir), k=POOL, at_most=POOL))


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(fuse(*_both_lists(spark, sf_dir), weights=WEIGHTED, k=POOL, at_most=POOL))


def _candidates(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Lexical pool with phrase bonus, joined to its chunks."""
    chunks = row_chunks(spark, sf_dir)
    lexical = _index(chunks).search(query, POOL)
    fused = fuse(lexical, lexical.limit(0), k=POOL, at_most=POOL).select("chunk_id", "score")
    # POOL rows by construction.
    pool = chunks.join(F.broadcast(fused), chunks.id == fused.chunk_id).drop("id")
    return with_phrase_bonus(pool, query)


def phrase_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_candidates(spark, sf_dir, PHRASE)).select("chunk_id", "score")


def _collapsed(spark: SparkSession, sf_dir: str, per_page: int) -> DataFrame:
    kept = collapse(_candidates(spark, sf_dir, PHRASE), K, per_page)
    return _scored(kept).select("chunk_id", "path", "score", "chunks_matched")


def collapse_per_page_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir, 0)


def collapse_per_page_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir, 1)


def collapse_per_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir, 2)


# --- whole engine -------------------------------------------------------------


def _engine(spark: SparkSession, sf_dir: str, **settings) -> SearchEngine:
    cfg = Config(lexical_only=True, **settings)
    engine = SearchEngine.from_documents(document_files(spark, sf_dir), cfg)
    # The vector of a document stands for its first chunk.
    number = F.regexp_extract("path", "([0-9]+)[.]md$", 1).cast("long")
    first = engine.chunks.groupBy(number.alias("vec_id")).agg(F.min("id").alias("chunk_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    engine.use_vectors(vectors.join(first, "vec_id").select("chunk_id", "embedding"))
    return engine


def _hit_rows(hits: DataFrame) -> DataFrame:
    flat = hits.withColumn("headings", X.heading_line("heading_path")).drop("heading_path")
    return _scored(flat)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked documents, lexical + dense lists, bonus, collapse, snippets."""
    vector = _query_vector(_vectors(spark, sf_dir))
    engine = _engine(spark, sf_dir, stem=False, per_page=2)
    return _hit_rows(engine.search(PHRASE, K, query_vector=vector))


def hybrid_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = _query_vector(_vectors(spark, sf_dir))
    return _hit_rows(_engine(spark, sf_dir).search(QUERY, K, query_vector=vector))


def hybrid_search_large_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 800 chunks, fetched by the same plan as a small one."""
    vector = _query_vector(_vectors(spark, sf_dir))
    engine = _engine(spark, sf_dir, stem=False, per_page=2)
    return _hit_rows(engine.search(PHRASE, LARGE_K, query_vector=vector))


def _two_roots(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """Documents and turns as two roots that have some relative paths in common."""
    name = F.col("doc_id").cast("string")
    same = F.format_string("conv-%s/turn-0.md", name)
    path = F.when(F.col("doc_id") < 100, same).otherwise(_file_path())
    docs = documents_from_table(_documents(spark, sf_dir), path, F.col("text"), F.lit("docs"))
    path = F.format_string("conv-%d/turn-%d.md", "conv_id", "turn")
    turns = table(spark, sf_dir, "conversations")
    talk = documents_from_table(turns, path, F.col("text"), F.lit("talk"))
    cfg = Config(lexical_only=True, stem=False, per_page=2)
    return SearchEngine.from_documents(docs.unionByName(talk), cfg)


def two_roots_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal paths under two roots are one document when hits are collapsed."""
    return _hit_rows(_two_roots(spark, sf_dir).search(TWO_ROOTS_QUERY, LARGE_K))


def two_roots_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of a path that both roots have, and the counts of files and chunks."""
    engine = _two_roots(spark, sf_dir)
    stats = engine.stats()
    return local_rows(
        spark,
        path=[SHARED_PATH],
        text=[engine.get_document(SHARED_PATH)],
        files=[stats["files"]],
        chunks=[stats["chunks"]],
    )


# --- lookups ------------------------------------------------------------------


def get_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(document_chunks(spark, sf_dir).lookup([ONE_CHUNK]))


def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of one document, as the engine's lookup returns it."""
    text = document_text(document_chunks(spark, sf_dir), ONE_PATH)
    return local_rows(spark, path=[ONE_PATH], text=[text])


def documents_as_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_parts(row_chunks(spark, sf_dir))


# --- embedding cache ----------------------------------------------------------


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), X.text_hash("text").alias("text_hash")
    )


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a cache of the documents with the same id."""
    return _hashed(spark, sf_dir).join(_vectors(spark, sf_dir), "chunk_id").select(
        "text_hash", F.size("embedding").alias("dim"), "embedding"
    )


def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_counts(copies_per_text(_hashed(spark, sf_dir)), _cached(spark, sf_dir))


def cache_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = materialize(_hashed(spark, sf_dir), "hashes")
    copies = materialize(copies_per_text(hashed), "copies")
    found = attach_vectors(hashed, copies, _cached(spark, sf_dir), hashed.count())
    return found.select(
        "chunk_id",
        F.size("embedding").cast("long").alias("dim"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
        F.round(F.get("embedding", F.size("embedding") - 1).cast("double"), 6).alias("last"),
    )


def cache_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors, and the same with one vector spoilt in each of three ways."""
    cached = materialize(_cached(spark, sf_dir), "cached")
    least = cached.agg(F.min("text_hash").alias("h")).first().h
    one = F.col("text_hash") == least
    spoilt = {
        "given": F.col("embedding"),
        "shorter": F.slice("embedding", 1, F.size("embedding") - 1),
        "not finite": F.transform("embedding", lambda x: (x * F.lit(float("nan"))).cast("float")),
        "null": F.lit(None).cast("array<float>"),
    }
    found = [
        is_consistent(cached.withColumn("embedding", F.when(one, new).otherwise(F.col("embedding"))))
        for new in spoilt.values()
    ]
    return local_rows(spark, case=list(spoilt), consistent=found)


def cache_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of a cache: odd documents' vectors are written again, negated."""
    hashed = materialize(_hashed(spark, sf_dir), "hashes")
    rows = hashed.join(_vectors(spark, sf_dir), "chunk_id").withColumn("dim", F.size("embedding"))
    cache = EmbeddingCache(spark, table_path(spark, "cache"))
    cache.save(rows)
    negated = F.transform("embedding", lambda x: -x)
    cache.save(rows.where(F.col("chunk_id") % 2 == 1).withColumn("embedding", negated))
    found = attach_vectors(hashed, copies_per_text(hashed), cache.load(), hashed.count())
    first = F.get("embedding", F.lit(0)).cast("double")
    return found.select("chunk_id", F.round(first, 6).alias("first"))


def cache_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations merged into one, and a fourth after it: the last one counts."""
    hashed = materialize(_hashed(spark, sf_dir), "hashes")
    rows = hashed.join(_vectors(spark, sf_dir), "chunk_id").withColumn("dim", F.size("embedding"))
    cache = EmbeddingCache(spark, table_path(spark, "cache"))
    for step, factor in ((1, 1), (2, -1), (3, 2), (5, 4)):
        if step == 5:
            cache.merge()
        scale = F.lit(factor)
        scaled = F.transform("embedding", lambda x: (x * scale).cast("float"))  # noqa: B023
        cache.save(rows.where(F.col("chunk_id") % step == 0).withColumn("embedding", scaled))
    found = attach_vectors(hashed, copies_per_text(hashed), cache.load(), hashed.count())
    first = F.get("embedding", F.lit(0)).cast("double")
    return found.select(
        "chunk_id",
        F.round(first, 6).alias("first"),
        F.lit(len(cache.manifests())).cast("long").alias("generations"),
    )


class LetterCounts:
    """An embedder that SQL can repeat: text length and number of ``e``."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in texts]


def embed_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through the cache, which holds every third document as (-1, id)."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    known = docs.where(F.col("chunk_id") % 3 == 0).select(
        X.text_hash("text").alias("text_hash"),
        F.lit(2).alias("dim"),
        F.array(F.lit(-1.0), F.col("chunk_id").cast("double")).cast("array<float>").alias("embedding"),
    )
    found = get_or_embed(docs, known, LetterCounts()).vectors
    at = [F.get("embedding", F.lit(i)).cast("double") for i in (0, 1)]
    return found.select("chunk_id", at[0].alias("first"), at[1].alias("second"))


QUERIES = {
    query.__name__: query
    for query in (
        token_counts, stemmed_terms, identifier_parts, alphabetic_words, snippets, indexable_texts,
        ignore_filter, path_order, chunk_oversize, chunk_headings, chunk_fences, corpus_scan,
        bm25_postings, term_df_idf, doc_len_stats, index_stats, index_stats_dense,
        bm25_topk, bm25_inverted_topk, bm25_block_max, bm25_block_max_hot_only, bm25_repeated_term, bm25_heading_boost, bm25_stemmed,
        l2_normalized, cosine_topk, cosine_topk_clustered, rrf_fuse, rrf_weighted, phrase_bonus,
        collapse_per_page_0, collapse_per_page_1, collapse_per_page_2,
        hybrid_search, hybrid_search_stemmed, hybrid_search_large_k,
        two_roots_search, two_roots_lookup, get_chunk, get_document, documents_as_parts,
        cache_hits_misses, cache_vectors, cache_validation, cache_overwrite, cache_generations,
        embed_misses,
    )
}
