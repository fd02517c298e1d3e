"""DuckDB statements giving the results ``table_queries`` must reproduce.

Written against the tables alone: no Spark result feeds into them.
"""

from __future__ import annotations

from .porter_sql import stems
from .table_queries import (
    HEADING_QUERY,
    LARGE_K,
    ONE_CHUNK,
    ONE_PATH,
    PHRASE,
    POOL,
    QUERY,
    REPEATED_QUERY,
    SHARED_PATH,
    TWO_ROOTS_QUERY,
    WEIGHTED,
    K,
)

# DuckDB's pattern engine has no look-around; on the given text this finds the
# same words once trailing punctuation is cut.
_WORD = r"_*[\p{L}\p{N}][\p{L}\p{N}\p{M}_]*(?:[._:-]+[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*)*"
_TAIL = r"[^\p{L}\p{N}]+$"
_INTERNAL = r"[^\p{Pc}][_.:-]"
_SPACE = (
    r"\t\n\x{0b}\x{0c}\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _words(relation: str, keys: str, text: str) -> str:
    """(keys, w) rows: every word of a text column."""
    return f"""
      SELECT {keys}, w FROM (
        SELECT {keys}, regexp_replace(u, '{_TAIL}', '') AS w FROM (
          SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{_WORD}')) AS u
          FROM {relation}))
      WHERE w <> ''"""


def _tokens(relation: str, keys: str, text: str) -> str:
    """(keys, term) rows: words, and the parts of identifiers; one pass over the text."""
    return f"""
      SELECT {keys}, unnest(CASE WHEN regexp_matches(w, '{_INTERNAL}')
        THEN list_prepend(w, list_filter(string_split_regex(w, '[_.:-]+'), lambda p: p <> ''))
        ELSE [w] END) AS term
      FROM ({_words(relation, keys, text)})"""


_ROW_CHUNKS = """
  chunks AS (SELECT doc_id AS id, source AS path, text FROM documents)"""

_DOCUMENT_CHUNKS = rf"""
  files AS (
    SELECT source, doc_id, source || '/' || doc_id || '.md' AS path,
      CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2)
           ELSE string_split(text, chr(10)) END AS lines
    FROM documents),
  counted AS (
    SELECT *, list_transform(lines,
      lambda l: len(regexp_extract_all(l, '[^{_SPACE}]+'))) AS toks FROM files),
  summed AS (
    SELECT source, doc_id, path, lines, len(lines) AS n,
      list_transform(range(len(lines) + 1),
        lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(list_slice(toks, 1, i)) END)::BIGINT[] AS upto
    FROM counted),
  spans AS (
    SELECT doc_id, 0::BIGINT AS b,
      CASE WHEN upto[n + 1] <= 256 THEN n
           ELSE greatest(1, len(list_filter(upto, lambda c: c <= 256)) - 1) END::BIGINT AS e
    FROM summed
    UNION ALL
    SELECT doc_id, b, greatest(b + 1, len(list_filter(upto, lambda c: c <= upto[b + 1] + 256)) - 1)::BIGINT
    FROM (
      SELECT s.doc_id, upto,
        greatest(s.b + 1, len(list_filter(upto, lambda c: c <= upto[s.e + 1] - 32)) - 1)::BIGINT AS b
      FROM spans s JOIN summed USING (doc_id) WHERE s.e < n)),
  sliced AS (
    SELECT source, doc_id, path, b, list_slice(lines, b + 1, e) AS part,
      list_transform(list_slice(lines, b + 1, e),
        lambda l: NOT regexp_full_match(l, '[{_SPACE}]*')) AS solid
    FROM spans JOIN summed USING (doc_id)),
  edges AS (
    SELECT *, list_position(solid, true) AS f,
      len(solid) + 1 - list_position(list_reverse(solid), true) AS l
    FROM sliced WHERE list_contains(solid, true)),
  chunks AS (
    SELECT row_number() OVER (ORDER BY source, doc_id || '.md', b) - 1 AS id, path,
      '' AS headings, array_to_string(list_slice(part, f, l), chr(10)) AS text,
      b + f AS line_start, b + l AS line_end
    FROM edges)"""



def _markdown_chunks(files: str, budget: int = 256, overlap: int = 32) -> str:
    """Chunks of any markdown: ``files`` selects key, root, path and text.

    The fence state and the trail of headings are carried from line to line, the spans of
    a section from cut to cut; no cut but the last is inside a fence.
    """
    trimmed = f"regexp_replace(regexp_extract(line, '^[{_SPACE}]*#{{1,6}}(.*)$', 1, 's'), '^[{_SPACE}]+', '')"
    trimmed = f"regexp_replace(regexp_replace({trimmed}, '[{_SPACE}]+$', ''), '#+$', '')"
    trimmed = f"regexp_replace({trimmed}, '[{_SPACE}]+$', '')"
    return rf"""
  given AS (
    SELECT key, root, path,
      CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2)
           ELSE string_split(text, chr(10)) END AS lines
    FROM ({files})),
  scan AS (
    SELECT key, 0::BIGINT AS i, ''::VARCHAR AS line, '' AS marker, 0::BIGINT AS section,
      CAST([] AS STRUCT(level BIGINT, title VARCHAR)[]) AS trail
    FROM given
    UNION ALL
    SELECT key, i, line, after, section + CASE WHEN level > 0 THEN 1 ELSE 0 END,
      CASE WHEN level > 0 THEN list_concat(list_filter(trail, lambda h: h.level < level),
        [{{'level': level, 'title': {trimmed}}}]) ELSE trail END
    FROM (
      SELECT *, CASE WHEN marker = '' AND after = ''
        THEN length(regexp_extract(line, '^[{_SPACE}]*(#{{1,6}})(?:[{_SPACE}]|$)', 1)) ELSE 0 END AS level
      FROM (
        SELECT *, CASE WHEN marker = '' THEN run
          WHEN run <> '' AND starts_with(run, marker)
            AND regexp_full_match(line, '[{_SPACE}]*(?:`+|~+)[{_SPACE}]*') THEN ''
          ELSE marker END AS after
        FROM (
          SELECT s.key, s.i + 1 AS i, lines[s.i + 1] AS line, marker, section, trail,
            regexp_extract(lines[s.i + 1], '^[{_SPACE}]*(`{{3,}}|~{{3,}})', 1) AS run
          FROM scan s JOIN given USING (key) WHERE s.i < len(lines))))),
  parts AS (
    SELECT key, section, min(i) - 1 AS first, count(*) AS n, any_value(trail) AS trail,
      list(line ORDER BY i) AS lines, list(marker <> '' ORDER BY i) AS opened,
      list(len(regexp_extract_all(line, '[^{_SPACE}]+')) ORDER BY i) AS toks
    FROM scan WHERE i > 0 GROUP BY key, section),
  summed AS (
    SELECT *, list_transform(range(n + 1),
        lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(list_slice(toks, 1, i)) END)::BIGINT[] AS upto,
      list_filter(range(1, n + 1), lambda p: p = n OR NOT opened[p]) AS cuts
    FROM parts),
  spans AS (
    SELECT key, section, 0::BIGINT AS b,
      CASE WHEN upto[n + 1] <= {budget} THEN n
        ELSE list_min(list_filter(cuts, lambda p:
          p >= greatest(1, len(list_filter(upto, lambda c: c <= {budget})) - 1))) END::BIGINT AS e
    FROM summed
    UNION ALL
    SELECT key, section, b, list_min(list_filter(cuts, lambda p:
      p >= greatest(b + 1, len(list_filter(upto, lambda c: c <= upto[b + 1] + {budget})) - 1)))::BIGINT
    FROM (
      SELECT s.key, s.section, upto, cuts,
        greatest(s.b + 1, len(list_filter(upto, lambda c: c <= upto[s.e + 1] - {overlap})) - 1)::BIGINT AS b
      FROM spans s JOIN summed USING (key, section) WHERE s.e < n)),
  edges AS (
    SELECT *, list_position(solid, true) AS f, len(solid) + 1 - list_position(list_reverse(solid), true) AS l
    FROM (
      SELECT key, section, b, first, trail, list_slice(lines, b + 1, e) AS part,
        list_transform(list_slice(lines, b + 1, e),
          lambda l: NOT regexp_full_match(l, '[{_SPACE}]*')) AS solid
      FROM spans JOIN summed USING (key, section))
    WHERE list_contains(solid, true)),
  chunks AS (
    SELECT row_number() OVER (ORDER BY root, string_split(path, '/'), section, b) - 1 AS id, path,
      array_to_string(list_transform(trail, lambda h: h.title), ' > ') AS headings,
      array_to_string(list_slice(part, f, l), chr(10)) AS text,
      first + b + f AS line_start, first + b + l AS line_end
    FROM edges JOIN given USING (key))"""


_BODY = "replace(text, '. ', '.' || chr(10))"
_FENCED_CHUNKS = _markdown_chunks(
    f"""
    SELECT row_number() OVER () AS key, 'conversations' AS root,
      'conv-' || conv_id || '/turn-' || turn || '.md' AS path,
      'before ' || role || chr(10) || '# conv ' || conv_id
        || E'\n```py\n# no heading\n~~~\nstill open here\n````\n' || {_BODY}
        || E'\n### deep C#  ##\n~~~~ x\n```\n~~~\n' || {_BODY} || E'\n~~~~~\n\n \n' || {_BODY}
        || E'\n####### seven\n#### ' || role || E'\n\n' || {_BODY} || E'\n## back\n'
        || CASE WHEN turn % 2 = 1 THEN E'```\nto the end\n# not a heading\n' ELSE '' END
        || {_BODY} || chr(10) AS text
    FROM conversations""",
    12,
    4,
)
_TWO_ROOTS_CHUNKS = _markdown_chunks(
    """
    SELECT doc_id AS key, 'docs' AS root, CASE WHEN doc_id < 100 THEN 'conv-' || doc_id || '/turn-0.md'
      ELSE source || '/' || doc_id || '.md' END AS path, text
    FROM documents
    UNION ALL
    SELECT -1 - row_number() OVER (), 'talk', 'conv-' || conv_id || '/turn-' || turn || '.md', text
    FROM conversations"""
)

_CONVERSATION_CHUNKS = rf"""
  turns AS (
    SELECT 'conv-' || conv_id AS folder, 'turn-' || turn || '.md' AS file, turn, conv_id, role,
      regexp_replace(text, '(?:\n[{_SPACE}]*)+$', '') AS body FROM conversations),
  sections AS (
    SELECT folder, file, 0 AS seq, ['conv ' || conv_id] AS trail,
      format(E'# conv {{}}\n\n```\n# code {{}}\n```', conv_id, turn) AS text,
      1 AS line_start, 5 AS line_end
    FROM turns
    UNION ALL
    SELECT folder, file, 1, ['conv ' || conv_id, 'turn ' || turn || ' ' || role],
      '## turn ' || turn || ' ' || role
        || CASE WHEN regexp_full_match(body, '[{_SPACE}]*') THEN '' ELSE chr(10) || body END,
      6, 6 + CASE WHEN regexp_full_match(body, '[{_SPACE}]*') THEN 0
                  ELSE len(string_split(body, chr(10))) END
    FROM turns),
  chunks AS (
    SELECT row_number() OVER (ORDER BY folder, file, seq) - 1 AS id, folder || '/' || file AS path,
      trail, array_to_string(trail, ' > ') AS headings, text, line_start, line_end
    FROM sections)"""

_BODY_POSTINGS = f"""
  posted AS (
    SELECT id, term, count(*)::DOUBLE AS tf FROM ({_tokens('chunks', 'id', 'text')})
    GROUP BY id, term)"""

def _stemmed_postings(query: str) -> str:
    return f"""
  counted_tokens AS MATERIALIZED (
    SELECT id, term, count(*) AS c FROM ({_tokens('chunks', 'id', 'text')}) GROUP BY id, term),
  vocabulary AS (
    SELECT term FROM counted_tokens UNION SELECT term FROM ({_query_tokens(query)})),{stems('vocabulary')},
  posted AS (
    SELECT id, stem AS term, sum(c)::DOUBLE AS tf FROM counted_tokens JOIN stems USING (term)
    GROUP BY id, stem)"""


_HEADING_POSTINGS = f"""
  headed AS (SELECT id, unnest(trail) AS title FROM chunks),
  posted AS (
    SELECT id, term, sum(w)::DOUBLE AS tf FROM (
      SELECT id, term, 1.0 AS w FROM ({_tokens('chunks', 'id', 'text')})
      UNION ALL
      SELECT id, term, 2.0 AS w FROM ({_tokens('headed', 'id', 'title')}))
    GROUP BY id, term)"""

_LENGTHS = """
  lengths AS (
    SELECT c.id, coalesce(sum(p.tf), 0) AS dl FROM chunks c LEFT JOIN posted p USING (id)
    GROUP BY c.id),
  corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM lengths)"""


def _lexical(query: str, pool: int = POOL, stemmed: bool = False) -> str:
    """``lexical``: the pool of (chunk_id, score) of a query."""
    found = _query_tokens(query)
    if stemmed:
        found = f"SELECT stem AS term FROM ({found}) q JOIN stems USING (term)"
    return f"""
  wanted AS (SELECT term, count(*) AS qtf FROM ({found}) GROUP BY term),
  frequency AS (SELECT term, count(*) AS df FROM posted SEMI JOIN wanted USING (term) GROUP BY term),
  lexical AS (
    SELECT id AS chunk_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
    FROM posted JOIN wanted USING (term) JOIN frequency USING (term)
      JOIN lengths USING (id), corpus
    GROUP BY id ORDER BY score DESC, chunk_id LIMIT {pool})"""


def _query_tokens(query: str) -> str:
    return _tokens(f"(SELECT 0 AS one, '{query}' AS q)", "one", "q")


def _dense(pool: int = POOL) -> str:
    return f"""
  probe AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
  dense AS (
    SELECT vec_id AS chunk_id,
      round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[])
        / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS score
    FROM embeddings, probe ORDER BY score DESC, chunk_id LIMIT {pool})"""

_DENSE_BY_DOCUMENT = """
  first_chunks AS (
    SELECT regexp_extract(path, '([0-9]+)[.]md$', 1)::BIGINT AS doc_id, min(id) AS id
    FROM chunks GROUP BY 1),
  probe AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
  dense AS (
    SELECT first_chunks.id AS chunk_id,
      round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[])
        / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS score
    FROM embeddings JOIN first_chunks ON doc_id = vec_id, probe
    ORDER BY score DESC, chunk_id LIMIT {pool})"""

_NO_DENSE = """
  dense AS (SELECT 0::BIGINT AS chunk_id, 0.0::DOUBLE AS score WHERE false)"""


def _fused(lexical_weight: float = 1.0, dense_weight: float = 1.0, pool: int = POOL) -> str:
    return f"""
  lexical_ranked AS (
    SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM lexical),
  dense_ranked AS (
    SELECT chunk_id, score AS dense_score,
      row_number() OVER (ORDER BY score DESC, chunk_id) AS dense_rank FROM dense),
  fused AS (
    SELECT chunk_id, lexical_rank, dense_rank,
      coalesce({lexical_weight}::DOUBLE / (60 + lexical_rank), 0)
        + coalesce({dense_weight}::DOUBLE / (60 + dense_rank), 0) AS score
    FROM lexical_ranked FULL JOIN dense_ranked USING (chunk_id)
    ORDER BY score DESC, dense_score DESC NULLS LAST, chunk_id LIMIT {pool})"""


def _bonus(query: str) -> str:
    return f"""
  candidates AS (
    SELECT f.chunk_id, c.* EXCLUDE (id),
      f.score + CASE WHEN contains(lower(c.text), lower('{query}')) THEN 0.02 ELSE 0 END AS score
    FROM fused f JOIN chunks c ON c.id = f.chunk_id)"""


def _collapsed(per_page: int, k: int = K) -> str:
    keep = (
        f"r <= {k}"
        if per_page == 0
        else f"in_path <= {per_page} AND (cut IS NULL OR r < cut)"
    )
    return f"""
  ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM candidates),
  placed AS (
    SELECT *, min(r) OVER (PARTITION BY path) AS first_r,
      row_number() OVER (PARTITION BY path ORDER BY r) AS in_path,
      count(*) OVER (PARTITION BY path) AS chunks_matched FROM ordered),
  stop AS (
    SELECT min(first_r) AS cut FROM (
      SELECT first_r, dense_rank() OVER (ORDER BY first_r) AS ord FROM placed)
    WHERE ord = {k + 1}),
  kept AS (SELECT * FROM placed, stop WHERE {keep})"""


def _with(*parts: str) -> str:
    recursive = "RECURSIVE " if any("FROM spans s" in p for p in parts) else ""
    return f"WITH {recursive}" + ",".join(parts) + "\n"


def _candidate_parts() -> tuple[str, ...]:
    return (_ROW_CHUNKS, _BODY_POSTINGS, _LENGTHS, _lexical(PHRASE), _NO_DENSE, _fused(), _bonus(PHRASE))


def _top(chunks: str, posted: str, query: str) -> str:
    return (
        _with(chunks, posted, _LENGTHS, _lexical(query))
        + "SELECT chunk_id, round(score, 6) AS score FROM lexical"
    )


_FUSED_OUT = "SELECT chunk_id, round(score, 6) AS score, lexical_rank, dense_rank FROM fused"
_CHUNK_OUT = "SELECT id, path, headings, text, line_start, line_end FROM chunks"
_KEPT_OUT = "SELECT chunk_id, path, round(score, 6) AS score, chunks_matched FROM kept"
_SNIPPET = "CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS snippet"

_HASHED = """
  hashed AS (SELECT doc_id AS chunk_id, sha256(text) AS text_hash FROM documents),
  cached AS (
    SELECT text_hash, max(embedding) AS embedding FROM hashed
    JOIN embeddings ON vec_id = chunk_id GROUP BY text_hash)"""



def _hybrid(k: int, pool: int, query: str = PHRASE, per_page: int = 2, stemmed: bool = False) -> str:
    return (
        _with(
            _DOCUMENT_CHUNKS,
            _stemmed_postings(query) if stemmed else _BODY_POSTINGS,
            _LENGTHS,
            _lexical(query, pool, stemmed),
            _DENSE_BY_DOCUMENT.format(pool=pool),
            _fused(pool=pool),
            _bonus(query),
            _collapsed(per_page, k),
        )
        + f"""SELECT chunk_id, path, headings, line_start, line_end, round(score, 6) AS score,
        {_SNIPPET}, chunks_matched FROM kept"""
    )


def _index_stats(dense: str) -> str:
    return (
        _with(_DOCUMENT_CHUNKS)
        + f"""SELECT (SELECT count(DISTINCT path) FROM chunks) AS files,
        (SELECT count(*) FROM chunks) AS chunks,
        (SELECT count(DISTINCT term) FROM ({_tokens('chunks', 'id', 'text')})) AS lexical_terms,
        {dense}"""
    )


ORACLES = {
    "token_counts": f"""
      SELECT term, count(*) AS n FROM ({_tokens('documents', 'doc_id', 'text')}) GROUP BY term""",
    "identifier_parts": f"""
      SELECT doc_id, word, part, count(*) AS n FROM (
        SELECT doc_id, w AS word, unnest(string_split_regex(w, '[_.:-]+')) AS part
        FROM ({_words('documents', 'doc_id', 'text')}) WHERE regexp_matches(w, '{_INTERNAL}'))
      WHERE part <> '' GROUP BY doc_id, word, part""",
    "alphabetic_words": rf"""
      SELECT doc_id, count(w) AS n_words,
        count(w) FILTER (WHERE regexp_full_match(w, '\p{{L}}+')) AS n_alphabetic
      FROM (SELECT doc_id FROM documents)
        LEFT JOIN ({_words('documents', 'doc_id', 'text')}) USING (doc_id)
      GROUP BY doc_id""",
    "snippets": f"SELECT doc_id, {_SNIPPET} FROM documents",
    "indexable_texts": """
      SELECT conv_id, turn, CASE WHEN turn > 0
        THEN 'conv ' || conv_id || ' > ' || role || chr(10) || text ELSE text END AS indexable
      FROM conversations""",
    "ignore_filter": r"""
      SELECT path FROM (SELECT source || '/' || doc_id || '.md' AS path FROM documents)
      WHERE NOT regexp_full_match(path,
        '(?s)src1/.*|.*7\.md|src(2|3)/[0-4].*\.md|(.*/)?.\.md')""",
    "path_order": """
      SELECT path, row_number() OVER (ORDER BY string_split(path, '/'), doc_id) AS position FROM (
        SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '-' END || doc_id || '.md' AS path
        FROM documents)""",
    "chunk_oversize": _with(_DOCUMENT_CHUNKS) + _CHUNK_OUT,
    "chunk_headings": _with(_CONVERSATION_CHUNKS) + _CHUNK_OUT,
    "chunk_fences": _with(_FENCED_CHUNKS) + _CHUNK_OUT,
    "corpus_scan": """
      WITH named AS (
        SELECT 0 AS root_number, doc_id % 10 AS kind, coalesce(text, '') AS text,
          CASE doc_id % 10 WHEN 6 THEN 'shared' ELSE source END || '/' || doc_id
            || CASE doc_id % 10 WHEN 4 THEN '.mdx' ELSE '.md' END AS path
        FROM documents
        UNION ALL
        SELECT 2, 9, coalesce(text, ''), CASE turn WHEN 0 THEN 'shared/' || conv_id || '.md'
          ELSE 'talk/' || conv_id || '/' || turn || '.markdown' END
        FROM conversations)
      SELECT root_number, path, strlen(text) AS bytes, md5(text) AS digest
      FROM named WHERE kind NOT IN (0, 1, 2, 3, 5)""",
    "bm25_postings": _with(_ROW_CHUNKS, _BODY_POSTINGS, _LENGTHS)
    + "SELECT term, id AS chunk_id, tf, dl AS doc_len FROM posted JOIN lengths USING (id)",
    "term_df_idf": _with(_ROW_CHUNKS, _BODY_POSTINGS)
    + """SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
      FROM (SELECT term, count(*) AS df FROM posted GROUP BY term),
        (SELECT count(*) AS n FROM chunks)""",
    "doc_len_stats": _with(_CONVERSATION_CHUNKS, _HEADING_POSTINGS, _LENGTHS)
    + "SELECT n_docs, round(avg_dl, 6) AS avg_doc_len FROM corpus",
    "index_stats": _index_stats("false AS dense, 0::BIGINT AS dim"),
    "index_stats_dense": _index_stats("true AS dense, 2::BIGINT AS dim"),
    "bm25_topk": _top(_ROW_CHUNKS, _BODY_POSTINGS, QUERY),
    "bm25_inverted_topk": _top(_ROW_CHUNKS, _BODY_POSTINGS, QUERY),
    "bm25_block_max": _top(_ROW_CHUNKS, _BODY_POSTINGS, QUERY),
    "bm25_block_max_hot_only": _top(_ROW_CHUNKS, _BODY_POSTINGS, REPEATED_QUERY),
    "bm25_repeated_term": _top(_ROW_CHUNKS, _BODY_POSTINGS, REPEATED_QUERY),
    "bm25_stemmed": _with(
        _ROW_CHUNKS, _stemmed_postings(QUERY), _LENGTHS, _lexical(QUERY, stemmed=True)
    )
    + "SELECT chunk_id, round(score, 6) AS score FROM lexical",
    "stemmed_terms": f"""
      WITH vocabulary AS (SELECT DISTINCT term FROM ({_tokens('documents', 'doc_id', 'text')})),
      {stems('vocabulary')}
      SELECT term, stem FROM stems""",
    "bm25_heading_boost": _top(_CONVERSATION_CHUNKS, _HEADING_POSTINGS, HEADING_QUERY),
    "l2_normalized": """
      SELECT vec_id, pos, 
        round((x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)))::FLOAT::DOUBLE, 5) + 0.0 AS x FROM (
        SELECT vec_id, unnest(range(len(embedding))) AS pos,
          (unnest(embedding) * (label + 2))::FLOAT::DOUBLE AS x FROM embeddings)""",
    "cosine_topk": _with(_dense()) + "SELECT chunk_id, round(score, 6) AS score FROM dense",
    "cosine_topk_clustered": _with(_dense()) + "SELECT chunk_id, round(score, 6) AS score FROM dense",
    "rrf_fuse": _with(
        _ROW_CHUNKS, _BODY_POSTINGS, _LENGTHS, _lexical(QUERY), _dense(), _fused()
    )
    + _FUSED_OUT,
    "rrf_weighted": _with(
        _ROW_CHUNKS,
        _BODY_POSTINGS,
        _LENGTHS,
        _lexical(QUERY),
        _dense(),
        _fused(WEIGHTED.lexical, WEIGHTED.dense),
    )
    + _FUSED_OUT,
    "phrase_bonus": _with(*_candidate_parts())
    + "SELECT chunk_id, round(score, 6) AS score FROM candidates",
    "collapse_per_page_0": _with(*_candidate_parts(), _collapsed(0)) + _KEPT_OUT,
    "collapse_per_page_1": _with(*_candidate_parts(), _collapsed(1)) + _KEPT_OUT,
    "collapse_per_page_2": _with(*_candidate_parts(), _collapsed(2)) + _KEPT_OUT,
    "hybrid_search": _hybrid(K, POOL),
    "hybrid_search_large_k": _hybrid(LARGE_K, 4 * LARGE_K),
    "hybrid_search_stemmed": _hybrid(K, POOL, QUERY, per_page=1, stemmed=True),
    "two_roots_search": _with(
        _TWO_ROOTS_CHUNKS,
        _BODY_POSTINGS,
        _LENGTHS,
        _lexical(TWO_ROOTS_QUERY, 4 * LARGE_K),
        _NO_DENSE,
        _fused(pool=4 * LARGE_K),
        _bonus(TWO_ROOTS_QUERY),
        _collapsed(2, LARGE_K),
    )
    + f"""SELECT chunk_id, path, headings, line_start, line_end, round(score, 6) AS score,
        {_SNIPPET}, chunks_matched FROM kept""",
    "two_roots_lookup": _with(_TWO_ROOTS_CHUNKS)
    + f"""SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY id) AS text,
        (SELECT count(DISTINCT path) FROM chunks) AS files, (SELECT count(*) FROM chunks) AS chunks
      FROM chunks WHERE path = '{SHARED_PATH}' GROUP BY path""",
    "get_chunk": _with(_DOCUMENT_CHUNKS) + _CHUNK_OUT + f" WHERE id = {ONE_CHUNK}",
    "get_document": _with(_DOCUMENT_CHUNKS)
    + f"""SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY id) AS text
      FROM chunks WHERE path = '{ONE_PATH}' GROUP BY path""",
    "documents_as_parts": """
      SELECT source AS path, doc_id AS id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source)
        THEN text ELSE chr(10) || chr(10) || text END AS part FROM documents""",
    "cache_hits_misses": _with(_HASHED)
    + """SELECT count(c.text_hash) AS hits, count(*) - count(c.text_hash) AS misses
      FROM hashed LEFT JOIN cached c USING (text_hash)""",
    "cache_vectors": _with(_HASHED)
    + """SELECT chunk_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) + 0.0 AS first,
        round(embedding[-1]::DOUBLE, 6) + 0.0 AS last FROM hashed JOIN cached USING (text_hash)""",
    "cache_validation": """
      WITH given AS (
        SELECT bool_and(len(embedding) = dim AND len(list_filter(embedding,
          lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS consistent
        FROM embeddings, (SELECT len(embedding) AS dim FROM embeddings LIMIT 1))
      SELECT 'given' AS "case", consistent FROM given
      UNION ALL SELECT unnest(['shorter', 'not finite', 'null']), false""",
    "cache_overwrite": """
      WITH rows AS (
        SELECT doc_id, sha256(text) AS h, embedding, vec_id % 2 = 1 AS again
        FROM documents JOIN embeddings ON vec_id = doc_id),
      written AS (
        SELECT h, 0 AS generation, embedding FROM rows
        UNION ALL
        SELECT h, 1, list_transform(embedding, lambda x: -x) FROM rows WHERE again),
      last AS (
        SELECT h, max(embedding) AS embedding FROM written JOIN (
          SELECT h, max(generation) AS generation FROM written GROUP BY h) USING (h, generation)
        GROUP BY h)
      SELECT doc_id AS chunk_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first
      FROM documents JOIN last ON h = sha256(text)""",
    "cache_generations": """
      WITH rows AS (
        SELECT doc_id, sha256(text) AS h, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
      written AS (
        SELECT h, step, list_transform(embedding, lambda x: (x * factor)::FLOAT) AS embedding
        FROM rows, (VALUES (1, 1), (2, -1), (3, 2), (5, 4)) steps(step, factor)
        WHERE doc_id % step = 0),
      last AS (
        SELECT h, max(embedding) AS embedding FROM written JOIN (
          SELECT h, max(step) AS step FROM written GROUP BY h) USING (h, step)
        GROUP BY h)
      SELECT doc_id AS chunk_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, 2::BIGINT AS generations
      FROM documents JOIN last ON h = sha256(text)""",
    "embed_misses": """
      WITH known AS (
        SELECT text, max(doc_id) AS id FROM documents WHERE doc_id % 3 = 0 GROUP BY text)
      SELECT doc_id AS chunk_id,
        CASE WHEN id IS NULL THEN length(d.text) ELSE -1 END::DOUBLE AS first,
        CASE WHEN id IS NULL THEN length(d.text) - length(replace(d.text, 'e', ''))
          ELSE id END::DOUBLE AS second
      FROM documents d LEFT JOIN known USING (text)""",
}
