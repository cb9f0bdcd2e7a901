"""Plain SQL that gives what the registered queries must give, and the parameters that both sides share."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.entities import SKIP_WORDS

QUERY_TEXT, QUERY_VECTOR, RELATION = "thble thention innd and the delion", 7, "about"

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms(c: str) -> str:
    return f"list_filter(regexp_extract_all({_LOWER.format(c)}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: strlen(t) > 1)"


def _keywords(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_distinct(regexp_extract_all({_LOWER.format(c)}, '[0-9a-z]+')), lambda t: NOT list_contains([{stop}], t))"


def _jaccard(a: str, b: str) -> str:
    same = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {same}::DOUBLE / (len({a}) + len({b}) - {same}) END"


_Q = f"q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {QUERY_VECTOR})"
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
_NEAR = f"{_Q}, {_V}, d AS (SELECT vec_id, round(1 - list_dot_product(x, qv), 6) AS distance FROM v, q)"
_BATCH = f"""{_V}, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(1 - list_dot_product(a.x, b.x), 6) AS distance FROM v a JOIN v b ON a.vec_id % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p),
    top AS (SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 5)"""
_POSTINGS = f"""t AS (SELECT doc_id AS chunk_id, {_terms('text')} AS terms FROM documents),
    e AS (SELECT chunk_id, len(terms) AS length, unnest(terms) AS term FROM t),
    p AS (SELECT chunk_id, term, length, count(*) AS tf FROM e GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT chunk_id, length FROM p)),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))"


def _search(asked: str, k: int) -> str:
    return f"""{_POSTINGS}, asked AS ({asked}),
    qt AS (SELECT query_id, unnest(list_distinct({_terms('text')})) AS term FROM asked),
    s AS (SELECT query_id, chunk_id, round(sum({_WEIGHT}), 6) AS bm25 FROM qt JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id)::INTEGER AS rank FROM s),
    found AS (SELECT query_id, rank, chunk_id, bm25 FROM r WHERE rank <= {k})"""


_ONE = f"SELECT 0 AS query_id, '{QUERY_TEXT}' AS text"
_CHUNKS = "c AS (SELECT vec_id AS chunk_id, text, embedding::DOUBLE[] AS x, vec_id // 100 AS doc_id, vec_id % 100 AS page_number FROM embeddings JOIN documents ON vec_id = documents.doc_id)"


def _hybrid(score: str, places: int, k: int = 5, mode: str = "hybrid", page_index: bool = True, filter_mode: str = "") -> str:
    """CTEs that end in `best`: the ranked results of the shared query over `c`."""
    most = 3 * k
    postings = _POSTINGS.replace("documents", "c").replace("doc_id AS chunk_id", "chunk_id")
    allowed = ", ok AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1)" if filter_mode else ""
    pre = " WHERE chunk_id IN (SELECT id FROM ok)" if filter_mode == "pre" else ""
    post = " WHERE chunk_id IN (SELECT id FROM ok)" if filter_mode == "post" else ""
    lexical = f"UNION ALL SELECT w.chunk_id, round(1 - list_dot_product(c.x, qv), 6), 1, -bm25 FROM words w JOIN c USING (chunk_id), q WHERE w.chunk_id NOT IN (SELECT chunk_id FROM near)" if mode == "hybrid" else ""
    own = _keywords(f"'{QUERY_TEXT}'")
    proximity = "CASE WHEN doc_id = b_doc THEN 1.0 / (1 + abs(page_number - b_page)) ELSE 0.0 END" if page_index else "0.0"
    return f"""WITH {_CHUNKS}, {_Q}{allowed}, {postings},
    qt AS (SELECT unnest(list_distinct({_terms(f"'{QUERY_TEXT}'")})) AS term),
    s AS (SELECT chunk_id, round(sum({_WEIGHT}), 6) AS bm25 FROM qt JOIN p USING (term) JOIN f USING (term), n{pre} GROUP BY ALL),
    words AS (SELECT * FROM s ORDER BY bm25 DESC, chunk_id LIMIT {most}),
    near AS (SELECT chunk_id, round(1 - list_dot_product(x, qv), 6) AS distance FROM c, q{pre} ORDER BY distance, chunk_id LIMIT {most}),
    both_ AS (SELECT chunk_id, distance, 0 AS part, distance AS by_ FROM near {lexical}),
    placed AS (SELECT *, row_number() OVER (ORDER BY part, by_, chunk_id) AS cand_pos FROM both_),
    kept AS (SELECT * FROM placed JOIN c USING (chunk_id){post}),
    top AS (SELECT chunk_id AS b_id, doc_id AS b_doc, page_number AS b_page FROM kept ORDER BY distance, cand_pos LIMIT 1),
    sig AS (SELECT *, round(1 - distance, 6) AS cosine_score,
        round(CASE WHEN chunk_id = b_id THEN 1.0 ELSE {proximity} END, 6)::DOUBLE AS page_score,
        round({_jaccard('qk', 'ck')}, 6)::DOUBLE AS keyword_score FROM (SELECT *, {own} AS qk, {_keywords('text')} AS ck FROM kept, top)),
    ranks AS (SELECT *, row_number() OVER (ORDER BY cosine_score DESC, cand_pos) AS r1, row_number() OVER (ORDER BY page_score DESC, cand_pos) AS r2, row_number() OVER (ORDER BY keyword_score DESC, cand_pos) AS r3 FROM sig),
    scored AS (SELECT *, round({score}, {places})::DOUBLE AS score FROM ranks),
    best AS (SELECT *, row_number() OVER (ORDER BY score DESC, cand_pos)::INTEGER AS rank FROM scored ORDER BY score DESC, cand_pos LIMIT {k})"""


_LINEAR = "0.7::DOUBLE * cosine_score + 0.2::DOUBLE * page_score + 0.1::DOUBLE * keyword_score"
_RRF = "0.7::DOUBLE / (60 + r1) + 0.2::DOUBLE / (60 + r2) + 0.1::DOUBLE / (60 + r3)"
_SHOW = " SELECT rank, chunk_id, score, cosine_score, page_score, keyword_score, doc_id, page_number FROM best"
_ENTRIES = _hybrid(_LINEAR, 6, 8) + """,
    entries AS (SELECT rank, chunk_id, '[Page ' || page_number || '] ' || text || chr(10) || chr(10) AS entry FROM best),
    toks AS (SELECT *, floor(strlen(entry) / 3.5::DOUBLE)::BIGINT AS tokens FROM entries),
    run AS (SELECT *, sum(tokens) OVER (ORDER BY rank)::BIGINT AS total FROM toks)"""

_WINDOWS = """w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
    i AS (SELECT doc_id, words, unnest(range(0, len(words), 160)) AS pos FROM w),
    windows AS (SELECT doc_id, (pos // 160)::INTEGER AS chunk_index, array_to_string(words[pos + 1 : pos + 200], ' ') AS text FROM i)"""
_OBJECTS = "o AS (SELECT event_id AS id, event_type AS type_name, props, event_id AS sync_clock, event_type = 'error' AS is_deleted, user_id FROM events)"
_EDGES = "edges AS (SELECT 'placed_by' AS relation, o_orderkey AS from_id, o_custkey AS to_id FROM orders UNION ALL SELECT 'contains', l_orderkey, l_partkey FROM lineitem)"


def _names(source: str) -> str:
    """CTEs that end in `s`: chunk_id, entity, type, confidence of the entities of a table of chunk_id and text."""
    skip = ", ".join(f"'{w}'" for w in SKIP_WORDS)
    marks = "'^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$'"
    upper = lambda c: f"coalesce(regexp_matches({c}, '^[A-Z]'), false)"
    following = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, 5))
    run = "w"
    for i in range(4, 0, -1):
        run = f"CASE WHEN {upper(f'w{i}')} THEN ' ' || {'w' + str(i) if run == 'w' else f'w{i} || {run}'} ELSE '' END"
    return f"""sentences AS (SELECT chunk_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?]*[.!?]|[^.!?]+$')) AS sentence, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?]*[.!?]|[^.!?]+$'), 1) AS sn FROM {source}),
    toks AS (SELECT chunk_id, sn, unnest(regexp_extract_all(sentence, '[0-9A-Za-z''-]+')) AS w, generate_subscripts(regexp_extract_all(sentence, '[0-9A-Za-z''-]+'), 1) AS i FROM sentences),
    ahead AS (SELECT *, {following} FROM toks WINDOW o AS (PARTITION BY chunk_id, sn ORDER BY i)),
    runs AS (SELECT *, w || {run} AS run FROM ahead),
    offers AS (SELECT chunk_id, sn, i, 1 AS kind, run AS name, CASE WHEN contains(run, ' ') THEN 0.9 ELSE 0.75 END::DOUBLE AS sure FROM runs WHERE i > 1 AND {upper('w')} AND length(w) > 1
        UNION ALL SELECT chunk_id, sn, i, 2, w, 0.8::DOUBLE FROM runs WHERE regexp_matches(w, '^[A-Z0-9]{{2,}}$')),
    clean AS (SELECT * REPLACE (regexp_replace(lower(name), {marks}, '', 'g') AS name) FROM offers),
    met AS (SELECT chunk_id, name AS entity, arg_min(sure, (sn, i, kind)) AS first_, max(sure) FILTER (kind = 1) AS best_ FROM clean WHERE length(name) > 1 AND name NOT IN ({skip}) GROUP BY ALL),
    s AS (SELECT chunk_id, entity, 'PROPER_NOUN' AS type, greatest(first_, coalesce(best_, 0)) AS confidence FROM met
        QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY greatest(first_, coalesce(best_, 0)) DESC, entity) <= 20)"""


_SIMPLE = f"{_WINDOWS}, cut AS (SELECT doc_id * 1000 + chunk_index AS chunk_id, text FROM windows), {_names('cut')}"
_DOCUMENT = f"whole AS (SELECT doc_id AS chunk_id, text FROM documents), {_names('whole')}"
_PAIRS = "pairs AS (SELECT DISTINCT a.entity, b.entity AS other FROM s a JOIN s b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity)"
_LOG = "log AS (SELECT user_id AS id, 'd' || (event_id % 3) AS writer, event_id // 2 AS sync_clock, value::VARCHAR AS props, value, event_type = 'error' AS is_deleted FROM events)"
_REPLICAS = f"{_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY writer, id ORDER BY sync_clock DESC) AS k FROM log), rep AS (SELECT * FROM r WHERE k = 1)"
_WON = "SELECT id, sync_clock, writer, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sync_clock DESC, writer DESC) AS w FROM rep{0}) WHERE w = 1"
_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
_ACCENTED, _PLAIN = "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÇÑàáâãäåèéêëìíîïòóôõöùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn" * 2
#: Words of whole texts as sub-words of single letters: [CLS] 2, [SEP] 3, [UNK] 1, first letters from 4, later ones from 40.
_PIECES = f"""words AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(coalesce(text, ''), '[!-/:-@\\[-`{{-~]|[^ \\t\\n\\r!-/:-@\\[-`{{-~]+')) AS raw FROM documents),
    folded AS (SELECT chunk_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{_ACCENTED}', 'abcdefghijklmnopqrstuvwxyz{_PLAIN}') AS w FROM words),
    ids AS (SELECT chunk_id, unnest(CASE WHEN regexp_matches(w, '^[0-9a-z]+$') THEN list_transform(string_split(w, ''), lambda c, i: strpos('{_LETTERS}', c) + CASE WHEN i = 1 THEN 3 ELSE 39 END) ELSE [1] END) AS id FROM folded
        UNION ALL SELECT doc_id, unnest([2, 3]) FROM documents)"""
_HASHED = f"""{_PIECES}, counts AS (SELECT chunk_id, id, count(*) AS m FROM ids GROUP BY ALL), sizes AS (SELECT chunk_id, sum(m) AS n FROM counts GROUP BY ALL),
    grid AS (SELECT i.id, a.axis, (i.id * 2654435761 + a.axis * 40503)::UBIGINT AS h0 FROM range(1, 76) i(id), range(64) a(axis)),
    mixed AS (SELECT id, axis, ((xor(h0, h0 >> 16)) * 73244475)::UBIGINT AS h2 FROM grid),
    numbers AS (SELECT id, axis, ((xor(h2, h2 >> 16) & 65535)::DOUBLE - 32768) / 32768 AS x FROM mixed),
    mean AS (SELECT chunk_id, axis, sum(m * x) / max(n) AS v FROM counts JOIN sizes USING (chunk_id) JOIN numbers USING (id) GROUP BY ALL),
    unit AS (SELECT chunk_id, sqrt(sum(v * v)) AS len, max(v) FILTER (axis = 0) AS a, max(v) FILTER (axis = 63) AS z FROM mean GROUP BY ALL)"""

SQL = {
    "wordpiece_encode": f"WITH {_PIECES} SELECT chunk_id, count(*)::INTEGER AS n_ids, sum(id)::BIGINT AS id_sum FROM ids GROUP BY chunk_id",
    "hash_embed": f"""WITH {_HASHED} SELECT doc_id AS chunk_id, 1.0::DOUBLE AS norm, CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE round(a / len, 3) END::DOUBLE AS first,
        CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round(z / len, 3) END::DOUBLE AS last FROM documents JOIN unit ON doc_id = chunk_id""",
    "knn_exact": f"WITH {_NEAR} SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 10",
    "knn_batch": f"WITH {_BATCH} SELECT * FROM top",
    "knn_radius": f"WITH {_NEAR} SELECT vec_id, distance FROM d WHERE distance <= 0.6",
    "true_cosine_top": f"""WITH {_Q}, {_V} SELECT vec_id, round(list_dot_product(x, qv) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(qv, qv))), 6) AS cosine,
        round(greatest(-1, least(1, list_dot_product(x, qv))), 6) AS clamped FROM v, q ORDER BY cosine DESC, vec_id LIMIT 10""",
    "vector_norm_check": f"WITH {_V} SELECT count(*) AS n_vectors, count(*) FILTER (abs(sqrt(list_dot_product(x, x)) - 1) > 0.01) AS n_off FROM v",
    "l2_normalize": f"WITH {_V}, s AS (SELECT vec_id, list_transform(x, lambda y: y * 3.0) AS x FROM v), m AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM s) SELECT vec_id, round(sqrt(list_dot_product(x, x)) / n, 6) AS norm, round(x[1] / n, 6) AS first FROM m",
    "int8_quantize": f"""WITH {_V}, s AS (SELECT vec_id, x, list_max(list_transform(x, lambda y: abs(y))) / 127.0::DOUBLE AS scale FROM v),
        c AS (SELECT vec_id, scale, list_transform(x, lambda y: round(y / scale)::INTEGER) AS codes FROM s)
        SELECT vec_id, round(scale, 9) AS scale, list_sum(codes)::BIGINT AS code_sum, list_max(codes) AS code_max FROM c""",
    "int8_two_stage_knn": f"""WITH {_Q}, {_V}, s AS (SELECT vec_id, x, list_max(list_transform(x, lambda y: abs(y))) / 127.0::DOUBLE AS scale FROM v),
        c AS (SELECT vec_id, x, scale, list_transform(x, lambda y: round(y / scale)::DOUBLE) AS codes FROM s),
        k AS (SELECT scale AS qs, codes AS qc FROM c WHERE vec_id = {QUERY_VECTOR}),
        f AS (SELECT vec_id, x, round(1 - list_dot_product(codes, qc) * scale * qs, 6) AS rough FROM c, k ORDER BY rough, vec_id LIMIT 20)
        SELECT vec_id, round(1 - list_dot_product(x, qv), 6) AS distance FROM f, q ORDER BY distance, vec_id LIMIT 10""",
    "knn_difficulty_gap": f"WITH {_BATCH} SELECT query_id, round((max(distance) - min(distance)) / greatest(min(distance), 1e-6), 6) AS gap FROM top GROUP BY query_id",
    "term_frequencies": f"WITH {_POSTINGS} SELECT chunk_id, term, tf FROM p",
    "doc_lengths": f"WITH {_POSTINGS} SELECT DISTINCT chunk_id, length::BIGINT AS length FROM p",
    "bm25_idf": f"WITH {_POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, n",
    "bm25_search": f"WITH {_search('SELECT item_id AS query_id, text FROM benchmark', 10)} SELECT * FROM found",
    "bm25_normalized": f"WITH {_search(_ONE, 10)} SELECT rank, chunk_id, bm25, round(bm25 / greatest(1e-6, max(bm25) OVER ()), 6) AS score FROM found",
    "keyword_jaccard": f"SELECT doc_id AS chunk_id, round({_jaccard('qk', 'ck')}, 6)::DOUBLE AS keyword_score FROM (SELECT doc_id, {_keywords(chr(39) + QUERY_TEXT + chr(39))} AS qk, {_keywords('text')} AS ck FROM documents)",
    "token_estimates": "SELECT doc_id AS chunk_id, floor(strlen(coalesce(text, '')) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents",
    "chunk_words": f"WITH {_WINDOWS} SELECT * FROM windows",
    "chunk_words_min_len": f"WITH {_WINDOWS}, f AS (SELECT *, min(CASE WHEN length(text) < 400 THEN chunk_index END) OVER (PARTITION BY doc_id) AS stop FROM windows) SELECT doc_id, chunk_index, text FROM f WHERE stop IS NULL OR chunk_index < stop",
    "chunk_chars_budget": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
        u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        c AS (SELECT doc_id, i, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM u),
        p AS (SELECT doc_id, list(e ORDER BY i) AS ends FROM c GROUP BY doc_id),
        b AS (SELECT doc_id, 0 AS chunk_index, 0::BIGINT AS a, greatest(1, len(list_filter(ends, lambda x: x <= 500)))::BIGINT AS z FROM p
            UNION ALL SELECT doc_id, chunk_index + 1, s, greatest(z + 1, len(list_filter(ends, lambda x: x <= ends[s] + 500)))::BIGINT
            FROM (SELECT b.*, p.ends, z - greatest(1, (z - a) // 5) AS s FROM b JOIN p USING (doc_id) WHERE z < len(ends)))
        SELECT doc_id, chunk_index, array_to_string(words[a + 1 : z], ' ') AS text FROM b JOIN w USING (doc_id)""",
    "ingest_new_docs": f"WITH {_WINDOWS} SELECT doc_id, count(*) AS n_chunks FROM windows WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id",
    "hybrid_linear": _hybrid(_LINEAR, 6) + _SHOW,
    "hybrid_rrf": _hybrid(_RRF, 9) + _SHOW,
    "retrieval_raw": _hybrid("cosine_score", 6) + " SELECT rank, chunk_id, score, cosine_score, 0.0::DOUBLE AS page_score, 0.0::DOUBLE AS keyword_score, doc_id, page_number FROM best",
    "retrieval_bm25": _hybrid(_LINEAR, 6) + """, five AS (SELECT * FROM words ORDER BY bm25 DESC, chunk_id LIMIT 5),
        z AS (SELECT row_number() OVER (ORDER BY bm25 DESC, chunk_id)::INTEGER AS rank, chunk_id, round(bm25 / greatest(1e-6, max(bm25) OVER ()), 6) AS score FROM five)
        SELECT rank, chunk_id, score, 0.0::DOUBLE AS cosine_score, 0.0::DOUBLE AS page_score, score AS keyword_score, doc_id, page_number FROM z JOIN c USING (chunk_id)""",
    "hybrid_expanded": _hybrid(_LINEAR, 6) + ", " + _names("c").replace("    s AS (SELECT chunk_id, entity", "    ents AS (SELECT chunk_id, entity") + """,
        own AS (SELECT DISTINCT entity FROM ents WHERE chunk_id IN (SELECT chunk_id FROM best WHERE rank <= 3)),
        wanted AS (SELECT entity FROM own UNION SELECT entity FROM ents WHERE chunk_id IN (SELECT chunk_id FROM ents WHERE entity IN (SELECT entity FROM own))),
        m AS (SELECT chunk_id, count(*) AS matches FROM ents WHERE entity IN (SELECT entity FROM wanted) AND chunk_id NOT IN (SELECT chunk_id FROM best) GROUP BY chunk_id ORDER BY matches DESC, chunk_id LIMIT 5)
        SELECT rank, chunk_id, score, cosine_score, page_score, keyword_score, doc_id, page_number FROM best
        UNION ALL SELECT 5 + row_number() OVER (ORDER BY matches DESC, chunk_id)::INTEGER, chunk_id, 0, 0, 0, 0, doc_id, page_number FROM m JOIN c USING (chunk_id)""",
    "vector_only": _hybrid(_LINEAR, 6, mode="vector") + _SHOW,
    "hybrid_no_page": _hybrid(_LINEAR, 6, page_index=False) + _SHOW,
    "hybrid_filtered_post": _hybrid(_LINEAR, 6, filter_mode="post") + _SHOW,
    "hybrid_filtered_pre": _hybrid(_LINEAR, 6, filter_mode="pre") + _SHOW,
    "page_proximity": f"""WITH {_CHUNKS}, {_Q}, d AS (SELECT *, round(1 - list_dot_product(x, qv), 6) AS distance FROM c, q ORDER BY distance, chunk_id LIMIT 30),
        b AS (SELECT chunk_id AS b_id, doc_id AS b_doc, page_number AS b_page FROM d ORDER BY distance, chunk_id LIMIT 1)
        SELECT chunk_id, round(CASE WHEN chunk_id = b_id THEN 1.0 WHEN doc_id = b_doc THEN 1.0 / (1 + abs(page_number - b_page)) ELSE 0.0 END, 6)::DOUBLE AS page_score FROM d, b""",
    "context_budget": _ENTRIES + " SELECT rank, chunk_id, tokens, total, total <= 1500 AS fits FROM run",
    "context_string": _ENTRIES + """,
        used AS (SELECT coalesce(max(total) FILTER (total <= 1500), 0) AS used, count(*) FILTER (total > 1500) > 0 AS truncated, coalesce(string_agg(entry, '' ORDER BY rank) FILTER (total <= 1500), '') AS kept FROM run),
        nxt AS (SELECT entry FROM run WHERE total > 1500 ORDER BY rank LIMIT 1),
        sized AS (SELECT *, floor((1500 - used) * 3.5)::INTEGER AS size, (SELECT entry FROM nxt) AS nxt FROM used),
        cut AS (SELECT *, (SELECT coalesce(max(k), 0) FROM range(0, size + 1) r(k) WHERE strlen(left(nxt, k)) <= size) AS chars FROM sized),
        done AS (SELECT kept || CASE WHEN truncated THEN CASE WHEN 1500 - used > 10 AND size < strlen(nxt) THEN left(nxt, chars) ELSE '' END || chr(10) || '[Context truncated for length]' ELSE '' END AS context, truncated FROM cut)
        SELECT context, truncated, floor(strlen(context) / 3.5::DOUBLE)::BIGINT AS tokens FROM done""",
    "context_words_skip": _hybrid(_LINEAR, 6, 8).replace("WITH ", "WITH RECURSIVE ", 1) + """,
        sized AS (SELECT rank, score, text, len(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS words_ FROM best),
        walk AS (SELECT 0 AS pos, 0::BIGINT AS used, ''::VARCHAR AS line
            UNION ALL SELECT pos + 1, CASE WHEN used + words_ <= 1575 THEN used + words_ ELSE used END, CASE WHEN used + words_ <= 1575 THEN printf('[%d] (score: %.3f) ', rank, score) || text ELSE '' END FROM walk JOIN sized ON rank = pos + 1)
        SELECT trim(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (line <> ''), '')) AS context FROM walk""",
    "object_by_property": f"WITH {_OBJECTS} SELECT id, props FROM o WHERE NOT is_deleted AND type_name = 'click' AND props::JSON ->> '$.k' = '7'",
    "object_list_page": f"WITH {_OBJECTS} SELECT id, props FROM o WHERE NOT is_deleted AND type_name = 'click' ORDER BY id LIMIT 50 OFFSET 20",
    "object_counts": f"WITH {_OBJECTS} SELECT type_name, count(*) AS n FROM o WHERE NOT is_deleted GROUP BY type_name",
    "object_latest": f"WITH {_OBJECTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sync_clock DESC) AS k FROM o) SELECT user_id AS id, type_name, props, sync_clock, is_deleted FROM r WHERE k = 1",
    "object_upsert": f"""WITH {_OBJECTS} SELECT id, CASE WHEN is_deleted THEN '{{"k": -1}}' ELSE props END AS props, CASE WHEN is_deleted THEN sync_clock + 1 ELSE sync_clock END AS sync_clock, false AS is_deleted FROM o""",
    "property_index": f"WITH {_OBJECTS} SELECT type_name, 'k' AS key, props::JSON ->> '$.k' AS value, count(*) AS n, min(id) AS first_id FROM o WHERE NOT is_deleted GROUP BY ALL",
    "relation_targets": f"WITH {_EDGES} SELECT from_id, to_id FROM edges WHERE relation = 'contains' AND from_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "relation_sources": f"WITH {_EDGES} SELECT from_id, to_id FROM edges WHERE relation = 'placed_by' AND to_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "relation_edges_distinct": f"WITH {_EDGES} SELECT relation, count(*) AS n FROM (SELECT DISTINCT * FROM edges) GROUP BY relation",
    "relation_cascade_delete": f"""WITH {_EDGES}, gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT relation, count(*) AS n, sum(from_id)::BIGINT AS sum_from FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone) GROUP BY relation""",
    "relation_edges_removed": f"""WITH {_EDGES} SELECT relation, count(*) AS n, sum(to_id)::BIGINT AS sum_to FROM edges
        WHERE relation <> 'placed_by' OR from_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY relation""",
    "relation_two_hops": "SELECT r_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "entities_extracted": f"WITH {_DOCUMENT} SELECT chunk_id, entity, type, confidence FROM s",
    "graph_rrf": f"""WITH {_CHUNKS}, {_Q}, {_names('c')},
        near AS (SELECT *, round(1 - list_dot_product(x, qv), 6) AS distance FROM c, q ORDER BY distance, chunk_id LIMIT 200),
        placed AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS cand_pos FROM near),
        wanted AS (SELECT DISTINCT entity FROM s WHERE chunk_id IN (SELECT chunk_id FROM placed WHERE cand_pos <= 40)),
        ov AS (SELECT chunk_id, count(*) AS shared FROM s WHERE entity IN (SELECT entity FROM wanted) GROUP BY chunk_id),
        top AS (SELECT chunk_id AS b_id, doc_id AS b_doc, page_number AS b_page FROM placed WHERE cand_pos = 1),
        sig AS (SELECT *, round(1 - distance, 6) AS cosine_score,
            round(CASE WHEN chunk_id = b_id THEN 1.0 WHEN doc_id = b_doc THEN 1.0 / (1 + abs(page_number - b_page)) ELSE 0.0 END, 6)::DOUBLE AS page_score,
            round({_jaccard('qk', 'ck')}, 6)::DOUBLE AS keyword_score, coalesce(shared, 0) AS shared_
            FROM (SELECT *, {_keywords(chr(39) + QUERY_TEXT + chr(39))} AS qk, {_keywords('text')} AS ck FROM placed LEFT JOIN ov USING (chunk_id), top)),
        ranks AS (SELECT *, row_number() OVER (ORDER BY cosine_score DESC, cand_pos) AS r1, row_number() OVER (ORDER BY page_score DESC, cand_pos) AS r2, row_number() OVER (ORDER BY keyword_score DESC, cand_pos) AS r3, row_number() OVER (ORDER BY shared_ DESC, cand_pos) AS r4 FROM sig),
        scored AS (SELECT chunk_id, cand_pos, round({_RRF} + CASE WHEN shared_ > 0 THEN 0.1::DOUBLE / (60 + r4) ELSE 0 END, 9)::DOUBLE AS score FROM ranks)
        SELECT row_number() OVER (ORDER BY score DESC, cand_pos)::INTEGER AS rank, chunk_id, score FROM scored ORDER BY score DESC, cand_pos LIMIT 10""",
    "entity_chunks": f"WITH {_SIMPLE} SELECT entity, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM s GROUP BY entity",
    "entity_cooccurrence": f"WITH {_SIMPLE}, {_PAIRS} SELECT * FROM pairs",
    "entity_related_2hop": f"""WITH {_SIMPLE}, {_PAIRS}, start AS (SELECT DISTINCT entity FROM s WHERE chunk_id % 20 = 0),
        one AS (SELECT DISTINCT other AS entity FROM pairs JOIN start USING (entity) WHERE other NOT IN (SELECT entity FROM start)),
        two AS (SELECT DISTINCT other AS entity FROM pairs JOIN one USING (entity) WHERE other NOT IN (SELECT entity FROM start UNION SELECT entity FROM one))
        SELECT entity, 1::INTEGER AS depth FROM one UNION ALL SELECT entity, 2::INTEGER FROM two""",
    "kg_expand": f"""WITH {_DOCUMENT}, {_PAIRS}, {_search(_ONE, 5).replace(' s AS', ' sc AS').replace('FROM s)', 'FROM sc)')},
        own AS (SELECT DISTINCT entity FROM s WHERE chunk_id IN (SELECT chunk_id FROM found WHERE rank <= 3)),
        wanted AS (SELECT entity FROM own UNION SELECT other FROM pairs JOIN own USING (entity)),
        m AS (SELECT chunk_id, count(*) AS matches FROM s WHERE entity IN (SELECT entity FROM wanted) AND chunk_id NOT IN (SELECT chunk_id FROM found) GROUP BY chunk_id)
        SELECT row_number() OVER (ORDER BY matches DESC, chunk_id)::INTEGER AS rank, chunk_id, matches FROM m ORDER BY matches DESC, chunk_id LIMIT 5""",
    "entity_remove": f"WITH {_SIMPLE} SELECT entity, count(*) AS n_chunks FROM s WHERE chunk_id % 3 <> 0 GROUP BY entity",
    "sync_export_since": f"""WITH {_REPLICAS}, {_EDGES}, {_CHUNKS}
        SELECT 'record' AS kind, count(*) AS n FROM (SELECT 1 FROM rep WHERE writer = 'd0' AND sync_clock > 200) HAVING count(*) > 0
        UNION ALL SELECT 'edge', count(*) FROM edges UNION ALL SELECT 'chunk', count(*) FROM c WHERE chunk_id > 200 HAVING count(*) > 0 UNION ALL SELECT 'tombstone', 1""",
    "sync_lww_merge": f"WITH {_REPLICAS} " + _WON.format(""),
    "sync_idempotent": f"WITH {_REPLICAS} " + _WON.format("") + " AND false",
    "sync_conflict_stats": f"""WITH {_REPLICAS}, a AS (SELECT * FROM rep WHERE writer = 'd0'), b AS (SELECT * FROM rep WHERE writer = 'd1')
        SELECT count(*) FILTER (a.id IS NULL) AS inserted, count(*) FILTER (b.sync_clock > a.sync_clock) AS newer,
               count(*) FILTER (b.sync_clock = a.sync_clock AND b.writer > a.writer) AS ties_won,
               count(*) FILTER (b.sync_clock < a.sync_clock OR b.sync_clock = a.sync_clock AND b.writer <= a.writer) AS skipped FROM b LEFT JOIN a ON a.id = b.id""",
    "sync_tombstones": "SELECT doc_id AS chunk_id, doc_id % 10 AS sync_clock FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0 OR doc_id % 10 > 5",
    "sync_apply_deletes": """SELECT doc_id AS chunk_id, -1::BIGINT AS clock FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
        UNION ALL SELECT DISTINCT doc_id, doc_id FROM labels WHERE toxic = 1""",
    "sync_lamport": f"WITH {_LOG} SELECT writer AS device, max(sync_clock) AS clock FROM log GROUP BY writer UNION ALL SELECT 'all', max(sync_clock) FROM log",
    "delta_round_trip": f"WITH {_REPLICAS} SELECT id, sync_clock, writer, is_deleted FROM rep WHERE writer = 'd0' AND sync_clock > 100",
    "stream_lww": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sync_clock DESC, writer DESC) AS k FROM log) SELECT id AS record_id, sync_clock AS clock, writer AS device, value, is_deleted FROM r WHERE k = 1",
    "stream_tumbling_events": "SELECT (epoch(date_trunc('day', ts)))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding_events": """WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s, event_type, value FROM events)
        SELECT epoch(s)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""",
    "stream_session_events": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 12 HOURS) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}
