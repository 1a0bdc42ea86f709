"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from lexispark.functions import text as T
from lexispark.operators import embed, learned
from lexispark.plans import queries as Q
from lexispark.plans import search
from lexispark.sources import tal

V = Q.VOCABULARY


def q(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) AS v({names}))"


def listed(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


TERMS = values([(q(t), q(w), str(e), str(k), q(V.entries[e].canonical_term), q(V.entries[e].category), listed(V.entries[e].capabilities)) for t, w, e, k in V.terms], "term, written, e, k, canonical, category, caps")
OWNER = values([(q(t), q(V.entries[e].canonical_term)) for t, e in V.owner.items()], "term, canonical")
DOMAIN = listed(V.domain_terms)
STOP = listed(T.STOPWORDS)


def matches(source: str, id: str) -> str:
    """(id, text, written, canonical, caps, category, s, n): the first match of each canonical term, s its place, n its rank in the text."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {id} ORDER BY s + length(term), -length(term), e, k) AS n FROM (
      SELECT d.{id}, d.text, t.*, instr(lower(d.text), t.term) - 1 AS s,
             row_number() OVER (PARTITION BY d.{id}, lower(t.canonical) ORDER BY instr(lower(d.text), t.term) - 1 + length(t.term), -length(t.term), t.e, t.k) AS rn
      FROM {source} d, {TERMS} t WHERE instr(lower(d.text), t.term) > 0) WHERE rn = 1)"""


CHUNKS = f"(SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS chunk_id, text, {' '.join(['CASE lang', *[f'WHEN {q(a)} THEN {q(b)}' for a, b in Q.KINDS.items()]])} ELSE 'document' END AS source_type, source || '/' || doc_id AS path FROM documents)"
POSTINGS = f"""(SELECT DISTINCT p.kind, p.key, p.chunk_id, c.source_type FROM {CHUNKS} c JOIN (
  SELECT 'concept' AS kind, lower(canonical) AS key, chunk_id FROM m UNION ALL SELECT 'category', category, chunk_id FROM m
  UNION ALL SELECT 'capability', unnest(caps), chunk_id FROM m UNION ALL SELECT 'source_type', source_type, chunk_id FROM {CHUNKS}) p USING (chunk_id))"""
WITH_POSTINGS = f"WITH m AS MATERIALIZED {matches(CHUNKS, 'chunk_id')}, p AS MATERIALIZED {POSTINGS}"

TOKENS = f"regexp_extract_all(lower(text), '{T.TOKEN}')"
_BLANK = "[\\s\\x1c-\\x1f\\x85\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def stem(w: str) -> str:
    cases = "".join(f" WHEN suffix({w}, {q(s)})" + (f" AND NOT suffix({w}, 'ss')" if s == "s" else "") + f" THEN left({w}, length({w}) - {len(s)})" for s in T.SUFFIXES)
    return f"CASE WHEN length({w}) <= 6 THEN {w}{cases} ELSE {w} END"


def pairs(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1])"


def boost(term: str, underscores: bool = False) -> str:
    more = f" OR list_contains({DOMAIN}, replace({term}, '_', ' '))" if underscores else ""
    return f"CASE WHEN list_contains({DOMAIN}, {term}){more} THEN 2.0 ELSE 1.0 END"


def normal(source: str, columns: str, digits: int) -> str:
    weight = f"round(CASE WHEN l > 0 THEN w / l ELSE w END, {digits})"  # a sum that cancels out may round to a negative zero here, but not in Spark
    return f"SELECT {columns}, CASE WHEN {weight} = 0 THEN 0 ELSE {weight} END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM ({source}))"


def hashed(n: int) -> str:
    return f"""SELECT doc_id, CAST(('0x' || right(md5(term), 7)) AS BIGINT) % {n} AS idx,
      sum(CASE WHEN CAST(('0x' || right(sha1(term), 1)) AS INT) % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(tf)) * {boost('term', True)}) AS w
      FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t || {pairs('t')}) AS term FROM
        (SELECT doc_id, list_filter({TOKENS}, lambda x: NOT list_contains({STOP}, x)) AS t FROM documents)) GROUP BY ALL) GROUP BY ALL"""


DIMS = values([(q(n), str(i)) for n, i in embed.ConceptEmbedder(V).dimensions.items()], "name, idx")
ACTIVE = f"""SELECT doc_id, name, idx, sum(w) AS w FROM (
  SELECT doc_id, lower(canonical) AS name, 1.0 AS w FROM m UNION ALL SELECT doc_id, lower(category), 0.3 FROM m
  UNION ALL SELECT doc_id, lower(unnest(caps)), 0.5 FROM m) JOIN {DIMS} d USING (name) GROUP BY ALL"""
WITH_DOCS = f"WITH m AS MATERIALIZED {matches('documents', 'doc_id')}"

_WEIGHTS = search.concept_weights(V, Q.QUERY)


def scored(extra: str = "", where: str = "TRUE") -> str:
    rows = [("'concept'", q(k), str(w)) for k, w in _WEIGHTS.items()] + ([("'capability'", q(extra), "0.5")] if extra else [])
    return f"(SELECT chunk_id, raw / max(raw) OVER () AS c FROM (SELECT chunk_id, sum(w) AS raw FROM p JOIN {values(rows, 'kind, key, w')} USING (kind, key) WHERE {where} GROUP BY chunk_id))"


_ASKED = listed([V.entries[e].canonical_term.lower() for _, e, _ in V.match(Q.QUERY)])
_LEVELS = "'ERROR','FATAL','CRITICAL'"
LINES = """(SELECT event_id + 1 AS line_number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' END AS level,
  'user-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS trace_id, CAST(floor(value) AS BIGINT) || '.00' AS amount,
  concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'warn' END, 'trace_id=user-' || lpad(CAST(user_id AS VARCHAR), 8, '0'), event_type,
  'amount: ' || CAST(floor(value) AS BIGINT) || '.00', 'error_code=E') AS message FROM events)"""
ENTRIES = f"(SELECT *, CASE WHEN level IS NOT NULL THEN level IN ({_LEVELS}) ELSE contains(lower(message), 'error') END AS is_error FROM {LINES})"


def traces(limit: int, more: str = "", by: str = "") -> str:
    return f"""(SELECT {by} trace_id, count(*) AS entry_count, min_by(timestamp, line_number) AS start_time, max_by(timestamp, line_number) AS end_time, bool_or(is_error) AS has_error,
      min(line_number) AS line_start, max(line_number) AS line_end, string_agg(message, chr(10) ORDER BY line_number) AS text, max_by(amount, line_number) AS last_amount
      FROM (SELECT *, row_number() OVER (PARTITION BY {by} trace_id ORDER BY line_number) AS rn FROM (SELECT *{more} FROM {ENTRIES})) WHERE rn <= {limit} GROUP BY {by} trace_id)"""




def literal(text: str) -> str:
    return " || chr(10) || ".join(map(q, text.split(chr(10))))


def chunked(source: str, size: int, overlap: int) -> str:
    """steps and pieces (key, i, chunk) of the texts (key, text) of ``source`` that are longer than ``size``: one window of the text at a time."""
    start, half = f"(CASE WHEN e = 0 THEN 0 ELSE e - {overlap} END)", size // 2
    ends = ", ".join(f"{size} - nullif(instr(reverse(substr(text, {start} + {half + 1}, {size - half})), {' || '.join('chr(10)' if c == chr(10) else q(c) for c in b[::-1])}), 0) + 1" for b in T.BREAKS)
    return f"""RECURSIVE steps(key, text, s, e) AS (
      SELECT key, text, 0, 0 FROM {source} WHERE length(text) > {size}
      UNION ALL SELECT key, text, {start}, CASE WHEN {start} + {size} < length(text) THEN {start} + coalesce({ends}, {size}) ELSE {start} + {size} END FROM steps WHERE {start} < length(text)),
    pieces AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS i, {strip('substr(text, s + 1, e - s)')} AS chunk FROM steps WHERE e > 0 AND {strip('substr(text, s + 1, e - s)')} <> '')"""


def ascii_words(x: str, letter: str) -> str:
    """Text with ``letter`` for each letter or digit that isn't ASCII, so that word boundaries, which are ASCII here, lie where they do in Unicode."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), '[^\\x00-\\x7F]', '{letter}', 'g')"


def heading(t: str) -> str:
    return f"""(length({t}) > 0 AND length({t}) < 100 AND NOT regexp_matches({t}, '[.,;:]$') AND (
        (upper({t}) = {t} AND lower({t}) <> {t}) OR regexp_matches({t}, '^\\d+\\.?\\s+\\w') OR regexp_matches({t}, '^[A-Z][a-z]+(\\s+[A-Z][a-z]+)*$') OR (regexp_matches({t}, '^[A-Z0-9\\s\\-:]+$') AND length({t}) < 80)))"""


#: Paragraphs, then the sections that headings divide them into; the numbers of sections count those that are left out later.
SECTIONS = f"""par AS (SELECT doc_id, n, {strip('p')} AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n+')) AS p, unnest(range(len(regexp_split_to_array(text, '\n\n+')))) AS n FROM documents)),
  g AS (SELECT doc_id, n, p, h, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM (SELECT *, NOT contains(p, chr(10)) AND {heading('p')} AS h FROM par WHERE p <> '')),
  sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS k, title, {strip('body')} AS text FROM (
    SELECT doc_id, g, max(p) FILTER (h) AS title, string_agg(p, chr(10) || chr(10) ORDER BY n) FILTER (NOT h) AS body FROM g GROUP BY ALL) WHERE body IS NOT NULL),
  long AS (SELECT doc_id || '/' || k AS key, text FROM sec WHERE length(text) > 1500)"""
CHUNKED = chunked("(SELECT doc_id AS key, text FROM documents)", 1200, 100)

def term_stats(digits: int) -> str:
    """Terms of one, two and three words with their statistics."""
    n_gram = lambda p: f"SELECT doc_id, regexp_split_to_array(unnest(regexp_extract_all(t, '{p[4:]}')), '\\s+') FROM l"
    return f"""l AS (SELECT doc_id, {ascii_words('lower(text)', 'Z')} AS t FROM documents),
      w AS (SELECT doc_id, [x] AS w FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{learned.UNIGRAM[4:]}', 1)) AS x FROM l) UNION ALL {n_gram(learned.BIGRAM)} UNION ALL {n_gram(learned.TRIGRAM)}),
      tf AS (SELECT doc_id, array_to_string(w, ' ') AS term, count(*) AS tf FROM w
        WHERE len(list_filter(w, lambda x: length(x) < 2 OR regexp_full_match(x, '[0-9]+') OR list_contains({listed(learned.STOPWORDS)}, x))) = 0 GROUP BY ALL),
      n AS (SELECT count(*) AS n FROM documents),
      stats AS MATERIALIZED (SELECT term, CAST(sum(tf) AS BIGINT) AS frequency, count(*) AS doc_frequency, round((1 + ln(sum(tf))) * ln(any_value(n) / (1 + count(*))), {digits}) AS tfidf
      FROM tf, n GROUP BY term HAVING sum(tf) >= 3 AND count(*) <= 0.8 * any_value(n)),
      top AS MATERIALIZED (SELECT term, frequency FROM stats ORDER BY tfidf DESC, term LIMIT 1000)"""


#: Where each term begins: splits leave the pieces between, whose lengths add up.
PLACES = f"""{term_stats(9)}, held AS MATERIALIZED (SELECT doc_id, term, string_split(lower(text), term) AS pieces FROM documents, top WHERE contains(lower(text), term)),
  o AS MATERIALIZED (SELECT doc_id, term, sum(length(piece) + length(term)) OVER (PARTITION BY doc_id, term ORDER BY n) - length(term) AS pos FROM (
  SELECT doc_id, term, unnest(pieces) AS piece, unnest(range(len(pieces))) AS n, len(pieces) AS k FROM held) WHERE n < k - 1)"""
PAIRS = """c AS (SELECT least(a.term, b.term) AS t1, greatest(a.term, b.term) AS t2, count(*) AS cnt FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.term <> b.term
  AND b.pos - a.pos BETWEEN 0 AND 50 AND (b.pos > a.pos OR a.term < b.term) GROUP BY ALL HAVING count(*) >= 2)"""

def told(most: int, least: float) -> str:
    """The context made of the best ``most`` results of ``least`` or more."""
    return f"""{WITH_POSTINGS}, top AS (SELECT *, row_number() OVER (ORDER BY round(c, 9) DESC, chunk_id) AS rank FROM {scored()} ORDER BY round(c, 9) DESC, chunk_id LIMIT {most}),
      x AS (SELECT rank, source_type, path, {strip('text')} AS body, 'Score: ' || printf('%.3f', c) AS score,
        'Concepts: ' || (SELECT array_to_string(list(DISTINCT canonical ORDER BY canonical)[1:5], ', ') FROM m WHERE m.chunk_id = top.chunk_id AND list_contains({_ASKED}, lower(canonical))) AS concepts,
        (SELECT flatten(list(caps ORDER BY n)) FROM m WHERE m.chunk_id = top.chunk_id) AS caps FROM top JOIN {CHUNKS} USING (chunk_id) WHERE c >= {least}),
      y AS (SELECT *, 'Capabilities: ' || nullif(array_to_string(list_filter(caps, lambda v, i: list_position(caps, v) = i)[1:5], ', '), '') AS capabilities FROM x),
      z AS (SELECT rank, source_type, CASE source_type WHEN 'code' THEN concat_ws(chr(10), chr(10) || '--- File: ' || path || ' ---', score, concepts, capabilities, chr(10) || '```', body, '```')
        WHEN 'document' THEN concat_ws(chr(10), chr(10) || '--- Document: ' || path || ' ---', score, concepts, '', body) ELSE concat_ws(chr(10), chr(10) || '--- Log: ' || path || ' ---', score, '', body) END AS said FROM y),
      w AS (SELECT concat_ws(chr(10), {', '.join(f"(SELECT {q(repeat)} || repeat('=', 60) || chr(10) || {q(title)} || chr(10) || repeat('=', 60) || chr(10) || string_agg(said, chr(10) ORDER BY rank) FROM z WHERE source_type = {q(kind)} HAVING count(*) > 0)" for kind, title, repeat in (('code', 'CODE ARTIFACTS', ''), ('document', 'DOCUMENTATION ARTIFACTS', chr(10)), ('log', 'LOG ARTIFACTS', chr(10))))}) AS context)
      SELECT md5(context) AS context_md5, length(context) AS n_chars FROM w"""


ORACLE_SQL = {
    "concept_match": f"""{WITH_DOCS} SELECT doc_id, count(m.n) AS n, coalesce(string_agg(canonical || ':' || written || ':' || s || ':' || (s + length(term)), '|' ORDER BY m.n), '') AS matches
      FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""",
    "concept_match_all": f"""SELECT canonical AS concept, written AS term, CAST(sum((length(l) - length(replace(l, term, ''))) // length(term)) AS BIGINT) AS n, count(*) AS docs
      FROM (SELECT lower(text) AS l FROM documents), {TERMS} t WHERE instr(l, term) > 0 GROUP BY t.e, t.k, canonical, written""",
    "concept_context": f"{WITH_DOCS} SELECT doc_id, canonical AS concept, substr(text, CAST(greatest(0, s - 50) AS BIGINT) + 1, CAST(s + length(term) + 50 - greatest(0, s - 50) AS BIGINT)) AS context FROM m",
    "keyword_lookup": f"SELECT doc_id, term, canonical AS concept, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) JOIN {OWNER} o USING (term) GROUP BY ALL",
    "concept_postings": f"{WITH_POSTINGS} SELECT kind, key, count(*) AS chunks FROM p GROUP BY ALL",
    "capability_counts": f"{WITH_POSTINGS} SELECT key AS capability, source_type, count(*) AS chunks FROM p WHERE kind = 'capability' GROUP BY ALL",
    "capability_search": f"{WITH_POSTINGS} SELECT chunk_id, source_type, 1.0::DOUBLE AS combined_score, 'concept' AS retrieval_method FROM p WHERE kind = 'capability' AND key = 'Screening' ORDER BY chunk_id LIMIT 20",
    "concept_search_topk": f"""{WITH_POSTINGS}, top AS (SELECT *, CAST(row_number() OVER (ORDER BY round(c, 9) DESC, chunk_id) AS INT) AS rank FROM {scored('Screening', "source_type IN ('document', 'log')")} ORDER BY round(c, 9) DESC, chunk_id LIMIT 25)
      SELECT rank, chunk_id, round(c, 6) AS concept_score, coalesce((SELECT string_agg(DISTINCT canonical, ',' ORDER BY canonical) FROM m WHERE m.chunk_id = top.chunk_id AND list_contains({_ASKED}, lower(canonical))), '') AS matched_concepts FROM top""",
    "hybrid_search": f"""{WITH_POSTINGS}, v AS (SELECT doc_id, list_transform(range(64), lambda i: coalesce(map_extract(map(list(idx), list(weight)), i)[1], 0.0)) AS v FROM (
        SELECT doc_id, idx, CASE WHEN l > 0 THEN w / l ELSE w END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM ({hashed(64)}))) GROUP BY doc_id),
      qv AS (SELECT list_transform(range(64), lambda i: coalesce(map_extract(map(list(idx), list(weight)), i)[1], 0.0)) AS v FROM (
        SELECT doc_id, idx, CASE WHEN l > 0 THEN w / l ELSE w END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM ({hashed(64).replace('FROM documents', f"FROM (SELECT 0 AS doc_id, {q(Q.QUERY)} AS text)")}))) GROUP BY doc_id),
      near AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS chunk_id, list_dot_product(v.v, qv.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(qv.v, qv.v)) + 1e-8) AS s FROM v, qv ORDER BY round(s, 9) DESC, chunk_id LIMIT 60),
      f AS (SELECT chunk_id, coalesce(s, 0) AS s, coalesce(c, 0) AS c FROM near FULL JOIN {scored()} USING (chunk_id))
      SELECT CAST(row_number() OVER (ORDER BY round(0.5 * s + 0.5 * c, 9) DESC, chunk_id) AS INT) AS rank, chunk_id, round(s, 6) AS vector_score, round(c, 6) AS concept_score, round(0.5 * s + 0.5 * c, 6) AS combined_score,
        CASE WHEN s > 0 AND c > 0 THEN 'hybrid' WHEN s > 0 THEN 'vector' ELSE 'concept' END AS retrieval_method FROM f ORDER BY round(0.5 * s + 0.5 * c, 9) DESC, chunk_id LIMIT 20""",
    "cross_reference": f"""{WITH_POSTINGS}, own AS (SELECT *, row_number() OVER (ORDER BY round(c, 9) DESC, chunk_id) AS rank FROM {scored(where="source_type = 'document'")} ORDER BY round(c, 9) DESC, chunk_id LIMIT 5),
      names AS (SELECT lower(canonical) AS key, row_number() OVER (ORDER BY r, canonical) AS o FROM (SELECT canonical, min(rank) AS r FROM own JOIN m USING (chunk_id) GROUP BY 1) ORDER BY r, canonical LIMIT 5),
      hits AS (SELECT source_type, chunk_id, min(o) AS o FROM p JOIN names USING (key) WHERE kind = 'concept' AND source_type IN ('code', 'log') GROUP BY ALL)
      SELECT 'document' AS result_type, rank, chunk_id, round(c, 6) AS score, 'concept' AS retrieval_method FROM own UNION ALL
      SELECT source_type, rank, chunk_id, 1.0, 'cross_reference' FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY o, chunk_id) AS rank FROM hits) WHERE rank <= 5""",
    "query_expansion": f"""WITH qs AS (SELECT row_number() OVER () AS id, text FROM {values([(q(x),) for x in (Q.QUERY, 'the and', 'nothing', 'licensed mail', 'eaux')], 'text')}), m AS {matches('qs', 'id')},
      rel AS {values([(q(e.canonical_term), str(i + 1), q(r)) for e in V.entries for i, r in enumerate(e.related_keywords[:3])], 'canonical, i, term')},
      cand AS (SELECT id, 0 AS n, 0 AS i, text AS x FROM qs UNION ALL SELECT id, n, 0, canonical FROM m WHERE lower(canonical) <> lower(written) UNION ALL SELECT m.id, m.n, rel.i, rel.term FROM m JOIN rel USING (canonical)),
      kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(x) ORDER BY n, i) AS rn FROM cand) WHERE rn = 1 OR i = 0)
      SELECT text AS query, expanded FROM qs JOIN (SELECT id, string_agg(x, '|' ORDER BY n, i) AS expanded FROM kept GROUP BY id) USING (id)""",
    "vector_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(v.embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e)) + 1e-8) AS s FROM embeddings v, q) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 15",
    "vector_topk_filtered": "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(v.embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e)) + 1e-8) AS s FROM embeddings v, q WHERE label IN (1, 2)) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 15",
    "batch_vector_topk": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)) + 1e-8) AS s FROM e q, e v WHERE q.vec_id % 20 = 0) SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 3",
    "cosine_pairs": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "token_counts": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term",
    "bigram_counts": f"SELECT term, count(*) AS tf FROM (SELECT unnest({pairs('t')}) AS term FROM (SELECT {TOKENS} AS t FROM documents)) GROUP BY term",
    "stem_counts": f"SELECT {stem('w')} AS stem, count(*) AS tf FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY ALL",
    "stopword_filtered": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS all_tokens, CAST(len(list_filter(t, lambda x: NOT list_contains({STOP}, x))) AS BIGINT) AS kept FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "tfidf_weights": f"""WITH w AS (SELECT doc_id, {stem('x')} AS term FROM (SELECT doc_id, unnest(list_filter(t || {pairs('t')}, lambda y: NOT list_contains({STOP}, y))) AS x FROM (SELECT doc_id, {TOKENS} AS t FROM documents))),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
      top AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term) - 1 AS idx, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, sum(tf) AS freq, count(*) AS df FROM tf GROUP BY term ORDER BY freq DESC, term LIMIT 10000))
      {normal(f"SELECT doc_id, idx, (1 + ln(tf)) * idf * {boost('term')} AS w FROM tf JOIN top USING (term)", 'doc_id, idx', 5)}""",
    "tfidf_min_df": f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter({TOKENS}, lambda y: NOT list_contains({STOP}, y))) AS term FROM documents) GROUP BY ALL),
      top AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term) - 1 AS idx, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, sum(tf) AS freq, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3 ORDER BY freq DESC, term LIMIT 10000))
      SELECT doc_id, idx, round(tf * idf * {boost('term')}, 5) AS weight FROM tf JOIN top USING (term)""",
    "bm25_weights": f"""WITH t AS (SELECT doc_id, list_filter({TOKENS}, lambda y: NOT list_contains({STOP}, y)) AS t FROM documents), a AS (SELECT avg(len(t)) AS a, count(*) AS n FROM t),
      tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
      {normal(f"SELECT doc_id, term, ln((a.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / a.a)) * {boost('term')} AS w FROM tf JOIN df USING (term), a", 'doc_id, term', 5)}""",
    "hash_embedding_sparse": normal(hashed(256), "doc_id, idx", 5),
    "embedding_by_name": normal(hashed(128), "doc_id, idx", 5),
    "concept_embedding": f"{WITH_DOCS} {normal(ACTIVE, 'doc_id, CAST(idx AS BIGINT) AS idx', 6)}",
    "explain_embedding": f"{WITH_DOCS} {normal(ACTIVE, 'doc_id, name', 6)}",
    "hybrid_embedding": f"""{WITH_DOCS}, c AS ({normal(ACTIVE, 'doc_id, CAST(idx AS BIGINT) AS idx', 15)}), h AS ({normal(hashed(64), 'doc_id, idx', 15)})
      SELECT doc_id, idx, round(0.6 * weight, 5) AS weight FROM c UNION ALL SELECT doc_id, idx + {embed.ConceptEmbedder(V).n_dimensions}, round(0.4 * weight, 5) FROM h""",
    "heading_detection": f"SELECT doc_id, count(*) AS lines, count(*) FILTER (coalesce({heading('t')}, FALSE)) AS headings FROM (SELECT doc_id, {strip('line')} AS t FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10)), chr(10))) AS line FROM documents)) GROUP BY doc_id",
    "doc_sections": f"""WITH {chunked('long', 1200, 100).replace('RECURSIVE', f'RECURSIVE {SECTIONS},', 1)},
      c AS (SELECT doc_id, title, CAST(k AS VARCHAR) AS chunk_index, text FROM sec WHERE length(text) BETWEEN 20 AND 1500 UNION ALL SELECT doc_id, title, k || '_' || i, chunk FROM pieces JOIN sec ON key = doc_id || '/' || k)
      SELECT 'd' || doc_id AS path, chunk_index, 'document_' || left(md5('d' || doc_id || ':' || left(text, 200) || ':' || chunk_index), 12) AS chunk_id,
        CASE WHEN coalesce(title, '') <> '' THEN 'section' ELSE 'paragraph' END AS semantic_type, md5(text) AS text_md5 FROM c""",
    "llm_sanitized": f"""SELECT doc_id, md5({strip("regexp_replace(regexp_replace(chr(1) || 'a' || chr(160) || repeat(chr(10), 4) || 'b' || chr(8232) || text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\x{a0}\\x{ad}\\x{1680}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}\\x{e000}-\\x{f8ff}]', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS clean_md5 FROM documents""",
    "tal_procedures": f"""WITH f AS (SELECT p_brand || '.tal' AS path, '! preamble' || chr(10) || string_agg(CASE WHEN p_size % 2 = 0 THEN 'INT ' ELSE '' END || 'PROC part^' || p_partkey || '(a);' || chr(10) || 'BEGIN' || chr(10) || ' CALL helper^' || p_size || ';' || chr(10)
        || ' x := $LEN(a);' || chr(10) || ' s := "' || p_name || '"; ! SIZE_' || p_size || chr(10) || 'END;', chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand),
      l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM f),
      g AS (SELECT *, regexp_matches(line, {q(tal.PROC)}) AS h, sum(CAST(regexp_matches(line, {q(tal.PROC)}) AS INT)) OVER (PARTITION BY path ORDER BY n) AS g FROM l),
      p AS (SELECT path, g, max(line) FILTER (h) AS head, min(n) AS line_start, max(n) AS line_end, string_agg(line, chr(10) ORDER BY n) AS text FROM g WHERE g > 0 GROUP BY path, g),
      k AS (SELECT *, list_sort(list_distinct(regexp_extract_all(text, '\\$[A-Z][A-Z0-9_]*') || regexp_extract_all(text, '(?i)CALL\\s+([A-Za-z_][A-Za-z0-9_\\^]*)', 1) || regexp_extract_all(text, '\\b([A-Z][A-Z0-9_]{{3,}})\\b', 1) || regexp_extract_all(text, '"([^"]+)"', 1))) AS words FROM p)
      SELECT path, regexp_extract(head, {q(tal.PROC)}, 2) AS procedure_name, nullif(regexp_extract(head, {q(tal.PROC)}, 1), '') AS return_type, line_start, line_end, array_to_string(words, ',') AS keywords,
        'code_' || left(md5(path || ':' || left(text, 200) || ':' || regexp_extract(head, {q(tal.PROC)}, 2)), 12) AS chunk_id FROM k""",
    "chunk_text": f"WITH {CHUNKED} SELECT key AS doc_id, i, md5(chunk) AS chunk_md5 FROM pieces UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 1200",
    "chunk_ids": "SELECT doc_id, 'document_' || left(md5(source || ':' || left(text, 200) || ':'), 12) AS chunk_id, left(md5(source || ':' || left(text, 100)), 12) AS fallback_id FROM documents",
    "html_strip": f"SELECT page_id, md5({strip(f'''regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_BLANK}+', ' ', 'g')''')}) AS text_md5 FROM pages",
    "embedding_texts": f"""{WITH_DOCS}, c AS (SELECT doc_id, list(canonical ORDER BY n) AS names, list(caps[1:2] ORDER BY n) AS caps FROM m GROUP BY doc_id),
      d AS (SELECT doc_id, list_filter(flatten(caps), lambda x, i: list_position(flatten(caps), x) = i)[1:5] AS caps, names[1:5] AS names FROM c),
      h AS (SELECT doc_id, text, concat_ws(' ', CASE WHEN names IS NOT NULL THEN 'Document section about ' || array_to_string(names, ', ') || '.' END, CASE WHEN len(caps) > 0 THEN 'Business capabilities: ' || array_to_string(caps, ', ') || '.' END, 'Section: T') AS head,
        coalesce(length('Document section about ' || array_to_string(names, ', ') || '.'), 0) + CASE WHEN len(caps) > 0 THEN length('Business capabilities: ' || array_to_string(caps, ', ') || '.') ELSE 0 END + 10 AS used FROM documents LEFT JOIN d USING (doc_id))
      SELECT doc_id, md5(head || ' ' || left(text, 1500 - used)) AS said_md5 FROM h""",
    "markdown_sections": f"""WITH t AS (SELECT conv_id, string_split(string_agg(repeat('#', least(turn % 4 + 1, 6)) || ' ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn), chr(10)) AS x FROM conversations GROUP BY conv_id),
      l AS (SELECT conv_id, unnest(x) AS line, unnest(range(len(x))) AS n FROM t),
      g AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS head, sum(CAST(regexp_matches(line, '^#{{1,6}}\\s+.+$') AS INT)) OVER (PARTITION BY conv_id ORDER BY n) AS g FROM l),
      s AS (SELECT conv_id, g, max(line) FILTER (head) AS h, {strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), '')")} AS content FROM g WHERE g > 0 GROUP BY conv_id, g)
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS i, regexp_extract(h, '^#{{1,6}}\\s+(.+)$', 1) AS title, md5(content) AS content_md5, length(regexp_extract(h, '^#+')) - 1 AS section_level FROM s WHERE content <> ''""",
    "log_level_extract": f"SELECT level, is_error, 'E' AS error_code, count(*) AS n, min(timestamp) AS first_ts, CAST(max(CAST(amount AS DOUBLE)) AS DOUBLE) AS max_amount FROM {ENTRIES} GROUP BY ALL",
    "log_trace_group": f"SELECT trace_id, entry_count, start_time, end_time, has_error, line_start, line_end, 'log_' || left(md5('events.log:' || left(text, 200) || ':' || trace_id), 12) AS chunk_id, last_amount FROM {traces(50)}",
    "log_batches": f"""SELECT batch, count(*) AS entry_count, bool_or(is_error) AS has_error, coalesce(string_agg(DISTINCT level, ',' ORDER BY level), '') AS levels, min(line_number) AS line_start, max(line_number) AS line_end, md5(string_agg(message, chr(10) ORDER BY line_number)) AS text_md5
      FROM (SELECT *, (row_number() OVER (ORDER BY line_number) - 1) // 10 AS batch FROM {ENTRIES}) GROUP BY batch""",
    "error_traces": f"SELECT CASE WHEN has_error THEN 'error_trace' ELSE 'transaction' END AS semantic_type, count(*) AS traces, CAST(sum(entry_count) AS BIGINT) AS entries FROM {traces(50)} GROUP BY ALL",
    "last_batch": f"SELECT batch, count(*) AS traces, CAST(sum(entry_count) AS BIGINT) AS entries FROM {traces(50, ', (line_number - 1) // 1000 AS batch', 'batch,')} GROUP BY batch",
    "json_field_extract": f"SELECT upper(event_type) AS level, upper(event_type) IN ({_LEVELS}) AS is_error, count(*) AS n, count(DISTINCT user_id) AS traces, count(DISTINCT props) AS messages FROM events GROUP BY ALL",
    "json_array_logs": f"""SELECT user_id || '-' || event_id // 10000 AS path, CAST(user_id AS VARCHAR) AS trace_id, count(*) AS entries, count(*) AS last_line,
      CAST(count_if(upper(event_type) IN ({_LEVELS})) AS BIGINT) AS errors, CAST(sum(length(props)) AS BIGINT) AS n_chars FROM events GROUP BY ALL""",
    "log_formats": "SELECT event_id, event_id % 4 = 0 AS json_lines, event_id % 4 = 1 AS json_array FROM events",
    "text_logs": f"""WITH f AS (SELECT conv_id, string_agg(upper(role) || ' ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
      l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM f)
      SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS entries, max(n) AS last_line, CAST(sum(length({strip('line')})) AS BIGINT) AS n_chars FROM l WHERE {strip('line')} <> '' GROUP BY ALL""",
    "cooccurrence_pairs": f"WITH {PLACES}, {PAIRS} SELECT * FROM c",
    "npmi": f"""WITH {PLACES}, {PAIRS},
      x AS (SELECT t1, t2, cnt, cnt / sum(cnt) OVER () AS j, a.frequency / (SELECT sum(frequency) FROM top) AS p1, b.frequency / (SELECT sum(frequency) FROM top) AS p2 FROM c JOIN top a ON a.term = t1 JOIN top b ON b.term = t2)
      SELECT t1, t2, cnt, round(CASE WHEN j < 1 THEN greatest(0, ln(j / (p1 * p2)) / -ln(j)) ELSE 0 END, 6) AS npmi FROM x""",
    "llm_context_text": told(6, 0.0),
    "llm_context_min_score": told(12, 0.7),
    "learned_term_stats": f"WITH {term_stats(6)} SELECT * FROM stats",
    "extracted_keywords": f"""WITH l AS (SELECT doc_id, {ascii_words("'NASA_X WireTransfer ' || text", '0')} AS t FROM documents),
      k AS (SELECT doc_id, {' || '.join(f"regexp_extract_all(t, '{p}')" for p in T.KEYWORDS)} AS k FROM l),
      d AS (SELECT doc_id, unnest(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i)) AS k FROM k)
      SELECT k, count(DISTINCT doc_id) AS docs FROM d GROUP BY k""",
    "index_statistics": f"""{WITH_POSTINGS} SELECT 'total_chunks' AS metric, '' AS name, count(*) AS value FROM documents UNION ALL SELECT 'distinct_keys', kind, count(DISTINCT key) FROM p GROUP BY kind
      UNION ALL SELECT 'chunks_by_' || kind, key, count(*) FROM p WHERE kind IN ('source_type', 'capability') GROUP BY kind, key""",
    "ranked_concepts": f"{WITH_POSTINGS}, n AS (SELECT source_type, key, count(*) AS n FROM p WHERE kind = 'concept' GROUP BY ALL) SELECT source_type, key, n, row_number() OVER (PARTITION BY source_type ORDER BY n DESC, key) AS rank FROM n",
    "vocabulary_statistics": f"""WITH t AS {TERMS}, e AS {values([(str(i), q(x.category), listed(x.capabilities)) for i, x in enumerate(V.entries)], 'e, category, caps')}
      SELECT 'total_entries' AS metric, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM e UNION ALL SELECT 'total_terms', '', count(DISTINCT term) FROM t UNION ALL SELECT 'categories', '', count(DISTINCT category) FROM e
      UNION ALL SELECT 'capabilities', '', count(DISTINCT c) FROM (SELECT unnest(caps) AS c FROM e) UNION ALL SELECT 'terms_per_entry', '', round((SELECT count(DISTINCT term) FROM t) / (SELECT count(*) FROM e), 2)
      UNION ALL (SELECT 'top_category', category, count(*) FROM e GROUP BY category ORDER BY count(*) DESC, category LIMIT 10)""",
    "source_types": f"SELECT doc_id, path, CASE WHEN list_contains(['.tal', '.tacl', '.txt'], x) THEN 'code' WHEN list_contains(['.pdf', '.docx', '.doc', '.md', '.html'], x) THEN 'document' WHEN list_contains(['.log', '.json', '.jsonl'], x) THEN 'log' END AS source_type FROM (SELECT doc_id, path, lower(regexp_extract(path, '\\.[^./]*$')) AS x FROM (SELECT doc_id, source || '/' || doc_id || ({listed(Q.ENDINGS)})[doc_id % {len(Q.ENDINGS)} + 1] AS path FROM documents))",
    "source_refs": "SELECT 'f.tal:' || CASE WHEN l_linenumber % 2 = 0 THEN 'lines ' || l_linenumber || '-' || (l_linenumber + 3) ELSE 'line ' || l_linenumber END || ':proc p:@ ' || l_returnflag AS ref, count(*) AS n FROM lineitem GROUP BY ALL",
}
