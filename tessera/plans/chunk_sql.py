"""DuckDB SQL for chunking, embedding, retrieval and answers: the queries' rows by prefix sums and joins, apart from the operators.

Separators stay at the start of the piece behind them, so pieces tile a text. Runs of pieces below the limit are merged: with P
the sums of their lengths, a chunk that starts at piece s ends before the first piece e whose end lies more than SIZE behind
P(s); the next one starts at the first piece from which no more than OVERLAP is left before e, and which leaves room for e.
"""

from __future__ import annotations

from tessera import config

SIZE, OVERLAP = 800, 150
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_MARKS = ("chr(10) || chr(10)", "chr(10)", "' '", "''")


def _level(k: int) -> str:
    """Pieces of the parts of level k; those at or above the limit are the parts of the next level."""
    which = " ".join(f"WHEN level <= {n} AND contains(t, {mark}) THEN {n}" for n, mark in enumerate(_MARKS[:-1]))
    mark = " ".join(f"WHEN {n} THEN {m}" for n, m in enumerate(_MARKS))
    return f"""cut{k} AS (SELECT doc_id, base, t, CASE {which} ELSE 3 END AS sep FROM part{k}),
marked{k} AS (SELECT *, CASE sep {mark} END AS mark FROM cut{k}),
split{k} AS (SELECT doc_id, base, sep, unnest(string_split(t, mark)) AS x, generate_subscripts(string_split(t, mark), 1) AS i, mark FROM marked{k}),
piece{k} AS (SELECT doc_id, base, sep, i, CASE WHEN i > 1 THEN mark ELSE '' END || x AS x FROM split{k}),
placed{k} AS (SELECT doc_id, base, sep, i, x, length(x) AS n, coalesce(sum(length(x)) OVER before, 0)::BIGINT AS pos,
    coalesce(sum((length(x) >= {SIZE})::INT) OVER before, 0) AS run
    FROM piece{k} WHERE x <> '' WINDOW before AS (PARTITION BY doc_id, base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
part{k + 1} AS (SELECT doc_id, base + pos AS base, x AS t, sep + 1 AS level FROM placed{k} WHERE n >= {SIZE})"""


_LEVELS = 4
_UNITS = " UNION ALL ".join(f"SELECT doc_id, {k} AS level, base, run, base + pos AS pos, n FROM placed{k} WHERE n < {SIZE}" for k in range(_LEVELS))


def _first(condition: str, low: str, high: str) -> str:
    """The first i of low .. high - 1 that meets the condition, or null."""
    return f"list_filter(range({low}, {high}), lambda i: {condition})[1]"


def chunked(texts: str = "documents") -> str:
    """CTEs from texts(doc_id, text) that end in chunks(id, text): the segmented chunks that are not blank, numbered before that filter."""
    return f"""part0 AS (SELECT doc_id, 0::BIGINT AS base, text AS t, 0 AS level FROM {texts} WHERE text <> ''),
{", ".join(_level(k) for k in range(_LEVELS))},
units AS ({_UNITS}),
runs AS (SELECT doc_id, level, base, run, min(pos) AS origin, list(n ORDER BY pos) AS n, list(pos ORDER BY pos) AS starts FROM units GROUP BY ALL),
sums AS (SELECT doc_id, origin, level, n, list_transform(starts, lambda a: a - origin) || [list_sum(n)::BIGINT] AS p, len(n) AS size FROM runs),
walk AS (SELECT doc_id, origin, level, n, p, size, 0 AS turn, 0::BIGINT AS s, {_first(f"p[i + 2] - p[1] > {SIZE}", "0", "size")} AS e FROM sums
    UNION ALL
    SELECT doc_id, origin, level, n, p, size, turn + 1, s, {_first(f"p[i + 2] - p[s + 1] > {SIZE}", "last + 1", "size")}
    FROM (SELECT doc_id, origin, level, n, p, size, turn, e AS last,
        {_first(f"p[e + 1] - p[i + 1] <= {OVERLAP} AND (i = e OR p[e + 2] - p[i + 1] <= {SIZE})", "s", "e + 1")} AS s FROM walk WHERE e IS NOT NULL)),
cuts AS (SELECT doc_id, origin, level, turn, origin + p[s + 1] AS first, p[coalesce(e, size) + 1] - p[s + 1] AS n FROM walk),
texts AS (SELECT c.doc_id, origin, turn, regexp_replace(substr(text, first::BIGINT + 1, n::BIGINT), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS text
    FROM cuts c JOIN {texts} d ON c.doc_id = d.doc_id),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id, origin, turn) - 1 AS id, text FROM texts WHERE text <> ''),
chunks AS (SELECT id, regexp_replace(text, '{_BLANK}+', ' ', 'g') AS text FROM numbered WHERE text <> '')"""

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def embedded(name: str, key: str, table: str) -> str:
    """CTEs {name}_words (key, token) and {name} (key, place, v): counts of hashed tokens, normalised, as floats."""
    return f"""{name}_all AS (SELECT {key}, unnest({_TOKENS}) AS token FROM {table}),
{name}_words AS (SELECT DISTINCT {key}, token FROM {name}_all),
{name}_counts AS (SELECT {key}, ('0x' || md5(token)[1:8])::BIGINT % 64 AS place, count(*)::DOUBLE AS c FROM {name}_all GROUP BY 1, 2),
{name} AS (SELECT {key}, place, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM {name}_counts)"""


def retrieved(passages: str, key: str, k: int = 3, overfetch: int = 3) -> str:
    """CTEs that end in found(item_id, id, rank): of the k x overfetch nearest passages the k that share most tokens with the question."""
    return f"""{embedded("q", "item_id", "benchmark")}, {embedded("p", key, passages)},
q_norm AS (SELECT item_id, sqrt(sum(v * v)) AS r FROM q GROUP BY 1), p_norm AS (SELECT {key}, sqrt(sum(v * v)) AS r FROM p GROUP BY 1),
dots AS (SELECT item_id, {key} AS id, sum(q.v * p.v) AS d FROM q JOIN p USING (place) GROUP BY 1, 2),
every AS (SELECT a.item_id, b.{key} AS id, round(coalesce(d, 0) / (a.r * b.r), 12) AS score
    FROM q_norm a CROSS JOIN p_norm b LEFT JOIN dots ON dots.item_id = a.item_id AND dots.id = b.{key}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS r FROM every) WHERE r <= {k * overfetch}),
shared AS (SELECT near.item_id, near.id, count(p_words.token) AS overlap FROM near LEFT JOIN q_words ON q_words.item_id = near.item_id
    LEFT JOIN p_words ON p_words.{key} = near.id AND p_words.token = q_words.token GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, id) AS rank FROM shared) WHERE rank <= {k})"""


RECURSIVE_CHUNKS = f"WITH RECURSIVE {chunked()} SELECT id::BIGINT AS id, text FROM chunks"
RERANKED = f"WITH {retrieved('documents', 'doc_id')} SELECT item_id, id AS doc_id, rank::BIGINT AS rank, overlap::BIGINT AS overlap FROM found"
VECTORS = f"WITH {embedded('q', 'item_id', 'benchmark')} SELECT item_id AS query_id, place, round(v, 6) AS v FROM q"
PASSAGES = f"""WITH RECURSIVE {chunked()}, {retrieved('chunks', 'id')}
SELECT item_id AS query_id, f.id, rank::BIGINT AS rank, overlap::BIGINT AS overlap, md5(c.text) AS text_md5 FROM found f JOIN chunks c ON c.id = f.id"""
#: Each question's answer from the chunks; no question here is without passages.
ANSWERS = f"""WITH RECURSIVE {chunked()}, {retrieved('chunks', 'id')},
contexts AS (SELECT item_id, string_agg(c.text, '{config.CONTEXT_SEPARATOR}' ORDER BY rank) AS t, count(*) AS n FROM found f JOIN chunks c ON c.id = f.id GROUP BY 1),
answered AS (SELECT b.item_id AS query_id, b.text AS query, coalesce(n, 0)::BIGINT AS n_contexts,
    CASE WHEN n IS NULL THEN '{config.NO_DOCUMENT}' ELSE 'answer ' || md5('{config.PROMPT[0]}' || t || '{config.PROMPT[1]}' || b.text || '{config.PROMPT[2]}') END AS answer
    FROM benchmark b LEFT JOIN contexts USING (item_id))"""
#: Asked for the first time and asked again.
CHATS = f"""{ANSWERS} SELECT round, query_id, answer, CASE round WHEN 1 THEN '{config.FROM_AGENT}' ELSE '{config.FROM_CACHE}' END AS source,
    CASE round WHEN 1 THEN n_contexts ELSE 0 END AS n_contexts FROM answered, (VALUES (1), (2)) r(round)"""
#: Points of all rows of documents and of conversations, as texts.
POINTS = f"""WITH RECURSIVE corpus AS (SELECT row_number() OVER (ORDER BY k, a, b) AS doc_id, text FROM (
    SELECT 0 AS k, doc_id AS a, 0 AS b, concat_ws(' ', CASE WHEN doc_id <> 0 THEN doc_id::VARCHAR END, nullif(text, ''), nullif(lang, ''), nullif(source, ''), CASE WHEN n_chars <> 0 THEN n_chars::VARCHAR END) AS text FROM documents
    UNION ALL SELECT 1, conv_id, turn, concat_ws(' ', CASE WHEN conv_id <> 0 THEN conv_id::VARCHAR END, CASE WHEN turn <> 0 THEN turn::VARCHAR END, nullif(role, ''), nullif(text, ''))
    FROM conversations)),
{chunked('corpus')}, {embedded('p', 'id', 'chunks')},
tokens AS (SELECT id, count(DISTINCT ('0x' || md5(token)[1:8])::BIGINT % 1024) AS n FROM p_all GROUP BY 1)
SELECT c.id::BIGINT AS id, md5(c.text) AS text_md5, 64::BIGINT AS n_dense, coalesce(n, 0)::BIGINT AS n_sparse FROM chunks c LEFT JOIN tokens USING (id)"""

#: The nearest nine by vector, ranked by BM25 over all documents.
BM25 = f"""WITH {retrieved('documents', 'doc_id')},
said AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
corpus AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM said),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM said) GROUP BY 1),
asked AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS q FROM benchmark),
hits AS (SELECT item_id, id, len(w) AS length, unnest(list_filter(w, lambda x: list_contains(q, x))) AS token FROM near JOIN asked USING (item_id) JOIN said ON doc_id = id),
counted AS (SELECT item_id, id, length, token, count(*) AS f FROM hits GROUP BY ALL),
scored AS (SELECT item_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) ORDER BY token) AS bm FROM counted JOIN df USING (token), corpus GROUP BY 1, 2),
ranked AS (SELECT item_id, id, round(coalesce(bm, 0), 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(bm, 0), 9) DESC, id) AS rank FROM near LEFT JOIN scored USING (item_id, id))
SELECT item_id AS query_id, id, rank::BIGINT AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 3"""

_SYLLABLE = r"[\p{L}\p{N}]+"
#: A syllable or a mark.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Runs of syllables with white space alone between them, and all words of up to four of their syllables.
SYLLABLES = f"""WITH runs AS (SELECT regexp_extract_all(r, '{_SYLLABLE}') AS s FROM (SELECT unnest(regexp_extract_all(lower(text), '{_SYLLABLE}(?:{_BLANK}+{_SYLLABLE})*')) AS r FROM documents)),
words AS (SELECT k, array_to_string(s[i + 1 : i + k], '_') AS word FROM (SELECT s, k, unnest(range(0, len(s) - k + 1)) AS i FROM (SELECT s, unnest([1, 2, 3, 4]) AS k FROM runs)))
SELECT word, count(*) AS n FROM words GROUP BY word, k HAVING k = 1 OR count(*) >= 3"""
