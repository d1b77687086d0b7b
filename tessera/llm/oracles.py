"""DuckDB SQL for the queries whose rows SQL can express whole: substring dedup, quality rules, SimHash, license scans and sharding.

Both spell out the contract and share nothing with the operators but the fixed values of the rules.
"""

from __future__ import annotations

from tessera.llm.license_texts import TEMPLATES
from tessera.llm.licenses import CONTAINMENT, SHINGLE, TOKEN
from tessera.llm.quality import ALPHA, DELTA, PATHS, PRICE, RULES
from tessera.llm.secret_scan import AROUND, BASE, BEFORE, CLASSES, INSIDE, LEAST_ACCESS, LEAST_ASSIGNED, STEPS, UUID, WORDS
from tessera.llm.sharding import BUNDLES, SLOT_ROWS
from tessera.llm.substrings import WINDOW
from tessera.llm.xxh_sql import xxh64

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows are compared by their words. A word goes if one of the windows over it starts in a smaller document.
SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
windows AS (SELECT doc_id, i, words[i] AS word,
    CASE WHEN i + {WINDOW - 1} <= len(words) THEN array_to_string(words[i : i + {WINDOW - 1}], ' ') END AS said FROM places),
judged AS (SELECT doc_id, i, word, said IS NOT NULL AND min(doc_id) OVER (PARTITION BY said) < doc_id AS again FROM windows),
covered AS (SELECT doc_id, i, word,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM judged),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS words FROM covered GROUP BY doc_id)
SELECT doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)"""

#: (path, rule, place in the path, rules of the path), (rule, k, cutoff).
_PATHS = ", ".join(f"({n}, '{rule}', {place}, {len(path)})" for n, path in enumerate(PATHS) for place, rule in enumerate(path))
_CUTOFFS = ", ".join(f"('{rule}', {k}, {cutoff}::DOUBLE)" for rule, cutoffs in RULES.items() for k, cutoff in enumerate(cutoffs))
_TAIL = f"""CASE WHEN n = 0 OR rejected >= n * {ALPHA}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, rejected + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}::DOUBLE) + (n - j) * ln(1 - {ALPHA}::DOUBLE)))) END"""


def _share(part: str, whole: str) -> str:
    return f"{part}::DOUBLE / greatest({whole}, 1)"


#: The counts, then the tests of every step of each stratum and path with exact binomial tails, then the verdicts.
QUALITY = f"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
grams AS (SELECT doc_id, i, CASE WHEN i + 2 <= len(words) THEN array_to_string(words[i : i + 2], ' ') END AS gram FROM places),
found AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM grams),
covered AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM found),
repeats AS (SELECT doc_id, count(*) FILTER (again) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
counts AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM docs JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
shares AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {{
    'symbols': {_share('n_symbols', 'word_chars')}, 'dup_lines': {_share('n_dup_lines', 'n_lines')},
    'repeats': {_share('n_repeat_words', 'n_words')}, 'exclaims': {_share('n_exclaims', 'n_words')}}} AS share FROM counts),
rules(rule, k, cutoff) AS (VALUES {_CUTOFFS}),
paths(path, rule, place, n_rules) AS (VALUES {_PATHS}),
truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
values_of AS (SELECT doc_id, lang, text, base_failed, unnest([{', '.join(f"'{r}'" for r in RULES)}]) AS rule, unnest([{', '.join(f"share.{r}" for r in RULES)}]) AS x
    FROM shares JOIN docs USING (doc_id, lang)),
steps AS (SELECT doc_id, path, min(k * n_rules + place + 1) AS step FROM values_of JOIN rules USING (rule) JOIN paths USING (rule) WHERE x > cutoff GROUP BY ALL),
trials AS (SELECT lang, text, min(quality) AS quality, min(doc_id) AS doc_id FROM shares JOIN docs USING (doc_id, lang) JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
strata AS (SELECT lang, count(*) FILTER (quality = 1) AS n FROM trials GROUP BY lang),
tried AS (SELECT s.lang, p.path, k.step, n, count(*) FILTER (quality = 1 AND t.step <= k.step) AS rejected, count(*) FILTER (quality = 0 AND t.step <= k.step) AS caught
    FROM strata s, (SELECT DISTINCT path FROM paths) p, range(1, {len(RULES) * max(map(len, RULES.values())) + 1}) k(step)
    LEFT JOIN (SELECT r.lang, r.quality, x.path, x.step FROM trials r JOIN steps x USING (doc_id)) t ON t.lang IS NOT DISTINCT FROM s.lang AND t.path = p.path GROUP BY ALL),
tested AS (SELECT *, {_TAIL} <= {DELTA}::DOUBLE / (SELECT count(*) * {len(PATHS)} FROM strata) AS passes FROM tried),
certified AS (SELECT *, bool_and(passes) OVER (PARTITION BY lang, path ORDER BY step) AS sure, caught - {PRICE} * rejected AS gain FROM tested),
chosen AS (SELECT lang, arg_max(path, {{'gain': gain, 'path': -path, 'step': -step}}) AS path, arg_max(step, {{'gain': gain, 'path': -path, 'step': -step}}) AS last
    FROM certified WHERE sure AND gain > 0 GROUP BY lang),
rejected AS (SELECT DISTINCT s.doc_id FROM shares s JOIN chosen c ON s.lang IS NOT DISTINCT FROM c.lang JOIN steps x ON x.doc_id = s.doc_id AND x.path = c.path WHERE x.step <= c.last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM shares"""


#: The table of CRC-32, by its rule: eight steps of its polynomial from each byte.
_CRC = ", ".join(
    f"crc{k + 1} AS (SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM crc{k})" for k in range(8)
)

#: Groups by size to the least-loaded of eight shards (ties: lower shard), one after the other; slots by doc_id within parts.
SHARDING = f"""
WITH RECURSIVE crc0 AS (SELECT i::BIGINT AS i, i::BIGINT AS c FROM range(256) t(i)), {_CRC}, crc AS (SELECT list(c ORDER BY i) AS places FROM crc8),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(md5(text), '-') AS same, strlen(coalesce(text, '')) + 1 AS size FROM documents),
bytes AS (SELECT DISTINCT same, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM docs),
sums AS (SELECT same, CASE WHEN len(b) = 0 THEN 0 ELSE xor(list_reduce(b, lambda c, x: xor(c >> 8, places[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) END AS sum FROM bytes, crc),
groups AS (SELECT same, sum(size) AS size FROM docs GROUP BY same),
item_of AS (SELECT same, size, CASE WHEN size > (SELECT sum(size) FROM docs) / {BUNDLES}::DOUBLE THEN same
    ELSE 'bundle ' || (CASE same WHEN '-' THEN 0 ELSE ('0x' || same[1:8])::BIGINT END % {BUNDLES}) END AS item FROM groups),
items AS (SELECT item, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY sum(size) DESC, item) AS n FROM item_of GROUP BY item),
placed AS (SELECT 0::BIGINT AS n, '' AS item, 0::BIGINT AS shard, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads
    UNION ALL SELECT i.n, i.item, list_position(loads, list_min(loads)) - 1,
        list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN i.size ELSE 0 END) FROM placed p JOIN items i ON i.n = p.n + 1),
rows AS (SELECT d.doc_id, d.size, d.same, p.shard, ('0x' || md5(concat_ws(':', d.doc_id, d.same))[1:8])::BIGINT
    % greatest(1, ceil((SELECT count(*) FROM (SELECT DISTINCT doc_id, same FROM docs)) / {SLOT_ROWS} / 8))::BIGINT AS part
    FROM docs d JOIN item_of USING (same) JOIN placed p USING (item))
SELECT doc_id, size::BIGINT AS size, sum::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, same) - 1 AS slot, NULL::INT AS grown_shard FROM rows JOIN sums USING (same)"""

_LICENSES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
_REACH = f"(ceil(n / 4.0) + {SHINGLE})::BIGINT"

#: Every place where a text and a template share a shingle; the template's shingles are then counted around it.
LICENSES = f"""
WITH docs AS (SELECT DISTINCT doc_id, md5(text) AS k, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
shingles AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM docs)),
templates AS (SELECT template, license, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM (VALUES {_LICENSES}) t(template, license, text)),
cut AS (SELECT template, license, o, array_to_string(w[o + 1 : o + {SHINGLE}], ' ') AS s FROM (SELECT template, license, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS o FROM templates)),
whole AS (SELECT template, license, count(*) AS n, list(DISTINCT s) AS held FROM cut GROUP BY 1, 2),
places AS (SELECT DISTINCT doc_id, k, template, i - o AS start FROM shingles JOIN cut USING (s)),
found AS (SELECT doc_id, k, template, license, start, n, held, list(DISTINCT s) AS seen, min(i) AS first_word FROM places JOIN whole USING (template) JOIN shingles USING (doc_id, k)
    WHERE i >= start - {_REACH} AND i < start + n + {_REACH} AND list_contains(held, s) GROUP BY ALL),
readings AS (SELECT *, round(len(seen)::DOUBLE / len(held), 4) AS containment FROM found WHERE round(len(seen)::DOUBLE / len(held), 4) >= {CONTAINMENT}),
sound AS (SELECT * FROM readings a WHERE NOT EXISTS (SELECT 1 FROM readings b WHERE a.doc_id = b.doc_id AND a.k = b.k AND b.containment > a.containment
    AND a.start < b.start + b.n AND b.start < a.start + a.n AND list_has_all(b.held, a.seen)))
SELECT doc_id, license, max(containment) AS containment, arg_max(first_word, {{'c': containment, 'w': -first_word}})::BIGINT AS first_word FROM sound GROUP BY doc_id, k, license"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = " | ".join(f"(CASE WHEN 2 * sum(((h >> {k}) & 1)::BIGINT) > count(*) THEN {2**k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(64))

#: Fingerprints from the shingles' hashes; all pairs of distinct fingerprints are compared, and links followed until nothing new is reached.
SIMHASH = f"""
WITH RECURSIVE docs AS (SELECT doc_id, md5(coalesce(text, '')) AS k, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
texts AS (SELECT DISTINCT k, w FROM docs),
shingles AS (SELECT k, array_to_string(w[i + 1 : i + 3], ' ') AS s FROM (SELECT k, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 2) END)) AS i FROM texts)),
hashes AS (SELECT s, {xxh64("regexp_extract_all(hex(encode(s)), '..')")}::UBIGINT AS h FROM (SELECT DISTINCT s FROM shingles)),
prints AS (SELECT k, {_BITS} AS fp FROM shingles JOIN hashes USING (s) GROUP BY k),
of_doc AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM docs LEFT JOIN prints USING (k)),
nodes AS (SELECT fp, min(doc_id) AS least FROM of_doc GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::BITSTRING) <= 3),
reach AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS fp, min(nodes.least) AS component_id FROM reach JOIN nodes ON nodes.fp = reach.b GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM of_doc JOIN least USING (fp)"""


def _either_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in pattern)


_ASSIGNED = _either_case("(?:password|passwd|secret|token|api_?key)").replace("'", "''") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CLASSES = ", ".join(f"({len(BASE) + k}, '{c.name}', {c.window}, {c.bits}::DOUBLE)" for k, c in enumerate(CLASSES))
_CASES = {c.name: f"[{c.characters.replace('-', '')}-]{{{c.window},}}" if "-" in c.characters else f"[{c.characters}]{{{c.window},}}" for c in CLASSES}


def _matches(kind: int, name: str, pattern: str, keep: str) -> str:
    """Each match of a pattern and its place, from what lies between the matches."""
    return f"""SELECT doc_id, n, {kind} AS kind, '{name}' AS name, list_sum(list_transform(b[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS start, m[k] AS said
  FROM (SELECT doc_id, n, m, b, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, n, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS b FROM docs)) WHERE {keep}"""


_PLAIN_WORDS = WORDS.replace("}+", "}").replace("++", "+").replace("*+", "*")
#: Matches by what lies between them; each window's entropy from the counts of its characters; joined windows that the allow-list does not know.
SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_matches(0, "assign", _ASSIGNED, f"length(regexp_extract(m[k], '{_ASSIGNED}', 1)) >= {LEAST_ASSIGNED}")}
  UNION ALL {_matches(1, "access", "AKIA[A-Z0-9]+", f"length(m[k]) >= {LEAST_ACCESS}")} UNION ALL {_matches(2, "hex", "[0-9a-f]+", "length(m[k]) >= 16")}),
classes(kind, name, width, bits) AS (VALUES {_CLASSES}),
runs AS ({" UNION ALL ".join(_matches(len(BASE) + k, c.name, _CASES[c.name], "true") for k, c in enumerate(CLASSES))}),
windows AS (SELECT r.*, width, bits, unnest(range(0, length(said) - width + 1)) AS i FROM runs r JOIN classes USING (kind)),
counted AS (SELECT *, list_sum(list_transform(map_values(list_aggregate(string_split(said[i + 1 : i + width], ''), 'histogram')), lambda c: round(c * log2(c) * 1048576))) AS total FROM windows),
dense AS (SELECT *, i - lag(i) OVER w > width AS gap FROM counted WHERE total <= floor(width * (log2(width) - bits) * 1048576) WINDOW w AS (PARTITION BY n, kind, start ORDER BY i)),
islands AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY n, kind, start ORDER BY i) AS island FROM dense),
joined AS (SELECT doc_id, n, kind, name, start + min(i) AS start, start + max(i) + any_value(width) AS stop FROM islands GROUP BY doc_id, n, kind, name, start, island),
read AS (SELECT j.*, d.text[j.start + 1 : j.stop] AS said, d.text[greatest(0, j.start - {AROUND}) + 1 : j.start] AS around FROM joined j JOIN docs d USING (n)),
unknown AS (SELECT * FROM read WHERE list_sum(list_transform(range(1, length(said)), lambda k: (ord(said[k + 1 : k + 1]) - ord(said[k : k]) = 1)::INT)) < {STEPS}::DOUBLE * (length(said) - 1)
  AND NOT regexp_full_match(said, '{_PLAIN_WORDS}') AND NOT regexp_full_match(said, '{UUID}') AND NOT regexp_matches(said, '{INSIDE[0]}') AND NOT regexp_matches(around, '{BEFORE[0].replace("'", "''")}')),
added AS (SELECT doc_id, n, kind, name, start, stop FROM unknown u WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = u.n AND b.start <= u.start AND u.stop <= b.start + length(b.said))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY stop - start DESC, kind) AS k FROM added),
alone AS (SELECT * FROM ordered a WHERE NOT EXISTS (SELECT 1 FROM ordered b WHERE a.n = b.n AND b.k <> a.k AND b.start <= a.start AND a.stop <= b.stop AND (b.start < a.start OR b.kind < a.kind))),
spans AS (SELECT n, kind, name, start, start + length(said) AS stop, true AS is_base FROM base UNION ALL SELECT n, kind, name, start, stop, false FROM alone),
said AS (SELECT n, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
  string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) FILTER (is_base) AS base, string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN said USING (n)"""


_CONVERSATION_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, places[xor(c, x) % 256 + 1])), 4294967295)"

#: Nodes are the distinct lists of first turns themselves; every node is counted at each of its ancestors.
TRIE = f"""
WITH RECURSIVE crc0 AS (SELECT i::BIGINT AS i, i::BIGINT AS c FROM range(256) t(i)), {_CRC}, crc AS (SELECT list(c ORDER BY i) AS places FROM crc8),
convs AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, turns, ({_CONVERSATION_CRC}) % 9 AS h FROM convs, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1 : c.h], c.turns[c.h + 1 :]) AS turns FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, d, turns[1 : d] AS said, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, said, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(any_value(said[d].text)), 0) AS saved,
  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM prefixes GROUP BY d, said),
children AS (SELECT d - 1 AS d, said[1 : d - 1] AS said, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
marked AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.said = n.said),
above AS (SELECT e, said[1 : e] AS said, saved, n_children = 0 AS leaf FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM marked)),
sums AS (SELECT e, said, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM marked n JOIN sums s ON s.e = n.d AND s.said = n.said LEFT JOIN nodes p ON p.d = n.d - 1 AND p.said = n.said[1 : n.d - 1]"""

#: All anchors against all rows.
NEGATIVES = """
WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM
  (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM
  (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scores WHERE same) WHERE n <= 5),
ranked AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""
