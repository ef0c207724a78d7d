"""DuckDB queries for operators whose whole result plain SQL can express."""

from __future__ import annotations

from monthpick.llm import chat_tree

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def substring_dedup(window: int = 13) -> str:
    """Words covered by a window that also starts in a document with a smaller doc_id (a null one counts as larger than all)."""
    shifted = " || chr(10) || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(window))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT r, doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM docs)),
windows AS (SELECT r, doc_id, k, w, md5({shifted}) AS win FROM words WINDOW o AS (PARTITION BY r ORDER BY k)),
firsts AS (SELECT win, min(coalesce(doc_id, 9223372036854775807)) AS d FROM windows WHERE win IS NOT NULL GROUP BY win),
marked AS (SELECT r, k, w, coalesce(firsts.d < coalesce(doc_id, 9223372036854775807), FALSE) AS starts FROM windows LEFT JOIN firsts USING (win)),
cut AS (SELECT r, k, w, bool_or(starts) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM cut GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""


_CLOSURE = """reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
roots AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""


def embedding_links(threshold: float = 0.95) -> str:
    """Cosine of all pairs of vectors of one length, and the smallest id reachable by links."""
    return f"""
WITH RECURSIVE rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nodes AS MATERIALIZED (SELECT vec_id AS id, v FROM rows WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON len(x.v) = len(y.v) AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= {threshold}),
{_CLOSURE}, degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(degree.n, 0) AS n_links, coalesce(roots.component_id, vec_id) AS component_id, vec_id = coalesce(roots.component_id, vec_id) AS kept
FROM rows LEFT JOIN degree ON vec_id = degree.id LEFT JOIN roots ON vec_id = roots.id
"""


def jaccard_classes(words: int = 5) -> str:
    """Sets of distinct shingles, intersections by a join on shingles, and the smallest id reachable by links."""
    gram = " || chr(10) || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(words))
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
words AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM docs WHERE len(ws) >= {words}),
shingles AS MATERIALIZED (SELECT DISTINCT id, md5(s) AS s FROM (SELECT id, {gram} AS s FROM words WINDOW o AS (PARTITION BY id ORDER BY k)) WHERE s IS NOT NULL
  UNION ALL SELECT id, md5(array_to_string(ws, chr(10))) FROM docs WHERE len(ws) BETWEEN 1 AND {words - 1}),
nodes AS MATERIALIZED (SELECT id, count(*) AS n FROM shingles GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM shingles x JOIN shingles y USING (s) WHERE x.id <> y.id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN nodes p ON a = p.id JOIN nodes q ON b = q.id WHERE 100 * common >= 75 * (p.n + q.n - common)),
{_CLOSURE}
SELECT docs.id AS doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, docs.id) AS component_id FROM docs LEFT JOIN nodes ON nodes.id = docs.id LEFT JOIN roots ON roots.id = docs.id
"""


def chat_digests() -> str:
    """Turns in order, digests, and the length that the template and its escapes give."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    special = "".join("\\" + c if c in "\\[]<>/" else c for c in "|".join(["\\", *chat_tree.CONTROL]))
    escaped = lambda c: f"length(regexp_replace({c}, {quote('(' + special + ')')}, {quote(chr(92) * 2 + chr(92) + '1')}, 'g'))"
    fixed = " ".join(f"WHEN {quote(role)} THEN {len(a) + len(b)}" for role, (a, b) in chat_tree.TEMPLATE.items())
    named = sum(map(len, chat_tree.NAMED))
    marked = quote("</s>[INST] ok [/INST]")
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {marked}), (-7, 1, 'assistant', {marked}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({escaped('text')} + CASE role {fixed} ELSE {named} + {escaped('role')} END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


#: The table of the CRC, and the CRC of a text's bytes by it (``t``).
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) x(i)))"


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def importance(buckets: int = 10_000, min_words: int = 20, percent: int = 5, seed: int = 42) -> str:
    """Windows of up to three words, CRC by its table over their bytes, counts, gains and the draw."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH {_CRC_TABLE},
texts AS (SELECT TRUE AS is_doc, row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents
  UNION ALL SELECT FALSE, row_number() OVER (), NULL, {words('text')} FROM benchmark),
words AS (SELECT is_doc, r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM texts),
runs AS (SELECT is_doc, r, w AS one, w || ' ' || lead(w) OVER o AS two, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS three FROM words WINDOW o AS (PARTITION BY is_doc, r ORDER BY k)),
features AS MATERIALIZED (SELECT is_doc, r, unnest([one, two, three]) AS f FROM runs),
coded AS MATERIALIZED (SELECT f, {_crc('f')} % {buckets} AS bucket FROM (SELECT DISTINCT f FROM features WHERE f IS NOT NULL), crc_table),
counts AS (SELECT bucket, count(*) FILTER (WHERE is_doc) AS s, count(*) FILTER (WHERE NOT is_doc) AS t FROM features JOIN coded USING (f) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {buckets})) / ((s + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN coded USING (f) JOIN gains USING (bucket) WHERE is_doc GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE is_doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= {min_words} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k, count(*) OVER (PARTITION BY n >= {min_words}) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= {min_words} AND k <= {percent} * able // 100 THEN k END AS rank FROM ranked
"""


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _edited(x: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {x}.c + {cost}, 'k': {x}.k || '{letter}', 'o': {x}.o || {line}}}"


def _inserted(x: str) -> str:
    """States after one more insert where that is cheaper (or as cheap, with a lesser audit)."""
    user, reply = "'user:' || chr(10)", "'assistant:' || chr(10)"
    to_user = ", ".join(_edited(f"{x}.{q}", "3", "I", user) for q in "bsa")
    return f"{{'b': {x}.b, 's': {x}.s, 'u': list_min([{x}.u, {to_user}]), 'a': list_min([{x}.a, {_edited(f'{x}.u', '3', 'I', reply)}])}}"


def conversation_repair() -> str:
    """Damage, faults, and the cheapest edits row by row over all four states, each with its cost, audit and text."""
    closed = lambda x, body: _let("y", _inserted(x), _let("z", _inserted("y"), body))
    line, new = "r.role || ':' || r.text || chr(10)", lambda role: f"'{role}:' || r.text || chr(10)"
    go = {q: _edited(f"z.{q}", "4", "D") for q in "bsua"}
    keep = lambda q, i: f"CASE WHEN r.i = '{i}' AND NOT r.must THEN {_edited(f'z.{q}', 'r.extra', 'K', line)} END"
    name = lambda q, role: f"CASE WHEN NOT r.must THEN {_edited(f'z.{q}', '3 + r.extra', 'R', new(role))} END"
    to_user = ", ".join([go["u"], *[keep(q, "u") for q in "bsa"], *[name(q, "user") for q in "bsa"]])
    to_reply = ", ".join([go["a"], keep("u", "a"), name("u", "assistant")])
    step = f"{{'b': {go['b']}, 's': list_min([{go['s']}, {keep('b', 's')}]), 'u': list_min([{to_user}]), 'a': list_min([{to_reply}])}}"
    state = lambda c: f"{{'c': {c}::BIGINT, 'k': '', 'o': ''}}"
    start = f"{{'b': {state(0)}, 's': {state(10**9)}, 'u': {state(10**9)}, 'a': {state(10**9)}}}"
    row = lambda i, must, extra, role, text, st: f"{{'i': {i}, 'must': {must}, 'extra': {extra}::BIGINT, 'role': {role}, 'text': {text}, 'st': {st}}}"
    folded = f"list_reduce(list_prepend({row(chr(39) * 2, 'FALSE', '0', chr(39) * 2, chr(39) * 2, start)}, rows), lambda p, r: {row('r.i', 'r.must', 'r.extra', 'r.role', 'r.text', closed('p.st', step))}).st"
    last = closed("e", "list_min([z.b, z.a])")
    blanks = "' ' || " + " || ".join(f"chr({c})" for c in range(9, 14))
    return f"""
WITH {_CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT given.*, {_crc('key')} % 20 AS kind FROM given, crc_table),
damaged AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS i, right(rtrim(text, {blanks}), 1) AS ending FROM damaged),
judged AS (SELECT *, ending = '' AS is_blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS is_again, ending NOT IN ('.', '!', '?') AS is_cut, lag(i) OVER (PARTITION BY conv ORDER BY n) AS before FROM placed),
grouped AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank, count(*) FILTER (WHERE is_again AND NOT is_blank) AS duplicate,
  count(*) FILTER (WHERE is_cut AND NOT is_blank AND NOT is_again) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
  list({row('i', 'is_blank OR is_again', 'CASE WHEN is_cut THEN 3 ELSE 0 END', 'role', 'text', start)} ORDER BY n) AS rows FROM judged GROUP BY conv),
ended AS (SELECT * EXCLUDE (rows), {folded} AS e FROM grouped),
done AS (SELECT * EXCLUDE (e), {last} AS x FROM ended)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.k, '') AS audit, sha256(coalesce(left(x.o, length(x.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) ids LEFT JOIN done USING (conv)
"""


ORACLES = {"op1_substring_dedup": substring_dedup(), "op3_embedding_graph": embedding_links(), "op9_jaccard_join": jaccard_classes(), "op10_chat_tree": chat_digests(), "op11_conversation_repair": conversation_repair(), "op12_importance": importance()}
