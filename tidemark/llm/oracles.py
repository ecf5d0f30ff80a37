"""DuckDB SQL of the text operators that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, licenses, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical lines of a text, as a list."""
    made = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|©)(?:[^\p{{L}}\p{{N}}\n]+(?:\(c\)|©|[0-9])|[^\p{{L}}\n]*[0-9]{{4}})[^\n]*$', '', 'g')"
    made = rf"regexp_replace({made}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for found, stands in licenses.OTHERS:
        made = rf"regexp_replace({made}, '\b{found}\b', '{stands}', 'g')"
    made = rf"regexp_replace({made}, 'licenc(e|es|ed|ing|ee|ees|or|ors)\b', 'licens\1', 'g')"
    return f"list_filter(list_transform(string_split({made}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def licenses_sql() -> str:
    known = ", ".join(f"({k}, {_quoted(a)}, {_quoted(kind)}, {_quoted(t)})" for k, (a, kind, t) in enumerate(licenses.KNOWN))
    return f"""WITH known AS (SELECT arg_min(license, k) AS license, arg_min(kind, k) AS kind, arg_min(n, k) AS n, canon FROM (SELECT k, license, kind, len({_canonical('text')}) AS n, array_to_string({_canonical('text')}, ' ') AS canon FROM (VALUES {known}) t(k, license, kind, text)) GROUP BY canon),
 docs AS (SELECT row_number() OVER () AS r, doc_id, {_canonical('text')} AS lines FROM documents),
 units AS (SELECT r, doc_id, true AS whole, array_to_string(lines, ' ') AS unit FROM docs
  UNION ALL SELECT r, doc_id, false, array_to_string(lines[i:i + h - 1], ' ') FROM (SELECT r, doc_id, lines, h, unnest(range(1, len(lines) - h + 2)) AS i FROM docs, (SELECT DISTINCT n AS h FROM known WHERE kind = 'notice' UNION SELECT 1)))
 SELECT doc_id, min(license) FILTER (whole) AS license, count(*) FILTER (NOT whole) AS n_notices, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole), '') AS notices
 FROM units JOIN known ON canon = unit GROUP BY r, doc_id"""


def _matches(pattern: str) -> str:
    """[(m, s, e)] of all matches: the lengths of pieces and matches before give the places."""
    p = _quoted(pattern)
    return (
        f"CASE WHEN regexp_matches(t, {p}) THEN list_transform(range(len(regexp_extract_all(t, {p}))), lambda i: {{'m': regexp_extract_all(t, {p})[i + 1], "
        f"'s': list_sum(list_transform(string_split_regex(t, {p})[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i], lambda x: length(x))), 0)}}) ELSE [] END"
    )


def secrets_sql() -> str:
    w = secrets.WINDOW
    windows = f"list_transform(range(1, length(m) - {w - 2}), lambda i: string_split(substring(m, i, {w}), ''))"
    entropy = f"list_max(list_transform({windows}, lambda c: log2({w}) - list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) * log2(len(list_filter(c, lambda y: y = x))))) / {w}))"
    same8 = "len(list_filter(range(1, length(m) - 6), lambda i: substring(m, i, 8) = repeat(substring(m, i, 1), 8))) > 0"
    holds = lambda has, lacks: " AND ".join([f"regexp_matches(m, {_quoted(p)})" for p in has] + [f"NOT regexp_matches(m, {_quoted(p)})" for p in lacks])
    allowed = " OR ".join(f"({holds(*x)})" for x in secrets.ALLOWED[:-1]) + f" OR {same8}"
    # The engine has no look-around: a class's candidates are whole runs of the wider class that it must not adjoin.
    wider = {"entropy_base64": ("[A-Za-z0-9+/_-]{20,}={0,2}", "true")}
    wider |= {c[0]: ("[A-Za-z0-9]{20,}", f"regexp_matches(m, '^{c[1].split('{')[0].split(')')[-1]}+$')") for c in secrets.CLASSES[:3]}
    least = " ".join(f"WHEN {3 + k} THEN " + (f"CASE WHEN regexp_matches(m, '[0-9]') THEN {c[3]} ELSE {c[4]} END" if c[4] else str(c[3])) for k, c in enumerate(secrets.CLASSES))
    part = lambda kind, rank, pattern, keep: f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, u.m AS m, u.s AS s FROM (SELECT doc_id, unnest({_matches(pattern)}) AS u FROM d) WHERE {keep}"
    assign = secrets.ASSIGN.replace(r"\x20", " ")
    found = " UNION ALL ".join([
        part("assign", 0, assign, f"length(regexp_extract(u.m, {_quoted(assign)}, 2)) >= 6"),
        part("access", 1, secrets.ACCESS, "true"),
        part("hex", 2, secrets.HEX, "true"),
        *(part(c[0], 3 + k, wider[c[0]][0], f"{wider[c[0]][1].replace('(m,', '(u.m,')} AND {holds(c[2], []).replace('(m,', '(u.m,')}") for k, c in enumerate(secrets.CLASSES)),
    ])
    span = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
 k AS (SELECT * FROM f WHERE rank < 3 OR (NOT ({allowed}) AND {entropy} >= CASE rank {least} END)),
 g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c, string_agg({span}, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg({span}, ',' ORDER BY s, rank) AS spans FROM k GROUP BY 1)
 SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def ranked_search_sql() -> str:
    """Every item against every document that shares a term with it."""
    found = lambda text: rf"list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found('text')} AS ts FROM documents),
 s AS (SELECT count(*) FILTER (len(ts) > 0) AS total, sum(len(ts))::BIGINT AS length FROM d),
 p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY 1, 2),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY 1),
 i AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest({found('text')}) AS term FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)) GROUP BY 1, 2, 3),
 m AS (SELECT r, doc_id, 75 + (25 * len(ts) * total) // length AS m FROM d, s WHERE len(ts) > 0),
 c AS (SELECT q, any_value(item_id) AS item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score, any_value(doc_id) AS doc_id FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, r)
 SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) WHERE rank <= 20"""


def spelling_sql() -> str:
    """Words one edit apart share what is left without one letter: the same place for a replaced letter, any place for an inserted one.

    The engine has no crc32, so the table of its 256 remainders is made by eight halvings each and folded over the bytes.
    """
    table = "(SELECT list(list_reduce(list_prepend(k::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS crc FROM range(256) t(k))"
    run = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_transform(range(length(hex(key)) // 2), lambda i: ('0x' || substring(hex(key), 2 * i + 1, 2))::BIGINT)"
    return rf"""WITH RECURSIVE t AS {table},
 r AS (SELECT doc_id, {run} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
 k AS (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM r),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: xor(a >> 8, crc[xor(a, b) % 256 + 1])), 4294967295) AS h FROM k, t),
 w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 x AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)),
 e AS (SELECT a.word AS word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN x b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM w a JOIN x b ON a.word = b.rest),
 g AS (SELECT word, count(*) AS n_near, max(m) AS best FROM e GROUP BY 1),
 b AS (SELECT e.word, min(near) AS near FROM e JOIN g ON g.word = e.word AND m = best GROUP BY 1),
 f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 10 * w.n THEN best END AS form_n, CASE WHEN best >= 10 * w.n THEN near END AS form FROM w LEFT JOIN g USING (word) LEFT JOIN b USING (word)),
 way(word, root, step) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
 SELECT f.word AS word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY 1) z ON z.word = f.word"""


def chat_sql() -> str:
    """Turn digests straight from the rows, and the length of all windows from prefix sums of turns' tokens."""
    trial = _quoted(chat.TRIAL)
    body = r"regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g')"
    return rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {trial}), (-7, 1, 'assistant', {trial}))),
 a AS (SELECT *, {chat.MARKS} + len(regexp_extract_all(text, '{chat.TOKEN}')) AS tokens, length('<turn ' || replace(url_encode(role), '%20', '+') || '>' || chr(10) || {body} || '</turn>' || chr(10)) AS size FROM r),
 b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - sum(tokens) OVER (PARTITION BY conv_id, turn, role, text) AS until, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM a),
 c AS (SELECT *, CASE WHEN total > {chat.SEGMENT} THEN until // {chat.SEGMENT} ELSE 0 END AS seg, place = 1 AND role = 'system' AS lead FROM b),
 d AS (SELECT *, greatest({chat.BUDGET - chat.HISTORY} - coalesce(max(tokens) FILTER (lead) OVER (PARTITION BY conv_id), 0), {chat.BUDGET // 4}) // 2 AS stride, sum(CASE WHEN lead THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS before FROM c),
 e AS (SELECT *, tokens > stride AS alone, sum((tokens > stride)::INT) OVER w AS n_alone, sum(CASE WHEN tokens > stride THEN 0 ELSE tokens END) OVER w AS filled FROM d WHERE NOT lead WINDOW w AS (PARTITION BY conv_id, seg ORDER BY place)),
 f AS (SELECT *, n_alone || ':' || alone || ':' || CASE WHEN alone THEN 0 ELSE (filled - 1) // stride END AS span FROM e),
 g AS (SELECT conv_id, seg, span, min(place) AS p0, min(before) AS b0, sum(size) AS own FROM f GROUP BY ALL),
 h AS (SELECT g.conv_id, g.p0, any_value(own) + coalesce(sum(p.size), 0) AS chars FROM g LEFT JOIN e p ON p.conv_id = g.conv_id AND p.place < g.p0 AND p.before >= g.b0 - {chat.HISTORY} GROUP BY 1, 2),
 i AS (SELECT conv_id, count(*) AS windows, sum(chars) AS chars FROM h GROUP BY 1),
 j AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, coalesce(any_value(size) FILTER (lead), 0) AS lead FROM c GROUP BY 1)
 SELECT j.conv_id AS conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (coalesce(chars, 0) + lead * greatest(coalesce(windows, 0), 1))::BIGINT AS formatted_chars FROM j LEFT JOIN i ON i.conv_id IS NOT DISTINCT FROM j.conv_id"""
