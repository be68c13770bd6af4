"""DuckDB SQL for the queries that SQL can express; none is used by the operators."""

from __future__ import annotations

import re

from . import licenses

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _words(column: str) -> str:
    return _FOLDED.format(_LOWER.format(f"coalesce({column}, '')"))


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_PLAIN} AS w FROM documents),
     g AS (SELECT k, doc_id, i, w[i : i + 12] AS g FROM (SELECT k, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
     m AS (SELECT k, i FROM (SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
     gone AS (SELECT DISTINCT k, p FROM (SELECT k, unnest(generate_series(i, i + 12)) AS p FROM m)),
     lost AS (SELECT k, list(p) AS ps FROM gone GROUP BY k)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (k)
"""

OP10 = f"""
WITH item AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, w[i : i + least(13, len(w)) - 1] AS g, least(13, len(w)) AS size
             FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
     doc AS (SELECT doc_id, {_words("text")} AS w FROM documents),
     place AS (SELECT doc_id, size, i, w[i : i + size - 1] AS g
               FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
                     FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
     hit AS (SELECT p.doc_id, p.i, p.size, n.item_id FROM place p JOIN win n ON p.g = n.g AND p.size = n.size),
     word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY doc_id),
     found AS (SELECT doc_id, list_sort(list(DISTINCT cast(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, cast(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def _template(text: str) -> str:
    """A template as a regular expression over words with one space before the first and after each."""
    out = " "
    for mark, low, high, word in re.findall(r"<<(/?opt|var (\d+)-(\d+))>>|([^\s<]+)", text):
        out += {"opt": "(?:", "/opt": ")?"}.get(mark, f"(?:[^ ]+ ){{{low},{high}}}" if mark else "".join(f"{w} " for w in word.replace(".", " ").split()))
    return out


def _license_sql() -> str:
    half = licenses.HALF_WORDS
    base = list(licenses.BASE.items())
    places = ", ".join(f"list_filter(generate_series(1, len(w)), lambda i: w[i : i + {len(p.split()) - 1}] = [{', '.join(repr(x) for x in p.split())}]) AS b{k}" for k, (p, _) in enumerate(base))
    marks = ", ".join(f"regexp_matches(s, '{_template(t)}') AS t{k}" for k, t in enumerate(licenses.TEMPLATES.values()))
    own = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(base))
    more = ", ".join(f"CASE WHEN t{k} THEN '{label}' END" for k, label in enumerate(licenses.TEMPLATES))
    parts = [(f"len(b{k}) > 0", licenses.Automaton(p, p).mandatory) for k, (p, _) in enumerate(base)]
    parts += [(f"t{k}", licenses.Automaton(label, t).mandatory) for k, (label, t) in enumerate(licenses.TEMPLATES.items())]
    rest = " * ".join(f"CASE WHEN {c} THEN {half}::DOUBLE / {half + n}::DOUBLE ELSE 1::DOUBLE END" for c, n in parts)
    joined = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents), j AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
     m AS (SELECT *, {places}, {marks} FROM j), a AS (SELECT *, list_concat({', '.join(f'b{k}' for k in range(len(base)))}) AS b FROM m)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(len(b) AS BIGINT) AS n_base, list_min(b) - 1 AS first_word, list_max(b) - 1 AS last_word,
       {joined.format(own)} AS base_labels, {joined.format(f"{own}, {more}")} AS labels, 1 - {rest} AS score
FROM a
"""


OP1 = _license_sql()

OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
     t AS (SELECT *, CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 WHEN 'system' THEN 18 ELSE 17 + len(url_encode(role)) END
                     + len(regexp_replace(text, '(\\*)(\[INST\]|\[/INST\]|\[ANS\]|<s>|</s>|<<SYS>>|<</SYS>>|\[TURN|\[/TURN\])', '\1\1\\\2', 'g')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(size) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || cast(page_id AS VARCHAR) || '>'
 || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
 || 'Content-Length: ' || cast(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

OP4 = f"""
WITH p AS (SELECT *, page_id // 16 AS leaf, cast('0x' || substr(md5(cast(page_id AS VARCHAR)), 1, 2) AS INTEGER) AS fate FROM pages),
     a AS (SELECT page_id, leaf, fate, strlen({_RECORD}) AS size, sha256({_RECORD}) AS digest FROM p),
     b AS (SELECT page_id, sha256({_RECORD}) AS found FROM (SELECT page_id, url, '~' || coalesce(html, '') AS html FROM p WHERE fate < 4)),
     n AS (SELECT leaf, sum(size) AS size FROM a GROUP BY leaf),
     o AS (SELECT leaf, cast(sum(size) OVER (ORDER BY leaf) - size AS BIGINT) AS range_start, cast(sum(size) OVER (ORDER BY leaf) AS BIGINT) AS range_end FROM n)
SELECT page_id, CASE WHEN fate < 4 THEN 'changed' WHEN fate < 6 THEN 'lost' ELSE 'added' END AS kind, leaf, range_start, range_end,
       CASE WHEN fate < 6 THEN digest END AS digest, CASE WHEN fate < 4 THEN found WHEN fate = 6 THEN digest END AS found_digest
FROM a JOIN o USING (leaf) LEFT JOIN b USING (page_id) WHERE fate <= 6
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, {_words("text")} AS w FROM documents),
     g AS (SELECT DISTINCT k, w[i : i + least(5, len(w)) - 1] AS g
           FROM (SELECT k, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
     c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.k <> y.k GROUP BY ALL),
     l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 5 * c >= 4 * (x.n + y.n - c)),
     r AS (SELECT k, k AS at FROM d UNION SELECT r.k, l.b FROM r JOIN l ON r.at = l.a),
     m AS (SELECT r.k, min(doc_id) AS class_id FROM r JOIN d ON r.at = d.k GROUP BY r.k),
     t AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, class_id, coalesce(n_links, 0) AS n_links
FROM d JOIN m USING (k) LEFT JOIN n USING (k) LEFT JOIN t USING (k)
"""

OP6 = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, {_PLAIN} AS w FROM documents),
     l AS (SELECT *, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM t),
     r AS (SELECT row_number() OVER () AS k, * FROM l),
     g AS (SELECT k, i, w[i : i + 7] AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 7)) AS i FROM r WHERE len(w) >= 8)),
     twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
     rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY k),
     c AS (SELECT r.k, doc_id, source, cast(len(w) AS BIGINT) AS n_words, cast(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  cast(len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  cast(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
           FROM r LEFT JOIN rep ON r.k = rep.k),
     f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  10 * n_symbols > word_chars OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS soft_failed FROM c),
     h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS b FROM f GROUP BY source),
     m AS (SELECT sum(b) / sum(n) AS mean, sum(n) AS total FROM h),
     v AS (SELECT any_value(mean) AS mean, sum(n * (b / n - mean) * (b / n - mean)) / any_value(total) AS spread FROM h, m),
     p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM v),
     s AS (SELECT source, round((b + mean * weight) / (n + weight), 6) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_rate > 0.5 AND soft_failed) AS kept, host_rate
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

OP8 = f"""
WITH d AS (SELECT doc_id, source, cast(len({_PLAIN}) AS BIGINT) AS size,
                  cast('0x' || substr(md5('17|' || coalesce(cast(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS u FROM documents),
     s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
     c AS (SELECT *, [3, 1, 2][(k - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
     o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS o, cast(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM c),
     l AS (SELECT *, (budget - coalesce(cast(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
                     / cast(sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
     t AS (SELECT source, source_size, least(cast(cap AS DOUBLE), w * max(level) OVER ()) AS target FROM l),
     g AS (SELECT *, CASE WHEN source_size > 0 THEN least(cast(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS whole FROM t),
     q AS (SELECT source, u, sum(size) AS size FROM d GROUP BY ALL),
     a AS (SELECT source, u, size, sum(size) OVER (PARTITION BY source ORDER BY u) AS upto FROM q),
     y AS (SELECT g.source, max(u) AS last FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source
           WHERE upto - size / 2 <= target - whole * source_size GROUP BY g.source)
SELECT doc_id, size, source_size, target, cast(size * least(whole + CASE WHEN u <= last THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source
"""

_VECTORS = """SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS q
       FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

OP11 = f"""
WITH v AS ({_VECTORS}),
     r AS (SELECT k, vec_id, q, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
     s AS (SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id, a.label = b.label AS same, cast(list_dot_product(cast(a.q AS DOUBLE[]), cast(b.q AS DOUBLE[])) AS BIGINT) AS score
           FROM r a JOIN r b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
     p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id NULLS LAST) <= 10
"""


def _rounds(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignments and codebooks of each round as common table expressions."""
    out = f"""
WITH v AS ({_VECTORS}),
     x AS (SELECT k, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS x FROM (SELECT k, q, unnest(generate_series(0, {parts - 1})) AS p FROM v)),
     b0 AS (SELECT p, e, x AS c FROM x JOIN (SELECT k, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM v) USING (k) WHERE e < {entries})"""
    for r in range(rounds + 1):
        out += f""",
     a{r} AS MATERIALIZED (SELECT k, p, x, e, d FROM (SELECT k, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{r} USING (p))
           QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY d, e) = 1)"""
        if r < rounds:
            out += f""",
     m{r} AS (SELECT p, e, list(cast(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
                SELECT p, e, i, sum(x[i]) AS total, count(*) AS n FROM (SELECT p, e, x, unnest(generate_series(1, len(x))) AS i FROM a{r}) GROUP BY ALL) GROUP BY p, e),
     b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))"""
    return out


OP13 = f"""{_rounds()},
     o AS (SELECT k, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, cast(sum(d) AS BIGINT) AS error FROM a2 GROUP BY k),
     h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (k), h
"""

ORACLES: dict[str, str] = {"op1_license_scan": OP1, "op3_chat_round_trip": OP3, "op4_warc_merkle_audit": OP4, "op5_ngram_jaccard_join": OP5, "op6_host_quality_rules": OP6, "op8_water_filling_mix": OP8, "op9_substring_dedup": OP9, "op10_benchmark_decontamination": OP10, "op11_hard_negatives": OP11, "op13_vector_codes": OP13}
