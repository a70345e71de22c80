"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from namewright.llm.quality_rules import CHAR_CLASSES, COMMON_WORDS

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to FROM p LEFT JOIN f ON p.html = f.html"""

NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node"""


def quality(min_words: int = 20, max_repeat_percent: int = 30, min_chars_for_js: int = 200, min_words_for_js: int = 60, max_char_js: float = 0.33, max_word_js: float = 0.33, max_sum_js: float = 0.46) -> str:
    """The counting rules and distances of quality_rules.score(), with exact medians."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    left, classes = "t", []
    for name, regex in CHAR_CLASSES.items():
        after = f"regexp_replace({left}, {quoted(regex)}, '', 'g')"
        classes.append(f"SELECT doc_id, '{name}' AS k, CAST(length({left}) - length({after}) AS DOUBLE) AS n FROM d")
        left = after
    classes.append(f"SELECT doc_id, 'left' AS k, CAST(length({left}) AS DOUBLE) AS n FROM d")
    listed = ", ".join(f"('{lang}', {i}, {quoted(w)})" for lang, ws in COMMON_WORDS.items() for i, w in enumerate(ws))
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    js = f"sqrt(greatest(0, sum({half('p', 'q')} + {half('q', 'p')}) / 2))"

    def distance(hist: str) -> str:
        return f"""(SELECT doc_id, {js} AS js FROM (SELECT h.doc_id, h.n / t.n AS p, coalesce(r.q, 0) / u.q AS q FROM {hist} h JOIN d ON d.doc_id = h.doc_id JOIN (SELECT doc_id, sum(n) AS n FROM {hist} GROUP BY 1) t ON t.doc_id = h.doc_id
            JOIN {hist}_ref r ON r.lang = d.lang AND r.k = h.k JOIN (SELECT lang, sum(q) AS q FROM {hist}_ref GROUP BY 1) u ON u.lang = d.lang WHERE t.n > 0 AND u.q > 0) GROUP BY doc_id)"""

    ref = lambda hist: f"{hist}_ref AS (SELECT d.lang, h.k, quantile_disc(h.n / t.n, 0.5) AS q FROM {hist} h JOIN (SELECT doc_id, sum(n) AS n FROM {hist} GROUP BY 1) t ON t.doc_id = h.doc_id JOIN d ON d.doc_id = h.doc_id JOIN b ON b.doc_id = h.doc_id WHERE NOT b.base_failed AND d.lang IN ({', '.join(map(quoted, COMMON_WORDS))}) AND t.n > 0 GROUP BY 1, 2)"
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
again AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(w) < {min_words} OR 100 * coalesce(again.n, 0) > {max_repeat_percent} * len(w) AS base_failed
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
chars AS ({' UNION ALL '.join(classes)}),
listed(lang, k, word) AS (VALUES {listed}),
found AS (SELECT d.doc_id, l.k, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) d JOIN listed l ON l.lang = d.lang AND (d.x = l.word OR d.x = upper(substr(l.word, 1, 1)) || substr(l.word, 2)) GROUP BY 1, 2),
every AS (SELECT d.doc_id, l.k, CAST(coalesce(f.n, 0) AS DOUBLE) AS n FROM d JOIN listed l ON l.lang = d.lang LEFT JOIN found f ON f.doc_id = d.doc_id AND f.k = l.k),
words AS (SELECT * FROM every UNION ALL SELECT e.doc_id, 99, max(b.n_words) - sum(e.n) FROM every e JOIN b ON b.doc_id = e.doc_id GROUP BY 1),
{ref('chars')}, {ref('words')},
j AS (SELECT b.*, CASE WHEN length(d.t) >= {min_chars_for_js} THEN c.js END AS cjs, CASE WHEN b.n_words >= {min_words_for_js} THEN w.js END AS wjs FROM b JOIN d ON d.doc_id = b.doc_id LEFT JOIN {distance('chars')} c ON c.doc_id = b.doc_id LEFT JOIN {distance('words')} w ON w.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(cjs, 0) > {max_char_js} OR coalesce(wjs, 0) > {max_word_js} OR coalesce(cjs + wjs, 0) > {max_sum_js}) AS kept FROM j"""


ORACLE = {"op2_warc": WARC, "op4_near_dedup": NEAR, "op5_quality_rules": quality()}
