"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from fedsight.llm import licenses, quality


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Lower-cased runs of letters and digits of a text.
_LETTER_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_WHITE = r"[\x20\x09-\x0D]+"

LICENSE_SQL = f"""
WITH templates(license, gram, m) AS (VALUES {", ".join(f"({_text(n)}, {_text(g)}, {len(gs)})"
    for n, gs in licenses.template_bigrams(licenses.TEMPLATES).items() for g in gs)}),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
    string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), [coalesce(text, '')])) AS unit FROM documents),
words AS (SELECT doc_id, unit, {_LETTER_WORDS.format("unit")} AS w FROM units),
grams AS (SELECT doc_id, unit, unnest(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS gram FROM words),
sized AS (SELECT doc_id, unit, gram, count(*) OVER (PARTITION BY doc_id, unit) AS n FROM grams),
dices AS (SELECT doc_id, unit, license, round(2.0 * count(*) / (n + m), 9) AS dice FROM sized JOIN templates USING (gram)
    GROUP BY doc_id, unit, license, n, m)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM dices WHERE dice >= 0.8 GROUP BY doc_id, license
"""

_ITEM = _LETTER_WORDS.format("text")
_GRAMS = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]"
DECONTAMINATION_SQL = f"""
WITH items AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS gram FROM (SELECT item_id, {_ITEM} AS w FROM benchmark)
    WHERE item_id IS NOT NULL AND len(w) > 0),
sized AS (SELECT item_id, gram, count(*) OVER (PARTITION BY item_id) AS q FROM items),
grams AS (SELECT DISTINCT doc_id, w, unnest({_GRAMS}) AS gram FROM (SELECT doc_id, {_ITEM} AS w FROM documents)
    WHERE doc_id IS NOT NULL AND len(w) > 0),
found AS (SELECT doc_id, w, item_id, q, count(*) AS n FROM grams JOIN sized USING (gram) GROUP BY doc_id, w, item_id, q)
SELECT doc_id, item_id, q AS n_item_shingles, max(n) AS n_shared, max(n) / q AS containment FROM found
WHERE n >= ceil(q * 0.8 - 1e-9) GROUP BY doc_id, item_id, q
"""

_WORD_LIST = "[" + ", ".join(_text(w) for w in quality.WORDS) + "]"
_LANGS = "(" + ", ".join(_text(x) for x in quality.COMMON_WORDS) + ")"
_JS = ("0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)")
_LETTERS = r"regexp_replace({0}, '\p{{L}}+', '', 'g')"
QUALITY_SQL = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce(text, '') AS t FROM documents),
parts AS (SELECT r, doc_id, lang, text, t, list_filter(string_split_regex(t, '{_WHITE}'), lambda x: x <> '') AS w,
    list_filter(string_split_regex(lower(regexp_replace(t, '{quality.PUNCTUATION.replace("'", "''")}', '', 'g')), '{_WHITE}'), lambda x: x <> '') AS pw,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(t) AS n, length({_LETTERS.format("t")}) AS a, length(regexp_replace({_LETTERS.format("t")}, '{_WHITE}', '', 'g')) AS b,
    length(regexp_replace(t, '{_WHITE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '{quality.PUNCTUATION.replace("'", "''")}', '', 'g')) AS punct FROM rows),
classes AS (SELECT r, lang, text, unnest(['letter', 'space', 'digit', 'punctuation', 'other']) AS class,
    unnest([n - a, a - b, least(digit, b), punct, b - least(digit, b) - punct]) AS c FROM parts),
class_ref AS (SELECT lang, class, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM classes
    WHERE lang IN {_LANGS} AND text IS NOT NULL GROUP BY lang, class),
words AS (SELECT r, lang, text, CASE WHEN list_contains({_WORD_LIST}, word) THEN word ELSE '' END AS word
    FROM (SELECT r, lang, text, unnest(pw) AS word FROM parts)),
counts AS (SELECT r, word, count(*) AS k FROM words GROUP BY r, word),
all_words AS (SELECT lang, word, count(*) AS k FROM words WHERE lang IN {_LANGS} AND text IS NOT NULL GROUP BY lang, word),
langs AS (SELECT DISTINCT lang FROM class_ref),
word_ref AS (SELECT l.lang, b.word, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY l.lang) AS q
    FROM langs l CROSS JOIN (SELECT unnest(list_append({_WORD_LIST}, '')) AS word) b LEFT JOIN all_words a ON a.lang = l.lang AND a.word = b.word),
class_js AS (SELECT r, lang, sqrt(greatest(0, sum({_JS}))) AS d FROM (SELECT c.r, f.lang, f.q, c.c / p.n AS p FROM classes c
    JOIN parts p ON p.r = c.r AND p.n > 0 JOIN class_ref f ON f.class = c.class) GROUP BY r, lang),
word_js AS (SELECT r, lang, sqrt(greatest(0, sum({_JS}))) AS d FROM (SELECT p.r, f.lang, f.q, coalesce(k, 0) / len(p.pw) AS p FROM parts p
    JOIN word_ref f ON len(p.pw) > 0 LEFT JOIN counts c ON c.r = p.r AND c.word = f.word) GROUP BY r, lang),
near AS (SELECT p.r, l.lang, coalesce(c.d, 1) AS c, coalesce(w.d, 1) AS w FROM parts p CROSS JOIN langs l
    LEFT JOIN class_js c ON c.r = p.r AND c.lang = l.lang LEFT JOIN word_js w ON w.r = p.r AND w.lang = l.lang),
nearest AS (SELECT r, lang, round(c, 6) AS c, round(w, 6) AS w FROM near
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY round(c + w, 9), lang) = 1),
windows AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY r),
base AS (SELECT p.*, len(p.w) AS n_words, coalesce(x.n, 0) AS n_repeat_words, y.lang AS nearest, y.c, y.w AS wd,
    len(p.w) < 50 OR 100 * coalesce(x.n, 0) > 50 * len(p.w) AS base_failed
    FROM parts p LEFT JOIN repeats x ON x.r = p.r LEFT JOIN nearest y ON y.r = p.r)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
    nearest, c AS class_distance, wd AS word_distance,
    NOT base_failed AND NOT ((lang IS NULL OR lang IN (SELECT lang FROM langs))
        AND coalesce((n >= 200 AND c > 0.2) OR (len(pw) >= 100 AND wd > 0.36), false)) AS kept FROM base
"""
