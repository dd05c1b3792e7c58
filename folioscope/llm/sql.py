"""Oracle SQL of the operators on texts that SQL can express: brute force over the whole tables."""

from __future__ import annotations

from folioscope.llm.lookalike import _INVISIBLE, CONFUSABLE, LEAST, RADICALS
from folioscope.plans.sql import ONCE, compat, text

#: White space that counts as a blank; line breaks do not.
_BLANKS = "[ \\t\\x0b\\f\\r\\x1c-\\x1f\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{2800}]+"


def _class(pattern: str) -> str:
    """A class of characters with the ones beyond ASCII written as numbers; SQL strings hold no zero byte."""
    return "[" + "".join(c if " " <= c <= "~" else f"\\x{{{max(1, ord(c)):X}}}" for c in pattern[1:-1]) + "]"


def form(c: str) -> str:
    """What a text looks like: plain characters, composed accents, one blank for many, nothing invisible."""
    alike = ("".join([*CONFUSABLE, *RADICALS]), "".join([*CONFUSABLE.values(), *RADICALS.values()]))
    seen = f"regexp_replace({c}, {text(_class(_INVISIBLE.pattern))}, '', 'g')"
    return f"regexp_replace(nfc_normalize(translate({compat(seen)}, {text(alike[0])}, {text(alike[1])})), {text(_BLANKS)}, ' ', 'g')"


def look_alike_sql() -> str:
    """Pairs of passages that look the same and differ in code points."""
    return f"""WITH f AS (SELECT id, raw_text, {form('raw_text')} AS form FROM {ONCE} WHERE id IS NOT NULL AND raw_text IS NOT NULL), k AS (SELECT * FROM f WHERE length(regexp_replace(form, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= {LEAST})
        SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.form = b.form AND a.id < b.id AND a.raw_text <> b.raw_text"""


def near_sql(similarity: float, shingle: int) -> str:
    """Pairs of passages by counting all sequences that any two of them share."""
    return f"""WITH f AS (SELECT id, regexp_replace(lower({form('raw_text')}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s FROM {ONCE} WHERE id IS NOT NULL AND raw_text IS NOT NULL), k AS (SELECT * FROM f WHERE length(s) >= {LEAST}), u AS (SELECT s, row_number() OVER (ORDER BY s) AS n FROM (SELECT DISTINCT s FROM k)),
        g AS (SELECT DISTINCT n, substring(s, i, {shingle}) AS gram FROM (SELECT n, s, unnest(range(1, length(s) - {shingle - 2})) AS i FROM u)), c AS (SELECT n, count(*) AS size FROM g GROUP BY 1),
        p AS (SELECT a.n AS x, b.n AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.n < b.n GROUP BY 1, 2), q AS (SELECT x, y FROM p JOIN c a ON a.n = x JOIN c b ON b.n = y WHERE common >= {similarity} * (a.size + b.size - common) UNION ALL SELECT n, n FROM u),
        m AS (SELECT id, n FROM k JOIN u USING (s)) SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM q JOIN m a ON a.n = x JOIN m b ON b.n = y WHERE x < y OR a.id < b.id"""
