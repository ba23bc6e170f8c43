"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, text: str, pattern: str) -> str:
    """rid, the key, j (from 1) and word of every word of every row."""
    return f"SELECT rid, {key}, unnest(w) word, unnest(range(1, len(w) + 1)) j FROM (SELECT row_number() OVER () rid, {key}, regexp_extract_all({text}, '{pattern}') w FROM {table})"


SUBSTRING_DEDUP = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') w FROM documents),
x AS MATERIALIZED (SELECT rid, doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) j FROM d),
g AS (SELECT rid, j, string_agg(word, ' ') OVER s h, count(*) OVER s n FROM x WINDOW s AS (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS MATERIALIZED (SELECT rid, j FROM (SELECT rid, j, count(*) OVER (PARTITION BY md5(h)) k FROM g WHERE n = 35) WHERE k > 1),
hit AS (SELECT DISTINCT rid, unnest(range(j, j + 35)) j FROM r),
kept AS (SELECT rid, count(*) n, string_agg(word, ' ' ORDER BY j) t FROM x ANTI JOIN hit USING (rid, j) GROUP BY 1)
SELECT doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

DECONTAMINATION = rf"""
WITH b AS MATERIALIZED ({_words("benchmark", "item_id", _LOWER, _ALNUM_WORDS)}),
bw AS MATERIALIZED (SELECT DISTINCT item_id, n, k FROM (SELECT item_id, j, count(*) OVER s n, string_agg(word, ' ') OVER s k, count(*) OVER (PARTITION BY rid) size FROM b WINDOW s AS (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13 OR j = 1 AND size < 13),
d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM_WORDS}') w FROM documents),
x AS (SELECT rid, unnest(w) word, unnest(range(1, len(w) + 1)) j FROM d),
s AS (SELECT rid, j, list(word) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) l FROM x),
c AS MATERIALIZED (SELECT s.rid, s.j, z.n, array_to_string(s.l[1:z.n], ' ') k FROM s, (SELECT DISTINCT n FROM bw) z WHERE len(s.l) >= z.n),
m AS MATERIALIZED (SELECT c.rid, c.j, bw.n, bw.item_id FROM c JOIN bw ON bw.n = c.n AND bw.k = c.k),
h AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(j, j + n)) p FROM m) GROUP BY 1),
i AS (SELECT rid, count(*) n_items, string_agg(item, ',' ORDER BY item) t FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) item FROM m) GROUP BY 1)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(t, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({_LOWER}, '{_SPACE_WORDS}') w FROM documents),
x AS (SELECT rid, unnest(w) word, unnest(range(1, len(w) + 1)) j FROM d),
g AS (SELECT rid, string_agg(word, ' ') OVER s h, count(*) OVER s n FROM x WINDOW s AS (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
t AS MATERIALIZED (SELECT DISTINCT rid, h FROM g WHERE n = 3 UNION SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS MATERIALIZED (SELECT rid, count(*) n FROM t GROUP BY 1),
p AS (SELECT a.rid a, b.rid b, count(*) k FROM t a JOIN t b ON a.h = b.h AND a.rid < b.rid GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n na ON na.rid = p.a JOIN n nb ON nb.rid = p.b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
s AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT rid a, rid b FROM d UNION SELECT w.a, s.b FROM w JOIN s ON s.a = w.b)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, min(o.doc_id) component_id FROM w JOIN d ON d.rid = w.a JOIN d o ON o.rid = w.b LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id, n.n
"""
