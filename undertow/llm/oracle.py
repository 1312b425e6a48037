"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from undertow.llm.licenses import template_rows

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _placed(words: str, table: str, key: str) -> str:
    """key, p, w: every word with its place."""
    return f"SELECT {key}, unnest(ws) w, generate_subscripts(ws, 1) p FROM (SELECT {key}, {words} ws FROM {table})"


# A window's key is its words with a space between; windows of all lengths that items have are looked for at each place.
DECONTAMINATE = f"""
WITH dw AS ({_placed(_WORDS, 'documents', 'doc_id')}), iw AS ({_placed(_WORDS, 'benchmark', 'item_id')}),
i AS (SELECT CAST(item_id AS VARCHAR) item, p, count(*) OVER (PARTITION BY item_id) c,
             list(w) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) l FROM iw WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(c, 10) n, array_to_string(l, ' ') k FROM i WHERE p <= c - least(c, 10) + 1),
d AS (SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) l FROM dw),
dn AS (SELECT doc_id, p, n, array_to_string(l[1:n], ' ') k FROM d JOIN (SELECT DISTINCT n FROM win) ON len(l) >= n),
hit AS (SELECT doc_id, p, dn.n, item FROM dn JOIN win ON win.n = dn.n AND win.k = dn.k),
places AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT DISTINCT doc_id, p, n, unnest(range(p, p + n)) q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM documents LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS ({_placed(_SPACED, 'documents', 'doc_id')}),
t AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id) c,
             list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) l FROM w),
sh AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') s FROM t WHERE p <= greatest(c - 2, 1)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
link AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) n_shingles, min(other) component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def licences() -> str:
    """All templates against all places: hits of an alignment, then the key phrases."""
    rows = template_rows()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    tpl = ", ".join(f"({i}, {text(label)}, {base}, {need}, {len(words)})" for i, label, base, words, _, need in rows)
    word = ", ".join(f"({i}, {at}, {text(w)})" for i, _, _, words, _, _ in rows for at, w in enumerate(words))
    key = ", ".join(f"({i}, {text(k)})" for i, _, _, _, keys, _ in rows for k in keys)
    return f"""
WITH w AS ({_placed(_WORDS, 'documents', 'doc_id')}), tpl(tpl, label, base, need, size) AS (VALUES {tpl}),
tw(tpl, tpos, w) AS (VALUES {word}), tk(tpl, k) AS (VALUES {key}),
line AS (SELECT doc_id, len({_WORDS}) n_words, ' ' || array_to_string({_WORDS}, ' ') || ' ' line FROM documents),
al AS (SELECT doc_id, tw.tpl, p - 1 - tpos AS place, count(*) hit FROM w JOIN tw USING (w) GROUP BY ALL),
st AS (SELECT al.*, label, base, size FROM al JOIN tpl USING (tpl) WHERE hit >= need),
lacks AS (SELECT DISTINCT doc_id, tpl FROM (SELECT DISTINCT doc_id, tpl FROM st) JOIN tk USING (tpl) JOIN line USING (doc_id) WHERE NOT contains(line, k)),
ok AS (SELECT * FROM st ANTI JOIN lacks USING (doc_id, tpl)),
per AS (SELECT doc_id, count(*) FILTER (base) n_base, min(place) FILTER (base) first_word, max(place) FILTER (base) last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels, max(hit/size) score FROM ok GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(first_word AS BIGINT) first_word, CAST(last_word AS BIGINT) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0) score
FROM line LEFT JOIN per USING (doc_id)
"""


# ``crc`` has the remainders of crc32 for single bytes; ``k`` the checksum of each number's digits.
TRIE = f"""
WITH crc AS (SELECT list(c ORDER BY i) tab FROM (SELECT i, list_reduce(range(8), lambda x, j: xor(x >> 1, (x & 1) * 3988292384), i) c FROM range(256) r(i))),
t AS (SELECT conv_id c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) id,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, id, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) pos FROM t),
k AS (SELECT c, count(*) own, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT)),
             lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 4 h FROM p, crc GROUP BY c, tab),
r AS (SELECT k.c, p.pos pl, id, w FROM k JOIN p ON p.c = k.c - k.c % 20 AND p.pos <= h
      UNION ALL SELECT k.c, p.pos + 1000000 pl, id, w FROM k JOIN p ON p.c = k.c AND p.pos > h),
s AS (SELECT k.c, coalesce(list(id ORDER BY pl) FILTER (id IS NOT NULL), []) l, coalesce(list(w ORDER BY pl) FILTER (id IS NOT NULL), []) ws FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
m AS (SELECT c, unnest(range(len(l) + 1)) d, l, ws FROM s),
n AS (SELECT list_slice(l, 1, d) k, d, min(c) c, count(*) n, any_value(CASE WHEN d > 0 THEN ws[d] ELSE 0 END) w,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '')) ends FROM m GROUP BY 1, 2),
kid AS (SELECT list_slice(k, 1, d - 1) k, count(*) kids FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) kids FROM n LEFT JOIN kid ON kid.k = n.k),
up AS (SELECT list_slice(k, 1, j) k, count(*) FILTER (kids = 0) leaves, sum((n - 1) * w) saved FROM (SELECT f.*, unnest(range(d + 1)) j FROM f) GROUP BY 1)
SELECT f.c conv_id, f.d depth, q.c parent_conv_id, f.n n_convs, f.kids n_children, up.leaves n_leaves, CAST(up.saved AS BIGINT) saved_tokens, f.ends ends_sha256
FROM f JOIN up ON up.k = f.k LEFT JOIN f q ON f.d > 0 AND q.d = f.d - 1 AND q.k = list_slice(f.k, 1, f.d - 1)
"""


def vector_codes(rounds: int = 6) -> str:
    """Rounds of assignment and update over (vector, part, component) rows."""
    step = ""
    for r in range(rounds + 1):
        step += f"""
d{r} AS MATERIALIZED (SELECT * FROM (SELECT vec_id, x.part, entry, sum((v - y) * (v - y)) d FROM x JOIN e{r} USING (part, j) GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1),"""
        if r < rounds:
            step += f"""
u{r} AS (SELECT x.part, entry, j, CAST(floor(sum(v) / count(*)) AS BIGINT) y FROM d{r} JOIN x USING (vec_id, part) GROUP BY 1, 2, 3),
e{r + 1} AS MATERIALIZED (SELECT e.part, e.entry, e.j, coalesce(u.y, e.y) y FROM e{r} e LEFT JOIN u{r} u USING (part, entry, j)),"""
    return f"""
WITH k AS (SELECT vec_id, label, embedding e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, i // 8 part, i % 8 j, CAST(floor(4096 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) v FROM k, range(64) r(i)),
e0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, j, v y FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),{step}
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) code, CAST(sum(d) AS BIGINT) error FROM d{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, j)) FROM e{rounds}) codebooks_sha256 FROM c JOIN k USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": DECONTAMINATE, "op4_jaccard": JACCARD, "op5_exactdedup": EXACT, "op10_licenses": licences(), "op11_vectorcodes": vector_codes(), "op13_prefixtrie": TRIE}
