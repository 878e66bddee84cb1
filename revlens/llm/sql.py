"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

_SQL: dict[str, str] = {
    "op8_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM grams),
places AS (
  SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT rid, item_id, places.k, p FROM places JOIN grams ON places.g = grams.g AND places.k = grams.k),
hit AS (
  SELECT rid, count(DISTINCT q) AS n_hit
  FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM found) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM found) GROUP BY rid),
posts AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS q FROM d),
counts AS (SELECT word, count(*) AS n FROM posts GROUP BY word),
bi AS (SELECT row_number() OVER () AS iid, item_id, w, least(13, len(w)) AS k
  FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
bw AS (SELECT iid, k, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS place FROM bi),
win AS (SELECT iid, k, unnest(range(len(w) - k + 1)) AS s FROM bi),
ranked AS (
  SELECT iid, k, place, word, row_number() OVER (PARTITION BY iid, s ORDER BY n, place) AS r,
    count(*) OVER (PARTITION BY iid, s) AS seen
  FROM win JOIN bw USING (iid, k) JOIN counts USING (word) WHERE place BETWEEN s AND s + k - 1),
anchors AS (SELECT DISTINCT iid, k, place, word FROM ranked WHERE r <= 3 AND 100 * seen >= 75 * k),
shifted AS (
  SELECT rid, iid, o, count(*) OVER (PARTITION BY rid, iid ORDER BY o RANGE BETWEEN 13 PRECEDING AND 13 FOLLOWING) AS m, k
  FROM (SELECT rid, iid, k, q - place AS o FROM posts JOIN anchors USING (word))),
cand AS (SELECT DISTINCT rid, iid, o FROM shifted WHERE m >= least(3, k)),
marked AS (
  SELECT rid, item_id, o, k, list_transform(range(len(bi.w)),
    lambda j: CASE WHEN list_contains(d.w[greatest(1, o + j - 12):greatest(0, o + j + 14)], bi.w[j + 1]) THEN 1 ELSE 0 END) AS m
  FROM cand JOIN d USING (rid) JOIN bi USING (iid)),
nears AS (
  SELECT rid, item_id, min(o + s) AS p
  FROM (SELECT rid, item_id, o, k, m, unnest(range(len(m) - k + 1)) AS s FROM marked)
  WHERE 100 * list_sum(m[s + 1:s + k]) >= 75 * k GROUP BY rid, item_id),
near AS (
  SELECT rid, count(*) AS n_near, string_agg(p, ',' ORDER BY p) AS near_items
  FROM (SELECT rid, item_id::VARCHAR || ':' || p::VARCHAR AS p FROM nears) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
""",
}


def _level(depth: int) -> str:
    """One level of the budget tree: shares of the parent's budget, full children first."""
    names = ["domain", "lang", "source"][:depth]
    parent, name = names[:-1], names[-1]
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"ORDER BY capacity / weight, {name}"
    weight = {
        "domain": "CASE g.domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END",
        "lang": "CASE g.lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 2 ELSE 1 END",
        "source": "1",
    }[name]
    upper = (
        f"JOIN l{depth - 1} USING ({', '.join(parent)})"
        if parent
        else "CROSS JOIN (SELECT (sum(tokens) * 60)::BIGINT // 100 AS budget FROM leaves) t"
    )
    of = f"l{depth - 1}.budget" if parent else "t.budget"
    keys = ", ".join([f"g.{n}" for n in names])
    return f"""
n{depth} AS (
  SELECT {keys}, {of} AS parent_budget, g.tokens, g.tokens * 2 AS capacity, ({weight})::BIGINT AS weight
  FROM (SELECT {', '.join(names)}, sum(tokens)::BIGINT AS tokens FROM leaves GROUP BY ALL) g {upper}),
o{depth} AS (
  SELECT *, (capacity * sum(weight) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (parent_budget - coalesce(sum(capacity) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS is_full
  FROM n{depth} WHERE capacity > 0),
l{depth} AS (
  SELECT {', '.join(names)}, tokens, CASE WHEN is_full THEN capacity ELSE
    ((weight * (parent_budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0)))
      // sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}))::BIGINT END AS budget
  FROM o{depth})"""


_SQL["op7_mixing"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    coalesce(CASE WHEN regexp_extract(source, '([0-9]+)', 1) <> ''
      THEN 'domain' || (regexp_extract(source, '([0-9]+)', 1)::BIGINT // 5) ELSE source END, '(none)') AS domain,
    len({_WORDS.format('text')})::BIGINT AS n_tokens, md5(coalesce(text, '')) AS h
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
{_level(1)},{_level(2)},{_level(3)},
k AS (
  SELECT d.*, budget // tokens AS whole, budget % tokens AS part,
    md5('mix-1:' || (budget // tokens) || ':' || coalesce(doc_id::VARCHAR, '') || ':' || h) AS key
  FROM d JOIN l3 USING (domain, lang, source) WHERE n_tokens > 0),
c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto
  FROM k)
SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source, n_tokens,
  (whole + CASE WHEN upto <= part THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE whole > 0 OR upto <= part
"""


# Edits are counted in bytes by levenshtein, so the corpus's accented letters are
# given one byte each first.
_SQL["op9_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS h, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, h, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d),
long AS (SELECT *, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, h, place) AS ord FROM lines WHERE length(line) >= 40),
classes AS (SELECT line, min(ord) AS first,
  translate(line, 'éèêçüößäñóíÉÈÊÇÜÖÄÑÓÍ', concat(chr(1), chr(2), chr(3), chr(4), chr(5), chr(6), chr(7), chr(8), chr(11), chr(12), chr(14),
    chr(15), chr(16), chr(17), chr(18), chr(19), chr(20), chr(21), chr(22), chr(23), chr(24))) AS flat
  FROM long GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM classes a JOIN classes b
  ON abs(length(a.line) - length(b.line)) <= 2 AND a.first < b.first AND levenshtein(a.flat, b.flat) <= 2),
gone AS (
  SELECT rid, place, ord <> first AS exact
  FROM long JOIN classes USING (line) LEFT JOIN (SELECT line, true AS near FROM near) USING (line)
  WHERE ord <> first OR near)
SELECT doc_id, n_lines, n_exact, n_near, n_lines - n_exact - n_near AS n_kept, sha256(kept) AS kept_sha256
FROM (
  SELECT d.rid, any_value(d.doc_id) AS doc_id,
    CASE WHEN length(any_value(d.text)) > 0 THEN count(*) ELSE 0 END AS n_lines,
    count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY lines.place) FILTER (exact IS NULL), '') AS kept
  FROM d JOIN lines ON d.rid = lines.rid LEFT JOIN gone ON gone.rid = lines.rid AND gone.place = lines.place
  GROUP BY d.rid)
"""


_SQL["op11_fim_wavelet"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents),
e AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x,
    ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS cut,
    ('0x' || h[25:32])::BIGINT % 100 AS turn FROM d),
f AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR cut >= 50 THEN 'plain'
      WHEN turn < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM f
"""

_SQL["op12_minhash_near_dedup"] = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT rid, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rid <> b.rid
  JOIN sizes x ON x.rid = a.rid JOIN sizes y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_id AS (SELECT reach.a AS rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least_id USING (rid) LEFT JOIN sizes USING (rid)
"""


def _merkle(names: str, of: str, group: str, levels: int) -> str:
    """Levels of a tree over ``of`` (group, i, h, c) and, beside them, of every row's
    proof and fold (table ``names``0 has rid, group, i, c, proof, fold)."""
    same = f"s.{group} IS NOT DISTINCT FROM b.{group} AND b.i = xor(s.i, 1)"
    return ",".join(
        f"""
{of}{k + 1} AS MATERIALIZED (
  SELECT {group}, i // 2 AS i, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
    (max(c) + 1) // 2 AS c FROM {of}{k} GROUP BY {group}, i // 2),
{names}{k + 1} AS MATERIALIZED (
  SELECT s.rid, s.{group}, s.i // 2 AS i, (s.c + 1) // 2 AS c, proof || coalesce(b.h, '') AS proof,
    CASE WHEN s.c = 1 THEN fold WHEN b.h IS NULL THEN sha256(fold) WHEN s.i % 2 = 0 THEN sha256(fold || b.h)
      ELSE sha256(b.h || fold) END AS fold
  FROM {names}{k} s LEFT JOIN {of}{k} b ON {same})"""
        for k in range(levels)
    )


def _leaf(n_chars: str) -> str:
    parts = [
        f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
        for c in ("doc_id", "source", "lang", n_chars, "text")
    ]
    return f"sha256({' || '.join(parts)})"


# Enough levels for 2**22 documents of one language and 2**8 languages. DuckDB has no
# CRC, so it is built bit by bit from the id's digits (its generator is a fixed value).
_SQL["op13_merkle_manifest"] = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, ignored: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)),
    4294967295::BIGINT) AS crc
  FROM documents),
leaves AS MATERIALIZED (
  SELECT rid, doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN crc % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS shown FROM d),
n0 AS MATERIALIZED (
  SELECT rid, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h,
    count(*) OVER (PARTITION BY lang) AS c FROM leaves),
s0 AS MATERIALIZED (SELECT rid, n0.lang, i, c, '' AS proof, shown AS fold FROM n0 JOIN leaves USING (rid)),
{_merkle('s', 'n', 'lang', 22)},
g0 AS MATERIALIZED (
  SELECT 0 AS one, lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS c
  FROM n22),
t0 AS MATERIALIZED (
  SELECT rid, 0 AS one, g0.i, g0.c, proof, fold FROM s22 s JOIN g0 ON s.lang IS NOT DISTINCT FROM g0.lang),
{_merkle('t', 'g', 'one', 8)}
SELECT doc_id, leaf, subroot, g8.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = g8.h AS verified
FROM t8 JOIN leaves USING (rid) JOIN g0 ON leaves.lang IS NOT DISTINCT FROM g0.lang CROSS JOIN g8
"""


def all_sql() -> dict[str, str]:
    return dict(_SQL)
