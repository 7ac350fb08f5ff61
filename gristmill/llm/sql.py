"""The SQL of this package's queries, for DuckDB.

Token ids, packing and spam have no SQL, and random samples can't have any.  They are tested against brute
force, exact round trips or labelled pages instead.
"""

from __future__ import annotations

_FOLD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '([0-9])([.,])([0-9])', '\1<\2>\3', 'g'), '([0-9])([.,])([0-9])', '\1<\2>\3', 'g'), '<([.,])>|[^\pL\pN<>]', '\1', 'g'), '[<>]', '', 'g')"
# A point or comma between digits is marked first, in two passes as matches may not overlap, and with signs that are cut from the text before.
_CLEAN = "translate({x}, '<>', '  ')"


def _fold(x: str) -> str:
    return _FOLD.replace("{x}", _CLEAN.replace("{x}", x))


_LABELLED = r"'(?i)^[^\pL\pN]*(population|exposure|comparator|outcome|direction)[\s\pZ]*[:=]'"
_SAME = rf"""
WITH c AS (SELECT id, min(claim) AS claim FROM claims_test WHERE id IS NOT NULL AND claim IS NOT NULL GROUP BY id),
f AS (SELECT id, {_fold("claim")} AS flat, list_filter(regexp_split_to_array(claim, '[;|]'), lambda p: regexp_matches(p, '[\pL\pN]')) AS p FROM c),
r AS (SELECT id, CASE WHEN len(p) >= 2 AND len(list_filter(p, lambda x: NOT regexp_matches(x, {_LABELLED}))) = 0 THEN 'fields ' || CAST(list_sort(list_transform(p, lambda x: {_fold("x")})) AS VARCHAR) ELSE 'text ' || flat END AS form FROM f WHERE flat <> ''),
g AS (SELECT id, min(id) OVER (PARTITION BY form) AS keep_id FROM r)"""
_LABELS = r"""WITH l AS (SELECT id, min(upper(regexp_replace(evidence_label, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'))) AS c FROM claims_test WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT c, count(*) AS n FROM l GROUP BY c),
t AS (SELECT plan_id, evidence_label, greatest(min_rows, CAST(round(target_share * sample_size) AS BIGINT)) AS wanted, coalesce(n.n, 0) AS available FROM sample_targets LEFT JOIN n ON upper(trim(evidence_label)) = n.c)"""

_LINKS = rf"""
WITH RECURSIVE f AS (SELECT DISTINCT id, {_fold("claim")} AS t FROM claims_test WHERE id IS NOT NULL AND claim IS NOT NULL),
u AS (SELECT t, min(id) AS rep FROM f WHERE t <> '' GROUP BY t), m AS (SELECT f.id, u.rep FROM f JOIN u ON f.t = u.t),
w AS (SELECT rep, t, unnest(range(1, length(t) - 1)) AS p FROM u WHERE length(t) >= 3), s AS (SELECT DISTINCT rep, substr(t, p, 3) AS s FROM w),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep), o AS (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.rep < y.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON a = p.rep JOIN n q ON b = q.rep WHERE 10 * i >= 6 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
g(k, r) AS (SELECT rep, rep FROM u UNION SELECT e.b, g.r FROM g JOIN e ON g.k = e.a WHERE g.r < e.b),
z AS (SELECT k, min(r) AS root FROM g GROUP BY k), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.id, m.rep AS class_id, z.root AS group_id, coalesce(d.n, 0) AS n_links FROM m JOIN z ON m.rep = z.k LEFT JOIN d ON m.rep = d.a"""

SQL: dict[str, str] = {
    "p1_found": rf"""
WITH f AS (SELECT DISTINCT id, {_fold("claim")} AS t FROM claims_test WHERE id IS NOT NULL AND claim IS NOT NULL),
u AS (SELECT t, min(id) AS rep FROM f WHERE t <> '' GROUP BY t), m AS (SELECT f.id, u.rep FROM f JOIN u ON f.t = u.t),
w AS (SELECT rep, t, unnest(range(1, length(t) - 1)) AS p FROM u WHERE length(t) >= 3), s AS (SELECT DISTINCT rep, substr(t, p, 3) AS s FROM w),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep), o AS (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.rep < y.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON a = p.rep JOIN n q ON b = q.rep WHERE 10 * i >= 6 * (p.n + q.n - i))
SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM l JOIN m x ON l.a = x.rep JOIN m y ON l.b = y.rep
UNION SELECT x.id, y.id FROM m x JOIN m y ON x.rep = y.rep AND x.id < y.id""",
    "p3_found": f"{_SAME} SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p3_copies": f"{_SAME} SELECT keep_id, count(*) AS n_copies FROM g GROUP BY keep_id",
    # Each id with its text's class, the group of texts linked through others, and how many other texts it links to.
    "p1_groups": _LINKS,
    "p8_parts": "SELECT plan_id, doc_id, greatest(1, CAST(ceil(coalesce(n_chars, 0) / CAST(capacity AS DOUBLE)) AS BIGINT)) AS parts, coalesce(n_chars, 0) AS chars, true AS in_bounds FROM documents, pack_plan",
    # How many rows were taken, too, is the sample's own; what was wanted and what there is aren't.
    "p6_wanted": f"{_LABELS} SELECT plan_id, evidence_label, wanted, available, wanted > available AS short FROM t",
    "p6_found": f"{_LABELS} SELECT plan_id, evidence_label FROM t WHERE wanted > available",
}
