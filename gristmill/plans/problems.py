"""Queries of the general problems, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import same_name
from gristmill.functions.geo import is_valid
from gristmill.operators.nearby import first_of_each, nearby_classes, nearby_pairs
from gristmill.operators.packed import CANDIDATES, Field, infer_delimiters, unpack
from gristmill.operators.regions import points_in_regions
from gristmill.sources.bad_rows import claim_fields, load_records

PACKED = [Field("cited_doc_ids"), Field("evidence_sentences", quoted=True)]
MAX_LABELS = 10_000


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _labels(spark: SparkSession, folder: str) -> list[str]:
    rows = _read(spark, folder, "sample_targets").select("evidence_label").where("evidence_label is not null").distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError("too many labels")
    return sorted(r[0] for r in rows)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_records(_read(spark, folder, "claims_raw"), claim_fields(_labels(spark, folder)), want="failed")


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The typed fields of the valid records, lists written with commas ('?' for a number beyond BIGINT), and the fields with such numbers."""
    loaded = load_records(_read(spark, folder, "claims_raw"), claim_fields(_labels(spark, folder)), want="loaded", beyond="beyond_bigint")
    written = [F.array_join(c, ",", "?").alias(c) for c in ("evidence_sentences", "cited_doc_ids")]
    return loaded.select("line_no", "id", "claim", "evidence_doc_id", "evidence_label", *written, "beyond_bigint")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearby_pairs(_read(spark, folder, "geo_object"), 0.5).select("id_a", "id_b")


def p4_names(spark: SparkSession, folder: str) -> DataFrame:
    return nearby_pairs(_read(spark, folder, "geo_object"), 0.5, carry=["name"]).select("id_a", "name_a", "id_b", "name_b", F.round("distance_km", 6).alias("distance_km"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each point: the class of its equal points and how many others are near; no pairs of equal points are made."""
    return nearby_classes(_read(spark, folder, "geo_object"), 0.5)


def p4_regions(spark: SparkSession, folder: str) -> DataFrame:
    """(region, id): the points in the star-shaped polygons around each point whose id is divisible by 100."""
    points = first_of_each(_read(spark, folder, "geo_object").where(is_valid(F.col("lat"), F.col("lng"))).select("id", "loaded_at", F.col("lat").alias("y"), F.col("lng").alias("x"), F.lit(0).alias("carry")), "loaded_at")
    points = points.select("id", F.col("y").alias("lat"), F.col("x").alias("lng"))
    reach = lambda k: 1.5 + F.pmod(F.col("id") + 7 * k, F.lit(5)) * 0.7
    corner = lambda k: F.struct(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + reach(k) * F.cos(k * math.pi / 6))).alias("lat"), (F.col("lng") + reach(k) * F.sin(k * math.pi / 6)).alias("lng"))
    polygons = points.where("id % 100 = 0").select(F.col("id").alias("region"), F.array(F.transform(F.sequence(F.lit(0), F.lit(11)), corner)).alias("rings"))
    return points_in_regions(points, polygons)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that splitting at the inferred delimiters gives; what isn't one then is in p5_unclean."""
    return unpack(_read(spark, folder, "claims_test"), PACKED, order="loaded_at", unclean="flag").where("clean").drop("clean")


def p5_unclean(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces that are no value under the inferred delimiters."""
    return unpack(_read(spark, folder, "claims_test"), PACKED, order="loaded_at", unclean="flag").where("not clean").select("id", "field", "item")


def p5_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    return infer_delimiters(_read(spark, folder, "claims_test"), PACKED).select("field", "delimiter", "rows", F.round("consistency", 6).alias("consistency"), F.round("regularity", 6).alias("regularity"), F.round("score", 6).alias("score"), "accepted")


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p4_found, p4_names, p4_classes, p4_regions, p5_found, p5_unclean, p5_delimiters)}

_FIELD = r'("[^"]*(""[^"]*)*"|[^",]*)'
_GEO = "g AS (SELECT id, arg_min(lat, loaded_at) AS lat, arg_min(lng, loaded_at) AS lng, arg_min(name, loaded_at) AS name FROM geo_object WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lng) GROUP BY id), "
_GEO += "b AS (SELECT *, CAST(floor((lat + 90) / 0.005) AS BIGINT) AS band FROM g), n AS (SELECT *, band + unnest([-1, 0, 1]) AS near FROM b), "
_GEO += "d AS (SELECT x.id AS id_a, x.name AS name_a, y.id AS id_b, y.name AS name_b, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x.lng) / 2), 2)))) AS km FROM n x JOIN b y ON x.near = y.band AND x.id < y.id)"

_SIGNS = [(c, {"\t": r"\t", "\n": r"\n", "\r": r"\r"}.get(c, "[" + ("\\" if c in "-." else "") + c + "]")) for c in CANDIDATES]
_CANDIDATE_ROWS = ", ".join(f"(chr({ord(c)}), '{p}+')" if c.isspace() else f"(chr({ord(c)}), '\\s*{p}\\s*')" for c, p in _SIGNS)
_EVERY = "[" + "".join(p.strip("[]") for _, p in _SIGNS) + "]"

# The rules, one after the other, by regular expressions over whole records.
_RECORDS = f"""
WITH r AS (SELECT line_no, regexp_replace(line, '[\\r\\n]+$', '') AS s FROM claims_raw),
q AS (SELECT line_no, s, NOT regexp_full_match(s, '{_FIELD}(,{_FIELD})*', 's') AS broken FROM r),
f AS (SELECT *, CASE WHEN broken THEN NULL ELSE regexp_extract_all(',' || s, ',{_FIELD}', 1, 's') END AS p FROM q),
u AS (SELECT line_no, broken, len(p) AS n, list_transform(p, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS v FROM f),
j AS (SELECT line_no, CASE WHEN broken THEN 'quoting' WHEN n IS NULL OR n <> 6 THEN 'columns'
  WHEN NOT regexp_full_match(v[1], '[0-9]+') OR NOT regexp_matches(v[2], '\\pL') OR regexp_matches(v[2], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFD}}]')
    OR NOT regexp_full_match(v[3], '[0-9]*') OR NOT (v[4] = '' OR v[4] IN (SELECT evidence_label FROM sample_targets))
    OR NOT regexp_full_match(v[5], '\\[ *([0-9]+ *(, *[0-9]+ *)*)?\\]') OR NOT regexp_full_match(v[6], '\\[ *([0-9]+ *(, *[0-9]+ *)*)?\\]') THEN 'value' END AS reason, v FROM u)"""
_WRITTEN = r"array_to_string(list_transform(regexp_extract_all(v[{k}], '[0-9]+'), lambda x: coalesce(CAST(TRY_CAST(x AS BIGINT) AS VARCHAR), '?')), ',')"
_BEYOND = r"len(list_filter(regexp_extract_all(v[{k}], '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT) IS NULL)) > 0"

SQL = {
    "p2_found": _RECORDS + "\nSELECT line_no, reason FROM j WHERE reason IS NOT NULL",
    "p2_loaded": _RECORDS + rf"""
SELECT line_no, TRY_CAST(v[1] AS BIGINT) AS id, v[2] AS claim, TRY_CAST(v[3] AS BIGINT) AS evidence_doc_id, nullif(v[4], '') AS evidence_label, {_WRITTEN.format(k=5)} AS evidence_sentences, {_WRITTEN.format(k=6)} AS cited_doc_ids,
  nullif(array_to_string(list_filter([CASE WHEN {_BEYOND.format(k=1)} THEN 'id' END, CASE WHEN {_BEYOND.format(k=3)} THEN 'evidence_doc_id' END, CASE WHEN {_BEYOND.format(k=5)} THEN 'evidence_sentences' END, CASE WHEN {_BEYOND.format(k=6)} THEN 'cited_doc_ids' END], lambda x: x IS NOT NULL), ','), '') AS beyond_bigint
FROM j WHERE reason IS NULL""",
    "p4_found": f"WITH {_GEO} SELECT id_a, id_b FROM d WHERE km <= 0.5",
    "p4_names": f"WITH {_GEO} SELECT id_a, name_a, id_b, name_b, round(km, 6) AS distance_km FROM d WHERE km <= 0.5",
    "p4_classes": f"WITH {_GEO}, e AS (SELECT id_a AS id FROM d WHERE km <= 0.5 UNION ALL SELECT id_b FROM d WHERE km <= 0.5), c AS (SELECT id, count(*) AS n FROM e GROUP BY id) SELECT g.id, min(g.id) OVER (PARTITION BY lat, lng) AS class_id, coalesce(c.n, 0) AS n_near FROM g LEFT JOIN c ON g.id = c.id",
    "p4_regions": f"""WITH {_GEO.split(', b AS')[0]},
v AS (SELECT id, k, greatest(-90e0, least(90e0, lat + (1.5e0 + ((id + 7 * k) % 5) * 0.7e0) * cos(k * pi() / 6))) AS vy, lng + (1.5e0 + ((id + 7 * k) % 5) * 0.7e0) * sin(k * pi() / 6) AS vx FROM g, range(12) r(k) WHERE id % 100 = 0),
e AS (SELECT v.id AS region, v.vy AS a, v.vx AS b, w.vy AS c, w.vx AS d FROM v JOIN v w ON v.id = w.id AND w.k = (v.k + 1) % 12),
h AS (SELECT region, g.id, t, count(*) AS n FROM e, g, (VALUES (-360e0), (0e0), (360e0)) u(t) WHERE (a > lat) <> (c > lat) AND (d - b) * (lat - a) / (c - a) + b > lng + t GROUP BY ALL)
SELECT region, id FROM h WHERE n % 2 = 1""",
    # Each candidate over the rows in which it is the only one, else over those in which it stands with others.
    "p5_delimiters": r"""
WITH v AS (SELECT 'cited_doc_ids' AS field, regexp_replace(cited_doc_ids, '["''“”]', '', 'g') AS v FROM claims_test WHERE cited_doc_ids IS NOT NULL
  UNION ALL SELECT 'evidence_sentences', regexp_replace(evidence_sentences, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”', 'Q', 'g') FROM claims_test WHERE evidence_sentences IS NOT NULL),
b AS (SELECT field, regexp_replace(regexp_replace(v, '[\[\](){}]', '', 'g'), '^\s+|\s+$', '', 'g') AS v FROM v),
k(d, p) AS (VALUES {candidates}),
t AS (SELECT field, v, d, regexp_replace(v, p, d, 'g') AS w FROM b JOIN k ON contains(v, d)),
a AS (SELECT *, NOT regexp_matches(replace(w, d, ''), '{every}') AS alone FROM t),
s AS (SELECT field, d, v, alone, list_filter(CASE WHEN alone THEN string_split(w, d) ELSE regexp_split_to_array(v, '{every}') END, lambda x: x <> '') AS l FROM a),
j AS (SELECT field, d, alone, len(list_filter(l, lambda x: regexp_full_match(x, '[0-9]+|Q'))) / CAST(greatest(len(l), 1) AS DOUBLE) AS r, CASE WHEN len(regexp_extract_all(v, '[0-9]+|Q')) = len(l) THEN 1e0 ELSE 0e0 END AS c FROM s),
g AS (SELECT field, d, alone, count(*) AS rows, avg(c) AS c, avg(r) AS r, row_number() OVER (PARTITION BY field, d ORDER BY alone DESC) AS n FROM j GROUP BY field, d, alone)
SELECT field, d AS delimiter, rows, round(c, 6) AS consistency, round(r, 6) AS regularity, round((c + r) / 2, 6) AS score, (c + r) / 2 >= 0.5 AS accepted FROM g WHERE n = 1""".replace("{candidates}", _CANDIDATE_ROWS).replace("{every}", _EVERY),
    # Of the pieces between signs that separate, those that are neither a number nor a quoted text.
    "p5_unclean": r"""
WITH c AS (SELECT id, arg_min(coalesce(cited_doc_ids, ''), loaded_at) AS c, arg_min(coalesce(evidence_sentences, ''), loaded_at) AS e FROM claims_test GROUP BY id),
v AS (SELECT id, 'cited_doc_ids' AS field, regexp_replace(c, '["''“”]', ' ', 'g') AS v FROM c
  UNION ALL SELECT id, 'evidence_sentences', regexp_replace(e, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”', ' ', 'g') FROM c),
u AS (SELECT id, field, unnest(regexp_split_to_array(v, '[\[\](){},;|/\s]')) AS item FROM v)
SELECT id, field, item FROM u WHERE item <> '' AND NOT regexp_full_match(item, '[0-9]+')""",
    "p5_found": """
WITH c AS (SELECT id, arg_min(coalesce(cited_doc_ids, ''), loaded_at) AS c, arg_min(coalesce(evidence_sentences, ''), loaded_at) AS e FROM claims_test GROUP BY id),
v AS (SELECT id, 'cited_doc_ids' AS field, regexp_extract_all(c, '[0-9]+') AS l FROM c
  UNION ALL SELECT id, 'evidence_sentences', regexp_extract_all(e, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”|[0-9]+') FROM c),
u AS (SELECT id, field, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM v)
SELECT id, field, CAST(pos AS BIGINT) AS pos, CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') WHEN x LIKE '''%' THEN replace(substr(x, 2, length(x) - 2), '''''', '''') WHEN x LIKE '“%' THEN substr(x, 2, length(x) - 2) ELSE x END AS item FROM u""",
}
