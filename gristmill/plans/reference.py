"""Queries of the keyed table, the dictionary, near-duplicate texts and geographic look-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.geo import haversine_km, squared_chord, squared_distance, unit_xyz
from gristmill.operators import geo, kv, neardup
from gristmill.operators.dictionary import PRIME, Dictionary, first_level, keep_first
from gristmill.session import materialize
from gristmill.sources.points import random_points

PARAMS = neardup.Params()
#: Long texts that are alike have similarities just above the threshold: more bands, so that over 0.9 of such pairs are candidates.
DOCUMENT_PARAMS = neardup.Params(bands=80)
RADIUS_KM = 100.0
# The places of the demonstration.
CITIES = [
    (0, 55.7558, 37.6173, "Moscow"),
    (1, 59.9343, 30.3351, "Saint Petersburg"),
    (2, 48.8566, 2.3522, "Paris"),
    (3, 51.5074, -0.1278, "London"),
    (4, 40.7128, -74.006, "New York"),
    (5, 35.6762, 139.6503, "Tokyo"),
    (6, -33.8688, 151.2093, "Sydney"),
    (7, 55.7522, 37.6156, "Kremlin"),
    (8, 59.9502, 30.3163, "Hermitage"),
]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# Near-duplicate texts: the claims, each id once for each text.


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "claims_test").select("id", F.coalesce("claim", F.lit("")).alias("claim")).distinct()


def _classes(spark: SparkSession, folder: str) -> neardup.Classes:
    return neardup.classes(_claims(spark, folder), "id", "claim", params=PARAMS)


def shingle_counts(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.shingle_sets(_claims(spark, folder), "id", "claim", PARAMS.k).select("id", F.size("shingles").cast("long").alias("n_shingles"))


def minhash_signatures(spark: SparkSession, folder: str) -> DataFrame:
    sigs = neardup.signatures(neardup.shingle_sets(_claims(spark, folder), "id", "claim", PARAMS.k), PARAMS)
    return sigs.select("id", F.col("sig")[0].alias("m0"), F.col("sig")[99].alias("m99"), F.aggregate("sig", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


def neardup_members(spark: SparkSession, folder: str) -> DataFrame:
    return _classes(spark, folder).members


def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.candidates(_classes(spark, folder).sigs, PARAMS)


def neardup_pairs_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.lsh_pairs(_classes(spark, folder), PARAMS)


def neardup_pairs_lsh_exact(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.lsh_pairs(_classes(spark, folder), PARAMS, verify="exact").withColumn("similarity", F.round("similarity", 6))


def neardup_pairs_exact(spark: SparkSession, folder: str) -> DataFrame:
    groups = neardup.classes(_claims(spark, folder), "id", "claim", params=PARAMS, stored=False)
    return neardup.exact_pairs(groups, PARAMS.threshold, dense=True).withColumn("similarity", F.round("similarity", 6))


def similar_lookup(spark: SparkSession, folder: str) -> DataFrame:
    sigs = _classes(spark, folder).sigs
    return neardup.similar_to(sigs.where("id % 100 = 0"), sigs, PARAMS)


def _lookup_rows(groups: neardup.Classes, params: neardup.Params) -> DataFrame:
    """(q, id, similarity): classes similar to the text of each id divisible by 100; a class is searched once, whichever of its ids ask."""
    sigs = groups.sigs
    asked = groups.members.where("id % 100 = 0").select(F.col("id").alias("asks"), F.col("class_id").alias("q"))
    found = neardup.similar_to(sigs.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi"), sigs, params)
    return asked.join(found, "q").select(F.col("asks").alias("q"), "id", "similarity").distinct()


def similar_lookup_rows(spark: SparkSession, folder: str) -> DataFrame:
    """As similar_lookup, which asks for the classes whose smallest id is divisible by 100 only."""
    return _lookup_rows(_classes(spark, folder), PARAMS)


def neardup_quality(spark: SparkSession, folder: str) -> DataFrame:
    groups = _classes(spark, folder)
    q = neardup.quality(neardup.lsh_pairs(groups, PARAMS), neardup.exact_pairs(groups, PARAMS.threshold, dense=True))
    return q.select("found", "true", "both", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# The same over the whole texts of the documents.


def _document_classes(spark: SparkSession, folder: str, stored: bool = False) -> neardup.Classes:
    texts = _read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return neardup.classes(texts, "doc_id", "text", params=DOCUMENT_PARAMS, stored=stored)


def documents_members(spark: SparkSession, folder: str) -> DataFrame:
    return _document_classes(spark, folder).members


def documents_lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.dense_candidates(_document_classes(spark, folder), DOCUMENT_PARAMS)


def documents_pairs_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.dense_lsh_pairs(_document_classes(spark, folder), DOCUMENT_PARAMS)


def documents_pairs_lsh_exact(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.dense_lsh_pairs(_document_classes(spark, folder), DOCUMENT_PARAMS, verify="exact").withColumn("similarity", F.round("similarity", 6))


def documents_pairs_exact(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.exact_pairs(_document_classes(spark, folder), DOCUMENT_PARAMS.threshold, dense=True).withColumn("similarity", F.round("similarity", 6))


def documents_similar_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _lookup_rows(_document_classes(spark, folder, stored=True), DOCUMENT_PARAMS)


def documents_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A row for either way to verify candidates."""
    groups = _document_classes(spark, folder)
    if groups.count is not None:
        groups.blocks("bands", "sig", "shingles")
    true = materialize(neardup.exact_pairs(groups, DOCUMENT_PARAMS.threshold, dense=True), "true")
    rows = [neardup.quality(neardup.dense_lsh_pairs(groups, DOCUMENT_PARAMS, v), true).withColumn("verify", F.lit(v)) for v in ("estimated", "exact")]
    return rows[0].unionByName(rows[1]).select("verify", "found", "true", "both", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# The keyed table.


def _ops(spark: SparkSession, folder: str) -> DataFrame:
    return kv.operations(_read(spark, folder, "kv_log"))


def kv_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return kv.snapshot(_ops(spark, folder))


def kv_results(spark: SparkSession, folder: str) -> DataFrame:
    return kv.results(_ops(spark, folder))


def kv_delete_result(spark: SparkSession, folder: str) -> DataFrame:
    return kv.results(_ops(spark, folder)).where("op = 'delete'").select("seq", "key", "existed")


def kv_multi_get(spark: SparkSession, folder: str) -> DataFrame:
    ops = _ops(spark, folder)
    probes = ops.select("key").distinct()
    absent = probes.select(F.concat("key", F.lit("/absent")).alias("key"))
    return kv.get_many(kv.snapshot(ops), probes.unionByName(absent))


def kv_missing(spark: SparkSession, folder: str) -> DataFrame:
    ops = _ops(spark, folder)
    return kv.get_many(kv.snapshot(ops), ops.select("key").distinct()).where("not found").select("key")


def kv_merge(spark: SparkSession, folder: str) -> DataFrame:
    ops = _ops(spark, folder)
    half = F.col("seq") % 1000 < 500
    # A base of some of the operations and a batch of those after it: both halves of each thousand.
    early = ops.groupBy("key").agg(F.max(F.when(half, F.col("seq"))).alias("last"))
    cut = ops.join(early, "key")
    base = kv.snapshot(cut.where("last is not null and seq <= last"))
    return kv.merge(base, cut.where("last is null or seq > last"))


def kv_record_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return kv_snapshot(spark, folder).select("key", kv.record_bytes(F.col("key"), F.col("value")).cast("long").alias("bytes"))


def kv_layout(spark: SparkSession, folder: str, page: int = 1024) -> DataFrame:
    return kv.layout_summary(kv.layout(kv_snapshot(spark, folder), page))


def kv_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return kv.layout(kv_snapshot(spark, folder), 1024)


# The dictionary.


def dict_lookup(spark: SparkSession, folder: str) -> DataFrame:
    titles = _read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc"), "title")
    probes = _read(spark, folder, "claims_test").select("id", F.trim("evidence_doc_id").alias("doc")).distinct()
    return Dictionary(titles, "doc", "title").lookup(probes, "doc", "title")


def dict_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return keep_first(_read(spark, folder, "documents").select("doc_id", "title", "source"), "title", "doc_id")


def dict_first_titles(spark: SparkSession, folder: str) -> DataFrame:
    return keep_first(_read(spark, folder, "documents").select("doc_id", "title"), "title", "doc_id", 1000)


def dict_bucket_stats(spark: SparkSession, folder: str) -> DataFrame:
    names = Dictionary(_read(spark, folder, "customer"), "c_name", "c_custkey")
    return names.buckets().agg(F.count("*").alias("buckets"), F.max("records").alias("largest"), F.sum(F.col("records") * F.col("records")).alias("secondary_space"))


# Points.


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return geo.valid_points(_read(spark, folder, "geo_object")).groupBy("id").agg(F.min(F.struct("loaded_at", "lat", "lng", "name")).alias("x")).select("id", "x.lat", "x.lng", "x.name")


def _queries(points: DataFrame) -> DataFrame:
    return points.where("id % 100 = 0").select(F.col("id").alias("qid"), (F.col("lat") * 0.9).alias("lat"), (F.col("lng") * 0.9).alias("lng"))


def geo_distance(spark: SparkSession, folder: str) -> DataFrame:
    _, lat, lng, _ = CITIES[0]
    p = _points(spark, folder)
    here = tuple(F.lit(v) for v in (lat, lng))
    km = haversine_km(*here, F.col("lat"), F.col("lng"))
    chord2 = squared_distance(unit_xyz(*here), unit_xyz(F.col("lat"), F.col("lng")))
    return p.select("id", F.round(km, 6).alias("km"), F.round(chord2, 6).alias("chord2"), F.round(squared_chord(km), 6).alias("chord2_of_km"))


def geo_nearest(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder)
    return geo.nearest_join(p, _queries(p)).withColumn("distance_km", F.round("distance_km", 6))


def geo_radius(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder)
    return geo.radius_join_plain(p, _queries(p), RADIUS_KM).withColumn("distance_km", F.round("distance_km", 6))


def geo_radius_pruned(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder)
    return geo.radius_join(p, _queries(p), RADIUS_KM).withColumn("distance_km", F.round("distance_km", 6))


def geo_cities(spark: SparkSession, folder: str) -> DataFrame:
    cities = spark.createDataFrame(CITIES, "id bigint, lat double, lng double, name string")
    q = spark.createDataFrame([(0, 55.76, 37.62), (1, 51.51, -0.13)], "qid bigint, lat double, lng double")
    near = geo.nearest_join(cities, q).withColumn("what", F.lit("nearest"))
    moscow = q.where("qid = 0")
    for km in (50.0, 800.0):
        near = near.unionByName(geo.radius_join(cities, moscow, km).withColumn("what", F.lit(f"within {km:g} km")))
    return near.join(cities.select("id", "name"), "id").select("what", "qid", "name", F.round("distance_km", 6).alias("distance_km"))


def geo_random_radius(spark: SparkSession, folder: str) -> DataFrame:
    p = random_points(spark, 1000)
    q = random_points(spark, 1000, skip=1000).select(F.col("id").alias("qid"), "lat", "lng")
    return geo.radius_join(p, q, RADIUS_KM).withColumn("distance_km", F.round("distance_km", 6))


_ALL = (
    shingle_counts, minhash_signatures, neardup_members, lsh_candidates, neardup_pairs_lsh, neardup_pairs_lsh_exact, neardup_pairs_exact, similar_lookup, similar_lookup_rows, neardup_quality,
    documents_members, documents_lsh_candidates, documents_pairs_lsh, documents_pairs_lsh_exact, documents_pairs_exact, documents_similar_lookup, documents_quality,
    kv_snapshot, kv_results, kv_delete_result, kv_multi_get, kv_missing, kv_merge, kv_record_bytes, kv_layout, kv_buckets,
    dict_lookup, dict_keep_first, dict_first_titles, dict_bucket_stats,
    geo_distance, geo_nearest, geo_radius, geo_radius_pruned, geo_cities, geo_random_radius,
)
QUERIES = {f.__name__: f for f in _ALL}

_DOCS = "d AS (SELECT DISTINCT id, lower(coalesce(claim, '')) AS t FROM claims_test)"
_SHINGLES = f"""{_DOCS}, w AS (SELECT id, t, unnest(range(1, length(t) - 1)) AS p FROM d WHERE length(t) >= 3),
s AS (SELECT DISTINCT id, unicode(substr(t, p, 1)) * 961 + unicode(substr(t, p + 1, 1)) * 31 + unicode(substr(t, p + 2, 1)) AS s FROM w)"""
_PARAMS = "prm(i, a, b) AS (VALUES " + ", ".join(f"({i}, CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for i, (a, b) in enumerate(PARAMS.functions)) + ")"
_CLASSES = f"""{_SHINGLES}, l AS (SELECT d.id, coalesce(list(s.s ORDER BY s.s), []) AS l FROM d LEFT JOIN s ON d.id = s.id GROUP BY d.id),
l2 AS (SELECT id, CASE WHEN l = [NULL] THEN 'none' ELSE CAST(l AS VARCHAR) END AS l FROM l),
h AS (SELECT l, min(id) AS class_id FROM l2 GROUP BY l), mem AS (SELECT l2.id, h.class_id FROM l2 JOIN h ON l2.l = h.l),
cs AS (SELECT s.* FROM s JOIN h ON s.id = h.class_id), cn AS (SELECT id, count(*) AS n FROM cs GROUP BY id)"""
_SIGS = f"""{_CLASSES}, {_PARAMS}, m AS (SELECT id, i, min((a * s + b) % 2147483647) AS m FROM cs, prm GROUP BY id, i
  UNION ALL SELECT h.class_id, i, 2147483647 FROM h, prm WHERE h.class_id NOT IN (SELECT id FROM cs)),
bd AS (SELECT id, i // 5 AS band, list(m ORDER BY i) AS k FROM m GROUP BY id, i // 5), sg AS (SELECT id, list(m ORDER BY i) AS g FROM m GROUP BY id),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.k = y.k AND x.id < y.id),
est AS (SELECT a, b, len(list_filter(list_zip(x.g, y.g), lambda z: z[1] = z[2])) / 100e0 AS similarity FROM cand JOIN sg x ON a = x.id JOIN sg y ON b = y.id)"""
_EXACT = "ov AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM cs x JOIN cs y ON x.s = y.s AND x.id < y.id {only} GROUP BY 1, 2), ex AS (SELECT a, b, i / CAST(p.n + q.n - i AS DOUBLE) AS similarity FROM ov JOIN cn p ON a = p.id JOIN cn q ON b = q.id WHERE i / CAST(p.n + q.n - i AS DOUBLE) >= 0.5)"
# Units of UTF-16 are spelled out, as texts have characters of two.
_DOCUMENT_SHINGLES = """d AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents),
cu AS (SELECT id, flatten(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)) AS u FROM d WHERE t <> ''),
w AS (SELECT id, unnest(u) AS c, generate_subscripts(u, 1) AS p FROM cu),
v AS (SELECT id, c * 961 + lead(c, 1) OVER (PARTITION BY id ORDER BY p) * 31 + lead(c, 2) OVER (PARTITION BY id ORDER BY p) AS s FROM w),
s AS (SELECT DISTINCT id, CAST(s AS BIGINT) AS s FROM v WHERE s IS NOT NULL)"""


def _values(params: neardup.Params) -> str:
    return "prm(i, a, b) AS (VALUES " + ", ".join(f"({i}, CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for i, (a, b) in enumerate(params.functions)) + ")"


def _of_documents(sql: str) -> str:
    """Statements over the claims, over the documents."""
    return sql.replace(_SHINGLES, _DOCUMENT_SHINGLES).replace(_PARAMS, _values(DOCUMENT_PARAMS)).replace("/ 100e0", f"/ {DOCUMENT_PARAMS.bands * DOCUMENT_PARAMS.rows}e0")


_OPS = "o AS (SELECT seq, lower(trim(any_value(op))) AS op, any_value(key) AS key, CASE WHEN lower(trim(any_value(op))) = 'put' THEN coalesce(any_value(value), '') END AS value FROM kv_log WHERE seq IS NOT NULL AND key IS NOT NULL GROUP BY seq)"
_SNAP = f"{_OPS}, z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM o WHERE op IN ('put', 'delete')), snap AS (SELECT key, value, seq FROM z WHERE n = 1 AND op = 'put')"
_RES = f"{_OPS}, y AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM o WHERE op IN ('put', 'get', 'delete')), res AS (SELECT y.seq, y.op, y.key, p.value AS result, coalesce(p.op = 'put', false) AS existed FROM y LEFT JOIN o p ON y.prev = p.seq)"
_LAYOUT = f"""{_SNAP}, k AS (SELECT key, strlen(key) + strlen(value) + 9 AS bytes, CASE WHEN key = '' THEN 0 ELSE list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) END AS h0 FROM snap),
kh AS (SELECT bytes, xor(h0, h0 >> 16) AS h FROM k), dp AS (SELECT bytes, h, unnest(range(0, 25)) AS depth FROM kh),
nd AS (SELECT depth, h & ((CAST(1 AS BIGINT) << depth) - 1) AS prefix, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM dp GROUP BY 1, 2),
fl AS (SELECT depth, prefix FROM nd WHERE bytes + 8 > 1024 AND depth < 24),
ch AS (SELECT depth + 1 AS depth, prefix FROM fl UNION ALL SELECT depth + 1, prefix + (CAST(1 AS BIGINT) << depth) FROM fl UNION ALL SELECT 0, 0),
lv AS (SELECT CAST(ch.depth AS INTEGER) AS depth, CAST(ch.prefix AS BIGINT) AS prefix, coalesce(nd.records, 0) AS records, coalesce(nd.bytes, 0) AS bytes FROM ch LEFT JOIN fl ON ch.depth = fl.depth AND ch.prefix = fl.prefix LEFT JOIN nd ON ch.depth = nd.depth AND ch.prefix = nd.prefix WHERE fl.depth IS NULL)"""
_A1, _B1 = first_level()
_PTS = "g AS (SELECT id, arg_min(lat, loaded_at) AS lat, arg_min(lng, loaded_at) AS lng FROM geo_object WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lng) GROUP BY id), q AS (SELECT id AS qid, lat * 0.9e0 AS qlat, lng * 0.9e0 AS qlng FROM g WHERE id % 100 = 0)"


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_NEAR = f"{_PTS}, dd AS (SELECT qid, id, {_km('qlat', 'qlng', 'lat', 'lng')} AS distance_km FROM q, g)"
_ROUND = "SELECT a, b, round(similarity, 6) AS similarity"

SQL = {
    "shingle_counts": f"WITH {_SHINGLES} SELECT d.id, count(s.s) AS n_shingles FROM d LEFT JOIN s ON d.id = s.id GROUP BY d.id",
    "minhash_signatures": f"WITH {_SHINGLES}, {_PARAMS}, m AS (SELECT d.id, i, coalesce(min((a * s + b) % 2147483647), 2147483647) AS m FROM d CROSS JOIN prm LEFT JOIN s ON d.id = s.id GROUP BY d.id, i) SELECT id, max(CASE WHEN i = 0 THEN m END) AS m0, max(CASE WHEN i = 99 THEN m END) AS m99, CAST(sum(m) AS BIGINT) AS total FROM m GROUP BY id",
    "neardup_members": f"WITH {_CLASSES} SELECT id, class_id FROM mem",
    "lsh_candidates": f"WITH {_SIGS} SELECT a, b FROM cand",
    "neardup_pairs_lsh": f"WITH {_SIGS} SELECT a, b, similarity FROM est WHERE similarity >= 0.5",
    "neardup_pairs_lsh_exact": f"WITH {_SIGS}, {_EXACT.format(only='JOIN cand c ON c.a = x.id AND c.b = y.id')} {_ROUND} FROM ex",
    "neardup_pairs_exact": f"WITH {_CLASSES}, {_EXACT.format(only='')} {_ROUND} FROM ex",
    "similar_lookup": f"WITH {_SIGS}, hit AS (SELECT DISTINCT x.id AS q, y.id AS id FROM bd x JOIN bd y ON x.band = y.band AND x.k = y.k WHERE x.id % 100 = 0), sc AS (SELECT q, hit.id, len(list_filter(list_zip(x.g, y.g), lambda z: z[1] = z[2])) / 100e0 AS similarity FROM hit JOIN sg x ON q = x.id JOIN sg y ON hit.id = y.id) SELECT q, id, similarity FROM sc WHERE similarity >= 0.5",
    "similar_lookup_rows": f"WITH {_SIGS}, hit AS (SELECT DISTINCT x.id AS q, y.id AS id FROM bd x JOIN bd y ON x.band = y.band AND x.k = y.k WHERE x.id IN (SELECT class_id FROM mem WHERE id % 100 = 0)), sc AS (SELECT q, hit.id, len(list_filter(list_zip(x.g, y.g), lambda z: z[1] = z[2])) / 100e0 AS similarity FROM hit JOIN sg x ON q = x.id JOIN sg y ON hit.id = y.id) SELECT DISTINCT mem.id AS q, sc.id, similarity FROM sc JOIN mem ON mem.class_id = q WHERE mem.id % 100 = 0 AND similarity >= 0.5",
    "neardup_quality": f"WITH {_SIGS}, {_EXACT.format(only='')}, f AS (SELECT a, b FROM est WHERE similarity >= 0.5), n AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM ex) AS \"true\", (SELECT count(*) FROM f JOIN ex ON f.a = ex.a AND f.b = ex.b) AS \"both\") SELECT found, \"true\", \"both\", round(\"both\" / CAST(\"true\" AS DOUBLE), 6) AS recall, round(\"both\" / CAST(found AS DOUBLE), 6) AS precision FROM n",
    "kv_snapshot": f"WITH {_SNAP} SELECT key, value, seq FROM snap",
    "kv_results": f"WITH {_RES} SELECT seq, op, key, result, existed FROM res",
    "kv_delete_result": f"WITH {_RES} SELECT seq, key, existed FROM res WHERE op = 'delete'",
    "kv_multi_get": f"WITH {_SNAP}, k AS (SELECT DISTINCT key FROM o), p AS (SELECT key FROM k UNION ALL SELECT key || '/absent' FROM k) SELECT p.key, s.value, s.key IS NOT NULL AS found FROM p LEFT JOIN snap s ON p.key = s.key",
    "kv_missing": f"WITH {_SNAP} SELECT DISTINCT key FROM o WHERE key NOT IN (SELECT key FROM snap)",
    "kv_merge": f"WITH {_SNAP} SELECT key, value, seq FROM snap",
    "kv_record_bytes": f"WITH {_SNAP} SELECT key, strlen(key) + strlen(value) + 9 AS bytes FROM snap",
    "kv_layout": f"WITH {_LAYOUT} SELECT max(depth) AS global_depth, count(*) AS buckets FROM lv",
    "kv_buckets": f"WITH {_LAYOUT} SELECT depth, prefix, records, bytes FROM lv",
    "dict_lookup": "WITH p AS (SELECT DISTINCT id, trim(evidence_doc_id, ' ') AS doc FROM claims_test) SELECT p.id, p.doc, d.title, d.doc_id IS NOT NULL AS found FROM p LEFT JOIN documents d ON p.doc = CAST(d.doc_id AS VARCHAR)",
    "dict_keep_first": "SELECT doc_id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS n FROM documents WHERE title IS NOT NULL) WHERE n = 1",
    "dict_first_titles": "SELECT doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS n FROM documents WHERE title IS NOT NULL) WHERE n = 1 ORDER BY doc_id LIMIT 1000",
    "dict_bucket_stats": f"WITH h AS (SELECT list_reduce(list_prepend(CAST({_B1} AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * {_A1} + c) % {PRIME}) % (SELECT count(*) FROM customer) AS b FROM customer), n AS (SELECT b, count(*) AS n FROM h GROUP BY b) SELECT count(*) AS buckets, max(n) AS largest, CAST(sum(n * n) AS BIGINT) AS secondary_space FROM n",
    "geo_distance": f"WITH {_PTS}, k AS (SELECT id, {_km('55.7558e0', '37.6173e0', 'lat', 'lng')} AS km, pow(cos(radians(55.7558e0)) * cos(radians(37.6173e0)) - cos(radians(lat)) * cos(radians(lng)), 2) + pow(cos(radians(55.7558e0)) * sin(radians(37.6173e0)) - cos(radians(lat)) * sin(radians(lng)), 2) + pow(sin(radians(55.7558e0)) - sin(radians(lat)), 2) AS c2 FROM g) SELECT id, round(km, 6) AS km, round(c2, 6) AS chord2, round(pow(2 * sin(km / 6371.0e0 / 2), 2), 6) AS chord2_of_km FROM k",
    "geo_nearest": f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance_km, id) AS n FROM dd) SELECT qid, id, round(distance_km, 6) AS distance_km FROM r WHERE n = 1",
    "geo_radius": f"WITH {_NEAR} SELECT qid, id, round(distance_km, 6) AS distance_km FROM dd WHERE distance_km <= 100",
    "geo_radius_pruned": f"WITH {_NEAR} SELECT qid, id, round(distance_km, 6) AS distance_km FROM dd WHERE distance_km <= 100",
    "geo_cities": "WITH c(id, lat, lng, name) AS (VALUES " + ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({o} AS DOUBLE), '{n}')" for i, a, o, n in CITIES) + "), q(qid, qlat, qlng) AS (VALUES (CAST(0 AS BIGINT), 55.76e0, 37.62e0), (1, 51.51e0, -0.13e0)), "
    + f"d AS (SELECT qid, id, name, {_km('qlat', 'qlng', 'lat', 'lng')} AS km FROM q, c), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY km, id) AS r FROM d) "
    "SELECT 'nearest' AS what, qid, name, round(km, 6) AS distance_km FROM n WHERE r = 1 UNION ALL SELECT 'within 50 km', qid, name, round(km, 6) FROM d WHERE qid = 0 AND km <= 50 UNION ALL SELECT 'within 800 km', qid, name, round(km, 6) FROM d WHERE qid = 0 AND km <= 800",
}
_DOCUMENT_F = "f AS (SELECT 'estimated' AS verify, a, b FROM est WHERE similarity >= 0.5 UNION ALL SELECT 'exact', ex.a, ex.b FROM ex JOIN cand ON ex.a = cand.a AND ex.b = cand.b)"
SQL |= {
    "documents_members": _of_documents(SQL["neardup_members"]),
    "documents_lsh_candidates": _of_documents(SQL["lsh_candidates"]),
    "documents_pairs_lsh": _of_documents(SQL["neardup_pairs_lsh"]),
    "documents_pairs_lsh_exact": _of_documents(SQL["neardup_pairs_lsh_exact"]),
    "documents_pairs_exact": _of_documents(SQL["neardup_pairs_exact"]),
    "documents_similar_lookup": _of_documents(SQL["similar_lookup_rows"]),
    "documents_quality": _of_documents(
        f"WITH {_SIGS}, {_EXACT.format(only='')}, {_DOCUMENT_F}, t AS (SELECT count(*) AS n FROM ex), g AS (SELECT verify, count(f.a) AS found, (SELECT n FROM t) AS \"true\", count(ex.a) AS \"both\" FROM (VALUES ('estimated'), ('exact')) y(verify) LEFT JOIN f USING (verify) LEFT JOIN ex ON f.a = ex.a AND f.b = ex.b GROUP BY verify) "
        "SELECT verify, found, \"true\", \"both\", CASE WHEN \"true\" = 0 THEN 1e0 ELSE round(\"both\" / CAST(\"true\" AS DOUBLE), 6) END AS recall, CASE WHEN found = 0 THEN 1e0 ELSE round(\"both\" / CAST(found AS DOUBLE), 6) END AS precision FROM g"
    ),
}
