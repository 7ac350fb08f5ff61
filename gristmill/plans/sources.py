"""Queries of CSV sources, the durable store, the growing index and the point table, and their SQL.

Those that need files write them first, from the given tables, to the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.geo import squared_distance_to_box, unit_xyz
from gristmill.operators import geo, kv, neardup
from gristmill.plans import reference as ref
from gristmill.session import register_written, shared_dir
from gristmill.sources.columns import column_index, csv_line, document_text, parse_line, parse_lines, read_columns
from gristmill.sources.kv_store import KvStore
from gristmill.sources.points import random_points


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the process."""
    return register_written(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


# CSV files.

HEADER = ' "Doc Id" ,TITLE , Source,lang'


def _documents_csv(spark: SparkSession, folder: str) -> str:
    """Files of CSV, each with the header in its first line: the documents' titles, sources and languages."""
    path = _place(spark, "csv")
    docs = ref._read(spark, folder, "documents")
    rows = docs.select(csv_line(F.col("doc_id"), F.concat(F.lit(" "), "title", F.lit("\t")), F.col("source"), F.col("lang")).alias("value"))

    def with_header(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([HEADER])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    rows.mapInArrow(with_header, "value string").write.text(path)
    return path


def csv_two_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and sources read back from CSV by name; rows without a title are dropped."""
    return read_columns(spark, _documents_csv(spark, folder), "title", "SOURCE")


def csv_one_column(spark: SparkSession, folder: str) -> DataFrame:
    return read_columns(spark, _documents_csv(spark, folder), "doc id")


def csv_column_index(spark: SparkSession, folder: str) -> DataFrame:
    """Places of column names in the header of the CSV files, -1 for one that isn't there."""
    head = parse_line(spark.read.text(_documents_csv(spark, folder)).where(F.lower("value").contains("doc id")).first()[0])
    names = ["doc id", "Title", " SOURCE ", "lang", "text", ""]
    return spark.createDataFrame([(n, column_index(head, n)) for n in names], "name string, place int")


def csv_fields(spark: SparkSession, folder: str) -> DataFrame:
    """(line_no, pos, field): the fields of every raw line by the tolerant parser, broken quotes and all."""
    lines = ref._read(spark, folder, "claims_raw").select("line_no", "line").where("line is not null")
    return parse_lines(lines, "line").select("line_no", F.posexplode("fields").alias("pos", "field"))


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) with title and text as one."""
    docs = ref._read(spark, folder, "documents")
    return docs.select("doc_id", document_text(F.col("title"), F.col("text")).alias("text"))


# The durable store.


def _store(spark: SparkSession, folder: str) -> KvStore:
    """A store that the whole log has been applied to, in three batches one after the other."""
    log = ref._read(spark, folder, "kv_log")
    top = log.agg(F.max("seq")).first()[0] or 0
    store = KvStore(spark, _place(spark, "store"), page_bytes=1024)
    for lo, hi in ((None, top // 3), (top // 3, 2 * top // 3), (2 * top // 3, None)):
        part = F.lit(True)
        if lo is not None:
            part &= F.col("seq") > lo
        if hi is not None:
            part &= F.col("seq") <= hi
        store.apply(log.where(part))
    return store


def kv_store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value) of a store that is opened again, by its path only."""
    return KvStore(spark, _store(spark, folder).path).table().select("key", "value")


def kv_store_created(spark: SparkSession, folder: str) -> DataFrame:
    """(page_bytes, records) of new stores, by the page size asked for; small pages are raised."""
    rows = []
    for asked in (1, 512, 4096):
        store = KvStore(spark, _place(spark, "store"), page_bytes=asked)
        rows.append((asked, store.page_bytes, store.table().count()))
    return spark.createDataFrame(rows, "asked int, page_bytes int, records bigint")


def kv_store_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What the pointer of a store says after three batches: its number, its deltas, its page size, also when opened with another."""
    store = _store(spark, folder)
    again = KvStore(spark, store.path, page_bytes=4096)
    meta = again.meta()
    return spark.createDataFrame([(meta["number"], len(meta["deltas"]), again.page_bytes)], "version int, deltas int, page_bytes int")


def kv_store_seen_by_others(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value) as a second store sees them that was opened before the last changes and never told of them."""
    log = ref._read(spark, folder, "kv_log")
    first = KvStore(spark, _place(spark, "store"))
    second = KvStore(spark, first.path)
    first.apply(log)
    first.put("written last", "x")
    return second.table().select("key", "value")


def kv_store_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """(records, tombstones, same) after compaction: live records only, and whether the content is what it was."""
    store = _store(spark, folder)
    before = store.table().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "value")).alias("x")).first()
    store.compact()
    after = store.table().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "value")).alias("x")).first()
    held = store.records().agg(F.sum("records").alias("records"), F.sum(F.when(F.col("op") == "delete", F.col("records")).otherwise(0)).alias("tombstones"))
    return held.select(F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("tombstones", F.lit(0)).cast("long").alias("tombstones"), F.lit(before == after).alias("same"))


def kv_store_destroyed(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a store is there before and after it is destroyed, and its records when it is made anew."""
    store = _store(spark, folder)
    before = store.exists()
    store.destroy()
    after = store.exists()
    return spark.createDataFrame([(before, after, KvStore(spark, store.path).table().count())], "before boolean, after boolean, records bigint")


def kv_get(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value) of single look-ups: the first, the last, the busiest and the empty key, and one that isn't there."""
    store = _store(spark, folder)
    ops = ref._ops(spark, folder)
    by = ops.groupBy("key").agg(F.count("*").alias("n"))
    first, last, busiest = by.agg(F.min("key"), F.max("key"), F.max_by("key", F.struct("n", "key"))).first()
    return spark.createDataFrame([(k, store.get(k)) for k in sorted({first, last, busiest, "", "no such key"} - {None})], "key string, value string")


def kv_bucket_files(spark: SparkSession, folder: str) -> DataFrame:
    """(depth, prefix, file_bytes) of each bucket of the layout: its page, doubled until it fits."""
    return ref.kv_buckets(spark, folder).select("depth", "prefix", kv.file_bytes(F.col("bytes"), 1024).alias("file_bytes"))


# The growing index.


def _index(spark: SparkSession, folder: str) -> neardup.SignatureIndex:
    """All claims, added in two parts."""
    index = neardup.SignatureIndex(spark, _place(spark, "index"), ref.PARAMS)
    claims = ref._claims(spark, folder)
    for part in (0, 1):
        index.add(claims.where(F.pmod("id", F.lit(2)) == part), "id", "claim")
    return index


def index_added_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicates of an index that was added to: the same as those of one built at once."""
    return _index(spark, folder).duplicates()


def index_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(q, id): entries that share a band with the text of each id divisible by 100, not verified."""
    asked = ref._claims(spark, folder).where("id % 100 = 0")
    return _index(spark, folder).candidates_of(asked, "id", "claim")


def index_size(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(_index(spark, folder).size(),)], "entries bigint")


def index_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(id, place, value) of the signatures of each id divisible by 100."""
    asked = ref._claims(spark, folder).where("id % 100 = 0")
    return _index(spark, folder).signatures(asked).select("id", F.posexplode("sig").alias("place", "value")).select("id", "place", F.col("value").cast("long").alias("value"))


# Points.


def geo_shown(spark: SparkSession, folder: str) -> DataFrame:
    """Each point as name(lat, lng)."""
    return ref._points(spark, folder).select("id", geo.shown(F.col("name"), F.col("lat"), F.col("lng")).alias("shown"))


def geo_box_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Squared distance of each point, on the unit sphere, to a box around the first city."""
    x, y, z = unit_xyz(F.lit(ref.CITIES[0][1]), F.lit(ref.CITIES[0][2]))
    box = (x - 0.1, y - 0.1, z - 0.1), (x + 0.1, y + 0.1, z + 0.1)
    return ref._points(spark, folder).select("id", F.round(squared_distance_to_box(unit_xyz(F.col("lat"), F.col("lng")), *box), 6).alias("distance2"))


def _point_table(spark: SparkSession, folder: str) -> tuple[geo.PointTable, DataFrame]:
    p = ref._points(spark, folder)
    table = geo.PointTable(p.where(F.pmod("id", F.lit(2)) == 0))
    table.insert(p.where(F.pmod("id", F.lit(2)) == 1))
    return table, ref._queries(p)


def geo_inserted_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Look-ups in a table of points that was inserted into."""
    table, q = _point_table(spark, folder)
    return table.find_in_radius(q, ref.RADIUS_KM).withColumn("distance_km", F.round("distance_km", 6))


def geo_inserted_nearest(spark: SparkSession, folder: str) -> DataFrame:
    table, q = _point_table(spark, folder)
    return table.find_nearest(q).withColumn("distance_km", F.round("distance_km", 6))


def geo_table_size(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(_point_table(spark, folder)[0].size(),)], "points bigint")


def random_point_table(spark: SparkSession, folder: str) -> DataFrame:
    """The first thousand seeded points."""
    return random_points(spark, 1000).select("id", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "name")


_ALL = (
    csv_two_columns, csv_one_column, csv_column_index, csv_fields, document_texts,
    kv_store_created, kv_store_roundtrip, kv_store_versions, kv_store_seen_by_others, kv_store_compacted, kv_store_destroyed, kv_get, kv_bucket_files,
    index_added_pairs, index_candidates, index_size, index_signatures,
    geo_shown, geo_box_distance, geo_inserted_radius, geo_inserted_nearest, geo_table_size, random_point_table,
)
QUERIES = {f.__name__: f for f in _ALL}

# Blanks and control characters at both ends go, as CSV values are trimmed; line breaks within are blanks in the files.
_TRIM = r"regexp_replace(regexp_replace({x}, '[\r\n]', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
# The seeded generator in whole numbers of 128 bits; a double takes the upper 26 and 27 bits of two states in a row.
_RANDOM = """WITH RECURSIVE r(n, s) AS (SELECT 0, CAST((42 # 25214903917) AS HUGEINT) UNION ALL SELECT n + 1, (s * 25214903917 + 11) % 281474976710656 FROM r WHERE n < {states}),
d AS (SELECT (n - 1) // 2 AS k, sum(CASE WHEN n % 2 = 1 THEN (s // 4194304) * 134217728 ELSE s // 2097152 END) AS v FROM r WHERE n > 0 GROUP BY 1),
p AS (SELECT k // 2 AS i, max(CASE WHEN k % 2 = 0 THEN CAST(v AS DOUBLE) / 9007199254740992e0 * 180e0 - 90e0 END) AS lat, max(CASE WHEN k % 2 = 1 THEN CAST(v AS DOUBLE) / 9007199254740992e0 * 360e0 - 180e0 END) AS lng FROM d GROUP BY 1)""".replace("42 # 25214903917", "xor(CAST(42 AS BIGINT), CAST(25214903917 AS BIGINT))")
_FIELD = r'(?:[^",]|"(?:[^"]|"")*(?:"|$))*'
_BOX = "cos(radians(55.7558e0)) * cos(radians(37.6173e0))", "cos(radians(55.7558e0)) * sin(radians(37.6173e0))", "sin(radians(55.7558e0))"
_XYZ = "cos(radians(lat)) * cos(radians(lng))", "cos(radians(lat)) * sin(radians(lng))", "sin(radians(lat))"
_GAP = " + ".join(f"pow(greatest(({b}) - 0.1e0 - ({v}), ({v}) - (({b}) + 0.1e0), 0e0), 2)" for b, v in zip(_BOX, _XYZ))

SQL = {
    "csv_two_columns": f"SELECT {_TRIM.format(x='title')} AS key, {_TRIM.format(x='coalesce(source, chr(32))')} AS value FROM documents WHERE title IS NOT NULL AND {_TRIM.format(x='title')} <> ''",
    "csv_one_column": "SELECT CAST(doc_id AS VARCHAR) AS key FROM documents",
    "csv_column_index": "SELECT name, CAST(place AS INTEGER) AS place FROM (VALUES ('doc id', 0), ('Title', 1), (' SOURCE ', 2), ('lang', 3), ('text', -1), ('', -1)) v(name, place)",
    # A field is a row of plain characters and quoted stretches; of a stretch, the quotes around it go and double ones inside become one.
    "csv_fields": rf"""
WITH f AS (SELECT line_no, regexp_extract_all(',' || line, '(?s),({_FIELD})', 1) AS p FROM claims_raw WHERE line IS NOT NULL),
u AS (SELECT line_no, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS x FROM f),
s AS (SELECT line_no, pos, regexp_extract_all(x, '(?s)[^"]+|"(?:[^"]|"")*(?:"|$)') AS q FROM u)
SELECT line_no, CAST(pos AS INTEGER) AS pos, coalesce(array_to_string(list_transform(q, lambda z: CASE WHEN z[1] <> '"' THEN z ELSE replace(substr(z, 2, length(z) - 1 - CASE WHEN (length(z) - length(replace(z, '"', ''))) % 2 = 0 THEN 1 ELSE 0 END), '""', '"') END), ''), '') AS field FROM s""",
    "document_texts": "SELECT doc_id, coalesce(title, '') || ' ' || coalesce(text, '') AS text FROM documents",
    "kv_store_created": "SELECT CAST(asked AS INTEGER) AS asked, CAST(greatest(asked, 512) AS INTEGER) AS page_bytes, CAST(0 AS BIGINT) AS records FROM (VALUES (1), (512), (4096)) v(asked)",
    "kv_store_roundtrip": f"WITH {ref._SNAP} SELECT key, value FROM snap",
    "kv_store_versions": "SELECT CAST(3 AS INTEGER) AS version, CAST(3 AS INTEGER) AS deltas, CAST(1024 AS INTEGER) AS page_bytes",
    "kv_store_seen_by_others": f"WITH {ref._SNAP} SELECT key, value FROM snap WHERE key <> 'written last' UNION ALL SELECT 'written last', 'x'",
    "kv_store_compacted": f"WITH {ref._SNAP} SELECT count(*) AS records, CAST(0 AS BIGINT) AS tombstones, true AS same FROM snap",
    "kv_store_destroyed": "SELECT true AS before, false AS after, CAST(0 AS BIGINT) AS records",
    "kv_get": f"WITH {ref._SNAP}, n AS (SELECT key, count(*) AS n FROM o WHERE op IN ('put', 'get', 'delete') GROUP BY key), a AS (SELECT min(key) AS key FROM n UNION SELECT max(key) FROM n UNION SELECT arg_max(key, (n, key)) FROM n UNION SELECT '' UNION SELECT 'no such key') SELECT a.key, snap.value FROM a LEFT JOIN snap ON a.key = snap.key",
    "kv_bucket_files": f"WITH {ref._LAYOUT} SELECT depth, prefix, CAST(1024 * pow(2, greatest(0, ceil(log2((bytes + 8) / 1024e0)))) AS BIGINT) AS file_bytes FROM lv",
    "index_added_pairs": f"WITH {ref._SIGS} SELECT a, b, similarity FROM est WHERE similarity >= 0.5",
    "index_candidates": f"WITH {ref._SIGS}, e AS (SELECT mem.id, bd.band, bd.k FROM mem JOIN bd ON mem.class_id = bd.id) SELECT DISTINCT x.id AS q, y.id AS id FROM e x JOIN e y ON x.band = y.band AND x.k = y.k WHERE x.id % 100 = 0",
    "index_size": "SELECT count(*) AS entries FROM (SELECT DISTINCT id, coalesce(claim, '') AS claim FROM claims_test WHERE id IS NOT NULL)",
    "index_signatures": f"WITH {ref._SHINGLES}, {ref._PARAMS}, q AS (SELECT id FROM d WHERE id % 100 = 0) SELECT q.id, CAST(i AS INTEGER) AS place, coalesce(min((a * s + b) % 2147483647), 2147483647) AS value FROM q CROSS JOIN prm LEFT JOIN s ON q.id = s.id GROUP BY q.id, i",
    "geo_shown": f"WITH {ref._PTS.split(', q AS')[0].replace('arg_min(lng, loaded_at) AS lng', 'arg_min(lng, loaded_at) AS lng, arg_min(coalesce(name, chr(0)), loaded_at) AS name')} SELECT id, (CASE WHEN name = chr(0) THEN 'null' ELSE name END) || '(' || CAST(lat AS VARCHAR) || ', ' || CAST(lng AS VARCHAR) || ')' AS shown FROM g",
    "geo_box_distance": f"WITH {ref._PTS} SELECT id, round({_GAP}, 6) AS distance2 FROM g",
    "geo_inserted_radius": ref.SQL["geo_radius"],
    "geo_inserted_nearest": ref.SQL["geo_nearest"],
    "geo_table_size": f"WITH {ref._PTS} SELECT count(*) AS points FROM g",
    "random_point_table": _RANDOM.format(states=4000) + " SELECT CAST(i AS BIGINT) AS id, round(lat, 9) AS lat, round(lng, 9) AS lng, 'p' || i AS name FROM p",
    "geo_random_radius": _RANDOM.format(states=8000) + f", k AS (SELECT CAST(q.i - 1000 AS BIGINT) AS qid, CAST(p.i AS BIGINT) AS id, {ref._km('q.lat', 'q.lng', 'p.lat', 'p.lng')} AS km FROM p, p q WHERE p.i < 1000 AND q.i >= 1000) SELECT qid, id, round(km, 6) AS distance_km FROM k WHERE km <= 100",
}
