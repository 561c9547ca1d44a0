"""Files of several kinds, parsers, matching, clusters and ways, each over files or rows made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distances, text as x
from ..operators import network as nw, trips as tr, zones as zo
from ..session import scratch
from ..sources import files
from .places import _LAT, _LON, _SQL, _hav, customers, suppliers
from .relational import T

c = F.col


def _sniffed(s: SparkSession, d: str) -> DataFrame:
    """Parts in three files: Windows-1252 with semicolons, UTF-8 with commas, UTF-8 with tabs."""
    path = scratch(s, "sniffed")
    s.conf.set("spark.sql.legacy.javaCharsets", "true")
    p = T(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" ñandú")).alias("p_name"), "p_size")
    for k, (sep, encoding) in enumerate(((";", "windows-1252"), (",", "utf-8"), ("\t", "utf-8"))):
        p.where(c("p_partkey") % 3 == k).write.mode("append").csv(path, sep=sep, encoding=encoding, header=True, lineSep="\n")
    return files.read_sniffed(s, f"{path}/*.csv").select(F.col("cells.p_partkey").cast("long").alias("p_partkey"), F.col("cells.p_name").alias("p_name"), F.col("cells.p_size").cast("int").alias("p_size"))


def _html(s: SparkSession, d: str) -> DataFrame:
    r = files.html_record(c("html"))
    return T(s, d, "pages").select("page_id", r.alias("r")).select("page_id", F.coalesce("r.title", F.lit("")).alias("title"), F.size("r.headings").alias("headings"), F.array_join("r.links", " ").alias("links"), F.size("r.paragraphs").alias("paragraphs"), F.array_join("r.cells", "|").alias("cells"))


def _html_sql() -> str:
    every = lambda p: f"regexp_extract_all(coalesce(html, ''), '{p}', 1, 'is')"
    plain = lambda e: f"trim(regexp_replace(regexp_replace({e}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
    inside = lambda tag: f"list_transform({every(f'<{tag}\\b[^>]*>(.*?)</{tag}>')}, lambda v: {plain('v')})"
    link = every("<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"''>]*)")
    return f"SELECT page_id, coalesce({inside('title')}[1], '') AS title, CAST(len({inside('h[1-3]')}) AS INT) AS headings, coalesce(array_to_string({link}, ' '), '') AS links, CAST(len({inside('p')}) AS INT) AS paragraphs, coalesce(array_to_string({inside('t[dh]')}, '|'), '') AS cells FROM pages"


def _osm(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as nodes and orders' suppliers as ways of map files, read back with a filter on tags."""
    path = scratch(s, "osm")
    node = suppliers(s, d).select(F.format_string('<node id="%d" lat="%s" lon="%s"><tag k="place" v="%s"/></node>', "s_id", c("lat").cast("string"), c("lon").cast("string"), F.when(c("s_id") % 3 == 0, "town").otherwise("village")).alias("value"))
    ref = T(s, d, "lineitem").where("l_orderkey % 10 = 1").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda v: F.format_string('<nd ref="%d"/>', v["l_suppkey"])), "").alias("nd"))
    way = ref.select(F.format_string('<way id="%d">%s<tag k="highway" v="%s"/></way>', "l_orderkey", "nd", F.when(c("l_orderkey") % 4 == 1, "primary").otherwise("path")).alias("value"))
    parts = node.unionByName(way).withColumn("block", F.pmod(F.xxhash64("value"), F.lit(8)))
    whole = parts.groupBy("block").agg(F.concat(F.lit("<osm>"), F.array_join(F.collect_list("value"), ""), F.lit("</osm>")).alias("value"))
    whole.write.partitionBy("block").text(path)
    nodes, ways = files.read_osm(s, path)
    return ways.where("tags['highway'] = 'primary'").select(c("id").alias("way"), F.posexplode("nodes").alias("seq", "id")).join(nodes.where("tags['place'] = 'town'"), "id").select("way", "seq", c("id").alias("node"), F.round("lat", 6).alias("lat"))


_OSM = "WITH n AS (SELECT s_suppkey AS id, " + _LAT.format(k="s_suppkey").replace("0D", "0::DOUBLE") + " AS lat FROM supplier WHERE s_suppkey % 3 = 0), w AS (SELECT l_orderkey AS way, l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS seq FROM lineitem WHERE l_orderkey % 10 = 1 AND l_orderkey % 4 = 1) SELECT way, CAST(seq AS INT) AS seq, id AS node, round(lat, 6) AS lat FROM w JOIN n USING (id)"


def _rasters(s: SparkSession, d: str) -> DataFrame:
    """Orders counted into two layers of a grid, as one compressed array file that each segment's task writes."""
    path = scratch(s, "rasters")
    n = T(s, d, "orders").groupBy((c("o_custkey") % 3).alias("file"), (c("o_orderkey") % 2).alias("layer"), (c("o_orderkey") % 7).alias("row"), (c("o_custkey") % 11).alias("col")).agg(F.count(F.lit(1)).alias("n"))

    def write(batches):
        import io

        import numpy as np
        import pyarrow as pa

        rows: dict = {}
        for b in batches:
            for f, *at, v in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                rows.setdefault(f, []).append((*at, v))
        for f, cells in rows.items():
            a = np.full((2, 7, 11), np.nan)
            for k, r, q, v in cells:
                a[k, r, q] = v
            out = io.BytesIO()
            np.savez_compressed(out, n=a)
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([out.getvalue()], pa.binary())], names=["file", "raw"])

    made = n.repartition(3, "file").mapInArrow(write, "file long, raw binary")
    # Spark has no sink of raw files: the bytes go through a table and then to the reader's parser.
    made.select(c("file").cast("string").alias("file"), c("raw").alias("content")).write.parquet(path)
    return files.raster_cells(s.read.parquet(path)).groupBy("layer", "row", "col").agg(F.sum("value").cast("long").alias("n"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    words = ("12 km / 1 h 20 min", "2 km 300 metros", "3 dias de ida y tres dias de retorno", "2h 35m", "150 m / 15 m", "61 K. 40 m.", "20:00 minutos", "50 km / 1:20 min", "1.45 horas", "media hora", "1,300 m", "sin dato")
    p = T(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, words)), (c("p_partkey") % 12 + 1).cast("int")).alias("t"))
    return p.select("p_partkey", distances.distance_time(c("t")).alias("v")).select("p_partkey", "v.*")


_CELLS = "SELECT p_partkey, [12, 2.3, NULL, NULL, 0.15, 61, NULL, 50, NULL, NULL, 1.3, NULL][p_partkey % 12 + 1]::DOUBLE AS km, [80, NULL, 4320, 155, 15, 40, 20, 80, 105, 30, NULL, NULL][p_partkey % 12 + 1]::DOUBLE AS minutes, p_partkey % 12 IN (7, 8) AS ambiguous FROM part"
_FEASTS = [("san juan", "06-24"), ("virgen del carmen", "07-16"), ("corpus", "easter+60"), ("semana santa", "easter-7..easter"), ("aniversario", "01-18")]


def _feasts(s: SparkSession, d: str) -> DataFrame:
    names = ("Fiesta de San Juan y Corpus", "VIRGEN DEL CARMÉN", "Corpus Christi", "Desanimado", "Aniversario de la ciudad", "Semana Santa")
    p = T(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (c("p_partkey") % 6 + 1).cast("int")).alias("t"))
    return p.select("p_partkey", zo.feast(c("t"), _FEASTS).alias("rule"))


def _snapped(s: SparkSession, d: str) -> DataFrame:
    layer = lambda k: F.element_at(F.array(*map(F.lit, ("road", "train", "boat"))), (k % 3 + 1).cast("int")).alias("layer")
    return nw.snapped(customers(s, d).select("id", "lat", "lon", layer(c("id"))), suppliers(s, d).select(c("s_id").alias("id"), "lat", "lon", layer(c("s_id"))), {"road": 150.0, "train": 90.0, "boat": 60.0}).select("id", "layer", "vertex", F.round("km", 6).alias("km"))


_SNAPPED = f"""{_SQL}, l AS (SELECT 0 AS m, 'road' AS layer, 150 AS lim UNION ALL SELECT 1, 'train', 90 UNION ALL SELECT 2, 'boat', 60), p AS (SELECT c.id, layer, s.s_id AS vertex, {_hav('c.lat', 'c.lon', 's.r_lat', 's.r_lon')} AS km, lim FROM c JOIN l ON c.id % 3 = m JOIN s ON s.s_id % 3 = m),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, vertex) AS r FROM p WHERE km <= lim) SELECT id, layer, vertex, round(km, 6) AS km FROM q WHERE r = 1"""


def _door(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", nw.door_to_door(c("l_quantity"), c("l_quantity") / 2, c("l_partkey") % 1000, c("l_suppkey") % 3, 4.0, 2.5, 10.0).alias("v"))
    return e.select("l_orderkey", "l_linenumber", F.round("v.minutes", 6).alias("minutes"), F.round("v.km", 6).alias("km"))


def _orders_of_five(s: SparkSession, d: str) -> DataFrame:
    p = customers(s, d).where("id > 0").withColumn("trip", F.expr("id div 5").cast("long"))
    lat, lon = -12.0 + (c("id") * 7 % 13) * 0.02, -77.0 + (c("id") * 3 % 7) * 0.03
    stop = p.select("trip", c("id").alias("stop"), lat.alias("lat"), lon.alias("lon"), F.lit(-12.0).alias("base_lat"), F.lit(-77.0).alias("base_lon"), F.lit(0.0).alias("visit"), F.lit(0.0).alias("opens"), F.lit(1440.0).alias("closes"), F.lit(1.0).alias("value"), F.lit("a").alias("kind"))
    return tr.best_order(stop).select("trip", F.round("given", 6).alias("given"), F.round("best", 6).alias("best"))


def _km(a: str, b: str) -> str:
    return _hav(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


_FIVE = f"""WITH RECURSIVE p AS (SELECT c_custkey // 5 AS trip, c_custkey AS stop, -12.0::DOUBLE + (c_custkey * 7 % 13) * 0.02::DOUBLE AS lat, -77.0::DOUBLE + (c_custkey * 3 % 7) * 0.03::DOUBLE AS lon FROM customer WHERE c_custkey > 0),
o AS (SELECT -12.0::DOUBLE AS lat, -77.0::DOUBLE AS lon), n AS (SELECT trip, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT p.trip, [p.stop] AS seen, p.lat, p.lon, {_km('o', 'p')} AS km FROM p, o UNION ALL SELECT w.trip, list_append(w.seen, p.stop), p.lat, p.lon, w.km + {_km('w', 'p')} FROM w JOIN p ON p.trip = w.trip AND NOT list_contains(w.seen, p.stop)),
e AS (SELECT w.trip, w.seen, (w.km + {_km('w', 'o')}) * 1.5 AS m FROM w JOIN n USING (trip), o WHERE len(w.seen) = n.n)
SELECT CAST(trip AS BIGINT) AS trip, round(min(m) FILTER (seen = list_sort(seen)), 6) AS given, round(min(m), 6) AS best FROM e GROUP BY 1"""


def _matched(s: SparkSession, d: str) -> DataFrame:
    left = customers(s, d).select("id", F.concat(F.lit("Museo "), c("id") % 40, F.lit(" de Ñaupa")).alias("name"), (c("id") % 2).alias("kind"), "lat", "lon")
    right = suppliers(s, d).select(c("s_id").alias("r_id"), F.concat(F.lit("de naupa museo "), c("s_id") % 40).alias("r_name"), (c("s_id") % 2).alias("r_kind"), "lat", "lon")
    return zo.matched(left, right, 200.0, 0.9).select("id", "r_id", F.round("ratio", 6).alias("ratio"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return zo.kmeans_sweep(customers(s, d), ["lat", "lon", "alt"], [3, 5])


QUERIES = {
    "S3_sniffed_csv": (_sniffed, "SELECT p_partkey, p_name || ' ñandú' AS p_name, p_size FROM part"),
    "S4_html_records": (_html, _html_sql()),
    "S6_map_file": (_osm, _OSM),
    "S8_rasters": (_rasters, "SELECT CAST(o_orderkey % 2 AS INT) AS layer, CAST(o_orderkey % 7 AS INT) AS \"row\", CAST(o_custkey % 11 AS INT) AS col, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "F6_distance_time": (_cells, _CELLS),
    "F26_feasts": (_feasts, "SELECT p_partkey, ['06-24', '07-16', 'easter+60', NULL, '01-18', 'easter-7..easter'][p_partkey % 6 + 1] AS rule FROM part"),
    "G6_snapped": (_snapped, _SNAPPED),
    "G8_door_to_door": (_door, "SELECT l_orderkey, l_linenumber, round(l_quantity + 4 + (l_partkey % 1000) * 1.3::DOUBLE / 1000 * 2.5 + (l_suppkey % 3) * 10, 6) AS minutes, round(l_quantity / 2 + (l_partkey % 1000) * 1.3::DOUBLE / 1000, 6) AS km FROM lineitem"),
    "G17_best_order": (_orders_of_five, _FIVE),
    "J18_name_matches": (_matched, None),
    "G13_kmeans_sweep": (_clusters, None),
}
