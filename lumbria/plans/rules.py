"""Row rules and small reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text as x
from ..operators import reports as rp, rules as ru, zones as zo
from .places import _SQL, _hav, customers
from .relational import T

c = F.col


def _pick(k: str, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (c(k) % len(values) + 1).cast("int"))


def _no_stop(s: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    return T(s, d, "part").select("p_partkey", ru.no_stop_reason(k % 5 + 1, k % 7 > 0, k % 11 == 0, k % 13 > 0, F.when(k % 3 == 0, "Montañas").otherwise("Lagos"), F.when(k % 17 > 0, k * 31 % 6500)).alias("why"))


_NO_STOP = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN 'folklore' WHEN p_partkey % 5 = 4 THEN 'event' WHEN p_partkey % 7 = 0 THEN 'no_place' WHEN p_partkey % 11 = 0 THEN 'doubtful_place' WHEN p_partkey % 13 = 0 THEN 'no_sheet'
WHEN p_partkey % 3 = 0 AND p_partkey % 17 > 0 AND p_partkey * 31 % 6500 > 5000 THEN 'summit' END AS why FROM part"""


def _tickets(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "part").select("p_partkey", ru.ticket_kind(_pick("p_partkey", "Ingreso LIBRE", "Boleto turístico", "previa cita", "Gratuito los domingos"), F.when(c("p_partkey") % 5 < 2, c("p_partkey") % 5 * 4)).alias("kind"))


_TICKETS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'paid' WHEN p_partkey % 4 IN (0, 3) OR p_partkey % 5 = 0 THEN 'free' WHEN p_partkey % 4 = 1 THEN 'paid' ELSE 'unknown' END AS kind FROM part"


def _numbers(s: SparkSession, d: str) -> DataFrame:
    v = F.when(c("p_partkey") % 5 == 0, float("nan")).when(c("p_partkey") % 7 == 0, float("inf")).otherwise(c("p_size") / 4)
    return T(s, d, "part").select("p_partkey", ru.number_or_null(v, 1).alias("v"))


def _checks(s: SparkSession, d: str) -> DataFrame:
    p = customers(s, d)
    km = ru.far_from(c("lat"), c("lon"), (F.lit(-10.0), F.lit(-75.0)))
    return p.select("id", ru.doubtful_place(km, c("alt"), F.when(c("id") % 3 > 0, (c("id") * 17 % 4500).cast("double")), 400.0, 300.0, (c("id") % 40).cast("double")).alias("check"))


_CHECKS = f"{_SQL} SELECT id, ({_hav('lat', 'lon', '-10', '-75')} > 400 AND NOT coalesce(id % 3 > 0 AND abs(alt - id * 17 % 4500) <= 300, false)) OR (id % 40 <= 5 AND alt > 1000) AS \"check\" FROM c"


def _altitudes(s: SparkSession, d: str) -> DataFrame:
    k = c("id")
    return customers(s, d).select("id", ru.trusted_altitude(F.when(k % 5 > 0, c("alt")), F.when(k % 7 > 0, k * 17 % 4500)).alias("a")).select("id", "a.m", "a.source")


_ALTITUDES = f"{_SQL}, t AS (SELECT id, CASE WHEN id % 5 > 0 THEN alt END AS a, CASE WHEN id % 7 > 0 THEN (id * 17 % 4500)::DOUBLE END AS b FROM c) SELECT id, CASE WHEN (a IS NULL OR abs(a - b) > 500) AND b IS NOT NULL THEN b ELSE a END AS m, CASE WHEN (a IS NULL OR abs(a - b) > 500) AND b IS NOT NULL THEN 'model' WHEN a IS NOT NULL THEN 'sheet' END AS source FROM t"


def _ranking(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "part").withColumn("spend", c("p_partkey") % 7).withColumn("fit", c("p_partkey") % 10)
    return ru.compatibility(p, {"p_size": 0.45, "fit": 0.35, "p_retailprice": 0.2}, "spend", "p_partkey", 25)


_RANKING = "WITH t AS (SELECT max(p_size) AS a, max(p_partkey % 10) AS b, max(p_retailprice) AS c FROM part) SELECT p_partkey, round(0.45 * (p_size / a) + 0.35 * (p_partkey % 10 / b) + 0.2 * (p_retailprice / c), 9) AS score FROM part, t ORDER BY score DESC, p_partkey % 7 DESC, p_partkey LIMIT 25"


def _markers(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "part").select("p_partkey", ru.from_marker(F.concat(F.lit("rmk "), _pick("p_partkey", "METAR A 01=", "x SPECI B METAR C", "none", "SPECI=="), c("p_partkey").cast("string"), F.when(c("p_partkey") % 2 == 0, "=").otherwise("")), "METAR", "SPECI").alias("t"))


_MARKERS = "WITH t AS (SELECT p_partkey, 'rmk ' || ['METAR A 01=', 'x SPECI B METAR C', 'none', 'SPECI=='][p_partkey % 4 + 1] || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '=' ELSE '' END AS x FROM part) SELECT p_partkey, rtrim(substring(x, least(nullif(instr(x, 'METAR'), 0), nullif(instr(x, 'SPECI'), 0))), '=') AS t FROM t"


def _tiles(s: SparkSession, d: str) -> DataFrame:
    lat, lon = c("lat") + F.when(c("id") % 2 == 0, 20).otherwise(0), c("lon") + F.when(c("id") % 3 == 0, 100).otherwise(0)
    return customers(s, d).select("id", ru.tile_name(lat, lon).alias("tile"), ru.padded_window(lat, lon, 0.25, 2).alias("w")).select("id", "tile", "w.*")


_TILES = f"{_SQL}, t AS (SELECT id, lat + CASE WHEN id % 2 = 0 THEN 20 ELSE 0 END AS a, lon + CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END AS o FROM c) SELECT id, CASE WHEN a >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(abs(floor(a)) AS INT) AS VARCHAR), 2, '0') || CASE WHEN o >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(abs(floor(o)) AS INT) AS VARCHAR), 3, '0') AS tile, CAST(floor((90 - a) / 0.25) - 2 AS BIGINT) AS row0, CAST(floor((90 - a) / 0.25) + 2 AS BIGINT) AS row1, CAST(floor((o + 180) / 0.25) - 2 AS BIGINT) AS col0, CAST(floor((o + 180) / 0.25) + 2 AS BIGINT) AS col1 FROM t"


def _names(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "part").select("p_partkey", ru.cut_name(F.concat(F.lit("Hotel Sol "), c("p_partkey").cast("string"), _pick("p_partkey", "", " - Cel 987654321", ", www.sol.pe", " (084) 123", " telf. 01", " ana@sol.pe"))).alias("name"))


def _month(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "orders").select("o_orderkey", c("o_orderdate").cast("date").alias("start_date"), F.date_add(c("o_orderdate").cast("date"), (c("o_orderkey") % 40).cast("int")).alias("end_date"), (c("o_custkey") % 4).cast("string").alias("region"))
    return ru.month_view(e, "1997-06-01", "2").select("o_orderkey", "kind")


_MONTH = "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1997-06-01' THEN 'starts' ELSE 'goes on' END AS kind FROM orders WHERE o_custkey % 4 = 2 AND CAST(o_orderdate AS DATE) < DATE '1997-07-01' AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) >= DATE '1997-06-01'"


def _access(s: SparkSession, d: str) -> DataFrame:
    l = T(s, d, "lineitem").select(c("l_orderkey").alias("code"), (c("l_linenumber") % 2).alias("way"), (c("l_linenumber") * 100000 + c("l_partkey")).alias("seq"), (c("l_linenumber") % 3).cast("string").alias("start"), F.lit("x").alias("end"), c("l_quantity").alias("km"), F.when(c("l_partkey") % 9 > 0, (c("l_partkey") % 60).cast("double")).alias("minutes"), (c("l_suppkey") % 4).cast("string").alias("detail"), F.when(c("l_suppkey") % 3 == 0, "A pie").otherwise("Auto").alias("means"))
    return ru.access_summary(l)


def _nights(s: SparkSession, d: str) -> DataFrame:
    p = customers(s, d).select((c("id") % 50).alias("zone"), c("id").alias("place"), (c("id") % 4).cast("string").alias("kind"), (c("id") * 37 % 101).alias("trust")).where("place % 5 < 2")
    return ru.nightly(p, s.range(50).select(c("id").alias("zone"), (c("id") % 6).cast("int").alias("nights")))


_PROSE = {
    "Se celebra el 24 de junio": "fija 06-24", "del 5 al 9 de agosto": "fija 08-05..08-09", "28 de diciembre al 6 de enero": "fija 12-28..01-06", "el segundo domingo de mayo": "nesimo 05 2 dom", "último viernes de septiembre": "nesimo 09 -1 vie",
    "la primera semana de octubre": "fija 10-01..10-07", "de noviembre a febrero": "mes 11..02", "en Marzo": "mes 03", "sin fecha": None,
}


def _prose(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "part").select("p_partkey", dates.prose_rule(_pick("p_partkey", *_PROSE)).alias("r")).select("p_partkey", "r.rule", F.date_format(dates.rule_dates(c("r.rule"), F.lit(2026))["starts"], "yyyy-MM-dd").alias("starts"))


_STARTS = ["2026-06-24", "2026-08-05", "2026-12-28", "2026-05-10", "2026-09-25", "2026-10-01", "2026-11-01", "2026-03-01", None]
_listed = lambda v: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + "]"


def _assigned(s: SparkSession, d: str) -> DataFrame:
    p = customers(s, d).withColumn("block", F.floor("lat").cast("long"))
    m = p.where("id % 4 = 0").select("block", (c("block") * 1000 + F.floor("lon")).alias("zone"), "lat", "lon", "alt")
    return zo.assigned(m, p.where("id % 4 > 0").select("block", "id", (c("id") % 7).alias("place"), "lat", "lon", "alt", (c("id") % 3 > 0).alias("counts")), limit_km=250.0)


def _systems(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "orders").select(_pick("o_orderkey", "engine", "guide", "variant").alias("system"), (c("o_custkey") % 97).alias("query"), (c("o_orderkey") * 7 % 61).alias("zone")).distinct()


_SYSTEMS = "p AS (SELECT DISTINCT ['engine', 'guide', 'variant'][o_orderkey % 3 + 1] AS system, o_custkey % 97 AS query, o_orderkey * 7 % 61 AS zone FROM orders)"


def _zone_facts(s: SparkSession) -> DataFrame:
    return s.range(61).select(c("id").alias("zone"), (c("id") % 3 == 0).alias("off_circuit"), (c("id") % 10 / 10).alias("novelty"))


_NOTICES = {
    "Contacto: María Quispe de la Cruz, lunes a viernes": "Contacto: [name], lunes a viernes", "coordinar con el Sr. Juan Huamán Rojas.": "coordinar con el Sr. [name].", "Responsable - Ana Ñaupa Soto (084)": "Responsable - [name] (084)",
    "Museo Don Bosco abierto": "Museo Don [name] abierto", "encargada de sala": "encargada de sala", "Plaza de Armas de Cusco": "Plaza de Armas de Cusco", "Ing. Luis Ríos": "Ing. [name]",
}


QUERIES = {
    "F4_names": (lambda s, d: T(s, d, "part").select("p_partkey", x.names_redacted(_pick("p_partkey", *_NOTICES)).alias("t")), f"SELECT p_partkey, {_listed(_NOTICES.values())}[p_partkey % 7 + 1] AS t FROM part"),
    "F25_prose_dates": (_prose, f"SELECT p_partkey, {_listed(_PROSE.values())}[p_partkey % 9 + 1] AS rule, {_listed(_STARTS)}[p_partkey % 9 + 1] AS starts FROM part"),
    "G11_assigned_zones": (_assigned, None),
    "A30_system_coverage": (lambda s, d: rp.system_coverage(_systems(s, d), _zone_facts(s)).select("system", "proposals", "zones", *(F.round(x, 9).alias(x) for x in ("off_circuit", "novelty", "share"))), f"WITH {_SYSTEMS} SELECT system, count(*) AS proposals, count(DISTINCT zone) AS zones, round(avg(CASE WHEN zone % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS off_circuit, round(avg(zone % 10 / 10), 9) AS novelty, round(count(DISTINCT zone) / 61, 9) AS share FROM p GROUP BY 1"),
    "A30_shared_zones": (lambda s, d: rp.shared_zones(_systems(s, d)), f"WITH {_SYSTEMS}, z AS (SELECT DISTINCT system, zone FROM p), n AS (SELECT system, count(*) AS n FROM z GROUP BY 1), j AS (SELECT a.system AS a, b.system AS b, count(*) AS k FROM z a JOIN z b ON a.zone = b.zone AND a.system < b.system GROUP BY 1, 2) SELECT a, b, CAST(k AS INT) AS \"both\", CAST(x.n + y.n - k AS INT) AS \"any\" FROM j JOIN n x ON x.system = a JOIN n y ON y.system = b"),
    "P3_no_stop_reason": (_no_stop, _NO_STOP),
    "P4_ticket_kind": (_tickets, _TICKETS),
    "P5_numbers": (_numbers, "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN round_even(p_size / 4, 1) END AS v FROM part"),
    "P9_doubtful_places": (_checks, _CHECKS),
    "P10_trusted_altitude": (_altitudes, _ALTITUDES),
    "P12_plausible_ways": (lambda s, d: T(s, d, "lineitem").where(ru.plausible(c("l_quantity"), (c("l_partkey") % 300).cast("double"))).select("l_orderkey", "l_linenumber", "l_partkey"), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity BETWEEN 0.5 AND 1500 AND l_partkey % 300 BETWEEN 1 AND 3000 AND l_quantity * 60 / (l_partkey % 300) BETWEEN 2 AND 110"),
    "G37_event_ranking": (_ranking, _RANKING),
    "Q4_from_marker": (_markers, _MARKERS),
    "Q5_tile_windows": (_tiles, _TILES),
    "Q8_cut_names": (_names, "SELECT p_partkey, 'Hotel Sol ' || p_partkey || CASE WHEN p_partkey % 6 = 3 THEN ' (084) 123' ELSE '' END AS name FROM part"),
    "Q10_month_view": (_month, _MONTH),
    "F13_access_summary": (_access, None),
    "G35_nightly_places": (_nights, None),
}
