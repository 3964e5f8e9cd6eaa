"""Domain tables derived from the star-schema test data.

The test data has no positions, so reports, detections, feeds and rasters are
derived from it by integer arithmetic and md5. Each derivation is one SELECT
written in the common subset of Spark SQL and DuckDB SQL, so the Spark operators
and the oracle start from the same rows. Only this module depends on test data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

EPOCH_US = 1_704_067_200_000_000


@dataclass(frozen=True)
class Dialect:
    """The few spots where the two SQL dialects differ."""

    name: str
    folder: str = ""

    def table(self, t: str) -> str:
        return f"parquet.`{self.folder}/{t}.parquet`" if self.name == "spark" else t

    def div(self, a: str, b) -> str:
        return f"(({a}) div {b})" if self.name == "spark" else f"(({a}) // {b})"

    def micros(self, ts: str) -> str:
        if self.name == "spark":
            zero = "cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"
            return f"(unix_micros(cast({ts} as timestamp)) - unix_micros({zero}))"
        return f"(epoch_us({ts}) - {EPOCH_US})"

    def hex8(self, text: str) -> str:
        """First eight hex digits of md5 as BIGINT."""
        if self.name == "spark":
            return f"cast(conv(substr(md5({text}), 1, 8), 16, 10) as bigint)"
        return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"

    def hash8(self, expr: str) -> str:
        return self.hex8(f"concat('7|', cast({expr} as {self.text}))")

    @property
    def text(self) -> str:
        return "string" if self.name == "spark" else "varchar"


def _e(s: Dialect) -> str:
    return f"""SELECT event_id, user_id, event_type, value, user_id % 40 AS pid,
      {s.div(s.micros('ts'), 10)} AS t_us, {s.micros('ts')} AS raw_us,
      365e-1 + (user_id % 40) * 5e-2 + ((event_id * 7919) % 1000) / 20000e0 AS lat,
      -76e0 + (user_id % 40) * 8e-2 + ((event_id * 104729) % 1000) / 20000e0 AS lon
      FROM {s.table('events')}"""


def _reports(s: Dialect) -> str:
    return """SELECT event_id, concat('P', cast(pid AS varchar(10))) AS platform_id, 'sea' AS domain, t_us,
      lat, lon, 20e0 AS uncertainty_m,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 25e0 * floor(value / 25e0) END AS speed_mps,
      CAST((event_id * 37) % 360 AS double) AS heading_deg,
      CASE WHEN pid % 5 = 0 THEN NULL ELSE CAST(10 + (pid * 13) % 290 AS double) END AS length_m
      FROM e WHERE event_type <> 'error'"""


def _observations(s: Dialect) -> str:
    scene = s.div("t_us", 3600000000)
    return f"""SELECT event_id AS obs_id, {scene} AS scene, {scene} * 3600000000 + 1800000000 AS t_scene_us,
      {s.div('t_us', 86400000000)} AS day,
      lat + (((event_id * 31) % 200) - 100) / 100000e0 AS lat,
      lon + (((event_id * 17) % 200) - 100) / 100000e0 AS lon,
      6e0 + ((event_id * 17) % 400) / 10e0 AS snr, 2 + (event_id * 13) % 40 AS pixels, 25e0 AS uncertainty_m,
      least(95e-2, (6e0 + ((event_id * 17) % 400) / 10e0) / 20e0) AS confidence
      FROM e WHERE event_type = 'error'"""


def _searched(s: Dialect) -> str:
    c = "CAST(floor(round(lon / 5e-2, 9)) AS bigint)"
    r = "CAST(floor(round(lat / 5e-2, 9)) AS bigint)"
    return f"""SELECT day, col, row, 1 + {s.hash8('col * 100000 + row')} % 10 AS level
      FROM (SELECT DISTINCT {s.div('t_us', 86400000000)} AS day, {c} AS col, {r} AS row FROM e) q"""


def _fixes(s: Dialect) -> str:
    return f"""SELECT event_id AS arrival, concat('F', cast(user_id % 6 AS varchar(10))) AS feed_id,
      CASE WHEN event_id % 29 = 0 THEN concat('entity:', cast(event_id AS varchar(20)))
           ELSE cast(user_id AS varchar(20)) END AS vehicle_key,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('T', cast(user_id % 9 AS varchar(10))) END AS trip_id,
      365e-1 + (user_id % 40) * 5e-2 + ((event_id * 7919) % 1000) / 200000e0 AS lat,
      -76e0 + (user_id % 40) * 8e-2 + ((event_id * 104729) % 1000) / 200000e0 AS lon,
      CASE WHEN event_id % 31 = 0 THEN NULL ELSE {s.div('raw_us', 400000000)} END AS vehicle_ts,
      {s.div('raw_us', 400000000)} + 3 + event_id % 5 AS fetched_at, {s.div('event_id', 500)} AS file
      FROM e"""


def _segments(s: Dialect) -> str:
    return """SELECT line_set, j, x0, y0, x1, y1 FROM (
      SELECT line_set, j, lon AS x0, lat AS y0, lead(lon) OVER (PARTITION BY line_set ORDER BY j) AS x1,
             lead(lat) OVER (PARTITION BY line_set ORDER BY j) AS y1
      FROM (SELECT l.line_set, n.n_nationkey AS j, -775e-1 + n.n_nationkey * 25e-2 AS lon,
                   l.base + ((n.n_nationkey * 7) % 5) * 1e-2 AS lat
            FROM {nation} n, (SELECT 'L3' AS line_set, 3705e-2 AS base UNION ALL SELECT 'L12', 372e-1
                 UNION ALL SELECT 'L24', 374e-1 UNION ALL SELECT 'L200', 402e-1) l) v) w
      WHERE x1 IS NOT NULL""".format(nation=s.table("nation"))


def _aircraft(s: Dialect) -> str:
    return f"""SELECT event_id, {s.div('t_us', 600000000)} AS poll, t_us, {s.div('t_us', 86400000000)} AS day,
      cast(user_id AS varchar(20)) AS hex, lat, lon,
      CASE event_id % 20 WHEN 0 THEN 'mlat' WHEN 1 THEN 'mode_s' WHEN 2 THEN 'tisb_other' ELSE 'adsb_icao' END
        AS type,
      CASE WHEN event_id % 23 = 0 THEN 'ground' ELSE cast((event_id * 137) % 30000 AS varchar(10)) END AS alt_baro,
      CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST((event_id * 41) % 13000 AS double) END AS alt_m,
      event_id % 23 = 0 AS on_ground, CAST((event_id * 7) % 90 AS double) AS contact_age_s
      FROM e"""


def _airports(s: Dialect) -> str:
    return f"""SELECT n_nationkey AS id, 36e0 + n_nationkey * 8e-1 AS lat, -765e-1 + n_nationkey * 11e-1 AS lon
      FROM {s.table('nation')} WHERE n_nationkey % 8 = 1"""


def _heartbeats(s: Dialect) -> str:
    day = s.div("t_us", 86400000000)
    return f"""SELECT event_id, t_us, concat('C', cast(user_id % 4 AS varchar(10))) AS collector,
      concat('C', cast(user_id % 4 AS varchar(10)), '-', cast({s.div('t_us', 7200000000)} AS varchar(10))) AS session,
      {day} AS day,
      CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'stop' ELSE 'poll' END AS event,
      event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN concat('E', cast(event_id % 3 AS varchar(5))) END
        AS error
      FROM e WHERE {s.div('t_us', 7200000000)} % 5 <> 3"""


def _ledger(s: Dialect) -> str:
    return f"""SELECT event_id, concat('G', cast(user_id % 12 AS varchar(10))) AS feed,
      {s.div('raw_us', 86400000000)} AS cycle,
      CASE event_type WHEN 'error' THEN 'http_error' WHEN 'click' THEN 'version_unknown' ELSE 'ok' END AS outcome,
      event_type <> 'error' AS returned,
      CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE CAST(floor(value) AS bigint) % 50 END AS n_events,
      CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '4' ELSE '4.1' END AS version_declared,
      CASE WHEN user_id % 12 = 5 THEN NULL WHEN user_id % 2 = 0 THEN '4.1' ELSE '4.0' END AS version_registry,
      CASE WHEN event_type = 'error' THEN NULL
           WHEN user_id % 12 IN (3, 4) THEN md5(concat('c', cast(user_id % 12 AS varchar(10))))
           ELSE md5(concat('c', cast(CAST(floor(value / 40e0) AS bigint) AS varchar(20)))) END AS content,
      CASE WHEN event_type = 'error' THEN NULL
           WHEN user_id % 12 = 4 THEN md5('same')
           ELSE md5(concat('b', cast({s.div('event_id', 3)} AS varchar(20)))) END AS body,
      1000 + (event_id * 37) % 5000 AS bytes
      FROM e"""


def _verdicts(s: Dialect) -> str:
    names = "CASE {x} WHEN 0 THEN 'clutter' WHEN 1 THEN 'vessel' WHEN 2 THEN 'fixed' ELSE 'ambiguous' END"
    return f"""SELECT doc_id, {names.format(x='(quality + 2 * (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)) % 4')} AS a,
      {names.format(x='(quality + (CASE WHEN doc_id % 3 = 0 THEN toxic + 1 ELSE 0 END)) % 4')} AS b,
      CASE doc_id % 3 WHEN 0 THEN '<=2nm' WHEN 1 THEN '2-10nm' ELSE '>10nm' END AS band,
      doc_id % 4 AS round, doc_id % 6 AS day, quality, toxic
      FROM {s.table('labels')}"""


def _pixels(s: Dialect) -> str:
    scene, row, c = s.div("event_id", 2000), s.div("event_id % 2000", 50), "event_id % 50"
    return f"""SELECT {scene} AS scene, {row} AS row, {c} AS col,
      CAST(50 + {s.hash8('event_id')} % 20 +
        CASE WHEN {row} % 16 IN (7, 8) AND {c} % 16 IN (7, 8) AND {s.hash8(s.div('event_id', 1024))} % 3 > 0
             THEN 400 ELSE 0 END AS double) AS dn,
      {row} >= 2 AS valid
      FROM e"""


def _lattice(s: Dialect) -> str:
    scene, i, j = s.div("p_partkey", 81), s.div("p_partkey % 81", 9), "p_partkey % 9"
    return f"""SELECT {scene} AS scene, {i} AS i, {j} AS j, {i} * 8e0 AS prow, {j} * 8e0 AS pcol,
      -75e0 + {scene} * 2e-1 + {j} * 2e-2 + {i} * 1e-3 + {j} * {j} * 1e-5 + {i} * {j} * 2e-6 AS lon,
      37e0 + {scene} * 1e-1 - {i} * 15e-3 + {j} * 5e-4 + {i} * {i} * 2e-5 AS lat
      FROM {s.table('part')} WHERE p_partkey < {s.div('(SELECT count(*) FROM ' + s.table('part') + ')', 81)} * 81"""


def _candidates(s: Dialect) -> str:
    return """SELECT obs_id, scene, t_scene_us, day, lat, lon, snr, pixels, uncertainty_m, confidence,
      CASE WHEN obs_id % 10 < 7 THEN 'heard' WHEN obs_id % 10 < 9 THEN 'intermittent' ELSE 'thin' END AS reception,
      obs_id % 3 = 0 AS matched
      FROM observations WHERE snr >= 15 AND pixels >= 6"""


def _tables(s: Dialect) -> dict[str, str]:
    return {"e": _e(s), "reports": _reports(s), "observations": _observations(s), "searched": _searched(s),
            "fixes": _fixes(s), "segments": _segments(s), "aircraft": _aircraft(s), "airports": _airports(s),
            "heartbeats": _heartbeats(s), "ledger": _ledger(s), "verdicts": _verdicts(s), "pixels": _pixels(s),
            "lattice": _lattice(s), "candidates": _candidates(s)}


NEEDS = {"e": [], "reports": ["e"], "observations": ["e"], "searched": ["e"], "fixes": ["e"], "segments": [],
         "aircraft": ["e"], "airports": [], "heartbeats": ["e"], "ledger": ["e"], "verdicts": [], "pixels": ["e"],
         "lattice": [], "candidates": ["e", "observations"]}


def duckdb_ctes() -> str:
    """All derived tables as a WITH list for the oracle."""
    return ",\n".join(f"{name} AS ({sql})" for name, sql in _tables(Dialect("duckdb")).items())


class Fixture:
    """Derived tables of one test-data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, str(sf_dir)
        self._sql = _tables(Dialect("spark", self.sf_dir))

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sql:
            raise AttributeError(name)
        ctes = ",\n".join(f"{n} AS ({self._sql[n]})" for n in [*NEEDS[name], name])
        return self.spark.sql(f"WITH {ctes} SELECT * FROM {name}")
