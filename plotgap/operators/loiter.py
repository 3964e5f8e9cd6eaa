"""Staying in a small place: maximal windows of bounded extent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap.constants import M_PER_DEG
from plotgap.plans.reuse import pin
from plotgap.plans.sequence import HOUR_US, chunk_of

US = 1_000_000
BOX = ["lat0", "lat1", "lon0", "lon1"]


def fits(box: np.ndarray, size_m: float) -> np.ndarray:
    """Whether boxes (rows of lat0, lat1, lon0, lon1) are at most ``size_m`` high and wide; a larger box never fits if a smaller does not."""
    lat0, lat1, lon0, lon1 = box.T
    nearest = np.where((lat0 <= 0) & (lat1 >= 0), 0.0, np.minimum(np.abs(lat0), np.abs(lat1)))
    return ((lat1 - lat0) * M_PER_DEG <= size_m) & ((lon1 - lon0) * M_PER_DEG * np.cos(np.radians(nearest)) <= size_m)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 1], b[:, 1]), np.minimum(a[:, 2], b[:, 2]), np.maximum(a[:, 3], b[:, 3])])


def advance(steps: np.ndarray, at: np.ndarray, box: np.ndarray, size_m: float) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the first place from ``at`` on whose box no longer fits with ``box`` and all between, and what was joined.

    All starts move at once, by halving stretches of ready-made box unions.
    """
    tables = [steps]
    while 2 ** len(tables) <= len(steps):
        half, now = 2 ** (len(tables) - 1), tables[-1]
        tables.append(joined(now[:-half], now[half:]))
    at, box = at.copy(), box.copy()
    for level in range(len(tables) - 1, -1, -1):
        can = np.nonzero(at + 2 ** level <= len(steps))[0]
        if len(can):
            tried = joined(box[can], tables[level][at[can]])
            good = fits(tried, size_m)
            box[can[good]], at[can[good]] = tried[good], at[can[good]] + 2 ** level
    return at, box


def _boxes(frame: pd.DataFrame) -> np.ndarray:
    return frame[["lat", "lat", "lon", "lon"]].to_numpy(np.float64)


PARTS = "platform_id string, chunk long, kind string, start_us long, end_us long, lat0 double, lat1 double, lon0 double, lon1 double"


def loiter(reports: DataFrame, size_m: float = 2000.0, min_duration_s: float = 7200.0, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """(platform_id, start_us, end_us, duration_s): maximal windows in which all reports lie in a box of ``size_m``.

    1. A platform's reports are cut into chunks of time, each swept by itself. Windows that end in their chunk are done; those
       that reach its end stay open with their box, the earliest for each box only. A chunk also leaves its own box.
    2. Over the seams only these summaries are walked, one row for a chunk and a few for what is open: whole chunks are
       skipped while they fit.
    3. The chunk in which an open window ends is read again and swept from the box that arrives there.

    So a platform with all the rows is dealt over many tasks, and a window may be as long as the data.
    """
    rows = reports.select("platform_id", "t_us", "event_id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("chunk", chunk_of("t_us", chunk_us))

    def sweep(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "event_id"])
        t, b = frame["t_us"].to_numpy(), _boxes(frame)
        n = len(b)
        end, box = advance(b, np.arange(n), b, size_m)
        first = np.unique(end, return_index=True)[1]
        out = [(*key, "closed", t[i], t[end[i] - 1], *([None] * 4)) for i in first.tolist() if end[i] < n]
        held = np.nonzero(end == n)[0]
        kept = [i for k, i in enumerate(held.tolist()) if k == 0 or (box[i] != box[held[k - 1]]).any()]
        out += [(*key, "open", t[i], t[-1], *box[i]) for i in kept]
        out.append((*key, "chunk", t[0], t[-1], b[:, 0].min(), b[:, 1].max(), b[:, 2].min(), b[:, 3].max()))
        return pd.DataFrame(out, columns=["platform_id", "chunk", "kind", "start_us", "end_us", *BOX])

    def seams(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        chunks = frame[frame["kind"] == "chunk"].sort_values("chunk")
        held = frame[frame["kind"] == "open"]
        number, last = chunks["chunk"].to_numpy(), chunks["end_us"].to_numpy()
        here = np.searchsorted(number, held["chunk"].to_numpy())
        at, box = advance(chunks[BOX].to_numpy(np.float64), here + 1, held[BOX].to_numpy(np.float64), size_m)
        over = at == len(number)
        out = pd.DataFrame(box, columns=BOX)
        out.insert(0, "end_us", last[at - 1])
        out.insert(0, "start_us", held["start_us"].to_numpy())
        out.insert(0, "kind", np.where(over, "closed", "open"))
        out.insert(0, "chunk", number[np.minimum(at, len(number) - 1)])
        out.insert(0, "platform_id", key[0])
        return out

    def finish(key: tuple, held: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "event_id"])
        t = frame["t_us"].to_numpy()
        at, _ = advance(_boxes(frame), np.zeros(len(held), np.int64), held[BOX].to_numpy(np.float64), size_m)
        end = np.where(at > 0, t[np.maximum(at, 1) - 1] if len(t) else 0, held["end_us"].to_numpy())
        return pd.DataFrame({"platform_id": key[0], "start_us": held["start_us"].to_numpy(), "end_us": end})

    parts = pin(rows.groupBy("platform_id", "chunk").applyInPandas(sweep, PARTS))
    met = pin(parts.where("kind <> 'closed'").groupBy("platform_id").applyInPandas(seams, PARTS))
    held = met.where("kind = 'open'")
    wanted = rows.join(held.select("platform_id", "chunk").distinct(), ["platform_id", "chunk"], "left_semi")
    ended = held.groupBy("platform_id", "chunk").cogroup(wanted.groupBy("platform_id", "chunk")).applyInPandas(finish, "platform_id string, start_us long, end_us long")
    closed = [df.where("kind = 'closed'").select("platform_id", "start_us", "end_us") for df in (parts, met)]
    every = closed[0].union(closed[1]).union(ended).groupBy("platform_id", "end_us").agg(F.min("start_us").alias("start_us"))
    duration = (F.col("end_us") - F.col("start_us")) / US
    return every.select("platform_id", "start_us", "end_us", duration.alias("duration_s")).where(F.col("duration_s") >= min_duration_s)
