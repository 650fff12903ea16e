"""Ratings of matches that arrive as a stream, day by day.

A match waits in its league's state until the watermark has passed its day; then a timer closes the day, all of its matches
are rated by what was known before it, and leave. A match that comes after its day was closed changes nothing: it is given
back as late. Whatever files or batches the matches came in, the ratings are those of one pass over all that were in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.ratings import LeagueFold

DAY_MS = 86_400_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayByDay(StatefulProcessor):
    """State of a league: its teams' ratings, and the matches of the days that are open, by day and by the part they came in. Each
    access is a round trip to the state store, so a value holds many: all ratings, or all matches of a day and part."""

    def __init__(self, k: float, home_adv: float):
        self.k, self.home_adv = k, home_adv

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getValueState("ratings", "teams array<bigint>, ratings array<double>")
        self.parts = handle.getValueState("parts", "n bigint")
        self.waiting = handle.getMapState("waiting", "day int, part bigint", "match_id array<bigint>, home array<bigint>, away array<bigint>, home_goals array<double>, away_goals array<double>")

    def _wait(self, frames: list[pd.DataFrame]) -> None:
        part = self.parts.get()[0] + 1 if self.parts.exists() else 0
        self.parts.update((part,))
        days = {}
        for day, rows in pd.concat(frames).groupby("day"):
            self.waiting.updateValue((int(day), part), tuple(rows[c].tolist() for c in VALUES))
            days[int(day)] = (int(day) + 1) * DAY_MS
        if days:
            self.handle.registerTimer(min(days.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed, held, n = timerValues.getCurrentWatermarkInMs(), [], 0
        for frame in rows:
            frame = frame[frame["counts"]]
            is_late = (frame["day"].astype("int64") + 1) * DAY_MS <= closed
            late = frame[is_late]
            yield pd.DataFrame([(i, key[0], d, None, None, None, None, True) for i, d in zip(late.match_id.tolist(), late.day.tolist())], columns=COLUMNS)
            held.append(frame[~is_late])
            n += len(held[-1])
            if n >= PART_ROWS:
                self._wait(held)
                held, n = [], 0
        if n:
            self._wait(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All days that are closed at once; the next open one has the timer after this."""
        closed, open_days, due = timerValues.getCurrentWatermarkInMs(), [], {}
        for day, part in sorted(self.waiting.keys()):
            end = (day + 1) * DAY_MS
            if end <= closed:
                due.setdefault(day, []).append(part)
            else:
                open_days.append(end)
        if open_days:
            self.handle.registerTimer(min(open_days))
        if not due:
            return
        known = dict(zip(*self.ratings.get())) if self.ratings.exists() else {}
        fold = LeagueFold(float(self.k), float(self.home_adv), True, known)
        for day, parts in due.items():
            matches = {}
            for part in parts:  # of a match that came twice the last
                matches |= {row[0]: row[1:] for row in zip(*self.waiting.getValue((day, part)))}
                self.waiting.removeKey((day, part))
            out = [(i, key[0], day, *fold.match(day, *matches[i]), False) for i in sorted(matches)]
            yield pd.DataFrame(out, columns=COLUMNS)
        self.ratings.update((list(fold.ratings), list(fold.ratings.values())))

    def close(self) -> None:
        pass


#: Matches of a league that are held at a time on their way into the state.
PART_ROWS = 100_000
VALUES = ["match_id", "home_team", "away_team", "home_goals", "away_goals"]
COLUMNS = ["match_id", "league", "day", "home_elo", "away_elo", "home_post", "away_post", "is_late"]


def rated_stream(stream: DataFrame, k: float = 50.0, home_adv: float = 80.0, delay: str = "30 days") -> DataFrame:
    """Of a stream of played matches (match_id, league, date, home_team, away_team, goals; whole numbers but for the date) a
    row when its day is closed, ``delay`` behind the latest date: match_id, league, date, home_elo, away_elo, home_post,
    away_post, is_late. A late match has a row without ratings. A match that comes twice while its day is open counts once. A row
    without match_id or result only moves time on. The session needs the RocksDB state store (``ROCKS_DB``).
    """
    league = dict(stream.dtypes)["league"]
    timed = stream.withColumn("__ts", F.col("date").cast("timestamp")).withWatermark("__ts", delay)
    # Without the time column no row is dropped as late before the processor has seen it.
    # A filter would be pushed below the watermark, which then would not see what moves time on: a flag instead.
    counts = F.col("match_id").isNotNull() & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    whole = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("match_id", "home_team", "away_team")]
    rows = timed.select("league", F.unix_date("date").alias("day"), counts.alias("counts"), *whole, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("home_goals", "away_goals")])
    out = rows.groupBy("league").transformWithStateInPandas(DayByDay(k, home_adv), f"match_id bigint, league {league}, day int, home_elo double, away_elo double, home_post double, away_post double, is_late boolean", "Append", "EventTime")
    return out.withColumn("date", F.date_from_unix_date("day")).drop("day")
