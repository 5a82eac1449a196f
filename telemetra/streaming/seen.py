"""T3 with a reset and bounded state: series as they are seen for the first time, told again
after a reset or once they have been away for longer than they are remembered.

Series are dealt to shards. A shard's state is two maps, of the series seen in this period of
``remember_seconds`` and in the one before; a sighting is noted in the map of its period, and a
map is emptied when its turn comes again. A map's entry is a cell of about ``CELL`` series, since
each read or write of an entry is a message between Python and Spark; cells are split as a map
grows, so that a batch reads and writes no more entries than it has series. So a series is
remembered for one to two periods
after it was last seen, and the state holds the series of two periods and no others. (Spark's
own time to live needs its processing-time mode, in which a query that should end with the
data at hand runs empty batches for ever.) The clock is the batch's own time, which a replayed
batch finds again.

A reset is a row of a control stream; it reaches every shard and empties its maps. It holds
for the batch that it arrives in: all series of that batch are new again.
"""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from telemetra.functions.points import in_time_span, sorted_json_object
from telemetra.operators import series
from telemetra.schemas import SeriesOptions
from telemetra.sources.labelled import labelled_points

SHARDS = 64
# Series of a cell when cells are made; they are split once they hold twice as many on average.
CELL = 256
REPORT = "series_key string, metric string, labels_json string, seq bigint, pos int, timestamp bigint"


def _processor(remember_seconds: int, cell: int = CELL) -> StatefulProcessor:
    """Reports the series of a shard that its maps do not hold. The class is made here, so
    that it travels whole: executors need pandas, not this package."""

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            # the period, and of each map its cells (a power of two, 0 while empty) and its series
            self.period = handle.getValueState("period", "n bigint, cells array<bigint>, series array<bigint>")
            self.maps = [handle.getMapState(name, "cell bigint", "series_keys array<string>") for name in ("even", "odd")]

        @staticmethod
        def dealt(names, cells):
            """Names by the cell that holds them."""
            found = {}
            for name in names:
                found.setdefault(zlib.crc32(name.encode("utf-8", "surrogatepass")) & (cells - 1), []).append(name)
            return found

        @staticmethod
        def cells_for(n):
            return 1 << max(0, -(-n // cell) - 1).bit_length()

        def held(self, i, at):
            found = self.maps[i].getValue((at,))
            return list(found[0]) if found else []

        def known(self, i, names, cells):
            """Which of the names a map holds."""
            found = set()
            if cells:
                for at, own in self.dealt(names, cells).items():
                    found.update(set(self.held(i, at)).intersection(own))
            return found

        def note(self, i, names, cells, series):
            """Adds the names to a map: those it held, its cells and its series."""
            found, empty = set(), not cells
            cells = cells or self.cells_for(len(names))
            for at, own in self.dealt(names, cells).items():
                held = [] if empty else self.held(i, at)
                old = set(held).intersection(own)
                new = [name for name in own if name not in old]
                if new:
                    self.maps[i].updateValue((at,), (held + new,))
                found |= old
                series += len(new)
            if series > 2 * cell * cells:
                more = self.cells_for(series)
                for at in range(cells):
                    for to, own in ({at: []} | self.dealt(self.held(i, at), more)).items():
                        self.maps[i].updateValue((to,), (own,))
                cells = more
            return found, cells, series

        def handleInputRows(self, key, rows, timerValues):
            # a batch's distinct series of the shard, each with its earliest row; one without a
            # number comes last
            first, reset, now = {}, False, 0
            for frame in rows:
                if len(frame):
                    now = int(frame["now"].iloc[-1])
                control = frame["reset"].astype(bool)
                if control.any():
                    reset, frame = True, frame[~control]
                seq = [s if s == s else math.inf for s in frame["seq"].tolist()]
                own = [frame[c].tolist() for c in ("pos", "series_key", "metric", "labels_json", "timestamp")]
                for row in zip(seq, *own):
                    known = first.get(row[2])
                    if known is None or row < known:
                        first[row[2]] = row
            period = now // remember_seconds
            last, cells, series = self.period.get() if self.period.exists() else (period, (0, 0), (0, 0))
            cells, series = list(cells), list(series)
            for i in range(2):
                if reset or period > last + 1 or (period > last and period % 2 == i):
                    self.maps[i].clear()
                    cells[i] = series[i] = 0
            here, other = period % 2, 1 - period % 2
            known = self.known(other, first, cells[other])
            if first:
                noted, cells[here], series[here] = self.note(here, first, cells[here], series[here])
                known |= noted
            self.period.update((period, cells, series))
            out = [(name, metric, labels, int(seq), int(pos), int(timestamp))
                   for name, (seq, pos, _, metric, labels, timestamp) in sorted(first.items()) if name not in known]
            if out:
                yield pd.DataFrame(out, columns=["series_key", "metric", "labels_json", "seq", "pos", "timestamp"])

        def close(self) -> None:
            pass

    return Seen()


def first_seen(lines: DataFrame, sink: str, checkpoint: str, resets: DataFrame | None = None, remember_seconds: int = 7 * 86_400,
               options: SeriesOptions = SeriesOptions(), shards: int = SHARDS, trigger=None, name: str | None = None) -> StreamingQuery:
    """Reports to ``<sink>/batch=<id>``: every series once, again after a row of the stream
    ``resets``, and again once it was not seen for ``remember_seconds`` to twice as long.
    Points whose timestamp is no time are left out."""
    from telemetra.streaming import live

    points = series.with_series_key(labelled_points(lines), options).where(in_time_span(F.col("timestamp")))
    rows = points.select(
        F.pmod(F.xxhash64("series_key"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("reset"), "series_key", "metric",
        sorted_json_object(F.col("labels")).alias("labels_json"), "seq", F.col("pos").cast("int").alias("pos"), "timestamp",
        F.unix_seconds(F.current_timestamp()).alias("now"))
    if resets is not None:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        control = resets.select(everywhere).select(
            "shard", F.lit(True).alias("reset"), *[F.lit("0").cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:-1]],
            F.unix_seconds(F.current_timestamp()).alias("now"))
        rows = rows.unionByName(control)
    told = rows.groupBy("shard").transformWithStateInPandas(_processor(remember_seconds), REPORT, "Update", "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return live._start(told.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger or live.FLUSH, name)


def read_reports(spark: SparkSession, sink: str) -> DataFrame:
    """All reports so far, with the batch that made them."""
    from telemetra.streaming import live

    return live.read_log(spark, sink)
