"""Streams of positions and events: watermarked windows, and keyed state for what windows can't say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, length: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Events per window and type; works on a stream (late rows beyond the watermark are dropped) and on a table."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if events.isStreaming else events
    return df.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class FatBox:
    """A moving object's box with a margin, renewed only when the object leaves it."""

    def __init__(self, margin: float) -> None:
        self.margin = margin

    def step(self, box: tuple | None, x: float, y: float) -> tuple[tuple, bool]:
        if box and box[0] <= x <= box[2] and box[1] <= y <= box[3]:
            return box, False
        return (x - self.margin, y - self.margin, x + self.margin, y + self.margin), True


def fat_box_updates(fixes: DataFrame, margin: float) -> DataFrame:
    """(track, steps, updates): how often each object's box was renewed, in order of seq; one group per object."""
    fat = FatBox(margin)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        box, n = None, 0
        for x, y in g.sort_values("seq")[["x", "y"]].itertuples(index=False):
            box, new = fat.step(box, x, y)
            n += new
        return pd.DataFrame({"track": [g["track"].iloc[0]], "steps": [len(g)], "updates": [n]})

    return fixes.groupBy("track").applyInPandas(run, "track long, steps long, updates long")


def fat_box_stream(fixes: DataFrame, margin: float) -> DataFrame:
    """The same on a stream (track, seq, x, y): the state is a box and two counters for each object; each batch gives the counts so far."""
    fat = FatBox(margin)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x0, y0, x1, y1, steps, n = state.get if state.exists else (None, None, None, None, 0, 0)
        box = None if x0 is None else (x0, y0, x1, y1)
        for x, y in pd.concat(list(batches)).sort_values("seq")[["x", "y"]].itertuples(index=False):
            box, new = fat.step(box, x, y)
            steps, n = steps + 1, n + new
        state.update((*box, steps, n))
        yield pd.DataFrame({"track": [key[0]], "steps": [steps], "updates": [n]})

    return fixes.groupBy("track").applyInPandasWithState(run, "track long, steps long, updates long", "x0 double, y0 double, x1 double, y1 double, steps long, updates long", "update", GroupStateTimeout.NoTimeout)


def lru_hits(requests: DataFrame, capacity: int) -> DataFrame:
    """(session, requests, hits) of a least-recently-used cache replayed for each session (session, seq, tile)."""
    from collections import OrderedDict

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict = OrderedDict()
        hits = 0
        for tile in g.sort_values("seq")["tile"]:
            if tile in cache:
                hits += 1
                cache.move_to_end(tile)
            else:
                cache[tile] = None
                if len(cache) > capacity:
                    cache.popitem(last=False)
        return pd.DataFrame({"session": [g["session"].iloc[0]], "requests": [len(g)], "hits": [hits]})

    return requests.groupBy("session").applyInPandas(run, "session long, requests long, hits long")


def bloom_bits(tiles: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Set bits of a Bloom filter of tile keys, as a table of 64-bit words: built by a distributed bit_or, tested by a join on the word."""
    k = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "tile"), F.lit(bits)) for i in range(hashes)]))
    places = tiles.select(k.alias("p"))
    return places.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))


def bloom_seen(tiles: DataFrame, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(tile, seen): false only for tiles that were never added."""
    k = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "tile"), F.lit(bits)) for i in range(hashes)]))
    probes = tiles.select("tile", k.alias("p")).withColumn("word", F.floor(F.col("p") / 64)).join(words, "word", "left")
    hit = F.coalesce(F.expr("(shiftright(bits, cast(p % 64 as int)) & 1) = 1"), F.lit(False))
    return probes.groupBy("tile").agg(F.bool_and(hit).alias("seen"))
