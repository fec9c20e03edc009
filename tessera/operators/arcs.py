"""Arcs of a loop: a table that every round joins its rows with, stored so that the rounds need not shuffle it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.iterate import Grown, Stored


def draw(key: str, turn: int) -> Column:
    """A number below 65,537 that looks random, from whole-number arithmetic that any engine repeats."""
    low, high = F.pmod(F.col(key), F.lit(1_000_003)), F.pmod(F.floor(F.col(key) / 1_000_003), F.lit(1_000_003))
    # 40,503 is odd and near the golden section of the modulus, so a key's parity changes at every third turn at the latest
    return F.pmod((low * 7_919 + high * 104_729) * 31 + F.floor(low / 257) * 9_973 + turn * 40_503, F.lit(65_537))


class Arcs:
    """(src, dst, ...) stored once.

    Up to FEW arcs they are one plain table, which the planner broadcasts or shuffles as it sees fit.  Beyond, they are bucketed by src,
    so only what is sent along them moves.  Sources with more than SPLIT arcs stay out of the buckets, where each of them would be one
    task's work: their arcs are a plain table, and what is sent from them is broadcast, as there are at most arcs / SPLIT such sources."""

    FEW = 1 << 20
    SPLIT = 1 << 20

    def __init__(self, rows: DataFrame):
        self._tables = [Stored(rows, F.count("*").alias("n"))]
        self.n = self._tables[0].seen.get("n", 0)
        self._hubs: DataFrame | None = None
        if self.n > self.FEW:
            plain = self._tables[0].df
            heavy = plain.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") > self.SPLIT).select("src")
            own = Stored(heavy, F.count("*").alias("n"))
            self._tables.append(own)
            if own.seen.get("n", 0):
                self._hubs = own.df
                hot = Stored(plain.join(F.broadcast(own.df), "src", "left_semi"))
                cold = plain.join(F.broadcast(own.df), "src", "left_anti")
                self._tables.append(hot)
            else:
                cold = plain
            buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self._cold = Stored(cold.repartition(buckets, "src"), by="src")
            self._tables.append(self._cold)

    @property
    def by(self) -> str | None:
        """The column by which states should be bucketed to meet the arcs without an exchange; None where it isn't worth it."""
        return "id" if self.n > self.FEW else None

    @property
    def df(self) -> DataFrame:
        return self._tables[0].df

    def hashed(self, rows: DataFrame) -> DataFrame:
        """rows with at most one for each vertex, as the side of a join that a task holds by its hash: bucket by bucket, so neither
        the arcs are sorted for it nor do the rows pass the driver.  Few arcs leave it to the planner."""
        return rows if self.n <= self.FEW else rows.hint("shuffle_hash")

    def send(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) along their out-arcs: id becomes src, the arcs' columns are added."""
        rows = rows.withColumnRenamed("id", "src")
        if self.n <= self.FEW:
            return rows.join(self._tables[0].df, "src")
        out = rows.join(self._cold.df, "src")
        if self._hubs is not None:
            hot = rows.join(F.broadcast(self._hubs), "src", "left_semi")
            out = out.unionByName(F.broadcast(hot).join(self._tables[2].df, "src"))
        return out

    def drop(self) -> None:
        for t in self._tables:
            t.drop()


def relax(arcs: Arcs, start: DataFrame, offer, moved: DataFrame | None = None, max_rounds: int | None = None, jump: bool = False) -> DataFrame:
    """The least values that start (id, value, parent) reaches along arcs: a vertex takes the smallest offer of its
    predecessors, offer(value) over the columns `value` and the arcs', until nothing gets smaller.

    Values only fall, so a round writes those that fell, as a part of a growing table in which an id's smallest value counts; parts
    are merged now and then.  What is known is met bucket by bucket, so no round sends it to the driver.  moved: the rows of start that are sent first, all if None.  jump: values are ids, and an id's own
    value is offered to whoever holds it, which halves long chains (for reachability, whose offers are the values)."""
    least_of = lambda df: df.groupBy("id").agg(F.min(F.struct("value", "parent")).alias("x")).select("id", "x.value", "x.parent")
    best = Grown(arcs.by, least_of)
    frontier, seen = best.add(start, F.count("*").alias("n"))
    if moved is not None:
        frontier = moved
    n, done = seen.get("n", 0), 0
    while n and (max_rounds is None or done < max_rounds):
        done += 1
        sent = arcs.send(arcs.hashed(frontier.select("id", "value"))).select(F.col("dst").alias("id"), offer(F.col("value")).alias("value"), F.col("src").alias("parent"))
        if jump:
            held = best.df.select(F.col("id").alias("by"), F.col("value").alias("next"))
            sent = sent.unionByName(frontier.join(arcs.hashed(held), F.col("value") == F.col("by")).select("id", F.col("next").alias("value"), "parent"))
        least = least_of(sent)
        known = best.df.select(F.col("id").alias("k"), F.col("value").alias("v"))
        fell = least.join(arcs.hashed(known), (F.col("id") == F.col("k")) & (F.col("v") <= F.col("value")), "left_anti")
        frontier, seen = best.add(fell, F.count("*").alias("n"))
        n = seen.get("n", 0)
    return least_of(best.df)
