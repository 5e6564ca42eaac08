"""Records that point to each other, as rows: walks along offsets, ranks in linked lists, nesting by indents and by brackets.

A walk through a file reads where the next record is from the record itself, one after the other. Here all places where a record may begin are rows (file, at, next), and pointers are doubled:
after k rounds each place knows the one 2**k records on, and the places reached from the start are twice as many. So a chain of any length takes a logarithm of rounds, each an equi-join that spreads
over the cluster by file and place, however large one file is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import joined, release, written

#: Bytes that are searched by one row of places().
SEARCHED = 1 << 16


def places(files: DataFrame, file: str, content: str, pattern: str | None = None, start: Column | int = 0, step: int = 1, block: int = SEARCHED) -> DataFrame:
    """(file, content, at): places of a pattern (bytes, hexadecimal), from 0, or without one every ``step``-th place from ``start`` on; ``content`` is the whole value.

    A value is searched in blocks that overlap by the pattern's length less one, so none is lost at a border and no array is longer than a block.
    """
    size = F.octet_length(content).cast("long")
    width = 1 if pattern is None else len(pattern) // 2
    first = F.lit(start).cast("long") if isinstance(start, int) else start.cast("long")
    rows = files.select(file, content, first.alias("__first"), size.alias("__size")).where(F.col("__size") - width >= F.col("__first"))
    rows = rows.select(file, content, "__size", F.explode(F.sequence("__first", F.col("__size") - width, F.lit(block * step).cast("long"))).alias("__from"))
    last = F.least(F.col("__from") + (block - 1) * step, F.col("__size") - width)
    ats = F.sequence("__from", last, F.lit(step).cast("long"))
    if pattern is not None:
        part = F.substr(F.col(content), (F.col("__from") + 1).cast("int"), F.lit(block * step + width).cast("int"))
        own = F.transform(F.array(part), lambda p: F.filter(F.transform(ats, lambda a: a - F.col("__from")), lambda i: F.substr(p, (i + 1).cast("int"), F.lit(width)) == F.unhex(F.lit(pattern))))
        ats = F.transform(F.flatten(own), lambda i: i + F.col("__from"))
    return rows.select(file, content, F.explode(ats).alias("at"))


class Chain:
    """Links (file, at, next), at most one for each file and place.  Jumps of 1, 2, 4, … links are made as they are needed and kept for further walks."""

    def __init__(self, links: DataFrame, file: str = "file"):
        self.file = file
        self.jumps = [written(links.select(file, "at", F.col("next").alias("to")), "links")]

    def _jump(self, k: int) -> DataFrame:
        while len(self.jumps) <= k:
            j = self.jumps[-1]
            b = j.select(self.file, F.col("at").alias("to"), F.col("to").alias("on"))
            self.jumps.append(written(joined(j, b, [self.file, "to"]).select(self.file, "at", F.col("on").alias("to")), "jumps"))
        return self.jumps[k]

    def walk(self, starts: DataFrame) -> DataFrame:
        """(file, start, at, nth): the places reached from each start (file, start and perhaps end), in order; nth counts from 0.

        A walk ends where no link begins, before ``end``, and at a place that it has been to: cycles are walked once.
        """
        bounded = "end" in starts.columns
        seen = starts.select(self.file, "start", F.col("end") if bounded else F.lit(None).cast("long").alias("end"), F.col("start").alias("at"), F.lit(0).cast("long").alias("nth"))
        seen = joined(seen, self.jumps[0].select(self.file, "at"), [self.file, "at"], "left_semi")
        if bounded:
            seen = seen.where("at < end")
        seen, many, k = written(seen.select(self.file, "start", "end", "at", "nth"), "walk"), -1, 0
        while (now := seen.count()) != many:
            step = self._jump(k)
            on = joined(seen, step, [self.file, "at"]).select(self.file, "start", "end", F.col("to").alias("at"), (F.col("nth") + (1 << k)).alias("nth"))
            on = joined(on, self.jumps[0].select(self.file, "at"), [self.file, "at"], "left_semi")
            if bounded:
                on = on.where("at < end")
            both = seen.unionByName(on).groupBy(self.file, "start", "at").agg(F.min("nth").alias("nth"), F.first("end").alias("end"))
            done, seen = seen, written(both.select(self.file, "start", "end", "at", "nth"), "walk")
            release(done)
            many, k = now, k + 1
        return seen.select(self.file, "start", "at", "nth")

    def release(self) -> None:
        release(*self.jumps)


def running(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = 1 << 14) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their keys before and at each, by ``order`` (integers, unique within the keys).

    Sums of blocks of the order are added up first, then rows within blocks: no task has all rows of a key.
    """
    rows = rows.withColumn("__value", value.cast("long")).withColumn("__block", F.floor(F.col(order) / block))
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    upto = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("__before", upto - F.col("__sum")).drop("__sum")
    within = F.sum("__value").over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return joined(rows.withColumn("__within", within), sums, [*keys, "__block"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__value", "__block", "__within", "__before")


def nearest_smaller(rows: DataFrame, key: str, nth: str, level: str) -> DataFrame:
    """``rows`` with parent: the nearest row before, of the same key, with a smaller level; null without one.  ``nth`` counts the rows of a key without gaps from 0.

    A stack, distributed: every row points to the one before it, and while that one's level isn't smaller, on to where that one points. All that lies between is never smaller, so
    pointers double until they are right: rounds are a logarithm of the rows and at most the depth of the nesting.
    """
    now = rows.select(key, F.col(nth).alias("__i"), F.col(level).alias("__l"), F.when(F.col(nth) > 0, F.col(nth) - 1).alias("__p"), F.col(nth).isNull().alias("__ok"))
    now = written(now, "nearest")
    while True:
        target = now.select(key, F.col("__i").alias("__p"), F.col("__l").alias("__pl"), F.col("__p").alias("__pp"))
        right = F.col("__p").isNull() | (F.col("__pl") < F.col("__l"))
        step = joined(now.where("not __ok"), target, [key, "__p"], "left")
        step = step.select(key, "__i", "__l", F.when(right, F.col("__p")).otherwise(F.col("__pp")).alias("__p"), right.alias("__ok"))
        done, now = now, written(now.where("__ok").unionByName(step), "nearest")
        release(done)
        if not now.where("not __ok").limit(1).count():
            return joined(rows, now.select(key, F.col("__i").alias(nth), F.col("__p").alias("parent")), [key, nth])


def rooted(rows: DataFrame, key: str, nth: str, name: str, alive: str | None = None) -> DataFrame:
    """(key, nth, path, alive): the names of each row's ancestors and its own, end to end, by the column parent; alive says whether it and all of them are.

    Ancestors are doubled as well: a round joins each row with the one its path has come to.
    """
    live = F.lit(True) if alive is None else F.col(alive)
    now = written(rows.select(key, F.col(nth).alias("__i"), F.col("parent").alias("__p"), F.col(name).alias("path"), live.alias("alive")), "paths")
    while now.where("__p is not null").limit(1).count():
        up = now.select(key, F.col("__i").alias("__p"), F.col("__p").alias("__pp"), F.col("path").alias("__path"), F.col("alive").alias("__alive"))
        step = joined(now, up, [key, "__p"], "left").select(key, "__i", F.col("__pp").alias("__p"), F.concat(F.coalesce("__path", F.lit("")), "path").alias("path"), (F.col("alive") & F.coalesce("__alive", F.lit(True))).alias("alive"))
        done, now = now, written(step, "paths")
        release(done)
    return now.select(key, F.col("__i").alias(nth), "path", "alive")
