"""Ordered work on keys of any size: running values, neighbours, order statistics and state machines, by parts.

A window over a key puts all its rows into one task. Here the rows are sorted by ranges of (key, order) instead and numbered off into parts of at most PART rows.
What a row needs from its own part comes from a window over the part; what it needs from the rows before comes from one small row per key and part, put in order
by a window over these alone, and is carried in by a join on key and part. So one key may hold all the rows: its parts are separate tasks, and what is
gathered per key is a PART-th of its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from . import retrieval as R

#: Rows of a part, a power of two.
PART = 1 << 16


@dataclass(frozen=True)
class Parts:
    """rows, with their part in ``__part``; parts of a key follow each other in its order."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]

    def within(self) -> W:
        """A part's rows in order."""
        return W.partitionBy(self.key, "__part").orderBy(*self.order)

    def over(self) -> W:
        """A key's parts in order, for the summaries of ``carry``."""
        return W.partitionBy(self.key).orderBy("__part")

    def carry(self, summaries: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """rows with the ``carried`` columns: expressions over a key's parts (see ``over``) of the ``summaries``, aggregates of each part."""
        per = self.rows.groupBy(self.key, "__part").agg(*[c.alias(n) for n, c in summaries.items()])
        per = per.select(self.key, "__part", *[c.alias(n) for n, c in carried.items()])
        per = written(per.withColumnRenamed(self.key, "__key").withColumnRenamed("__part", "__of"))
        some = F.broadcast(per) if R.fits(per, F.lit(128)) else per
        return self.rows.join(some, self.rows[self.key].eqNullSafe(some["__key"]) & (self.rows["__part"] == some["__of"])).drop("__key", "__of")


def parted(rows: DataFrame, key: str, order: list[str], part: int = PART) -> Parts:
    """rows as a written table in parts; ``order`` should tell a key's rows apart."""
    if part & (part - 1):
        raise ValueError("part must be a power of two")
    by = [key, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # Partition and row number in one; the sort comes first.
    placed = placed.withColumn("__part", F.shiftright(F.monotonically_increasing_id(), part.bit_length() - 1))
    return Parts(written(placed), key, tuple(order))


BEFORE = (W.unboundedPreceding, -1)


def running_max(parts: Parts, value: str, name: str) -> DataFrame:
    """rows with ``name``: the greatest value before each row of its key, null where there is none."""
    out = parts.carry({"__s": F.max(value)}, {"__carried": F.max("__s").over(parts.over().rowsBetween(*BEFORE))})
    own = F.max(value).over(parts.within().rowsBetween(*BEFORE))
    return out.withColumn(name, F.greatest(own, F.col("__carried"))).drop("__carried", "__part")


def previous(parts: Parts, values: list[str], keep: bool = False) -> DataFrame:
    """rows with ``__before_<value>``: the value of the row before in its key, null for the first; ``keep``: with their part, for another scan."""
    last = {f"__s_{v}": F.max_by(v, F.struct(*parts.order)) for v in values}
    out = parts.carry(last, {f"__c_{v}": F.lag(f"__s_{v}").over(parts.over()) for v in values})
    first = F.row_number().over(parts.within()) == 1
    out = out.withColumn("__first", first)
    for v in values:
        out = out.withColumn(f"__before_{v}", F.when(F.col("__first"), F.col(f"__c_{v}")).otherwise(F.lag(v).over(parts.within())))
    return out.drop("__first", *([] if keep else ["__part"]), *[f"__c_{v}" for v in values])


def following(parts: Parts, value: str, name: str) -> DataFrame:
    """rows with ``name``: the value of the row behind in its key, null for the last."""
    out = parts.carry({"__s": F.min_by(value, F.struct(*parts.order))}, {"__carried": F.lead("__s").over(parts.over())})
    last = F.row_number().over(parts.within()) == F.count("*").over(W.partitionBy(parts.key, "__part"))
    return out.withColumn(name, F.when(last, F.col("__carried")).otherwise(F.lead(value).over(parts.within()))).drop("__carried", "__part")


def last_known(parts: Parts, value: str, name: str) -> DataFrame:
    """rows with ``name``: the last value before each row of its key that is not null."""
    known = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*parts.order)))
    out = parts.carry({"__s": known}, {"__carried": F.last("__s", ignorenulls=True).over(parts.over().rowsBetween(*BEFORE))})
    own = F.last(value, ignorenulls=True).over(parts.within().rowsBetween(*BEFORE))
    return out.withColumn(name, F.coalesce(own, "__carried")).drop("__carried", "__part")


def states(parts: Parts, action: str, start: str, moves: dict[str, tuple[list[str], str]], begun: DataFrame | None = None) -> DataFrame:
    """(key, status, applied, refused) after all of a key's actions in order; ``moves``: action -> (states it may be taken in, the state it leads to).
    ``begun``: (key, status, applied, refused) of keys that do not begin at ``start``.

    A part's actions fold to a map from each state that it may be entered in to the one that it leaves, with what was applied and refused on the way.
    Maps are composed along the parts of a key, which is the same as folding all actions one by one."""
    names = sorted({start, *(s for froms, to in moves.values() for s in (*froms, to))})

    def step(a: Column, x: Column) -> Column:
        to = F.lit(None).cast("string")
        for name, (froms, target) in moves.items():
            to = F.when((x == name) & a["status"].isin(froms), target).otherwise(to)
        return F.struct(
            F.coalesce(to, a["status"]).alias("status"), (a["applied"] + to.isNotNull().cast("long")).alias("applied"), (a["refused"] + to.isNull().cast("long")).alias("refused"))

    fresh = lambda s: F.struct(F.lit(s).alias("status"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))
    # At most PART actions, by the order of the part.
    own = F.transform(F.array_sort(F.collect_list(F.struct(*parts.order, F.col(action).alias("__action")))), lambda r: r["__action"])
    maps = parts.rows.groupBy(parts.key, "__part").agg(own.alias("__own"))
    folds = F.array(*[F.aggregate("__own", fresh(s), step) for s in names])
    maps = written(maps.select(parts.key, "__part", folds.alias("__map")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("__part", "__map"))), lambda r: r["__map"])

    def compose(a: Column, m: Column) -> Column:
        there = F.element_at(m, F.array_position(F.array(*map(F.lit, names)), a["status"]).cast("int"))
        return F.struct(there["status"].alias("status"), (a["applied"] + there["applied"]).alias("applied"), (a["refused"] + there["refused"]).alias("refused"))

    done = maps.groupBy(parts.key).agg(in_order.alias("__maps"))
    first = fresh(start)
    if begun is not None:
        done = done.join(begun.select(F.col(parts.key).alias("__key"), F.struct("status", F.col("applied").cast("long").alias("applied"), F.col("refused").cast("long").alias("refused")).alias("__begun")), F.col(parts.key).eqNullSafe(F.col("__key")), "left")
        first = F.coalesce("__begun", first)
    done = done.select(parts.key, F.aggregate("__maps", first, compose).alias("s"))
    return done.select(parts.key, F.col("s.status").alias("status"), F.col("s.applied").cast("int").alias("applied"), F.col("s.refused").cast("int").alias("refused"))


def quantiles(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float], part: int = PART) -> DataFrame:
    """(by..., and each probability's quantile under its name): exact, by linear interpolation between neighbours; nulls do not count, groups without values are left out.

    Equal values of a group are counted first. The distinct ones are put in order by parts; the counts of the parts tell in which one each wanted rank lies, and only
    those parts are looked into. No buffer grows with a group's values."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("__g") if by else F.lit(0).alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    parts = parted(seen, "__g", ["__v"], part)
    sizes = parts.rows.groupBy("__g", "__part").agg(F.sum("__c").alias("__size"))
    sizes = sizes.withColumn("__begin", F.coalesce(F.sum("__size").over(parts.over().rowsBetween(*BEFORE)), F.lit(0))).withColumn("__n", F.sum("__size").over(W.partitionBy("__g")))
    ranks = F.array(*[f(F.lit(float(p)) * (F.col("__n") - 1)).cast("long") for p in probabilities.values() for f in (F.floor, F.ceil)])
    inside = F.array_distinct(F.filter(ranks, lambda r: (r >= F.col("__begin")) & (r < F.col("__begin") + F.col("__size"))))
    wanted = written(sizes.select("__g", "__part", "__begin", "__n", inside.alias("__ranks")).where(F.size("__ranks") > 0))  # a part or two per group and probability
    hint = F.broadcast if R.fits(wanted, F.lit(256)) else (lambda df: df)
    near = parts.rows.join(hint(wanted), ["__g", "__part"])
    end = F.col("__begin") + F.sum("__c").over(parts.within())
    near = near.withColumn("__end", end).withColumn("__ranks", F.filter("__ranks", lambda r: (r >= F.col("__end") - F.col("__c")) & (r < F.col("__end"))))
    found = near.where(F.size("__ranks") > 0).select("__g", "__n", F.explode("__ranks").alias("r"), "__v")
    found = found.groupBy("__g", "__n").agg(F.map_from_entries(F.collect_list(F.struct("r", "__v"))).alias("__at"))  # two ranks per probability

    def value_at(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    return found.select(*[F.col(f"__g.{c}").alias(c) for c in by], *[value_at(p).alias(n) for n, p in probabilities.items()])
