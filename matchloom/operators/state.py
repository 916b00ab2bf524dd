"""Versions of tables: latest rows, upserts, expiry, flags, reuse by content, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS
from matchloom.session import discard, materialise


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the highest ``by``, nulls last; of equal ones always the same, by a digest of all columns.

    Partial maxima are taken before the shuffle, so that hot keys do not gather.
    """
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(by).isNotNull(), F.col(by), F.xxhash64(*others))).alias("_row"))
    return best.select(*keys, "_row.*")


def upserted(rows: DataFrame, keys: list[str], changed: str, keep_first: list[str]) -> DataFrame:
    """One row for each key: the values written last, but those of ``keep_first`` from the first write. Rows with a null key stay apart."""
    others = [c for c in rows.columns if c not in keys and c not in keep_first]
    order = lambda names: F.struct(F.col(changed), *names)
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    aggs = [F.max_by(F.struct(*others), order(others)).alias("_last"), F.min_by(F.struct(*keep_first), order(keep_first)).alias("_first")]
    done = rows.where(full).groupBy(*keys).agg(*aggs).select(*keys, "_last.*", "_first.*")
    return done.unionByName(rows.where(~full).select(done.columns))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` holds, and ``new``: no stale rows of a key stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def matched_by_either(rows: DataFrame, id_column: str, first: list[str], second: list[str]) -> DataFrame:
    """``(id, owner)``: rows that agree in all columns of ``first``, or of ``second``, belong together, also through others between
    them, and to the least id among them.

    The least id spreads along both keys, jumping to the owner's owner each time, until nothing changes; only a count reaches
    the driver.
    """
    full = lambda keys: F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    kept = materialise(rows.select(id_column, *{*first, *second}).withColumn("owner", F.col(id_column)))
    while True:
        now = kept.select("*", F.col("owner").alias("_next"))
        for keys in (first, second):
            least = kept.where(~full(keys)).groupBy(*keys).agg(F.min("owner").alias("_least"))
            now = now.join(least, keys, "left").withColumn("_next", F.least("_next", F.coalesce("_least", "_next"))).drop("_least")
        jump = now.groupBy(F.col(id_column).alias("_next")).agg(F.min("_next").alias("_jump"))
        now = materialise(now.join(jump, "_next", "left").withColumn("_next", F.least("_next", F.coalesce("_jump", "_next"))).drop("_jump"))
        if now.where("_next <> owner").isEmpty():
            return now.select(id_column, "owner")
        discard(kept)
        kept = now.drop("owner").withColumnRenamed("_next", "owner")


def live(now: Column, expires: str = "expires_at") -> Column:
    """True for rows without expiry, and before it."""
    return F.col(expires).isNull() | (F.col(expires) > now)


def pending(flag: str = "indexed") -> Column:
    """True for rows whose flag is not true; null counts as not true."""
    return ~F.col(flag).eqNullSafe(F.lit(True))


def expiry(created: Column, days: int = DEFAULTS.ttl_days) -> Column:
    """Expiry of a row written at ``created``."""
    return created + F.make_interval(days=F.lit(days))


def cache_hits(cache: DataFrame, now: Column, hours: int = DEFAULTS.cache_hours) -> DataFrame:
    """Rows of ``cache(key, value, cached_at)`` that are not too old; with 0 hours or less all."""
    return cache if hours <= 0 else cache.where(F.col("cached_at") + F.make_interval(hours=F.lit(hours)) > now)


def cache_set(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with ``rows`` in place of what it held under their keys."""
    return replaced(cache, rows, "key")


def cache_delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without ``keys(key)``."""
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def cache_clear(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cache without rows, and the number it held."""
    return cache.limit(0), cache.agg(F.count("*").alias("removed"))


def swept(cache: DataFrame, now: Column, hours: int = DEFAULTS.cache_hours) -> tuple[DataFrame, DataFrame]:
    """The rows of a cache that stay, and the number of those that are too old."""
    old = F.lit(False) if hours <= 0 else F.coalesce(F.col("cached_at") + F.make_interval(hours=F.lit(hours)) <= now, F.lit(True))
    return cache_hits(cache, now, hours), cache.agg(F.count_if(old).alias("removed"))
