"""Small relational building blocks that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import blank


def frontier(listings: DataFrame, crawled: DataFrame, key: str, order: str, statuses=("pending", "failed"), status: str = "detail_status") -> DataFrame:
    """Listings still to be crawled: not crawled, first seen for each key, in one of the statuses."""
    open_ = listings.where(~blank(F.col(key))).join(crawled.select(key), key, "left_anti").where(F.col(status).isin(*statuses))
    return open_.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def coalesced_join(details: DataFrame, listings: DataFrame, keys: list[str], shared: list[str], dedupe_right: bool = False) -> DataFrame:
    """Inner join; of shared columns the details' value counts, else the listings'."""
    right = listings.dropDuplicates(keys) if dedupe_right else listings
    joined = details.alias("d").join(right.alias("l"), keys)
    own = [c for c in details.columns if c not in keys and c not in shared]
    other = [c for c in listings.columns if c not in keys and c not in shared and c not in details.columns]
    return joined.select(*keys, *[F.coalesce(f"d.{c}", f"l.{c}").alias(c) for c in shared], *[F.col(f"d.{c}") for c in own], *[F.col(f"l.{c}") for c in other])


def lookup_codes(c: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key is in no row of the parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def parent_names(frame: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """frame with its parent's name, from the same table."""
    up = frame.select(F.col(key).alias("_up"), F.col(name).alias(f"parent_{name}"))
    return frame.join(up, F.col(parent) == F.col("_up"), "left").drop("_up")


def top_k(frame: DataFrame, k: int, by: str, ties: list[str], groups: list[str] | None = None) -> DataFrame:
    """The k rows with the greatest ``by``, of each group if groups are given; ties by further columns."""
    order = [F.col(by).desc(), *ties]
    if not groups:
        return frame.orderBy(*order).limit(k)
    return frame.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def page(frame: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    return frame.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def seeded_sample(frame: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key, so that reruns agree."""
    return frame.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def weighted_sample(frame: DataFrame, n: int, key: str, weight: str, seed: int = 42, groups: list[str] | None = None) -> DataFrame:
    """n rows without replacement, with chances in proportion to weight (exponential keys)."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**53)) + 0.5) / 2.0**53
    keyed = frame.where(F.col(weight) > 0).withColumn("_key", -F.log(uniform) / F.col(weight))
    if not groups:
        return keyed.orderBy("_key").limit(n).drop("_key")
    return keyed.withColumn("_n", F.row_number().over(W.partitionBy(*groups).orderBy("_key"))).where(F.col("_n") <= n).drop("_key", "_n")


def weighted_union(real: DataFrame, simulated: DataFrame, user: str = "user_id") -> DataFrame:
    """Real and simulated events, the latter's users marked as such."""
    return real.unionByName(simulated.withColumn(user, F.concat(F.lit("sim_"), F.col(user).cast("string"))), allowMissingColumns=True)


def value_counts(frame: DataFrame, *columns: str) -> DataFrame:
    """Counts and shares in percent, null being a value."""
    counts = frame.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(frame.agg(F.count("*").alias("_total")))).withColumn("share", F.round(100 * F.col("n") / F.col("_total"), 2)).drop("_total")


def describe(frame: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles by linear interpolation, max."""
    c = F.col(column).cast("double")
    quartiles = [F.percentile(c, q).alias(name) for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return frame.groupBy(*(groups or [])).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *quartiles, F.max(c).alias("max"))


def histogram(frame: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the upper end belongs to the last bin, values outside are left out."""
    inside = frame.where(F.col(column).between(low, high))
    number = F.least(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return inside.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def null_report(frame: DataFrame) -> DataFrame:
    """For each column the numbers of nulls and of blanks, and the missing share in percent."""
    one = frame.agg(F.count("*").alias("total"), *[x for i, c in enumerate(frame.columns) for x in (F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.count_if(F.col(c).isNotNull() & blank(F.col(c).cast("string"))).alias(f"b{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("blanks")) for i, c in enumerate(frame.columns)])
    flat = one.select("total", F.explode(rows).alias("r")).select("r.*", "total")
    return flat.select("column_name", "nulls", "blanks", F.when(F.col("total") > 0, F.round(100 * (F.col("nulls") + F.col("blanks")) / F.col("total"), 2)).otherwise(0.0).alias("missing_pct"))


def duplicate_report(frame: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """For each named key the rows beyond the first of equal ones (null being a value)."""
    measures = [(F.count("*") - F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]))).alias(name) for name, columns in keys.items()]
    one = frame.agg(*measures)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key_name"), F.col(n).alias("duplicates")) for n in keys])).alias("r")).select("r.*")


def first_seen(items: Column) -> Column:
    """Distinct strings of an array, ignoring case, in the order of their first."""
    none = F.array().cast("array<string>")

    def add(seen, x):
        return F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x)))

    return F.aggregate(F.coalesce(items, none), none, add)


def pairs_within(sets: DataFrame, group: str, item: str, block: int = 512, most_hot: int = 65_536) -> DataFrame:
    """(a, b), a < b, of the items of each group, once for each group; sets has distinct (group, item) rows.

    Groups of more than ``block`` items, and of more than one part in
    ``most_hot`` of all rows, are dealt out in blocks of which every two meet by
    themselves. There are fewer than most_hot such groups, so they are broadcast.
    """
    sets = sets.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(item).alias("_i"))
    counts = sets.groupBy("_g").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > max(block, total // most_hot)))
    cold = sets.join(hot, "_g", "left_anti")
    n_blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = sets.join(hot, "_g").withColumn("_b", F.pmod(F.xxhash64("_i"), n_blocks).cast("int"))
    first = dealt.select("_g", F.col("_i").alias("x"), F.col("_b").alias("_low"), F.explode(F.sequence(F.col("_b"), n_blocks - 1)).alias("_high"))
    second = dealt.select("_g", F.col("_i").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_low"), F.col("_b").alias("_high"))
    pairs = cold.toDF("_g", "x").join(cold.toDF("_g", "y"), "_g").where("x < y").select("x", "y")
    more = first.join(second, ["_g", "_low", "_high"]).where("x < y or (_low < _high and x <> y)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return pairs.unionByName(more).toDF("a", "b")


def blocks(frame: DataFrame, key: str, group: str, size: int) -> DataFrame:
    """The keys of each group, without nulls, as sorted arrays of ``size``, few of them shorter; columns group and keys."""
    frame = frame.where(F.col(key).isNotNull())
    n = frame.groupBy(group).agg(F.ceil(F.count("*") / (16 * size)).alias("_n"))
    dealt = frame.join(F.broadcast(n), group).withColumn("_part", F.pmod(F.xxhash64(key), "_n"))
    whole = dealt.groupBy(group, "_part").agg(F.array_sort(F.collect_list(key)).alias("_keys"))
    starts = F.sequence(F.lit(1), F.size("_keys"), F.lit(size))
    return whole.select(group, F.explode(F.transform(starts, lambda i: F.slice("_keys", i, size))).alias("keys"))


def spread_pairs(pairs: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows of two arrays as rows of all pairs of their elements: inner's, again and again, for each of outer's.

    Runs and repeated sequences take little room in parquet. Generated code would hold all rows that come from one before
    it hands them on; the higher-order function keeps the first explode out of it, so only one outer element's are held.
    """
    rest = [c for c in pairs.columns if c not in (outer, inner)]
    first = pairs.select(*rest, inner, F.explode(F.transform(outer, lambda x: x)).alias(outer))
    return first.select(*rest, outer, F.explode(inner).alias(inner))


def pair_counts(frame: DataFrame, item: str, group: str) -> DataFrame:
    """How many groups hold both of a pair of distinct items (a < b)."""
    return pairs_within(frame.select(group, item).distinct(), group, item).groupBy("a", "b").agg(F.count("*").alias("n"))
