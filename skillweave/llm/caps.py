"""Capping records per dominant contributor (problem 1).

``cap_contributors`` is a b-matching of records and contributors by proposals. Every record proposes to all
the contributors it lists. A contributor holds its best proposals up to its capacity and displaces weaker
ones; a record stays only if none of its contributors displaces it. The result is that of taking the records
one by one, best first, each if all its contributors have room.

All records that hold at all of their contributors are matched in one round, their places are taken off the
capacities, records with a full contributor are displaced, and the rest propose again. A record that waits for
one other only (the holder of a contributor's last place) follows it: it stays if that one goes. Chains of
followers are resolved by pointer doubling within the round, so that a chain of n records takes log n joins.
With one contributor per record, one round decides.

Defined cases: a record without contributors (null or empty list, or only nulls) is kept, it counts for no
one. A contributor named twice by a record counts once. A repeated record id counts once, with its best
score. Null and NaN scores are the lowest. Equal scores: the smaller id first. An empty table gives an
empty table. Contributors missing from the capacities have no limit, a null capacity neither; one below 0 is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.plans.materialize import materialize, scratch


def rank_in_groups(df: DataFrame, group: str, order: list[Column], slices: int | None = None) -> DataFrame:
    """df with its 1-based rank within group as column ``rank``, without one task per group.

    A range exchange on (group, order) cuts a hot group into many slices; the rank within a slice plus the
    sizes of the group's earlier slices is the rank in the group. order must be total.
    """
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, F.col(group), *order).withColumn("_slice", F.spark_partition_id())
    cut = materialize(cut)
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(group, "_slice").count()
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(group, "_slice").orderBy(*order)
    ranked = cut.withColumn("_inside", F.row_number().over(inside)).join(sizes, [group, "_slice"])
    return ranked.withColumn("rank", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_slice")


def _followed(ranked: DataFrame) -> DataFrame:
    """id, root, kept: of the records that follow others, the record at their chain's end and whether they stay if
    that one does. ranked: id, contributor, rank, capacity."""
    holder = ranked.where("rank = 1 and capacity = 1").select("contributor", F.col("id").alias("holder"))
    blocked = ranked.where("rank > capacity").join(holder, "contributor", "left")
    only = F.bool_and((F.col("rank") == 2) & (F.col("capacity") == 1)).alias("only")
    waits = blocked.groupBy("id").agg(only, F.min("holder").alias("root"), F.max("holder").alias("other"))
    chain = materialize(waits.where("only and root = other").select("id", "root", F.lit(False).alias("kept")))
    while True:
        ahead = chain.select(F.col("id").alias("root"), F.col("root").alias("then"), F.col("kept").alias("also"))
        far = chain.join(ahead, "root", "left")
        step = materialize(
            far.select("id", F.coalesce("then", "root").alias("root"), F.when(F.col("also").isNull(), F.col("kept")).otherwise(F.col("kept") == F.col("also")).alias("kept"), F.col("then").isNotNull().alias("moved"))
        )
        if not step.where("moved").head(1):
            return step.drop("moved")
        chain = step.drop("moved")


def cap_contributors(records: DataFrame, capacities: DataFrame) -> DataFrame:
    """records: id, contributors (array of string), score (double). capacities: contributor, capacity (bigint).

    Returns id, displaced_by (the contributors that were full when it was displaced, null for a kept record), one
    row per distinct id.
    """
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    edges = (
        records.select("id", score.alias("score"), F.explode("contributors").alias("contributor"))
        .where(F.col("contributor").isNotNull())
        .groupBy("id", "contributor")
        .agg(F.max("score").alias("score"))
    )
    # Only contributors over their capacity can displace: the count is pre-aggregated, and the
    # contributors that are left are few by nature (their members outnumber their capacities).
    demand = edges.groupBy("contributor").agg(F.count("*").alias("n"))
    limits = capacities.where("capacity is not null").groupBy("contributor").agg(F.greatest(F.min("capacity"), F.lit(0)).alias("capacity"))
    left = materialize(demand.join(limits, "contributor").where("n > capacity").select("contributor", "capacity"))
    contested = edges.join(left.select("contributor"), "contributor", "left_semi")
    # a record's score must be one value at all its contributors, or rounds could wait for each other
    best = contested.groupBy("id").agg(F.max("score").alias("score"))
    pending = materialize(contested.drop("score").join(best, "id"))
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    lost: list[DataFrame] = []
    while True:
        with scratch() as keep:
            ranked = materialize(rank_in_groups(pending, "contributor", order).join(left, "contributor").drop("score"))
            matched = ranked.groupBy("id").agg(F.bool_and(F.col("rank") <= F.col("capacity")).alias("matched")).where("matched").select("id")
            if left.where("capacity = 1").head(1):
                matched = materialize(matched)
                chain = _followed(ranked)
                matched = matched.unionByName(chain.where("kept").join(matched.withColumnRenamed("id", "root"), "root", "left_semi").select("id"))
            matched = materialize(matched)
            taken = ranked.join(matched, "id", "left_semi").groupBy("contributor").agg(F.count("*").alias("taken"))
            room = F.col("capacity") - F.coalesce("taken", F.lit(0))
            left = materialize(left.join(taken, "contributor", "left").select("contributor", room.alias("capacity")))
            rest = pending.join(matched, "id", "left_anti")
            full = rest.join(left.where("capacity = 0").select("contributor"), "contributor").groupBy("id")
            lost.append(materialize(full.agg(F.collect_set("contributor").alias("displaced_by"))))
            pending = materialize(rest.join(lost[-1], "id", "left_anti"))
            keep += [left, pending, lost[-1]]
        if not pending.head(1):
            break
    out = reduce(DataFrame.unionByName, lost)
    return records.select("id").distinct().join(out, "id", "left")


def repo_key(name: Column) -> Column:
    """One spelling per repository: lower case, no blanks around, no ending .git, then no -main or -master."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, r"\A\s+|\s+\z", "")), r"\.git\z", "")
    return F.regexp_replace(bare, r"-(main|master)\z", "")


def latest_score(tags: DataFrame, score: str = "reusable_intent_score") -> DataFrame:
    """data_id, score of the tag with the latest tagged_at, then the largest tag_id; clamped to [0, 1]."""
    last = tags.groupBy("data_id").agg(F.max_by(F.col(score), F.struct("tagged_at", "tag_id")).alias("score"))
    valid = F.when(F.isnan("score"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return last.select("data_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), valid)).alias("score"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, repo, ext (of the path), score of every distinct data_id."""
    ext = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    units = (
        spark.read.parquet(f"{sf_dir}/source_unit.parquet")
        .groupBy("data_id")
        .agg(F.min(repo_key(F.col("repo_name"))).alias("repo"), F.min(ext).alias("ext"))
    )
    tags = latest_score(spark.read.parquet(f"{sf_dir}/source_unit_tag.parquet"))
    return units.join(tags, "data_id", "left").select(F.col("data_id").alias("id"), "repo", "ext", F.coalesce("score", F.lit(0.0)).alias("score"))


def _displaced(records: DataFrame, shares: dict[str, int]) -> DataFrame:
    """data_id of the records displaced where each value of a column may have the count of all records divided by
    the column's share."""
    named = lambda c: F.concat(F.lit(f"{c}:"), c)
    records = materialize(records.select("id", F.array(*map(named, shares)).alias("contributors"), "score"))
    count = records.count()
    room = F.coalesce(*[F.when(F.col("contributor").startswith(f"{c}:"), count // n) for c, n in shares.items()])
    each = records.select(F.explode("contributors").alias("contributor")).where("contributor is not null").distinct()
    out = cap_contributors(records, each.withColumn("capacity", room.cast("bigint")))
    return out.where("displaced_by is not null").select(F.col("id").alias("data_id"))


def p1_found(spark: SparkSession, sf_dir: str, share: int = 50) -> DataFrame:
    """data_id of the units beyond the best N / share of their repository, N being all distinct data_id."""
    return _displaced(_records(spark, sf_dir), {"repo": share})


def p1_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id of the units to drop so that no repository has more than a fiftieth and no file extension more than
    a twentieth of all; each unit has both as contributors."""
    return _displaced(_records(spark, sf_dir), {"repo": 50, "ext": 20})


QUERIES = {"p1_found": p1_found, "p1_shared": p1_shared}

_UNITS = r"""
u as (
  select data_id, min(regexp_replace(regexp_replace(lower(regexp_replace(repo_name, '^\s+|\s+$', '', 'g')), '\.git$', ''),
                      '-(main|master)$', '')) as repo, min(lower(regexp_extract(relative_path, '\.([^./]+)$', 1))) as ext
  from source_unit group by data_id
), t as (
  select data_id, case when s is null or isnan(s) then 0.0 else least(1.0, greatest(0.0, s)) end as score
  from (select data_id, reusable_intent_score as s,
               row_number() over (partition by data_id order by tagged_at desc, tag_id desc) as n
        from source_unit_tag) where n = 1
)"""
SQL = {
    "p1_found": f"""
with {_UNITS}, r as (
  select u.data_id, row_number() over (partition by repo order by coalesce(score, 0.0) desc, u.data_id) as n
  from u left join t using (data_id)
)
select data_id from r where n > (select count(*) // 50 from u)
""",
    # one record after the other, with what each contributor holds so far
    "p1_shared": f"""
with recursive {_UNITS}, o as (
  select u.data_id, 'repo:' || repo as a, 'ext:' || ext as b, row_number() over (order by coalesce(score, 0.0) desc, u.data_id) as i,
         count(*) over () // 50 as most_a, count(*) over () // 20 as most_b
  from u left join t using (data_id)
), r as (
  select 0::bigint as i, '' as data_id, true as kept, map {{'': 0::bigint}} as held
  union all
  select n.i, n.data_id, n.kept, case when n.kept then map_concat(held, map {{coalesce(n.a, ''): x + 1, coalesce(n.b, ''): y + 1}}) else held end
  from (select o.*, held, coalesce(held[o.a], 0) as x, coalesce(held[o.b], 0) as y,
               (o.a is null or coalesce(held[o.a], 0) < most_a) and (o.b is null or coalesce(held[o.b], 0) < most_b) as kept
        from r join o on o.i = r.i + 1) n
)
select data_id from r where not kept
""",
}
