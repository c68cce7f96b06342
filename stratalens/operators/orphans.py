"""Problem 5: references to objects or nodes that are not there.

A broadcast Bloom filter of all parent keys proves most orphans at once: what it
doesn't hold is nowhere. Only references that pass it are verified by an exact
join, and that join also tells the deleted from the late ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.functions import bloom
from stratalens.session import BROADCAST_ROWS, lookup_join, materialize

_NEVER = "timestamp '9999-12-31 23:59:59'"


def _spellings(kinds: DataFrame) -> DataFrame:
    """(kind, one): every spelling of a kind, and the one that stands for all."""
    both = kinds.select(F.explode(F.array("singular_eng", "russian_name")).alias("kind"), F.col("singular_eng").alias("one"))
    return materialize(both.where("kind is not null").groupBy("kind").agg(F.min("one").alias("one")), "spellings")


def _one_spelling(df: DataFrame, spellings: DataFrame, spread: str) -> DataFrame:
    """``object`` with its kind in one spelling."""
    rest: Column = F.expr("substring(object, instr(object, '.'))")
    kind = F.when(F.instr("object", ".") > 0, F.substring_index("object", ".", 1))
    joined = lookup_join(df.withColumn("kind", kind), spellings, ["kind"], "left", spread, written=True)
    return joined.withColumn("object", F.when(F.col("one").isNotNull(), F.concat("one", rest)).otherwise(F.col("object"))).drop("kind", "one")


def _key(tag: str, *columns: str) -> Column:
    return F.xxhash64(F.lit(tag), *columns)


def _merged(spans: DataFrame, *within: str) -> DataFrame:
    """Spans (since, until) that overlap or touch, as one, of each group."""
    own = W.partitionBy(*within).orderBy("since")
    reached = spans.withColumn("reached", F.max("until").over(own.rowsBetween(W.unboundedPreceding, -1)))
    numbered = reached.withColumn("span", F.sum(F.when(F.col("since") <= F.col("reached"), 0).otherwise(1)).over(own))
    return numbered.groupBy(*within, "span").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("span")


def lives(universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each (repo, object): when it first began, and the disjoint spans in which it exists.

    Spans are merged by month of their beginning first, so that an object with
    very many rows is split among tasks and only what is left of it meets.
    """
    rows = universe.groupBy("repo", "object", "first_seen").agg(F.max(F.coalesce("deleted_at", F.expr(_NEVER))).alias("until"))
    begun = rows.groupBy("repo", "object").agg(F.min("first_seen").alias("begun"))
    spans = rows.where("until > first_seen").select("repo", "object", F.col("first_seen").alias("since"), "until", F.date_trunc("month", "first_seen").alias("month"))
    return begun, _merged(_merged(spans, "repo", "object", "month"), "repo", "object")


def orphans(membership: DataFrame, universe: DataFrame, subsystem: DataFrame, kinds: DataFrame, most_bytes: int = bloom.MOST_BYTES, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(table_name, row_id, reason, seen_at) of both tables; seen_at is read_at of a node.

    Defined results: null and empty references are no case; a member without
    seen_at is a case only if universe never holds its object; an object without
    first_seen never begins, and one deleted before it began doesn't exist; a
    null repo is one repo; a null parent path in ``subsystem`` is no parent;
    with empty parents every reference is missing; repeated rows count once.
    A filter above ``most_bytes`` isn't built, and all references are verified.
    """
    spark = membership.sparkSession
    members = membership.where("object is not null and object != ''").select("member_id", "repo", "object", "seen_at")
    spellings = _spellings(kinds)
    members = _one_spelling(members, spellings, "member_id").select(F.lit("membership").alias("table_name"), F.col("member_id").alias("row_id"), "repo", F.col("object").alias("target"), "seen_at", _key("o", "repo", "object").alias("h"))
    nodes = subsystem.where("parent_path is not null and parent_path != ''").select(F.lit("subsystem").alias("table_name"), F.col("subsystem_id").alias("row_id"), "repo", F.col("parent_path").alias("target"), F.col("read_at").alias("seen_at"), _key("n", "repo", "parent_path").alias("h"))
    objects = _one_spelling(universe.where("object is not null").select("repo", "object", "first_seen", "deleted_at"), spellings, "first_seen")
    paths = subsystem.where("path is not null").select("repo", F.col("path").alias("target"))
    keys = objects.select(_key("o", "repo", "object").alias("h")).unionAll(paths.select(_key("n", "repo", "target").alias("h")))
    held = bloom.build(keys, most_bytes)
    maybe = bloom.may_hold(held, F.col("h"), spark)
    missing = F.lit("missing").alias("reason")

    proved = members.unionAll(nodes).where(~maybe).select("table_name", "row_id", missing, "seen_at")
    begun, spans = lives(objects)
    begun = begun.withColumnRenamed("object", "target")
    asked = lookup_join(members.where(maybe), begun.withColumn("there", F.lit(True)), ["repo", "target"], "left", "row_id", most=most_rows)
    spans = spans.withColumnRenamed("object", "target")
    alive = (F.col("seen_at") >= F.col("since")) & (F.col("seen_at") < F.col("until"))
    dead = lookup_join(asked, spans, ["repo", "target"], "left_anti", "row_id", alive, most=most_rows)
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("seen_at").isNull(), None).when(F.col("begun") <= F.col("seen_at"), "deleted").otherwise("late")
    of_members = dead.select("table_name", "row_id", reason.alias("reason"), "seen_at").where("reason is not null")
    of_nodes = lookup_join(nodes.where(maybe), paths.distinct(), ["repo", "target"], "left_anti", "row_id", most=most_rows).select("table_name", "row_id", missing, "seen_at")
    return proved.unionAll(of_members).unionAll(of_nodes).distinct()


def found(membership: DataFrame, universe: DataFrame, subsystem: DataFrame, kinds: DataFrame) -> DataFrame:
    """p5_found over both tables."""
    return orphans(membership, universe, subsystem, kinds).select("table_name", "row_id", "reason")


def counts(membership: DataFrame, universe: DataFrame, subsystem: DataFrame, kinds: DataFrame) -> DataFrame:
    """Orphans per table, month and reason; the month is that of seen_at, or of read_at for nodes, and null without one."""
    month = F.date_format("seen_at", "yyyy-MM").alias("month")
    return orphans(membership, universe, subsystem, kinds).groupBy("table_name", month, "reason").agg(F.count("*").alias("orphans"))


def orphans_sql(last: str) -> str:
    """The orphans as ``orphan`` in DuckDB's SQL, by plain lookups, before the query ``last``."""
    spelled = lambda t: f"case when k.one is not null then k.one || substr({t}.object, instr({t}.object, '.')) else {t}.object end"
    return f"""
        with k as (select unnest([singular_eng, russian_name]) as kind, singular_eng as one from metadata_kind),
        member as (select distinct member_id, m.repo, {spelled("m")} as object, seen_at from membership m
                   left join k on k.kind = split_part(m.object, '.', 1) and contains(m.object, '.') where m.object != ''),
        life as (select distinct u.repo, {spelled("u")} as object, first_seen, deleted_at from universe u
                 left join k on k.kind = split_part(u.object, '.', 1) and contains(u.object, '.')),
        judged as (select m.member_id, m.seen_at, count(l.repo) as n,
                          coalesce(bool_or(l.first_seen <= m.seen_at), false) as begun,
                          coalesce(bool_or(l.first_seen <= m.seen_at and (l.deleted_at is null or m.seen_at < l.deleted_at)), false) as alive
                   from member m left join life l on l.repo = m.repo and l.object = m.object group by m.member_id, m.seen_at),
        orphan as (
            select 'membership' as table_name, member_id as row_id, case when n = 0 then 'missing' when begun then 'deleted' else 'late' end as reason, seen_at
            from judged where n = 0 or (not alive and seen_at is not null)
            union all
            select distinct 'subsystem', subsystem_id, 'missing', read_at from subsystem s
            where parent_path != '' and not exists (select 1 from subsystem p where p.repo = s.repo and p.path = s.parent_path))
        {last}
    """


FOUND_SQL = "select table_name, row_id, reason from orphan"
COUNTS_SQL = "select table_name, strftime(seen_at, '%Y-%m') as month, reason, count(*) as orphans from orphan group by all"
