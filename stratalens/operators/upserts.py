"""Snapshots of files: differences, signatures, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Versions of derivation, schema and format that a signature covers.
VERSIONS = (1, 6, 16)


def file_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, change) of two sets of files with unique keys: added, modified or deleted; null equals null only."""
    a = old.select(*key, F.struct(*fields).alias("__old"), F.lit(True).alias("__was"))
    b = new.select(*key, F.struct(*fields).alias("__new"), F.lit(True).alias("__is"))
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(*key, "change")


def latest_files(manifest: DataFrame) -> DataFrame:
    """The files of each snapshot, of repeated ones those loaded last."""
    return manifest.groupBy("repo", "gen", "rel_path").agg(F.max(F.struct("loaded_at", "mtime_ms", "size", "doc_id")).alias("x")).select("repo", "gen", "rel_path", "x.mtime_ms", "x.size", "x.doc_id")


def ends(manifest: DataFrame) -> DataFrame:
    """(repo, gen, newest): the first and the last snapshot of each repo that has two."""
    snapshots = manifest.groupBy("repo", "gen").agg(F.min("gen_at").alias("gen_at"))
    span = snapshots.groupBy("repo").agg(F.min(F.struct("gen_at", "gen")).alias("a"), F.max(F.struct("gen_at", "gen")).alias("b")).where("a != b")
    return span.select("repo", F.inline(F.array(F.struct(F.col("a.gen").alias("gen"), F.lit(False).alias("newest")), F.struct(F.col("b.gen").alias("gen"), F.lit(True).alias("newest")))))


def signatures(manifest: DataFrame) -> DataFrame:
    """(repo, gen, signature, files): one content signature of each snapshot.

    The digests of its files are added up, eight numbers each, and the sums
    digested with the versions: the order of files doesn't matter, sums are made
    before the exchange, and no snapshot is gathered anywhere.
    """
    line = F.concat_ws("\x00", "rel_path", F.coalesce(F.col("mtime_ms").cast("string"), F.lit("")), F.coalesce(F.col("size").cast("string"), F.lit("")))
    rows = latest_files(manifest).select("repo", "gen", F.sha2(line, 256).alias("d"))
    number = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("bigint")
    sums = rows.groupBy("repo", "gen").agg(F.count("*").alias("files"), *[F.sum(number(i)).alias(f"s{i}") for i in range(8)])
    whole = F.concat_ws("\n", F.lit(".".join(map(str, VERSIONS))), "files", *[f"s{i}" for i in range(8)])
    return sums.select("repo", "gen", F.substring(F.sha2(whole, 256), 1, 16).alias("signature"), "files")


def signatures_sql() -> str:
    sums = [f"sum(('0x' || d[{8 * i + 1}:{8 * i + 8}])::bigint)::varchar" for i in range(8)]
    return f"""
        with file as (select repo, gen, rel_path, mtime_ms, size from manifest
                      qualify row_number() over (partition by repo, gen, rel_path order by loaded_at desc nulls last, mtime_ms desc nulls last, size desc nulls last, doc_id desc nulls last) = 1),
        digest as (select repo, gen, sha256(rel_path || chr(0) || coalesce(mtime_ms::varchar, '') || chr(0) || coalesce(size::varchar, '')) as d from file)
        select repo, gen, sha256(concat_ws(chr(10), '{".".join(map(str, VERSIONS))}', count(*)::varchar, {", ".join(sums)}))[1:16] as signature, count(*) as files from digest group by all
    """


def upsert(base: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``changed`` in the place of those with their keys."""
    return base.join(changed.select(*key).distinct(), key, "left_anti").unionByName(changed)


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``base`` without the rows of some keys."""
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame, key: list[str], kind: str = "change") -> DataFrame:
    """``base`` after added, modified and deleted rows: base without all touched keys, and what is new."""
    fresh = changes.where(F.col(kind) != "deleted").drop(kind)
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(fresh.select(*base.columns))


def overlay(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """Both with their origin; a key of the overlay hides that of the base."""
    return base.join(over.select(*key).distinct(), key, "left_anti").withColumn("origin", F.lit("base")).unionByName(over.withColumn("origin", F.lit("overlay")))


def first_of(df: DataFrame, name: list[str], order: list[str]) -> DataFrame:
    """The first row of each name by an order that ends all ties."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*name).orderBy(*order))).where("__n = 1").drop("__n")


def reload_report(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row: modules before and after, added, modified and deleted ones, and whether anything changed.

    ``accepted`` is false where a filled snapshot would be replaced by an empty one.
    """
    counts = file_diff(old, new, key, fields).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")])
    count = lambda df: df.agg(F.count("*")).scalar()
    out = counts.select(count(old).alias("before"), count(new).alias("after"), "added", "modified", "deleted")
    return out.withColumn("changed", F.col("added") + F.col("modified") + F.col("deleted") > 0).withColumn("accepted", (F.col("after") > 0) | (F.col("before") == 0))
