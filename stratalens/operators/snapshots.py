"""Problem 2: files added, modified and deleted between consecutive full snapshots.

Every file of a snapshot is written as signed cells: a presence marker and one
cell per compared field, with +1 in the comparison that ends at its snapshot and
-1 in the one that begins there. Cells that did not change cancel out. What is
left of a file's marker tells added from deleted, and what is left of its field
cells tells that it was modified, and in which fields.

One exchange of the rows by (repo, path) serves all three aggregations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.session import lookup_join

#: Fields whose change makes a file modified.
FIELDS = ("mtime_ms", "size")


def _path(text: str) -> str:
    """Forward slashes, no leading ``./``, composed characters."""
    text = text.replace("\\", "/")
    while text.startswith("./"):
        text = text[2:].lstrip("/")
    return unicodedata.normalize("NFC", text)


def _numbers(column: pa.Array) -> np.ndarray:
    """Sortable numbers with null before all others."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    return pc.fill_null(column, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths in one spelling; of the rows of one file in a batch only the latest goes on."""
    for batch in batches:
        paths = batch.column("rel_path").dictionary_encode()
        clean = pa.array([None if p is None else _path(p) for p in paths.dictionary.to_pylist()], pa.string()).take(paths.indices)
        key = pc.binary_join_element_wise(batch.column("repo"), batch.column("gen"), clean, "\x00", null_handling="replace", null_replacement="\x01")
        group = key.dictionary_encode().indices.to_numpy()
        order = np.lexsort([_numbers(batch.column(f)) for f in (*reversed(FIELDS), "loaded_at")] + [group])
        last = np.append(np.diff(group[order]) != 0, True) if len(order) else np.empty(0, bool)
        kept = pa.array(np.sort(order[last]))
        yield pa.RecordBatch.from_arrays([(clean if name == "rel_path" else batch.column(name)).take(kept) for name in batch.schema.names], names=batch.schema.names)


def changes(manifest: DataFrame) -> DataFrame:
    """(repo, gen, rel_path, diff_kind, changed_fields), gen being the later snapshot of the pair.

    Defined results: snapshots follow each other by gen_at (the earliest one
    delivered with the gen), equal ones by gen; null equals null only; of rows
    of one file with equal loaded_at the one with the greatest mtime_ms, then
    size holds, and null is before every value; a null path or repo is a value
    like others; changed_fields of added and deleted files is empty; an empty
    table and a single snapshot give no rows. Other columns are not read.
    """
    order = W.partitionBy("repo").orderBy("gen_at", "gen")
    snapshots = (  # one row a snapshot
        manifest.groupBy("repo", "gen").agg(F.min("gen_at").alias("gen_at"))
        .select("repo", "gen", (F.row_number().over(order) > 1).alias("later"), F.lead(F.struct("gen")).over(order).alias("next"))
    )
    files = manifest.select("repo", "gen", "rel_path", "mtime_ms", "size", "loaded_at")
    files = files.mapInArrow(_combine, files.schema)
    files = lookup_join(files, snapshots, ["repo", "gen"], "inner", "rel_path")
    files = files.repartition("repo", "rel_path").groupBy("repo", "rel_path", "gen", "later", "next").agg(F.max(F.struct("loaded_at", *FIELDS)).alias("x"))
    ends = F.when(F.col("later"), F.struct(F.struct("gen").alias("at"), F.lit(1).alias("sign")))
    begins = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("at"), F.lit(-1).alias("sign")))
    signed = files.select("repo", "rel_path", "x", F.explode(F.array(ends, begins)).alias("s")).where("s is not null")
    marker = F.struct(F.lit("").alias("field"), F.lit(None).cast("bigint").alias("value"))
    cells = F.array(marker, *[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("value")) for f in FIELDS])
    summed = (
        signed.select("repo", "rel_path", F.col("s.at.gen").alias("gen"), "s.sign", F.inline(cells))
        .groupBy("repo", "rel_path", "gen", "field", "value").agg(F.sum("sign").alias("sign"))
        .where("sign != 0")
    )
    left = summed.groupBy("repo", "rel_path", "gen").agg(
        F.max(F.when(F.col("field") == "", F.col("sign"))).alias("presence"), F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("fields")
    )
    kind = F.when(F.col("presence") == 1, "added").when(F.col("presence") == -1, "deleted").otherwise("modified")
    fields = F.when(F.col("presence").isNull(), F.array_join("fields", ",")).otherwise("")
    return left.select("repo", "gen", "rel_path", kind.alias("diff_kind"), fields.alias("changed_fields"))


def diff(manifest: DataFrame) -> DataFrame:
    """p2_found: the changes without their fields."""
    return changes(manifest).drop("changed_fields")


def diff_sql() -> str:
    """The changes in DuckDB's SQL, by a full outer join of neighbouring snapshots."""
    return """
        with clean as (
            select repo, gen, gen_at, nfc_normalize(regexp_replace(replace(rel_path, '\\', '/'), '^(\\./+)+', '')) as rel_path, mtime_ms, size, loaded_at from manifest),
        snap as (
            select repo, gen, row_number() over w as n, lead(gen) over w as next_gen
            from (select repo, gen, min(gen_at) as gen_at from clean group by all) window w as (partition by repo order by gen_at, gen)),
        file as (
            select repo, gen, rel_path, mtime_ms, size from clean
            qualify row_number() over (partition by repo, gen, rel_path order by loaded_at desc nulls last, mtime_ms desc nulls last, size desc nulls last) = 1),
        old as (select s.repo, s.next_gen as gen, rel_path, mtime_ms, size from file f join snap s on f.repo = s.repo and f.gen = s.gen where s.next_gen is not null),
        new as (select s.repo, s.gen, rel_path, mtime_ms, size from file f join snap s on f.repo = s.repo and f.gen = s.gen where s.n > 1),
        both_sides as (
            select coalesce(o.repo, n.repo) as repo, coalesce(o.gen, n.gen) as gen, coalesce(o.rel_path, n.rel_path) as rel_path,
                   o.repo is null as fresh, n.repo is null as gone,
                   n.mtime_ms is distinct from o.mtime_ms as m, n.size is distinct from o.size as s
            from old o full join new n on o.repo = n.repo and o.gen = n.gen and o.rel_path = n.rel_path)
        select repo, gen, rel_path, case when fresh then 'added' when gone then 'deleted' else 'modified' end as diff_kind,
               case when fresh or gone then '' else concat_ws(',', case when m then 'mtime_ms' end, case when s then 'size' end) end as changed_fields
        from both_sides where fresh or gone or m or s
    """
