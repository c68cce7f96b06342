"""Queries of the surveyed operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import catalog, keys, kinds, text
from stratalens.operators import eventlog, forms, modules, registers, search, subsystems, upserts
from stratalens.plans import render, sqlfront
from stratalens.session import table
from stratalens.sources.formxml import ELEMENTS, display_type

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function."""

    def kept(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return kept


DISPLAY = {tag: name for tag, name in ELEMENTS.items() if name}

# --- search by lines

WORD, REGEX, WORDS = "Возврат", r"(?i)процедура\s+\w*|\bReturn\b", "регистр document проведение"
CODE = "процедура возврат HTTPRequest"
_IDS = ["doc_id", "file_id"]
_MODULES = modules.modules_sql()
_CATEGORY, _TYPE = "Документ", "МодульОбъекта"
#: What DuckDB's RE2 finds for the same pattern; \w and \b are ASCII in both.
_REGEX_SQL = f"regexp_matches(x, '{REGEX}')"
_EXACT_SQL = f"contains(lower(x), '{WORD.lower()}')"
_LINE_TOTAL = "select count(*) as total, 'lines' as unit from hit"
_FIRST = "select doc_id, file_id, line_no, line, context from hit order by doc_id, file_id, line_no limit 50"


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.modules(table(spark, sf_dir, "source_file"))


@query(f"select distinct file_id, repo, doc_id, namespace, category, object_name, module_type, length(content) as chars from ({_MODULES})")
def module_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with keys and their parts."""
    return _modules(spark, sf_dir).withColumn("chars", F.length("content").cast("bigint")).drop("content").distinct()


@query(search.lines_sql(_MODULES, _EXACT_SQL, "doc_id, file_id", _FIRST))
def search_exact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines with a word in any case, with two lines around."""
    return search.first_lines(_modules(spark, sf_dir), search.exact(WORD), _IDS)


@query(search.lines_sql(_MODULES, _EXACT_SQL, "doc_id, file_id", "select doc_id, file_id, line_no, line, context from hit"))
def search_exact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All such lines."""
    return search.line_hits(_modules(spark, sf_dir), search.exact(WORD), _IDS)


@query(search.lines_sql(_MODULES, _EXACT_SQL, "doc_id, file_id", _LINE_TOTAL))
def search_exact_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of such lines."""
    return search.line_total(_modules(spark, sf_dir), search.exact(WORD), _IDS)


@query(search.lines_sql(f"select * from ({_MODULES}) where category = '{_CATEGORY}' and module_type = '{_TYPE}'", _EXACT_SQL, "doc_id, file_id", _FIRST))
def search_exact_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first such lines in modules of a category and type."""
    return search.first_lines(_modules(spark, sf_dir), search.exact(WORD), _IDS, category=_CATEGORY, module_type=_TYPE)


@query(search.lines_sql(_MODULES, _REGEX_SQL, "doc_id, file_id", _FIRST))
def search_regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines in which an RE2 pattern is found."""
    return search.first_lines(_modules(spark, sf_dir), search.pattern(spark, REGEX), _IDS)


@query(search.lines_sql(_MODULES, _REGEX_SQL, "doc_id, file_id", _LINE_TOTAL))
def search_regex_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of such lines."""
    return search.line_total(_modules(spark, sf_dir), search.pattern(spark, REGEX), _IDS)


@query(search.lines_sql("select doc_id, text as content from documents", "regexp_matches(x, '(?i)ошибк\\w*$|[[:digit:]]{3,}')", "doc_id", _LINE_TOTAL))
def search_document_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the corpus in which a pattern is found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return search.line_total(docs, search.pattern(spark, r"(?i)ошибк\w*$|[[:digit:]]{3,}"), ["doc_id"])


# --- search by relevance


@query(search.ranked_sql(WORDS))
def search_smart_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a query."""
    return search.ranked(table(spark, sf_dir, "documents"), WORDS)


@query(search.smart_sql(_MODULES, CODE, "file_id"))
def search_smart_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best modules for a query with synonyms, with their best lines."""
    return search.smart_hits(_modules(spark, sf_dir), CODE, ["file_id"])


@query(search.smart_sql(_MODULES, CODE, "file_id", f"category = '{_CATEGORY}'"))
def search_smart_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best modules of a category; statistics are those of all modules."""
    return search.smart_hits(_modules(spark, sf_dir), CODE, ["file_id"], category=_CATEGORY)


@query(search.smart_sql(_MODULES, "КонецЕсли. endif;", "file_id"))
def search_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose parts stand in no line as they are: hits keep line 0 or that of a synonym."""
    return search.smart_hits(_modules(spark, sf_dir), "КонецЕсли. endif;", ["file_id"])


@query(search.ranked_sql(CODE, source=_MODULES, synonyms=catalog.SYNONYMS, ids="file_id", content="content", last="select count(*) as total, 'modules' as unit from score"))
def search_smart_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of modules with any of the terms."""
    return search.smart_total(_modules(spark, sf_dir), CODE, ["file_id"])


_SYNONYM_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(catalog.SYNONYMS.items()))
_POSTINGS = r"""
    with synonym(term, partner) as (values {rows}),
    word as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as term from documents where text is not null),
    emitted as (select doc_id, term from word union all select doc_id, partner from word join synonym using (term)),
    posting as (select term, doc_id, count(*) as tf from emitted group by all)
""".format(rows=_SYNONYM_ROWS)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text", catalog.SYNONYMS)


@query(f"select * from (values {_SYNONYM_ROWS}) t(term, partner)")
def synonym_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their partners in the other language."""
    return catalog.synonym_table(spark)


@query(_POSTINGS + "select term, sum(tf)::bigint as n from posting where term in (select term from synonym) group by all")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words with synonyms are emitted."""
    return _postings(spark, sf_dir).join(F.broadcast(catalog.synonym_table(spark).select("term")), "term").groupBy("term").agg(F.sum("tf").alias("n"))


@query(_POSTINGS + "select * from posting")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the corpus."""
    return _postings(spark, sf_dir)


@query(_POSTINGS + "select term, count(*) as df, sum(tf)::bigint as cf from posting group by all")
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of all terms."""
    return search.document_frequency(_postings(spark, sf_dir))


@query(_POSTINGS + "select doc_id, count(*) as terms from posting where term in ('регистр', 'document', 'проведение', 'если', 'if') group by all")
def postings_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any term of a query, by the index."""
    return search.matched(_postings(spark, sf_dir), WORDS + " Если", catalog.SYNONYMS)


@query(_POSTINGS.replace("from documents where text is not null", f"from (select distinct file_id as doc_id, content as text from ({_MODULES}))") + "select * from posting")
def module_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all modules, built anew."""
    own = _modules(spark, sf_dir).select("file_id", "content").dropDuplicates(["file_id"])
    return search.postings(own, "file_id", "content", catalog.SYNONYMS)


@query(f"""
    with held as (select distinct repo, doc_id, true as held from ({_MODULES})), entry as ({modules.ENTRIES_SQL})
    select count(*) as entries, count_if(held is null)::bigint as unreadable from entry left join held using (repo, doc_id)""")
def hit_unreadable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries whose contents are not there."""
    return search.unreadable(_entries(spark, sf_dir), _modules(spark, sf_dir))


# --- keys, parts and facets


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.entries(table(spark, sf_dir, "path_entry"))


_PATHS_SQL = f"select distinct repo, rel_path, {keys.sql_forward('rel_path')} as path from manifest where lower(rel_path) like '%.bsl'"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.keyed(table(spark, sf_dir, "manifest").select("repo", "rel_path").distinct())


@query(keys.sql_slots(f"select repo, rel_path, wrap_depth, key as doc_id, key from ({keys.sql_keys(_PATHS_SQL)})").replace("exclude (parts)", "exclude (parts, key)"))
def key_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and parts of all paths of the snapshots."""
    return _paths(spark, sf_dir)


@query(f"select count_if(wrap_depth > 0)::bigint as wrapped, count(*) as paths from ({keys.sql_keys(_PATHS_SQL)})")
def wrapped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below further folders."""
    return modules.wrapped(_paths(spark, sf_dir))


@query(f"""
    with k as ({keys.sql_keys(_PATHS_SQL)}), n as (select repo, key, count(*) as n from k group by all having count(*) > 1)
    select repo, sum(n - 1)::bigint as lost, count(*) as shared_keys, array_to_string(list_sort(list(key))[:5], '|') as sample from n group by all""")
def collapsed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that several paths of a repo have."""
    return modules.collapsed(_paths(spark, sf_dir))


@query(modules.ENTRIES_SQL)
def key_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of all keys of the index."""
    return _entries(spark, sf_dir)


@query(f"select distinct entry_id, {keys.sql_composed('doc_id')} as composed, doc_id != {keys.sql_composed('doc_id')} as changed from path_entry where doc_id is not null")
def nfc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with their four letters composed."""
    whole = keys.composed(F.col("doc_id"))
    return table(spark, sf_dir, "path_entry").where("doc_id is not null").select("entry_id", whole.alias("composed"), (F.col("doc_id") != whole).alias("changed")).distinct()


_SHORT_SQL = "split_part(object, '.', -1)"


@query(f"select distinct object, {subsystems.reference_sql('object')} as canonical, {_SHORT_SQL} as short_name, case when contains(object, '.') then split_part(object, '.', 1) else '' end as kind from membership where object is not null")
def kind_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with their kind in Russian, their short names and kinds."""
    o = F.col("object")
    return table(spark, sf_dir, "membership").where("object is not null").select(o, keys.canonical_reference(o).alias("canonical"), keys.short_name(o).alias("short_name"), keys.kind_prefix(o).alias("kind")).distinct()


@query(f"with entry as ({modules.ENTRIES_SQL}) select namespace, category, count(*) as entries, count(distinct object_name) as objects, count(distinct module_type) as module_types from entry group by all")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each namespace and category."""
    return modules.facet_counts(_entries(spark, sf_dir))


@query(f"select distinct category from ({modules.ENTRIES_SQL})")
def facet_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All categories."""
    return modules.facet(_entries(spark, sf_dir), "category")


@query(f"select distinct object_name from ({modules.ENTRIES_SQL}) where category = '{_CATEGORY}'")
def facet_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a category."""
    return modules.facet(_entries(spark, sf_dir), "object_name", category=_CATEGORY)


@query(f"select distinct module_type from ({modules.ENTRIES_SQL}) where category = '{_CATEGORY}'")
def facet_module_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module types of a category."""
    return modules.facet(_entries(spark, sf_dir), "module_type", category=_CATEGORY)


@query(f"select * from ({modules.ENTRIES_SQL}) where namespace = 'ext' and category = '{_CATEGORY}'")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of extensions in a category."""
    return modules.narrowed(_entries(spark, sf_dir), namespace="ext", category=_CATEGORY)


@query(f"with e as ({modules.ENTRIES_SQL}) select * from e where category = '{_CATEGORY}' and entry_id in (select entry_id from e where module_type = '{_TYPE}')")
def filter_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intersection of two lists of entries."""
    own = _entries(spark, sf_dir)
    return modules.smaller_first(modules.narrowed(own, category=_CATEGORY), modules.narrowed(own, module_type=_TYPE).select("entry_id"), "entry_id")


@query(f"select count(*) as modules, count(distinct (repo, doc_id)) as slots from ({modules.ENTRIES_SQL})")
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries and distinct keys."""
    return modules.counts(_entries(spark, sf_dir))


@query()
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each of eight shards."""
    return _entries(spark, sf_dir).groupBy(keys.shard(F.col("doc_id"), 8).alias("shard")).agg(F.count("*").alias("entries"))


_TREE_SQL = f"""
    with live as (select distinct repo, {subsystems.reference_sql('object')} as object from universe where object is not null and deleted_at is null),
    named as (select repo, object, coalesce({kinds.sql_map(kinds.TREE_OF)}[split_part(object, '.', 1)], split_part(object, '.', 1)) as category from live where object != '' and not ends_with(object, '{kinds.NOISE[0]}') and not ends_with(object, '{kinds.NOISE[1]}')),
    tree as (select repo, category, coalesce(nullif(list_position({kinds.sql_list(kinds.TREE)}, category), 0), {len(kinds.TREE) + 1})::int as ord, coalesce({kinds.sql_map(kinds.TREE_TITLES)}[category], category) as title, {_SHORT_SQL} as name from named)
"""


@query(_TREE_SQL + "select * from tree")
def metadata_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Living objects by category of the tree."""
    return modules.metadata_tree(table(spark, sf_dir, "universe"))


@query(_TREE_SQL + "select * from tree where category = 'Документы'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of one category; an unknown one is empty."""
    return modules.metadata_tree(table(spark, sf_dir, "universe")).where(F.col("category") == "Документы")


@query(_TREE_SQL + f"select category, ord, title, count(*) as objects, ord <= {len(kinds.TREE)} as known from tree group by all")
def metadata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each category."""
    return modules.metadata_summary(table(spark, sf_dir, "universe"))


@query(f"select distinct object, ends_with(object, '{kinds.NOISE[0]}') or ends_with(object, '{kinds.NOISE[1]}') as noise from universe where object is not null")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and whether they are generated ones."""
    return table(spark, sf_dir, "universe").where("object is not null").select("object", keys.is_noise(F.col("object")).alias("noise")).distinct()


@query("select * from (values " + ", ".join(f"({n}, '{g}', '{ru}', '{en}', {repr(s) if s and chr(39) not in s else 'null' if not s else chr(39) + s.replace(chr(39), chr(39) * 2) + chr(39)})" for n, (g, ru, en, s) in enumerate(catalog.FUNCTIONS, 1)) + ") t(no, function_group, name_ru, name_en, spark_equivalent)")
def function_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of the library."""
    return catalog.function_table(spark)


@query("select * from (values " + ", ".join(f"({n}, '{ru}')" for n, (g, ru, en, s) in enumerate(catalog.FUNCTIONS, 1) if "стр" in ru.lower() or "стр" in en.lower()) + ") t(no, name_ru)")
def function_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with a text in their name."""
    return catalog.function_help(spark, "Стр").select("no", "name_ru")


# --- subsystems


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "membership")


@query(subsystems.sql("select * from held"))
def membership_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object with its subsystems and their roots."""
    return subsystems.memberships(_membership(spark, sf_dir))


@query(subsystems.sql("select * from ref"))
def distinct_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (name, root) of each object."""
    return subsystems.refs(_membership(spark, sf_dir))


@query(subsystems.ORPHANS_SQL)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in no subsystem."""
    return subsystems.orphans(table(spark, sf_dir, "universe"), _membership(spark, sf_dir))


@query(subsystems.sql(f"""
    , orphan as (select repo, count(*) as orphans from ({subsystems.ORPHANS_SQL}) group by all), n as (select repo, count(*) as objects from alive group by all),
    r as (select repo from membership union select repo from universe), c as (select repo, coalesce(objects, 0) as objects, coalesce(orphans, 0) as orphans from r left join n using (repo) left join orphan using (repo))
    select *, case when objects = 0 then 'unavailable' when orphans = 0 then 'covered' else 'orphans' end as status from c"""))
def orphan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and orphans of each repo, and whether its universe is there."""
    return subsystems.orphan_status(table(spark, sf_dir, "universe"), _membership(spark, sf_dir))


#: Objects to look for: by whole name, and by short name with a type.
WHOLE, SHORT, TYPE = "справочник.журналлимитовxml", "ЖурналЛимитовXML", "Catalog"
_HITS_SQL = """
    , h as (select *, lower(object) = '{q}' as whole, ({typed}) as typed from ref where lower(object) = '{q}' or lower(split_part(object, '.', -1)) = '{q}'),
    w as (select *, bool_or(whole) over (partition by repo) as any_whole, bool_or(not whole and typed) over (partition by repo) as any_typed from h),
    hit as (select repo, object, name, root from w where case when any_whole then whole else not any_typed or typed end)
"""


def _containing_sql(name: str, object_type: str, last: str) -> str:
    russian = {k.lower(): v.lower() for k, v in kinds.APPLIED.items()}.get(object_type.lower(), "")
    typed = f"lower(split_part(object, '.', 1)) in ('{object_type.lower()}', '{russian}')" if object_type else "false"
    return subsystems.sql(_HITS_SQL.format(q=name.lower(), typed=typed) + last)


@query(_containing_sql(WHOLE, "", "select * from hit"))
def containing_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsystems that hold an object, by its whole name."""
    return subsystems.containing(_membership(spark, sf_dir), WHOLE)


@query(_containing_sql(SHORT, TYPE, "select * from hit"))
def containing_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a short name and a type."""
    return subsystems.containing(_membership(spark, sf_dir), SHORT, TYPE)


@query(_containing_sql(SHORT, "", "select count(distinct (repo, object)) as objects, count(*) as total from hit"))
def containing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects and subsystems that are."""
    return subsystems.containing_total(_membership(spark, sf_dir), SHORT)


@query(subsystems.sql(subsystems.INTERSECTIONS_SQL))
def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in several subsystems."""
    return subsystems.intersections(_membership(spark, sf_dir))


@query(subsystems.sql(subsystems.INTERSECTIONS_SQL + " and count(distinct root) >= 2"))
def intersections_cross_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in several branches."""
    return subsystems.intersections(_membership(spark, sf_dir), cross_branch=True)


@query(subsystems.sql(f", i as ({subsystems.INTERSECTIONS_SQL}) select repo, object, row_number() over (partition by repo, object order by name, root, path)::int as ref_no, name, root from ref semi join i using (repo, object)"))
def intersection_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subsystems of objects in several ones, in order."""
    return subsystems.intersection_refs(_membership(spark, sf_dir))


@query(subsystems.sql(f"select distinct repo, split_part(object, '.', 1) as kind from held where list_contains({kinds.sql_list(kinds.UNIVERSE.values())}, split_part(object, '.', 1)) and (repo, split_part(object, '.', 1)) not in (select (repo, split_part(object, '.', 1)) from alive)"))
def coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that are referred to and have no object."""
    return subsystems.coverage_warnings(_membership(spark, sf_dir), table(spark, sf_dir, "universe"))


_NODES = "select distinct repo, path, parent_path, name from subsystem where path is not null"


@query(f"with n as (select distinct repo, split_part(path, '.', -1) as name, path from ({_NODES})) select *, count(*) over (partition by repo, name) as namesakes from n qualify namesakes > 1")
def ambiguous_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose short name others bear."""
    return subsystems.ambiguous_names(table(spark, sf_dir, "subsystem"))


@query("select distinct repo, path from subsystem where split_part(path, '.', -1) = 'НаймСевер'")
def resolve_subsystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that a short name can mean."""
    return subsystems.resolve(table(spark, sf_dir, "subsystem"), "НаймСевер")


@query(f"with n as (select distinct repo, path, parent_path from ({_NODES})) select n.repo, n.path, len(string_split(n.path, '.'))::int - 2 as depth, (p.path is not null)::int as parents from n left join (select distinct repo, path from n) p on p.repo = n.repo and p.path = n.parent_path")
def subsystem_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their level."""
    return subsystems.tree(table(spark, sf_dir, "subsystem"))


@query(f"""
    with recursive n as ({_NODES}), walk as (
        select repo, path, name as root, 0 as level from n where parent_path is null
        union all select n.repo, n.path, w.root, w.level + 1 from walk w join n on n.repo = w.repo and n.parent_path = w.path)
    select distinct * from walk""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached from the roots."""
    return subsystems.flattened(table(spark, sf_dir, "subsystem"))


# --- snapshots and changes

_ENDS_SQL = """
    with file as (select repo, gen, rel_path, mtime_ms, size, doc_id from manifest
        qualify row_number() over (partition by repo, gen, rel_path order by loaded_at desc nulls last, mtime_ms desc nulls last, size desc nulls last, doc_id desc nulls last) = 1),
    g as (select repo, gen, min(gen_at) as gen_at from manifest group by all), e as (select repo, arg_min(gen, (gen_at, gen)) as a, arg_max(gen, (gen_at, gen)) as b from g group by all having count(*) > 1),
    old as (select f.* from file f join e on e.repo = f.repo and e.a = f.gen), new as (select f.* from file f join e on e.repo = f.repo and e.b = f.gen),
    diff as (select coalesce(o.repo, n.repo) as repo, coalesce(o.rel_path, n.rel_path) as rel_path,
             case when o.repo is null then 'added' when n.repo is null then 'deleted' when o.mtime_ms is distinct from n.mtime_ms or o.size is distinct from n.size then 'modified' end as change
             from old o full join new n on o.repo = n.repo and o.rel_path = n.rel_path)
"""


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    manifest = table(spark, sf_dir, "manifest")
    files = upserts.latest_files(manifest).join(F.broadcast(upserts.ends(manifest)), ["repo", "gen"])  # two rows a repo
    return files.where("not newest").drop("newest"), files.where("newest").drop("newest")


@query(_ENDS_SQL + "select * from diff where change is not null")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files changed between the first and the last snapshot of each repo."""
    old, new = _ends(spark, sf_dir)
    return upserts.file_diff(old, new, ["repo", "rel_path"], ["mtime_ms", "size"])


def _manifest_kind(change: str, text_: str) -> None:
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return manifest_diff(spark, sf_dir).where(F.col("change") == change).select("repo", "rel_path")

    found.__name__, found.__doc__ = f"manifest_{change}", text_
    query(_ENDS_SQL + f"select repo, rel_path from diff where change = '{change}'")(found)


_manifest_kind("added", "Files that are new.")
_manifest_kind("modified", "Files with another time or size.")
_manifest_kind("deleted", "Files that are gone.")


@query(_ENDS_SQL + """, c as (select count_if(change = 'added')::bigint as added, count_if(change = 'modified')::bigint as modified, count_if(change = 'deleted')::bigint as deleted from diff)
    select (select count(*) from old) as before, (select count(*) from new) as after, c.*, added + modified + deleted > 0 as changed, true as accepted from c""")
def reload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reload from the first to the last snapshots does."""
    old, new = _ends(spark, sf_dir)
    return upserts.reload_report(old, new, ["repo", "rel_path"], ["mtime_ms", "size"])


@query(upserts.signatures_sql())
def generation_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content signature of each snapshot."""
    return upserts.signatures(table(spark, sf_dir, "manifest"))


_SIZES = "select distinct doc_id, source, n_chars from documents"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").distinct()


@query(f"with d as ({_SIZES}) select * from d where source is distinct from 'ticket' union all select doc_id, source, n_chars + 1 from d where source = 'ticket'")
def upsert_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after those of one source were delivered anew."""
    own = _sizes(spark, sf_dir)
    return upserts.upsert(own, own.where("source = 'ticket'").withColumn("n_chars", F.col("n_chars") + 1), ["doc_id"])


@query(f"select * from ({_SIZES}) where source is distinct from 'ticket'")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those of one source."""
    own = _sizes(spark, sf_dir)
    return upserts.delete(own, own.where("source = 'ticket'"), ["doc_id"])


@query(f"with d as ({_SIZES}) select *, 'base' as origin from d where source is distinct from 'ticket' union all select *, 'overlay' from d where source = 'ticket'")
def union_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base and an overlay behind one name."""
    own = _sizes(spark, sf_dir)
    return upserts.overlay(own, own.where("source = 'ticket'"), ["doc_id"])


@query(_ENDS_SQL + ", touched as (select repo, rel_path from diff where change is not null) select repo, rel_path, mtime_ms, size from new")
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshots after all changes up to the last ones: these themselves."""
    old, new = (df.select("repo", "rel_path", "mtime_ms", "size") for df in _ends(spark, sf_dir))
    changes = upserts.file_diff(old, new, ["repo", "rel_path"], ["mtime_ms", "size"]).join(new, ["repo", "rel_path"], "left")
    return upserts.apply_changes(old, changes, ["repo", "rel_path"])


@query("select distinct repo, object, min(form_name) over (partition by repo, object) as form_name, count(distinct form_name) over (partition by repo, object) - 1 as others from form_info where form_name is not null")
def first_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first form of each object by name, and how many others there are."""
    own = table(spark, sf_dir, "form_info").where("form_name is not null")
    return own.groupBy("repo", "object").agg(F.min("form_name").alias("form_name"), (F.count_distinct("form_name") - 1).alias("others"))


@query(forms.sql(f"select {forms.element_type('e')} as type, coalesce({kinds.sql_map(DISPLAY)}[{forms.element_type('e')}], {forms.element_type('e')}) as display, count(*) as elements from element group by all"))
def form_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of forms by what their type is called."""
    return forms.elements(table(spark, sf_dir, "form_info")).groupBy("type", display_type(F.col("type")).alias("display")).agg(F.count("*").alias("elements"))


# --- event log

_NOW = dt.datetime(2024, 1, 20, 12)
_START, _END = "2024-01-03", "2024-01-10"
_EVENTS = f"ts >= timestamp '{_START}' and ts < timestamp '2024-01-11'"


def _plain(df: DataFrame) -> DataFrame:
    """Exact sums as plain numbers."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(f"select * from events where {_EVENTS} and event_type = 'error'")
def eventlog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events between two days, of a level."""
    return eventlog.filtered(_events(spark, sf_dir), _START, _END, level="error")


@query(f"select *, (select count(*) from events where {_EVENTS}) as total from events where {_EVENTS} order by ts, event_id limit 50")
def eventlog_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of events with the number of all."""
    return eventlog.page_with_total(eventlog.filtered(_events(spark, sf_dir), _START, _END))


@query("select count(*) as total, 'events' as unit from events where ts >= timestamp '2024-01-13 12:00:00'")
def eventlog_default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last seven days before a moment."""
    return eventlog.total(eventlog.filtered(_events(spark, sf_dir), now=_NOW))


@query("select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as events, round(sum(value), 2) as value from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return eventlog.per_window(_events(spark, sf_dir), "1 hour")


@query("""with s as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as window_start, event_type, value from events)
    select window_start, window_start + interval '1 hour' as window_end, event_type, count(*) as events, round(sum(value), 2) as value from s group by all""")
def event_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by sliding hours and type."""
    return eventlog.per_window(_events(spark, sf_dir), "1 hour", "30 minutes")


@query("""with m as (select *, coalesce(ts >= lag(ts) over w + interval '30 minutes', true)::int as fresh from events window w as (partition by user_id order by ts, event_id)),
    n as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from m)
    select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as events from n group by user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users."""
    return eventlog.sessions(_events(spark, sf_dir))


# --- queries and registers

_TABLES = {"Документ.Заказ": "orders", "Справочник.Клиент": "customer"}
RUSSIAN = """ВЫБРАТЬ К.c_mktsegment КАК segment, КОЛИЧЕСТВО(*) КАК orders, МАКСИМУМ(З.o_orderdate) КАК last_date // по "сегментам"
    ИЗ Документ.Заказ КАК З ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Клиент КАК К ПО З.o_custkey = К.c_custkey
    ГДЕ З.o_orderdate >= &Начало И НЕ З.o_orderstatus = "F" СГРУППИРОВАТЬ ПО К.c_mktsegment ИМЕЮЩИЕ КОЛИЧЕСТВО(*) > &Мало"""


@query("select c_mktsegment as segment, count(*) as orders, max(o_orderdate) as last_date from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '1996-01-01' and o_orderstatus != 'F' group by all having count(*) > 5")
def query_with_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in Russian keywords with named parameters."""
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return sqlfront.prepared(spark, RUSSIAN, {"Начало": "1996-01-01", "Мало": 5}, _TABLES)


@query("select o_orderkey, o_totalprice, true as truncated from orders order by o_orderkey limit 100")
def query_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a query and whether there are more."""
    return sqlfront.truncated(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query("select * from (values ('ВЫБРАТЬ 1 КАК х', true), ('SELECT 1 +', false), ('DROP TABLE x', false), ('SELECTX 1', false), ('select * from nowhere_at_all', false), ('ВЫБРАТЬ ПЕРВЫЕ 5 n_name ИЗ nation ГДЕ n_nationkey > &Ключ', true)) t(query, valid)")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and whether they are queries."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    texts = ["ВЫБРАТЬ 1 КАК х", "SELECT 1 +", "DROP TABLE x", "SELECTX 1", "select * from nowhere_at_all", "ВЫБРАТЬ ПЕРВЫЕ 5 n_name ИЗ nation ГДЕ n_nationkey > &Ключ"]
    return spark.createDataFrame([(t, sqlfront.validate(spark, t)[0]) for t in texts], "query string, valid boolean")


STOCK = registers.Accumulation("l_shipdate", ("l_partkey", "l_suppkey"), "l_quantity", "l_returnflag <=> 'R'")
BY_PART = registers.Accumulation("l_shipdate", ("l_partkey",), "l_quantity", "l_returnflag <=> 'R'")
_AT, _FROM, _TO = "1998-06-30 00:00:00", "1997-01-01 00:00:00", "1997-12-31 23:59:59"
_MOVES = """with m as (select l_partkey, l_suppkey, l_shipdate as period, case when l_returnflag = 'R' then 0 else l_quantity end::decimal(18,4) as receipt,
    case when l_returnflag = 'R' then l_quantity else 0 end::decimal(18,4) as expense from lineitem where l_shipdate is not null and l_quantity is not null)"""


@query(f"{_MOVES} select l_partkey, l_suppkey, sum(receipt - expense)::double as balance from m where period <= timestamp '{_AT}' group by all having sum(receipt - expense) != 0")
def register_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of parts and suppliers at a moment."""
    return _plain(registers.balance(table(spark, sf_dir, "lineitem"), STOCK, _AT))


@query(f"{_MOVES} select l_partkey, l_suppkey, date_trunc('month', period)::timestamp as period, sum(receipt)::double as receipt, sum(expense)::double as expense, sum(receipt - expense)::double as turnover from m where period between timestamp '{_FROM}' and timestamp '{_TO}' group by all")
def register_turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnovers by month."""
    return _plain(registers.turnovers(table(spark, sf_dir, "lineitem"), STOCK, _FROM, _TO))


_BALANCES = f"""{_MOVES}, g as (select l_partkey, case when period >= timestamp '{_FROM}' then date_trunc('quarter', period)::timestamp end as period, sum(receipt) as receipt, sum(expense) as expense from m where period <= timestamp '{_TO}' group by all)"""
_RUNNING = """, r as (select *, receipt - expense as turnover, sum(receipt - expense) over (partition by l_partkey order by period nulls first) as closing from {g})
    select l_partkey, period, (closing - turnover)::double as opening, receipt::double as receipt, expense::double as expense, turnover::double as turnover, closing::double as closing from r where period is not null"""


@query(_BALANCES + _RUNNING.format(g="g"))
def register_balance_and_turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening balances, turnovers and closing balances by quarter."""
    return _plain(registers.balance_and_turnovers(table(spark, sf_dir, "lineitem"), BY_PART, _FROM, _TO, "quarter"))


@query(_BALANCES + """, f as (select l_partkey, period, sum(receipt) as receipt, sum(expense) as expense from (select * from g union all
    select l_partkey, unnest(generate_series(timestamp '1997-01-01', timestamp '1997-10-01', interval '3 months')), 0, 0 from (select distinct l_partkey from g)) group by all)""" + _RUNNING.format(g="f"))
def register_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with quarters without movements."""
    return _plain(registers.balance_and_turnovers(table(spark, sf_dir, "lineitem"), BY_PART, _FROM, _TO, "quarter", fill=True))


@query("select user_id, ts, event_id, event_type, value from events where ts <= timestamp '2024-01-15' and ts is not null qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def slice_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user up to a moment."""
    return registers.slice_last(_events(spark, sf_dir), "ts", ["user_id"], ["event_id"], ["event_type", "value"], "2024-01-15")


@query("select user_id, ts, event_id, event_type, value from events where ts >= timestamp '2024-01-15' qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def slice_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user from a moment on."""
    return registers.slice_first(_events(spark, sf_dir), "ts", ["user_id"], ["event_id"], ["event_type", "value"], "2024-01-15")


@query("select o_custkey, o_orderdate, o_orderkey, o_orderstatus from orders where o_orderdate is not null qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def slice_last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer."""
    return registers.slice_last(table(spark, sf_dir, "orders"), "o_orderdate", ["o_custkey"], ["o_orderkey"], ["o_orderstatus"])


# --- scalar functions


@query("select event_id, case when value is null then '' when value = floor(value) then value::bigint::varchar else value::varchar end as cell, coalesce(event_type, '') as kind, try_cast(json_extract(props, '$.k') as int) as k from events")
def render_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as a table shows them, and a field of their JSON."""
    return _events(spark, sf_dir).select("event_id", render.cell(F.col("value")).alias("cell"), F.coalesce("event_type", F.lit("")).alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select distinct repo, gen, sha256(concat_ws('/', repo, gen))[1:16] as path_hash, to_base64(repo::blob) as encoded from manifest")
def path_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of folders and texts in base 64."""
    own = table(spark, sf_dir, "manifest").select("repo", "gen").distinct()
    return own.select("repo", "gen", F.substring(F.sha2(F.concat_ws("/", "repo", "gen"), 256), 1, 16).alias("path_hash"), F.base64(F.encode("repo", "UTF-8")).alias("encoded"))


@query("select distinct file_id, replace(rel_path, '|', '\\|') as escaped, json_valid(content) as is_json from source_file where lower(rel_path) like '%.json' and content is not null")
def json_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files and whether they are JSON, leaving byte order marks to the reader."""
    own = table(spark, sf_dir, "source_file").where("lower(rel_path) like '%.json' and content is not null")
    return own.select("file_id", text.escape_pipe(F.col("rel_path")).alias("escaped"), F.expr("try_parse_json(content) is not null").alias("is_json")).distinct()
