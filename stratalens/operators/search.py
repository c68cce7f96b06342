"""Full-text search: by lines (exact and by pattern) and by relevance (published BM25).

Lines are searched inside arrays, and only lines that match become rows.
Relevance uses statistics of the whole corpus; every top-k has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import catalog, text
from stratalens.operators.modules import narrowed
from stratalens.session import materialize

K1, B = 1.2, 0.75
DEFAULT_LIMIT, MOST_LIMIT = 50, 500


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact(query: str) -> Callable[[Column], Column]:
    """Lines with ``query`` in them, in any case."""
    return lambda line: F.contains(F.lower(line), F.lit(query.lower()))


def pattern(spark, regex: str) -> Callable[[Column], Column]:
    """Lines that an RE2 pattern finds itself in."""
    java = text.checked_pattern(spark, regex)
    return lambda line: line.rlike(java)


# --- by lines


def line_hits(modules: DataFrame, match: Callable[[Column], Column], ids: list[str], **within: str) -> DataFrame:
    """(ids, line_no, line, context) of all matching lines.

    Defined results: null contents have no lines, an empty one has one; a
    repeated row counts once. ``match`` is any condition on a line.
    """

    def found(all_lines: Column) -> Column:
        numbers = F.filter(F.transform(all_lines, lambda line, i: F.when(match(line), i + 1)), lambda n: n.isNotNull())
        return F.transform(numbers, lambda n: F.struct(n.alias("line_no"), F.get(all_lines, n - 1).alias("line"), text.context(all_lines, n).alias("context")))

    return narrowed(modules, **within).where("content is not null").select(*ids, F.inline(_let(text.lines(F.col("content")), found))).distinct()


def first_lines(modules: DataFrame, match: Callable[[Column], Column], ids: list[str], limit: int | None = None, **within: str) -> DataFrame:
    """The first of them, by ids and line."""
    return line_hits(modules, match, ids, **within).orderBy(*ids, "line_no").limit(text.clamp_limit(limit, DEFAULT_LIMIT, MOST_LIMIT))


def line_total(modules: DataFrame, match: Callable[[Column], Column], ids: list[str], **within: str) -> DataFrame:
    """All matching lines before any limit: (total, unit)."""
    count = lambda all_lines: F.size(F.filter(all_lines, match))
    per = narrowed(modules, **within).where("content is not null").select(*ids, _let(text.lines(F.col("content")), count).alias("n")).distinct()
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total")).withColumn("unit", F.lit("lines"))


# --- by relevance


def terms(query: str, synonyms: dict[str, str] | None = None) -> list[list[str]]:
    """What the query looks for: each distinct word, and its synonym; with each the words that count as it."""
    synonyms = synonyms or {}
    own = dict.fromkeys(x for w in text.query_words(query) for x in (w, synonyms.get(w)) if x)
    return [sorted({t, synonyms.get(t, t)}) for t in sorted(own)]


def counted(df: DataFrame, ids: list[str], content: str, wanted: list[list[str]], synonyms: dict[str, str] | None = None) -> DataFrame:
    """(ids, length, tf0, tf1, ...) of each text; a word with a synonym counts for two."""
    both = (lambda w: F.size(w) + F.size(F.filter(w, lambda x: x.isin(*synonyms)))) if synonyms else F.size
    counts = lambda words: F.struct(both(words).alias("length"), *[F.size(F.filter(words, _one_of(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    return df.where(F.col(content).isNotNull()).select(*ids, _let(text.words(F.col(content)), counts).alias("c")).select(*ids, "c.*").distinct()


def _one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def scored(df: DataFrame, ids: list[str], content: str, query: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(ids, score) of all texts with any of the terms.

    Defined results: null texts are no documents; words repeated in the query
    count once; a query without words finds nothing; scores have six digits.
    Texts are cut into words once: their counts are written, a few numbers a text.
    """
    wanted = terms(query, synonyms)
    if not wanted:
        return df.where("false").select(*ids, F.lit(0.0).alias("score"))
    table = materialize(counted(df, ids, content, wanted, synonyms), "term_counts")
    names = [f"tf{i}" for i in range(len(wanted))]
    # one row with the statistics of the corpus, from the written counts
    n, mean, *held = table.agg(F.count("*"), F.avg("length"), *[F.count_if(F.col(c) > 0) for c in names]).first()
    score = F.lit(0.0)
    for c, df in zip(names, held):
        idf = F.log1p(F.lit((n - df + 0.5) / (df + 0.5)))
        score = score + idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return table.where(" or ".join(f"{c} > 0" for c in names)).select(*ids, F.round(score, 6).alias("score"))


def ranked(documents: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(doc_id, score) of the best documents: score descending, then doc_id."""
    return scored(documents, ["doc_id"], "text", query).orderBy(F.desc("score"), "doc_id").limit(text.clamp_limit(limit, DEFAULT_LIMIT, MOST_LIMIT))


def _best_line(all_lines: Column, query: str, synonyms: dict[str, str]) -> Column:
    """(line, context, lines_matched) of a hit.

    The first line with the most parts of the query, repeated ones counting
    again; without any, the first line with a part's synonym; else line 0.
    """
    parts = text.blank_parted(query)
    wider = [x for p in parts for x in (p, synonyms.get(p)) if x]
    holds = lambda line, words: [F.contains(F.lower(line), F.lit(w)) for w in words]

    def number(line: Column) -> Column:
        total = F.lit(0)
        for has in holds(line, parts):
            total = total + has.cast("int")
        return total

    def any_of(line: Column) -> Column:
        found = F.lit(False)
        for has in holds(line, wider):
            found = found | has
        return found.cast("int")

    def placed(scores: Column) -> Column:
        best = F.array_max(scores)
        return F.struct(F.when(best > 0, F.array_position(scores, best)).otherwise(0).cast("int").alias("line"), F.size(F.filter(scores, lambda s: s > 0)).alias("lines_matched"))

    own = _let(F.transform(all_lines, number), placed)
    other = _let(F.transform(all_lines, any_of), placed) if len(wider) > len(parts) else own
    return _let(own, lambda o: F.when(o["line"] > 0, o).otherwise(other))


def smart_hits(modules: DataFrame, query: str, ids: list[str], limit: int | None = None, **within: str) -> DataFrame:
    """(ids, score, line, context, lines_matched) of the best modules, with synonyms.

    Contents are joined to the top-k alone. A hit without line keeps line 0 and an empty context.
    """
    found = scored(modules, ids, "content", query, catalog.SYNONYMS)
    if any(within.values()):
        found = found.join(narrowed(modules, **within).select(*ids).distinct(), ids, "left_semi")
    top = found.orderBy(F.desc("score"), *ids).limit(text.clamp_limit(limit, DEFAULT_LIMIT, MOST_LIMIT))
    held = modules.join(F.broadcast(top), ids).dropDuplicates(ids)  # MOST_LIMIT rows at most

    def described(all_lines: Column) -> Column:
        shown = lambda b: F.struct(b["line"].alias("line"), F.when(b["line"] > 0, text.context(all_lines, b["line"])).otherwise("").alias("context"), b["lines_matched"].alias("lines_matched"))
        return _let(_best_line(all_lines, query, catalog.SYNONYMS), shown)

    return held.withColumn("b", _let(text.lines(F.col("content")), described)).select(*ids, "score", "b.*").orderBy(F.desc("score"), *ids)


def smart_total(modules: DataFrame, query: str, ids: list[str], **within: str) -> DataFrame:
    """All modules with any of the terms: (total, unit)."""
    wanted = sorted({w for group in terms(query, catalog.SYNONYMS) for w in group})
    words = text.words(F.col("content"))
    hits = narrowed(modules, **within).where("content is not null").where(F.exists(words, _one_of(wanted)) if wanted else F.lit(False))
    return hits.select(*ids).distinct().agg(F.count("*").alias("total")).withColumn("unit", F.lit("modules"))


# --- the index as a table


def postings(df: DataFrame, doc_id: str, content: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(term, doc_id, tf); every word also stands for its synonym."""
    found = df.where(F.col(content).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(text.words(F.col(content))).alias("term"))
    if synonyms:
        pairs = F.broadcast(catalog.synonym_table(df.sparkSession))  # the fixed table
        found = found.join(pairs, "term", "left").select("doc_id", F.explode(F.array_compact(F.array("term", "partner"))).alias("term"))
    return found.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, df, cf): texts with the term, and its occurrences."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def matched(postings: DataFrame, query: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, terms): texts with any term of the query, by the index; terms is how many of them."""
    spark = postings.sparkSession
    wanted = sorted({t for group in terms(query, synonyms) for t in group})
    words = spark.createDataFrame([(w,) for w in wanted], "term string")
    return postings.join(F.broadcast(words), "term").groupBy("doc_id").agg(F.count("*").alias("terms"))


def unreadable(entries: DataFrame, modules: DataFrame) -> DataFrame:
    """Entries of an index and those whose contents are not there: (entries, unreadable)."""
    held = modules.select("repo", "doc_id").distinct().withColumn("held", F.lit(True))
    return entries.join(held, ["repo", "doc_id"], "left").agg(F.count("*").alias("entries"), F.count_if(F.col("held").isNull()).alias("unreadable"))


# --- the same in DuckDB's SQL


def ranked_sql(query: str, limit: int = DEFAULT_LIMIT, source: str = "select doc_id, text from documents", synonyms: dict[str, str] | None = None, ids: str = "doc_id", content: str = "text", last: str | None = None) -> str:
    """Relevance over a relation; ``score`` is the relation of all hits."""
    wanted = ", ".join("(" + str(i) + ", [" + ", ".join(f"'{w}'" for w in group) + "])" for i, group in enumerate(terms(query, synonyms)))
    twice = f" + len(list_filter(t, lambda x: list_contains([{', '.join(repr(s) for s in sorted(synonyms))}], x)))" if synonyms else ""
    last = last if last is not None else f"select {ids}, score from score order by score desc, {ids} limit {limit}"
    return f"""
        with words(i, w) as (values {wanted}),
        tokens as (select distinct {ids}, regexp_extract_all(lower({content}), '[\\p{{L}}\\p{{N}}_]+') as t from ({source}) where {content} is not null),
        sized as (select {ids}, t, len(t){twice} as dl from tokens),
        stats as (select count(*) as n, avg(dl) as mean from sized),
        tf as (select {ids}, i, dl, len(list_filter(t, lambda x: list_contains(w, x))) as f from sized, words),
        df as (select i, count(*) as d from tf where f > 0 group by i),
        score as (select {ids}, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * dl / mean))), 6) as score
                  from tf join df using (i), stats where f > 0 group by all)
        {last}
    """


def lines_sql(source: str, condition: str, ids: str, last: str) -> str:
    """Lines of a relation's ``content`` that satisfy ``condition`` on x, as ``hit``."""
    return f"""
        with held as (select distinct {ids}, string_split(content, chr(10)) as ls from ({source}) where content is not null),
        numbered as (select {ids}, ls, unnest(ls) as x, generate_subscripts(ls, 1) as line_no from held),
        hit as (select {ids}, line_no::int as line_no, x as line, array_to_string(ls[greatest(line_no - 2, 1):line_no + 2], chr(10)) as context from numbered where {condition})
        {last}
    """


def smart_sql(source: str, query: str, ids: str, where: str = "true", limit: int = DEFAULT_LIMIT) -> str:
    """``smart_hits`` over a relation with ``content``."""
    parts = text.blank_parted(query)
    wider = [x for p in parts for x in (p, catalog.SYNONYMS.get(p)) if x]
    number = " + ".join(f"contains(lower(x), '{p}')::int" for p in parts)
    other = " or ".join(f"contains(lower(x), '{p}')" for p in wider)
    last = f"""
        , top as (select score.* from score semi join (select {ids} from ({source}) where {where}) using ({ids}) order by score desc, {ids} limit {limit}),
        held as (select distinct {ids}, string_split(content, chr(10)) as ls from ({source}) semi join top using ({ids})),
        judged as (select *, list_transform(ls, lambda x: {number}) as a, list_transform(ls, lambda x: ({other})::int) as b from held),
        chosen as (select {ids}, ls, case when list_max(a) > 0 then a else b end as s from judged),
        placed as (select {ids}, ls, case when list_max(s) > 0 then list_position(s, list_max(s)) else 0 end as line, len(list_filter(s, lambda x: x > 0)) as lines_matched from chosen)
        select {ids}, score, line::int as line, case when line > 0 then array_to_string(ls[greatest(line - 2, 1):line + 2], chr(10)) else '' end as context, lines_matched::int as lines_matched
        from top join placed using ({ids})"""
    return ranked_sql(query, source=source, synonyms=catalog.SYNONYMS, ids=ids, content="content", last="").rstrip() + last
