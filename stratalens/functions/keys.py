"""Keys of modules: from paths, and into their parts; references and names.

All are expressions of built-in functions. The shape of a path below the root of
a dump is one pattern; whatever stands before its first match is wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions import kinds

_ALTERNATIVES = lambda words: "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"
#: A segment that doesn't end the object's own part of the path.
_SEGMENT = "(?:[^/]{1,2}|[^/]{4,}|[^E/][^/]{2}|E[^x/][^/]|Ex[^t/])"
_OBJECT = f"{_ALTERNATIVES(kinds.FOLDERS)}/{_SEGMENT}/(?:{_ALTERNATIVES(kinds.CHILD_FOLDERS)}/{_SEGMENT}/)?Ext/(?:Form/)?{_ALTERNATIVES(kinds.MODULE_FILES)}"
_SHAPE = f"(?:{kinds.EXTENSIONS}/[^/]*/)?(?:{_OBJECT}|Ext/{_ALTERNATIVES(kinds.CONFIGURATION_FILES)})"
#: Wrapping, and the path below the root.
ROOTED = f"^((?:[^/]*/)*?)({_SHAPE})$"

# The letters that are composed in keys, as base and mark and as one character.
_COMPOSED = (("и\u0306", "\u0439"), ("И\u0306", "\u0419"), ("е\u0308", "\u0451"), ("Е\u0308", "\u0401"))


def composed(text: Column) -> Column:
    """й, Й, ё and Ё as one character each; other characters stay."""
    for apart, whole in _COMPOSED:
        text = F.replace(text, F.lit(apart), F.lit(whole))
    return text


def forward(path: Column) -> Column:
    """Forward slashes, and no leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def wrapping(path: Column) -> Column:
    """The leading segments that are no part of the dump, with their slashes; '' for none."""
    return F.coalesce(F.regexp_extract(path, ROOTED, 1), F.lit(""))


def wrap_depth(path: Column) -> Column:
    """The number of such segments."""
    return _let(wrapping(path), lambda w: F.length(w) - F.length(F.translate(w, "/", "")))


def _base(parts: Column) -> Column:
    folder, name, file = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.element_at(parts, -1)
    plain = folder.isin(*kinds.PLAIN_FOLDERS) & (file == "Module.bsl") & ~F.array_contains(parts, "Forms")
    suffix = F.when(plain, "Модуль").otherwise(F.coalesce(kinds.looked_up(kinds.MODULE_FILES, file), F.regexp_replace(file, r"\.bsl$", "")))
    places = [F.array_position(parts, child) for child in kinds.CHILD_FOLDERS]
    at = F.least(*[F.when((p > 0) & (p < F.size(parts)), p) for p in places])
    named = _let(at, lambda i: F.concat(kinds.looked_up(kinds.CHILD_FOLDERS, F.get(parts, (i - 1).cast("int"))), F.lit("."), F.get(parts, i.cast("int"))))
    key = F.concat_ws(".", F.coalesce(kinds.looked_up(kinds.FOLDERS, folder), folder), name, named, suffix)
    whole = F.concat(F.lit(f"{kinds.CONFIGURATION}."), kinds.looked_up(kinds.CONFIGURATION_FILES, file), F.lit(".Модуль"))
    return F.coalesce(F.when((F.size(parts) == 2) & (folder == "Ext"), whole), key)


def module_key(path: Column) -> Column:
    """The key of a module's path; a path of one segment is its own key, null stays null."""
    below = F.substring(path, F.length(wrapping(path)) + 1, F.length(path))

    def named(parts: Column) -> Column:
        extended = (F.get(parts, F.lit(0)) == kinds.EXTENSIONS) & (F.size(parts) >= 4)
        lead = F.when(extended, F.concat(F.lit(f"{kinds.EXTENSION}."), F.get(parts, F.lit(1)), F.lit("."))).otherwise("")
        rest = F.when(extended, F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
        return F.when(F.size(parts) >= 2, F.concat(lead, _let(rest, _base)))

    return composed(F.coalesce(_let(F.split(below, "/", -1), named), path))


def layout_key(path: Column, own: str | None, children: dict[str, str]) -> Column:
    """The key under a layout: modules in the folder of a child extension are that one's, all others ``own``'s.

    Without either the key is that of the path alone.
    """
    plain = module_key(path)
    if own:
        plain = F.concat(F.lit(f"{kinds.EXTENSION}.{own}."), plain)
    if not children:
        return plain
    first = F.substring_index(path, "/", 1)
    name = F.when(F.instr(path, "/") > 0, kinds.looked_up(children, first))
    inner = module_key(F.substring(path, F.length(first) + 2, F.length(path)))
    return F.coalesce(F.concat(F.lit(f"{kinds.EXTENSION}."), name, F.lit("."), inner), plain)


def slots(key: Column) -> Column:
    """(namespace, category, object_name, module_type) of a key.

    The namespace is ext by the prefix alone. Category and object stand behind
    an extension's name only if there are five parts and the third is a category.
    """

    def own(parts: Column) -> Column:
        extended = (F.size(parts) >= 5) & (F.get(parts, F.lit(0)) == kinds.EXTENSION) & F.get(parts, F.lit(2)).isin(*kinds.CATEGORIES)
        return F.when(extended, F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)

    def named(parts: Column) -> Column:
        count = F.size(parts)
        return F.struct(
            F.when(key.startswith(f"{kinds.EXTENSION}."), kinds.EXTENSION).otherwise("").alias("namespace"),
            F.when(count >= 2, F.get(parts, F.lit(0))).otherwise("").alias("category"),
            F.when(count >= 2, F.get(parts, F.lit(1))).otherwise(key).alias("object_name"),
            F.when(count >= 3, F.element_at(parts, -1)).otherwise("").alias("module_type"),
        )

    return _let(_let(F.split(key, r"\.", -1), own), named)


def canonical_reference(raw: Column) -> Column:
    """A reference with its kind in Russian: applied kinds by exact case, service kinds by any; '' without a dot."""
    text = composed(raw)
    kind = F.substring_index(text, ".", 1)
    rest = F.substring(text, F.length(kind) + 1, F.length(text))
    lower = {k.lower(): v for k, v in kinds.SERVICE.items()}
    name = F.when(kind.isin(*kinds.APPLIED.values()), kind).otherwise(F.coalesce(kinds.looked_up(kinds.APPLIED, kind), kinds.looked_up(lower, F.lower(kind)), kind))
    return F.when(F.instr(text, ".") == 0, "").otherwise(F.concat(name, rest))


def short_name(full: Column) -> Column:
    """Behind the last dot."""
    return F.substring_index(full, ".", -1)


def kind_prefix(full: Column) -> Column:
    """Before the first dot; '' without one."""
    return F.when(F.instr(full, ".") > 0, F.substring_index(full, ".", 1)).otherwise("")


def is_noise(name: Column) -> Column:
    """Generated objects that no report lists."""
    return name.endswith(kinds.NOISE[0]) | name.endswith(kinds.NOISE[1])


def shard(key: Column, count: int) -> Column:
    """An even spread of keys over ``count`` shards."""
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def shard_count(files: int, cores: int) -> int:
    """Shards for a number of files: one for 2000, at least one and at most one a core."""
    return max(1, min(files // 2000, cores))


#: A name that an extension may bear: letters, digits (not first), underscores, at most 128, nothing unseen.
EXTENSION_NAME = r"^[\p{L}_][\p{L}\p{Nd}_]{0,127}$"
_UNSEEN_LETTERS = "ᅟᅠㅤﾠ"


def is_extension_name(name: Column) -> Column:
    return F.coalesce(name.rlike(EXTENSION_NAME) & ~name.rlike(f"[{_UNSEEN_LETTERS}]"), F.lit(False))


# --- the same in DuckDB's SQL


def sql_composed(text: str) -> str:
    for apart, whole in _COMPOSED:
        text = f"replace({text}, '{apart}', '{whole}')"
    return text


def sql_forward(path: str) -> str:
    return f"regexp_replace(replace({path}, '\\', '/'), '^(\\./+)+', '')"


def sql_keys(source: str) -> str:
    """A query that adds ``wrap_depth`` and ``key`` to a relation with ``path``."""
    m = kinds.sql_map
    base = lambda p: f"""case when len({p}) = 2 and {p}[1] = 'Ext' and {m(kinds.CONFIGURATION_FILES)}[{p}[2]] is not null then '{kinds.CONFIGURATION}.' || {m(kinds.CONFIGURATION_FILES)}[{p}[2]] || '.Модуль'
        else concat_ws('.', coalesce({m(kinds.FOLDERS)}[{p}[1]], {p}[1]), {p}[2],
            list_filter(list_transform(range(1, len({p})), lambda i: {m(kinds.CHILD_FOLDERS)}[{p}[i]] || '.' || {p}[i + 1]), lambda x: x is not null)[1],
            case when {p}[1] in ({', '.join(f"'{f}'" for f in kinds.PLAIN_FOLDERS)}) and {p}[-1] = 'Module.bsl' and not list_contains({p}, 'Forms') then 'Модуль'
                 else coalesce({m(kinds.MODULE_FILES)}[{p}[-1]], regexp_replace({p}[-1], '\\.bsl$', '')) end) end"""  # noqa: E731
    return f"""
        select * exclude (wrap, parts), (len(wrap) - len(replace(wrap, '/', '')))::int as wrap_depth,
               {sql_composed(f"case when len(parts) < 2 then path when parts[1] = '{kinds.EXTENSIONS}' and len(parts) >= 4 then '{kinds.EXTENSION}.' || parts[2] || '.' || ({base('parts[3:]')}) else {base('parts')} end")} as key
        from (select *, string_split(substr(path, len(wrap) + 1), '/') as parts from (select *, regexp_extract(path, '{ROOTED}', 1) as wrap from ({source})))
    """


def sql_slots(source: str) -> str:
    """A query that adds the four parts to a relation with ``key``."""
    return f"""
        select * exclude (parts), case when starts_with(key, '{kinds.EXTENSION}.') then '{kinds.EXTENSION}' else '' end as namespace,
               case when len(parts) >= 2 then parts[1] else '' end as category, case when len(parts) >= 2 then parts[2] else key end as object_name, case when len(parts) >= 3 then parts[-1] else '' end as module_type
        from (select * exclude (p), case when len(p) >= 5 and p[1] = '{kinds.EXTENSION}' and list_contains({kinds.sql_list(kinds.CATEGORIES)}, p[3]) then p[3:] else p end as parts
              from (select *, string_split(key, '.') as p from ({source})))
    """
