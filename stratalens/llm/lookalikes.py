"""Problem 1: one consistent form for texts that look the same.

What nobody sees is left out, and the width of letters and spaces is levelled.
Then each word gets its resolved scripts: those in which every one of its
letters has a spelling that looks the same. A word of mixed scripts is respelled
in the script that remains; a word that could be of several scripts whole is
respelled in that of the words around it. At last characters are composed.
Case, accents and marks stay.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.scripts import SEVERAL, Scripts, scripts
from stratalens.session import lookup_join, materialize


@dataclass
class Form:
    """The consistent form of a text, and its words that needed a choice."""

    text: str
    mixed: int = 0  # words whose letters were of no common script
    whole: int = 0  # words that look the same whole in several scripts


def _words(text: str) -> list[tuple[int, int]]:
    """Runs of letters and marks, parted where a capital begins a word."""
    out, begin, last_lower, n = [], -1, False, len(text)
    for i, c in enumerate(text):
        letter = c.isalpha()
        if not letter and not (begin >= 0 and unicodedata.category(c)[0] == "M"):
            if begin >= 0:
                out.append((begin, i))
                begin = -1
            continue
        if begin < 0:
            begin = i
        elif letter and c.isupper():
            after = next((x for x in text[i + 1 : i + 4] if x.isalpha()), "") if i + 1 < n and (text[i + 1].isalpha() or unicodedata.category(text[i + 1])[0] == "M") else ""
            if last_lower or after.islower():
                out.append((begin, i))
                begin = i
        if letter:
            last_lower = c.islower()
    if begin >= 0:
        out.append((begin, n))
    return out


#: Parts of texts whose words are remembered.
_KEPT = 100_000


def _part(part: str, known: Scripts) -> tuple[list[tuple[int, int, int, int]], dict[int, int], int, int]:
    """Of a part without dots: its words with actual and resolved scripts, how many are of one script each, how many are mixed and whole-script."""
    every = (1 << len(known.names)) - 1
    words, votes, mixed, whole = [], {}, 0, 0
    for a, b in _words(part):
        actual = resolved = every
        for c in part[a:b]:
            own = known.mask(c) or every
            actual &= own
            look = known.look.get(c)
            resolved &= own if look is None else sum(1 << s for s in known.members[look])
        words.append((a, b, actual, resolved))
        mixed += not actual
        whole += bool(resolved & (resolved - 1)) and resolved != every
        if resolved and resolved & (resolved - 1) == 0:
            votes[resolved] = votes.get(resolved, 0) + 1
    return words, votes, mixed, whole


def _spelled(part: str, words: list[tuple[int, int, int, int]], around: int, known: Scripts) -> str:
    """The part with each word in its script."""
    chars = list(part)
    for a, b, _, resolved in words:
        # the lowest bit is the script that is preferred; abbreviations take it wherever they stand
        short = b - a > 1 and all(c.isupper() for c in chars[a:b])
        chosen = (0 if short else resolved & around) or resolved & -resolved
        bit = chosen.bit_length() - 1
        for i in range(a, b):
            look = known.look.get(chars[i])
            if look is not None:
                members = known.members[look]
                chars[i] = members[bit] if bit in members else members[min(members)]
    return "".join(chars)


def consistent(text: str, known: Scripts) -> Form:
    """The form by which texts that look the same meet."""
    if text.isascii():
        return Form(text)
    parts = unicodedata.normalize("NFD", text.translate(known.level)).split(".")
    if len(known.parts) > _KEPT:
        known.parts.clear()
        known.spelled.clear()
    found, votes, form = [], {}, Form("")
    for part in parts:
        own = known.parts.get(part)
        if own is None:
            own = known.parts[part] = _part(part, known)
        found.append(own)
        for script, n in own[1].items():
            votes[script] = votes.get(script, 0) + n
        form.mixed += own[2]
        form.whole += own[3]
    around = max(votes, key=lambda s: (votes[s], -s)) if votes else 0
    out = []
    for part, own in zip(parts, found):
        spelled = known.spelled.get((part, around))
        if spelled is None:
            spelled = known.spelled[part, around] = _spelled(part, own[0], around, known)
        out.append(spelled)
    form.text = unicodedata.normalize("NFC", ".".join(out))
    return form


_FORM = "struct<text:string,mixed:int,whole:int>"


def looks(column: Column | str, spark: SparkSession) -> Column:
    """``consistent`` of each text as (text, mixed, whole); null stays null."""
    shared = spark.sparkContext.broadcast(scripts(spark))

    @F.arrow_udf(_FORM)
    def udf(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        forms = [consistent(t, shared.value) for t in coded.dictionary.to_pylist()]
        parts = [pa.array([f.text for f in forms], pa.string()), pa.array([f.mixed for f in forms], pa.int32()), pa.array([f.whole for f in forms], pa.int32())]
        parts = [p.take(coded.indices) for p in parts]
        return pa.StructArray.from_arrays(parts, names=["text", "mixed", "whole"])

    return udf(column)


#: Field, its row id, and what must be equal beside it.
PATH_FIELDS = (("doc_id", "entry_id", ("repo",)), ("object_name", "entry_id", ("repo", "category", "module_type")))
NODE_FIELDS = (("name", "subsystem_id", ("repo",)),)


def _texts(df: DataFrame, fields) -> DataFrame:
    """(field_name, id, k, t) of each field of each row; k holds what must be equal."""
    parts = [F.struct(F.lit(name).alias("field_name"), F.col(row_id).alias("id"), F.to_json(F.struct(*within), {"ignoreNullFields": "false"}).alias("k"), F.col(name).alias("t")) for name, row_id, within in fields]
    return df.select(F.inline(F.array(*parts))).where("t is not null and id is not null")


def forms(path_entry: DataFrame, subsystem: DataFrame) -> DataFrame:
    """(field_name, row_id, text, form, mixed_words, whole_script_words) of all three fields.

    Defined results: null texts and rows without id give no row; an empty text
    is its own form; repeated rows count once.
    """
    texts = _texts(path_entry, PATH_FIELDS).unionAll(_texts(subsystem, NODE_FIELDS)).select("field_name", "id", "t").distinct()
    return texts.withColumn("f", looks("t", texts.sparkSession)).select("field_name", F.col("id").alias("row_id"), F.col("t").alias("text"), F.col("f.text").alias("form"), F.col("f.mixed").alias("mixed_words"), F.col("f.whole").alias("whole_script_words"))


def _coarse(column: str, spark: SparkSession) -> Column:
    """A form of built-in functions that is equal wherever consistent forms are."""
    text = F.col(column)
    for one, several in SEVERAL.items():
        text = F.replace(text, F.lit(one), F.lit(several))
    return F.translate(text, *scripts(spark).coarse)


def found(path_entry: DataFrame, subsystem: DataFrame) -> DataFrame:
    """p1_found: (field_name, id_a, id_b) of rows with equal forms and different characters.

    Only texts that differ from another one of equal coarse form get their
    consistent form at all. Pairs are made of spellings first, and then of the
    rows that bear them, so that many rows of one spelling cost no more than the
    pairs they are in. Defined results: as of ``forms``; nulls in what must be
    equal are equal to each other.
    """
    spark = path_entry.sparkSession
    texts = _texts(path_entry, PATH_FIELDS).unionAll(_texts(subsystem, NODE_FIELDS)).withColumn("near", F.xxhash64("field_name", "k", _coarse("t", spark)))
    # hashes that meet by chance make a group larger; texts of a group are told apart by 128 bits
    a, b = F.xxhash64("t"), F.xxhash64(F.lit(1), "t")
    varied = texts.groupBy("near").agg(F.min(a).alias("a"), F.max(a).alias("a2"), F.min(b).alias("b"), F.max(b).alias("b2")).where("a != a2 or b != b2").select("near")
    rows = materialize(lookup_join(texts, varied, ["near"], "left_semi", "id").drop("near").distinct(), "near")
    key = ["field_name", "k", "form"]
    spelled = rows.select("field_name", "k", "t").distinct().withColumn("form", looks("t", spark)["text"])
    spelled = materialize(spelled, "spelled")
    pairs = lookup_join(spelled, spelled.withColumnRenamed("t", "t_b"), key, "inner", "t", F.col("t") != F.col("t_b"), written=True).drop("form")
    left = lookup_join(rows.withColumnRenamed("id", "id_a"), pairs, ["field_name", "k", "t"], "inner", "id_a")
    right = rows.select("field_name", "k", F.col("t").alias("t_b"), F.col("id").alias("id_b"))
    both = lookup_join(left, right, ["field_name", "k", "t_b"], "inner", "id_a", F.col("id_a") < F.col("id_b"), written=True)
    return both.select("field_name", "id_a", "id_b").distinct()
