"""Scripts of letters, and letters of other scripts that are drawn alike.

Both tables are read once from the Unicode library that Spark itself brings
(ICU4J), through the driver's JVM: the script extensions of all characters, and
the skeletons its spoof checker gives to letters. Letters of different scripts
with one skeleton, one letter and of one case, form a class with at most one
letter of each script.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Letters a reader tells apart although their skeletons agree, and pairs with different capitals that look the same.
_TOLD_APART = set("αγικπστυφχωΛɅ")
_ALSO_ALIKE = ("hһ", "dԁ", "vν", "lӏ")
#: Scripts in the order in which one is preferred where nothing else decides.
_FIRST = ("Latn", "Cyrl", "Grek", "Armn")


@dataclass
class Scripts:
    """Ranges of characters with the bits of their scripts, and classes of letters that look alike."""

    names: list[str]
    begins: list[int]
    masks: list[int]  # of the range that begins there; 0 is every script
    look: dict[str, int]  # letter to class
    members: list[dict[int, str]]  # of a class: the letter of each script, by bit number
    level: dict[int, str]  # characters nobody sees become nothing, those that differ in width alone another
    coarse: tuple[str, str] = ("", "")  # of a form of built-in functions: characters, and what they become
    _known: dict[str, int] = field(default_factory=dict)
    #: What readers remember of parts of texts; not sent to executors.
    parts: dict = field(default_factory=dict)
    spelled: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"names": self.names, "begins": self.begins, "masks": self.masks, "look": self.look, "members": self.members, "level": self.level, "coarse": self.coarse}

    def __setstate__(self, state):
        self.__init__(**state)

    def mask(self, char: str) -> int:
        """The bits of a character's scripts; 0 where it goes with every script."""
        found = self._known.get(char)
        if found is None:
            at = bisect.bisect_right(self.begins, ord(char)) - 1
            found = self._known[char] = self.masks[at] if at >= 0 else 0
        return found


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """The ranges of an escaped set pattern."""
    inner = pattern[1:-1]
    chars = [(int(m[1] or m[2], 16) if m[1] or m[2] else ord(m[3] or m[4]), m[4] == "-" and not m[3]) for m in re.finditer(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)|(.)", inner, re.S)]
    out, i = [], 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1][1]:
            out.append((chars[i][0], chars[i + 2][0]))
            i += 3
        else:
            out.append((chars[i][0], chars[i][0]))
            i += 1
    return out


# Marks and fillers that show nothing, beside all format characters.
_UNSEEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))


def _levels() -> dict[int, str]:
    """Characters nobody sees, blanks, hyphens that don't break, widths and ligatures."""
    level = {0x2010: "-", 0x2011: "-"} | dict.fromkeys(_UNSEEN, "")
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind == "Cf":
            level[c] = ""
        elif kind == "Zs":
            level[c] = " "
        elif 0xFB00 <= c <= 0xFB06 or c > 0x2FFF and unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>")):
            level.setdefault(c, unicodedata.normalize("NFKD", chr(c)))
    return level


#: Characters that become several; all others become one at most.
SEVERAL = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xFB00, 0xFB07)}


def _coarse(made: Scripts) -> tuple[str, str]:
    """Characters and what they become in a form that is equal wherever consistent forms are.

    Marks go, letters become the first of their class. What decomposes into
    several letters goes, and so do those letters. Characters without
    counterpart stand last.
    """
    alike = lambda c: made.members[made.look[c]][min(made.members[made.look[c]])] if c in made.look else c
    become, gone = {}, set()
    for n in range(0x110000):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        whole = unicodedata.normalize("NFD", made.level.get(n, c))
        bases = [x for x in whole if unicodedata.category(x)[0] != "M"]
        if c in SEVERAL:
            continue
        if len(bases) > 1:
            gone.update(bases, c)
        elif not bases:
            become[c] = ""
        elif (one := alike(bases[0])) != c:
            become[c] = one
    become |= dict.fromkeys(gone | {c for c, x in become.items() if x in gone}, "")
    order = sorted(become, key=lambda c: not become[c])
    return "".join(order), "".join(become[c] for c in order)


def _base_letters() -> list[str]:
    """Letters that are no composed or compatibility forms."""
    return [c for n in range(0x110000) if not 0xD800 <= n < 0xE000 and unicodedata.category(c := chr(n)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c)]


def _classes(skeleton: dict[str, str], script: dict[str, int]) -> list[list[str]]:
    """Letters of one case and skeleton, one a script; small ones only if their capitals agree as well."""
    by: dict[tuple[str, str], dict[int, str]] = {}
    for char, seen in skeleton.items():
        if len(seen) != 1 or not seen.isalpha() or char in _TOLD_APART or char not in script:
            continue
        if char.islower():
            upper, other = char.upper(), seen.upper() if seen.islower() else None
            if other is None or len(upper) != 1 or skeleton.get(upper, upper) != skeleton.get(other, other):
                continue
        by.setdefault((unicodedata.category(char), seen), {}).setdefault(script[char], char)  # characters come in order: the first stays
    return [list(members.values()) for members in by.values()]


_MADE: list[Scripts] = []


def scripts(spark: SparkSession) -> Scripts:
    """The tables, read once a process."""
    if _MADE:
        return _MADE[0]
    icu = spark.sparkContext._jvm.com.ibm.icu
    script, sets, wanted = icu.lang.UScript, icu.text.UnicodeSet, icu.lang.UProperty.SCRIPT_EXTENSIONS
    count = icu.lang.UCharacter.getIntPropertyMaxValue(icu.lang.UProperty.SCRIPT) + 1
    names = {n: script.getShortName(n) for n in range(count)}
    order = sorted((n for n in names if names[n] not in ("Zyyy", "Zinh", "Zzzz", "Qaai")), key=lambda n: (_FIRST.index(names[n]) if names[n] in _FIRST else len(_FIRST), n))
    bounds: dict[int, int] = {}
    single: dict[str, int] = {}
    kept = []
    for n in order:
        found = sets().applyIntPropertyValue(wanted, n)
        if found.isEmpty():
            continue
        bit = len(kept)
        kept.append(names[n])
        for a, b in _ranges(sets().addAll(found).toPattern(True)):
            bounds[a] = bounds.get(a, 0) ^ 1 << bit
            bounds[b + 1] = bounds.get(b + 1, 0) ^ 1 << bit
    begins, masks, held = [], [], 0
    for at in sorted(bounds):
        held ^= bounds[at]
        begins.append(at)
        masks.append(held)
    made = Scripts(kept, begins, masks, {}, [], _levels())
    letters = _base_letters()
    for c in letters:
        m = made.mask(c)
        if m and m & (m - 1) == 0:
            single[c] = m.bit_length() - 1
    made._known.clear()
    checker = icu.text.SpoofChecker.Builder().build()
    skeleton = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
    groups = _classes(skeleton, single) + [list(pair) for pair in _ALSO_ALIKE]
    merged: dict[str, list[str]] = {}
    for group in groups:
        joined = {c: None for g in (merged.get(x, [x]) for x in group) for c in g}
        for c in joined:
            merged[c] = list(joined)
    done: set[str] = set()
    for group in merged.values():
        members: dict[int, str] = {}
        for c in group:
            members.setdefault(single[c], c)
        if len(members) > 1 and group[0] not in done:
            done.update(group)
            made.look |= {c: len(made.members) for c in members.values()}
            made.members.append(members)
    made.coarse = _coarse(made)
    _MADE.append(made)
    return made
