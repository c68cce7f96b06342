"""Problem 8: the language of documents and of their paragraphs.

One interpolated Kneser-Ney model of characters per language; the n-grams of
all models lie in sorted hash arrays with a column per language. A paragraph
gets the language of the lowest cross-entropy per character; the margin over
the runner-up gives the confidence, and paragraphs with too little prose or too
small a margin, or unlike all languages, are rejected: they never make a
document mixed. So are documents that aren't mixed. The scale of the
confidences and the bound are fitted on held-out rows of the sample.

Words are what is scored. Equal words of a batch are scored once, so the cost
follows the vocabulary, not the corpus. Code, names in several cases, dotted
names, short quotations and bracketed remarks are left out, for prose decides;
where a document has no other prose, its quotations, remarks and headings do.

Defined results: a rejected document has a row without a language, and its
confidence; p8_found leaves it out; null, empty and blank texts, and texts without any prose, give
no row; repeated documents give repeated results; ties go to the first language
of ``LANGUAGES``; texts are read to their end, however long.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.llm.codepoints import LIMIT, code_points, raw_bytes, slices
from stratalens.llm.langseeds import NAMES, SEEDS

LANGUAGES = tuple(SEEDS)

ORDER = 5
#: A paragraph with fewer letters of prose, or a lower confidence, is rejected.
LEAST_LETTERS, LEAST_CONFIDENCE = 8, 0.9
#: Every so many training rows one is held out; scales to choose from.
HELD_OUT, SCALES = 5, np.geomspace(0.05, 2, 60)

_APOSTROPHES = (0x27, 0x2019, 0x2BC)
_WORD, _UPPER, _LOWER, _BLANK, _FORMAT, _TIED = 1, 2, 4, 8, 16, 32

#: What is not prose: marked code, quotations, remarks in brackets or between dashes, lines of code.
_NOT_PROSE = re.compile(
    r"""&[A-Za-z]+;|&#[0-9]+;|`[^`\n]*`|«[^«»\n]*»|„[^„“”"\n]*[“”"]|“[^“”\n]*”|"[^"\n]*"|(?<!\w)'[^'\n]*'(?!\w)"""
    r"""|\([^()\n]{0,80}\)|\[[^\[\]\n]{0,80}\]|\{[^{}\n]*\}|<[^<>\n]*>|—[  ]+[^—\n.]{3,60}?[  ]+—|https?://\S+"""
    r"""|^[ \t]*[\w.]+[ \t]*=[^\n]*$|^[ \t]*[\w.]+\([^\n]*\);[ \t]*$|^[ \t]*[#&|][^\n]*$""",
    re.M,
)


@lru_cache(maxsize=1)
def _flags() -> tuple[np.ndarray, np.ndarray]:
    """Flags of every code point, and its lower-case form where that is one character."""
    flags = np.zeros(LIMIT, np.uint8)
    lower = np.arange(LIMIT, dtype=np.uint32)
    for c in range(LIMIT):
        char = chr(c)
        kind = unicodedata.category(char)
        if kind[0] in "LM":
            flags[c] = _WORD
        if kind in ("Lu", "Lt"):
            flags[c] |= _UPPER
            if len(low := char.lower()) == 1:
                lower[c] = ord(low)
        elif kind == "Ll":
            flags[c] |= _LOWER
        if char.isspace():
            flags[c] |= _BLANK
        if kind == "Cf":
            flags[c] |= _FORMAT
        if kind[0] == "N" or char in "_@\\":
            flags[c] |= _TIED
    return flags, lower


#: A quotation of more characters is prose; what stands within it is judged as elsewhere.
LONGEST_QUOTATION = 80
_QUOTED = frozenset("«„“\"'{<")


def _blank_out(match: re.Match) -> str:
    found = match.group()
    if found[0] in _QUOTED and len(found) > LONGEST_QUOTATION + 2:
        return found[0] + _NOT_PROSE.sub(_blank_out, found[1:-1]) + found[-1]
    return " " * len(found)


def _blank_out_code(match: re.Match) -> str:
    """Quotations, remarks and headings stay."""
    found = match.group()
    if found[0] in "«„“\"'([—" or found.lstrip().startswith("# "):
        return found[0] + _NOT_PROSE.sub(_blank_out_code, found[1:])
    return " " * len(found)


def _restore(text: str, points: np.ndarray, blanked: np.ndarray, row: np.ndarray, words: np.ndarray) -> None:
    """Put quotations, remarks and headings back where a row would keep no prose, for then they are its prose."""
    left = np.zeros(int(row[-1]) + 1, bool)
    left[row[(words[points] & _WORD) != 0]] = True
    kept = np.zeros(len(left), bool)
    kept[row[(words[blanked] & _WORD) != 0]] = True
    for k in np.flatnonzero(left & ~kept):
        begin, end = np.searchsorted(row, [k, k + 1])
        blanked[begin:end] = np.frombuffer(_NOT_PROSE.sub(_blank_out_code, text[begin:end]).encode("utf-32-le"), np.uint32)


def _composed(texts: pa.Array) -> pa.Array:
    """Composed characters; Arrow's own utf8_normalize takes letters and marks apart. Texts without marks are left alone."""
    marked = pc.match_substring_regex(texts, "[\\x{0300}-\\x{036F}]")
    if not pc.any(marked).as_py():
        return texts
    whole = [unicodedata.normalize("NFC", t) for t in texts.filter(marked).to_pylist()]
    return pc.replace_with_mask(texts, marked, pa.array(whole, texts.type))


@dataclass
class Prose:
    """Words of a string array, in order, and where paragraphs and rows end."""

    words: pa.DictionaryArray
    letters: np.ndarray  # of each word
    paragraph: np.ndarray  # of each word
    row: np.ndarray  # of each paragraph; blank ones aren't counted


def prose(texts: pa.Array) -> Prose:
    """Paragraphs and scorable words."""
    flags, lower = _flags()
    texts = _composed(texts.fill_null("") if texts.null_count else texts)
    texts = pc.binary_join_element_wise(texts, "\n", "")  # rows end their lines, so that nothing joins two of them
    data, offsets = raw_bytes(texts)
    points, at = code_points(data) if len(data) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    rows = np.searchsorted(at, offsets)
    n = len(points)
    if not n:
        return Prose(pa.array([], pa.binary()).dictionary_encode(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # lines: a new one after each line end and at each row
    ends = (points == 0x0A) | (points == 0x0D) | (points == 0x2029)
    fresh = np.zeros(n + 1, bool)
    fresh[1:] = ends
    fresh[rows] = True
    line = np.cumsum(fresh[:n]) - 1
    first = np.flatnonzero(fresh[:n])
    row_of_line = np.searchsorted(rows, first, side="right") - 1
    ink = np.zeros(len(first), bool)
    kinds = flags[points]
    ink[line[(kinds & (_BLANK | _FORMAT)) == 0]] = True
    # CR LF is one line end: the empty line between the two is no blank line
    pair = (points[first] == 0x0A) & (first > 0) & (points[np.maximum(first - 1, 0)] == 0x0D) & ~np.isin(first, rows)
    real = ~pair
    before = np.zeros(len(first), bool)
    held = np.flatnonzero(real)
    before[held[1:]] = ink[held[:-1]] & (row_of_line[held[1:]] == row_of_line[held[:-1]])
    opens = ink & ~before & real
    paragraph_of_line = np.cumsum(opens) - 1
    row = row_of_line[opens]
    # what is not prose becomes blanks; the length stays
    text = data.tobytes().decode("utf-8").replace("\r", "\n")
    blanked = np.frombuffer(_NOT_PROSE.sub(_blank_out, text).encode("utf-32-le"), np.uint32).copy()
    _restore(text, points, blanked, row_of_line[line], flags)
    points = blanked
    kinds = flags[points]
    kept = np.flatnonzero((kinds & _FORMAT) == 0)
    points, kinds, line = points[kept], kinds[kept], line[kept]
    n = len(points)
    inside = np.zeros(n + 2, bool)
    word = inside[1:-1]
    word[:] = (kinds & _WORD) != 0
    mark = np.flatnonzero(np.isin(points, _APOSTROPHES))
    inside[mark + 1] = inside[mark] & inside[mark + 2]
    change = np.diff(inside.astype(np.int8))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # lines may touch only through their ends, so a word is of one line
    tied = np.zeros(n + 4, bool)
    tied[2:-2] = (kinds & _TIED) != 0
    dot = np.zeros(n + 4, bool)
    dot[2:-2] = points == 0x2E
    letter = np.zeros(n + 4, bool)
    letter[2:-2] = word
    code = tied[begin + 1] | tied[end + 2] | (dot[begin + 1] & letter[begin]) | (dot[end + 2] & letter[end + 3])
    hump = np.zeros(n + 1, np.int64)
    if n > 1:
        hump[2:] = np.cumsum(((kinds[1:] & _UPPER) != 0) & ((kinds[:-1] & _LOWER) != 0))
        code |= hump[end] > hump[np.minimum(begin + 1, n)]
    begin, end = begin[~code], end[~code]
    size = end - begin
    paragraph = paragraph_of_line[line[begin]]
    stops = np.cumsum(size)
    where = np.repeat(begin - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
    chars = lower[points[where]]
    chars[np.isin(chars, _APOSTROPHES)] = 0x27
    raw = np.frombuffer(chars.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    bounds = starts[np.concatenate([[0], stops])].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])
    return Prose(words.dictionary_encode(), size, paragraph, row)


# --- character models -------------------------------------------------------------------------

_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xC2B2AE3D27D4EB4F << k)) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(ORDER)], np.uint64)


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each symbol, by order; depth and word of each symbol.

    A word stands between two blanks; the depth is the number of symbols of the word before.
    """
    text = "".join(f" {w} " for w in words)
    symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(symbols)) - starts[owner]
    hashes, plain = [], np.zeros(len(symbols), np.uint64)
    for k in range(ORDER):
        shifted = np.zeros(len(symbols), np.uint64)
        shifted[k:] = symbols[: max(len(symbols) - k, 0)]
        plain = plain + (shifted + np.uint64(1)) * _MULTIPLIERS[k]
        x = (plain ^ (plain >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append(x ^ (x >> np.uint64(29)))
    return hashes, depth, owner


@dataclass
class Tables:
    """One order: n-gram hashes with discounted probabilities, context hashes with back-off weights."""

    grams: np.ndarray
    alpha: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


def _count_order(k: int, hashes: list[np.ndarray], depth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of order k+1, their Kneser-Ney counts and their contexts."""
    valid = np.flatnonzero(depth >= max(k, 1))  # the first blank is given, never predicted
    grams, index, inverse = np.unique(hashes[k][valid], return_index=True, return_inverse=True)
    raw = np.bincount(inverse, weights=weight[valid])
    where = valid[index]
    counts = raw
    if k + 1 < ORDER:
        longer = np.flatnonzero(depth >= k + 1)
        _, first = np.unique(hashes[k + 1][longer], return_index=True)
        slot = np.searchsorted(grams, hashes[k][longer[first]])
        preceded = np.bincount(slot, minlength=len(grams))
        counts = np.where((depth[where] == k) | (preceded == 0), raw, preceded)
    context = hashes[k - 1][where - 1] if k else np.zeros(len(grams), np.uint64)
    return grams, counts, context


def train(counts: dict[str, Counter]) -> list[Tables]:
    """Interpolated Kneser-Ney models from word counts by language, order by order."""
    per_order: list[list] = [[] for _ in range(ORDER)]
    for lang in LANGUAGES:
        words = sorted(counts[lang])
        hashes, depth, owner = _grams(words)
        weight = np.array([counts[lang][w] for w in words], float)[owner]
        for k in range(ORDER):
            per_order[k].append(_count_order(k, hashes, depth, weight))
    out = []
    for found in per_order:
        grams = np.unique(np.concatenate([g for g, _, _ in found]))
        contexts = np.unique(np.concatenate([c for _, _, c in found]))
        alpha = np.zeros((len(grams), len(LANGUAGES)), np.float32)
        back = np.ones((len(contexts), len(LANGUAGES)), np.float32)
        for j, (own, n, context) in enumerate(found):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            at = np.searchsorted(contexts, context)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            alpha[np.searchsorted(grams, own), j] = np.maximum(n - discount, 0) / total[at]
            back[:, j] = np.where(total > 0, np.minimum(discount, n.min()) * kinds / np.maximum(total, 1e-9), 1)
        out.append(Tables(grams, alpha, contexts, back))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = default
    return out


def score_words(model: list[Tables], words: list[str]) -> np.ndarray:
    """Log-probability of each word under each language."""
    if not words:
        return np.zeros((0, len(LANGUAGES)))
    hashes, depth, owner = _grams(words)
    p = np.full((len(depth), len(LANGUAGES)), 1 / 300)
    for k, t in enumerate(model):
        at = np.flatnonzero(depth >= max(k, 1))
        context = hashes[k - 1][at - 1] if k else np.zeros(len(at), np.uint64)
        p[at] = _find(t.grams, hashes[k][at], t.alpha, 0) + _find(t.contexts, context, t.back, 1) * p[at]
    logs = np.log(np.maximum(p, 1e-12))
    logs[depth == 0] = 0
    return np.add.reduceat(logs, np.flatnonzero(depth == 0), axis=0)


@dataclass
class Identifier:
    """Models with the scale that turns margins into confidences; keeps scored words up to a bound."""

    model: list[Tables]
    scale: float = 0.25
    worst: float = 8.0
    keep: int = 400_000
    known: dict = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((1 << 12, len(LANGUAGES)), np.float64))

    def __getstate__(self):
        return {"model": self.model, "scale": self.scale, "worst": self.worst, "keep": self.keep}

    def __setstate__(self, state):
        self.__init__(**state)

    def _entries(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known, self.scores = {}, np.zeros((1 << 12, len(LANGUAGES)))
        new = [w for w in words if w not in self.known]
        if new:
            found = score_words(self.model, [w.decode("utf-8") for w in new])
            used = len(self.known)
            while used + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[used : used + len(new)] = found
            self.known.update(zip(new, range(used, used + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def paragraphs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, log-probabilities and scored letters of each paragraph."""
        found = prose(texts)
        totals = np.zeros((len(found.row), len(LANGUAGES)))
        letters = np.zeros(len(found.row), np.int64)
        if len(found.letters):
            own = self.scores[entry] if len(entry := self._entries(found.words.dictionary.to_pylist())) else np.zeros((0, len(LANGUAGES)))
            first = np.flatnonzero(np.diff(found.paragraph, prepend=-1))
            at = found.paragraph[first]
            totals[at] = np.add.reduceat(own[np.asarray(found.words.indices)], first, axis=0)
            letters[at] = np.add.reduceat(found.letters, first)
        return found.row, totals, letters

    def confidence(self, totals: np.ndarray) -> np.ndarray:
        """Probability of each language."""
        x = (totals - totals.max(axis=1, keepdims=True)) * self.scale
        e = np.exp(x)
        return e / e.sum(axis=1, keepdims=True)

    def sure(self, totals: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Whether the paragraph is prose of a language we know."""
        top = self.confidence(totals).max(axis=1)
        entropy = -totals.max(axis=1) / np.maximum(letters, 1)
        return (letters >= LEAST_LETTERS) & (top >= LEAST_CONFIDENCE) & (entropy <= self.worst)

    def segments(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Row, segment number, language and confidence: one row a document, and one a paragraph of mixed ones (from 1)."""
        row, totals, letters = self.paragraphs(texts)
        if not len(row):
            return {"row": np.zeros(0, np.int64), "segment_no": np.zeros(0, np.int32), "lang": np.zeros(0, np.int64), "confidence": np.zeros(0), "letters": np.zeros(0, np.int64)}
        best = totals.argmax(axis=1)
        sure = self.sure(totals, letters)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        group = np.cumsum(np.diff(row, prepend=-1) != 0) - 1
        bits = np.bitwise_or.reduceat(np.where(sure, 1 << best, 0), first)
        mixed = (bits & (bits - 1)) != 0
        whole = np.add.reduceat(totals, first, axis=0)
        many = np.add.reduceat(letters, first)
        # a rejected paragraph of a mixed document leans on the documents' other paragraphs
        lean = np.where(sure[:, None], totals, totals + 0.02 * (whole[group] - totals))
        seg_best = lean.argmax(axis=1)
        seg_top = self.confidence(lean).max(axis=1)
        doc_best, doc_top = whole.argmax(axis=1), self.confidence(whole).max(axis=1)
        doc_best = np.where(mixed | self.sure(whole, many), doc_best, -1)  # a rejected document has no language
        number = np.arange(len(row)) - first[group] + 1
        inner = mixed[group]
        has = many > 0
        out_row = np.concatenate([row[first][has], row[inner]])
        order = np.argsort(out_row, kind="stable")
        cat = lambda a, b: np.concatenate([a[has], b[inner]])[order]
        return {
            "row": out_row[order],
            "segment_no": cat(np.zeros(len(first), np.int32), number.astype(np.int32)),
            "lang": cat(doc_best, seg_best),
            "confidence": cat(doc_top, seg_top),
            "letters": cat(many, letters),
            "mixed": cat(mixed, mixed[group]),
        }


# --- training ---------------------------------------------------------------------------------


def _variants(words: Counter) -> Counter:
    """The words, and with a lower weight the same words without their accents."""
    out = Counter(words)
    for w, n in words.items():
        bare = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
        if bare != w:
            out[bare] += max(1, n // 5)
    return out


def _word_counts(texts: list[str], rows: np.ndarray | None = None) -> tuple[Prose, list[str]]:
    found = prose(pa.array(texts, pa.string()))
    return found, [w.decode("utf-8") for w in found.words.dictionary.to_pylist()]


def fit(sample: list[tuple[str, str]]) -> Identifier:
    """Train on (language, text) rows whose labels may be wrong, starting from the seed sentences.

    Twice, paragraphs that the present models give to another language than
    their label are left out and the models are trained anew.
    """
    seeds = {}
    for lang in LANGUAGES:
        found, names = _word_counts([SEEDS[lang]])
        seeds[lang] = Counter({names[i]: 3 * int(n) for i, n in Counter(np.asarray(found.words.indices).tolist()).items()})
    own = Identifier(train({k: _variants(v) for k, v in seeds.items()}))
    if not sample:
        return own
    label = np.array([LANGUAGES.index(lang) for lang, _ in sample])
    texts = pa.array([t for _, t in sample], pa.string())
    found = prose(texts)
    names = [w.decode("utf-8") for w in found.words.dictionary.to_pylist()]
    codes = np.asarray(found.words.indices)
    held = np.arange(len(label)) % HELD_OUT == 0  # never trained on
    for _ in range(2):
        row, totals, letters = own.paragraphs(texts)
        trusted = (totals.argmax(axis=1) == label[row]) & (letters >= LEAST_LETTERS) & ~held[row]
        counts = {k: Counter(v) for k, v in seeds.items()}
        keep = trusted[found.paragraph]
        pair, n = np.unique(np.stack([label[row[found.paragraph[keep]]], codes[keep]]), axis=1, return_counts=True)
        for (lang, code), times in zip(pair.T.tolist(), n.tolist()):
            counts[LANGUAGES[lang]][names[code]] += times
        own = Identifier(train({k: _variants(v) for k, v in counts.items()}))
    _calibrate(own, pa.array([t for (_, t), out in zip(sample, held) if out], pa.string()), label[held])
    return own


def _calibrate(own: Identifier, texts: pa.Array, label: np.ndarray) -> None:
    """Scale and entropy bound from held-out paragraphs whose label agrees.

    The scale makes the confidences of their pieces of three words most likely:
    of a whole paragraph the language is known, of its pieces it must be found.
    """
    found = prose(texts)
    row, totals, letters = own.paragraphs(texts)
    trusted = (totals.argmax(axis=1) == label[row]) & (letters >= LEAST_LETTERS)
    if trusted.sum() < 20:
        return
    entropy = -totals[trusted].max(axis=1) / letters[trusted]
    own.worst = float(np.median(entropy) + 15 * max(entropy.std(), 0.1))  # between other subjects, to 1.9 on sf0.1, and other languages, from 3.5
    scores = own.scores[own._entries(found.words.dictionary.to_pylist())][np.asarray(found.words.indices)]
    opens = np.diff(found.paragraph, prepend=-1) != 0
    place = np.arange(len(opens)) - np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
    first = np.flatnonzero(place % 3 == 0)
    held = trusted[found.paragraph[first]] & (np.add.reduceat(found.letters, first) >= LEAST_LETTERS)
    pieces, truth = np.add.reduceat(scores, first, axis=0)[held], label[row[found.paragraph[first]]][held]
    if len(pieces) < 50:
        return
    margin = pieces - pieces.max(axis=1, keepdims=True)
    own_margin = margin[np.arange(len(truth)), truth]
    loss = [np.mean(np.log(np.exp(margin * x).sum(axis=1)) - own_margin * x) for x in SCALES]
    own.scale = float(SCALES[int(np.argmin(loss))])


def label_language(label: str | Column) -> Column:
    """The two-letter code a label names, or null: case, region and three-letter codes don't matter."""
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)])
    text = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    whole = F.try_element_at(known, text)
    return F.coalesce(whole, F.try_element_at(known, F.split(text, "[-_.]")[0]))


def sample_rows(df: DataFrame, text: str, label: str, per_language: int = 300, longest: int = 20_000) -> list[tuple[str, str]]:
    """At most ``per_language`` different labelled texts of each language, chosen by a hash of the text.

    The bound holds for the training rows alone; rows longer than ``longest``
    characters aren't used for training, and copies of a text count once.
    """
    rows = df.select(label_language(label).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    rows = rows.where(F.length("t") <= longest).withColumn("h", F.xxhash64("t"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}  # eight rows
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * per_language / n))])
    drawn = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("l")] * 1_000_003).groupBy("l", "h").agg(F.min("t").alias("t"))
    order = W.partitionBy("l").orderBy("h")  # of about 1.3 x per_language rows a language
    out: dict[str, list] = {}
    for r in drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).orderBy("h", "l").collect():  # bounded
        out.setdefault(r.l, []).append((r.l, r.t))
    return [x for lang in LANGUAGES for x in out.get(lang, [])]


def _batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*LANGUAGES, None], object)
        for batch in batches:
            texts, done = batch.column(batch.num_columns - 1), 0
            for piece in slices(texts, 4 << 20):
                got = own.segments(piece)
                at = pa.array(got["row"] + done)
                columns = [batch.column(i).take(at) for i in range(batch.num_columns - 1)]
                columns += [pa.array(got["segment_no"], pa.int32()), pa.array(names[got["lang"]], pa.string()), pa.array(got["confidence"], pa.float64())]
                columns.append(pa.array(got["mixed"] if len(got["row"]) else [], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "segment_no", "lang", "confidence", "mixed"])
                done += len(piece)

    return run


def identify(df: DataFrame, keep: list[str | Column], text: str = "text", label: str = "lang", per_language: int = 300) -> DataFrame:
    """The columns ``keep`` with segment_no, lang, confidence and mixed.

    A row with segment_no 0 for each document with prose, and for mixed ones a
    row for each paragraph. No shuffle; the models are broadcast, their size is
    bounded by the training sample.
    """
    own = fit(sample_rows(df, text, label, per_language))
    shared = df.sparkSession.sparkContext.broadcast(own)
    given = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(_batches(shared), f"{schema}, segment_no int, lang string, confidence double, mixed boolean")
