"""Problem 6: ids equal those of a public library, and texts come back from them."""

import base64
import random

import pyarrow as pa
import pytest

from stratalens.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = ["", " ", "\n\n", "  a", "don't 'LL 's", "\x1c\x85᠎ x", "é", "é", "½³Ⅷ", "٣४", "'re're", "👩‍👩‍👧", "a\r\nb\t", " ", "<|endoftext|>", "ёЁ" * 40, "x" * 20_000, "\n" * 3000, "abc 123" * 4000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_and_round_trip(library):
    rng = random.Random(6)
    alphabet = list("abcdeABC '\n\t 0123.,!?-_ёжйїł½") + ["'ll", "'s", "  ", "́", "日本", "🙂", "\x1c", "\x85", " ", "the", "Процедура", " the"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    own = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    for at in (0, 7):  # of a slice, too
        got = own.encode(pa.array(texts).slice(at)).to_pylist()
        assert got == [library.encode_ordinary(t) for t in texts[at:]]
        assert own.count(pa.array(texts).slice(at)).to_pylist() == [len(x) for x in got]
        assert [library.decode(x) for x in got] == texts[at:]


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Привет, мир", "y"), (3, "Привет, мир", "y"), (4, "a" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df, ["doc_id"]).collect())
    assert got == [(1, []), (2, []), (3, library.encode_ordinary("Привет, мир")), (3, library.encode_ordinary("Привет, мир")), (4, library.encode_ordinary("a" * 300_000))]
    assert bpe.encode(df.limit(0), ["doc_id"]).count() == 0
    assert sorted(r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect())[:2] == [0, 0]
    with pytest.raises(ValueError):
        bpe.encode(df, ["doc_id"], vocabulary="/nowhere")
