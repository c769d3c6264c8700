"""Token counts against a plain Viterbi search; token files against the tokenizer and a round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heddle.llm import token_counts as tc
from heddle.llm import token_output as to

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=300, seed=2):
    rng = random.Random(seed)
    alphabet = list("aAbBsStT.,!?'é <09_-\n\t") + ["é", " ", "\x1c", "\x85", "ß", "İ", "Σ", "本", "\U0001f600", "<|endoftext|>", "<|EndOfText|>", "word, ", "Word. "]
    return ["", None, " ", "a" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_cached_words_change_no_id():
    encode, whole = to.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    assert encode.by_word
    texts = odd_texts(3000)
    got = encode([None if t is None else t.encode() for t in texts])
    assert got == [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_small_caches_change_no_id(monkeypatch):
    texts = [None if t is None else t.encode() for t in odd_texts(500)]
    want = to.WordEncoder(WORDS)(texts)
    monkeypatch.setattr(to, "CACHE_WORDS", 20)
    assert to.WordEncoder(WORDS)(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_get_whole_texts(name):
    path = public_tokenizers.path(name)
    encode, texts = to.WordEncoder(path), odd_texts(50)
    assert not encode.by_word
    assert encode([None if t is None else t.encode() for t in texts]) == [np.array(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, to.BLOCK, to.BLOCK + 3])
def test_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32, n, dtype=np.uint32) >> rng.integers(0, 32, n, dtype=np.uint32)
    lengths = np.array([n // 2, 0, n - n // 2], "<u4")
    data = to.encode_file(ids, lengths)
    got, sizes = to.decode_file(data)
    assert (got == ids).all() and (sizes == lengths).all()
    with pytest.raises(ValueError):
        to.decode_file(data[:-1] + b"x")


def test_documents_come_back_in_order(spark, monkeypatch):
    texts = odd_texts(80)
    rows = [(i * 3 % 97, t) for i, t in enumerate(texts)] + [(5, "same"), (5, "same"), (5, "a longer one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as path", "2 as base", "3 as n_tokens").repartition(6)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in to.token_output(df, WORDS).collect())
    whole, start, want = Tokenizer.from_file(WORDS), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, len((r[1] or "").encode()), (r[1] or "").encode())):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert to.token_output(df.limit(0), WORDS).count() == 0


def plain_count(model, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + model.worst * size, -(-best[end - 1][1] + size))]
        options += [(best[s][0] + model.scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in model.scores]
        best.append(max(options))
    return -best[-1][1]


def test_counts_equal_plain_search(spark):
    model = tc.Unigram.load(PIECES)
    texts = [*odd_texts(200), "internationalisation international internal interns", "the the theory"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as id")
    got = {r["id"]: (r["n_words"], r["n_tokens"]) for r in tc.token_counts(df, PIECES).collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        assert got[i] == (len(words), sum(plain_count(model, tc.MARK + w) for w in words)), t
    assert tc.token_counts(df.limit(0), PIECES).count() == 0


def test_shared_prefixes_are_scored_once(monkeypatch):
    model = tc.Unigram({"a": -1.0, "ab": -1.5, "b": -1.0, "abc": -9.0})
    asked = []
    model.scores = type("Seen", (dict,), {"get": lambda self, k: (asked.append(k), dict.get(self, k))[1]})(model.scores)
    assert list(model.count_sorted(["ab", "aba", "abab"])) == [1, 2, 2]
    assert len(asked) == 1 + 2 + 3 + 3


def test_marks_are_learnt_apart_from_words():
    """A word with many kinds of marks after it is asked for once, and so is each run of marks."""
    encode, whole, asked = to.WordEncoder(WORDS), Tokenizer.from_file(WORDS), []
    fresh, small = encode._fresh, encode._fresh_words
    encode._fresh, encode._fresh_words = lambda w: (asked.extend(w), fresh(w))[1], lambda w: (asked.extend(x.decode() for x in w), small(w))[1]
    text = "harbour&&& Harbour### harbour... harbour, HARBOUR b52&&& <|endoftext|> <|EndOfText|>... it's!'"
    assert encode([text.encode()]) == [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(asked) == len(set(asked)) and {"harbour", "&&&", "###", "...", ",", "b52", "it's", "!'"} <= set(asked) and "harbour&&&" not in asked
