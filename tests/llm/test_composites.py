"""Capitals whose small letters alone have a composite, against the tokenizer."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from heddle.llm import token_output as to

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_capitals_before_combining_marks():
    encode, whole = to.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    marks = ["J̌", "H̱", "T̈", "W̊", "Y̊"]
    texts = [t for m in marks for t in (m, f"A{m}b. Next", f"WORD {m}, É. X.")] + ["Plain, ASCII. Text", "Été. Là, OÙ. Ça"]
    assert encode([t.encode() for t in texts]) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
