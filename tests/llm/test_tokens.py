"""Ids of texts with letters newer than Python's tables against the tokenizer on whole texts."""

import random

from tessella.llm import packing
from tessella.llm.queries import tokenizer_path


def test_unassigned_letters():
    from tokenizers import Tokenizer

    tok, coder, r = Tokenizer.from_file(tokenizer_path()), packing.Coder(tokenizer_path()), random.Random(6)
    parts = ["\u1c89", "\U00016d40", "'s", "'ll", " ", "word", "12", "\n", "é", "\u0378", "<|endoftext|>", "!"]
    texts = ["\u1c89's", "plain text", "", "\U00016d40's x"] + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(2000)]
    ids, at = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
