"""Token counts of pieces of letters by the model alone, against whole texts."""

import random

from hyperloom.llm import tokens

SIGNS = [*"abcXYZÀéßªºµÿ×÷½²³'.,;:!?<|>&$%*_-#\"()[]\\/~^`1239", "'s", "'T", "<|endoftext|>", "é", "́", "İ", "ſ", "K", "Å", "ﬁ", "中", "…", " ", "\u0085", "­", "Σ", "\t", "\r", "\x00", "\x1c", "😀", "ᄀ", "ᅡ"]


def test_only_pieces_with_other_signs_are_encoded_as_texts():
    counter = tokens.Counter(tokens.default_path())
    whole, seen = counter.encode, []
    counter.encode = lambda texts: seen.extend(texts) or whole(texts)
    texts = ["Haanth the Éviieré Ciónuecoga. weiß&&& ingere,&&& (x) 12", "…Étude weiß, nda"]
    assert counter.count(texts) == whole(texts)
    assert set(seen) == {".", "&&&", ",&&&", "(x", ")", "12", "…Étude", ","}


def test_pieces_of_odd_signs_against_whole_texts():
    counter, rng = tokens.Counter(tokens.default_path()), random.Random(3)
    for _ in range(6):
        texts = ["".join(rng.choice(SIGNS if rng.random() < 0.8 else [" ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
        texts += ["".join(c for c in t if c <= "ÿ") for t in texts]
        assert counter.count(texts) == counter.encode(texts)
    assert max(map(len, counter.known)) <= tokens.SHORT
