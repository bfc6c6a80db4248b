"""Ids equal those of the untouched file's library where a text holds a special token's string."""

import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm.tokens import BYTE_BPE, encoder


def test_ids_are_those_of_the_default_settings():
    library, encode = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE)), encoder()
    cases = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n  <|endoftext|>", "x  <|endoftext|>  y", "<|endoftext|", "naïve🎉<|endoftext|>🎉 é", "no token", " " * 3000 + "x<|endoftext|>"]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        assert encode(text).tolist() == want, text[-40:]
        assert encode._slow.encode(text, add_special_tokens=False).ids == want
    assert encode._fast and encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
