"""Added tokens of the vocabulary, against the tokenizer as loaded."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from depthwise.llm.tokens import encoder


def test_added_tokens():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode
    end = "<|endoftext|>"
    for text in (f"a {end} b", end, end * 3, f"{end}\n\n  x", f"été  {end}東京 {end}", f"<|endoftext {end[1:]}", f"it's{end}'s", "plain", f"a  {end}  b "):
        assert np.frombuffer(encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(f"a {end} b"), "<u2").tolist() == [64, 220, 50256, 275]
