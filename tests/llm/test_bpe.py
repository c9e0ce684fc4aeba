import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tokenloom.llm import bpe


def test_pieces_equal_the_library():
    rnd = random.Random(2)
    words = ["The", "the", "can't", "it's", "naïve", "12", "a1b2", "x.", "y,,", "...", "%%%", "é.", "日本", "|", "end.***", "don’t", "'s", "A!B", "q r", "​", "<|endoftext|>", "tab\tbed", "x'"]
    texts = [rnd.choice([" ", " ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts += ["", " ", "\n", "a  b", "a \nb", " lead", "trail ", "a\n\nb", "\r\n", "a\x85b", "one\ntwo three.\nfour", "é", "\x01a", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "one two\nthree <|endoftext", "no |endoftext|> here"]
    regular = [" ".join(rnd.choice(words[:8] + words[9:12]) for _ in range(20)) + "\nNext line." for _ in range(50)]
    texts += regular
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    coder, lib = bpe.Encoder(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    for _ in range(2):
        ids, sizes = coder.encode(data, off)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        for i, t in enumerate(texts):
            assert ids[cut[i]:cut[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t
