import random
import zlib

import numpy as np
import pytest

from tidelog.llm import packing as P

from .cases import frame

END = "<|endoftext|>"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_vocabulary())  # as it is loaded


def test_added_tokens_in_texts_are_those_tokens(tokenizer):
    rnd = random.Random(4)
    texts = ["", END, f"a {END} b", f"{END}{END}x", f"a\n{END}\nb", "<|endoftext|", "<<|endoftext|>>", f"don't{END}'s"]
    texts += ["".join(rnd.choice([" ", "\n", "a", "1", "é", ".", END, "<|", "|>", "word "]) for _ in range(25)) for _ in range(300)]
    e = P.encoder(P.default_vocabulary())
    for t in texts:
        assert e.whole(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert e.whole(f"a {END} b").tolist() == [64, 220, 50256, 275]


def test_packed_ids_are_the_tokenizers(spark, tokenizer):
    text = f"one {END} two{END}"
    r = P.pack(frame(spark, [(1, text)]), P.default_vocabulary()).orderBy("start").collect()
    own = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert 50256 in own and {x["doc_tokens"] for x in r} == {len(own)}
    for x in r:
        assert x["ids_crc32"] == zlib.crc32(np.array(own[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
