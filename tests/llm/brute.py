"""Brute-force versions for the pipeline's test."""

import public_tokenizers as P
from test_shingles import brute_firsts  # noqa: F401
from test_substrings import brute_words  # noqa: F401
from test_tokens import check_packing  # noqa: F401
from tokenizers import Tokenizer

_tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(text):
    return _tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
