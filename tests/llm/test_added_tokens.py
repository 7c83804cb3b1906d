import public_tokenizers as P
import tiktoken
from test_tokens import check_packing
from tokenizers import Tokenizer

from inkveil.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "<| endoftext|>", "word " * 1500 + "<|endoftext|> tail", "", None, "<|endoftext|>" * 1100]


def test_added_tokens_have_their_ids(make):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(TEXTS)}
    assert ids[0] == [64, 220, 50256, 275, 2]
    rows = packing.pack(make(TEXTS)).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    check_packing(rows, ids)


def test_texts_without_them_are_as_before(texts):
    path = P.path("byte_bpe_50k.json")
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=packing.json_ranks(path), special_tokens={})
    for x in texts:
        assert packing._encoding(path).encode(x or "", allowed_special="all") == plain.encode_ordinary(x or "")
