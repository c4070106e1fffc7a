"""Cached and split encoding against the libraries on random texts."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from spotlake.llm.byte_bpe import ByteBpe
from spotlake.llm.chunks import split_chunks
from spotlake.llm.packing import JsonIds
from spotlake.llm.token_count import PieceCounter

PARTS = st.sampled_from(["the", "Hello", "don't", "l'été", "ß", "日本語", "🎉", "12", "3.5", ".", ",", "!!", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "▁", "▁▁", "<s>", "<|endoftext|>", "_", "''s", "ª", "Ⅷ"])
TEXT = st.lists(PARTS | st.text(max_size=3).filter(lambda s: s.isascii() or s.isprintable()), max_size=25).map("".join)


@cache
def libraries():
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = P.path("piece_bpe_32k.model")
    return (
        (ByteBpe(path, P.PATTERN), plain),
        (JsonIds(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))),
        (PieceCounter(pieces), sentencepiece.SentencePieceProcessor(model_file=pieces)),
    )


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_as_the_libraries(text):
    (bpe, plain), (ids, tokenizer), (count, pieces) = libraries()
    assert np.frombuffer(bpe.text_ids(text), "<u4").tolist() == plain.encode_ordinary(text)
    assert np.frombuffer(ids.text_ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert count(text) == len(pieces.encode(text))


@given(TEXT)
def test_chunks_rebuild_the_text(text):
    chunks = split_chunks(text)
    if chunks is not None:
        assert chunks[0] + "".join(c if c.startswith("\n") else " " + c for c in chunks[1:]) == text
