"""Ids by pieces and parts against the tokenizer's own encoding of the whole text."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from rfcover.llm import tokens  # noqa: E402


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("entries", [60, 600_000])
def test_pieces_equal_whole_texts(name, entries, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", entries)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    draw = random.Random(11)
    # letters that grow or compose in lower case, contractions, marks, digits, special tokens' letters
    letters = "aAbZsStTdDÉéßÿÀ×÷²µªİ'''’.,:;<|>$09́ \nendoftextll"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "<|ENDOFTEXT|> x", "a<|endoftext|>b", "It'S don''s 'Tis we'll", "ΑΣ ΣΑΣ", "x" * 5000, "token=AbC123-_é,"]
    texts += texts[:50]
    got = [ids for at in range(0, len(texts), 100) for ids in encoder.encode(texts[at : at + 100])]
    assert got == encoder._ids(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_plain_words_are_learned_by_parts(name, monkeypatch):
    encoder = tokens.Encoder(public_tokenizers.path(name))
    marks = [a + b for a in ".,:;!?" for b in ("", ")", "'", '"')]
    texts = [" ".join(f"plain{chr(97 + n % 26)}{chr(97 + n // 26)}{mark}" for mark in marks) for n in range(100)]
    want = encoder._ids(texts)
    monkeypatch.setattr(encoder, "_ids", lambda texts: pytest.fail("plain words went to the whole tokenizer"))
    assert encoder.encode(texts) == want
    # words (with and without a space) and marks once each, not every word with every mark
    assert len(encoder.memo) <= 200 + len(marks)


def test_kinds_of_parts_are_held_against_their_bytes(monkeypatch):
    words = ["a" * n + end for n in (1, 7, 8, 9, 16, 255, 400) for end in ("", "b", "c")] * 3
    data = tokens.np.frombuffer("".join(words).encode(), tokens.np.uint8)
    end = tokens.np.cumsum([len(x) for x in words])
    start = end - [len(x) for x in words]
    for shared in (False, True):
        if shared:  # one hash for all
            monkeypatch.setattr(tokens, "mix", lambda x: x * tokens.np.uint64(0))
        first, kind = tokens._kinds(data, start, end)
        assert [words[i] for i in first[kind]] == words
