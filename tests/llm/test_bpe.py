"""Against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from hashloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(open(PATH, encoding="utf-8").read())


def check(df, library):
    done = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    want = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()), key=str)
    got = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in done), key=str)
    assert got == want
    decoded = sorted((str(r.doc_id), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in done)
    assert decoded == sorted((str(d), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for d, ids in want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in done)


def test_documents(documents, library):
    check(documents, library)


def test_odd(odd, nobody, empty, library):
    check(odd.unionByName(nobody), library)
    assert bpe.encode(empty, PATH).count() == 0


def test_any_text(own, library):
    rng = random.Random(5)
    alphabet = ["the", "ing", "a", "b", "'s", "'LL", "'", "Σ", "ΑΣ", "İ", "é", "é", "漢", "🙂", "‍", "\x1c", "\x85", "\xa0", "　", "\x00", "1", "½", "٣", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", ".", ",", "...", "ﬁ", "Å", "ß", "ǅ", "﻿", "­", "가", "ᄀ", "ᅡ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(60)) if not 0xD800 <= c < 0xE000) for _ in range(1500)]
    texts += ["".join(rng.choice("aeioustrnbl") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_character(own, library):
    """Each code point between letters and before a stop."""
    texts = [f"a{chr(c)}b." for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(texts[lo : lo + 500]) for lo in range(0, len(texts), 500)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:20]
