import hashlib
import random

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from shelfspark.llm import _text, _vocab, bpe, packing
from shelfspark.llm._vocab import Merges, Vocabulary

ODD = [
    "it's we've they'll I'd 'tis ''s 's' x's1 don't  a'b 'S 'RE l'été", "Σίσυφος ΟΔΟΣ İstanbul ß ﬁ é é", "<|endoftext|> hi <|startoftext|>there", "", None, "   ", "a b　c\x1cd\x85e",
    "123 ½ Ⅷ ٣ 4.5", "日本語テスト한국어", "a" * 3000, "​x﻿", "x\u0000y", "🙂🙂 👨‍👩‍👧", "don’t", "a'", "'", "'s", "'l", "'ll", "'re'd'xx", "Å ǅ ΐ", "𐐀𐐁 𝒜", "\n\n a\n \nb  \n",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("a'stredvlm 1.\n\té'Σ<|") for _ in range(r.randint(0, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(bpe.byte_tokenizer())


@pytest.fixture(scope="module")
def lexicon():
    words = sorted({w.encode() for w in (" the", " of", "the", " then", "\n", " that", " hat", "at", "é", " it")})
    return bpe.Lexicon(bpe.compile_lexicon(zip(words, Merges(bpe.byte_tokenizer()).encode(words)))), words


def test_encode_decode(texts, byte_bpe, lexicon):
    path = bpe.byte_tokenizer()
    ids, of = bpe.encode(texts, path, lexicon[0])
    back, digits = bpe.decode(ids, of, path), bpe.decimals(ids, of, path)
    for i, t in enumerate(texts):
        want = byte_bpe.encode(t or "", add_special_tokens=False).ids
        assert ids[of[i] : of[i + 1]].tolist() == want, t
        assert back[i].decode() == byte_bpe.decode(want, skip_special_tokens=False) and digits[i].decode() == ",".join(map(str, want))


def test_lexicon(lexicon):
    lex, words = lexicon
    asked = [*words, b"", b" t", b"th", b"x", b" thenn", b" hats", b"\xff" * 100]
    assert lex.numbers(asked).tolist() == [*range(len(words)), *[-1] * 7]
    for i, w in enumerate(words):
        assert lex.ids[lex.start[i] : lex.start[i + 1]].tolist() == Merges(bpe.byte_tokenizer()).encode([w])[0]
    # suffixes are shared: "at" of " that", " hat" and "at" is one path
    assert len(lex.final) < 1 + sum(map(len, words))
    assert bpe.Lexicon(bpe.compile_lexicon([])).numbers([b"a", b""]).tolist() == [-1, -1]


def test_merges_are_exact_for_corpus_words(spark, sf_dir, byte_bpe):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = sorted({w for t in texts for w in regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", t)})
    assert Merges(bpe.byte_tokenizer()).encode([w.encode() for w in words]) == [e.ids for e in byte_bpe.encode_batch(words, add_special_tokens=False)]


def test_word_tokenizer(texts):
    path = packing.word_tokenizer()
    t = Tokenizer.from_file(path)
    ids, of = packing.tokenised(texts, path)
    for i, x in enumerate(texts):
        assert ids[of[i] : of[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_query(awkward, empty, byte_bpe):
    df, texts = awkward
    want = {}
    for d, t in texts:
        ids = byte_bpe.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(byte_bpe.decode(ids, skip_special_tokens=False)))
    got = bpe.coded(df).collect()
    assert len(got) == len(texts) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert bpe.coded(empty).collect() == []


def test_a_worker_remembers_few_words(monkeypatch):
    """Also where hashes agree, words are told apart by their bytes."""
    merges, r = Merges(bpe.byte_tokenizer()), random.Random(2)
    for bits in (64, 6):
        v = Vocabulary(merges, most=1000)
        monkeypatch.setattr(_vocab, "spans", lambda *a, b=bits: _text.spans(*a) >> np.uint64(64 - b))
        for _ in range(20):
            words = [*{f" w{r.randrange(4000)}".encode() for _ in range(700)}, b"long" * 100, b"a", b" ", b"long" * 100 + b"x"]
            r.shuffle(words)
            ends = np.cumsum([len(w) for w in words])
            ids, n = v(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == merges.encode(words)
            assert v.n <= 1700


def test_words_with_equal_polynomial_hashes():
    """Two words of 1,024 letters whose sums of powers modulo 2**64 agree whatever the base."""
    odd = lambda i: bin(i).count("1") % 2
    a, b = ("".join("ab"[odd(i) ^ k] for i in range(1024)) for k in (0, 1))
    for path, encode in ((bpe.byte_tokenizer(), lambda t, p: bpe.encode(t, p)), (packing.word_tokenizer(), packing.tokenised)):
        t = Tokenizer.from_file(path)
        ids, of = encode([a, b, f"{a} {b}"], path)
        assert [ids[x:y].tolist() for x, y in zip(of[:-1], of[1:])] == [t.encode(x).ids for x in (a, b, f"{a} {b}")]


def test_every_code_point():
    """Each code point beside letters, digits, spaces and itself, as both tokenizers have it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}\n" for c in points[i : i + 512]) for i in range(0, len(points), 512)]
    for path, encode in ((bpe.byte_tokenizer(), lambda t, p: bpe.encode(t, p)), (packing.word_tokenizer(), packing.tokenised)):
        t = Tokenizer.from_file(path)
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            ids, of = encode(some, path)
            for i, x in enumerate(t.encode_batch(some, add_special_tokens=False)):
                assert ids[of[i] : of[i + 1]].tolist() == x.ids, hex(points[(at + i) * 512])
