import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe

from .conftest import LONG, ODD_ROWS


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_matches_the_library(documents, texts, library):
    of = {r.doc_id: r for r in bpe.round_trip_digests(documents).collect()}
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = of[key]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(library):
    codec = bpe.codec(bpe.default_vocabulary())
    samples = [t or "" for _, t in ODD_ROWS] + ["'s'll' I've   x", "x" * 700 + " " * 300, "½²٣ ٤x", "á é", "<|endoftext|><|endoftext|>x <|endof", "\r\n\r\n  a", "日本語テキスト", "naïve _under_ __x1__", "\x85\x1c\x1f a", "ſ ’ŉ K", LONG[:3000]]
    for text in samples:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_random_texts(library):
    codec, r = bpe.codec(bpe.default_vocabulary()), random.Random(5)
    alphabet = "abcdefgh THE 0123456789 .,;'-\n\tßéü中😀‍̀<|>"
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 60)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    for _ in range(300):
        text = "".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x250, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(40))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_character_is_split_like_the_library(library):
    """Behind a letter, a number and a sign, in blocks."""
    codec = bpe.codec(bpe.default_vocabulary())
    points = [c for c in range(1, 0x33480) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)} 1{chr(c)} #{chr(c)}" for c in points[at : at + 4096])
        words = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert codec.words(text) == words


def test_long_words_merge_alike():
    codec, r = bpe.codec(bpe.default_vocabulary()), random.Random(9)
    for n in (3, 40, 200, 255):
        word = bytes(r.choice(b"etaoinshr ") for _ in range(n))
        whole = codec._merge_long(word)
        assert whole == codec.merge_word(word) and b"".join(codec.tokens[i] for i in whole) == word


def test_round_trip_and_odd_rows(odd, empty):
    got = bpe.round_trip_digests(odd).collect()
    assert len(got) == odd.count()
    back = bpe.decode_documents(bpe.encode_documents(odd))
    # � appears only where a text isn't whole UTF-8; these are
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((k, t or "")) for k, t in ODD_ROWS)
    assert bpe.round_trip_digests(empty).collect() == []
