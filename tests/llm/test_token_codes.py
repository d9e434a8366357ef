import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomdex.llm import token_codes as T

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=700), st.sampled_from([4, 8, 12]))
def test_codes(ids, width):
    levels = T.pack(np.array(ids, np.uint32), width)
    assert T.unpack(levels, width).tolist() == ids
    for at in {0, len(ids) - 1, len(ids) // 2, min(511, len(ids) - 1), min(512, len(ids) - 1)}:
        assert T.access(levels, at, width) == ids[at]


def brute(texts, ids):
    tok, start, rows = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        got = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((i, start, len(got), zlib.crc32(got.tobytes())))
        start += len(got)
    return rows


def test_files(spark, docs, odd):
    ids = [5 * i for i in range(len(odd))]
    folder, manifest = T.write_codes(docs(odd, ids), PATH, docs_per_shard=4)
    assert manifest.count() > 2
    got = sorted(tuple(r)[:4] for r in T.read_digests(spark, folder, manifest).collect())
    assert got == brute(odd, ids)
    name = manifest.orderBy("shard", "part").first()["name"]
    whole = T.DacFile(T.files.get(folder, name))
    assert [whole.token(i) for i in range(len(whole.ids()))] == whole.ids().tolist()


def test_split_files_null_ids_and_empty(spark, docs, odd):
    folder, manifest = T.write_codes(docs(odd, [None, *range(1, len(odd))]), PATH, file_tokens=50)
    got = [tuple(r)[:4] for r in T.read_digests(spark, folder, manifest).orderBy("start").collect()]
    assert got == brute(odd, [None, *range(1, len(odd))])
    folder, manifest = T.write_codes(docs([]), PATH)
    assert T.read_digests(spark, folder, manifest).count() == 0


#: The normaliser ends the last letter in a combining mark, or a special token's text is spelled in another case.
MARKED = ["ŞİRKETİ. x", "হয়, x", "पहाड़, x", "\ufb2a. x", "a<|ENDOFTEXT|> <|StartOfText|>. X", "<|endoftext|>! END.", "İ. İ, ŞİŞLİ. sonra ÀİSTANBULİ. x\u00a0y\u2028z \u0301a \u0327\u0308 \x85b", "ÉTÉ. Слово, WORD? don'T! it'S."]


def whole(tok, texts):
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def same(tok, texts):
    ids, counts = T.encode_texts(T.Words(tok, T.words_apart(PATH), most=50), pa.array(texts, pa.string()), None)
    want = whole(tok, texts)
    return counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_marks_and_special_tokens_equal_whole_text():
    tok = Tokenizer.from_file(PATH)
    assert T.words_apart(PATH) and same(tok, MARKED)


def test_random_unicode_equals_whole_text():
    tok, rng = Tokenizer.from_file(PATH), random.Random(4)
    letters = "aAzZ019.,;:!?'\"-_<|>\x00\x01\x1c\x85\t\n\r\x0b\x0c  \u00a0\u1680\u2003\u2028\u3000\ufeffİıßſÅÀḑ়়̧́̈ͅহবपाक़ড়\u09df\u095c\ufb2aשׂ각ᄀ각日▁😀Σσς"
    pick = lambda: rng.choice(letters) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xF900, 0x10000), rng.randrange(0x10000, 0x20000)]))
    texts = ["".join(pick() for _ in range(rng.randrange(1, 60))) for _ in range(5000)]
    texts += [" ".join(rng.choice(["it's", "<|ENDOFTEXT|>", "<|endoftext|>.", "İ.", "\x01", "a\x01"]) for _ in range(9)) for _ in range(50)]
    assert same(tok, texts)


def test_other_files_are_encoded_whole(tmp_path):
    """A file whose splitter joins a space to the word after it, and one with a token that takes in white space."""
    byte_level = public.path("byte_bpe_50k.json")
    assert not T.words_apart(byte_level)
    tok, texts = Tokenizer.from_file(byte_level), ["a  b c", "", "İ. x\n\ny"]
    ids, counts = T.encode_texts(T.Words(tok, False), pa.array(texts), 7)
    want = [[*x, 7] for x in whole(tok, texts)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    assert not T.words_apart(str(tmp_path / "t.json"))
