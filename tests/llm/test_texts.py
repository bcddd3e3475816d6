"""Words of texts, token ids and token counts."""

import random
import re

import pyarrow as pa
import pytest

from parcelframe.llm import bpe, textarrays as T, token_counts

from .conftest import clash, docs_of

ODD = ["", None, "Hello, WORLD ñandú 12x", "a" * 5000 + " b c " + "d" * 3000, " ", "x y", "x  y\tx", "Ω≈ç√ <|endoftext|> it's"]


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
@pytest.mark.parametrize("keep,pattern", [(T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (T.NONSPACE, r"[^\x20\x09-\x0D]+")])
def test_words_as_by_pattern(size, keep, pattern):
    lower = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)
    got, per = [], [0] * len(ODD)
    for data, cuts, doc in T.slices(pa.array(ODD), keep, size):
        starts, ends, n = T.words(data, cuts, keep)
        got += [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
        for d, k in zip(doc, n):
            per[d] += int(k)
        for h, a, b in zip(T.hashes(data, starts, ends)[0], starts, ends):
            assert int(h) == T.word_hash(bytes(data[a:b]).decode())
    want = [re.findall(pattern, lower(t or "")) for t in ODD]
    assert got == sum(want, []) and per == [len(w) for w in want]


def test_ids_equal_the_library():
    e, rng = bpe.encoder(bpe.vocabulary()), random.Random(2)
    parts = list("ab  \n\t'sré1! 　 é\x85\x1cñ") + ["<|endoftext|>", "'ll", "\r\n", "日本", "😀", "²", "aaaa", "----", "tion"]
    texts = ODD[:-1] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    for t, ids in zip(texts, e.ids(texts)):
        assert ids.tolist() == (e.library.encode(t, add_special_tokens=False).ids if t else [])


def test_ids_of_whole_documents(spark):
    e = bpe.encoder(bpe.vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t, ids in zip(texts, e.ids(texts)):
        assert ids.tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_token_cache_encodes_each_digest_once(spark, tmp_path):
    path, e = str(tmp_path / "cache"), bpe.encoder(bpe.vocabulary())
    first = clash(docs_of(spark, ["one two", "one two", None, "", "long " * 600], ids=[1, 2, 3, 4, None]))
    got = {r.doc_id: r for r in token_counts.count_tokens(first, path).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[1].n_tokens == got[2].n_tokens == 2 and got[3].n_tokens == got[4].n_bytes == 0
    assert got[None].over_limit and not got[1].over_limit
    assert got[None].n_tokens == len(e.library.encode("long " * 600, add_special_tokens=False).ids)
    assert spark.read.parquet(path).count() == 3
    again = docs_of(spark, ["one two", "three"], ids=[8, 9])
    assert token_counts.count_tokens(again, path).count() == 2
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("digest").distinct().count() == 4  # one new text
    assert token_counts.count_tokens(again.limit(0), path).count() == 0


def test_cache_of_another_tokenizer_is_not_used(spark, tmp_path):
    path, docs = str(tmp_path / "cache"), docs_of(spark, ["some text"])
    token_counts.fill_cache(docs, path)
    token_counts.fill_cache(docs, path, "word_bpe_49k.json")
    assert spark.read.parquet(path).select("tokenizer").distinct().count() == 2
