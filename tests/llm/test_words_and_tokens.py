import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from geoloom.llm import packing, tokencount, wordstream

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a", "A b\tc\nd  e", "x" * 5000, "ein Wörtchen  über\x0bÄrger", "same same same", "\n\n"]


def _python_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def test_words_are_those_of_a_regular_expression():
    for _, _, words in wordstream.chunks(pa.array([*TEXTS, None]), wordstream.SPACED):
        for d, text in enumerate([*TEXTS, ""]):
            own = [words.data[a:b].tobytes() for a, b in zip(words.start[words.first[d] : words.first[d + 1]], words.end[words.first[d] : words.first[d + 1]], strict=True)]
            assert own == _python_words(text)


def test_hashes_tell_words_apart_and_fold_case():
    some = [f"w{i}" for i in range(3000)] + ["Abc", "aBC", "é", "É"]
    _, _, words = next(wordstream.chunks(pa.array([" ".join(some)]), wordstream.SPACED))
    h = words.hashes()
    assert len(set(h[:3000].tolist())) == 3000
    assert h[3000] == h[3001] and h[3002] != h[3003]


def test_shingles_of_few_words_are_one():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(wordstream.shingles(h, 5)) == 3
    assert len(wordstream.shingles(h[:3], 5)) == 1
    assert len(wordstream.shingles(h[:0], 5)) == 0
    assert wordstream.shingles(h[:3], 5)[0] not in wordstream.shingles(h, 5)


def _random_texts(n):
    rnd = random.Random(5)
    alphabet = [chr(i) for i in range(0x250)] + list("  \n\t'’stredlvm0123²½Ⅷ漢字かな😀​　\x1c\x85") + ["<|endoftext|>", " don't", "'ll", "   "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_counts_and_ids_are_the_librarys():
    library, count, ids = Tokenizer.from_file(PATH), tokencount.counter(PATH), packing.ids_of(PATH)
    for text in [*TEXTS, *_random_texts(1500)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert count.count(text) == len(want), text
        assert np.frombuffer(ids.of(text), dtype="<u4").tolist() == want, text


def test_token_counts_of_a_table(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b <|endoftext|>", 9), (3, "a b <|endoftext|>", 9), (4, "word " * 600, 9)], "doc_id long, text string, n_tokens int")
    rows = sorted(tokencount.token_counts(docs, PATH).collect())
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows[:4]] == [(1, 0, 0, False), (2, 0, 0, False), (3, 17, 4, False), (3, 17, 4, False)]
    assert rows[4].over_limit and rows[4].n_bytes == 3000
    assert tokencount.token_counts(docs.limit(0), PATH).count() == 0
