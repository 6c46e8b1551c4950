import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from brassloom.llm.op10_bpe import default_path, digests, encode_column, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_ids_equal_the_library_on_random_texts(library):
    bpe, r = vocabulary(default_path()), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz'  0123!?.#éßİΣσ中文한́̀\t\n\x1c\x85\xa0😀<|>ﬁ"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        if r.random() < 0.2:
            text = r.choice("abx!é") * r.randint(1, 300) + text
        if r.random() < 0.1:
            text = f"<|endoftext|>{text}<|startoftext|>"
        want = library.encode(text, add_special_tokens=False).ids
        assert list(bpe.encode(text)) == want
        assert bpe.decode(want) == library.decode(want, skip_special_tokens=False)


def test_digests_of_edge_cases(spark, library):
    texts = [None, "", "   \n", "Hello it's", "Hello it's", "x" * 150_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    for row in digests(docs).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert digests(docs.limit(0)).collect() == []
    out = encode_column(docs).collect()
    assert list(out[3].ids) == library.encode("Hello it's", add_special_tokens=False).ids
    assert out[3].n_tokens == 1
