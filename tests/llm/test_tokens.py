"""Token operators against the libraries that define them."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from listing_lifecycle_spark.llm import bpe  # noqa: E402
from listing_lifecycle_spark.llm.bpe import decode, encode, round_trip  # noqa: E402
from listing_lifecycle_spark.llm.token_counts import count_tokens, vocabulary  # noqa: E402
from tests.llm.conftest import ODD  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    random.seed(3)
    alphabet = list("aabcdeestrlmvd'''  \n\t\r 019é²½ 　ßЖ中文！!.,#🙂́\x1c\x85")
    return ["".join(random.choices(alphabet, k=random.randint(0, 80))) for _ in range(n)]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_random_texts_encode_as_the_library_does():
    texts, library = random_texts(4000), tiktoken_encoding()
    coded = list(bpe._encode(iter([batch(texts)]), RANKS))
    assert [x for b in coded for x in b.column(1).to_pylist()] == [library.encode_ordinary(t) for t in texts]
    assert [x for b in bpe._decode(iter(coded), RANKS) for x in b.column(2).to_pylist()] == [t.encode() for t in texts]


def test_encode_and_decode_odd_rows(texts_table):
    library = tiktoken_encoding()
    rows = decode(encode(texts_table(ODD), RANKS), RANKS).collect()
    got = sorted(((r.doc_id or 0), hashlib.md5(bytes(r.decoded)).hexdigest(), list(r.ids)) for r in rows)
    assert got == sorted(((i or 0), hashlib.md5((t or "").encode()).hexdigest(), library.encode_ordinary(t or "")) for i, t in ODD)
    assert sorted(map(str, round_trip(texts_table(ODD), RANKS).collect())) == sorted(map(str, rows))
    assert encode(texts_table([]), RANKS).count() == 0


def test_long_pieces_equal_the_matrix():
    model = bpe.ranks(RANKS)
    for piece in (b"a" * 700, b"the" * 300, bytes(random.Random(5).choices(b"etaoinshr", k=900))):
        ids = model.byte[np.frombuffer(piece, np.uint8)]
        (_, matrix), = bpe.merge_matrix(ids[None, :].astype(np.int32), model.pairs)
        assert bpe.merge_long(ids.tolist(), model.pairs) == matrix[0].tolist()


def test_memory_may_forget(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts, library = random_texts(60), tiktoken_encoding()
    model = bpe.Ranks(RANKS)
    monkeypatch.setattr(bpe, "ranks", lambda path: model)
    coded = [b for t in texts for b in bpe._encode(iter([batch([t])]), RANKS)]
    assert [x for b in coded for x in b.column(1).to_pylist()] == [library.encode_ordinary(t) for t in texts]


def test_counts_equal_the_library(texts_table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = ODD + [(100 + i, t) for i, t in enumerate(random_texts(400))] + [(900, "a<|endoftext|>" * 400)]
    got = sorted(map(tuple, ((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(texts_table(rows), JSON).collect())))
    want = [(i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want)
    assert count_tokens(texts_table([]), JSON).count() == 0


def test_whole_tokens_are_proven():
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(JSON), vocabulary(JSON)
    assert len(model.whole) > 40_000
    for token in sorted(model.whole)[::997]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert len(library.encode(text, add_special_tokens=False).ids) == 1
