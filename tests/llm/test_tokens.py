import base64
import random

import pytest

from strandmill.llm.tokens import PRE_TOKEN, Encoder, PerfectHash, encoded

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = {str(i).encode() * (i % 3 + 1): i for i in range(3000)}
    table = PerfectHash(keys)
    assert sorted(table.place(k) for k in keys) == list(range(len(keys)))
    assert all(table.get(k) == v for k, v in keys.items())
    assert table.get(b"absent") is None and table.get(b"") is None


def test_equals_a_known_encoder(path, known):
    assert PRE_TOKEN == P.PATTERN
    rng = random.Random(1)
    own = Encoder(path)
    scripts = ["abcdefg   .,'!", "äöüßéèêñ ", "абвгдежз ", "漢字仮名カナ。、", "กขคงจฉ ", "काखी ", "0123456789 -", "\n\t ​　", "👍🏽🎉"]
    texts = ["", " ", "  a", "<|endoftext|> it's", "a" * 3000, "  \n\n  x  "]
    texts += ["".join(rng.choice(rng.choice(scripts)) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    texts += ["".join(rng.choice(s) for _ in range(120)) for s in scripts]
    for text in texts:
        assert own.text(text).tolist() == known.encode_ordinary(text)


def test_null_empty_and_repeated_rows(spark, path):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello hello", None), (3, "hello hello", None), (None, "a", "")], "doc long, body string, ids string")
    rows = [(r["doc"], r["ids"]) for r in encoded(df, "doc", "body", path).collect()]
    assert sorted(rows, key=repr) == sorted([(1, []), (2, []), (3, [31373, 23748]), (3, [31373, 23748]), (None, [64])], key=repr)
    assert encoded(df.limit(0), "doc", "body", path).count() == 0
