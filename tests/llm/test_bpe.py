import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
from tidemark.llm.bpe import PrefixEncoder, encode_corpus, read_ranks

FOLDER = "/opt/tokenizers"
TEXTS = [None, "", " ", "\n\n  \t", "It's the nurses' 3rd visit!  ", "Ünïcödé naïve café", "请在20:05之后入住，谢谢。", "👩‍⚕️🇿🇦 ❤️", "<|endoftext|> x", "a" * 3000, " " * 5000, "zero​width­   \x1c\x85", "１２３ ²½ Ⅷ", "é é", "word " * 20_000]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_corpus(spark, reference):
    rnd = random.Random(4)
    pool = [*range(0x20, 0x180), 0x200B, 0x200D, 0x2028, 0xA0, 0x3000, 0xFEFF, 0x301, 0x1F600, 0x4E00, 0x4E8C, 0x663, *b"     \n\n'sretlld"]
    texts = TEXTS + ["".join(chr(rnd.choice(pool)) for _ in range(rnd.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(texts)], "d bigint, body string, ids int, _id string").repartition(3)
    out = encode_corpus(df, "d", "body", f"{FOLDER}/byte_bpe_50k.tiktoken")
    assert out.dtypes == [("d", "bigint"), ("ids", "array<int>")]
    got = {r.d: r.ids for r in out.collect()}
    assert got == {k: reference(t) for k, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "d", "body", f"{FOLDER}/byte_bpe_50k.tiktoken").count() == 0
    assert encode_corpus(df.union(df), "d", "body", f"{FOLDER}/byte_bpe_50k.tiktoken").count() == 2 * len(texts)


def test_shared_prefixes_do_not_matter():
    encoder = PrefixEncoder(read_ranks(open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb").read()))
    words = [b"the", b"them", b"theme", b"there", b" there", b"xx", b"x"]
    together = encoder.encode_all(words)
    for w in words:
        alone = PrefixEncoder(encoder.ranks)
        assert alone.encode(w) == together[w] == [encoder.ranks[p] for p in encoder.merged(w)]
