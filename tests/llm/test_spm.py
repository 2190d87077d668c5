import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import spm

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def bpe():
    return spm.Vocabulary.load(PATH)


def texts():
    rng = random.Random(2)
    parts = ["hello", "World", "  ", " ", "\n", "▁", "é", "中文", "😀", "12345", "ion", "the", "<s>", "<0x41>", "\x00", "ａ", "​", "x" * 50, "ab" * 30, "!!!", "'re", "ungkeit", "     "]
    return ["", " ", "a", "▁▁", "x" * 3000, *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400))]


def test_merges_match_the_library(bpe):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    work = spm.Encoder(bpe)
    given = texts()
    found = work.encode([*given, None])
    assert found[-1] is None
    for t, ids in zip(given, found):
        assert ids.tolist() == library.encode(t), repr(t)
    assert work.decode(found)[:-1] == [t.replace("▁", " ") for t in given]


def test_documents_match_the_library(bpe):
    import pyarrow.parquet as pq
    import sentencepiece

    given = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    found = spm.Encoder(bpe).encode(given)
    assert [x.tolist() for x in found] == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(given)


def test_viterbi_matches_every_segmentation():
    rng = random.Random(4)
    pieces = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    words = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(25)} | {"▁", "▁a", "▁bc", "a", "b"}
    pieces += [(w, -rng.random() * 9) for w in sorted(words)]
    vocabulary = spm.Vocabulary(pieces, ["unknown"] + ["byte"] * 256 + ["normal"] * len(words), "unigram")
    work = spm.Encoder(vocabulary)
    given = ["".join(rng.choices("aabbcd ", k=rng.randint(1, 9))) for _ in range(300)]
    scores = dict(pieces[257:])

    def best(text):
        top = -1e18
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(edges)]
            if all(p in scores or len(p) == 1 for p in parts):
                top = max(top, sum(scores.get(p, vocabulary.worst) for p in parts))
        return top

    for t, ids in zip(given, work.encode(given)):
        got = sum(vocabulary.worst if i < 257 else pieces[i][1] for i in ids)
        assert abs(got - best("▁" + t.replace(" ", "▁"))) < 1e-9
    assert work.decode(work.encode(given)) == given


def test_columns(spark, bpe):
    rows = [(1, "hello world"), (1, "hello world"), (2, ""), (3, None), (None, "é 中")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int")
    shared = spm.share(spark, bpe)
    out = spm.encode_documents(docs, bpe).withColumn("back", spm.decode(F.col("ids"), shared)).collect()
    assert [r["back"] for r in out] == [t for _, t in rows]
    both = spm.encode_documents(docs, bpe, ids_col="n_tokens", check_col="same").collect()
    assert [r["n_tokens"] for r in both] == [r["ids"] for r in out] and all(r["same"] for r in both)
    assert out[2]["ids"] == [] and out[3]["ids"] is None
    assert spm.encode_documents(docs.where("false"), bpe).collect() == []
