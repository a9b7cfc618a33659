"""Merge agendas and sentencepiece encoding, against plain merging and the library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.llm import merge_agenda, queries, sentence_pieces
from flowscope.llm.queries import vocabulary

PIECES = vocabulary("piece_bpe_32k.model")
ODD = ["a", "The ", "  ", "\n", "\t", "\x1c", "▁", "é", "É", "é", "́", "Σ", "İ", "<|endoftext|>", "<s>", "</s>",
       "<0x41>", "'s", "1", "!!", "​", "日本", "x" * 50, "\x00", "　", "😀", " ", ". ", ",\n", "J̌", "ﬁ", ""]


def odd_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        some = rng.sample(ODD, rng.choice([4, 10, len(ODD)]))
        yield "".join(rng.choices(some, k=rng.choice([0, 1, 3, 10, 60, 700])))


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def merged_plainly(pairs, word):
    """Scan for the pair of the smallest rank, the leftmost of equals, and merge it, until none is left."""
    word = [*word]
    while True:
        found = [(pairs[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in pairs]
        if not found:
            return word
        _, i = min(found)
        word[i:i + 2] = [pairs[word[i], word[i + 1]][1]]


@pytest.mark.parametrize("seed", range(4))
def test_agenda_merges_like_a_scan(seed):
    """Random pairs, with equal ranks, also of symbols that are made later by a better pair."""
    rng = random.Random(seed)
    pairs = {
        (rng.randrange(30), rng.randrange(30)): (rng.randrange(12), rng.randrange(30)) for _ in range(300)}
    agenda = merge_agenda.Agenda(pairs)
    words = [rng.choices(range(32), k=rng.choice([0, 1, 2, 5, 9, 17, 40, 64, 65, 200])) for _ in range(400)]
    got, counts = agenda.merge(np.array(sum(words, []), np.int32), np.array([*map(len, words)]))
    want = [merged_plainly(pairs, w) for w in words]
    assert counts.tolist() == [*map(len, want)]
    assert got.tolist() == sum(want, [])
    assert [agenda.merge_one(w) for w in words] == want


def test_ids_and_texts_are_the_librarys(monkeypatch):
    """With a store that holds everything, and with one that is cleared for every slice."""
    model, texts = library(), ["", *odd_texts(1_500, 1)]
    want = model.encode(texts)
    for words in (1_000_000, 1):
        monkeypatch.setattr(sentence_pieces, "STORE_WORDS", words)
        own = sentence_pieces.Pieces(PIECES)
        for i in range(0, len(texts), 400):
            ids, counts = own.encode(texts[i:i + 400])
            assert ids.tolist() == sum(want[i:i + 400], [])
            assert counts.tolist() == [*map(len, want[i:i + 400])]
            assert own.decode(ids, counts).to_pylist() == model.decode(want[i:i + 400])


def test_any_ids_decode_like_the_library():
    """Control and unknown tokens, broken characters, several spaces in front."""
    rng, model, own = random.Random(2), library(), sentence_pieces.Pieces(PIECES)
    ids = [[rng.choice([rng.randrange(32_000), rng.randrange(260), 259, 29871]) for _ in range(rng.randrange(6))]
           for _ in range(5_000)]
    got = [own.decode(np.array(x, np.int64), np.array([len(x)])).to_pylist()[0] for x in ids]
    assert got == model.decode(ids)
    valid = [x for x, t in zip(ids, got) if "�" not in t]
    flat = own.decode(np.array(sum(valid, []), np.int64), np.array([*map(len, valid)]))
    assert flat.to_pylist() == model.decode(valid)


@pytest.mark.parametrize("text", ["x" * 100_000, "日本語" * 30_000, " " * 20_000, "\n" * 20_000, "😀" * 5_000])
def test_long_unbroken_texts(text):
    ids, counts = sentence_pieces.pieces(PIECES).encode([text])
    assert ids.tolist() == library().encode(text)


def test_a_difference_from_the_library_raises(monkeypatch):
    own = sentence_pieces.Pieces(PIECES)
    own.ids = own.ids.copy()
    own.ids[own.ids == library().piece_to_id("▁the")] = 5
    with pytest.raises(RuntimeError):
        own.encode(["in the end"])


def test_encode_on_odd_rows(spark):
    """Null and empty texts, repeated rows, null keys, clashing names, small output batches, no rows."""
    texts = [None, "", *odd_texts(60, 3), "long word " * 40_000]
    rows = [(i if i else None, t, "clash", "clash", 1) for i, t in enumerate(texts + texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids string, decoded int")
    got = sentence_pieces.encode(docs, PIECES)
    assert got.columns == ["doc_id", "ids", "decoded"]
    model = library()
    want = [(i, model.encode(t or ""), model.decode(model.encode(t or ""))) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sentence_pieces.encode(docs.limit(0), PIECES).collect() == []
    again = sentence_pieces.decode(got.unionByName(got.limit(1).withColumn("ids", F.lit(None))), PIECES).collect()
    assert sorted(map(str, [r.decoded for r in again])) == sorted(map(str, [w[2] for w in want] + [None]))


def test_query_of_pieces(spark, tmp_path):
    texts = [None, "", *odd_texts(40, 4)]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_sentence_pieces(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    model = library()
    want = set()
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids))]
        want.add((i, len(ids), *digests))
    assert {tuple(r) for r in got.collect()} == want
