"""Alignment of two tokenizers, against the libraries and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.llm import queries, token_alignment
from flowscope.llm.queries import vocabulary

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["a", "The ", "  ", "\n", "\t", "\x1c", "\x85", "é", "É", "é", "́", "Σ", "İ", "<|endoftext|>", "<s>", "</s>",
       "<0x41>", "'s", "'S", "I've ", "1", "12ab", "!!", "​", "日本", "x" * 50, "\x00", "　", "😀", " ", ". ", ",\n",
       "ﬁ", "ǅ", "×", "ª", "ɏ", "don't", " in the", " of", "-", "_a"]


def odd_texts(n, seed, marks=ODD):
    rng = random.Random(seed)
    for _ in range(n):
        some = rng.sample(marks, rng.choice([4, 10, len(marks)]))
        yield "".join(rng.choices(some, k=rng.choice([0, 1, 3, 10, 60, 500])))


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECES)


def plainly(texts):
    """Per text: tokens, groups and links, straight from the libraries and the contract."""
    a, b = libraries()
    letters = token_alignment.byte_letters()
    found = []
    for text in texts:
        if not text:
            found.append(([], [], [], []))
            continue
        a_ids = a.encode(" " + text, add_special_tokens=False).ids
        b_ids = b.encode(text)
        a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in b_ids]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        a_ends, b_ends = ([int(x) for x in np.cumsum([len(t) for t in some])] for some in (a_bytes, b_bytes))
        both = sorted(set(a_ends) & set(b_ends))
        groups, begin = [], 0
        for end in both:
            groups.append((
                [i for i, e in zip(a_ids, a_ends) if begin < e <= end], [i for i, e in zip(b_ids, b_ends) if begin < e <= end]))
            begin = end
        place_a, place_b = dict(zip(a_ends, a_ids)), dict(zip(b_ends, b_ids))
        found.append((a_ids, b_ids, groups, [(place_a[e], place_b[e]) for e in both]))
    return found


def expected(texts):
    found = plainly(texts)
    counts = Counter(link for *_, links in found for link in links)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    for a_ids, b_ids, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a_ids), len(b_ids), len(groups), len(links), text, sum(counts[x] for x in links),
               sum(counts[x] == highest[x[1]] for x in links))


def test_words_align_like_the_libraries():
    """Facts, links and group texts of odd texts, also with a store that is cleared every time."""
    texts = ["", *odd_texts(700, 1), "▁", "a ▁ b"]
    want = plainly(texts)
    for words in (1_000_000, 1):
        token_alignment.STORE_WORDS, before = words, token_alignment.STORE_WORDS
        try:
            own = token_alignment.Aligner(BYTES, PIECES)
            for i in range(0, len(texts), 150):
                facts, links, which, groups = own.align(texts[i:i + 150])
                part = want[i:i + 150]
                assert facts.tolist() == [[len(a), len(b), len(x)] for a, b, _, x in part]
                assert which.tolist() == [n for n, p in enumerate(part) for _ in p[3]]
                place = {int(p): b for b, p in enumerate(own.place)}
                got = [(int(x) % own.a.size, place[int(x) // own.a.size]) for x in links]
                assert got == [x for *_, some in part for x in some]
                assert groups.to_pylist() == [
                    ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in p[2]) for p in part]
        finally:
            token_alignment.STORE_WORDS = before


def test_plain_words_are_cut_like_the_library():
    """Every character that the pattern knows, in many neighbourhoods."""
    rng, own = random.Random(4), token_alignment.ByteLevel(BYTES)
    known = [chr(c) for c in range(0x21, 0x250) if token_alignment._PLAIN.fullmatch(chr(c))]
    marks = known + ["'s", "'t", "'re", "'ve", "'ll", "'", "0", "9", "a", "Z", "`", "{", "~", "!"] * 20
    words = known + ["".join(rng.choices(marks, k=rng.randrange(1, 12))) for _ in range(6_000)]
    ids, counts = own.plain(words)
    want = own.odd(words)
    assert counts.tolist() == [*map(len, want)]
    assert ids.tolist() == sum(want, [])


@pytest.mark.parametrize("frame", [3, 65_536])
def test_runs_merge_to_counts(monkeypatch, frame):
    """Sorted runs hold every record once, and a merge of many counts each pair, with codes across frames."""
    monkeypatch.setattr(token_alignment, "FRAME", frame)
    rng = np.random.default_rng(1)
    bits, part, runs, counts = 20, 40, {}, Counter()
    for _ in range(9):
        codes = rng.integers(0, part * token_alignment.RADIX, 500) ** 2 // (part * token_alignment.RADIX)
        docs = rng.integers(0, 30, 500)
        counts.update(codes.tolist())
        records = Counter(zip(codes.tolist(), docs.tolist()))
        seen = {}
        for radix, run in token_alignment.runs_of((codes << bits) | docs, bits, part):
            runs.setdefault(radix, []).append(run)
            for own, sizes, own_docs, links in token_alignment.frames(run):
                assert set(own // part) <= {radix}
                for c, d, n in zip(np.repeat(own, sizes).tolist(), own_docs.tolist(), links.tolist()):
                    seen[c, d] = n
        assert seen == records
    got, order = Counter(), []
    for radix in sorted(runs):
        for codes, links in token_alignment.merge_runs(runs[radix]):
            order += codes.tolist()
            got.update(dict(zip(codes.tolist(), links.tolist())))
    assert got == counts
    assert order == sorted(set(order))


def test_align_against_plain_counting(spark, monkeypatch):
    """Null and empty texts, repeated rows and keys, clashing names, copies, several tasks, lots and runs."""
    texts = [None, "", *odd_texts(150, 6), "▁ no tokens", "one\n" * 300, "x" * 30_000, "日本語" * 3_000]
    texts += ["the same line of the table"] * 60
    rows = [(i if i % 7 else None, t, 1, "clash", 2.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int, groups string, run double").repartition(9)
    got = token_alignment.align(docs, BYTES, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "count_sum", "n_best"]
    want = [(r[0], *w) for r, w in zip(rows, expected(texts))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_small_runs_give_the_same(spark, monkeypatch):
    """Runs of a few links, written by one task in this process, merge to the same counts."""
    monkeypatch.setattr(token_alignment, "RUN_LINKS", 50)
    monkeypatch.setattr(token_alignment, "SLICE_TEXTS", 3, raising=False)
    texts = [*odd_texts(40, 8)]
    own = token_alignment.Aligner(BYTES, PIECES)
    runs, docs = {}, []
    for i in range(0, len(texts), 5):
        _, links, which, _ = own.align(texts[i:i + 5])
        docs.append(len(links))
        for radix, run in token_alignment.runs_of((links << own.doc_bits) | which, own.doc_bits, own.part * own.a.size):
            runs.setdefault(radix, []).append(run)
    counts = Counter(x for *_, links in plainly(texts) for x in links)
    place = {int(p): b for b, p in enumerate(own.place)}
    got = {}
    for some in runs.values():
        for codes, links in token_alignment.merge_runs(some):
            got |= {(c % own.a.size, place[c // own.a.size]): n for c, n in zip(codes.tolist(), links.tolist())}
    assert got == counts and sum(docs) == sum(counts.values())


def test_no_rows_and_no_tokens(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(none, BYTES, PIECES).collect() == []
    empty = spark.createDataFrame([(1, None), (1, ""), (2, "▁")], "doc_id int, text string")
    got = token_alignment.align(empty, BYTES, PIECES).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, "", 0, 0)] * 2 + [(2, 0, 0, 0, 0, "", 0, 0)]


def test_query_of_alignment(spark, tmp_path):
    texts = [None, "", *odd_texts(50, 9)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    frame.withColumn("lang", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_token_alignment(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
        "groups_sha256": "string", "count_sum": "bigint", "n_best": "bigint"}
    want = {
        (i, a, b, g, n, hashlib.sha256(text.encode()).hexdigest() if text else "", s, best)
        for i, (a, b, g, n, text, s, best) in enumerate(expected(texts))}
    assert {tuple(r) for r in got.collect()} == want
