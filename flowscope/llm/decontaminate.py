"""Benchmark passages in documents, found with an FM-index for each shard of documents.

A shard is a run of whole documents of one partition, cut at ``SHARD_WORDS`` words. Its text
is the sequence of their words that occur in the test set; every stretch of other words, and
the end of every document, is one separator, which no test phrase holds. The index of this
sequence is a Burrows-Wheeler transform in a wavelet tree with sampled suffix positions.
Test phrases are searched backwards, all at once: each step narrows the intervals by two
ranks. Occurrences are located by walking back to a sampled position, and the words they
cover are merged into spans.

Shards are independent, so nothing is shuffled: the test set goes to the documents. It is
broadcast in blocks of at most ``BLOCK_WORDS`` words, whatever its size. With more than one
block the rows are numbered and written to the shared folder, and the blocks' results are
put together by that number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.rows import keyed_texts, text_column, whole_rows
from flowscope.sizing import stored

WINDOW = 10
#: words of one shard; a single longer document is a shard by itself
SHARD_WORDS = 250_000
#: words of the test set in one broadcast
BLOCK_WORDS = 1_000_000
#: every so many-th position of a run of words is sampled
SAMPLE_EVERY = 8

#: bytes of words (A-Z as a-z) stay, all others part words
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and all characters beyond ASCII."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Phrases:
    """The windows of a block of test items, as word numbers from 1."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        number = self.vocabulary.setdefault
        for at, (_, text) in enumerate(items):
            ids = tuple(number(w, len(self.vocabulary) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[i:i + window], set()).add(at)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.codes = np.zeros((len(found), window), np.int64)  # right-aligned
        for i, p in enumerate(found):
            self.codes[i, window - len(p):] = p
        self.owners = [sorted(x) for x in found.values()]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions in order of their suffixes. Symbol 0 separates: each one differs from all
    others and sorts before the words, in order of position.

    The first sort takes as many symbols as fit in 63 bits, each further one doubles the
    length by which ties are sorted. Ties end at a separator, so long copies in the same
    shard take few rounds.
    """
    n = len(text)
    bits = max(1, int(symbols).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)  # no separator so far
    for k in range(min(width, n)):
        symbol = np.zeros(n, np.int64)
        symbol[:n - k] = text[k:]
        key = (key << bits) | np.where(open_, symbol, 0)
        open_ &= symbol != 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    # a suffix that has met its separator is unique, ordered by position
    new |= ~open_[order]
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    after = np.append(~new[1:], False)
    tied = np.flatnonzero(~new | after)  # rows of the order
    while len(tied):
        at = order[tied]
        beyond = at + width
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        first = rank[at]
        again = np.lexsort((second, first))
        at, first, second = at[again], first[again], second[again]
        order[tied] = at
        new = np.empty(len(tied), bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        still = ~new
        still[:-1] |= ~new[1:]
        tied = tied[still]
        width *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence: one bit row for each binary digit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols).bit_length())
        self.zeros, self.counts = [], []
        for shift in range(self.bits - 1, -1, -1):
            bit = (sequence >> shift) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.counts.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        # the bottom row is in order of the reversed digits
        begins = np.searchsorted(reversed_digits(sequence, self.bits), np.arange(1 << self.bits))
        self.begins = begins[reversed_digits(np.arange(1 << self.bits), self.bits)]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        at = end
        for level, shift in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.counts[level][at]
            at = np.where((symbol >> shift) & 1, self.zeros[level] + ones, at - ones)
        return at - self.begins[symbol]


def reversed_digits(numbers: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(numbers), np.int64)
    for k in range(bits):
        out |= ((numbers >> k) & 1) << (bits - 1 - k)
    return out


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` begins with a separator."""
        order = suffix_array(text, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.transform = text[order - 1]  # before the first position stands the last symbol
        self.tree = WaveletTree(self.transform, symbols)
        # positions after a separator are sampled too: a walk never has to cross one
        sampled = (order % SAMPLE_EVERY == 0) | (self.transform == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each phrase in the order of suffixes."""
        n = len(self.transform)
        low = np.zeros(len(phrases.lengths), np.int64)
        high = np.full(len(phrases.lengths), n, np.int64)
        window = phrases.codes.shape[1]
        for step in range(window):
            alive = np.flatnonzero((phrases.lengths > step) & (low < high))
            if not len(alive):
                break
            symbol = phrases.codes[alive, window - 1 - step]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the order of suffixes."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found = np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            hit = self.sampled[at + 1] > self.sampled[at]
            found[left[hit]] = self.samples[self.sampled[at[hit]]] + steps[left[hit]]
            left, at = left[~hit], at[~hit]
            symbol = self.transform[at]
            rows[left] = self.first[symbol] + self.tree.rank(symbol, at)
            steps[left] += 1
        return found


#: occurrences located at once
LOCATED = 1_000_000


def search_shard(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[np.ndarray], list[list[int]]]:
    """For each document: its number of words, hit spans (k x 2, in words, merged) and item numbers."""
    get, sizes, parts = phrases.vocabulary.get, [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    ends = np.cumsum(np.array(sizes, np.int64) + 1)  # of each document, in words and separators
    whole = np.concatenate([np.zeros(1, np.int32), *parts])
    kept = (whole != 0) | (np.append(1, whole[:-1]) != 0)  # stretches of others become one separator
    kept[0] = True
    text, places = whole[kept].astype(np.int64), np.flatnonzero(kept) - 1
    spans = [np.zeros((0, 2), np.int64)] * len(texts)
    items: list[list[int]] = [[] for _ in texts]
    if not text.any() or not len(phrases.lengths):
        return sizes, spans, items
    index = FmIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases)
    found = np.flatnonzero(high > low)
    covered = np.zeros(int(ends[-1]) + 1, np.int32)
    pairs: set[tuple[int, int]] = set()
    begin = 0
    totals = np.cumsum(high[found] - low[found])
    while begin < len(found):
        done = totals[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(totals, done + LOCATED, "right")))
        some = found[begin:end]
        counts = high[some] - low[some]
        rows = np.repeat(low[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        at = places[index.locate(rows)]
        lengths = np.repeat(phrases.lengths[some], counts)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + lengths, -1)
        inside = np.searchsorted(ends, at, "right")
        seen = np.unique(np.stack([inside, np.repeat(some, counts)], 1), axis=0)
        pairs.update((int(d), i) for d, p in seen for i in phrases.owners[p])
        begin = end
    hit = (np.cumsum(covered) > 0).astype(np.int8)
    edges = np.diff(np.concatenate([[0], hit, [0]]))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inside = np.searchsorted(ends, starts, "right")
    offsets = np.concatenate([[0], ends])
    documents, firsts = np.unique(inside, return_index=True)
    for d, i, j in zip(documents, firsts, [*firsts[1:], len(inside)]):
        spans[d] = np.stack([starts[i:j], stops[i:j]], 1) - offsets[d]
    for d, i in pairs:
        items[d].append(i)
    return sizes, spans, items


#: what the search returns besides the key
RESULT = "n_words long, spans array<struct<begin:long,end:long>>, items array<long>"


def _search(phrases: Broadcast, field: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = phrases.value
        for keys, texts in _shards(batches, field):
            sizes, spans, items = search_shard(texts, own)
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(sizes, pa.int64()),
                pa.array([[{"begin": int(b), "end": int(e)} for b, e in s] for s in spans],
                         pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array([[own.items[i] for i in sorted(x)] for x in items], pa.list_(pa.int64())),
            ], names=["key", "n_words", "spans", "items"])

    return run


def _shards(batches: Iterator[pa.RecordBatch], field: str | None) -> Iterator[tuple[pa.Array, list]]:
    """Rows of one partition in runs of about ``SHARD_WORDS`` words (six characters each)."""
    keys, texts, size = [], [], 0
    for batch in batches:
        begin = 0
        for i, text in enumerate(text_column(batch, field)):
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 1
            if size >= 6 * SHARD_WORDS:
                yield pa.concat_arrays([*keys, batch.column("key").slice(begin, i + 1 - begin)]), texts
                keys, texts, size, begin = [], [], 0, i + 1
        keys.append(batch.column("key").slice(begin))
    if texts:
        yield pa.concat_arrays(keys), texts


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The test set in blocks of at most ``BLOCK_WORDS`` words (one item at least)."""
    block, size = [], 0
    for row in items.select(F.col(item), F.col(text)).dropna().toLocalIterator():
        n = len(words_of(row[1]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def find_items(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: ``key``, ``n_words``, ``spans`` and ``items``.

    A phrase is a run of ``window`` words of an item, or a whole shorter item. ``spans`` are
    the merged word ranges ``[begin, end)`` of the document that lie in occurrences of
    phrases, ``items`` the sorted items with such phrases. Null texts have no words and
    items with a null id or text are ignored; an empty test set hits nothing. Of a repeated ``item`` all texts count. Rows keep
    their multiplicity, also with a repeated or null ``key``, whatever the size of the test set.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _find(rows, "key", "text", _blocks(benchmark, item, item_text), window).withColumnRenamed("key", key)


def _find(rows: DataFrame, key: str, text: str, blocks: Iterator[list[tuple]], window: int) -> DataFrame:
    """``key`` as it is in ``rows``, and what the search for all blocks returns."""
    context = rows.sparkSession.sparkContext

    def search(rows: DataFrame, key: str, block: list[tuple]) -> DataFrame:
        rows, field = keyed_texts(rows, key, text)
        schema = f"key {rows.schema['key'].dataType.simpleString()}, {RESULT}"
        return rows.mapInArrow(_search(context.broadcast(Phrases(block, window)), field), schema)

    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = search(rows, key, first).withColumnRenamed("key", key)
    else:
        # written once, so that all blocks see the same numbers
        numbered = stored(rows.withColumn("number", F.monotonically_increasing_id()))
        found = None
        for block in chain([first, second], blocks):
            more = search(numbered, "number", block)
            found = more if found is None else found.unionByName(more)
        found = found.groupBy(F.col("key").alias("number")).agg(
            F.max("n_words").alias("n_words"),
            merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"))
        found = numbered.select("number", key).join(found, "number")
    return found.select(key, "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def merged_spans(spans):
    """Spans in any order, merged where they overlap or touch."""
    none = F.array().cast("array<struct<begin:long,end:long>>")

    def add(done, span):
        last = F.element_at(done, -1)
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["begin"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, add)


def hit_words(spans="spans"):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` without any test phrase, with all their columns.

    Whole rows go through the search, so rows need no key. Only with a test set of several
    blocks they are joined with what was found, by a number of their own.
    """
    found = _find(whole_rows(docs), "row", f"row.{text}", _blocks(benchmark, "item_id", "text"), WINDOW)
    return found.filter(F.size("spans") == 0).select("row.*")
