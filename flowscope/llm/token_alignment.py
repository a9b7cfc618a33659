"""Alignment of two tokenizers, with corpus-wide counts of linked token pairs.

A text in the bytes of both tokenizations is cut where tokens of both end; the two tokens
that end there are linked. Counting the linked pairs of a corpus, and telling every document
the counts of its own pairs, is an external sort:

* A task keeps one number for each link, made of the pair and the document. The number is
  side-major: first the radix part of the B id, then the B id, then the A id, then the
  document. When so many are held, they are sorted, equal ones are counted, and each radix
  part goes out as one run of zstd frames. So hot pairs are added up before any shuffle,
  and a run is a row of bounded size.
* Runs are gathered by radix part and lot, a few neighbouring tasks, so no pair and no part
  is ever in one place. A heap merges the runs of a lot frame by frame and counts each pair.
* The counts of lots are added up by pair; the highest of a B id is over at most as many
  rows as A has ids.
* The runs of each lot are read again beside the counts of its pairs, and what a document
  gets from a lot streams back as one row.

Text is cut into words before tokenizing, at single spaces between characters that are no
white space: neither tokenizer joins anything across them. A worker keeps the alignment of
its words in a bounded store.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heapreplace
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.merge_agenda import Agenda, ragged
from flowscope.llm.sentence_pieces import Pieces, pieces, text_slices
from flowscope.llm.token_counts import pre_tokens
from flowscope.sizing import scratch_dir

#: parts of the B ids, and neighbouring tasks in a lot
RADIX, LOT_TASKS = 8, 4
#: links that a task holds before it writes runs, and records in a frame of a run
RUN_LINKS, FRAME = 3_000_000, 65_536
#: bounds of a worker's store: words, and numbers in its longest array
STORE_WORDS, STORE_IDS = 500_000, 6_000_000
#: bytes of group texts at which an output batch ends
BATCH_BYTES = 8_000_000

_BORDERS = re.compile(r"(?<=\S) (?=\S)")
# letters up to U+024F, digits, and the other marks of ASCII: words of these alone are cut
# by this pattern as byte-level tokenizers cut them; all other words go to the library
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+")


def byte_letters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer file: its merges as an agenda, and the library for odd words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.agenda = Agenda({
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        letters = byte_letters()
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.size = max(vocab.values()) + 1
        self.widths = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.widths[i] = len(token)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and their number in each word, of plain words with a space in front."""
        text = " " + " ".join(words)
        parts = _PRE_TOKENS.findall(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        if len(raw) > len(text):
            lead = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
            ends = np.append(lead, len(raw))[np.cumsum(sizes)]
            sizes = np.diff(ends, prepend=0)
        ids, counts = self.agenda.merge(self.of_byte[raw], sizes)
        starts = np.flatnonzero(raw[np.cumsum(sizes) - sizes] == 0x20)
        return ids, np.add.reduceat(counts, starts)

    def odd(self, words: list[str]) -> list[list[int]]:
        """Token ids of other words with a space in front."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]


def joined_lists(plain: tuple[np.ndarray, np.ndarray], odd: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter(chain.from_iterable(odd), np.int32)
    counts = np.fromiter(map(len, odd), np.int64, len(odd))
    return np.concatenate([plain[0], flat]), np.concatenate([plain[1], counts])


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` values."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


class Aligner:
    """Words as tokens of both sides, links and groups, in arrays that documents gather from."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), pieces(b_path)
        b: Pieces = self.b
        texts = b.texts.to_pylist()[:b.size]
        self.b_widths = np.array([len(t) for t in texts], np.int64)
        #: B ids in the order of their radix parts
        self.part = -(-b.size // RADIX)
        ids = np.arange(b.size, dtype=np.int64)
        self.place = ids % RADIX * self.part + ids // RADIX
        #: bits of a document within a run; a pair takes the others
        self.doc_bits = 63 - (RADIX * self.part * self.a.size).bit_length()
        if self.doc_bits < 20:
            raise ValueError("the two vocabularies are too large for one number")
        # a token of a group's text with what follows it
        self.names = pa.array(
            [f"{i}{end}" for ends, size in ((",|", self.a.size), (",;", b.size)) for end in ends for i in range(size)],
            pa.binary())
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        #: per word: numbers of A tokens, B tokens and links, then whether bytes are equal
        self.facts = np.empty((0, 4), np.int64)
        self.links, self.link_begins = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.tokens, self.token_begins = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _add(self, words: list[str]) -> None:
        """Tokenize and align words that the store lacks; the plain ones come first."""
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        odd = [w for w in words if not _PLAIN.fullmatch(w)]
        none = (np.empty(0, np.int32), np.empty(0, np.int64))
        a, n_a = joined_lists(self.a.plain(plain) if plain else none, self.a.odd(odd) if odd else [])
        parts = [pre_tokens(w) for w in odd]
        b, per_part = self.b.merged(plain + [*chain.from_iterable(parts)])
        borders = np.concatenate([np.arange(len(plain) + 1), len(plain) + np.cumsum([len(p) for p in parts], dtype=np.int64)])
        n_b = np.diff(np.concatenate([[0], np.cumsum(per_part)])[borders.astype(np.int64)])
        widths = np.fromiter((len(w.encode()) + 1 for w in plain + odd), np.int64, len(words))
        self.places.update(zip(plain + odd, range(len(self.places), len(self.places) + len(words))))
        self._align(a, n_a, b, n_b, widths)

    def _align(self, a, n_a, b, n_b, widths) -> None:
        a_total, b_total = sums_of(self.a.widths[a], n_a), sums_of(self.b_widths[b], n_b)
        same = (a_total == widths) & (b_total == widths)
        # the others make a text have no tokens, so none are kept
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        n_a, n_b, widths = n_a * same, n_b * same, widths * same
        which_a, which_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        a_at, b_at = np.cumsum(self.a.widths[a]), np.cumsum(self.b_widths[b])
        near = np.searchsorted(b_at, a_at)
        ends_too = (near < len(b_at)) & (b_at[np.minimum(near, len(b_at) - 1)] == a_at)
        a_end = np.flatnonzero(ends_too)
        b_end = near[a_end]
        n_links = np.bincount(which_a[a_end], minlength=len(n_a))
        pairs = self.place[b[b_end]] * self.a.size + a[a_end]
        # tokens in the order of a group's text: of each group first A, then B
        a_last_of = np.zeros(len(a), bool)
        a_last_of[a_end] = True
        b_last_of = np.zeros(len(b), bool)
        b_last_of[b_end] = True
        a_group, b_group = np.cumsum(a_last_of) - a_last_of, np.cumsum(b_last_of) - b_last_of
        names = np.concatenate([
            a + a_last_of * self.a.size, 2 * self.a.size + b + b_last_of * self.b.size]).astype(np.int32)
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_links, same], 1)])
        self.links = np.concatenate([self.links, pairs])
        self.link_begins = np.concatenate([self.link_begins, self.link_begins[-1] + np.cumsum(n_links)])
        self.tokens = np.concatenate([self.tokens, names[order]])
        self.token_begins = np.concatenate([self.token_begins, self.token_begins[-1] + np.cumsum(n_a + n_b)])

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
        """Of texts: facts (tokens of A and B, links), the pairs of all links, the text of each pair, group texts.

        An empty text, or one whose bytes the two do not share, has no tokens.
        """
        words = [_BORDERS.split(t) if t else [] for t in texts]
        every = [*chain.from_iterable(words)]
        new = set(every).difference(self.places)
        if len(self.places) + len(new) > STORE_WORDS or len(self.tokens) > STORE_IDS:
            self.clear()
            new = set(every)
        if new:
            self._add([*new])
        at = np.fromiter(map(self.places.__getitem__, every), np.int64, len(every))
        n_words = np.array([len(x) for x in words], np.int64)
        which = np.repeat(np.arange(len(texts)), n_words)
        good = np.ones(len(texts), bool)
        good[which[self.facts[at, 3] == 0]] = False
        at, which = at[good[which]], which[good[which]]
        borders = np.searchsorted(which, np.arange(len(texts) + 1))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.facts[at], 0)])
        facts = np.diff(sums[borders], axis=0)[:, :3]
        begins, counts = self.link_begins[at], self.link_begins[at + 1] - self.link_begins[at]
        links = self.links[ragged(begins, counts)]
        begins, counts = self.token_begins[at], self.token_begins[at + 1] - self.token_begins[at]
        parts = self.names.take(pa.array(self.tokens[ragged(begins, counts)]))
        groups = _group_texts(parts, np.concatenate([[0], np.cumsum(facts[:, 0] + facts[:, 1])]))
        return facts, links, np.repeat(np.arange(len(texts)), facts[:, 2]), groups


def _group_texts(parts: pa.BinaryArray, borders: np.ndarray) -> pa.StringArray:
    """Named tokens joined to one text for each document, without the last semicolon."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[:len(parts) + 1]
    data = memoryview(parts.buffers()[2] or b"")
    places = offsets[borders].tolist()
    return pa.array([bytes(data[i:max(i, j - 1)]).decode("ascii") for i, j in zip(places, places[1:])], pa.string())


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


# --- runs ------------------------------------------------------------------------------------


def pack_frame(codes: np.ndarray, docs: np.ndarray, links: np.ndarray) -> bytes:
    """A frame of records in rising order of (code, doc): codes with their numbers of records, then records."""
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    counts = np.diff(first, append=len(codes))
    raw = b"".join([
        np.array([len(first), len(codes)], "<i8").tobytes(), codes[first].astype("<i8").tobytes(),
        counts.astype("<u4").tobytes(), docs.astype("<u4").tobytes(), links.astype("<u4").tobytes()])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, their numbers of records, documents and links of each frame of a run."""
    place = 0
    while place < len(run):
        size = int.from_bytes(run[place:place + 8], "little")
        raw = zstandard.ZstdDecompressor().decompress(run[place + 8:place + 8 + size])
        place += 8 + size
        n_codes, n = np.frombuffer(raw, "<i8", 2).tolist()
        at, arrays = 16, []
        for kind, count in (("<i8", n_codes), ("<u4", n_codes), ("<u4", n), ("<u4", n)):
            arrays.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
            at += arrays[-1].size * int(kind[2])
        yield tuple(arrays)


def runs_of(keys: np.ndarray, doc_bits: int, part_codes: int) -> Iterator[tuple[int, bytes]]:
    """Radix parts and runs from the numbers of links; equal numbers become one record."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    links = np.diff(first, append=len(keys))
    codes, docs = keys[first] >> doc_bits, keys[first] & ((1 << doc_bits) - 1)
    borders = np.searchsorted(codes, np.arange(RADIX + 1) * part_codes).tolist()
    for radix, (begin, end) in enumerate(zip(borders, borders[1:])):
        packed = [
            pack_frame(codes[i:min(i + FRAME, end)], docs[i:min(i + FRAME, end)], links[i:min(i + FRAME, end)])
            for i in range(begin, end, FRAME)]
        if packed:
            yield radix, b"".join(len(x).to_bytes(8, "little") + x for x in packed)


def merge_runs(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rising codes and their links from sorted runs, of which one frame each is open.

    The heap holds the last code of every open frame. Below the smallest of these nothing can
    come any more, so the codes so far are counted and that run moves on. That code itself
    may go on in the next frame, so the last one counted waits for more.
    """
    open_runs, waiting = [], None
    for run in runs:
        more = frames(run)
        open_runs.append([more, *_code_links(next(more))])
    heap = [(int(codes[-1]), i) for i, (_, codes, _) in enumerate(open_runs)]
    heapify(heap)
    live = len(heap)
    while live:
        limit, i = heap[0]
        codes, links = [], []
        for state in open_runs:
            n = int(np.searchsorted(state[1], limit, "right"))
            codes.append(state[1][:n])
            links.append(state[2][:n])
            state[1], state[2] = state[1][n:], state[2][n:]
        found, places = np.unique(np.concatenate(codes), return_inverse=True)
        totals = np.zeros(len(found), np.int64)
        np.add.at(totals, places, np.concatenate(links))
        if len(found):
            if waiting and waiting[0] == found[0]:
                totals[0] += waiting[1]
            elif waiting:
                yield np.array([waiting[0]]), np.array([waiting[1]])
            waiting = int(found[-1]), int(totals[-1])
            yield found[:-1], totals[:-1]
        following = next(open_runs[i][0], None)
        if following is None:
            heapreplace(heap, (np.iinfo(np.int64).max, i))
            live -= 1
        else:
            open_runs[i][1:] = _code_links(following)
            heapreplace(heap, (int(open_runs[i][1][-1]), i))
    if waiting:
        yield np.array([waiting[0]]), np.array([waiting[1]])


def _code_links(frame) -> tuple[np.ndarray, np.ndarray]:
    codes, counts, _, links = frame
    return codes, np.add.reduceat(links, np.cumsum(counts) - counts)


# --- tasks -----------------------------------------------------------------------------------

_ALIGNED = "number long, n_a long, n_b long, n_links long, groups string, radix int, lot long, docs long, run binary"


def _aligned(a_path: str, b_path: str, key_type: pa.DataType) -> Callable:
    """Rows of documents, and rows of runs whose document columns are null."""
    schema = pa.schema([
        ("key", key_type), ("number", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
        ("groups", pa.string()), ("radix", pa.int32()), ("lot", pa.int64()), ("docs", pa.int64()), ("run", pa.binary())])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = aligner(a_path, b_path), TaskContext.get().partitionId()
        base = number = task << 40  # documents of this task are numbered from here on
        held: list[np.ndarray] = []
        n_held = 0

        def written(begin: int, end: int) -> Iterator[pa.RecordBatch]:
            if held:
                for radix, packed in runs_of(np.concatenate(held), own.doc_bits, own.part * own.a.size):
                    yield batch(
                        1, number=pa.array([begin]), radix=pa.array([radix], pa.int32()), lot=pa.array([task // LOT_TASKS]),
                        docs=pa.array([end - begin]), run=pa.array([packed], pa.binary()))

        for rows in batches:
            for begin, texts in text_slices(rows.column("text")):
                facts, links, which, groups = own.align(texts)
                held.append((links << own.doc_bits) | (number - base + which))
                n_held += len(links)
                offsets = np.frombuffer(groups.buffers()[1], np.int32)[:len(texts) + 1]
                i = 0
                while i < len(texts):
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH_BYTES, "right")) - 1)
                    yield batch(
                        j - i, key=rows.column("key").slice(begin + i, j - i), number=pa.array(np.arange(number + i, number + j)),
                        n_a=pa.array(facts[i:j, 0]), n_b=pa.array(facts[i:j, 1]), n_links=pa.array(facts[i:j, 2]),
                        groups=groups.slice(i, j - i))
                    i = j
                number += len(texts)
                if n_held >= RUN_LINKS or number - base >= 1 << (own.doc_bits - 1):
                    yield from written(base, number)
                    held, n_held, base = [], 0, number
        yield from written(base, number)

    return run


def _counted(runs: pa.Table) -> pa.Table:
    """The links of each pair in the runs of one lot and radix part."""
    parts = [*merge_runs(runs.column("run").to_pylist())]
    codes, links = (np.concatenate(x) for x in zip(*parts))
    n = len(codes)
    return pa.table({
        "radix": pa.array(np.full(n, runs["radix"][0].as_py(), np.int32)),
        "lot": pa.array(np.full(n, runs["lot"][0].as_py())), "code": pa.array(codes), "links": pa.array(links)})


def _returned(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the documents of a lot get from the pairs of one radix part."""
    order = np.argsort(counts["code"].to_numpy())
    codes, totals, best = (counts[c].to_numpy()[order] for c in ("code", "total", "best"))
    numbers, sums, bests = [], [], []
    for i in range(len(runs)):
        n = runs["docs"][i].as_py()
        own_sums, own_bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for pairs, records, docs, links in frames(runs["run"][i].as_py()):
            at = np.repeat(np.searchsorted(codes, pairs), records)
            np.add.at(own_sums, docs, links * totals[at])
            np.add.at(own_bests, docs, links * best[at])
        some = np.flatnonzero(own_sums)
        numbers.append(runs["number"][i].as_py() + some)
        sums.append(own_sums[some])
        bests.append(own_bests[some])
    return pa.table({
        "number": pa.array(np.concatenate(numbers)), "count_sum": pa.array(np.concatenate(sums)),
        "n_best": pa.array(np.concatenate(bests))})


def align(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text",
    kept: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """Per document: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``count_sum``, ``n_best``.

    ``a_path`` names a byte-level tokenizer file, which gets a space and the text; ``b_path``
    a sentencepiece model with byte pieces, which puts the space there itself. Strings like
    special tokens are plain text. A text that is null or empty, or whose bytes in tokens of
    either side are not the space and the text, has no tokens: zeros, and empty groups.

    ``groups`` writes each group as A ids, a bar and B ids, with commas between ids and
    semicolons between groups. ``kept`` makes of it what is kept, as these texts are several
    times as long as the documents. ``count_sum`` adds up, over a document's links, how many
    links of the corpus join the same two ids; ``n_best`` counts links whose pair is the most
    frequent of its B id, ties included.

    Rows keep their multiplicity, null and repeated keys included; other columns do not
    matter. The corpus is written once, as digests and runs, to the shared folder.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_field = rows.limit(0).select("key").toArrow().schema.field("key").type
    schema = f"key {rows.schema['key'].dataType.simpleString()}, {_ALIGNED}"
    folder = scratch_dir(spark, "alignment")
    made = rows.mapInArrow(_aligned(a_path, b_path, key_field), schema).withColumn("groups", kept(F.col("groups")))
    made.write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.schema(made.schema).parquet(folder)
    runs = aligned.filter(F.col("radix").isNotNull()).select("radix", "lot", "number", "docs", "run")
    lots = (
        runs.groupBy("radix", "lot").applyInArrow(_counted, "radix int, lot long, code long, links long"))
    lots.write.option("compression", "zstd").parquet(f"{folder}-counts")
    lots = spark.read.schema(lots.schema).parquet(f"{folder}-counts")
    a_size = ByteLevel(a_path).size
    of_b = Window.partitionBy(F.expr(f"code div {a_size}L"))
    totals = (
        lots.groupBy("code").agg(F.sum("links").alias("total"))
        .withColumn("best", (F.col("total") == F.max("total").over(of_b)).cast("long")))
    back = (
        runs.groupBy("radix", "lot")
        .cogroup(lots.join(totals, "code").select("radix", "lot", "code", "total", "best").groupBy("radix", "lot"))
        .applyInArrow(_returned, "number long, count_sum long, n_best long")
        .groupBy("number").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    zero = F.lit(0).cast("long")
    return (
        aligned.filter(F.col("radix").isNull()).drop("radix", "lot", "docs", "run").join(back, "number", "left")
        .select(
            F.col("key").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "groups",
            F.coalesce("count_sum", zero).alias("count_sum"), F.coalesce("n_best", zero).alias("n_best")))
