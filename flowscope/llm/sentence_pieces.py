"""SentencePiece encoding and decoding for merge-type vocabularies.

Text is cut into pre-tokens, a run of spaces and what follows it; no piece of the vocabulary
holds a space behind another character (checked when the model is loaded), so each is
encoded by itself. An agenda of adjacent symbol pairs, ordered by score and then by place,
merges the characters of a pre-token; what the vocabulary lacks becomes byte pieces. Each
worker keeps what it encoded in a bounded store. The pre-tokens of an Arrow batch that are
new to it are encoded together, decoded again, and both are compared with the sentencepiece
library before they are used: a difference raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.merge_agenda import Agenda, ragged
from flowscope.llm.token_counts import SPACE, load_model, pre_tokens

#: bounds of a worker's store: pre-tokens, and token ids of all of them
STORE_WORDS, STORE_IDS = 700_000, 6_000_000
#: bytes of texts worked on at once, and token ids at which an output batch ends
SLICE_BYTES = 2_000_000
BATCH_IDS = 500_000
#: pre-tokens that the library gets as one text when it checks
TOGETHER = 64
#: what the library writes for the unknown token
UNKNOWN = " ⁇ "


class Pieces:
    """The vocabulary of a model as an agenda over symbols, with its decoder."""

    def __init__(self, path: str):
        model = self.model = load_model(path)
        size = self.size = model.get_piece_size()
        if not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError("this vocabulary has no byte pieces")
        if any(map(model.is_unused, range(size))):
            raise ValueError("this vocabulary has unused pieces")
        kinds = (model.is_control, model.is_unknown, model.is_byte)
        ids = {model.id_to_piece(i): i for i in range(size) if not any(is_kind(i) for is_kind in kinds)}
        scores = {piece: model.get_score(i) for piece, i in ids.items()}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        # a symbol is a piece, or a character that only stands inside pieces
        symbols = {s: i for i, s in enumerate({*ids, *chain.from_iterable(ids)})}
        self.agenda = Agenda({
            (symbols[piece[:i]], symbols[piece[i:]]): (order[scores[piece]], symbols[piece])
            for piece in ids for i in range(1, len(piece)) if piece[:i] in symbols and piece[i:] in symbols})
        #: symbols of characters; one that no piece holds has a number of its own
        self.unlike = len(symbols)
        self.letters = np.arange(0x110000, dtype=np.int32) + self.unlike
        for s, i in symbols.items():
            if len(s) == 1:
                self.letters[ord(s)] = i
        self.names = [*symbols]
        self.ids = np.array([ids.get(s, -1) for s in symbols], np.int32)
        self.bytes = [model.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        values = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        texts = [
            b"" if model.is_control(i) else UNKNOWN.encode() if model.is_unknown(i)
            else values.get(i) or model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        # the first token of a text loses its space, unless it is unknown or a byte
        first = [t[1:] if t[:1] == b" " and i not in values and not model.is_unknown(i) else t for i, t in enumerate(texts)]
        self.texts = pa.array(texts + first, pa.binary())
        self.empty = np.array([not t for t in texts])
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.kept = np.empty(0, np.int32)
        self.begins = np.zeros(1, np.int64)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-tokens, each written without its first space, and their numbers."""
        text = (SPACE + SPACE.join(words)).replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        found, counts = self.agenda.merge(self.letters[codes], sizes)
        ids = np.where(found < self.unlike, self.ids[np.minimum(found, self.unlike - 1)], -1)
        return self._with_bytes(found, ids, counts) if (ids < 0).any() else (ids, counts)

    def _with_bytes(self, found: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """Symbols that are no piece as the byte pieces of their characters."""
        odd = np.flatnonzero(ids < 0)
        spelled = {
            s: [self.bytes[b] for b in (self.names[s] if s < self.unlike else chr(s - self.unlike)).encode()]
            for s in np.unique(found[odd]).tolist()}
        parts = [spelled[s] for s in found[odd].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] = [len(x) for x in parts]
        longer = np.repeat(ids, sizes)
        longer[longer < 0] = [*chain.from_iterable(parts)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return longer, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of different pre-tokens and their numbers, as the library has them too.

        The library gets ``TOGETHER`` pre-tokens as one text. Those that end in a space would
        run into the next one there, so they come last, each as a text of its own; an empty
        one, a lone space, is an empty text to the library and stays unchecked.
        """
        joined = next((i for i, w in enumerate(words) if not w or w[-1] == " "), len(words))
        found, counts = self.merged(words)
        groups = [words[i:min(i + TOGETHER, joined)] for i in range(0, joined, TOGETHER)]
        groups += [[w] for w in words[joined:] if w]
        theirs = self.model.encode([" ".join(g) for g in groups], num_threads=1)
        lone = len(words) > joined and not words[-1]
        ours = found[:len(found) - int(counts[-1])] if lone else found
        if not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int32), ours):
            raise RuntimeError("the agenda and the library encode differently")
        decoded = self.decode(ours, np.fromiter(map(len, theirs), np.int64, len(theirs)))
        if decoded.to_pylist() != self.model.decode(theirs, num_threads=1):
            raise RuntimeError("the tables and the library decode differently")
        return found, counts

    def _add(self, words: set[str]) -> None:
        """Encode pre-tokens into the store."""
        plain = [w for w in words if w and w[-1] != " "]
        new = plain + [w for w in words if w and w[-1] == " "] + [""] * ("" in words)
        found, counts = self.checked(new)
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(counts)])
        self.kept = np.concatenate([self.kept, found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of whole texts, one after the other, and their numbers."""
        words = [pre_tokens(t) for t in texts]
        every = [*chain.from_iterable(words)]
        new = set(every).difference(self.places)
        if len(self.places) + len(new) > STORE_WORDS or len(self.kept) > STORE_IDS:
            self.clear()
            new = set(every)
        if new:
            self._add(new)
        at = np.fromiter(map(self.places.__getitem__, every), np.int64, len(every))
        sizes = self.begins[at + 1] - self.begins[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        borders = np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)])
        return self.kept[ragged(self.begins[at], sizes)], np.diff(ends[borders])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.StringArray:
        """The texts of token ids, ``counts`` of them each, without the space in front."""
        ids = np.asarray(ids, np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        shown = np.append(np.flatnonzero(~self.empty[ids]), len(ids))
        lead = shown[np.searchsorted(shown, ends - counts)]  # the first token that leaves text
        lead = lead[lead < ends]
        ids = ids.copy()
        ids[lead] += self.size
        parts = self.texts.take(pa.array(ids))
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[:len(parts) + 1]
        data = parts.buffers()[2] or pa.py_buffer(b"")
        places = offsets[np.concatenate([[0], ends])].astype(np.int32)
        raw = bytes(data)[:int(places[-1])]
        try:
            raw.decode()
        except UnicodeDecodeError:
            return pa.array([spelled(raw[i:j]) for i, j in zip(places, places[1:])], pa.string())
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(places), pa.py_buffer(raw))


def spelled(run: bytes) -> str:
    """UTF-8, where each byte that belongs to no character becomes one replacement mark."""
    parts = []
    while True:
        try:
            return "".join([*parts, run.decode()])
        except UnicodeDecodeError as wrong:
            parts += [run[:wrong.start].decode(), "�"]
            run = run[wrong.start + 1:]


_known: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker."""
    if path not in _known:
        _known[path] = Pieces(path)
    return _known[path]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Rows of a text column, null as empty, in slices of about ``limit`` bytes, one row at least."""
    sizes = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for begin, texts in text_slices(batch.column("text")):
                ids, counts = own.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                i = 0
                while i < len(texts):
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_IDS, "right")) - 1)
                    flat = ids[ends[i]:ends[j]]
                    offsets = pa.array((ends[i:j + 1] - ends[i]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(begin + i, j - i), pa.ListArray.from_arrays(offsets, pa.array(flat)),
                         own.decode(flat, counts[i:j])], names=["key", "ids", "decoded"])
                    i = j

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``ids`` (array of int) and the text ``decoded`` from them.

    ``path`` names a merge-type sentencepiece model with byte pieces that every worker can
    read. Ids are those of the library without begin, end or sampling; strings like special
    tokens are plain text. A null text is encoded as an empty one: no ids, an empty text.
    Rows keep their multiplicity; other columns do not matter. Texts are encoded whole.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded string"
    return rows.mapInArrow(_encode(path), schema).withColumnRenamed("key", key)


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: one text bounds the memory
                row = batch.slice(i, 1)
                ids = row.column("ids")
                text = own.decode(ids[0].values.to_numpy(), np.array([len(ids[0])])) if ids[0].is_valid else [None]
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array(text, pa.string())], names=[*row.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns and ``ids``) with ``decoded``; a column of that name is replaced.

    Null ids decode to null, no ids to an empty text. Bytes that make no character become
    one replacement mark each, as in the library.
    """
    rows = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(path), f"{fields}, decoded string")
