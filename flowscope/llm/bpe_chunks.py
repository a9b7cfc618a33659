"""Exact BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last characters cuts every text into chunks at places that depend
on the content alone, so copied passages fall into the same chunks wherever they stand. A
task encodes each different chunk once and keeps it in a bounded cache that outlives texts
and batches. Chunks cut words apart, so the joins are repaired: a window
around the join is encoded again and widened word by word until its first and last words
come out exactly as the two chunks have them. A word without end is not repaired chunk by
chunk but kept open and encoded when it ends, so the work stays linear.

Words are parted by spaces and line feeds; both are white space to every tokenizer
that drops it, so what stands on either side is encoded independently. Words are encoded by
the library and kept in a second bounded cache.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: characters of the rolling window, a power of two
WINDOW = 16
#: a chunk ends with a chance of 1 in so many, a power of two
MEAN_CHUNK = 1_024
MIN_CHUNK, MAX_CHUNK = 256, 8_192
#: bounds of a worker's caches: words, characters of all chunks
WORD_CACHE = 250_000
CHUNK_CACHE_CHARS = 3_000_000
CACHED_CHARS = 64

_mixer = np.uint32(2_654_435_761)


class Encoder:
    """The library's tokenizer with caches of words and chunks."""

    def __init__(self, path: str):
        # Spark runs a worker for each core; the library's threads would only compete
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.encode(" \n", add_special_tokens=False).ids:
            raise ValueError("this tokenizer keeps white space")
        tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        #: without a decoder the library puts spaces between tokens
        self.tokens = tokens if self.tokenizer.decoder is None else None
        self.lowers = self.encode_plain("AbÉ Ü") == self.encode_plain("abé ü")
        # one object for each id, however many words hold it
        self.numbers = list(range(len(tokens)))
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, list[tuple[int, ...]]] = {}
        self.chunk_chars = 0

    def forget(self) -> None:
        self.words, self.chunks, self.chunk_chars = {}, {}, 0

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Token ids of each word; every different one is encoded once."""
        found = [*map(self.words.get, words)]
        missed = [i for i, ids in enumerate(found) if ids is None]
        if missed:
            new = list({words[i] for i in missed})
            fresh = {
                w: tuple(map(self.numbers.__getitem__, e.ids))
                for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
            if len(self.words) + len(fresh) > WORD_CACHE:
                self.words.clear()
            self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHED_CHARS)
            for i in missed:
                found[i] = fresh[words[i]]
        return found

    def encode_chunk(self, chunk: str, parts: list[str]) -> list[tuple[int, ...]]:
        """Token ids of a chunk, for each of its words (the first and last may be cut)."""
        found = self.chunks.get(chunk)
        if found is None:
            found = self.encode_words(parts)
            if self.chunk_chars + len(chunk) > CHUNK_CACHE_CHARS:
                self.chunks.clear()
                self.chunk_chars = 0
            self.chunks[chunk] = found
            self.chunk_chars += len(chunk)
        return found

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text, equal to those of the library."""
        words: list[tuple[int, ...]] = []
        texts: list[str] = []  # of the last words, while a join may need them
        for chunk, shared in whole_words(chunks_of(self.folded(text))):
            parts = split_words(chunk)
            if shared:
                ids = self.encode_chunk(chunk, parts)
            else:  # its first word is encoded once, with what stands before it
                ids = [(), *self.encode_words(parts[1:])] if texts else self.encode_words(parts)
            if texts:
                ids, parts = self.repaired(words, texts, ids, parts)
            words += ids
            texts = (texts + parts)[-KEPT_WORDS:]
        return list(chain.from_iterable(words))

    def repaired(self, words, texts, ids, parts):
        """Join a chunk to what stands before it; takes the words it replaces off ``words``.

        The last word before the join and the first after it are one. Windows with one, two,
        four... whole words more on either side are encoded until both margins agree.
        """
        margin = 1
        while True:
            left, right = texts[-1 - margin:], parts[:1 + margin]
            joined = left[:-1] + [left[-1] + right[0]] + right[1:]
            window = self.encode_plain(" ".join(joined))
            before = tuple(chain.from_iterable(words[len(words) - len(left):len(words) - 1]))
            after = tuple(chain.from_iterable(ids[1:len(right)]))
            n = len(window) - len(after)
            if n >= len(before) and window[:len(before)] == before and window[n:] == after:
                words.pop()
                texts.pop()
                return [window[len(before):n], *ids[1:]], [joined[len(left) - 1], *parts[1:]]
            if len(left) <= margin and len(right) <= margin:
                raise ValueError("this tokenizer does not part words at white space")
            margin *= 2

    def encode_plain(self, text: str) -> tuple[int, ...]:
        return tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def folded(self, text: str) -> str:
        """Lower case, where the tokenizer makes no other difference of it.

        Below U+0300 nothing combines, so case and composition do not interact; only strings
        like special tokens are left as they are.
        """
        if not self.lowers or "<|" in text:
            return text
        plain = text.isascii() or np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < 0x300
        return text.lower() if plain else text

    def decode(self, ids: list[int]) -> str:
        if self.tokens:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


#: words kept in front of a join; a wider margin than this has never to be read
KEPT_WORDS = 64
_STOPS = re.compile("([.,])(?<=[a-z\u00df-\u00f6\u00f8-\u00ff].)(?=[ \n])")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def split_words(text: str) -> list[str]:
    """Words, and the marks that end them; never empty, the first and the last may be.

    A full stop or comma between a letter and white space is encoded by itself in any case.
    """
    return _STOPS.sub(r" \1", text).replace("\n", " ").split(" ")


def cut_places(text: str) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` characters ends a chunk.

    Each doubling step adds the hash of the window before, so a hash takes log2(WINDOW)
    passes over the text.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    rolled = codes * _mixer
    rolled ^= rolled >> np.uint32(15)
    width = 1
    while width < WINDOW:
        longer = rolled.copy()
        longer[width:] += rolled[:-width] * np.uint32(pow(31, width, 1 << 32))
        rolled, width = longer, width * 2
    rolled *= _mixer
    return np.flatnonzero(rolled >> np.uint32(32 - (MEAN_CHUNK.bit_length() - 1)) == 0) + 1


def chunks_of(text: str) -> Iterator[str]:
    """The text in chunks of ``MIN_CHUNK`` to ``MAX_CHUNK`` characters, the last may be shorter."""
    if len(text) <= MIN_CHUNK:
        if text:
            yield text
        return
    begin = 0
    for end in chain(cut_places(text).tolist(), [len(text)]):
        while end - begin > MAX_CHUNK:
            yield text[begin:begin + MAX_CHUNK]
            begin += MAX_CHUNK
        if end - begin >= MIN_CHUNK or end == len(text) > begin:
            yield text[begin:end]
            begin = end


def whole_words(chunks: Iterator[str]) -> Iterator[tuple[str, bool]]:
    """Chunks, and whether each is as the hash cut it.

    Chunks without any border of words are parts of one unbroken word. They are held until
    it ends and go out with the chunk that it ends in, so no part of it is encoded twice.
    """
    held: list[str] = []
    for chunk in chunks:
        if " " not in chunk and "\n" not in chunk:
            held.append(chunk)
        elif held:
            yield "".join([*held, chunk]), False
            held = []
        else:
            yield chunk, True
    if held:
        yield "".join(held), False


#: rows turned into Python objects at once
SLICE = 256


def _encode(path: str, decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                for rows in _id_batches(part.column("key"), ids):
                    yield _with_texts(rows, own) if decoded else rows
        own.forget()  # the worker goes on to other work

    return run


def _with_texts(rows: pa.RecordBatch, own: Encoder) -> pa.RecordBatch:
    texts = [
        own.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None for ids in rows.column("ids")]
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "decoded"])


#: token ids in one Arrow batch, at which it ends
BATCH_IDS = 500_000


def _id_batches(keys: pa.Array, ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_IDS`` ids, of one row at least."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_IDS, "right")))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids[i:j]])]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids[i:j]), np.int32, int(offsets[-1]))
        yield pa.RecordBatch.from_arrays(
            [keys.slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["key", "ids"])
        i = j


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Per document: ``key`` and ``ids`` (array of int), as the tokenizers library encodes.

    ``path`` names a tokenizer file that every worker can read. It must drop white space and
    part words at it. Special tokens are not added; their strings inside a text become what
    the library makes of them. A null text is encoded as an empty one, which has no ids.
    Rows keep their multiplicity; other columns do not matter. With ``decoded`` the text that
    the ids decode to is added in the same pass.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(_encode(path, decoded), schema).withColumnRenamed("key", key)


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                yield _with_texts(batch.slice(i, SLICE), own)

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns and ``ids``) with ``decoded``; special tokens stay in the text.

    Null ids decode to null, no ids to an empty text. A column ``decoded`` is replaced.
    """
    rows = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(path), f"{fields}, decoded string")
