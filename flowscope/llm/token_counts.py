"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

No piece of the vocabulary holds a space behind another character (checked when the model
is loaded), so a text falls into pre-tokens, each a run of spaces and what follows it, that
are encoded independently. Tier one is a broadcast table from frequent pre-tokens to their
numbers of tokens, of at most ``table_size`` entries. Tier two is a cache in each Python
worker, of at most ``CACHE_SIZE`` entries; a pre-token in neither is encoded by the library.

The table only saves work and never changes a count. It is chosen over all documents: each
partition keeps a summary of at most ``SUMMARY_SIZE`` pre-tokens and reports those that make
up a fair share of it, so only such heavy hitters, not pre-tokens, are added up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what the library writes for a space inside pieces
SPACE = "▁"
TABLE_SIZE = 65_536
#: entries of a partition's summary, and of a worker's cache
SUMMARY_SIZE = 100_000
CACHE_SIZE = 300_000
#: a pre-token is reported by a partition of which it makes up at least this share
LEAST_SHARE = 1 / 20_000
#: a pre-token of more characters is encoded each time, so that caches stay small
CACHED_CHARS = 64

_GAPS = re.compile(" +[^ ]*")
_models: dict[str, object] = {}
_caches: dict[str, dict[str, int]] = {}


def load_model(path: str):
    """The library's model, once for each worker."""
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        for i in range(model.get_piece_size()):
            if inner.search(model.id_to_piece(i)):
                raise ValueError("this vocabulary has pieces across a space")
        if model.encode("  a", out_type=str) == model.encode("a", out_type=str):
            raise ValueError("this model removes spaces")
        _models[path] = model
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space.

    The library puts one space before a text, and again before each pre-token when it is
    encoded by itself. A literal space mark is the same to the library as a space.
    """
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _GAPS.findall(" " + text)]
    return text.split(" ")


#: rows turned into Python strings at once
SLICE = 512


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for i in range(0, batch.num_rows, SLICE):
        yield from (x or "" for x in batch.column("text").slice(i, SLICE).to_pylist())


def _heavy() -> Callable:
    """Heavy hitters of each partition; the smallest counts go when the summary is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in batches:
            for t in _texts(batch):
                seen.update(pre_tokens(t))
                if len(seen) > SUMMARY_SIZE:
                    kept = seen.most_common(SUMMARY_SIZE // 2)
                    total += sum(seen.values()) - sum(n for _, n in kept)
                    seen = Counter(dict(kept))
        total += sum(seen.values())
        found = [(w, n) for w, n in seen.items() if n >= max(2, total * LEAST_SHARE) and len(w) <= CACHED_CHARS]
        yield pa.RecordBatch.from_pydict({
            "token": pa.array([w for w, _ in found], pa.string()),
            "n": pa.array([n for _, n in found], pa.int64())})

    return run


def frequent_lengths(docs: DataFrame, model_path: str, text: str = "text", table_size: int = TABLE_SIZE) -> dict[str, int]:
    """The first tier: the frequent pre-tokens, at most ``table_size``, and their lengths."""
    top = (
        docs.select(F.col(text).alias("text")).mapInArrow(_heavy(), "token string, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token").limit(table_size))
    words = top.select("token").toArrow().column("token").to_pylist()
    return lengths(load_model(model_path), words)


def lengths(model, words: list[str]) -> dict[str, int]:
    """Tokens of each pre-token. The library adds no space to an empty one, so that is put right."""
    found = dict(zip(words, map(len, model.encode(words, num_threads=1)))) if words else {}
    if "" in found:
        lone = model.piece_to_id(SPACE) != model.unk_id()
        found[""] = 1 if lone else len(SPACE.encode())
    return found


def text_length(text: str, model, first: dict[str, int], second: dict[str, int]) -> int:
    """Tokens of one text: from the table, then from the worker's cache, then from the library."""
    words = pre_tokens(text)
    found = [*map(first.get, words)]
    total = sum(filter(None, found))
    missed = [w for w, n in zip(words, found) if n is None]
    if not missed:
        return total
    new = list({w for w in missed if w not in second})
    if len(second) + len(new) > CACHE_SIZE:
        second.clear()
        new = list(set(missed))
    if not new:
        return total + sum(map(second.__getitem__, missed))
    fresh = lengths(model, new)
    second.update((w, n) for w, n in fresh.items() if len(w) <= CACHED_CHARS)
    return total + sum(fresh[w] if w in fresh else second[w] for w in missed)


def _count(model_path: str, table: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first, second = load_model(model_path), table.value, _caches.setdefault(model_path, {})
        for batch in batches:
            counts = [text_length(t, model, first, second) for t in _texts(batch)]
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), n_bytes, pa.array(counts, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", table_size: int = TABLE_SIZE,
) -> DataFrame:
    """Per document: ``key``, ``n_bytes`` (UTF-8) and ``n_tokens``, as the library counts.

    ``model_path`` is a sentencepiece model that every worker can read. A null text counts
    as empty and has no tokens. Rows keep their multiplicity; other columns do not matter.
    Texts are encoded whole, whatever their length.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, model_path, text, table_size))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(
        _count(model_path, table), f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens")
