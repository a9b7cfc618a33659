"""Exact Jaccard join of n-gram sets, with a prefix tree.

Texts become sets of hashed n-grams. Equal word sequences are one set. Three steps leave
less and less for the join:

1. Every set sends its n-grams, packed and pre-aggregated by the worker, to the task of their
   hash range, which tells which n-grams occur in more than one set. Similarity 0.8 needs at
   least 0.8 of a set in common with one other set, so a set with fewer shared n-grams has no
   partner and is done. This is the case for nearly all texts.
2. The same is counted again among the sets that are left, with copies put together, and
   then with frequencies. N-grams are globally ordered by them, rare ones first. Two similar sets share one of their first
   n-grams (prefix filter), so sets that share one of these belong to one group, the
   component of such ties.
3. Each group is joined in one task. Its sets are stored in a trie, ordered frequent n-grams
   first; a set descends the trie together with its overlap so far, shared by all sets below
   a node, and leaves a branch as soon as what remains of it and of the set cannot reach the
   overlap that the sizes ask for. Branches whose sets are all linked to it already are
   skipped: components are asked for, not pairs. A group of more than ``BLOCK`` sets is cut
   into blocks that are joined with each other, first all with one, then only what is not
   yet linked with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.components import components
from flowscope.sizing import small_rows, stored

N = 5
#: similarity as a fraction, so that borders are exact
NUMERATOR, DENOMINATOR = 80, 100
#: sets and n-grams of one worker chunk, which are counted together before anything is sent
CHUNK, CHUNK_GRAMS = 4_096, 1_000_000
#: sets in one block of a group
BLOCK = 1_000
#: sets of a cell that are compared one with another, without a trie
FEW = 12
#: bytes of text that are cut into words together, and rows
PIECE, PIECE_ROWS = 2 << 20, 256
#: longer words are hashed one by one
LONG_WORD = 32

_mix, _mix_word = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A-Z lower-cased, every kind of ASCII white space a blank
_plain = np.arange(256, dtype=np.uint8)
_plain[65:91] += 32
_plain[[9, 10, 11, 12, 13]] = 32
#: the first bytes of eight, as a little-endian number
_first = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def sequence_key(words: list[bytes]) -> bytes:
    """Equal for equal word sequences."""
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else b""


class Cut:
    """Texts cut into words together: ``words_of`` each, as places in one array of bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        _, places, data = texts.buffers()
        ends = np.frombuffer(places, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4))
        ends = ends.astype(np.int64)
        size = int(ends[-1] - ends[0])
        self.padded = np.zeros(size + 8, np.uint8)
        self.bytes = self.padded[:size]
        if size:
            np.take(_plain, np.frombuffer(data, np.uint8, size, int(ends[0])), out=self.bytes)
        ends -= ends[0]
        filled = ends[1:] > ends[:-1]
        heads, tails = ends[:-1][filled], ends[1:][filled] - 1
        self.word = self.bytes != 32
        opens, closes = self.word.copy(), self.word.copy()
        opens[1:] &= ~self.word[:-1]
        opens[heads] = self.word[heads]
        closes[:-1] &= ~self.word[1:]
        closes[tails] = self.word[tails]
        self.starts = np.flatnonzero(opens)
        self.lengths = np.flatnonzero(closes) + 1 - self.starts
        # the words of text i are those from cuts[i] up to cuts[i + 1]
        self.cuts = np.searchsorted(self.starts, ends)
        self.counts = np.diff(self.cuts)

    def keys(self) -> list[bytes]:
        """``sequence_key`` of each text."""
        follows = np.ones(len(self.starts), bool)
        follows[self.cuts[:-1][self.counts > 0]] = False
        kept = self.word.copy()
        kept[self.starts[follows] - 1] = True
        joined = memoryview(self.bytes[kept].tobytes())
        letters = np.concatenate([[0], np.cumsum(self.lengths)])
        sizes = np.diff(letters[self.cuts]) + np.maximum(self.counts - 1, 0)
        ends = np.cumsum(sizes)
        return [xxhash.xxh3_128_digest(joined[i:j]) if j > i else b"" for i, j in zip((ends - sizes).tolist(), ends.tolist())]

    def _codes(self) -> np.ndarray:
        """A hash of each word."""
        eights = np.ndarray((len(self.bytes),), "<u8", self.padded, strides=(1,))
        codes = self.lengths.astype(np.uint64) * _mix_word
        some = np.flatnonzero(self.lengths <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            some = some[self.lengths[some] > at]
            if not len(some):
                break
            piece = eights[self.starts[some] + at] & _first[np.minimum(self.lengths[some] - at, 8)]
            code = (codes[some] ^ piece) * _mix
            code ^= code >> np.uint64(29)
            code *= _mix_word
            codes[some] = code ^ (code >> np.uint64(32))
        for i in np.flatnonzero(self.lengths > LONG_WORD).tolist():
            codes[i] = xxhash.xxh3_64_intdigest(self.bytes[self.starts[i]:self.starts[i] + self.lengths[i]])
        return codes

    def gram_sets(self, n: int = N) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sorted different 64-bit hashes of all runs of ``n`` words (of fewer
        words, of the one run), behind one another, and where the set of each text ends."""
        codes = self._codes()
        sizes = np.where(self.counts >= n, self.counts - n + 1, self.counts > 0)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(owner)) - begins[owner] + self.cuts[owner]
        grams = np.empty(len(owner), np.uint64)
        width = np.minimum(self.counts, n)[owner]
        for w in range(1, n + 1):
            some = np.flatnonzero(width == w)
            if len(some):
                hashed, first = np.full(len(some), w, np.uint64), at[some]
                for k in range(w):
                    hashed = (hashed ^ codes[first + k]) * _mix
                    hashed ^= hashed >> np.uint64(29)
                grams[some] = hashed
        for i, j in zip(begins.tolist(), ends.tolist()):
            grams[i:j].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        return grams[new], np.cumsum(np.bincount(owner[new], minlength=len(sizes)))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a column ``text``, of about ``PIECE`` bytes or one row at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(before, before[at] + PIECE, "right"))
        end = max(min(end, at + PIECE_ROWS), at + 1)
        yield batch.slice(at, end - at)
        at = end


def enough(shared, size) -> bool:
    """Whether ``shared`` n-grams of a set of ``size`` can make it similar to any other."""
    return DENOMINATOR * shared >= NUMERATOR * size


# --- packed n-grams ----------------------------------------------------------------------

PACKED = "kind int, chunk long, bucket int, keys binary, owners binary, sizes binary, ids array<long>"


def _pack(grams: np.ndarray) -> bytes:
    """Sorted hashes, one row of bytes per digit, so that near ones compress well.

    The last two of eight bytes are left out: n-grams that differ in these alone count as
    shared, which can only keep a set longer in the running.
    """
    return grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(6, -1)
    whole = np.zeros((rows.shape[1], 8), np.uint8)
    whole[:, 2:] = rows.T
    return whole.view(">u8").ravel().astype(np.uint64)


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


#: in place of an owner: more than one set of the chunk has this n-gram
MANY = 0xFFFF


def _chunk_rows(ids: list, keys: list[bytes], sets: list[np.ndarray], chunk: int, buckets: int) -> Iterator[dict]:
    """One row that describes the different sets of a chunk, and one for each bucket of n-grams.

    An n-gram of several sets of the chunk is known to be shared; it is sent once, without an
    owner, so that a passage in every text costs each chunk one entry.
    """
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams)
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(grams)))
    group = np.cumsum(new) - 1
    many = counts > 1
    known = np.bincount(owners[many[group]], minlength=len(sets)).astype(np.int32)
    sizes = np.array([[len(s), k] for s, k in zip(sets, known)], np.int32).reshape(-1, 2)
    yield {"kind": 0, "chunk": chunk, "bucket": int(chunk % buckets), "keys": b"".join(keys),
           "owners": None, "sizes": sizes.tobytes(), "ids": ids}
    grams = grams[first]
    owner = np.where(many, MANY, owners[first]).astype(np.uint16)
    bucket = _bucket_of(grams, buckets)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        i, j = cuts[b], cuts[b + 1]
        if i < j:
            yield {"kind": 1, "chunk": chunk, "bucket": b, "keys": _pack(grams[i:j]),
                   "owners": owner[i:j].view(np.uint8).reshape(-1, 2).T.tobytes(), "sizes": None, "ids": None}


_FIELDS = pa.schema([
    ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()),
    ("owners", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _scan(buckets: int) -> Callable:
    """Texts to packed rows, chunk by chunk; equal texts of a chunk are one set of it.

    A set that other chunks hold too seems to share all its n-grams; that only keeps it in
    the running, and copies are put together before the next step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sets, seen, count = [], [], [], set(), 0
        chunk = TaskContext.get().partitionId() << 32  # the same when a lost task is run again
        for batch in batches:
            for part in pieces(batch):
                cut = Cut(part.column("text"))
                own = [key or b"\0" * 16 for key in cut.keys()]
                grams, ends = cut.gram_sets()
                begin = 0
                for key, end in zip(own, ends.tolist()):
                    sets.append(None if key in seen else grams[begin:end])
                    if key not in seen:
                        seen.add(key)
                        count += end - begin
                    begin = end
                ids += part.column("key").to_pylist()
                keys += own
                if len(ids) >= CHUNK or count >= CHUNK_GRAMS:
                    yield _chunk_batch(ids, keys, sets, chunk, buckets)
                    chunk += 1
                    ids, keys, sets, seen, count = [], [], [], set(), 0
        if ids:
            yield _chunk_batch(ids, keys, sets, chunk, buckets)

    return run


def _chunk_batch(ids: list, keys: list[bytes], sets: list, chunk: int, buckets: int) -> pa.RecordBatch:
    """The different sets come first, then the copies, which hold no n-grams."""
    own = [i for i, s in enumerate(sets) if s is not None]
    copies = [i for i, s in enumerate(sets) if s is None]
    rows = _chunk_rows([ids[i] for i in own + copies], [keys[i] for i in own + copies],
                       [sets[i] for i in own] + [np.zeros(0, np.uint64)] * len(copies), chunk, buckets)
    return pa.RecordBatch.from_pylist(list(rows), schema=_FIELDS)


SHARED = "kind int, chunk long, ids array<long>, keys binary, sizes binary, shared binary"


def _shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: for every chunk, how many n-grams of each set occur in another set too."""
    out = []
    described = rows[rows["kind"] == 0]
    for r in described.itertuples():
        out.append((0, r.chunk, r.ids, r.keys, r.sizes, None))
    packed = rows[rows["kind"] == 1]
    if len(packed):
        grams = [_unpack(x) for x in packed["keys"]]
        lengths = [len(g) for g in grams]
        whole = np.concatenate(grams)
        order = np.argsort(whole)
        ordered = whole[order]
        new = np.ones(len(whole), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(new) - 1
        times = np.bincount(group)
        # an entry without an owner stands for several sets
        owners = np.concatenate([
            np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
            for x in packed["owners"]])
        several = np.bincount(group, weights=owners[order] == MANY) > 0
        shared = np.empty(len(whole), bool)
        shared[order] = ((times > 1) | several)[group]
        ends = np.cumsum(lengths)
        for chunk, i, j in zip(packed["chunk"], ends - lengths, ends):
            mine = owners[i:j][shared[i:j]]
            mine = mine[mine != MANY]
            if len(mine):
                counts = np.bincount(mine)
                out.append((1, chunk, None, None, None, counts.astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["kind", "chunk", "ids", "keys", "sizes", "shared"])


SIZED = "id long, gram_key binary, n_grams long, shared long"


def _sized(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk: size and shared n-grams of the set of every row."""
    described = rows[rows["kind"] == 0].iloc[0]
    sizes = np.frombuffer(described["sizes"], np.int32).reshape(-1, 2).astype(np.int64)
    shared = sizes[:, 1].copy()
    for x in rows[rows["kind"] == 1]["shared"]:
        counts = np.frombuffer(x, np.int32)
        shared[:len(counts)] += counts
    keys = [described["keys"][i:i + 16] for i in range(0, len(described["keys"]), 16)]
    # copies of a set stand behind the sets of the chunk, with its key
    first = {}
    at = [first.setdefault(k, i) for i, k in enumerate(keys)]
    return pd.DataFrame({
        "id": pd.array(list(described["ids"]), dtype="Int64"), "gram_key": keys,
        "n_grams": sizes[at, 0], "shared": shared[at]})


def sized_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, key of its word sequence, size of its set, and how many of its n-grams
    occur in another set as well (or in a copy of it in another chunk)."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_scan(buckets), PACKED)
    counted = packed.groupBy("bucket").applyInPandas(_shared, SHARED)
    return counted.groupBy("chunk").applyInPandas(_sized, SIZED)


# --- the sets that are left --------------------------------------------------------------

def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each n-gram of each set."""
    for batch in batches:
        for part in pieces(batch):
            grams, ends = Cut(part.column("text")).gram_sets()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column("node").to_numpy(), np.diff(ends, prepend=0))), pa.array(grams.view(np.int64))],
                names=["node", "gram"])


def _key_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            keys = Cut(part.column("text")).keys()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=["node", "text", "gram_key"])


def texts_of(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """``node`` and ``text``, once for each of ``nodes`` (``node``, an id, and ``gram_key``).

    An id may be repeated with other texts, so the key of the words decides as well.
    """
    wanted = nodes
    few = small_rows(wanted)
    if few is not None:  # at most the bounds of small_rows
        wanted = F.broadcast(docs.sparkSession.createDataFrame(few, schema=wanted.schema))
    ids = wanted.select(F.col("node").alias("_node"), F.col("gram_key").alias("_key"))
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    found = rows.join(ids.select("_node").distinct(), F.col("node") == F.col("_node"), "left_semi")
    keyed = found.mapInArrow(_key_of, "node long, text string, gram_key binary")
    right = (F.col("node") == F.col("_node")) & (F.col("gram_key") == F.col("_key"))
    return keyed.join(ids, right, "left_semi").dropDuplicates(["node", "gram_key"]).select("node", "text")


def ordered_sets(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node``, ``n_grams``, ``grams`` and ``often``: of the sets of ``texts`` (``node``, ``text``)
    those n-grams that another of them has too, rare ones first, and how many have them.
    ``sizes`` has ``node`` and ``n_grams``."""
    every = texts.mapInArrow(_grams, "node long, gram long")
    often = every.groupBy("gram").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") > 1)
    lists = every.join(often, "gram").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    return lists.join(sizes, "node").select(
        "node", "n_grams", F.col("grams.gram").alias("grams"), F.col("grams.n").alias("often"))


def prefix_groups(sets: DataFrame) -> DataFrame:
    """``node`` and ``group``: sets that share an n-gram of their prefixes, directly or not.

    The prefix of a set of n is its n - ceil(0.8 n) + 1 first n-grams; those that no other
    set has come before all ``grams`` and take up a part of it.
    """
    n, m = F.col("n_grams"), F.size("grams")
    prefix = n - F.ceil(n * F.lit(NUMERATOR) / F.lit(DENOMINATOR)) + 1 - (n - m)
    heads = sets.withColumn("prefix", prefix.cast("int")).filter(F.col("prefix") > 0).select(
        "node", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram"))
    first = heads.groupBy("gram").agg(F.min("node").alias("a"))
    ties = heads.join(first, "gram").filter(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
    return components(ties).select("node", F.col("component").alias("group"))


class TrieNode:
    __slots__ = ("run", "children", "ends", "least", "longest", "member", "mixed")

    def __init__(self, run: np.ndarray):
        self.run = run  # the n-grams of the edge above
        self.children: dict[int, TrieNode] = {}
        self.ends: list[int] = []  # sets that end here
        self.least = 1 << 60  # size of the smallest set below
        self.longest = 0  # most n-grams of one set below this node
        self.member, self.mixed = -1, False  # a set below; whether they may be unlinked


def similar(shared: int, one: int, other: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (one + other - shared)


class PrefixTree:
    """A trie of sets, with the classes of sets linked so far."""

    def __init__(self, sizes: list[int]):
        self.root = TrieNode(np.zeros(0, np.int64))
        self.sizes = sizes
        self.parent = list(range(len(sizes)))
        self.tested = 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def insert(self, at: int, grams: np.ndarray) -> None:
        node, done = self.root, 0
        while True:
            self._below(node, at, len(grams) - done)
            if done == len(grams):
                node.ends.append(at)
                return
            child = node.children.get(int(grams[done]))
            if child is None:
                child = TrieNode(grams[done:])
                node.children[int(grams[done])] = child
                self._below(child, at, 0)
                child.ends.append(at)
                return
            n = min(len(child.run), len(grams) - done)
            differ = np.flatnonzero(child.run[:n] != grams[done:done + n])
            n = int(differ[0]) if len(differ) else n
            if n < len(child.run):  # the edge is cut in two
                upper = TrieNode(child.run[:n])
                upper.least, upper.longest = child.least, child.longest + len(child.run) - n
                upper.member, upper.mixed = child.member, child.mixed
                node.children[int(upper.run[0])] = upper
                child.run = child.run[n:]
                upper.children[int(child.run[0])] = child
                child = upper
            node, done = child, done + n

    def _below(self, node: TrieNode, at: int, left: int) -> None:
        node.least = min(node.least, self.sizes[at])
        node.longest = max(node.longest, left)
        if node.member < 0:
            node.member = at
        elif not node.mixed and self.find(node.member) != self.find(at):
            node.mixed = True

    def link_similar(self, at: int, grams: np.ndarray) -> None:
        """Links set ``at`` with all similar sets of the trie, but for those linked already."""
        size, stack = self.sizes[at], [(self.root, 0, 0)]
        while stack:
            node, shared, passed = stack.pop()
            if not node.mixed and node.member >= 0 and self.find(node.member) == self.find(at):
                continue
            if len(node.run):
                place = np.searchsorted(grams, node.run)
                shared += int((grams[np.minimum(place, len(grams) - 1)] == node.run).sum())
                passed = int(np.searchsorted(grams, node.run[-1], "right"))
            most = shared + min(len(grams) - passed, node.longest)
            if not similar(most, size, max(node.least, 0)):
                continue
            for end in node.ends:
                self.tested += 1
                if similar(shared, size, self.sizes[end]):
                    self.parent[self.find(end)] = self.find(at)
            stack += [(child, shared, passed) for child in node.children.values()]


def _linked_few(sizes: list[int], grams: list[np.ndarray]) -> list[int]:
    """For each of a few sets one of its class; each set is compared with those not yet linked with it."""
    heads, ordered = list(range(len(sizes))), [np.sort(g) for g in grams]
    for at in range(1, len(sizes)):
        for other in range(at):
            few, many = sorted((ordered[at], ordered[other]), key=len)
            if heads[at] == heads[other] or not similar(len(few), sizes[at], sizes[other]):
                continue
            place = np.minimum(np.searchsorted(many, few), len(many) - 1)
            if similar(int((many[place] == few).sum()), sizes[at], sizes[other]):
                gone = heads[other]
                heads = [heads[at] if h == gone else h for h in heads]
    return heads


def _linked_many(sizes: list[int], grams: list[np.ndarray], often: np.ndarray) -> list[int]:
    """For each set one of its class, by the trie."""
    # numbers in the global order, frequent first, so that paths through the trie are shared
    different, first, place = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    rank = np.empty(len(different), np.int64)
    rank[np.lexsort((different, -often[first]))] = np.arange(len(different))
    numbers, cuts = rank[place], np.cumsum([0, *map(len, grams)])
    tree = PrefixTree(sizes)
    for at in range(len(sizes)):
        one = np.sort(numbers[cuts[at]:cuts[at + 1]])
        tree.link_similar(at, one)
        tree.insert(at, one)
    return [tree.find(i) for i in range(len(sizes))]


def _join_cell(rows: pa.Table) -> pa.RecordBatch:
    """Links in one cell of a group, as one pair for each set that is linked."""
    rows = rows.sort_by([("n_grams", "ascending"), ("node", "ascending")]).combine_chunks()
    nodes, sizes = rows["node"].to_numpy(), rows["n_grams"].to_pylist()
    lists = rows["grams"].combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    grams = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
    if len(sizes) <= FEW:
        found = _linked_few(sizes, grams)
    else:
        found = _linked_many(sizes, grams, rows["often"].combine_chunks().flatten().to_numpy().astype(np.int64))
    heads = nodes[found]
    linked = heads != nodes
    return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(heads[linked])], names=["a", "b"])


def _join_cells(cells: int) -> Callable:
    """Cell after cell of sorted rows, whose first ``cells`` columns name the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = np.column_stack([batch.column(i).to_numpy() for i in range(cells)])
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                same = held and all(held[0].column(c)[0] == batch.column(c)[i] for c in range(cells))
                if held and not same:
                    yield _join_cell(pa.Table.from_batches(held))
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield _join_cell(pa.Table.from_batches(held))

    return run


def _cells(members: DataFrame, cells: list[str]) -> DataFrame:
    rows = members.select(*cells, "node", "n_grams", "grams", "often")
    sorted_rows = rows.repartition(*cells).sortWithinPartitions(*cells)
    return sorted_rows.mapInArrow(_join_cells(len(cells)), "a long, b long")


def linked_sets(sets: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs ``a``, ``b`` of sets whose components are those of similarity."""
    members = stored(sets.join(groups, "node").select("node", "group", "n_grams", "grams", "often"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    sizes = sizes.select("group", F.ceil(F.col("n") / block).alias("blocks"))
    placed = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # the first block meets every other one
    met = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).when(
        F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1))
    links = stored(_cells(placed.withColumn("cell", F.explode(met)), ["group", "cell"]))
    large = placed.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return links
    known = components(links)
    classed = large.join(known, "node", "left").withColumn("class", F.coalesce("component", "node"))
    counts = classed.groupBy("group", "class").agg(F.count("*").alias("n"))
    main = counts.groupBy("group").agg(F.max_by("class", "n").alias("main"))
    rest = stored(classed.join(main, "group").filter(F.col("class") != F.col("main")))
    if rest.isEmpty():
        return links
    # what is not in the main class meets all blocks
    parts = rest.groupBy("group").agg(F.ceil(F.count("*") / block).alias("parts"))
    asked = rest.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select(
        "node", "group", "n_grams", "grams", "often", "part",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("cell"))
    stayed = large.join(parts, "group").select(
        "node", "group", "n_grams", "grams", "often",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("block").alias("cell"))
    both = asked.unionByName(stayed).dropDuplicates(["node", "group", "part", "cell"])
    return links.unionByName(_cells(both, ["group", "part", "cell"]))


def near_sets(docs: DataFrame, near: DataFrame, key: str, text: str) -> DataFrame:
    """The ordered sets of those of ``near`` that still share enough once copies are put together."""
    texts = stored(texts_of(docs, near.select("node", "gram_key"), key, text))
    again = sized_sets(texts, "node", "text")
    left = stored(again.filter(enough(F.col("shared"), F.col("n_grams"))).select(F.col("id").alias("node"), "n_grams"))
    return ordered_sets(texts.join(left, "node", "left_semi"), left)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``n_shingles`` and ``component_id``.

    A document's set has the different runs of five words (of fewer words, the whole
    sequence). Two documents are linked when their sets' similarity is 0.8 or more;
    ``component_id`` is the smallest ``key`` that links lead to, its own included. Without
    words or text a set is empty and linked with nothing. ``key`` is a whole number. Rows that
    repeat one with another text stand for themselves. A null key is linked with nothing
    but copies of its text. An empty table gives no rows. N-grams are compared by
    64-bit hashes.
    """
    sized = stored(sized_sets(docs, key, text))
    filled = sized.filter((F.col("n_grams") > 0) & F.col("id").isNotNull())
    classes = filled.groupBy("gram_key").agg(
        F.min("id").alias("node"), F.max("n_grams").alias("n_grams"), F.max("shared").alias("shared"))
    near = classes.filter(enough(F.col("shared"), F.col("n_grams"))).select("node", "gram_key", "n_grams")
    sets = stored(near_sets(docs, stored(near), key, text))
    links = linked_sets(sets, prefix_groups(sets))
    merged = components(links)
    class_of = classes.join(merged, "node", "left").select(
        "gram_key", F.coalesce("component", "node").alias("component_id"))
    return sized.join(class_of, "gram_key", "left").select(
        F.col("id").alias(key), F.col("n_grams").alias("n_shingles"),
        F.when(F.col("n_grams") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
