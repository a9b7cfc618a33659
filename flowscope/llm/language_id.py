"""Language of a text by unigram models of pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary, without case. For each language a
probability is learned for every piece. The probability of a word is the sum over all ways
to cut it into pieces (forward algorithm); a text is scored by the product over its words.
The piece probabilities are fitted by expectation-maximisation (forward and backward sums)
on the word counts of a bounded sample of labelled texts.

Sums run over many words of one length at once, in numpy; a worker keeps the scores of
words in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.llm.rows import keyed_texts, text_column

UNKNOWN = "und"
#: labelled texts of each language that the models are fitted on, and words of each
SAMPLE_TEXTS = 1_500
SAMPLE_WORDS = 60_000
ROUNDS = 3
#: letters of the longest runs that the models are fitted on; longer words are cut for that only
FIT_LETTERS = 48
#: longer words are summed one by one, so many positions at a time, and not kept
LONG_WORD, POSITIONS = 48, 4_096
#: pseudo-count of every piece, and probability of a letter that is no piece
SMOOTHING, UNSEEN = 0.05, 1e-6
#: keeps sums in range: every letter is scored this many times too high
LETTER_SCALE = 30.0
WORD_CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):  # numerals that are no digits, as in x², are no letters
        found = [w for part in found for w in "".join(c if c.isalpha() else " " for c in part).split(" ") if w]
    return found


#: stands for the space in front of a word
SPACE = "▁"


def read_pieces(path: str) -> list[str]:
    """Pieces of letters, with or without the space in front, of a sentencepiece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p and (p == SPACE or p.removeprefix(SPACE).isalpha()))


class Pieces:
    """Numbers of pieces, looked up by hashes of character codes; 0 is no piece."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        hashes = np.zeros(len(pieces), np.uint64)
        for n in sorted({len(p) for p in pieces}):
            at = [i for i, p in enumerate(pieces) if len(p) == n]
            for hashed in _hashes(_codes([pieces[i] for i in at], n), n):
                hashes[at] = hashed[:, 0]
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], (order + 1).astype(np.int32)
        if len(np.unique(hashes)) < len(pieces):
            raise ValueError("two pieces have the same hash")
        # the hashes that begin with these bits, so that a look-up is one gather and one compare
        self.bits = np.uint64(64 - 20)
        slots = self.hashes >> self.bits
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[slots] = np.arange(len(pieces))  # the last of equals
        self.crowded = bool(len(np.unique(slots)) < len(pieces))

    def look_up(self, hashed: np.ndarray) -> np.ndarray:
        at = self.slot[hashed >> self.bits]
        found = self.hashes[at] == hashed
        out = np.where(found, self.numbers[at], 0)
        if self.crowded:  # pieces that share a slot stand next to each other
            for back in (1, 2, 3):
                near = np.maximum(at - back, 0)
                out = np.where(self.hashes[near] == hashed, self.numbers[near], out)
        return out


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)


def _hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length from 1 to ``longest``, hashes of all substrings of that length."""
    rolled = np.zeros(codes.shape, np.uint64)
    for k in range(longest):
        rolled = rolled[:, :codes.shape[1] - k] * np.uint64(0x9E3779B97F4A7C15) + codes[:, k:] + np.uint64(1)
        mixed = rolled ^ (rolled >> np.uint64(29))
        yield mixed * np.uint64(0xBF58476D1CE4E5B9)


def piece_grid(pieces: Pieces, words: list[str]) -> list[np.ndarray]:
    """For words of one length: for each piece length, the piece number at every position."""
    codes = _codes([SPACE + w for w in words], len(words[0]) + 1)
    return [pieces.look_up(h) for h in _hashes(codes, min(pieces.longest, codes.shape[1]))]


def _weights(grid: list[np.ndarray], probabilities: np.ndarray) -> list[np.ndarray]:
    """Scaled probabilities of the pieces of a grid, by word, position and language."""
    out = []
    for k, numbers in enumerate(grid, 1):
        weight = probabilities[numbers]
        if k == 1:
            weight = np.maximum(weight, UNSEEN)
        out.append(weight * LETTER_SCALE ** k)
    return out


def forward(weights: list[np.ndarray]) -> np.ndarray:
    """Sums over all segmentations of every beginning: word, length of it, language."""
    n = weights[0].shape[1]
    sums = np.zeros((weights[0].shape[0], n + 1, weights[0].shape[2]))
    sums[:, 0] = 1.0
    for end in range(1, n + 1):
        for k in range(1, min(len(weights), end) + 1):
            sums[:, end] += sums[:, end - k] * weights[k - 1][:, end - k]
    return sums


def word_scores(pieces: Pieces, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), probabilities.shape[1]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = long_word_score(pieces, probabilities, words[i])
    for n in np.unique(lengths[lengths <= LONG_WORD]):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 4_096):
            some = at[i:i + 4_096]
            sums = forward(_weights(piece_grid(pieces, [words[j] for j in some]), probabilities))
            out[some] = np.log(sums[:, -1]) - (n + 1) * np.log(LETTER_SCALE)
    return out


def long_word_score(pieces: Pieces, probabilities: np.ndarray, word: str) -> np.ndarray:
    """As ``word_scores``, for one word of any length.

    Only the sums of the last positions are held, as a piece reaches back no further; they
    are brought back into range by a factor for each language whose logarithm is added up.
    """
    text, longest = SPACE + word, pieces.longest
    scale = LETTER_SCALE ** np.arange(1, longest + 1)[:, None]
    last = np.zeros((longest, probabilities.shape[1]))  # the sum at the position before, and so on
    last[0] = 1.0
    logs = np.zeros(probabilities.shape[1])
    for begin in range(0, len(text), POSITIONS):
        end = min(begin + POSITIONS, len(text))
        lead = max(0, begin - longest + 1)
        codes = _codes([text[lead:end]], end - lead)
        # by end and length of a piece: its number
        numbers = np.zeros((end - begin, longest), np.int64)
        for k, hashed in enumerate(_hashes(codes, min(longest, end - lead)), 1):
            found = pieces.look_up(hashed)[0]  # by begin of the piece, from ``lead`` on
            ends = np.arange(lead, lead + len(found)) + k - 1 - begin
            numbers[ends[ends >= 0], k - 1] = found[ends >= 0]
        weights = probabilities[numbers]
        weights[:, 0] = np.maximum(weights[:, 0], UNSEEN)
        weights *= scale
        for weight in weights:
            now = (last * weight).sum(0)
            last[1:] = last[:-1].copy()
            last[0] = now
            if now.min() < 1e-100 or now.max() > 1e100:
                logs += np.log(now)
                last /= now
    return np.log(last[0]) + logs - len(text) * np.log(LETTER_SCALE)


def fit(pieces: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities (piece number by language) from counts of words by language."""
    languages = counts.shape[1]
    probabilities = np.full((len(pieces.pieces) + 1, languages), 1.0 / len(pieces.pieces))
    probabilities[0] = 0.0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    groups = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 4_096):
            some = at[i:i + 4_096]
            groups.append((piece_grid(pieces, [words[j] for j in some]), counts[some]))
    for _ in range(ROUNDS):
        expected = np.full(probabilities.shape, SMOOTHING)
        for grid, seen in groups:
            weights = _weights(grid, probabilities)
            ahead = forward(weights)
            back = forward([w[:, ::-1] for w in weights])[:, ::-1]  # by what is left of the word
            share = seen / ahead[:, -1]
            for k, numbers in enumerate(grid, 1):
                n = numbers.shape[1]
                used = ahead[:, :n] * weights[k - 1] * back[:, k:k + n] * share[:, None, :]
                for language in range(languages):
                    expected[:, language] += np.bincount(
                        numbers.ravel(), used[:, :, language].ravel(), len(expected))
        expected[0] = 0.0
        probabilities = expected / expected.sum(0)
    return probabilities


class Model:
    """What scoring needs: pieces, their probabilities and the names of the languages."""

    def __init__(self, pieces: Pieces, probabilities: np.ndarray, languages: list[str]):
        self.pieces, self.probabilities, self.languages = pieces, probabilities, languages
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))
        self.used = 0

    def __getstate__(self):
        return self.pieces, self.probabilities, self.languages

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.cache, self.used, self.rows = {}, 0, self.rows[:0]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of all ``words`` together in each language."""
        long = [w for w in words if len(w) > LONG_WORD]
        if long:
            short = self.scores([w for w in words if len(w) <= LONG_WORD])
            return short + sum(long_word_score(self.pieces, self.probabilities, w) for w in long)
        new = list({w for w in words if w not in self.cache})
        if self.used + len(new) > WORD_CACHE:
            self.cache.clear()
            self.used = 0
            new = list(set(words))
        if self.used + len(new) > len(self.rows):
            more = np.zeros((max(2 * len(self.rows), self.used + len(new), 4_096), len(self.languages)))
            more[:self.used] = self.rows[:self.used]
            self.rows = more
        if new:
            self.rows[self.used:self.used + len(new)] = word_scores(self.pieces, self.probabilities, new)
            self.cache.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior share under equal priors."""
        names, shares, parts = [], [], [words_of(t) for t in texts]
        self._fill(parts)
        for words in parts:
            if not words or not self.languages:
                names.append(UNKNOWN)
                shares.append(0.0)
                continue
            total = self.scores(words)
            best = int(total.argmax())  # the first of equals, languages being sorted
            names.append(self.languages[best])
            shares.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, shares

    def _fill(self, parts: list[list[str]]) -> None:
        """New words of many texts are scored together."""
        every = list({w for words in parts for w in words if len(w) <= LONG_WORD})
        if self.languages and len(every) < WORD_CACHE:
            self.scores(every)


#: rows turned into Python strings at once
SLICE = 512


def _predict(model: Broadcast, field: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                names, shares = own.predict(text_column(part, field).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                    names=["key", "lang_pred", "score"])
        own.forget()  # the worker goes on to other work

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word of each text, long ones in parts."""
    for batch in batches:
        languages, words = [], []
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own = [w[i:i + FIT_LETTERS] for w in words_of(text) for i in range(0, len(w), FIT_LETTERS)]
            words += own
            languages += [language] * len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()), pa.array(words, pa.string())], names=["lang", "word"])


def train(
    labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang",
    sample_texts: int = SAMPLE_TEXTS, sample_words: int = SAMPLE_WORDS,
) -> Model:
    """Fits the models on at most ``sample_texts`` texts of each language.

    The sample takes the texts with the smallest hashes, so it depends on the texts alone,
    and on copies of a text only once. Of each language the ``sample_words`` most frequent
    words of the sample are fitted on. Rows with a null text or language take no part;
    without any labelled row the model knows no language and predicts ``und``. There must
    be few languages: one window partition ranks the sample of each.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.xxhash64("text")
    # different texts, however many copies they have; 2 % more or less matter to nothing
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.approx_count_distinct(rank, 0.02).alias("n")).collect()}
    if not sizes:
        return Model(Pieces(read_pieces(vocabulary)), np.zeros((1, 0)), [])
    # the share of hashes that leaves about twice the sample is cut off before any shuffle
    share = F.create_map(*[
        x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, 2.0 * sample_texts / max(n, 1))))])
    near = rows.withColumn("rank", rank).filter(
        F.col("rank") / F.lit(2.0 ** 64) + 0.5 <= F.element_at(share, F.col("lang")))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("rank", "text"))
    sample = near.dropDuplicates(["lang", "rank"]).withColumn("nth", nth).filter(F.col("nth") <= sample_texts)
    counted = (
        sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string")
        .groupBy("lang", "word").agg(F.count("*").alias("n")))
    top = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    table = counted.withColumn("nth", top).filter(F.col("nth") <= sample_words).toArrow()
    languages = sorted(sizes)
    words = sorted(set(table.column("word").to_pylist()))
    at, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    for language, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts[at[word], column[language]] = n
    pieces = Pieces(read_pieces(vocabulary))
    return Model(pieces, fit(pieces, words, counts), languages)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``lang_pred`` and ``score`` (0 to 1), over the whole text.

    A null text, or one without letters, is ``und`` with score 0. Of equally likely
    languages the first by name is taken. Rows keep their multiplicity. ``text`` may be a field
    of ``key``, as in "row.text", and is then sent to the workers once.
    """
    rows, field = keyed_texts(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared, field), f"key {kind}, lang_pred string, score double").select(
        F.col("key").alias(key), "lang_pred", "score")
