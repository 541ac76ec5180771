"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary file (its path is a parameter).
It is one of bytes, so words are cut over their UTF-8 bytes: pieces may be parts
of a letter, and no letter of any script is unknown. Each language has a
probability for every piece. A word's probability is the sum over all ways to
cut it into pieces, by the forward algorithm; a text's is the product over its
words, and the languages' posterior gives the answer.
Words are runs of letters (Unicode categories L), split by the same code when
learning and when predicting.

Learning: at most `per_language` labelled training rows of each language,
chosen by the hash of their id, have all their words counted by Spark;
expectation maximisation, one task for each language, sets the piece
probabilities. A run of over TAUGHT letters, as scripts without blanks have,
teaches as consecutive runs of that length (it is scored whole). Prediction covers every whole text:
words are scored once for each worker and remembered, unknown ones together in
array operations.

Defined cases: a text that is null or has no letter is `und` with score 0, as
is every text if there is nothing to learn from; ties go to the smaller name;
rows with a null language teach nothing; of rows that repeat an id and language
each teaches; runs of any number of letters are scored whole; over
MAX_LANGUAGES languages are an error; other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut, held_out, sized_broadcast

PER_LANGUAGE, ROUNDS = 400, 4
#: Languages that a model can hold; more are an error.
MAX_LANGUAGES = 500
#: Bytes that a piece can have (more are an error), and characters of a text split at a time.
LONGEST, SLICE = 128, 1 << 16
#: Letters of a run that are learned from together, and bytes of a word whose
#: probabilities need no weighing.
TAUGHT, PLAIN = 32, 24
#: Word scores that a worker remembers; when full, it starts anew. Words of over
#: LONG letters are never remembered.
REMEMBERED, LONG = 200_000, 64
#: Words gathered before unknown ones are scored together.
GATHERED = 200_000
#: Numbers held while learning; beyond, they are found anew in each round.
HELD = 1 << 24
#: Weight of every piece besides its counts.
SMOOTH = 1e-2
BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters(narrow: bool = False) -> re.Pattern[str]:
    """Runs of letters; `narrow` for texts within U+00FF, where it is faster."""
    inside = (c for c in range(0x100 if narrow else sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L")
    runs = [[c for _, c in g] for _, g in itertools.groupby(enumerate(inside), lambda x: x[1] - x[0])]
    return re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]+")


def units(word: str) -> str:
    """A word's UTF-8 bytes, each as the character of its number."""
    return word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")


def read_pieces(path: str) -> list[str]:
    """The pieces of a rank file (base64 and rank on each line) that can lie in a
    word: bytes of letters, and bytes beyond ASCII, whole letters or not. Blanks
    around a piece are dropped, and what can be is lower-cased."""
    found = set()
    with open(path, "rb") as f:
        for line in f:
            if not line.split():
                continue
            piece = base64.b64decode(line.split()[0]).strip()
            try:
                piece = piece.decode().lower().encode()
            except UnicodeDecodeError:
                piece = piece.lower()
            if piece and all(c >= 0x80 or 97 <= c <= 122 for c in piece):
                found.add(piece.decode("latin-1"))
    if max(map(len, found), default=0) > LONGEST:
        raise ValueError(f"a piece has over {LONGEST} bytes")
    return sorted(found)


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width).astype(np.uint64)


class Pieces:
    """Looks up the pieces that end at a place, for many words at once: tables
    of slots by the high bits of a hash; what meets a taken slot in one has its
    slot in the next."""

    BITS = 18

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        self.keys: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        left = [(self._hash(p), i) for i, p in enumerate(pieces)]
        while left:
            left = self._place(left)

    def _slots(self, which: int, h: np.ndarray) -> np.ndarray:
        turned = h if which == 0 else (h ^ (h >> np.uint64(31))) * (BASE + np.uint64(2 * which))
        return (turned >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _place(self, given: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Fill a new table; returns what met a taken slot."""
        slots = self._slots(len(self.keys), np.array([h for h, _ in given], np.uint64))
        self.keys.append(np.zeros(1 << self.BITS, np.uint64))
        self.index.append(np.full(1 << self.BITS, -1))
        rest = []
        for (h, i), k in zip(given, slots, strict=True):
            if self.index[-1][k] < 0:
                self.keys[-1][k], self.index[-1][k] = h, i
            else:
                rest.append((h, i))
        return rest

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def prefix_hashes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
        return out

    def at(self, prefix: np.ndarray, i: int, length: int) -> np.ndarray:
        """Index of the piece that covers i - length to i; n (a single byte
        outside the vocabulary) or n + 1 (no piece) where there is none."""
        h = prefix[:, i] - prefix[:, i - length] * self.powers[length]
        out = np.full(len(h), self.n if length == 1 else self.n + 1)
        for which in range(len(self.keys)):
            k = self._slots(which, h)
            hit = (self.keys[which][k] == h) & (self.index[which][k] >= 0)
            out = np.where(hit, self.index[which][k], out)
        return out


def log_scores(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (as `units`) under each language, all cuts summed."""
    out = np.zeros((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for _, group in itertools.groupby(order, key=lambda i: len(words[i])):
        group = list(group)
        width = len(words[group[0]])
        step = max(1, (1 << 20) // (width * max(1, table.shape[1])))
        for at in range(0, len(group), step):
            some = group[at : at + step]
            prefix = pieces.prefix_hashes(_codes([words[i] for i in some], width))
            alphas, logs = [np.ones((len(some), table.shape[1]))], np.zeros((len(some), table.shape[1]))
            for i in range(1, width + 1):
                alphas.append(sum(alphas[-length] * table[pieces.at(prefix, i, length)] for length in range(1, min(pieces.longest, i) + 1)))
                alphas = alphas[-pieces.longest:]
                if i % 16 == 0:  # keeps long words within the range of doubles
                    scale = alphas[-1]
                    logs += np.log(scale)
                    alphas = [a / scale for a in alphas]
            out[some] = np.log(alphas[-1]) + logs
    return out


def learn_pieces(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation maximisation for one language; the last two entries are the
    byte outside the vocabulary and no piece. Each byte of a word is weighed so
    that the word's probability is 1, which changes no share of its cuts and
    keeps the sums within the range of doubles."""
    n = pieces.n
    p = np.full(n + 2, 1.0 / (n + 1))
    p[-1] = 0
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    groups: list[tuple[int, list[int], int]] = []  # letters, some words of so many, numbers to hold
    for width, group in itertools.groupby(order, key=lambda i: len(words[i])):
        cells = width * min(width, pieces.longest)
        some = list(group)
        step = max(1, HELD // 8 // cells)
        groups += [(width, some[at : at + step], cells * len(some[at : at + step])) for at in range(0, len(some), step)]

    def found_in(width: int, group: list[int]) -> dict[tuple[int, int], np.ndarray]:
        prefix = pieces.prefix_hashes(_codes([words[i] for i in group], width))
        return {(i, k): pieces.at(prefix, i, k).astype(np.int32) for i in range(1, width + 1) for k in range(1, min(pieces.longest, i) + 1)}

    kept = [found_in(w, g) for w, g, _ in groups] if sum(c for *_, c in groups) <= HELD else None
    for _ in range(rounds):
        seen = np.zeros(n + 2)
        for at, (width, group, _) in enumerate(groups):
            found, weight = kept[at] if kept else found_in(width, group), counts[group]
            chance = {at: p[where] for at, where in found.items()}
            if width > PLAIN:
                logs = log_scores(pieces, p[:, None], [words[i] for i in group])[:, 0]
                powers = np.exp(-logs / width)[None, :] ** np.arange(pieces.longest + 1)[:, None]
                chance = {(i, k): x * powers[k] for (i, k), x in chance.items()}
            forward = [np.ones(len(weight))]
            for i in range(1, width + 1):
                forward.append(sum(forward[i - k] * chance[i, k] for k in range(1, min(pieces.longest, i) + 1)))
            backward = [np.ones(len(weight))]
            for i in range(width - 1, -1, -1):
                backward.append(sum(backward[width - i - k] * chance[i + k, k] for k in range(1, min(pieces.longest, width - i) + 1)))
            backward.reverse()
            share = weight / np.maximum(forward[width], 1e-300)
            for (i, k), where in found.items():
                seen += np.bincount(where, share * forward[i - k] * chance[i, k] * backward[i], n + 2)
        seen[-1] = 0
        p = (seen + SMOOTH) / (seen.sum() + SMOOTH * (n + 1))
        p[-1] = 0
    return p


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word and n for the texts of each batch."""
    for batch in rows:
        seen: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for words in _split(text.as_py() or ""):
                seen.update((lang, w[at : at + TAUGHT]) for w in words for at in range(0, len(w), TAUGHT))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def train(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and the table of probabilities, from training rows."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out("id"))
    counts = cut(labelled.groupBy("lang").count())
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages to learn")
    # A hash thins each language to a few times what is taken, so that no task ranks all rows of a common one.
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / (1 << 32)
    thinned = labelled.select("id", "lang").join(F.broadcast(counts), "lang").where(share * F.col("count") < 4 * per_language)
    ranked = thinned.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")))
    chosen = cut(ranked.where(F.col("n") <= per_language).select("id", "lang").distinct())  # per_language rows of each language
    sample = labelled.join(sized_broadcast(chosen, per_language * MAX_LANGUAGES), ["id", "lang"], "left_semi")
    counted = sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = read_pieces(vocab)
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word")
        p = learn_pieces(Pieces(sent.value), [units(w) for w in group["word"]], group["n"].to_numpy(float))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "p": [p]})

    learned = counted.groupBy("lang").applyInPandas(learn, "lang string, p array<double>").orderBy("lang").toArrow()
    table = learned.column("p").combine_chunks().flatten().to_numpy().reshape(-1, len(pieces) + 2).T if learned.num_rows else np.zeros((len(pieces) + 2, 0))
    langs = learned.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    return [langs[i] for i in order], pieces, np.ascontiguousarray(table[:, order])


class Scorer:
    """A worker's model and the scores of the words it remembers."""

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray):
        self.pieces, self.table = Pieces(pieces), table
        self.known: dict[str, int] = {}
        self.scores = np.zeros((REMEMBERED + GATHERED, len(langs)))

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of each text, and whether it has a letter. Words of many
        texts, or slices of one, are gathered before unknown ones are scored."""
        total, some = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), bool)
        gathered: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            for words in _split(text.as_py() or ""):
                if words:
                    gathered.append((i, words))
                    some[i] = True
                    n += len(words)
                    if n >= GATHERED:
                        self._add(gathered, total)
                        gathered, n = [], 0
        self._add(gathered, total)
        return total, some

    def _add(self, gathered: list[tuple[int, list[str]]], total: np.ndarray) -> None:
        words = set().union(*(w for _, w in gathered))
        long = {w for w in words if len(w) > LONG}
        if long:
            found = list(long)
            scored = dict(zip(found, log_scores(self.pieces, self.table, [units(w) for w in found]), strict=True))
            for i, some in gathered:
                for w in long.intersection(some):
                    total[i] += scored[w] * some.count(w)
            gathered = [(i, [w for w in some if w not in long]) for i, some in gathered]
            words -= long
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > len(self.scores):
            self.known.clear()
            missing = words
        if len(missing) > len(self.scores):  # one slice with more different words than are remembered
            self.scores = np.zeros((len(missing), self.scores.shape[1]))
        new, begin = list(missing), len(self.known)
        if new:
            self.scores[begin : begin + len(new)] = log_scores(self.pieces, self.table, [units(w) for w in new])
            self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
        for i, some in gathered:
            total[i] += self.scores[np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))].sum(0)


_workers: dict[str, Scorer] = {}


def predict(df: DataFrame, model: tuple[list[str], list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (the posterior)."""
    key = uuid.uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sent.value[0]
        if key not in _workers:
            _workers.clear()
            _workers[key] = Scorer(*sent.value)
        scorer = _workers[key]
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                total, some = scorer.totals(part.column(1))
                best = total.argmax(1) if langs else np.zeros(len(total), int)
                post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if langs else np.zeros(len(total))
                some &= bool(langs)
                names = [langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(some, post, 0.0))], names=["id", "lang_pred", "score"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _split(text: str) -> Iterator[list[str]]:
    """Lists of lower-case letter runs; slices end after a blank or line end, or
    else after the next character that is no letter."""
    at, find = 0, letters()
    while len(text) - at > SLICE:
        stop = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE)) + 1
        if stop <= at:
            run = find.match(text, at + SLICE)
            stop = (run.end() if run else at + SLICE) + 1
        yield _words(text[at:stop])
        at = stop
    yield _words(text[at:] if at else text)


def _words(text: str) -> list[str]:
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return letters().findall(text)
    return letters(True).findall(text)


def identify(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the training rows and predict every row: id, held_out,
    lang_pred, score."""
    found = predict(df, train(df, vocab, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
