"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The vocabulary file is a public `tokenizers` JSON (BPE with word ends, byte
level); its path is a parameter. A document passes through in slices that end
before white space, so normalisation and splitting need no more than a slice;
where no white space comes, slices end before a character that no composition
reaches back from, and the word that stands open goes on in the next slice.
Inside a word, merging can reach back only as far as a chain of merges of
falling rank can carry information from right to left. The longest such chain,
computed once from the merge list, is the sufficient lookahead: a token that
ends at least that many symbols before the known end of the word is final and
is emitted. So even a word of millions of letters is held a window at a time.

What counts as a letter, numeral or white space is asked of the library's own
splitter, and texts beyond Latin-1 are normalised by its own normaliser, so
that both follow the Unicode tables that the library was built with.

Defined cases: a null text counts as empty (no tokens, empty decoded text);
special tokens that stand in a text become their ids, as in the library; a text
of any length is encoded whole, with or without blanks (only an unbroken run of
combining marks, which normalisation orders as one, is held as a whole);
repeated rows give repeated results; other columns may have any name and are
not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are normalised and split at a time.
SLICE = 1 << 16
#: Bytes of words and their ids, roughly, that a worker remembers; when full, it
#: starts anew. Words of over LONG characters are never remembered.
REMEMBERED, LONG = 128 << 20, 256
#: Symbols beyond the lookahead that are gathered before merging goes on.
BLOCK = 2048

#: Suffixes that the public vocabulary file's splitting rule parts
#: from words.
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
BLANKS = " \n\t\r"


def _ranges(points: Iterable[int]) -> str:
    """Rising code points as the inside of a character class."""
    runs = ([c for _, c in g] for _, g in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]))
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


class Splitter:
    """Normalisation and words as the library has them: suffixes, letter runs,
    single numerals, runs of anything else but white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        letters, numerals, others = self._classes(library.pre_tokenizer.pre_tokenize_str)
        words = lambda most: re.compile("|".join([*SUFFIXES, f"[{_ranges(c for c in letters if c < most)}]+", f"[{_ranges(c for c in numerals if c < most)}]", f"[{_ranges(c for c in others if c < most)}]+"]))
        self.narrow, self.wide = words(0x100), words(sys.maxunicode + 1)
        self.runs = [re.compile(f"[{_ranges(c)}]+") for c in (letters, others)]

    @staticmethod
    def _classes(split) -> tuple[list[int], list[int], list[int]]:
        """Letters, numerals, all else but white space: the splitter is given
        the code points in order, and what it leaves together is of one class."""

        def kind(c: str) -> int:
            return 0 if len(split("a" + c)) == 1 else 2 if len(split("." + c)) == 1 else 1

        found: tuple[list[int], list[int], list[int]] = ([], [], [])
        for plane in range(0, sys.maxunicode + 1, 0x10000):
            points = [c for c in range(plane, plane + 0x10000) if not 0xD800 <= c < 0xE000]
            # A plane of which each 64th code point is neither letter nor numeral holds none.
            if plane and len(split("".join(map(chr, points[::64])))) == 1 and kind(chr(plane)) == 2:
                found[2].extend(points)
                continue
            for _, (start, end) in split("".join(map(chr, points))):
                found[kind(chr(points[start]))].extend(points[start:end])
        return found

    def normal(self, text: str) -> tuple[str, bool]:
        """The normalised text and whether it lies within Latin-1."""
        if text.isascii():
            return text.lower(), True
        try:
            text.encode("latin-1")
            return text.lower(), True
        except UnicodeEncodeError:
            return self.normalise(text), False

    def words(self, text: str) -> list[str]:
        text, narrow = self.normal(text)
        return (self.narrow if narrow else self.wide).findall(text)


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@functools.cache
def safe_start() -> re.Pattern[str]:
    """A character before which a text can be cut: no composition or ordering of
    marks reaches back from it. ASCII, and letters that are not the second part
    of a composed character."""
    seconds = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul syllables
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            seconds.add(int(parts[1], 16))
    letters = (c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L" and not unicodedata.combining(chr(c)) and c not in seconds)
    return re.compile(f"[\\x00-\\x7f{_ranges(letters)}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge list with what the transducer derives from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.end] for c in letters]
        self.text = {i: t for t, i in (self.vocab | self.specials).items()}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.joined[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])

    def width(self, token: int) -> int:
        """Symbols (bytes) that a token spans."""
        return len(self.text[token].removesuffix(self.end)) or 1

    @functools.cached_property
    def lookahead(self) -> int:
        """Symbols after which a token is final.

        Whether the merge (u, v) happens can depend on what follows v only if
        an earlier merge takes v, or a right end of v, together with its right
        neighbour; that merge depends on what follows it in the same way. Ranks
        fall along such a chain, so its length is found in order of rank."""
        ends: dict[int, list[int]] = {}  # right ends of a token, itself first
        reach: dict[int, int] = {}  # by left part: symbols that its chains span
        most = 0
        for (left, right), (_, made) in sorted(self.joined.items(), key=lambda x: x[1][0]):
            tail = ends.setdefault(right, [right])
            far = self.width(right) + max((reach.get(t, 0) for t in tail), default=0)
            reach[left] = max(reach.get(left, 0), far)
            ends.setdefault(made, [made, *tail])
            most = max(most, far)
        return most + max(map(self.width, self.vocab.values()))

    def merge(self, symbols: list[int]) -> list[int]:
        """Repeatedly join the pair of lowest rank, the leftmost first."""
        joined = self.joined
        if len(symbols) > 48:
            return self._merge_long(symbols)
        get, none = joined.get, (len(joined), -1)
        pairs = [get(p, none) for p in itertools.pairwise(symbols)]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            symbols[i : i + 2] = (made := best[1],)
            del pairs[i]
            if i:
                pairs[i - 1] = get((symbols[i - 1], made), none)
            if i < len(pairs):
                pairs[i] = get((made, symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same by a heap and links, in n log n."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = list(symbols)
        heap = [(self.joined[p][0], i, p) for i, p in enumerate(itertools.pairwise(symbols)) if p in self.joined]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] == pair[0] else -1
            if j < 0 or alive[j] != pair[1]:
                continue
            alive[i], alive[j] = self.joined[pair][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (p := (alive[a], alive[b])) in self.joined:
                    heapq.heappush(heap, (self.joined[p][0], a, p))
        return [s for s in alive if s >= 0]

    def transduce(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one word given byte by byte; each is emitted once no
        further byte can change it."""
        window = Window(self)
        data = iter(data)
        while part := bytes(itertools.islice(data, BLOCK)):
            yield from window.feed(part)
        yield from window.close()

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        if len(data) > self.lookahead:
            return list(self.transduce(data))
        return self.merge([self.inner[b] for b in data[:-1]] + [self.final[data[-1]]])


class Window:
    """The transducer's state inside one word: symbols that a further byte can
    still change, and the last byte, which may end the word."""

    def __init__(self, merges: Merges):
        self.merges, self.held, self.last = merges, [], b""

    def feed(self, data: bytes) -> Iterator[int]:
        """Tokens that are final once these bytes of the word are known."""
        data = self.last + data
        self.last = data[-1:]
        merges, begin = self.merges, 0
        while begin < len(data) - 1:
            stop = min(len(data) - 1, begin + merges.lookahead + BLOCK - len(self.held))
            self.held += [merges.inner[b] for b in data[begin:stop]]
            begin = stop
            if len(self.held) == merges.lookahead + BLOCK:
                at, stable = 0, len(self.held) - merges.lookahead
                for token in merges.merge(list(self.held)):
                    if at + merges.width(token) > stable:
                        break
                    at += merges.width(token)
                    yield token
                del self.held[:at]

    def close(self) -> list[int]:
        """The tokens that are left, the word having ended."""
        rest = self.held + [self.merges.final[b] for b in self.last]
        self.held, self.last = [], b""
        return self.merges.merge(rest)


class Encoder:
    """Text to ids, a slice at a time. `words` finds the ids of words that are
    not remembered: the transducer unless another way is given. With `packed`,
    a piece's ids are little-endian unsigned 32-bit bytes, else a list."""

    def __init__(self, path: str, words=None, packed: bool = False):
        self.merges, self.split = Merges(path), splitter(path)
        words = words or (lambda missing: (tuple(self.merges.encode_word(w)) for w in missing))
        self.pack = (lambda ids: struct.pack(f"<{len(ids)}I", *ids)) if packed else list
        self.find = (lambda missing: map(self.pack, words(missing))) if packed else words
        self.join = b"".join if packed else lambda found: list(itertools.chain.from_iterable(found))
        self.known: dict[str, tuple[int, ...] | bytes] = {}
        self.room = REMEMBERED
        self.specials = {t: self.pack([i]) for t, i in self.merges.specials.items()}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    def ids_of(self, text: str) -> Iterator[list[int] | bytes]:
        """Pieces whose ids, one after the other, encode the text."""
        start = 0
        if self.special and "<" in text:
            for found in self.special.finditer(text):
                yield from self._plain(text[start : found.start()])
                yield self.specials[found.group()]
                start = found.end()
        yield from self._plain(text[start:] if start else text)

    def _plain(self, text: str) -> Iterator[list[int] | bytes]:
        at, n = 0, len(text)
        while n - at > SLICE:
            stop = max(text.rfind(c, at + 1, at + SLICE) for c in BLANKS)
            if stop < 0:
                stop = min((p for c in BLANKS if (p := text.find(c, at + SLICE)) >= 0), default=n)
                yield from self._unbroken(text, at, stop)
            else:
                yield self._ids(self.split.words(text[at:stop]))
            at = stop
        if at < n:
            yield self._ids(self.split.words(text[at:]))

    def _unbroken(self, text: str, at: int, end: int) -> Iterator[list[int] | bytes]:
        """A long stretch without blanks. A word that stands open at the end of
        a slice is held back, and passes through the transducer once it is long."""
        rest, open_word, run = "", None, None
        while at < end:
            stop = end if end - at <= SLICE else next((i for i in range(at + SLICE, at, -1) if safe_start().match(text, i)), 0)
            if not stop:
                found = safe_start().search(text, at + SLICE, end)
                stop = found.start() if found else end
            piece = self.split.normal(text[at:stop])[0]
            at = stop
            if open_word:
                going = run.match(piece)
                yield self.pack([*open_word.feed(going.group().encode() if going else b"")])
                if going and going.end() == len(piece) and at < end:
                    continue
                yield self.pack(open_word.close())
                open_word, piece = None, piece[going.end() if going else 0 :]
            rest += piece
            if at == end:
                break
            words = [m.span() for m in self.split.wide.finditer(rest)]
            # The last word may go on, and a mark with one letter may yet be a suffix.
            back = 1 + (len(words) > 1 and rest[slice(*words[-2])] == "'" and words[-1][1] - words[-1][0] == 1)
            hold = words[-back][0] if words and words[-1][1] == len(rest) else len(rest)
            yield self._ids([rest[s:e] for s, e in words if s < hold])
            rest = rest[hold:]
            if len(rest) > LONG and (run := next((r for r in self.split.runs if r.fullmatch(rest)), None)):
                open_word = Window(self.merges)
                yield self.pack([*open_word.feed(rest.encode())])
                rest = ""
        yield self._ids(self.split.wide.findall(rest))

    def _ids(self, words: list[str]) -> list[int] | bytes:
        known = self.known
        long = []
        if missing := set(words).difference(known):
            cost = sum(map(len, missing)) * 5 + 250 * len(missing)
            if cost > self.room:
                known.clear()
                missing = set(words)
                self.room = REMEMBERED
            self.room -= cost
            missing = list(missing)
            known.update(zip(missing, self.find(missing), strict=True))
            long = [w for w in missing if len(w) > LONG]
        ids = self.join(map(known.__getitem__, words))
        for w in long:
            self.room += 5 * len(w) + 250
            del known[w]
        return ids


class ByteToText:
    """Incremental machine from UTF-8 bytes to text: bytes of a character that
    is not complete yet are its state; broken ones become U+FFFD."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


class Decoder:
    """Ids to text in constant memory. `decode` gives the library's text (the
    vocabulary file names no decoder, so entries are parted by one blank);
    `readable` undoes the byte letters and turns word ends into blanks."""

    def __init__(self, merges: Merges):
        self.merges = merges
        size = max(merges.text) + 1
        self.pieces = [merges.text.get(i, "").encode() for i in range(size)]
        back = {c: b for b, c in enumerate(byte_letters())}
        self.raw = [b"" if i not in merges.text else merges.text[i].encode() if merges.text[i] in merges.specials else bytes(back[c] for c in merges.text[i].removesuffix(merges.end)) + b" " * (bool(merges.end) and merges.text[i].endswith(merges.end)) for i in range(size)]

    def decode(self, lists: Iterable[list[int]]) -> Iterator[str]:
        machine, sep = ByteToText(), b""
        for ids in lists:
            if ids:
                yield machine.feed(sep + b" ".join(map(self.pieces.__getitem__, ids)))
                sep = b" "
        yield machine.close()

    def readable(self, lists: Iterable[list[int]]) -> Iterator[str]:
        machine = ByteToText()
        for ids in lists:
            yield machine.feed(b"".join(map(self.raw.__getitem__, ids)))
        yield machine.close()


def library_words(path: str):
    """Ids of normalised words by the tokenizers library, which does not
    normalise them again. Parted by blanks, words encode as in their texts; the
    library tells which word an id belongs to."""
    from tokenizers import Tokenizer, normalizers

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True  # special tokens are cut out before
    library.normalizer = normalizers.Sequence([])

    def find(words: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            found = library.encode(" ".join(some), add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in some]
            for i, w in zip(found.ids, found.word_ids, strict=True):
                ids[w].append(i)
            yield from ids

    return find


@functools.lru_cache(maxsize=4)
def encoder(path: str, library: bool = False) -> Encoder:
    """One for each worker and vocabulary file. With `library`, words go
    through the tokenizers library and ids come packed."""
    return Encoder(path, library_words(path), packed=True) if library else Encoder(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).merges)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and `ids` array<int>."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in rows:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [[i for some in coder.ids_of(t or "") for i in some] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", readable: bool = False) -> DataFrame:
    """One row per document: id and `text`, from its ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for batch in rows:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = ["".join((back.readable if readable else back.decode)([ids or []])) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kept = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text in one stream and keep digests only:
    id, n_tokens, ids_sha256, decoded_sha256."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, back = encoder(path), decoder(path)
        number = [str(i) for i in range(len(back.pieces))]
        for batch in rows:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

                def seen() -> Iterator[list[int]]:
                    nonlocal n
                    for ids in coder.ids_of(text.as_py() or ""):  # noqa: B023
                        if ids:
                            ids_hash.update((" " * bool(n) + " ".join(map(number.__getitem__, ids))).encode())  # noqa: B023
                            n += len(ids)
                        yield ids

                for out in back.decode(seen()):
                    text_hash.update(out.encode())
                counts.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_text.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)
