"""Near copies by SimHash at a similarity of 0.8 over five-word shingles.

The 64-bit fingerprints of `simhash` link at 3 bits, and texts with a Jaccard
similarity of 0.8 differ in about 10 of 64. So this form takes a wide
fingerprint of `BANDS` bands: signs of random projections of the set of a text's
distinct shingles. Set bits of the projections come from a hashed count vector
turned twice by random signs and a Hadamard matrix, in exact whole numbers.

Anchors are, in each band, the words of the 31-bit Hamming code (covering
radius 1). A band's threshold is 0, so a fingerprint goes to every anchor within
radius 1 + 0: exactly one in each band. At similarity s two sets differ in a
share p of bits, cos(pi p) = 2 s / (1 + s), and meet in a band with a chance of
about (1 - p)^26; `BANDS` is chosen so that at 0.8 nine pairs in ten meet.
At an anchor 64 further bits tell chance meetings off. What remains is compared
on all bits (standard error of the similarity about 0.012); links within four
errors of the limit are settled by the shingle sets of the texts themselves,
unless surer links join their texts already.

Only distinct shingle sets are sent. Of what is at an anchor leaders are held: a
row links to all leaders before it that it is near, and leads if there is none.
Every batch does so before the exchange, on whole fingerprints and by likely links
only, and sends its leaders and spanning links alone, so a dense group of any
size crowds no anchor and does not yield all its pairs. At an anchor the check
decides who meets. Where a meeting turns out not to be likely, as among the pages
of one template, a leader has covered rows that are not like it; so all rows of
such an anchor meet once more with their whole fingerprints, and there again
only likely links cover: those whose fingerprints tell 0.8 or more. What travels twice is linear in the rows of such anchors.
A link between a row that a likely link covers and a row that its leader is not
near is found only in bands where the former leads.

Defined cases: null texts count as empty; texts without words have equal sets and
are near copies of each other; fewer words than five are one shingle; texts of
any length are read whole; of rows that repeat an id and a text one stays; other
columns may have any name; an empty table gives an empty result. Shingles and
sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut
from lodestar.llm.simhash import _words, keep_one
from lodestar.operators.components import connected_components

#: Words of a shingle, and the similarity from which texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Bands of 32 bits (31 make the anchor) and the words of the check that follow.
BANDS, CHECK = 164, 2
#: Differing bits of the 64 of the check up to which a meeting is looked at.
MEET = 18
#: Standard errors from the limit within which a link covers.
COVER = 0
#: Size of the hashed count vector, and texts turned at once.
DIM, TOGETHER = 8192, 16
MIX = 0x9E3779B97F4A7C15


def limit(similarity: float, errors: float) -> int:
    """Differing bits of wide fingerprints at that similarity, and so many standard errors."""
    bits = 32 * (BANDS + CHECK)
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    digest, found, last = xxhash.xxh64_intdigest, [], np.zeros(0, np.uint64)
    for words in _words(data):
        hashes = np.concatenate([last, np.fromiter(map(digest, words), np.uint64, len(words))])
        if (n := len(hashes) - width + 1) > 0:
            found.append(np.unique(_rolled(hashes, n, width)))
            last = hashes[n:]
        else:
            last = hashes
    if not found:
        found = [_rolled(last, 1, len(last))]
    return np.unique(np.concatenate(found))


def _rolled(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = (total ^ hashes[i : i + n]) * np.uint64(MIX)
        total ^= total >> np.uint64(29)
    return total


def _signs() -> np.ndarray:
    return 1.0 - 2.0 * np.random.default_rng(42).integers(0, 2, (2, DIM, 1))


def _turn(x: np.ndarray) -> None:
    """Multiplies the columns of x by a Hadamard matrix, in place."""
    step, columns = 1, x.shape[1]
    while step < DIM:
        y = x.reshape(-1, 2, step * columns)
        difference = y[:, 0] - y[:, 1]
        y[:, 0] += y[:, 1]
        y[:, 1] = difference
        step *= 2


def wide(sets: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """A row of BANDS + CHECK 32-bit words for each set of shingle hashes."""
    x = np.empty((DIM, len(sets)))
    shift = np.uint64(64 - DIM.bit_length() + 1)
    for i, h in enumerate(sets):
        x[:, i] = np.bincount((h >> shift).astype(np.int64), 1.0 - 2.0 * (h & np.uint64(1)), DIM)
    for sign in signs:
        x *= sign
        _turn(x)
    bits = np.ascontiguousarray((x[: 32 * (BANDS + CHECK)] > 0).T)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4")


def homes(words: np.ndarray) -> np.ndarray:
    """The key of the nearest anchor of each band: band and code word."""
    v = words[:, :BANDS] & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros(v.shape, np.uint32)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        syndrome |= (np.bitwise_count(v & np.uint32(mask)) & 1).astype(np.uint32) << np.uint32(j)
    home = v ^ (np.left_shift(np.uint32(1), syndrome) >> np.uint32(1))
    return home.astype(np.int64) + (np.arange(BANDS, dtype=np.int64) << 31)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark (a hash of the text), set (a hash of its shingles), words (the wide fingerprint)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs()
        for batch in rows:
            names, words = [], []
            for at in range(0, batch.num_rows, TOGETHER):
                sets = [shingles(t.as_py() or b"") for t in batch.column(1).slice(at, TOGETHER)]
                names += [xxhash.xxh3_64_intdigest(s) for s in sets]
                words += [w.tobytes() for w in wide(sets, signs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(words, pa.binary())], names=["id", "mark", "set", "words"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = df.select(F.col(id_col).alias("id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("mark"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, mark long, set long, words binary")


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), BANDS + CHECK)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two or more equal keys."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(new[1:], len(keys))
    several = ends - new > 1
    return zip(new[several].tolist(), ends[several].tolist(), strict=True)


def _led(prints: np.ndarray, most: int, cover: int) -> tuple[np.ndarray, list[tuple[np.ndarray, int, np.ndarray]]]:
    """Which rows no leader covers, and for each leader the rows near it with the
    differing bits; those of at most `cover` bits it covers."""
    free, found = np.ones(len(prints), bool), []
    for i in range(len(prints) - 1):
        if free[i]:
            bits = np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(1, dtype=np.int64)
            near = np.flatnonzero(bits <= most)
            if len(near):
                free[near[bits[near] <= cover] + i + 1] = False
                found.append((near + i + 1, i, bits[near]))
    return free, found


def _spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """One link from each of n rows to the smallest that pairs join it to."""
    one, two = pairs[:, 0], pairs[:, 1]
    label, was = np.arange(n), None
    while was is None or (label != was).any():
        was = label.copy()
        least = np.minimum(was[one], was[two])
        for at in (one, two, was[one], was[two]):
            np.minimum.at(label, at, least)
        label = label[label]
    rows = np.flatnonzero(label != np.arange(n))
    return np.stack([rows, label[rows]], 1)


def _sent(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, a, b: a set and its check at each anchor that it leads in its batch;
    a link between sets under a negative key, odd if it is sure. Of the sure ones
    those that span their groups are sent."""
    most, cover, sure = limit(SIMILARITY, 4), limit(SIMILARITY, COVER), limit(SIMILARITY, -4)
    for batch in rows:
        if not batch.num_rows:
            continue
        sets, words = batch.column(0).to_numpy(), _words_of(batch.column(1))
        keys = homes(words).ravel()
        order = np.argsort(keys, kind="stable")
        leads, links = np.ones(len(keys), bool), []
        for start, end in _runs(keys[order]):
            cells = order[start:end]
            members = cells // BANDS
            free, found = _led(words[members], most, cover)
            leads[cells[~free]] = False
            links += [np.stack([members[near], np.full(len(near), members[i]), bits], 1) for near, i, bits in found]
        at = np.flatnonzero(leads)
        checks = np.ascontiguousarray(words[:, BANDS:]).view(np.int64)[:, 0]
        pairs = np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 3), np.int64)
        spanning = _spanning(pairs[pairs[:, 2] <= sure, :2], len(sets))
        pairs = np.concatenate([spanning, pairs[pairs[:, 2] > sure, :2]])
        src, dst = sets[pairs[:, 0]], sets[pairs[:, 1]]
        passing = -2 - 2 * (src & 0x7FFFFFFF) + (np.arange(len(src)) < len(spanning))
        columns = [np.concatenate(c) for c in ([keys[at], passing], [sets[at // BANDS], src], [checks[at // BANDS], dst])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b"])


SURE, UNSURE, MEMBER = range(3)


def _met(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows that meet at an anchor: kind, key, src, dst; of anchors
    with meetings every row as a member. Leaders of a batch's last anchor pass to
    the next batch."""
    carried, touched = tuple(np.zeros(0, np.int64) for _ in range(3)), None
    for batch in rows:
        if not batch.num_rows:
            continue
        given = [batch.column(i).to_numpy() for i in range(3)]
        linked = given[0] < 0
        sure = (given[0][linked] & 1).astype(bool)
        out = [(np.where(sure, SURE, UNSURE), given[0][linked], given[1][linked], given[2][linked])]
        key, name, check = (np.concatenate([c, g[~linked]]) for c, g in zip(carried, given, strict=True))
        free = np.ones(len(key), bool)
        prints = check.view(np.uint64)[:, None]
        met = key[:0]
        for start, end in _runs(key):
            free[start:end], found = _led(prints[start:end], MEET, MEET)
            for near, i, _ in found:
                out.append((np.full(len(near), UNSURE), key[start + near], name[start + near], np.full(len(near), name[start + i])))
            if found:
                met = np.append(met, key[start])
        if touched is not None:
            met = np.append(met, touched)
        some = np.isin(key, met)
        out.append((np.full(some.sum(), MEMBER), key[some], name[some], name[some]))
        last = free & (key == key[-1]) if len(key) else free
        touched = key[-1] if len(key) and key[-1] in met else None if len(key) else touched
        carried = (key[last], name[last], check[last])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["kind", "key", "src", "dst"])


def _again(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by whole fingerprints of the rows of each anchor (key, set, words);
    likely ones cover. Of a batch's sure links those that span its groups are
    told, with no differing bits, and of the doubtful ones those between groups."""
    most, cover, sure = limit(SIMILARITY, 4), limit(SIMILARITY, COVER), limit(SIMILARITY, -4)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS + CHECK), np.uint32))
    for batch in rows:
        if not batch.num_rows:
            continue
        given = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _words_of(batch.column(2)))
        key, name, words = (np.concatenate([h, g]) for h, g in zip(held, given, strict=True))
        free = np.ones(len(key), bool)
        out = [(np.zeros(0, np.int64),) * 3]
        for start, end in _runs(key):
            free[start:end], found = _led(words[start:end], most, cover)
            out += [(name[start + near], np.full(len(near), name[start + i]), bits) for near, i, bits in found]
        last = free & (key == key[-1])
        held = (key[last], name[last], words[last])
        src, dst, bits = (np.concatenate(c) for c in zip(*out, strict=True))
        names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        pairs = at.reshape(2, -1).T
        spanning = _spanning(pairs[bits <= sure], len(names))
        group = np.arange(len(names))
        group[spanning[:, 0]] = spanning[:, 1]
        apart = (bits > sure) & (group[pairs[:, 0]] != group[pairs[:, 1]])
        told = np.concatenate([np.column_stack([spanning, np.zeros(len(spanning), np.int64)]), np.unique(np.column_stack([pairs, bits])[apart], axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(names[told[:, 0]]), pa.array(names[told[:, 1]]), pa.array(told[:, 2].astype(np.int32))], names=["src", "dst", "bits"])


def _differing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        bits = np.bitwise_count(_words_of(batch.column(2)) ^ _words_of(batch.column(3))).sum(1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], names=["src", "dst", "bits"])


def _alike(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            one, two = shingles(a.as_py()), shingles(b.as_py())
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(both / (len(one) + len(two) - both) >= SIMILARITY)
        yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))


def _both(links: DataFrame, sides: DataFrame, value: str) -> DataFrame:
    """src, dst and the value of each side."""
    one = sides.select(F.col("set").alias("src"), F.col(value).alias("one"))
    two = sides.select(F.col("set").alias("dst"), F.col(value).alias("two"))
    return links.join(one, "src").join(two, "dst").select("src", "dst", "one", "two")


def links(df: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """src, dst: sets of shingles whose similarity is `SIMILARITY` or more, as
    many as join all that such links join."""
    nodes = cut(rows.groupBy("set").agg(F.first("words").alias("words")))
    sent = nodes.mapInArrow(_sent, "key long, a long, b long").repartition("key").sortWithinPartitions("key", "a")
    met = cut(sent.mapInArrow(_met, "kind long, key long, src long, dst long").distinct())
    pair = lambda one, two: (F.greatest(one, two).alias("src"), F.least(one, two).alias("dst"))
    named = met.select("kind", "key", *pair("src", "dst"))
    linked = named.where(F.col("kind") != MEMBER).groupBy("src", "dst").agg((F.min("kind") == SURE).alias("sure"))
    unsure = cut(_both(linked.where("NOT sure"), nodes, "words").mapInArrow(_differing, "src long, dst long, bits int"))
    sure = F.col("bits") <= limit(SIMILARITY, -4)
    open_ = named.where((F.col("kind") == UNSURE) & (F.col("key") >= 0)).join(unsure.where(F.col("bits") > limit(SIMILARITY, COVER)), ["src", "dst"]).select("key").distinct()
    members = met.where(F.col("kind") == MEMBER).join(open_, "key", "left_semi").select("key", F.col("src").alias("set"))
    whole = members.join(nodes, "set").select("key", "set", "words").repartition("key").sortWithinPartitions("key", "set")
    again = whole.mapInArrow(_again, "src long, dst long, bits int").select(*pair("src", "dst"), "bits")
    compared = cut(unsure.where(F.col("bits") <= limit(SIMILARITY, 4)).unionByName(again).distinct())
    known = cut(linked.where("sure").select("src", "dst").unionByName(compared.where(sure).select("src", "dst")))
    # A doubtful link within a group that sure links make joins nothing new.
    group = cut(connected_components(known))
    side = lambda end: group.select(F.col("node").alias(f"_{end}"), F.col("component").alias(f"of_{end}"))
    placed = compared.where(~sure).join(side("src"), F.col("src") == F.col("_src"), "left").join(side("dst"), F.col("dst") == F.col("_dst"), "left")
    doubtful = cut(placed.where(F.coalesce("of_src", "src") != F.coalesce("of_dst", "dst")).select("src", "dst"))
    sides = doubtful.select(F.explode(F.array("src", "dst")).alias("set")).distinct()
    first = rows.join(sides, "set").groupBy("set").agg(F.min(F.struct("id", "mark")).alias("at")).select("set", "at.*")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("t"))
    same = texts["id"].eqNullSafe(first["id"]) & (texts["mark"] == first["mark"])
    texts = cut(texts.join(first, same).groupBy("set").agg(F.first("t").alias("t")))
    exact = _both(doubtful, texts, "t").mapInArrow(_alike, "src long, dst long")
    return cut(known.unionByName(exact))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark and component (one set of each group) for every row."""
    rows = cut(fingerprints(df, id_col, text_col))
    linked = connected_components(links(df, rows, id_col, text_col))
    found = rows.select("id", "mark", "set").join(linked, F.col("set") == F.col("node"), "left")
    return found.select("id", "mark", F.coalesce("component", "set").alias("component"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group exactly one row stays, as in `simhash.drop_near_copies`."""
    return keep_one(df, groups(df, id_col, text_col), id_col, text_col)
