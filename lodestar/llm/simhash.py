"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64 bits; two link at `most` = 3 or fewer differing bits. Cut
into two halves, at least one half of such a pair differs in at most one bit.
On 31 bits of a half the anchors are the words of the Hamming code: covering
radius 1, each fingerprint has exactly one nearest anchor. A fingerprint goes
to every anchor within covering radius plus the half's threshold (1 + 1 = 2):
its own and 15 others at most, whatever the data. So the nearest anchor of
either of a pair is reached by the other, and fingerprints are compared, on
all 64 bits, at the anchor alone.

Only distinct fingerprints are sent. At an anchor the fingerprints whose
nearest it is are held, all others stream past in blocks; a union-find over
those held leaves at most one link for each newcomer and each join of groups,
so a dense group does not yield all its pairs. Anchors that hold over `hot`
fingerprints are split by salt: each task holds a part, all meet each part.
Where over `hot` fingerprints share a half, those that only pass an anchor are
split too, each part meeting all that the anchor holds.

Defined cases: a null text counts as empty and has fingerprint zero, which
links like any other; texts of any length are read whole, a slice at a time;
rows that repeat an id are kept; a component whose ids are all null has a null
id; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, sized_broadcast, unique_name
from lodestar.operators.components import connected_components

#: Differing bits at which two fingerprints still link.
MOST = 3
#: Fingerprints held at one anchor by one task; beyond, an anchor is salted.
HOT = 50_000
#: Comparisons made at once.
CELLS = 1 << 21
#: Bytes of a text, and shingles, worked on at once.
SLICE, BLOCK = 1 << 20, 1 << 15
BITS = 31


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Lower-case words in lists; a slice ends between words where it can."""
    at = 0
    while len(data) - at > SLICE:
        stop = max(data.rfind(c, at, at + SLICE) for c in b" \n\t\r\x0b\x0c")
        stop = stop if stop > at else min((p for c in b" \n\t\r\x0b\x0c" if (p := data.find(c, at + SLICE)) >= 0), default=len(data))
        yield data[at:stop].lower().split()
        at = stop
    yield data[at:].lower().split()


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits over the hashes of all shingles of `width` words."""
    digest = xxhash.xxh64_intdigest
    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in _words(data):
        words = last + words
        for at in range(0, max(0, len(words) - width + 1), BLOCK):
            part = words[at : at + BLOCK + width - 1]
            hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(width)), strict=False)], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
        last = words[-(width - 1) :] if width > 1 else []
    if not n and last:  # fewer words than a shingle
        return digest(b" ".join(last), seed)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long) and mark, a hash of the text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["id", "fp", "mark"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = df.select(F.col(id_col).alias("id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("mark"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long, mark long")


def _syndrome(v: Column) -> Column:
    """Xor of the positions (1 to 31) of the set bits."""
    masks = [sum(1 << (p - 1) for p in range(1, BITS + 1) if p >> j & 1) for j in range(5)]
    parts = [F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(m))).cast("long") % 2, j) for j, m in enumerate(masks)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _bit(position: Column) -> Column:
    """The word with that one bit set, position 0 being none."""
    words = F.array(*(F.lit(1 << p >> 1).cast("long") for p in range(BITS + 1)))
    return F.element_at(words, (position + 1).cast("int"))


def _sided(nodes: DataFrame) -> DataFrame:
    """Each fingerprint's halves: v (31 bits), s (syndrome) and home (its
    nearest anchor)."""
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    v = F.expr("shiftrightunsigned(fp, 32 * half) & 2147483647L")
    sided = nodes.select("fp", half.alias("half")).withColumn("v", v).withColumn("s", _syndrome(F.col("v")))
    return sided.withColumn("home", F.col("v").bitwiseXOR(_bit(F.col("s"))) + F.shiftleft(F.col("half").cast("long"), BITS))


def _passed() -> Column:
    """The anchors besides its own that a half goes to: two bits away."""
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(BITS)), lambda i: (i < i.bitwiseXOR(F.col("s").cast("int"))) & (i != F.col("s"))),
        lambda i: F.struct(
            (F.col("v").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(F.col("s").cast("int")))) + F.shiftleft(F.col("half").cast("long"), BITS)).alias("key"),
            F.lit(False).alias("held"),
        ),
    )


def anchored(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """key, salt, part, held, fp: every distinct fingerprint at every anchor
    within reach; `held` where it is the fingerprint's nearest anchor. Each salt
    of a key holds its share of the fingerprints; parts of a salt hold the same
    and each sees its share of those that pass."""
    sided = _sided(nodes)
    halves = sided.groupBy("half", "v", "s", "home").count()
    salts = halves.groupBy("home").agg(F.sum("count").alias("n")).where(F.col("n") > hot).select(F.col("home").alias("key"), F.ceil(F.col("n") / hot).cast("int").alias("salts"), F.lit(1).alias("parts"))
    passing = halves.where(F.col("count") > hot).select(F.explode(_passed()).alias("at"), "count").groupBy("at.key").agg(F.sum("count").alias("n"))
    parts = passing.select("key", F.lit(1).alias("salts"), F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    crowded = cut(salts.unionByName(parts).groupBy("key").agg(F.max("salts").alias("salts"), F.max("parts").alias("parts")))
    home = F.array(F.struct(F.col("home").alias("key"), F.lit(True).alias("held")))
    rows = sided.select("fp", F.explode(F.concat(home, _passed())).alias("at")).select("at.key", "at.held", "fp")
    rows = rows.join(sized_broadcast(crowded, 100_000), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = rows.withColumn("held", F.col("held") & (F.col("own") == F.col("salt")))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    rows = rows.withColumn("part", F.explode(F.when(F.col("held"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    return rows.select("key", "salt", "part", "held", "fp")


class _Anchor:
    """Compares what streams past one anchor with what it holds."""

    def __init__(self, most: int):
        self.most, self.key, self.held = most, None, np.zeros(0, np.uint64)
        self.group_of = np.zeros(0, np.int64)  # of those held, the group each is linked to

    def meet(self, fps: np.ndarray, from_held: int | None = None) -> list[tuple[int, int]]:
        """Links of newcomers to those held, one for each group that a newcomer
        meets; the groups become one. from_held: position of the first newcomer
        if they are held themselves."""
        links: list[tuple[int, int]] = []
        if not len(self.held):
            return links
        step = max(1, CELLS // len(self.held))
        for at in range(0, len(fps), step):
            some = fps[at : at + step]
            near = np.bitwise_count(some[:, None] ^ self.held[None, :]) <= self.most
            if from_held is not None:
                near[np.arange(len(some)), np.arange(len(some)) + at + from_held] = False
            for i in np.flatnonzero(near.any(1)):
                others = np.flatnonzero(near[i])
                groups, first = np.unique(self.group_of[others], return_index=True)
                if from_held is not None:
                    own = self.group_of[at + i + from_held]
                    groups, first = groups[groups != own], first[groups != own]
                else:
                    own = groups[0]
                links += [(int(some[i]), int(self.held[j])) for j in others[first]]
                if len(groups) > (from_held is None):
                    self.group_of[np.isin(self.group_of, groups)] = own
        return links

    def group(self, key, held: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        """Rows of one anchor (key, salt, part), held ones first; a later call
        may go on with it."""
        links = []
        if key != self.key:
            self.key, self.held, self.group_of = key, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n := int(held.sum()):
            begin = len(self.held)
            self.held = np.concatenate([self.held, fps[:n]])
            self.group_of = np.concatenate([self.group_of, np.arange(begin, begin + n)])
            if key[2] == 0:  # the other parts hold the same
                links += self.meet(fps[:n], begin)
        if n < len(fps):
            links += self.meet(fps[n:])
        return links


def links(nodes: DataFrame, most: int = MOST, hot: int = HOT) -> DataFrame:
    """src, dst: links between distinct fingerprints that connect all those
    within `most` bits (a spanning part of the links at each anchor)."""
    if most > 3:
        raise ValueError("a half's threshold of 1 covers at most 3 differing bits")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = _Anchor(most)
        for batch in rows:
            if not batch.num_rows:
                continue
            key, salt, part, held, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            fps = fps.view(np.uint64)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (part[1:] != part[:-1])]))
            ends = np.append(new[1:], len(key))
            work = held[new] & (ends - new > 1)
            work[[0, -1]] = True  # these may go on in the batches before and after
            found = [x for a, b in zip(new[work], ends[work], strict=True) for x in anchor.group((key[a], salt[a], part[a]), held[a:b], fps[a:b])]
            made = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["src", "dst"])

    rows = anchored(nodes, hot).repartition("key", "salt", "part").sortWithinPartitions("key", "salt", "part", F.desc("held"))
    return rows.mapInArrow(run, "src long, dst long")


def _linked(df: DataFrame, id_col: str, text_col: str, width: int, most: int, hot: int) -> DataFrame:
    """id, fp, mark, component (one fingerprint of each) and component_id."""
    rows = cut(fingerprints(df, id_col, text_col, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    linked = connected_components(links(nodes.select("fp"), most, hot))
    grouped = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = cut(grouped.join(least, "component").select("fp", "component", "component_id"))
    return rows.join(of_fp, "fp")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = MOST, hot: int = HOT) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id
    (smallest id reachable by links) and mark (hash of the text)."""
    found = _linked(df, id_col, text_col, width, most, hot)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "mark")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = MOST) -> DataFrame:
    """Of each component exactly one row stays: the one with the smallest id (a
    null id being largest), of equal ids the one with the smallest text hash, of
    rows that repeat both any one."""
    return keep_one(df, _linked(df, id_col, text_col, width, most, HOT), id_col, text_col)


def keep_one(df: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that stay, given component, id and mark of every row."""
    found = grouped.groupBy("component", "id", "mark").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("i"), F.col("mark").alias("m"), "n")
    stays = cut(found.groupBy("component").agg(F.min(order).alias("least")).select("least.i", "least.m", "least.n").distinct())
    mark = unique_name(df, "mark")
    marked = df.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("i")) & (F.col(mark) == F.col("m"))
    repeated = stays.where("n > 1")
    if repeated.isEmpty():
        return marked.join(stays, same, "left_semi").drop(mark)
    once = marked.join(stays.where("n = 1"), same, "left_semi")
    # Each task first drops its own repeats, so no group travels whole.
    again = marked.join(repeated, same, "left_semi").dropDuplicates([id_col, mark])
    return once.unionByName(again).drop(mark)
