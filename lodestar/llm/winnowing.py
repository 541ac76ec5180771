"""Document fingerprints by winnowing, in DataFrame functions only.

A word of over LONG characters, as texts without blanks are made of, counts as
that many words of one character, so runs of characters are compared there.
Words are hashed, runs of `k` words get a rolling (cyclic polynomial) hash, and
of every `w` consecutive hashes the smallest is chosen, the rightmost of equal
ones. A choice is kept once, with its position, so any run of w + k - 1 words
that two texts share gives them a common entry: three words at k = w = 2. Hash and
position share one long (hash in the high bits, falling position in the low
ones): the smallest long is the rightmost smallest hash, and a window of 8
takes three passes.

The next document is found without one global order: quantiles of the ids cut
the table into `buckets` ranges, texts are dealt once by bucket and sorted
there, and the first document of each range also goes to the range before it.
Only as many rows as there are buckets travel twice, and only they are
broadcast (at most MAX_BUCKETS).

Defined cases: a null text counts as empty and has an empty fingerprint; fewer
than k words give one hash of them all; a null id comes last in descending
order; rows that repeat an id follow each other by falling text hash; a single
document is its own next. Two empty fingerprints have likeness 1, an empty and
another one 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import unique_name

K, W = 2, 2
#: Characters of a word from which on each of them is a word.
LONG = 12
MAX_BUCKETS = 1 << 16
LOW = (1 << 31) - 1


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _upto(a: Column, less: int) -> Column:
    """The first size - less elements, at least one if there is any."""
    return F.slice(a, 1, F.greatest(F.size(a) - less, F.least(F.size(a), F.lit(1))))


def _least_with(a: Column, far: int):
    return lambda x, i: F.least(x, F.get(a, i + far))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add `out`: array<long> of chosen entries in order of position."""
    if w & (w - 1):
        raise ValueError("the window is a power of two")
    step = unique_name(df, "_step")
    df = df.withColumn(step, F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    is_long = lambda x: F.char_length(x) > LONG
    parted = F.flatten(F.transform(F.col(step), lambda x: F.when(is_long(x), F.split(x, "")).otherwise(F.array(x))))
    df = df.withColumn(step, F.when(F.exists(F.col(step), is_long), parted).otherwise(F.col(step)))
    df = df.withColumn(step, F.transform(F.col(step), lambda x: F.xxhash64(x)))

    def gram(x: Column, i: Column) -> Column:
        rolled = _rotated(x, k - 1)
        for j in range(1, k):
            rolled = rolled.bitwiseXOR(_rotated(F.coalesce(F.get(F.col(step), i + j), F.lit(0).cast("long")), k - 1 - j))
        return F.shiftleft(F.shiftrightunsigned(rolled, 32), 31).bitwiseOR(F.lit(LOW).cast("long") - i)

    df = df.withColumn(step, F.transform(_upto(F.col(step), k - 1), gram))
    for far in (1 << b for b in range(w.bit_length() - 1)):
        df = df.withColumn(step, F.transform(F.col(step), _least_with(F.col(step), far)))
    df = df.withColumn(step, _upto(F.col(step), w - 1))
    return df.withColumn(out, F.filter(F.col(step), lambda x, i: (i == 0) | (x != F.get(F.col(step), i - 1)))).drop(step)


def entries(fp: Column) -> Column:
    """The fingerprint as text: hash:position, joined by commas."""
    return F.concat_ws(",", F.transform(fp, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 31))), F.lit(":"), (F.lit(LOW).cast("long") - x.bitwiseAND(F.lit(LOW).cast("long"))).cast("string"))))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftrightunsigned(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _bucket(ids: Column, cuts: list[int]) -> Column:
    """How many of the rising cuts are at most the id; -1 for a null id."""
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    outer = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= ids))
    inner = F.size(F.filter(F.get(F.array(*map(longs, blocks)), outer - 1), lambda x: x <= ids)) if blocks else F.lit(0)
    return F.when(ids.isNull(), -1).when(outer == 0, 0).otherwise((outer - 1) * step + inner).cast("int")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> tuple[DataFrame, Window]:
    """id, text, bucket, ghost and next_text, and the window in which the next
    row follows. Ghost rows only serve the row before them."""
    spark = df.sparkSession
    buckets = min(MAX_BUCKETS, buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 8 * buckets).alias("cuts")).first()["cuts"] if buckets > 1 else []
    bucket = _bucket(F.col("id"), sorted(set(cuts or [])))
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("head")).collect()  # one row for each bucket
    heads.sort(key=lambda r: -r["bucket"])
    serves: dict[int | None, list[int]] = {}
    for before, r in zip(heads[-1:] + heads[:-1], heads, strict=True):
        serves.setdefault(r["head"], []).append(before["bucket"])
    served = spark.createDataFrame(list(serves.items()), "head long, serves array<int>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(served), F.col("id").eqNullSafe(F.col("head")), "left")
    place = lambda b, ghost: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"))
    places = F.concat(F.array(place(bucket, False)), F.coalesce(F.transform("serves", lambda b: place(b, True)), F.array().cast("array<struct<bucket:int,ghost:boolean>>")))
    rows = rows.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.bucket", "at.ghost")
    window = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("id"), F.desc("mark"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(window)), window


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W, buckets: int | None = None) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text is the text
    with its last floor(n_chars / 2) characters replaced by the first as many
    of the next document in descending order of id, the first after the last."""
    rows, window = with_next(df, id_col, text_col, buckets)
    rows = with_fingerprint(rows, "text", "fp", k, w)
    rows = rows.withColumn("next_set", F.lead(hashes(F.col("fp"))).over(window)).where(~F.col("ghost"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fp", k, w)
    rows = rows.withColumn("own_set", hashes(F.col("fp")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        entries(F.col("fp")).alias("fingerprint"),
        entries(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), hashes(F.col("edited_fp"))).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
