"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of SAMPLES
samples every term has a pair (r, c) of Gamma(2, 1) variables and a uniform b, made from
hashes of the term alone; a term of weight w scores c * exp(-r * (t - b + 1)) with
t = floor(ln(w) / r + b), and the least score is the sample. Two texts share a sample
with the probability of their generalised Jaccard similarity (the sum of the lesser
weights over the sum of the greater ones).

The variables are drawn in an order that keeps the usual weight cheap. r * (1 - b) and
r * b are two independent exponentials E and F (r = E + F), and for w = 1 the score is
x = c * exp(-E), itself exponential; given x, c - x is exponential and independent of x.
So U = exp(-x) is taken from a hash as it is, and c and r from a second hash where w > 1:
with V = exp(-(c - x)) and G = exp(-F), exp(-E) is ln U / (ln U + ln V), and the score is
x * exp(-r * t). The least score is the greatest exp(-score). As the score of another term,
or of another t, is another number, 16 bits of its hash stand for the sample.

DataFrame functions only. Null text counts as empty; a text without words has the empty
fingerprint, which is like itself (1) and like nothing else (0). Texts are handled whole,
each in one task. Every row has a fingerprint of its own, also where doc_id is null or
repeats: rows are ordered by doc_id descending, nulls last, equal ones by their key. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.llm import common as C

#: Samples of a fingerprint and hex digits of each.
SAMPLES, DIGITS = 64, 4

_STEP = 0x9E3779B97F4A7C15


def _hash(term: Column, k: int) -> Column:
    return F.xxhash64(term.bitwiseXOR(F.lit((_STEP * (k + 1)) % (1 << 63))))


def _uniform(bits: Column, shift: int, n: int) -> Column:
    """Within (0, 1) from the n bits that lie above `shift`."""
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << n) - 1)).cast("double") * F.lit(2.0**-n) + F.lit(2.0 ** -(n + 1))


def sample(term: Column, weight: Column, k: int) -> Column:
    """exp(-score) of a term (a 64-bit hash) of this weight (at least 1) in sample k."""
    u, more = _uniform(_hash(term, 2 * k), 12, 52), _hash(term, 2 * k + 1)
    v, g = _uniform(more, 0, 32), _uniform(more, 32, 32)
    wide = F.lit(1.0) + F.log(v) / F.log(u)  # exp(E)
    steps = F.floor(F.log(weight / g) / F.log(wide / g)).cast("double")
    return (
        F.when(weight == 1, u)
        .when((weight - 1) * F.log(u) > F.log(v), u)  # t = 0
        .when(F.sqrt(weight * g) < wide, F.exp(F.log(u) * g / wide))  # t = 1
        .otherwise(F.exp(F.log(u) * F.pow(g / wide, steps)))
    )


def weighted(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, term (hash of a word), weight (times it occurs) of texts (keys, text)."""
    words = texts.select(*keys, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def sampled(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, fingerprint of those texts (keys, text; the keys are unique) that have words."""
    best = weighted(texts, *keys).groupBy(*keys).agg(*[F.max(sample(F.col("term"), F.col("weight"), k)).alias(f"s{k}") for k in range(SAMPLES)])
    digits = [F.lpad(F.hex(F.xxhash64(f"s{k}").bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0") for k in range(SAMPLES)]
    return best.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, from 0 to 1."""
    part = lambda x, k: F.substring(x, DIGITS * k + 1, DIGITS)
    same = sum((F.when(part(a, k) == part(b, k), 1).otherwise(0) for k in range(SAMPLES)), F.lit(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def _texts(keyed: C.Rows) -> DataFrame:
    return keyed.only("text").select(C.ROW, F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    keyed = C.Rows(C.only(docs, "doc_id", "text"))
    # by row before words are counted: texts are shuffled once, counted words aren't
    found = sampled(_texts(keyed).repartition(C.ROW), C.ROW)
    return keyed.only("doc_id").join(found, C.ROW, "left").select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def following(rows: DataFrame) -> DataFrame:
    """rows (the row's key, doc_id, n) with next, the key of the row after it, and prev and prev_n of the one before; the first follows the last.

    Ranges are ordered on their own; the one row at each end of a range is joined to its neighbour.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col(C.ROW).asc()]
    rows = C.written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    w = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumns({"next": F.lead(C.ROW).over(w), "prev": F.lag(C.ROW).over(w), "prev_n": F.lag("n").over(w)})
    ends = rows.groupBy("part").agg(F.min(F.when(F.col("prev").isNull(), F.struct(C.ROW))).alias("first"), F.min(F.when(F.col("next").isNull(), F.struct(C.ROW, "n"))).alias("last"))
    parts = Window.orderBy("part")  # a row for each range
    after = F.coalesce(F.lead("first").over(parts), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("last").over(parts), F.last("last").over(parts.rowsBetween(0, Window.unboundedFollowing)))
    ends = ends.select("part", after.alias("after"), before.alias("before"))
    rows = rows.join(F.broadcast(ends), "part")
    pick = {"next": F.coalesce("next", f"after.{C.ROW}"), "prev": F.coalesce("prev", f"before.{C.ROW}"), "prev_n": F.coalesce("prev_n", "before.n")}
    return rows.withColumns(pick).drop("part", "after", "before")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: every text against an edited one and the next.

    The next is that by doc_id descending, after the last the first; edited, a text has the beginning of the next in place of its last half.
    """
    keyed = C.Rows(C.only(docs, "doc_id", "text"))
    texts = _texts(keyed)
    sizes = keyed.only("doc_id", "text").select(C.ROW, "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    links = C.written(following(sizes), "links")
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    given = texts.join(links.select(C.ROW, "prev", "prev_n"), C.ROW).select(F.col("prev").alias(C.ROW), F.substring("text", F.lit(1), half("prev_n")).alias("piece"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "piece")
    both = texts.join(given, C.ROW).select(C.ROW, "text", edited.alias("edited"))
    versions = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("x")
    found = sampled(both.select(C.ROW, versions).select(C.ROW, "x.version", "x.text"), C.ROW, "version")
    found = found.groupBy(C.ROW).agg(*[F.max(F.when(F.col("version") == v, F.col("fingerprint"))).alias(c) for v, c in enumerate(("fingerprint", "edited_fingerprint"))])
    # one plan, so that texts are shuffled once for the digests and the words
    out = both.select(C.ROW, F.sha2("edited", 256).alias("edited_sha256")).join(found, C.ROW, "left").fillna("", ["fingerprint", "edited_fingerprint"])
    out = C.written(out.join(links.select(C.ROW, "doc_id", F.col("n").alias("n_chars"), "next"), C.ROW), "fingerprints")
    out = out.join(out.select(F.col(C.ROW).alias("next"), F.col("fingerprint").alias("next_fingerprint")), "next")
    near = {c: likeness(F.col("fingerprint"), F.col(x)).alias(c) for c, x in (("near_edited", "edited_fingerprint"), ("near_next", "next_fingerprint"))}
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near.values())


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(C.read(spark, sf_dir, "documents"))
