"""Personal data: pattern spans and information-theoretic sanitisation.

Base spans are found by patterns (email, ip, card, phone). Every distinct base value is
a protected entity. Over the whole corpus, the words (outside e-mail addresses) of the
documents that mention an entity are counted against all documents that have those
words: a word discloses an entity when its pointwise mutual information with the entity
reaches DISCLOSED of the entity's own information, that is when seeing the word nearly
tells the entity. Such words count only with SUPPORT different texts behind them. Their
occurrences become spans of kind `term`, in every document, unless they lie in a base
span.

In the sanitised text base spans and words at full disclosure are removed (their kind in
brackets stays); other disclosing words are generalised to what kind of word they are
(a name, if it begins with a capital, or a word).

How it stays small: equal texts are one text with a count. Words are first counted in
the texts that mention an entity of SUPPORT texts; a pair can only reach the limit if
its documents are a certain part of all those that have the word, of which the ones
counted so far are some. Only words with such a pair are counted over the corpus, and only
words that disclose are looked up in all texts.

DataFrame functions only. Positions are code points from 0, ends exclusive. Null text
counts as empty. Very long texts and texts with thousands of matches are handled whole.
Every row is a document, also where doc_id is null or repeats; what is found depends on
the text alone. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow.llm import common as C

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, written so that a failed start is not tried again inside the same run of characters, and without nested backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The least letters of a word.
LETTERS = 3
#: Share of an entity's information from which a word discloses it; different texts that must show it.
DISCLOSED, SUPPORT = 0.9, 2

_WORD = rf"\p{{L}}{{{LETTERS},}}"
_SPAN = "array<struct<start:int,end:int,body:string>>"


#: Matches whose places are summed one after the other; of more, parts of so many are summed, then the parts.
PART = 64


def _from(pairs: Column, start: Column) -> Column:
    """The spans of (gap, long, body) in order, the first gap beginning at start."""

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["long"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + x["long"]).alias("end"), x["body"].alias("body")))).alias("out"))

    return F.aggregate(pairs, F.struct(start.cast("int").alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _all(pairs: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int")), lambda i: F.slice(pairs, i * PART + 1, PART))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["long"]))
        ends = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), _from))

    return F.when(F.size(pairs) <= PART, _from(pairs, F.lit(0))).otherwise(_let(parts, joined))


def spans(text: Column, pattern: Column) -> Column:
    """start, end and body of every match of pattern in text."""

    def placed(bodies: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, F.lit(-1)), F.lit(1), F.size(bodies))
        pairs = F.zip_with(pieces, bodies, lambda p, b: F.struct(F.length(p).alias("gap"), F.length(b).alias("long"), b.alias("body")))
        return F.when(F.size(bodies) == 0, F.array().cast(_SPAN)).otherwise(_let(pairs, _all))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.split(F.reverse(digits), "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.filter(each, lambda x: x != ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda b: F.lit(True),
    "ip": lambda b: F.forall(F.split(b, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")),
    "card": lambda b: luhn(_digits(b)),
    "phone": lambda b: F.length(_digits(b)).between(10, 15),
}


def _passes(kind: str):
    return lambda s: _VALID[kind](s["body"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _placed(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), key (128 bits of the text) of every row."""
    rows = C.only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("key", F.unhex(F.md5(F.col("text"))))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text, key (digest of the text), and the valid spans of each kind of every row."""
    rows = keyed(docs)
    for kind, pattern in PATTERNS.items():
        may = F.contains("text", F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else F.lit(True)
        found = F.filter(spans(F.col("text"), F.lit(pattern)), _passes(kind))
        rows = rows.withColumn(kind, F.when(may, found).otherwise(F.array().cast(_SPAN)))
    return rows


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _mentions() -> Column:
    """The entities of a row's base spans."""
    named = lambda kind: lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["body"]))
    return F.array_distinct(F.concat(*[F.transform(F.col(kind), named(kind)) for kind in PATTERNS]))


def disclosing(found: DataFrame, texts: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """term, share (PMI over the entity's information) of the disclosing words.

    found: key and mentions of every document; texts: key and text of every document.
    """
    total = float(max(found.count(), 1))
    bearers = found.where(F.size("mentions") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("mentions").alias("mentions"))
    mentions = C.written(bearers.select("key", "n", F.explode("mentions").alias("entity")), "mentions")
    of_entity = mentions.groupBy(F.col("entity").alias("e")).agg(F.sum("n").alias("entity_docs"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= support) & (F.col("entity_docs") < total))
    held = mentions.join(C.small(C.written(of_entity, "entities"), 96), F.col("entity") == F.col("e"))
    held = C.written(held.groupBy("key", "n").agg(F.collect_list(F.struct("entity", "entity_docs")).alias("entities")), "held")

    outside = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", F.lit(PATTERNS["email"]), F.lit(" "))).otherwise(F.col("text"))
    side = C.small(held.select(F.col("key").alias("k"), "n", "entities"), 192)
    own = texts.join(side, F.col("key") == F.col("k")).dropDuplicates(["key"]).select("n", "entities", F.array_distinct(_terms(outside)).alias("terms"))
    own = C.written(own, "own")
    words = own.select("n", F.explode("terms").alias("term"))
    seen = words.groupBy(F.col("term").alias("t")).agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    joint = own.select("n", "terms", F.inline("entities")).select("n", "entity", "entity_docs", F.explode("terms").alias("term"))
    joint = joint.groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count(F.lit(1)).alias("texts"), F.first("entity_docs").alias("entity_docs")).where(F.col("texts") >= support)

    def share(term_docs: str) -> Column:
        return F.log2(F.lit(total) * F.col("joint") / (F.col("entity_docs") * F.col(term_docs))) / F.log2(F.lit(total) / F.col("entity_docs"))

    pairs = joint.join(seen.select("t", "seen"), F.col("term") == F.col("t")).where(share("seen") >= disclosed)
    pairs = C.written(pairs.groupBy("term", "joint", "entity_docs").agg(F.lit(1)).select("term", "joint", "entity_docs"), "pairs")
    may = C.small(C.written(pairs.select(F.col("term").alias("t")).distinct(), "may"), 64)
    everywhere = texts.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    counts = everywhere.join(may, F.col("term") == F.col("t"), "left_semi").groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("term_docs"))
    sure = pairs.join(counts, F.col("term") == F.col("t")).select("term", share("term_docs").alias("share")).where(F.col("share") >= disclosed)
    return C.written(sure.groupBy("term").agg(F.max("share").alias("share")), "terms")


def found_spans(docs: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """doc_id, key, base and all (arrays of start, order, kind, end, sorted) of every row; order is the kind's place in KINDS, and 5 for a generalised term."""
    docs = C.only(docs, "doc_id", "text")
    rows = base(docs)
    each = [F.transform(F.col(k), _placed(i, k)) for i, k in enumerate(KINDS[:-1])]
    found = C.written(rows.select("doc_id", "key", F.array_sort(F.concat(*each)).alias("base"), _mentions().alias("mentions")), "base")
    texts = keyed(docs).select("key", "text")
    terms = disclosing(found.select("key", "mentions"), texts, disclosed, support)
    side = C.small(terms.select(F.col("term").alias("t"), "share"), 64)
    places = texts.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(side, F.col("term") == F.col("t"))
    by_text = places.groupBy(F.col("key").alias("k")).agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("share") < 1.0, F.col("term"))).alias("mild"), F.count(F.lit(1)).alias("rows"))
    by_text = C.written(by_text, "terms")
    one = texts.join(C.small(by_text, 512), F.col("key") == F.col("k")).dropDuplicates(["key"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array("terms"), "|"), F.lit(r")(?!\p{L})"))
    level = lambda s: F.when(F.array_contains(F.col("mild"), F.lower(s["body"])), 5).otherwise(4)
    placed = lambda s: F.struct(s["start"].alias("start"), level(s).alias("order"), F.lit("term").alias("kind"), s["end"].alias("end"))
    hits = C.written(one.select("key", "rows", F.transform(spans(F.col("text"), pattern), placed).alias("hits")), "hits")
    with_hits = C.with_groups(found, hits, ["key"], "rows", found.count())
    free = F.filter("hits", lambda h: ~F.exists("base", lambda s: (s["start"] < h["end"]) & (h["start"] < s["end"])))
    out = with_hits.select("doc_id", "key", "base", F.array_sort(F.concat("base", free)).alias("all"))
    return out.unionByName(found.join(hits.select("key"), "key", "left_anti").select("doc_id", "key", "base", F.col("base").alias("all")))


def _listed(name: str) -> Column:
    return F.array_join(F.transform(F.col(name), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text of every row with its spans replaced; of overlapping spans the first by place, then kind, counts."""
    found = found_spans(docs, **options).select(F.col("key").alias("k"), "all").where(F.size("all") > 0).groupBy("k").agg(F.first("all").alias("all"))
    rows = C.only(docs, "doc_id", "text").withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = rows.join(found, F.col("key") == F.col("k"), "left")

    def step(acc: Column, s: Column) -> Column:
        body = F.substring(F.col("text"), s["start"] + 1, F.lit(1))
        mark = F.when(s["order"] < 5, F.concat(F.lit("["), s["kind"], F.lit("]"))).when(body == F.lower(body), "[word]").otherwise("[name]")
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), mark)).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(new)

    end = F.aggregate(F.coalesce("all", F.array()), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    whole = F.concat(F.array_join(end["out"], ""), F.substring(F.col("text"), end["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.when(F.size("all") > 0, whole).otherwise(F.col("text")).alias("text"))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_spans(C.read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:-1]]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))
