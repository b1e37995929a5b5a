"""Rules on read text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that readers confuse with digits, each with its digit below.
LETTERS = "OoQDIilL|ZzESsGbTBgq"
DIGITS_OF = "00001111122355667899"

HIGH, MEDIUM, LOW = 0.85, 0.70, 0.50


def digits_only(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, LETTERS, DIGITS_OF), "[^0-9]", "")


def clean(text: Column, max_digits: int = 5, max_value: int | None = None) -> Column:
    """Struct (text, modified): confused letters become digits, the rest goes, leading zeros go (one stays), the length is cut; above max_value nothing stays."""
    source = F.coalesce(text, F.lit(""))
    out = F.substring(F.regexp_replace(digits_only(source), "^0+(?=.)", ""), 1, max_digits)
    if max_value is not None:
        out = F.when(out.try_cast("long") > max_value, "").otherwise(out)
    return F.struct(out.alias("text"), (out != source).alias("modified"))


def digit_penalty(text: Column, conf: Column, lengths: Column | None = None) -> Column:
    """conf less .15 (0 at least) if the number of digits is unexpected (1 to 4 by default)."""
    lengths = F.array(*map(F.lit, (1, 2, 3, 4))) if lengths is None else lengths
    return F.when(F.array_contains(lengths, F.length(text)), conf).otherwise(F.greatest(F.lit(0.0), conf - 0.15))


def repdigit(text: Column) -> Column:
    """Three or more of the same character."""
    return (F.length(text) >= 3) & (F.length(F.replace(text, F.substring(text, 1, 1), F.lit(""))) == 0)


def short_ok(text: Column, conf: Column) -> Column:
    """Whether an unregistered number is sure enough for its length."""
    return F.when(F.length(text) == 1, conf >= 0.95).when(F.length(text) == 2, conf >= 0.90).otherwise(True)


def suspicious(text: Column, conf: Column, lengths: Column, strict: bool = False) -> Column:
    """Struct (suspicious, reason, adjusted, reject): the first of five rules that holds."""
    unexpected = ~F.array_contains(lengths, F.length(text)) & (conf < 0.95)

    def verdict(reason: str | None, adjusted: Column, reject: Column | bool) -> Column:
        reject = F.lit(reject) if isinstance(reject, bool) else reject
        return F.struct(F.lit(reason is not None).alias("suspicious"), F.lit(reason).cast("string").alias("reason"), adjusted.cast("double").alias("adjusted"), reject.alias("reject"))

    return (
        F.when(F.coalesce(text, F.lit("")) == "", verdict("empty", F.lit(0.0), True))
        .when(conf < 0.35, verdict("very_low_confidence", conf, True))
        .when((F.length(text) <= 2) & (conf < 0.85), verdict("short_low_confidence", conf * 0.7, strict))
        .when(unexpected, verdict("unexpected_length", conf * 0.8, F.lit(strict) | (conf < 0.7)))
        .when(conf < 0.7, verdict("low_confidence", conf, False))
        .otherwise(verdict(None, conf, False))
    )


def level(conf: Column) -> Column:
    return F.when(conf >= HIGH, "high").when(conf >= MEDIUM, "medium").when(conf >= LOW, "low").otherwise("reject")


def adjusted(conf: Column, boost: Column, valid: Column, stable: Column, agreement: Column, auto_accept: bool = True) -> Column:
    """Confidence after registry and voting, in 0..1."""
    out = conf + boost + (F.when(valid, 0.15).otherwise(0.0) if auto_accept else F.lit(0.0))
    out = out + F.when(stable, 0.10).when(agreement >= 0.8, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def review_reason(lvl: Column, valid: Column, corrected: Column, original: Column, validated: Column, stable: Column) -> Column:
    """Why a reading is to be reviewed."""
    parts = F.concat_ws(
        "; ",
        F.when(lvl == "reject", "Very low confidence").when(lvl == "low", "Low confidence"),
        F.when(~valid, "Not in bib set"),
        F.when(corrected, F.concat(F.lit("Auto-corrected "), original, F.lit("->"), validated)),
        F.when(~stable, "Unstable across frames"),
    )
    return F.when(parts == "", "Needs verification").otherwise(parts)


def longest_run(text: Column) -> Column:
    """The longest run of one to four digits, the first of equals, or null."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![0-9])[0-9]{1,4}(?![0-9])"), F.lit(0))
    return F.aggregate(runs, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))


def clock(seconds: Column, hundredths: bool = False) -> Column:
    """Seconds of a day as HH:MM:SS, with .hh if wanted."""
    whole = F.floor(seconds).cast("long")
    base = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60)
    return F.concat(base, F.format_string(".%02d", F.floor((seconds - whole) * 100 + 1e-6).cast("long"))) if hundredths else base


def line_of(text: Column) -> Column:
    """`x1,y1,x2,y2` as a struct of numbers, or null unless there are four."""
    parts = F.split(text, ",")
    at = [F.get(parts, F.lit(k)).try_cast("double") for k in range(4)]
    whole = F.size(parts) == 4
    for x in at:
        whole = whole & x.isNotNull()
    return F.when(whole, F.struct(*[x.alias(n) for x, n in zip(at, ("x1", "y1", "x2", "y2"))]))


def range_of(text: Column) -> Column:
    """`a-b` as a struct of two whole numbers, or null."""
    cut = F.instr(text, "-")
    a, b = F.substring(text, F.lit(1), cut - 1).try_cast("long"), F.substring(text, cut + 1, F.length(text)).try_cast("long")
    return F.when((cut > 0) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("last")))
