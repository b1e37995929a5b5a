"""Model outputs to text: softmax, greedy CTC and runner-up digits, on numpy arrays in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The alphabet of a CTC head; index 0 is the blank.
ALPHABET = "0123456789"


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ctc(logits: np.ndarray) -> tuple[str, float]:
    """Text and mean confidence of the kept steps (0 if none): best class of each step, repeats collapsed, blanks dropped."""
    p = softmax(logits)
    best, conf = p.argmax(axis=1), p.max(axis=1)
    keep = (best != 0) & np.r_[True, best[1:] != best[:-1]]
    return "".join(ALPHABET[i - 1] for i in best[keep]), float(conf[keep].mean()) if keep.any() else 0.0


def digit_details(logits: np.ndarray, end: int) -> list[dict]:
    """For each step before the end class: the digit, its probability, and the runner-up digit and its probability."""
    out = []
    for p in softmax(logits):
        if int(p.argmax()) == end:
            break
        digits = p[: len(ALPHABET)]
        first, second = np.argsort(-digits, kind="stable")[:2]
        out.append({"digit": ALPHABET[first], "prob": float(digits[first]), "ru_digit": ALPHABET[second], "ru_prob": float(digits[second])})
    return out


def ctc_decoded(rows: DataFrame, key: str, steps: str) -> DataFrame:
    """key, text, confidence of every row of logits (array of steps, each an array of classes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ctc(np.stack([np.asarray(s, dtype=float) for s in x])) if x is not None and len(x) else ("", 0.0) for x in b[steps]]
            yield pd.DataFrame({key: b[key], "text": [t for t, _ in found], "confidence": [c for _, c in found]})

    return rows.select(key, steps).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string, confidence double")


def digit_product(probs: Column) -> Column:
    """Product of digit probabilities; .5 if there are none."""
    return F.when(F.size(probs) > 0, F.aggregate(probs, F.lit(1.0), lambda a, p: a * p)).otherwise(F.lit(0.5))


def ctc_labels(text: Column) -> Column:
    """Digits as CTC classes ('0' is 1)."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int") + 1)
