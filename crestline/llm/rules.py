"""Quality rules whose cutoffs carry a guarantee on false rejections.

A rule rejects a text when a signal exceeds a cutoff. On labelled texts the
number of good ones that a cutoff rejects is binomial; the exact lower-tail
probability of that count under the tolerated rate is a p-value for "this
cutoff rejects too many good texts". Cutoffs of a rule are tested from the
mildest to the strictest until one cannot be certified (fixed-sequence
testing), and the error level is divided over all strata and rules
(Bonferroni). With probability 1 - ``delta``, no stratum loses more than
``tolerance`` of its good texts to the rules together.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm.base import map_texts, small, text_slices
from crestline.llm.words import SPACES, Words
from crestline.session import materialize

# Signal: (numerator, denominator, scale); its value is floor(scale * numerator / denominator), 0 without a denominator.
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "upper": ("n_upper", "word_chars", 1000),
    "marks": ("n_marks", "word_chars", 1000),
    "word_length": ("word_chars", "n_words", 10),
}
# Cutoffs per signal from the mildest to the strictest.
CUTOFFS = {
    "symbols": (500, 300, 200, 150, 100, 70, 50, 30, 20, 10),
    "dup_lines": (900, 800, 700, 600, 500, 400, 300, 250, 200, 150),
    "repeats": (800, 600, 500, 400, 300, 250, 200, 150, 100, 50),
    "upper": (900, 800, 700, 600, 500, 400, 300, 250, 200, 150),
    "marks": (600, 500, 400, 300, 250, 200, 150, 120, 100, 80),
    "word_length": (400, 300, 250, 200, 180, 160, 140, 120, 110, 100),
}
TOLERANCE = 0.05
DELTA = 0.05
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:\"'()[]{}=+/\\~^_`@")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _repeat_words(text: bytes, hashes: np.ndarray) -> int:
    """Words inside windows that occur at least twice; equal hashes are confirmed on the words."""
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(count[back] > 1)
    if not len(maybe):
        return 0
    words, by = text.split(), defaultdict(list)
    for i in maybe.tolist():
        by[tuple(words[i : i + WINDOW])].append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in by.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.add(at, WINDOW), -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(docs: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """Counts of every whole text, beside the columns in ``keep``; null and empty texts count zero."""

    def fn(batch):
        for a, e, texts in text_slices(batch):
            w = Words(texts, SPACES)
            lead = (w.bytes & 0xC0) != 0x80

            def total(mask):
                c = np.concatenate([[0], np.cumsum(mask)])
                return c[w.text_end] - c[w.text_start]

            window, whole = w.windows(WINDOW)
            lines, dup, rep = [], [], []
            for t, first, n in zip(texts, w.first.tolist(), w.count.tolist()):
                full = [x for x in t.split(b"\n") if x.strip()]
                lines.append(len(full))
                dup.append(len(full) - len(set(full)))
                rep.append(_repeat_words(t, window[first : first + n - WINDOW + 1]) if n > WINDOW else 0)
            cols = [w.count, total(w.inside & lead), total(_SYMBOL[w.bytes]), lines, dup, rep, total(_UPPER[w.bytes]), total(_MARK[w.bytes])]
            held = [batch.column(k).slice(a, e - a) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(np.asarray(c, np.int64)) for c in cols)], [*batch.schema.names[:-1], *COUNTS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("text"))
    out = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return map_texts(rows, fn, out).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def signal(name: str):
    top, under, scale = SIGNALS[name]
    return F.when(F.col(under) > 0, F.floor(F.col(top) * scale / F.col(under))).otherwise(F.lit(0)).cast("long")


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) of a binomial, exact up to rounding: the regularised incomplete beta I(1-p; n-x, x+1)."""
    if x >= n:
        return 1.0
    a, b, z = n - x, x + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log(p))
    flip = z > (a + 1) / (a + b + 2)
    if flip:
        a, b, z = b, a, p
    # I = front / (a * K) with the continued fraction K = 1 + d1 / (1 + d2 / (1 + ...)).
    c, d, k = 1.0, 0.0, 1.0
    for m in range(1, 1_000_000):
        j = m // 2
        if m % 2:
            t = -(a + j) * (a + b + j) * z / ((a + 2 * j) * (a + 2 * j + 1))
        else:
            t = j * (b - j) * z / ((a + 2 * j - 1) * (a + 2 * j))
        d = 1.0 / (1.0 + t * d)
        c = 1.0 + t / c
        k *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    part = front / (a * k)
    return min(1.0, max(0.0, 1 - part if flip else part))


def certified(good: int, rejected: list[int], level: float, rate: float) -> int:
    """Number of leading cutoffs whose false-rejection rate is certified below ``rate``."""
    k = 0
    while k < len(rejected) and good and binomial_tail(rejected[k], good, rate) <= level:
        k += 1
    return k


def learn_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, tolerance: float = TOLERANCE, delta: float = DELTA) -> DataFrame:
    """(stratum, cut_<signal>...): certified cutoff per stratum and signal, null where none is.

    ``labels`` has (doc_id, quality); a text is good if all its non-null labels
    are 1. Texts rejected by the base rules take no part. A stratum without
    good labelled texts gets no cutoff. The null stratum is one of its own.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).where(F.col("_q") >= 1)
    over = [F.sum((signal(s) > c).cast("long")).alias(f"{s}_{k}") for s in SIGNALS for k, c in enumerate(CUTOFFS[s])]
    per = materialize(
        counts.where(~F.col("base_failed")).join(good, "doc_id").groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_good"), *over), "holdout"
    )
    level, rate = delta / max(1, per.count() * len(SIGNALS)), tolerance / len(SIGNALS)

    def fn(batch):
        rows = batch.to_pylist()
        out = {"_stratum": batch.column(0)}
        for s in SIGNALS:
            best = [certified(r["_good"], [r[f"{s}_{k}"] for k in range(len(CUTOFFS[s]))], level, rate) for r in rows]
            out[f"cut_{s}"] = pa.array([CUTOFFS[s][k - 1] if k else None for k in best], pa.int64())
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = per.schema["_stratum"].dataType.simpleString()
    return map_texts(per, fn, f"_stratum {kind}, " + ", ".join(f"cut_{s} long" for s in SIGNALS))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", tolerance: float = TOLERANCE, delta: float = DELTA, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, stratum, counts, base_failed, failed_rules, kept) of every row of ``docs``.

    A null or empty text has no words and fails the base rules. Without labels
    only the base rules reject. Repeated rows are judged each by itself; a null
    doc_id is judged but never labelled. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("_stratum"), F.col(text).alias("text"))
    counts = materialize(base_counts(rows, "doc_id", "text", "_stratum"), "counts")
    cuts = materialize(learn_cutoffs(counts, labels.select("doc_id", "quality"), "_stratum", tolerance, delta), "cutoffs")
    return _judged(counts, cuts).select("doc_id", F.col("_stratum").alias("stratum"), *COUNTS, "base_failed", "failed_rules", "kept")


def _judged(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counts`` with the rules each row fails and whether it is kept."""
    cuts = small(cuts).withColumnRenamed("_stratum", "_s")
    both = counts.join(cuts, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    failed = F.filter(F.array(*[F.when(signal(s) > F.col(f"cut_{s}"), F.lit(s)) for s in SIGNALS]), lambda x: x.isNotNull())
    return both.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", **risk) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, with all their columns; no row is joined or shuffled."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("_stratum"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    counts = materialize(base_counts(rows, "doc_id", "text", "_stratum"), "counts")
    cuts = materialize(learn_cutoffs(counts, labels.select("doc_id", "quality"), "_stratum", **risk), "cutoffs")
    return _judged(base_counts(rows, "doc_id", "text", "_stratum", "_row"), cuts).where("kept").select("_row.*")
