"""Secret scan with a random forest that removes false positives.

Everything on the scan's path is a DataFrame function: a regular expression
cuts a text into long tokens and what stands between them, features of every
token are column expressions, and the trained forest is turned into nested
conditions. Every finding is labelled; training uses Spark ML on a bounded
sample of each kind of them.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.session import materialize

# A candidate is a token of these characters, so long, with a digit in it.
TOKEN = r"[A-Za-z0-9+/_\-]{16,}"
# Characters kept on either side of a candidate.
BEFORE, AFTER = 48, 24
# Labelled findings learned from, of each kind; kinds with fewer than LEAST_FINDINGS are repeated up to it, so that bagging and leaves see them.
MAX_FINDINGS = 20_000
LEAST_FINDINGS = 50
# Hash ranges that findings are counted by to find the smallest hashes of a kind.
HASH_BINS = 4_096
# Dictionary words and letter pairs.
MAX_WORDS = 400
MAX_PAIRS = 300
TREES, DEPTH = 15, 5
MASK = "[SECRET]"

# Published prefixes of credentials, and words that announce one.
KINDS = (r"^(AKIA|ASIA)[A-Z0-9]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}", r"^xox[abprs]-", r"^sk_live_", r"^AIza[A-Za-z0-9_\-]{35}$")
FORMATS = "|".join(KINDS)
WORDS = r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|auth|bearer|credential)"
ASSIGNED = WORDS + r"[\"']?\s*[=:]\s*[\"']?$"

FEATURES = ("length", "digits", "upper", "symbols", "hex", "transitions", "familiar", "dictionary", "slashes", "path", "assigned", "word_near", "quoted", "word_after")


def tokens(text: Column) -> Column:
    """array<struct<value, before, after>> of all long tokens, candidates or not, in order."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    zipped = F.arrays_zip(found.alias("v"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("h"))
    each = F.transform(zipped, lambda z: F.struct(z["v"].alias("value"), F.right(z["g"], F.lit(BEFORE)).alias("before"), F.left(F.coalesce(z["h"], F.lit("")), F.lit(AFTER)).alias("after")))
    return F.filter(each, lambda c: c["value"].isNotNull())


def _share(value: Column, pattern: str) -> Column:
    """Share of characters that ``pattern`` matches."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def features(c: Column, dictionary: list[str], pairs: list[str]) -> dict[str, Column]:
    """Numbers that describe a token, its characters, its path and its neighbours."""
    v, before, after = c["value"], c["before"], c["after"]
    low = F.lower(v)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    letters = F.regexp_extract_all(low, F.lit("(?=([a-z][a-z]))"), F.lit(1))
    common = F.array(*[F.lit(p) for p in pairs]) if pairs else F.array().cast("array<string>")
    known = F.size(F.filter(letters, lambda p: F.array_contains(common, p)))
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    out = {
        "length": F.length(v),
        "digits": _share(v, "[0-9]"),
        "upper": _share(v, "[A-Z]"),
        "symbols": _share(v, r"[+/_\-]"),
        "hex": v.rlike("^[0-9a-f]+$"),
        "transitions": (F.length(classes) - 1) / F.length(v),
        "familiar": known / F.greatest(F.length(v) - 1, F.lit(1)),
        "dictionary": _share(low, words) if words else F.lit(0.0),
        "slashes": F.length(v) - F.length(F.regexp_replace(v, "/", "")),
        "path": before.rlike(r"(://|www\.|[/\\.@])\S*$"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "word_near": before.rlike(WORDS),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        "word_after": after.rlike(r"^\S{0,2}\s+[A-Za-z]{2,}"),
    }
    return {k: x.cast("double") for k, x in out.items()}


def weak_label(c: Column) -> Column:
    """1 for findings whose format or assignment confirms a credential, else 0."""
    return (c["value"].rlike(FORMATS) | c["before"].rlike(ASSIGNED)).cast("int")


def is_candidate(c: Column) -> Column:
    return c["value"].rlike("[0-9]")


def vocabulary(texts: DataFrame) -> tuple[list[str], list[str]]:
    """(frequent words of four letters or more, frequent letter pairs) of ordinary text."""
    word = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\w])([a-z]{4,12})(?![\w])"), F.lit(1))).alias("w")).groupBy("w").count()
    top = word.orderBy(F.desc("count"), "w").limit(4 * MAX_WORDS).collect()
    pairs: dict[str, int] = {}
    for r in top:
        for a, b in zip(r["w"], r["w"][1:]):
            pairs[a + b] = pairs.get(a + b, 0) + r["count"]
    return [r["w"] for r in top[:MAX_WORDS]], sorted(pairs, key=lambda p: (-pairs[p], p))[:MAX_PAIRS]


def kind(c: Column) -> Column:
    """The published format of a finding from 1 up, -1 for one confirmed by its assignment only, 0 for the others."""
    out = F.when(c["value"].rlike(KINDS[0]), 1)
    for k, pattern in enumerate(KINDS[1:], 2):
        out = out.when(c["value"].rlike(pattern), k)
    return out.when(c["before"].rlike(ASSIGNED), -1).otherwise(0)


def weak_findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_FINDINGS, least: int = LEAST_FINDINGS) -> DataFrame:
    """(value, before, after, label) of candidates of all documents: of each kind those of the ``most`` smallest hashes.

    A kind of fewer than ``least`` findings is repeated to about that number.
    """
    c = F.col("c")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").rlike("[0-9]"))
    found = texts.select("doc_id", F.explode(tokens(F.col("text"))).alias("c")).where(is_candidate(c))
    rows = found.select("c.value", "c.before", "c.after", weak_label(c).alias("label"), kind(c).alias("kind"), F.xxhash64("doc_id", "c.value", "c.before", "c.after").alias("hash"))
    rows = rows.withColumn("bin", F.pmod(F.shiftrightunsigned("hash", 40), F.lit(HASH_BINS)))
    # Kinds times bins are few counts; the first bins that hold ``most`` findings hold the chosen ones.
    reach: dict[int, tuple[int, int]] = {}
    for r in sorted(rows.groupBy("kind", "bin").count().collect()):
        last, n = reach.get(r["kind"], (-1, 0))
        reach[r["kind"]] = (r["bin"], n + r["count"]) if n < most else (last, n)
    near = F.lit(False)
    for k, (last, _) in reach.items():
        near = near | ((F.col("kind") == k) & (F.col("bin") <= last))
    order = Window.partitionBy("kind").orderBy("bin", "hash", "value", "before", "after")
    times = F.lit(1)
    for k, (_, n) in reach.items():
        if n < least:
            times = F.when(F.col("kind") == k, math.ceil(least / n)).otherwise(times)
    chosen = rows.where(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return chosen.select("value", "before", "after", "label", F.explode(F.sequence(F.lit(1), times)).alias("_")).drop("_")


def train(findings: DataFrame, dictionary: list[str], pairs: list[str], trees: int = TREES, depth: int = DEPTH) -> list:
    """Forest as nested tuples (feature, threshold, left, right) or a vote 0/1 per leaf.

    With findings of one class only, the forest always votes for it; without
    any, it votes against.
    """
    c = F.struct("value", "before", "after")
    rows = findings.select(*[x.alias(k) for k, x in features(c, dictionary, pairs).items()], F.col("label").cast("double").alias("label"))
    # A bounded sample in one ordered partition makes bagging repeatable.
    rows = rows.coalesce(1).sortWithinPartitions(*FEATURES, "label")
    seen = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(seen) < 2:
        return [seen[0] if seen else 0.0]
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(rows)
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=2, featureSubsetStrategy="sqrt").fit(data)

    def walk(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        s = node.split()
        return FEATURES[s.featureIndex()], float(s.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._call_java("rootNode")) for t in model.trees]


def votes(forest: list, f: dict[str, Column]) -> Column:
    """Share of trees that call a finding a secret."""

    def one(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        name, cut, left, right = node
        return F.when(f[name] <= F.lit(cut), one(left)).otherwise(one(right))

    total = one(forest[0])
    for t in forest[1:]:
        total = total + one(t)
    return total / len(forest)


def scan(docs: DataFrame, forest: list, dictionary: list[str], pairs: list[str], doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, findings, clean, row) of every row of ``docs``.

    ``findings`` lists (value, score, secret) in order, ``clean`` is the text
    with secrets masked, ``row`` holds all columns of the row. Null, empty and
    digit-free texts have no candidates and stay as they are.
    """
    empty = F.array().cast("array<struct<value:string,before:string,after:string>>")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    col = F.col("text")

    def judged(c: Column) -> Column:
        f = features(c, dictionary, pairs)
        named = F.struct(*[x.alias(k) for k, x in f.items()])
        # One-element arrays keep the features from being worked out anew at every node.
        score = F.element_at(F.transform(F.array(named), lambda n: votes(forest, {k: n[k] for k in f})), 1)
        return F.struct(c["value"].alias("value"), F.when(is_candidate(c), score).otherwise(F.lit(0.0)).alias("score"))

    each = F.when(col.rlike("[0-9]"), tokens(col)).otherwise(empty)
    out = rows.withColumn("_t", each).withColumn("_f", F.coalesce(F.transform("_t", judged), F.array().cast("array<struct<value:string,score:double>>")))
    gaps = F.split(col, TOKEN, -1)
    kept = F.transform("_f", lambda x: F.when(x["score"] > threshold, F.lit(MASK)).otherwise(x["value"]))
    masked = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), kept.alias("k")), lambda z: F.concat(z["g"], F.coalesce(z["k"], F.lit("")))), "")
    dirty = F.exists("_f", lambda x: x["score"] > threshold)
    named = F.filter("_f", lambda x: x["value"].rlike("[0-9]"))
    findings = F.transform(named, lambda x: F.struct(x["value"].alias("value"), x["score"].alias("score"), (x["score"] > threshold).alias("secret")))
    return out.select("doc_id", findings.alias("findings"), F.when(dirty, masked).otherwise(col).alias("clean"), "row")


def scan_with_weak_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Label the findings of all ``docs``, train on a bounded sample of each kind, then scan all of them."""
    dictionary, pairs = vocabulary(docs.select(F.col(f"`{text}`").cast("string").alias("text")))
    forest = train(materialize(weak_findings(docs, doc_id, text), "findings"), dictionary, pairs)
    return scan(docs, forest, dictionary, pairs, doc_id, text)
