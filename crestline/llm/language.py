"""Language identification by cross-parsing entropy.

Per language, a suffix automaton holds every substring of some labelled text.
A text is parsed greedily into the longest phrases that occur in the sample of
a language; a phrase costs the bits of a pointer into that sample, and the
language with the fewest normalised phrases (bits per letter) wins. Phrases end
at word ends, so that the parse of a word is a pure function of the word: a
worker parses each distinct word once and adds up counts for whole texts.

Every labelled language is learned from a sample of the same bounds. Languages
whose automata do not fit into a worker together are parsed against in groups,
one pass over the texts per group; the two lowest costs of each group are merged.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.base import kept, map_texts, text_slices

# Labelled sample: texts per language, characters per text and per language; the rest of the labelled rows is not learned from.
SAMPLE_TEXTS = 24
SAMPLE_CHARS = 2_500
LANGUAGE_CHARS = 60_000
# Characters of the samples of a group, so that its automata fit into a worker.
GROUP_CHARS = 240_000
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """Every substring of a text, in a number of states linear in its length."""

    def __init__(self, text: str):
        self.size = max(1, len(text))
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def phrases(self, text: str) -> int:
        """Number of longest-match phrases; a letter the sample lacks is a phrase by itself."""
        step, n, i, count = self.next, len(text), 0, 0
        while i < n:
            state = step[0]
            start = i
            while i < n:
                to = state.get(text[i])
                if to is None:
                    break
                state, i = step[to], i + 1
            if i == start:
                i += 1
            count += 1
        return count


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, each between word marks."""
    return [f" {w} " for w in _WORD.findall(text.lower())]


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text) of the learned sample: per language the texts of smallest id hash, short ones of few letters last.

    Ids are ranked without their texts; the chosen texts are then read by id.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    w = Window.partitionBy("_l").orderBy((F.col("_n") < chars // 4), F.xxhash64("_d"), "_d")
    ids = (
        rows.select(F.col(doc_id).alias("_d"), F.col(lang).alias("_l"), F.length(text).alias("_n"))
        .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= texts)
    )
    chosen = [(r["_l"], r["_d"]) for r in ids.select("_l", "_d").collect()]
    if not chosen:
        return []
    picked = rows.where(F.col(doc_id).isin([d for _, d in chosen])).select(F.col(doc_id).alias("d"), F.col(lang).alias("l"), F.substring(text, 1, chars).alias("t"))
    wanted = set(chosen)
    return sorted({(r["l"], r["t"]) for r in picked.collect() if (r["l"], r["d"]) in wanted})


def learn(labelled: list[tuple[str, str]], chars: int = LANGUAGE_CHARS) -> dict[str, str]:
    """Training text per language, of the same length at most for all of them."""
    by: dict[str, list[str]] = {}
    for lang, text in labelled:
        by.setdefault(lang, []).extend(words_of(text))
    return {lang: "".join(w)[:chars] for lang, w in sorted(by.items()) if w}


def grouped(texts: dict[str, str], chars: int = GROUP_CHARS) -> list[dict[str, str]]:
    """Languages in groups of at most ``chars`` characters, one language at least."""
    out: list[dict[str, str]] = []
    size = 0
    for lang, t in sorted(texts.items()):
        if not out or size + len(t) > chars:
            out.append({})
            size = 0
        out[-1][lang] = t
        size += len(t)
    return out


class Parser:
    """Bits per language of words, cached."""

    def __init__(self, texts: dict[str, str]):
        self.langs = list(texts)
        self.automata = [SuffixAutomaton(t) for t in texts.values()]
        self.bits = np.array([math.log2(a.size + 1) for a in self.automata])
        self.slot: dict[str, int] = {}
        self.rows: list[list[int]] = []
        self.table = np.zeros((0, len(self.langs)), np.int64)

    def top(self, texts: list[str]) -> list[list[tuple[float, str]]]:
        """(bits, language) of the best and second-best language of whole texts; none of a text without a letter."""
        split = [_WORD.findall(t.lower()) for t in texts]
        flat = [w for words in split for w in words]
        out = []
        if not flat or not self.langs:
            return [[]] * len(texts)
        if len(self.slot) > CACHE_WORDS:
            self.slot.clear()
            self.rows.clear()
            self.table = self.table[:0]
        for w in set(flat).difference(self.slot):
            self.slot[w] = len(self.rows)
            marked = f" {w} "
            self.rows.append([a.phrases(marked) for a in self.automata])
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int64)])
        at = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        total = np.concatenate([np.zeros((1, len(self.langs)), np.int64), np.cumsum(self.table[at], axis=0)])
        ends = np.cumsum([0, *map(len, split)])
        for a, b in zip(ends, ends[1:]):
            if a == b:
                out.append([])
                continue
            cost = (total[b] - total[a]) * self.bits
            out.append([(float(cost[k]), self.langs[k]) for k in np.argsort(cost, kind="stable")[:2]])
        return out

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of whole texts."""
        return [(t[0][1], 1 - t[0][0] / t[1][0] if len(t) > 1 else 1.0) if t else ("und", 0.0) for t in self.top(texts)]


def _parser(texts: dict[str, str]) -> Parser:
    """The worker's automata and the parses of words it has seen, kept from task to task."""
    return kept("language", tuple(texts.items()), lambda: Parser(texts))


def identify(docs: DataFrame, texts: dict[str, str], doc_id: str = "doc_id", text: str = "text", group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text alone.

    ``score`` is 1 - bits of the best / bits of the second best language, 1 if
    only one is known; equal costs go to the name that sorts first. A text that
    is null or has no letter, and every text if nothing was learned, is ``und``
    with score 0. Repeated rows and null ids are kept; other columns are ignored.
    """
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    groups = grouped(texts, group_chars)
    if len(groups) > 1:
        return _merged(cols, groups)
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def fn(batch):
        parser = _parser(shared.value)
        for a, e, raw in text_slices(batch):
            found = parser.score([t.decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, e - a), pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return map_texts(cols, fn, "doc_id long, lang_pred string, score double", "language")


def _merged(cols: DataFrame, groups: list[dict[str, str]]) -> DataFrame:
    """One pass per group; costs meet by id and digest of the text, of which they are a pure function, and equal rows are counted."""
    kind = pa.list_(pa.struct([("bits", pa.float64()), ("lang", pa.string())]))

    def one(number: int, texts: dict[str, str]) -> DataFrame:
        shared = cols.sparkSession.sparkContext.broadcast(texts)

        def fn(batch):
            parser = _parser(shared.value)
            for a, e, raw in text_slices(batch):
                top = [[{"bits": b, "lang": x} for b, x in t] for t in parser.top([t.decode("utf-8", "replace") for t in raw])]
                digest = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), digest, pa.array(top, kind)], ["doc_id", "digest", "top"])

        return map_texts(cols, fn, "doc_id long, digest binary, top array<struct<bits:double,lang:string>>", "language").withColumn("first", F.lit(int(number == 0)))

    passes = [one(k, g) for k, g in enumerate(groups)]
    rows = passes[0]
    for p in passes[1:]:
        rows = rows.unionByName(p)
    # Sorted by bits, then name; a group gives two costs at most, and repeated rows the same ones.
    merged = rows.groupBy("doc_id", "digest").agg(F.array_sort(F.flatten(F.collect_set("top"))).alias("top"), F.sum("first").cast("int").alias("n"))
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    score = F.when(best.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(1 - best["bits"] / second["bits"])
    each = merged.select("doc_id", F.coalesce(best["lang"], F.lit("und")).alias("lang_pred"), score.alias("score"), F.explode(F.sequence(F.lit(1), "n")).alias("_"))
    return each.drop("_")


def identify_from_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from rows whose id's crc32 is not 2 modulo 4."""
    fold = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    texts = learn(sample(docs.where(~fold), doc_id, text, lang))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, texts, doc_id, text).select("doc_id", held.alias("held_out"), "lang_pred", "score")
