"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary entry at every
place. A trie of the vocabulary with failure links does it in one pass: where a
trie node has no edge for the next character, its failure link leads to the
node of what remains after the longest pieces are taken off, and the number of
pieces taken off is stored with the link. Only numbers are added up; no piece
is built.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.base import kept, map_texts, text_slices

# Counts of at most so many words, of at most so many bytes each, stay with a worker.
CACHE_WORDS = 500_000
WORD_BYTES = 48
MARK = "▁"


def load_vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece model; those that begin with the mark begin a word."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class LongestMatch:
    """Trie with failure links over word starts and continuations.

    Two roots: 0 for the beginning of a word, 1 for its continuation. Entries
    with the mark hang below root 0 without it, all others below root 1.
    """

    def __init__(self, vocabulary: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for piece in vocabulary:
            if piece == MARK or not piece:
                continue
            at, rest = (0, piece[1:]) if piece.startswith(MARK) else (1, piece)
            for ch in rest:
                to = self.edges[at].get(ch)
                if to is None:
                    to = self.edges[at][ch] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                at = to
            final[at] = True
        # A word may also begin with the mark alone, followed by continuations.
        alone = MARK in vocabulary
        n = len(self.edges)
        self.link = [-1] * n
        self.popped = [0] * n
        if alone:
            self.link[0], self.popped[0] = 1, 1
        queue: deque[int] = deque([0, 1])
        while queue:
            u = queue.popleft()
            for ch, v in self.edges[u].items():
                if final[v]:
                    self.link[v], self.popped[v] = 1, 1
                else:
                    z, taken = self.link[u], self.popped[u]
                    while z >= 0 and ch not in self.edges[z]:
                        taken += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.edges[z][ch], taken
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if it cannot be covered."""
        edges, link, popped = self.edges, self.link, self.popped
        at = total = 0
        for ch in word:
            while ch not in edges[at]:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 0
            at = edges[at][ch]
        while at != 1:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 0
        return total


def _matcher(vocabulary: str | None) -> tuple[LongestMatch, dict[bytes, int]]:
    """The worker's automaton and the counts of words it has seen, kept from task to task."""
    return kept("wordpiece", vocabulary, lambda: (LongestMatch(load_vocabulary(vocabulary)), {}))


def token_counts(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    Words are runs between ASCII white space. A word that the vocabulary cannot
    cover counts as one token and as one unknown. Null and empty texts count
    zero; repeated rows and null ids are kept; other columns are ignored.
    """

    def fn(batch):
        match, cache = _matcher(vocabulary)
        for a, e, texts in text_slices(batch):
            n_words, n_tokens, n_unknown = [], [], []
            for t in texts:
                words = t.split()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                fresh = set(words).difference(cache)
                for w in fresh:
                    cache[w] = match.count(w.decode("utf-8", "replace"))
                each = list(map(cache.__getitem__, words))
                for w in fresh:
                    if len(w) > WORD_BYTES:
                        del cache[w]
                bad = each.count(0)
                n_words.append(len(words))
                n_tokens.append(sum(each) + bad)
                n_unknown.append(bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, e - a), *(pa.array(c, pa.int64()) for c in (n_words, n_tokens, n_unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(cols, fn, "doc_id long, n_words long, n_tokens long, n_unknown long", "wordpiece")
