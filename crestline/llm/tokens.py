"""Token ids of whole texts with a public tokenizer file, cached by chunk between ASCII white space.

The tokenizers used here never join characters across white space, so a text's
ids are those of its chunks. Distinct chunks are few next to their occurrences;
a worker encodes each once with the library. About half of the distinct chunks
of a corpus occur once, so a chunk first waits in a short memory of WAITING
chunks and moves to the cache of CACHE_CHUNKS when it comes again. Chunks of
more than CHUNK_BYTES (paragraphs without spaces) are encoded anew.
"""

from __future__ import annotations

import os

import numpy as np

from crestline.llm.base import kept

CACHE_CHUNKS, WAITING = 600_000, 150_000
CHUNK_BYTES = 48
# New chunks are handed to the library in lots of so many, and of so many bytes.
LOT, LOT_BYTES = 20_000, 1 << 20


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: bytes) -> bool:
    """Whether lower-casing A-Z beforehand cannot change the ids: no special token in capitals, no combining marks to compose with."""
    return b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder; a worker that runs several tasks keeps its cache."""
    return kept("tokens", path, lambda: ChunkEncoder(path))


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.waiting: dict[bytes, bytes] = {}
        name = "<|endoftext|>"
        number = self.tokenizer.token_to_id(name)
        alone = number is not None and self.tokenizer.encode(f"a{name}a", add_special_tokens=False).ids.count(number) == 1
        self.fence = (name, number) if alone else None
        # With a tokenizer that lower-cases, "The" and "the" share an entry.
        self.folds = self.tokenizer.encode("ABYZ", add_special_tokens=False).ids == self.tokenizer.encode("abyz", add_special_tokens=False).ids

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Ids of every text, each closed by ``end``."""
        tail, cache, waiting = np.uint32(end).tobytes(), self.cache, self.waiting
        split = [(t.lower() if self.folds and _plain(t) else t).split() for t in texts]
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        lot, size = [], 0
        fresh = []
        for w in set().union(*split).difference(cache):
            if w in waiting:
                cache[w] = waiting.pop(w)
                continue
            fresh.append(w)
            lot.append(w)
            size += len(w)
            if len(lot) >= LOT or size >= LOT_BYTES:
                self._learn(lot)
                lot, size = [], 0
        if lot:
            self._learn(lot)
        get = cache.__getitem__
        out = [b"".join(map(get, words)) + tail for words in split]
        if len(waiting) > WAITING:
            waiting.clear()
        for w in fresh:
            ids = cache.pop(w)
            if len(w) <= CHUNK_BYTES:
                waiting[w] = ids
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks, all in one text with a special token between them where the tokenizer has one."""
        cache, plain = self.cache, chunks
        if self.fence:
            plain = [w for w in chunks if b"<|" in w]
            rest = [w for w in chunks if b"<|" not in w]
            name, number = self.fence
            text = name.join([w.decode("utf-8", "replace") for w in rest])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == number)
            if len(cuts) == len(rest) - 1:
                raw = ids.tobytes()
                starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
                cache.update(zip(rest, [raw[a:b] for a, b in zip(starts, ends)]))
            else:
                plain = chunks
        done = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in plain], add_special_tokens=False)
        for w, e in zip(plain, done):
            cache[w] = np.array(e.ids, "<u4").tobytes()
