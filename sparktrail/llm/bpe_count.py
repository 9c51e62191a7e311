"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a word form a linked list; a heap holds each adjacent pair that
the vocabulary can merge, and the pair of the lowest rank, then the leftmost,
is merged until none is left. The count is the number of symbols at the start
less the merges: no identifier is made. A character outside the vocabulary
starts as one symbol for each of its UTF-8 bytes.

No piece of such a vocabulary goes over the start of a word, nor over a line
end, so words are merged one by one and the counts of words met before are kept,
in a cache of bounded size. Both facts are checked when a vocabulary is loaded.

Defined cases: a null or empty text has 0 tokens and 0 bytes; a text is never
cut; special strings in it are ordinary text; equal ranks go by place; repeated
rows are counted each; ids may be null or of any kind; an empty table gives no
rows; other columns are ignored unless named.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

SPACE = "▁"
CACHE_WORDS, CACHE_CHARS = 600_000, 64


class Merger:
    """ranks: piece to rank, low first. Counts the symbols that are left after all merges."""

    def __init__(self, ranks: dict[str, float]):
        for piece in ranks:
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError(f"a piece goes over a word's start or a line's end: {piece!r}")
        self.ranks = ranks
        self.spaced, self.bare = _Words(self, SPACE), _Words(self, "")
        self.breaks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")

    def merged(self, word: str) -> int:
        ranks, n = self.ranks, len(word)
        symbols = list(word)
        count = sum(1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            # Characters outside the vocabulary can stand inside a piece only if merged: then their bytes go.
            count -= self._weight(a) + self._weight(b) - 1
            symbols[i], symbols[j] = a + b, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                rank = ranks.get(symbols[i] + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
            h = left[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + symbols[i])
                if rank is not None:
                    heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        return count

    def _weight(self, symbol: str) -> int:
        return 1 if symbol in self.ranks else len(symbol.encode("utf-8", "surrogatepass"))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or SPACE in text:
            # Runs of spaces are pieces of their own, so words are not separated by single ones.
            total = 0
            for unit in self.breaks.findall(SPACE + text.replace(" ", SPACE)):
                total += len(unit) if unit[0] == "\n" else self.bare[unit]
            return total
        first, *rest = text.split("\n")
        total = sum(map(self.spaced.__getitem__, first.split(" "))) + len(rest)
        for line in rest:
            start, *words = line.split(" ")
            total += self.bare[start] + sum(map(self.spaced.__getitem__, words))
        return total


class _Words(dict):
    def __init__(self, merger: Merger, before: str):
        super().__init__()
        self.merger, self.before = merger, before

    def __missing__(self, word: str) -> int:
        n = self.merger.merged(self.before + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_LOADED: dict[str, Merger] = {}


def piece_merger(model: str) -> Merger:
    """Of a vocabulary file of pieces with scores; a name without a folder is looked up among the public tokenizers."""
    if model not in _LOADED:
        import public_tokenizers
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        plain = [i for i in range(pieces.vocab_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
        _LOADED.clear()
        _LOADED[model] = Merger({pieces.id_to_piece(i): -pieces.get_score(i) for i in plain})
    return _LOADED[model]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""

    def count(batches):
        merger = piece_merger(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [merger.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    ids = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return map_arrow(ids, count, f"doc_id {ids.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")
