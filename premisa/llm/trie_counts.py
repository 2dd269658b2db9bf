"""Unigram token counts of documents, worked out on a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from premisa.llm.common import per_worker, tokenizer_file, with_result

MARK = "▁"
TRIE_NODES = 400_000
CACHE_WORDS = 300_000
PRE_TOKEN = 64


class Vocabulary:
    """Pieces with log-probabilities. The file ranks its pieces; a piece of rank r gets the share of
    a Zipf law, minus the logarithm of r + 2. A character outside is one token per UTF-8 byte, each
    below the least likely piece."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {}
        for i in range(model.get_piece_size()):
            special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
            if not special and not model.is_unused(i):
                scores[model.id_to_piece(i)] = -math.log(i + 2.0)
        return cls(scores)


class Trie:
    """Best segmentations of all prefixes met so far.

    A node is a prefix of a pre-token and stores its forward score, the best sum of scores of a
    segmentation, and the tokens of that segmentation. It depends on the prefix alone, so pre-tokens
    that begin alike share the work; a pre-token's count is read at its last node. Of equal scores the
    one with fewer tokens counts. The trie is emptied when it holds ``TRIE_NODES``, which changes no
    result.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.children: list[dict[str, int]] = [{}]
        self.score = [0.0]
        self.tokens = [0]

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of a pre-token."""
        if len(self.score) + len(word) > TRIE_NODES:
            self.children, self.score, self.tokens = [{}], [0.0], [0]
        at, path = 0, [0]
        children, score, tokens = self.children, self.score, self.tokens
        known, longest, byte = self.vocabulary.scores, self.vocabulary.longest, self.vocabulary.byte
        for i, letter in enumerate(word):
            below = children[at].get(letter)
            if below is None:
                best, fewest = -math.inf, 0
                for start in range(max(0, i + 1 - longest), i + 1):
                    s = known.get(word[start : i + 1])
                    n = 1
                    if s is None:
                        if start < i:
                            continue
                        n = len(letter.encode("utf-8", "surrogatepass"))
                        s = byte * n
                    node = path[start]
                    total, count = score[node] + s, tokens[node] + n
                    if total > best or (total == best and count < fewest):
                        best, fewest = total, count
                below = len(score)
                children[at][letter] = below
                children.append({})
                score.append(best)
                tokens.append(fewest)
            at = below
            path.append(at)
        return tokens[at]

    def long_count(self, word: str) -> int:
        """The same forward scores for one long pre-token, keeping only as many as a piece is long."""
        known, longest, byte = self.vocabulary.scores, self.vocabulary.longest, self.vocabulary.byte
        scores, counts = [0.0], [0]
        for i, letter in enumerate(word):
            best, fewest = -math.inf, 0
            for k in range(min(longest, i + 1), 0, -1):
                s, n = known.get(word[i + 1 - k : i + 1]), 1
                if s is None:
                    if k > 1:
                        continue
                    n = len(letter.encode("utf-8", "surrogatepass"))
                    s = byte * n
                total, count = scores[-k] + s, counts[-k] + n
                if total > best or (total == best and count < fewest):
                    best, fewest = total, count
            scores.append(best)
            counts.append(fewest)
            if len(scores) > 4 * longest:
                del scores[:-longest], counts[:-longest]
        return counts[-1]


class Counts(dict):
    """Token counts of words, kept within a bound; a long word keeps nothing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.trie = Trie(vocabulary)

    def __missing__(self, word: str) -> int:
        if len(word) > PRE_TOKEN:
            return self.trie.long_count(MARK + word)
        found = self.trie.count(MARK + word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


def counter(path: str) -> Counts:
    """One per Python worker, so that its words last over tasks."""
    return per_worker("counter", path, lambda: Counts(Vocabulary.load(path)))


def token_counts(
    docs: DataFrame, text: str = "text", vocabulary: str | None = None, into: str = "token_counts"
) -> DataFrame:
    """Add the struct ``into``: ``n_words``, ``n_tokens`` and ``max_word_tokens`` of every text.

    Pre-tokens are the words between white space, each with a leading mark; tokens are those of the
    most likely segmentation under a unigram model on the pieces of ``vocabulary`` (a sentencepiece
    file). A NULL or empty text has none. Repeated rows are counted each; a column named like
    ``into`` is replaced. Words are kept per worker in bounded tables.
    """
    path = vocabulary or tokenizer_file("piece_bpe_32k.model")
    fields = ["n_words", "n_tokens", "max_word_tokens"]
    kind = T.StructType([T.StructField(f, T.LongType()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        get = counter(path).__getitem__
        for batch in batches:
            found: list[list[int]] = [[], [], []]
            for t in batch.column(text).to_pylist():
                own = list(map(get, t.split())) if t else []
                for store, x in zip(found, (len(own), sum(own), max(own, default=0)), strict=True):
                    store.append(x)
            yield batch, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields)

    return with_result(docs, into, kind, run)
