"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Each task numbers the distinct pre-tokens of its texts and inserts those that are new
in a trie, a round of texts at a time. A node is a prefix and holds its unigram
forward score - the best log-probability of a segmentation of the prefix and that
segmentation's number of tokens (the fewest if scores tie) - computed once, from the
nodes above it. So words that share a prefix share its scores, and the count of a
pre-token is read at its terminal node. The trie is made depth by depth: the words are
sorted, so a depth's nodes are runs of equal (node above, character), and all nodes of
a depth get their scores at once from the pieces of each length that end there.
Texts are counted by adding up terminal counts.

There is no shuffle: counts are functions of the text, and a task remembers the
counts of words up to a fixed number of characters - a full table is dropped and a
new one begun, which changes no result. Pre-tokens over ``LONG`` characters are scored
by the same recurrence along the word, without a trie.

Defined results: a null or empty text has 0 tokens; repeated rows stay repeated;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm import pieces as pc
from tabprep.llm import units
from tabprep.llm.sampled_pieces import _BASE, Vocabulary

LONG = 48
#: Words that are put in one trie, and characters of text whose words are numbered before.
TRIE_WORDS, ROUND_CHARS = 100_000, 16_000_000


def walk(word: str, pieces: pc.Pieces) -> tuple[float, int]:
    """The forward score and count of one marked word, from its shorter prefixes."""
    best, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        c, top, n = word[end - 1], -1e300, 0
        for first in range(max(0, end - pieces.longest), end):
            s = pieces.scores.get(word[first:end])
            if s is None:
                if first < end - 1:
                    continue
                k = len(c.encode("utf-8", "replace"))  # a character by its bytes
                s = pc.BYTE_SCORE * k
            else:
                k = 1
            s, k = s + best[first], k + count[first]
            if s > top or s == top and k < n:
                top, n = s, k
        best.append(top)
        count.append(n)
    return best[-1], count[-1]


def trie_scores(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, int]:
    """The terminal scores and counts of sorted distinct marked words, and the
    number of nodes of their trie."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum(size) - size
    score, tokens = np.zeros(len(words)), np.zeros(len(words), np.int64)
    live, node, nodes = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    # of the nodes one depth up: hashes of the last 0, 1, ... characters; scores and counts of the node so far above
    above = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
    for depth in range(1, int(size.max(initial=0)) + 1):
        on = size[live] >= depth
        live, node = live[on], node[on]
        char = chars[begins[live] + depth - 1]
        new = np.concatenate(([True], (node[1:] != node[:-1]) | (char[1:] != char[:-1])))
        parent, c, node = node[new], char[new], np.cumsum(new) - 1
        nodes += len(parent)
        width = (1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000))
        top, n = np.full(len(c), -1e300), np.zeros(len(c), np.int64)
        code = c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        level, lone = [], np.ones(len(c), bool)
        for k, (h, best, count) in enumerate(above[: vocab.pieces.longest], 1):
            level.append((h[parent] * _BASE + code, best[parent], count[parent]))
            hit, at = vocab.find(k, level[-1][0])
            s, t = vocab.scores[at] + level[-1][1][hit], level[-1][2][hit] + 1
            if k == 1:
                lone[hit] = False
            better = (s > top[hit]) | (s == top[hit]) & (t < n[hit])
            top[hit[better]], n[hit[better]] = s[better], t[better]
        s, t = pc.BYTE_SCORE * width + level[0][1], level[0][2] + width   # characters without a piece: their bytes
        better = lone & ((s > top) | (s == top) & (t < n))
        top[better], n[better] = s[better], t[better]
        above = [(np.zeros(len(c), np.uint64), top, n), *level]
        done = size[live] == depth
        score[live[done]], tokens[live[done]] = top[node[done]], n[node[done]]
    return score, tokens, nodes


class Counter:
    """Counts the tokens of texts; remembers the counts of their words."""

    def __init__(self, pieces: pc.Pieces):
        self.pieces, self.vocab = pieces, Vocabulary(pieces)
        self._forget()

    def _forget(self):
        self.numbers, self.score, self.tokens = units.Numbers(), units.Grown(np.float64), units.Grown(np.int64)

    def _learn(self):
        fresh, self.numbers.fresh = self.numbers.fresh, []
        marked = [pc.SPACE + w for w in fresh]
        order = sorted((i for i, w in enumerate(fresh) if len(w) <= LONG), key=marked.__getitem__)
        score, tokens = np.zeros(len(fresh)), np.zeros(len(fresh), np.int64)
        for a in range(0, len(order), TRIE_WORDS):
            some = order[a: a + TRIE_WORDS]
            score[some], tokens[some], _ = trie_scores([marked[i] for i in some], self.vocab)
        for i, w in enumerate(fresh):
            if len(w) > LONG:
                score[i], tokens[i] = walk(marked[i], self.pieces)
        self.score.add(score)
        self.tokens.add(tokens)

    def count(self, texts: list[str]):
        """For blocks of texts: tokens, pre-tokens and score of each text."""
        if self.numbers.full:
            self._forget()
        done = []
        for a, b in units.blocks(texts):
            which, counts = self.numbers.of([pc.pre_tokens(t) for t in texts[a:b]])
            done.append((which.astype(np.int32), counts))
        if self.numbers.fresh:
            self._learn()
        for which, counts in done:
            score, real = np.zeros(len(counts)), counts > 0
            if real.any():
                score[real] = np.add.reduceat(self.score.all[which], (np.cumsum(counts) - counts)[real])
            yield units.sums(self.tokens.all[which], counts), counts, score


def _counter(pieces):
    def run(batches):
        counter = Counter(pieces.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in units.blocks(texts, ROUND_CHARS):
                found = [np.concatenate(x) for x in zip(*counter.count(texts[first:last]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *map(pa.array, found)],
                                                 ["doc_id", "n_tokens", "n_pre_tokens", "score"])
    return run


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = pc.MODEL) -> DataFrame:
    """One row per document row: ``doc_id, n_tokens, n_pre_tokens, score`` (the
    log-probability of the best segmentation)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = docs.sparkSession.sparkContext.broadcast(pc.load(model))
    return d.mapInArrow(_counter(pieces),
                        f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, n_pre_tokens long, score double")
