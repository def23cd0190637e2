"""Token counts by trie-shared dynamic programming.

The unigram model: the pieces of a public byte-level vocabulary, with the Zipf
probability 1 / ((rank + 1) * H) of a piece's rank (H normalises), so nothing is
trained. A pre-token's tokens are those of its most probable segmentation (of equally
probable ones, the one of fewest tokens). Per Arrow batch, the distinct pre-tokens are
put into a trie (as a sorted list, whose neighbours share their prefix); the forward
score of each trie node is computed once, however many pre-tokens pass through it, and
the count at each terminal node is stored. Rows never move between tasks: the whole
job is one scan, and what a task holds is one batch and a memory of bounded size.

Defined results: a null or empty text has 0 tokens and 0 pre-tokens; repeated rows are
counted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame

from caseloom.llm import pretokens

SCHEMA = "doc_id long, n_bytes long, n_pretokens long, n_tokens long"


@lru_cache(maxsize=2)
def unigram_scores(file: str = pretokens.RANKS_FILE) -> tuple[dict[bytes, float], int]:
    """Log probability of each piece, and the length of the longest."""
    ranks = pretokens.ranks(file)
    log_h = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - log_h for p, r in ranks.items()}, max(map(len, ranks))


class PretokenTrie:
    """Forward scores over the trie of the pre-tokens given so far."""

    def __init__(self, scores: dict[bytes, float], longest: int):
        self.scores, self.longest = scores, longest
        self.computed = 0  # trie nodes whose forward score was computed

    def terminal_counts(self, words: Iterable[bytes]) -> dict[bytes, int]:
        get, longest = self.scores.get, self.longest
        out: dict[bytes, int] = {}
        path = b""
        best, count = [0.0], [0]  # forward score and tokens of the node at each depth of `path`
        for word in sorted(set(words)):
            shared = len(commonprefix((path, word)))
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, tokens = -math.inf, 0
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    score = get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and count[start] < tokens - 1):
                            top, tokens = score, count[start] + 1
                best.append(top)
                count.append(tokens)
                self.computed += 1
            path, out[word] = word, count[-1]
        return out


def count_batch(texts: list[str | None], memory: dict[str, int], trie: PretokenTrie) -> list[tuple[int, int]]:
    """(pre-tokens, tokens) of each text. memory: of words that stand alone with a space
    before them, tokens + (pre-tokens << 40), which this fills."""
    pieces: list[tuple[list[str], list[str]]] = []  # of each text: remembered words, other pre-tokens
    find, new, other = pretokens.pattern().findall, set(), set()
    for t in texts:
        first, *rest = (t or "").split(" ")
        seen = all(map(memory.__contains__, rest)) and not first[-1:].isspace()
        if seen or pretokens.split_words(t or "") is not None:
            pieces.append((rest, find(first)))
            if not seen:
                new.update(w for w in rest if w not in memory)
        else:
            pieces.append(([], find(t or "")))
        other.update(pieces[-1][1])
    split = {w: [x.encode() for x in find(" " + w)] for w in new}
    counts = trie.terminal_counts({x for xs in split.values() for x in xs} | {x.encode() for x in other})
    memory.update({w: sum(counts[x] for x in xs) + (len(xs) << 40) for w, xs in split.items()})
    out = []
    for rest, own in pieces:
        n = sum(map(memory.__getitem__, rest))
        out.append(((n >> 40) + len(own), (n & (1 << 40) - 1) + sum(counts[x.encode()] for x in own)))
    if len(memory) > pretokens.MEMORY:
        memory.clear()
    return out


_memory: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, vocabulary: str = pretokens.RANKS_FILE) -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens) of documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, memory = PretokenTrie(*unigram_scores(vocabulary)), _memory.setdefault(vocabulary, {})
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                texts = part["text"].tolist()
                counts = count_batch(texts, memory, trie)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "n_bytes": [len((t or "").encode()) for t in texts],
                        "n_pretokens": [a for a, _ in counts],
                        "n_tokens": [b for _, b in counts],
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
