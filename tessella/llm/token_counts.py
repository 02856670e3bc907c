"""Token counts by a linear longest-match automaton.

A word's greedy word pieces are the longest pieces of the vocabulary that
match from the left.  A trie of all pieces has, for each node, a failure link
and the number of pieces that are popped when it is followed; both are
computed once, so that each symbol of a word is read once and no piece is ever
built.  All different words of a block go through the automaton together, but
for very long ones, which go one by one.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessella.llm.packing import byte_letters
from tessella.llm.words import Words, blocks, given, returned, tune, utf8

END = 256
SYMBOLS = 257
NONE = -1
LONG = 4096  # bytes from which a word is walked by itself: the others are read abreast, a step for each byte of the longest


class Automaton:
    """Trie with failure links over the symbols 0-255 and END.

    pieces: tuples of symbols; END stands only last, in pieces that end a
    word.  A word with a symbol that no piece covers is one unknown token.
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        goto: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    final.append(False)
                at = goto[at][c]
            final[at] = at != 0
        link, pops = [NONE] * len(goto), [0] * len(goto)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in goto[u].items():
                if final[v]:
                    link[v], pops[v] = 0, 1
                else:
                    z, n = link[u], pops[u]
                    while z != NONE and c not in goto[z]:
                        z, n = link[z], n + pops[z]
                    if z != NONE:
                        link[v], pops[v] = goto[z][c], n
                todo.append(v)
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        at = np.array([(u * SYMBOLS + c, v) for u, row in enumerate(goto) for c, v in row.items()], np.int64).reshape(-1, 2)
        at = at[np.argsort(at[:, 0])]
        self.key, self.to = np.ascontiguousarray(at[:, 0]), np.ascontiguousarray(at[:, 1])
        self.next: dict[int, int] = {}

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's next nodes; NONE where there is none."""
        want = state * SYMBOLS + symbol
        i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[i] == want, self.to[i], NONE) if len(self.key) else np.full(len(state), NONE)

    def walk(self, word: bytes) -> int:
        """Number of pieces of one word + END, symbol by symbol."""
        if not self.next:
            self.next = dict(zip(self.key.tolist(), self.to.tolist(), strict=True))
            self.plain = self.link.tolist(), self.pops.tolist()
        (link, pops), step = self.plain, self.next
        state = count = 0
        for symbol in chain(word, (END,)):
            while (to := step.get(state * SYMBOLS + symbol, NONE)) == NONE:
                if link[state] == NONE:
                    return 1
                count, state = count + pops[state], link[state]
            state = to
        while state:
            if link[state] == NONE:
                return 1
            count, state = count + pops[state], link[state]
        return count

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of pieces of each word data[start:end] + END."""
        long = end - start > LONG
        out = np.empty(len(start), np.int64)
        out[~long] = self._abreast(data, start[~long], end[~long])
        for i in np.flatnonzero(long).tolist():
            out[i] = self.walk(data[start[i] : end[i]].tobytes())
        return out

    def _abreast(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        order = np.argsort(-n, kind="stable")  # longest first: those still read are a prefix
        start, n = start[order], n[order]
        state, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        lost = np.zeros(len(n), bool)
        for i in range(int(n[0]) + 1 if len(n) else 0):
            live = int(np.searchsorted(-n, -i, side="right"))  # words with n >= i
            ends = int(np.searchsorted(-n[:live], -i, side="left"))
            symbol = np.full(live, END, np.int64)
            symbol[:ends] = data[start[:ends] + i]
            todo = np.flatnonzero(~lost[:live])
            while len(todo):
                to = self.step(state[todo], symbol[todo])
                hit = to != NONE
                state[todo[hit]] = to[hit]
                todo = todo[~hit]
                at = state[todo]
                bad = self.link[at] == NONE
                lost[todo[bad]] = True
                count[todo] += self.pops[at]
                todo, at = todo[~bad], at[~bad]
                state[todo] = self.link[at]
        todo = np.flatnonzero(~lost & (state != 0))
        while len(todo):
            at = state[todo]
            bad = self.link[at] == NONE
            lost[todo[bad]] = True
            count[todo] += self.pops[at]
            state[todo] = np.maximum(0, self.link[at])
            todo = todo[~bad & (state[todo] != 0)]
        out = np.empty(len(n), np.int64)
        out[order] = np.where(lost, 1, count)
        return out


def read_pieces(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file; a trailing ``end_mark`` becomes END, special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    letter = byte_letters()
    out = []
    for word in spec["model"]["vocab"]:
        if word in special:
            continue
        stem = word.removesuffix(end_mark)
        if stem and all(c in letter for c in stem):
            out.append(tuple(letter[c] for c in stem) + ((END,) if stem != word else ()))
    return out


@lru_cache(maxsize=2)
def automaton(path: str, end_mark: str = "</w>") -> Automaton:
    return Automaton(read_pieces(path, end_mark))


def count_tokens(docs: DataFrame, vocabulary: str, end_mark: str = "</w>") -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_tokens: words of the lower-cased whole text, and their greedy word pieces.

    Null and empty texts have none of either; null ids stay null; repeated
    rows give repeated rows; other columns are ignored; an empty table gives an
    empty table.
    """
    tune(docs.sparkSession)

    def run(batches):
        machine = automaton(vocabulary, end_mark)
        for block in blocks(batches):
            words = Words([utf8((x or "").lower(), lower=False) for x in block["text"]])
            _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
            each = machine.counts(np.frombuffer(words.buf, np.uint8), words.start[first], words.end[first])
            total = np.r_[0, np.cumsum(each[which])] if len(which) else np.zeros(1, np.int64)
            yield pd.DataFrame({"doc_id": block["doc_id"], "n_words": np.diff(words.first), "n_tokens": np.diff(total[words.first])})

    return returned(given(docs, "text").mapInPandas(run, "doc_id string, n_words long, n_tokens long"))
