"""Word-piece token counts by a linear longest-match automaton, without building pieces.

The vocabulary's trie has a second root for pieces inside a word. A state's failure link leads to the state reached
when the pieces that greedy matching would cut off have been popped; only the number of those pieces is kept. A word
is read byte by byte: without a transition the state's popped count is added and its failure link taken. A word that
can't be matched to its end is one unknown token, as in greedy word-piece matching. Words are runs of
`[^\\x20\\x09-\\x0D]`. The vocabulary derives from a public model file (VOCABULARY, a parameter): pieces with the
whitespace marker begin words, others stand inside them. Null, empty and blank texts have no words and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_views
from .double_array import DoubleArray, build, distinct
from .words import bounds

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_INSIDE = 256  # the code of the edge from the root to the root of pieces inside words


@dataclass
class Automaton:
    """Trie, failure links (-1: none) and popped counts by state, and the root of pieces inside words."""

    trie: DoubleArray
    fail: np.ndarray
    popped: np.ndarray
    inside: int


def vocabulary(model: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that stand inside one."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    return [x[1:] for x in names if x.startswith(MARK) and x[1:] and MARK not in x[1:]], [x for x in names if MARK not in x]


def automaton(first: list[str], inside: list[str]) -> Automaton:
    keys = [list(x.encode()) for x in dict.fromkeys(first)] + [[_INSIDE, *x.encode()] for x in dict.fromkeys(inside)]
    trie, edges = build(keys, list(range(len(keys))))
    n = len(trie.base)
    fail, popped = [-1] * n, [0] * n
    base, check, value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
    root = base[0] + _INSIDE if check[base[0] + _INSIDE] == 0 else -1
    for parent, code, state in edges:  # parents stand before their children
        if state == root:
            continue
        if value[state] >= 0:
            fail[state], popped[state] = root, 1
            continue
        z, count = fail[parent], popped[parent]
        while z >= 0 and check[base[z] + code] != z:
            count += popped[z]
            z = fail[z]
        if z >= 0:
            fail[state], popped[state] = base[z] + code, count
    return Automaton(trie, np.array(fail, np.int32), np.array(popped, np.int32), root)


def count_spans(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of each span (a word)."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    state, count = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
    lost = np.zeros(len(starts), bool)
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
    for k, n in enumerate(live):  # the first n words have a byte at place k
        todo = np.flatnonzero(~lost[:n])
        codes = data[starts[todo] + k].astype(np.int32)
        while len(todo):
            to, ok = a.trie.step(state[todo], codes)
            state[todo[ok]] = to[ok]
            todo, codes = todo[~ok], codes[~ok]
            count[todo] += a.popped[state[todo]]
            state[todo] = a.fail[state[todo]]
            gone = state[todo] < 0
            lost[todo[gone]] = True
            todo, codes = todo[~gone], codes[~gone]
    todo = np.flatnonzero(~lost & (state != a.inside) & (sizes > 0))
    while len(todo):
        count[todo] += a.popped[state[todo]]
        state[todo] = a.fail[state[todo]]
        lost[todo[state[todo] < 0]] = True
        todo = todo[(state[todo] >= 0) & (state[todo] != a.inside)]
    count[lost] = 1
    out = np.empty(len(starts), np.int64)
    out[order] = count
    return out


def token_counts(docs: DataFrame, a: Automaton) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(a)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_views(b.column(1)):
                starts, ends = bounds(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
                begins = np.searchsorted(starts, offsets)
                tokens = np.zeros(len(starts), np.int64)
                if len(starts):
                    one, to, of = distinct(data, starts, ends)
                    tokens = count_spans(sent.value, data, one, to)[of]
                total = np.concatenate([[0], np.cumsum(tokens)])[begins]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(np.diff(begins)), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of all documents; null, empty and blank texts have none of either, repeated rows a row each."""
    return token_counts(table(spark, sf_dir, "documents"), automaton(*vocabulary()))
