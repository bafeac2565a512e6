"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces come from a public model file (MODEL, a parameter). Its scores are merge ranks, which a Zipf law turns into log
scores: -log(rank + 2). A text gets a blank in front, blanks stand for the whitespace marker, and a character of which
no piece exists falls back to its UTF-8 bytes at the lowest score less PENALTY. No piece has a blank after another
character, so the best segmentation of a text is that of its units (a run of blanks and what follows up to the next
blank), and each distinct unit of a batch is segmented once. Scores are added as multiples of
2**-20, so ties are exact; they go to the longer last piece.

Defined results: null and empty texts have no pieces; a literal marker character reads back as a blank; whole texts of
any length are encoded, a long unit like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_views
from .double_array import DoubleArray, build, distinct, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PENALTY = 10.0  # a fixed value of the format
UNIT = 1 << 20
MARK = "▁"


@dataclass
class Pieces:
    """The trie, log scores by id, bytes of all pieces with where each begins, ids of the byte pieces, the lowest score."""

    trie: DoubleArray
    scores: np.ndarray
    content: np.ndarray
    begins: np.ndarray
    byte_ids: np.ndarray
    lowest: float

    def __post_init__(self) -> None:
        self.units = np.round(self.scores.astype(float) * UNIT).astype(np.int64)


def zipf_scores(model: str = MODEL) -> tuple[list[str], list[int], np.ndarray, list[int]]:
    """Pieces of a model file, kinds (1 normal, 6 byte, else control), log scores, and ids of bytes 0 to 255."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    names = [p.id_to_piece(i) for i in range(n)]
    kinds = [6 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 1 for i in range(n)]
    rank = np.array([-p.get_score(i) if k == 1 else 0.0 for i, k in enumerate(kinds)])
    scores = np.where(np.array(kinds) == 1, -np.log(rank + 2), 0.0).astype(np.float32)
    at = {x: i for i, x in enumerate(names)}
    return names, kinds, scores, [at[f"<0x{b:02X}>"] for b in range(256)]


def load(model: str = MODEL) -> Pieces:
    names, kinds, scores, byte_ids = zipf_scores(model)
    normal = [i for i, k in enumerate(kinds) if k == 1]
    texts = [bytes([int(x[3:5], 16)]) if k == 6 else x.replace(MARK, " ").encode() if k == 1 else b"" for x, k in zip(names, kinds)]
    if any(b" " in texts[i].lstrip(b" ") for i in normal):
        raise ValueError("a piece has a blank after another character")
    trie, _ = build([list(texts[i]) for i in normal], normal)
    return Pieces(trie, scores, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]), np.array(byte_ids), float(scores[normal].min()))


def segment(p: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of spans (each a unit), one span after the other, and how many each has."""
    sizes = ends - starts
    where = ranges(starts, sizes)
    text = data[where]
    unit = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    offset = np.arange(len(text)) + unit  # lattice nodes: one more than bytes in each unit
    heads = (text & 0xC0) != 0x80
    width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
    # all pieces that begin anywhere, found side by side
    at, state, deep = np.flatnonzero(heads), np.zeros(int(heads.sum()), np.int32), 0
    found_at, found_size, found_id = [], [], []
    single = np.zeros(len(text), bool)
    while len(at):
        to, ok = p.trie.step(state, text[at + deep])
        at, state = at[ok], to[ok]
        deep += 1
        ids = p.trie.value[state]
        hit = ids >= 0
        found_at.append(at[hit])
        found_size.append(np.full(int(hit.sum()), deep))
        found_id.append(ids[hit])
        single[at[hit & (width[at] == deep)]] = True
        on = left[at] > deep
        at, state = at[on], state[on]
    bare = np.flatnonzero(heads & ~single)
    found_at.append(bare)
    found_size.append(np.minimum(width[bare], left[bare]))
    found_id.append(np.full(len(bare), -1))
    at, size, piece = np.concatenate(found_at), np.concatenate(found_size), np.concatenate(found_id)
    gain = np.where(piece >= 0, p.units[piece], round((p.lowest - PENALTY) * UNIT))
    order = np.argsort(place[at], kind="stable")
    at, size, piece, gain = at[order], size[order], piece[order], gain[order]
    source, target = offset[at], offset[at] + size
    best = np.full(len(text) + len(starts), np.iinfo(np.int64).min // 2)
    best[np.cumsum(sizes + 1) - sizes - 1] = 0
    back, chosen = np.zeros(len(best), np.int64), np.full(len(best), -1)
    stops = np.searchsorted(place[at], np.arange(1, int(sizes.max(initial=0)) + 1))
    a = 0
    for b in stops:  # all units advance by one place at once
        s, t = source[a:b], target[a:b]
        score = best[s] + gain[a:b]
        better = score > best[t]
        t = t[better]
        best[t], back[t], chosen[t] = score[better], s[better], piece[a:b][better]
        a = b
    # walk back from all ends at once
    first = np.cumsum(sizes + 1) - sizes - 1
    node, lane = first + sizes, np.arange(len(starts))
    steps = []
    going = sizes > 0
    node, lane = node[going], lane[going]
    while len(node):
        steps.append((lane, chosen[node], back[node], node - back[node]))
        node = back[node]
        on = node > first[lane]
        node, lane = node[on], lane[on]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    lanes, ids, froms, spans = (np.concatenate(x) for x in zip(*steps))
    order = np.lexsort((froms, lanes))
    lanes, ids, froms, spans = lanes[order], ids[order], froms[order], spans[order]
    parts = np.where(ids >= 0, 1, spans)
    out = np.repeat(ids, parts)
    raw = text[ranges(froms - lanes, np.where(ids >= 0, 0, spans))]
    out[out < 0] = p.byte_ids[raw]
    return out, np.bincount(lanes, parts, minlength=len(starts)).astype(np.int64)


def with_blanks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of non-empty texts with a blank in front, markers as blanks; and where each begins."""
    raw = [(" " + t.replace(MARK, " ")).encode("utf-8", "replace") if t else b"" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def encode(p: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of all texts, and where each text's begin."""
    data, offsets = with_blanks(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = data == 32
    begin = blank & ~np.concatenate([[False], blank[:-1]])
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    one, to, of = distinct(data, starts, ends)
    ids, counts = segment(p, data, one, to)
    begins = np.cumsum(counts) - counts
    out = ids[ranges(begins[of], counts[of])]
    total = np.concatenate([[0], np.cumsum(counts[of])])
    return out, total[np.searchsorted(starts, offsets)]


def decode(p: Pieces, ids: np.ndarray) -> bytes:
    """UTF-8 of a text's pieces, without the blank in front."""
    sizes = p.begins[ids + 1] - p.begins[ids]
    return p.content[ranges(p.begins[ids], sizes)].tobytes()[1:]


def encoded(docs: DataFrame, pieces: Pieces, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_bytes_pieces (by fallback), ids_sha256 (of the ids as 32-bit little-endian numbers),
    round_trip (the pieces decode to the text) and, if asked for, the ids."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        by_byte = np.zeros(len(p.scores), bool)
        by_byte[p.byte_ids] = True
        for b in batches:
            for first, end, _, _ in text_views(b.column(1)):
                part = b.slice(first, end - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found, begins = encode(p, texts)
                each = [found[x:y] for x, y in zip(begins[:-1], begins[1:])]
                columns = [part.column(0), pa.array(np.diff(begins)), pa.array([int(by_byte[e].sum()) for e in each], pa.int64()), pa.array([hashlib.sha256(e.astype("<i4").tobytes()).hexdigest() for e in each], pa.string()), pa.array([decode(p, e) == t.replace(MARK, " ").encode("utf-8", "replace") for e, t in zip(each, texts)])]
                names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(found, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *["ids"] * ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their decoding; null and empty texts have none, repeated rows give a row each."""
    return encoded(table(spark, sf_dir, "documents"), load(), ids=False)
