"""Double-array tries whose transitions run over whole arrays of states, and the distinct spans of a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import mix

_RNG = np.random.default_rng(20240602)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POINT = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


@dataclass
class DoubleArray:
    """State s goes by code c to base[s] + c if check[that] == s. value: of the key that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether there are such."""
        to = self.base[states] + codes
        return to, self.check[to] == states


def build(keys: list[list[int]], values: list[int], codes: int = 257) -> tuple[DoubleArray, list[tuple[int, int, int]]]:
    """The trie of keys (distinct), and its edges (parent, code, child) by depth. State 0 is the root."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, v in zip(keys, values):
        at = 0
        for c in key:
            to = children[at].get(c)
            if to is None:
                to = children[at][c] = len(children)
                children.append({})
                value.append(-1)
            at = to
        value[at] = v
    size = 2 * len(children) + 2 * codes
    used = bytearray(size + codes)
    used[0] = 1
    state = [0] * len(children)
    base, check, ends = [0] * (size + codes), [-1] * (size + codes), [-1] * (size + codes)
    edges, level = [], [0]
    hint = [1] * 18  # where to look on, by number of children: what was passed over is not tried again
    while level:
        below = []
        for node in sorted(level, key=lambda n: -len(children[n])) if len(level) < 5000 else level:
            kids = children[node]
            if not kids:
                continue
            cs = sorted(kids)
            at = hint[min(len(cs), 17)]
            while True:
                b = at - cs[0]
                if b > 0 and not used[at] and not any(used[b + c] for c in cs):
                    break
                at += 1
                if at + 2 * codes >= len(used):
                    more = len(used)
                    used += bytearray(more)
                    for x, fill in ((base, 0), (check, -1), (ends, -1)):
                        x += [fill] * more
            hint[min(len(cs), 17)] = at
            s = state[node]
            base[s] = b
            for c in cs:
                t = b + c
                used[t], check[t], state[kids[c]], ends[t] = 1, s, t, value[kids[c]]
                edges.append((s, c, t))
            below += kids.values()
        level = below
    top = max(t for *_, t in edges) + codes + 1 if edges else codes + 1
    base, check, ends = (x + [f] * max(0, top - len(x)) for x, f in ((base, 0), (check, -1), (ends, -1)))
    ends[0] = value[0]
    return DoubleArray(np.array(base[:top], np.int32), np.array(check[:top], np.int32), np.array(ends[:top], np.int32)), edges


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, letter case kept."""
    if not _powers or len(_powers[0]) <= len(data):
        n = max(4 << 20, len(data)) + 1
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)])) for p in (_POINT, pow(_POINT, -1, 2**64))]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers[0][: len(data)])])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the distinct spans, and for each span the distinct one that it equals."""
    _, one, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[one], ends[one], of


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
