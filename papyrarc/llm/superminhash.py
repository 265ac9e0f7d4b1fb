"""SuperMinHash signatures of many sets at once."""

from __future__ import annotations

import numpy as np

from .wordhash import U64, mix


def signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) SuperMinHash values of the sets of 64-bit elements (sorted by row, distinct in a row).

    Every element draws, from its own generator, a random permutation of the m slots step by step and
    in step j offers j + U(0,1) to its j-th slot; a slot keeps the least offer. An element thus gives
    its ranks to different slots, which correlates them and lowers the variance below plain MinHash.
    Steps run over all sets together. A set stops early, after step j, once all its slots hold less
    than j + 1, as later offers are larger. A set without elements keeps infinity.
    """
    out = np.full(n_rows * m, np.inf)
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            x = mix(elements + U64((2 * j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = (x >> U64(11)).astype(np.float64) * 2.0**-53 + j
        with np.errstate(over="ignore"):
            low = mix(x) >> U64(32)
        pick = j + ((low * U64(m - j)) >> U64(32)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            at = np.arange(len(perm))
            slot = perm[at, pick].astype(np.int64)
            perm[at, pick] = perm[:, j]
        np.minimum.at(out, rows * m + slot, value)
        worst = out.reshape(n_rows, m).max(axis=1)
        keep = worst[rows] >= j + 1
        if keep.all() and perm is not None:
            continue
        elements, rows = elements[keep], rows[keep]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            at, pick = np.arange(len(elements)), pick[keep]
            perm[at, pick] = perm[:, 0]
        else:
            perm = perm[keep]
    return out.reshape(n_rows, m)


def bands(values: np.ndarray, n_bands: int) -> np.ndarray:
    """(rows, n_bands) 64-bit keys of equally wide bands of the signatures."""
    bits = np.ascontiguousarray(values).view(np.uint64)
    width = bits.shape[1] // n_bands
    keys = np.zeros((len(bits), n_bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            keys = mix(keys * U64(0x9FB21C651E98DF25) + bits[:, i::width][:, :n_bands])
    return keys.view(np.int64)
