"""Noise on numpy arrays, many rows at a time: what noise's Arrow functions do."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import md5

import numpy as np

ROWS = 1024  # whose draws are held at once


def draws(labels: list[bytes], n: int) -> np.ndarray:
    """The draws of hashing.draw(label, i) for i from 1 to n, a row a label."""
    ends = [b":%d" % i for i in range(1, n + 1)]
    found = b"".join([md5(label + e, usedforsecurity=False).digest() for label in labels for e in ends])
    return (np.frombuffer(found, ">u8")[::2] >> np.uint64(4)).astype(np.int64).reshape(len(labels), n)


def compositions(items: int, pieces: int, labels: list[bytes]) -> np.ndarray:
    """Ends of the segments of drawn compositions, a row a label: the pieces - 1 places of the least draws are cut."""
    cuts = min(max(pieces - 1, 0), max(items - 1, 0))
    out = np.empty((len(labels), cuts + 1), np.int64)
    out[:, cuts] = items
    if cuts:
        for at in range(0, len(labels), ROWS):
            least = np.argsort(draws(labels[at : at + ROWS], items - 1), axis=1, kind="stable")[:, :cuts]
            out[at : at + ROWS, :cuts] = np.sort(least, axis=1) + 1
    return out


def alike(*keys: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(keys, rows) of the rows with the same keys."""
    found = defaultdict(list)
    for i, k in enumerate(zip(*[k.tolist() for k in keys], strict=True)):
        found[k].append(i)
    for k, rows in found.items():
        yield k, np.array(rows)


def turns(length: int, noise: int, spans: int, labels: list[bytes]) -> np.ndarray | None:
    """Lengths of the kept and noise spans in turn, a row a label; none if there are fewer kept spans than noise ones."""
    ends = compositions(noise, spans, [x + b":noise" for x in labels])
    kept = compositions(length - noise, spans, [x + b":keep" for x in labels])
    n = ends.shape[1]
    if kept.shape[1] < n:
        return None
    out = np.empty((len(labels), 2 * n), np.int64)
    out[:, ::2], out[:, 1::2] = np.diff(kept[:, :n], axis=1, prepend=0), np.diff(ends, axis=1, prepend=0)
    return np.maximum(out, 0)


def masks(length: np.ndarray, noise: np.ndarray, spans: np.ndarray, labels: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, mask, rows that have none): kept and noise spans take turns, a kept one first."""
    sizes, found, none = np.zeros(len(length), np.int64), [], np.zeros(len(length), bool)
    for (n, z, s), rows in alike(length, noise, spans):
        lengths = turns(n, z, s, [labels[i] for i in rows])
        if lengths is None:
            none[rows] = True
            continue
        sizes[rows] = lengths.sum(axis=1)
        found.append((rows, np.repeat(np.tile([False, True], lengths.size // 2), lengths.ravel())))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], bool)
    for rows, mask in found:
        each = sizes[rows]
        out[np.repeat(offsets[rows] - (np.cumsum(each) - each), each) + np.arange(len(mask))] = mask
    return offsets, out, none


def replaced(offsets: np.ndarray, tokens: np.ndarray, mask: np.ndarray, first_id: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, tokens) with each run of masked ones in a row replaced by one sentinel."""
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    before[offsets[:-1][offsets[:-1] < len(mask)]] = False
    opens = mask & ~before
    count = np.concatenate([[0], np.cumsum(opens)])
    rank = count[:-1] - np.repeat(count[offsets[:-1]], np.diff(offsets))
    stays = ~mask | opens
    out = np.where(opens, first_id + step * rank, tokens)[stays].astype(np.int32)
    return np.concatenate([[0], np.cumsum(stays)])[offsets], out


def ended(offsets: np.ndarray, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists with end after each."""
    return offsets + np.arange(len(offsets)), np.insert(values, offsets[1:], end)
