"""Sorted runs of strings, front-coded for the exchange, and loser trees that merge them.

A run is sorted; each string is stored as the length of the prefix it shares with the one before and the
bytes after that. The merge never looks at a prefix twice: contestants in the tree carry the length they
share with the last string put out, and characters are compared only beyond an equal length.
"""

from __future__ import annotations

import numpy as np


def sort_rows(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix, as strings of one length."""

    def word(column: int, rows: np.ndarray | slice) -> np.ndarray:
        some = keys[rows, column : column + 8]
        pad = 8 - some.shape[1]
        return np.ascontiguousarray(np.pad(some, ((0, 0), (0, pad))) if pad else some).view(">u8")[:, 0].astype(np.uint64)

    first = word(0, slice(None))
    order = np.argsort(first, kind="stable")
    if keys.shape[1] <= 8 or len(order) < 2:
        return order
    first = first[order]
    same = np.flatnonzero(first[1:] == first[:-1])
    if not len(same):
        return order
    tied = np.zeros(len(order), bool)  # only rows that tie in the first word need the others
    tied[same] = tied[same + 1] = True
    at = np.flatnonzero(tied)
    rows = order[at]
    words = [word(column, rows) for column in range(8, keys.shape[1], 8)]
    order[at] = rows[np.lexsort([*words[::-1], first[at]])]
    return order


def places(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the sorted rows come before each cut; equal ones come after."""
    whole = f"S{keys.shape[1]}"
    return np.searchsorted(np.ascontiguousarray(keys).view(whole)[:, 0], np.ascontiguousarray(cuts).view(whole)[:, 0])


def shared(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(keys), np.uint8)
    for at in range(1, len(keys), 100_000):
        differ = keys[at : at + 100_000] != keys[at - 1 : at - 1 + len(keys[at : at + 100_000])]
        first = differ.argmax(1)
        out[at : at + 100_000] = np.where(differ.any(1), first, keys.shape[1])
    return out


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """(shared lengths, remaining bytes) of sorted rows."""
    lengths = shared(keys)
    tails = [keys[at : at + 100_000][np.arange(keys.shape[1]) >= lengths[at : at + 100_000, None]].tobytes() for at in range(0, len(keys), 100_000)]
    return lengths.tobytes(), b"".join(tails)


def first_difference(a: bytes, b: bytes, at: int, width: int) -> int:
    """The first place from ``at`` on where two strings of one width differ, or the width."""
    while at < width:
        x = int.from_bytes(a[at : at + 16]) ^ int.from_bytes(b[at : at + 16])
        if x:
            size = min(16, width - at)
            return at + (8 * size - x.bit_length()) // 8
        at += 16
    return width


def merge(runs: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge front-coded runs: (run of each string put out, length it shares with the one before)."""
    count = len(runs)
    lengths = [r[0] for r in runs]
    tails = [r[1] for r in runs]
    place, offset = [0] * count, [0] * count
    now: list[bytes] = [b""] * count
    share = [0] * count  # with the last string put out; -1 once a run has ended

    def step(run: int) -> None:
        k = place[run]
        if k == len(lengths[run]):
            share[run] = -1
            return
        h = lengths[run][k]
        at = offset[run]
        end = at + width - h
        now[run] = now[run][:h] + tails[run][at:end]
        offset[run], place[run], share[run] = end, k + 1, h

    for run in range(count):
        step(run)
        if share[run] >= 0:
            share[run] = 0
    # loser[n]: the run that lost at inner node n; leaves are nodes count..2*count-1
    loser = [0] * max(1, count)
    best = [0] * (2 * count)
    for run in range(count):
        best[count + run] = run
    for node in range(count - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        ha, hb = share[a], share[b]
        if ha == hb and ha >= 0:
            h = first_difference(now[a], now[b], ha, width)
            if h < width and now[b][h] < now[a][h]:
                a, b = b, a
            share[b] = h
        elif hb > ha:
            a, b = b, a
        best[node], loser[node] = a, b
    winner = best[1] if count > 1 else 0
    total = sum(map(len, lengths))
    out_run, out_share = [0] * total, [0] * total
    for k in range(total):
        out_run[k], out_share[k] = winner, share[winner]
        # the next string of the winner's run
        p = place[winner]
        if p == len(lengths[winner]):
            share[winner] = h = -1
        else:
            h = lengths[winner][p]
            at = offset[winner]
            end = at + width - h
            now[winner] = now[winner][:h] + tails[winner][at:end]
            offset[winner], place[winner], share[winner] = end, p + 1, h
        node = (count + winner) >> 1
        while node:
            other = loser[node]
            g = share[other]
            if g > h:
                loser[node], winner, h = winner, other, g
            elif g == h and h >= 0:
                a, b = now[winner], now[other]
                d = first_difference(a, b, h, width)
                if d < width and b[d] < a[d]:
                    loser[node] = winner
                    share[winner] = d
                    winner = other
                else:
                    share[other] = d
            node >>= 1
    return np.array(out_run, np.int32), np.array(out_share, np.int16)
