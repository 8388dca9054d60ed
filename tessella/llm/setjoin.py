"""An exact Jaccard self-join of sets on one node that skips by the relations of sets.

Index level: the list of a token is cut into blocks by the token's position in the sets, and in a block the sets are
ordered by size. For a probing set, each block admits one run of sizes (the position filter), found by binary search;
blocks whose run is empty are skipped.

Answer level: a set that is probed becomes a leader; its answers are its overlaps with all sets that it, or a set
within reuse() of it, might match. A set that differs from the leader in few tokens isn't probed: its overlaps are the
leader's, less those of the tokens it lacks, plus those of the tokens it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A set follows a leader from which it differs in this share of the leader's tokens at most, and in less at low thresholds.
REUSE = 0.2
#: Positions of a block; pairs that are held before they are given.
SPAN, PORTION = 16, 1 << 20


def least(size: np.ndarray | int, threshold: float):
    """The least overlap, or size, that a set of this size asks of a partner."""
    return np.ceil(threshold * np.asarray(size, np.float64) - 1e-9).astype(np.int64)


def reuse(threshold: float) -> float:
    """The share of its leader's tokens in which a follower may differ, so that all its partners share a token with the leader.

    A partner shares threshold times the follower's size with the follower at least. Of these the follower adds a tokens
    to the leader's; with b that it lacks, a < threshold * (size + a - b) holds if a + b is below the leader's size times
    threshold / max(threshold, 1 - threshold).
    """
    return min(REUSE, 0.9 * threshold / max(threshold, 1 - threshold))


def _reach(share: np.ndarray | float, threshold: float):
    return share >= threshold - 1e-12


def jaccard_join(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of places in sets and their Jaccard similarity, if it is the threshold at least. Sets are distinct tokens."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(none, *jaccard_portions(sets, threshold), strict=True))


def jaccard_portions(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in portions: pairs may be as many as the square of the sets."""
    k = len(sets)
    size = np.fromiter((len(s) for s in sets), np.int64, k)
    if k < 2:
        return
    order = np.argsort(size, kind="stable")
    rank = size[order]
    _, token, count = np.unique(np.concatenate([sets[s] for s in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), rank)
    # Tokens by frequency, rare ones first. Those of one set only come first and never match.
    by_count = np.argsort(count, kind="stable")
    place = np.empty(len(count), np.int64)
    place[by_count] = np.arange(len(count))
    single = int((count == 1).sum())
    token = place[token]
    at = np.lexsort((token, owner))
    token, owner = token[at], owner[at]
    first = np.concatenate([[0], np.cumsum(rank)])
    position = np.arange(len(token)) - first[owner]
    ok = token >= single
    token, owner, position = token[ok] - single, owner[ok], position[ok]
    first = np.searchsorted(owner, np.arange(k + 1))
    n_tokens = len(count) - single
    if not n_tokens:
        return

    # Lists by token, position block, set: sets are numbered by size.
    block = position // SPAN
    index = np.lexsort((owner, block, token))
    list_owner, list_block, list_token = owner[index], block[index], token[index]
    new = np.ones(len(index), np.bool_)
    new[1:] = (np.diff(list_token) != 0) | (np.diff(list_block) != 0)
    begin = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    key = number * k + list_owner
    block_of = np.searchsorted(list_token[begin], np.arange(n_tokens + 1))
    low_position = list_block[begin] * SPAN
    list_first = np.searchsorted(list_token, np.arange(n_tokens + 1))

    c, follows = threshold / (1 + threshold), reuse(threshold)
    leader = np.full(k, -1)
    answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    followers: dict[int, int] = {}
    flag = np.zeros(n_tokens, np.bool_)
    spot = np.full(k, -1)
    out_i, out_j, out_s, held = [], [], [], 0

    def spread(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.repeat(starts - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())

    def probe(x: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of a leader and of what may follow it, and its overlaps with them."""
        own, pos, slack = token[first[x] : first[x + 1]], position[first[x] : first[x + 1]], int(follows * rank[x])
        many = block_of[own + 1] - block_of[own]
        b, i = spread(block_of[own], many), np.repeat(pos, many)
        lo = (c * rank[x] + low_position[b] - slack) / (1 - c)
        hi = (rank[x] - i + slack) / c - rank[x]
        lo, hi = np.searchsorted(rank, lo - 1e-6), np.searchsorted(rank, hi + 1e-6, side="right")
        ok = lo < hi
        b, lo, hi = b[ok], lo[ok], hi[ok]
        s, e = np.searchsorted(key, b * k + lo), np.searchsorted(key, b * k + hi)
        found = np.unique(list_owner[spread(s, e - s)])
        flag[own] = True
        length = first[found + 1] - first[found]
        shared = np.add.reduceat(flag[token[spread(first[found], length)]].astype(np.int64), np.cumsum(length) - length) if len(found) else length
        flag[own] = False
        return found, shared

    for x in range(k):
        if leader[x] < 0:
            found, shared = probe(x)
            gap = rank[found] + rank[x] - 2 * shared
            follow = found[(gap <= int(follows * rank[x])) & (leader[found] < 0) & (found > x)]
            leader[follow] = x
            leader[x] = x
            if len(follow):
                answers[x], followers[x] = (found, shared), len(follow)
        else:
            lead = int(leader[x])
            found, base = answers[lead]
            mine, its = token[first[x] : first[x + 1]], token[first[lead] : first[lead + 1]]
            spot[found] = np.arange(len(found))
            shared = base.copy()
            for tokens, sign in ((np.setdiff1d(mine, its, assume_unique=True), 1), (np.setdiff1d(its, mine, assume_unique=True), -1)):
                near = spot[list_owner[spread(list_first[tokens], list_first[tokens + 1] - list_first[tokens])]]
                shared += sign * np.bincount(near[near >= 0], minlength=len(found))
            spot[found] = -1
            followers[lead] -= 1
            if not followers[lead]:
                del answers[lead]
        before = found < x
        f, s = found[before], shared[before]
        share = s / np.maximum(1, rank[f] + rank[x] - s)
        good = _reach(share, threshold)
        out_i.append(f[good])
        out_j.append(np.full(int(good.sum()), x))
        out_s.append(share[good])
        held += len(out_i[-1])
        if held >= PORTION or x == k - 1:
            i, j, s = order[np.concatenate(out_i)], order[np.concatenate(out_j)], np.concatenate(out_s)
            yield np.minimum(i, j), np.maximum(i, j), s
            out_i, out_j, out_s, held = [], [], [], 0


def few_join(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a handful of sets, each pair by itself."""
    out = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if min(len(sets[i]), len(sets[j])) >= least(max(len(sets[i]), len(sets[j])), threshold):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                share = both / max(1, len(sets[i]) + len(sets[j]) - both)
                if _reach(share, threshold):
                    out.append((i, j, share))
    a = np.array(out, np.float64).reshape(-1, 3)
    return a[:, 0].astype(np.int64), a[:, 1].astype(np.int64), a[:, 2]
