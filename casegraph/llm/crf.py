"""A linear-chain conditional random field with two tags, exact over chains of any length.

Tags are 0 (clean) and 1 (toxic).  A token's score is one number, added where its tag is 1; chains
start anew at marked tokens.  Forward and backward products run over all chains of a batch at once:
the tokens stand in rows of equal length, the 2 x 2 products of the rows are built step by step for all
rows together, carried from row to row, and spread back over the rows.
"""

from __future__ import annotations

import numpy as np


def _scan(m00: np.ndarray, m01: np.ndarray, m10: np.ndarray, m11: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors v_t = v_(t-1) M_t for all tokens, from (0.5, 0.5); M_t has the given entries."""
    total = len(m00)
    width = max(1, int(total**0.5))
    n = -(-total // width)

    def steps(values: np.ndarray) -> np.ndarray:
        """Row t holds token t of each of the n rows of tokens; 0.5 fills up."""
        out = np.full(n * width, 0.5)
        out[:total] = values
        return np.ascontiguousarray(out.reshape(n, width).T)

    a, b, c, d = steps(m00), steps(m01), steps(m10), steps(m11)
    p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in range(width):
        p00, p01 = p00 * a[t] + p01 * c[t], p00 * b[t] + p01 * d[t]
        p10, p11 = p10 * a[t] + p11 * c[t], p10 * b[t] + p11 * d[t]
        scale = 1 / (p00 + p01 + p10 + p11)
        p00 *= scale
        p01 *= scale
        p10 *= scale
        p11 *= scale
    first = np.empty(n)
    v = 0.5
    for r, (e, f, g, h) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        first[r] = v
        zero, one = (1 - v) * e + v * g, (1 - v) * f + v * h
        v = one / (zero + one)
    out = np.empty((width, n))
    v1 = first
    for t in range(width):
        v0 = 1 - v1
        zero, one = v0 * a[t] + v1 * c[t], v0 * b[t] + v1 * d[t]
        v1 = one / (zero + one)
        out[t] = v1
    ones = np.ascontiguousarray(out.T).reshape(-1)[:total]
    return 1 - ones, ones


def marginals(
    scores: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of tag 1 for each token and, if asked for, of each pair of neighbouring tags.

    ``starts`` marks the tokens a chain begins with; ``transition`` (2 x 2) and ``initial`` (2) are log
    weights.  A pair's probabilities stand at its second token; at a chain's first they are zero.
    """
    total = len(scores)
    if not total:
        return np.zeros(0), np.zeros((0, 2, 2)) if pairs else None
    weight = np.exp(np.clip(scores, -30, 30))
    move, begin = np.exp(transition), np.exp(initial)
    # Both rows of a start matrix are the initial weights, so what came before has no effect.
    m00 = np.where(starts, begin[0], move[0, 0])
    m10 = np.where(starts, begin[0], move[1, 0])
    m01 = np.where(starts, begin[1], move[0, 1]) * weight
    m11 = np.where(starts, begin[1], move[1, 1]) * weight
    a0, a1 = _scan(m00, m01, m10, m11)
    # Backward: b_t = M_(t+1) b_(t+1), read from the right with transposed matrices.
    later = [np.r_[0.5, m[:0:-1]] for m in (m00, m10, m01, m11)]
    b0, b1 = (b[::-1] for b in _scan(*later))
    zero, one = a0 * b0, a1 * b1
    tagged = one / (zero + one)
    if not pairs:
        return tagged, None
    joint = np.zeros((total, 2, 2))
    inner = ~starts
    inner[0] = False
    at = np.flatnonzero(inner)
    joint[at, 0, 0] = a0[at - 1] * m00[at] * b0[at]
    joint[at, 0, 1] = a0[at - 1] * m01[at] * b1[at]
    joint[at, 1, 0] = a1[at - 1] * m10[at] * b0[at]
    joint[at, 1, 1] = a1[at - 1] * m11[at] * b1[at]
    joint[at] /= joint[at].sum(axis=(1, 2), keepdims=True)
    return tagged, joint
