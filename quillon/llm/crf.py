"""A small linear-chain conditional random field on hashed features, in numpy.

Every token has a fixed number K of feature slots. Training maximises the regularised log-likelihood with AdaGrad, the whole
training set at once (all sequences' tokens of one place together); decoding is Viterbi. Training is deterministic.
"""

import zlib

import numpy as np

DIM = 1 << 15


def slot(feature: str) -> int:
    """Hash slot of a feature; slot 0 is the padding."""
    return zlib.crc32(feature.encode()) % (DIM - 1) + 1


class Chain:
    """Weights of the field: emissions (DIM, labels), transitions (labels, labels) and starts."""

    def __init__(self, labels: int, emit=None, move=None, start=None) -> None:
        self.labels = labels
        self.emit = np.zeros((DIM, labels)) if emit is None else emit
        self.move = np.zeros((labels, labels)) if move is None else move
        self.start = np.zeros(labels) if start is None else start

    def fit(self, sequences: list[np.ndarray], targets: list[np.ndarray], rounds: int = 70, rate: float = 0.35, ridge: float = 1e-3) -> "Chain":
        n, L, k = len(sequences), self.labels, sequences[0].shape[1]
        order = sorted(range(n), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        active = [int((lengths > t).sum()) for t in range(lengths[0])]  # long sequences first: those that have a token t are a prefix
        at = np.concatenate([[0], np.cumsum(active)])
        blocks = [slice(at[t], at[t + 1]) for t in range(len(active))]
        real = np.concatenate([np.stack([sequences[i][t] for i in order[:m]]) for t, m in enumerate(active)])  # tokens by their place in the sequence
        y = np.concatenate([np.array([targets[i][t] for i in order[:m]]) for t, m in enumerate(active)])
        flat = real.reshape(-1)
        gold = np.eye(L)[y].T
        ends = at[lengths - 1] + np.arange(n)
        owner = np.concatenate([np.arange(m) for m in active])
        after = np.arange(active[0], len(y))  # every token but the first of its sequence, and the one before it
        before = np.concatenate([np.arange(m) + at[t] for t, m in enumerate(active[1:])]) if len(after) else after
        gold_move = gold[:, before] @ gold[:, after].T
        sums = [np.zeros_like(self.emit), np.zeros_like(self.move), np.zeros_like(self.start)]
        for _ in range(rounds):
            score = np.ascontiguousarray(self.emit[real].sum(axis=1).T)
            alpha, beta = score.copy(), np.zeros_like(score)
            alpha[:, blocks[0]] += self.start[:, None]
            for prev, block, m in zip(blocks, blocks[1:], active[1:]):
                alpha[:, block] += _lse(alpha[:, prev][:, None, :m] + self.move[:, :, None])
            for prev, block, m in reversed(list(zip(blocks, blocks[1:], active[1:]))):
                beta[:, prev][:, :m] = _lse((score[:, block] + beta[:, block])[:, None] + self.move.T[:, :, None])
            total = _lse(alpha[:, ends])[owner]
            diff = gold - np.exp(np.clip(alpha + beta - total, -50, 0))
            g_emit = np.stack([np.bincount(flat, weights=np.repeat(d, k), minlength=DIM) for d in diff], axis=1)
            pair = alpha[:, None, before] + self.move[:, :, None] + (score + beta)[None, :, after] - total[after]
            g_move = gold_move - np.exp(np.clip(pair, -50, 0)).sum(axis=2)
            g_start = diff[:, blocks[0]].sum(axis=1)
            g_emit[0] = 0
            for w, g, s in zip((self.emit, self.move, self.start), (g_emit, g_move, g_start), sums):
                g = g - ridge * n * w
                s += g * g
                w += rate * g / (np.sqrt(s) + 1e-6)
        return self

    def decode(self, x: np.ndarray) -> list[int]:
        """Best labels of one sequence (tokens, K)."""
        return self.best(self.emit[x].sum(axis=1))

    def best(self, score: np.ndarray) -> list[int]:
        """Best labels of one sequence by its tokens' scores (tokens, labels)."""
        best = self.start + score[0]
        back = []
        for row in score[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _lse(a: np.ndarray) -> np.ndarray:
    """log-sum-exp over axis 0."""
    top = a.max(axis=0)
    return top + np.log(np.exp(a - top).sum(axis=0))
