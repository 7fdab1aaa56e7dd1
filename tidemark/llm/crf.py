"""Linear-chain conditional random field over sparse binary features: training by full-batch Adam, Viterbi over blocks side by side."""

from __future__ import annotations

import numpy as np


class Crf:
    """features: integer arrays (tokens, slots) of indices below `size`; index 0 means none."""

    def __init__(self, size: int, labels: int):
        self.w = np.zeros((size, labels))
        self.t = np.zeros((labels, labels))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.w[features[:, 0]]
        for k in range(1, features.shape[1]):
            out += self.w[features[:, k]]
        return out

    @staticmethod
    def padded(lengths: np.ndarray) -> np.ndarray:
        """(sequences, longest) positions of tokens; -1 beyond a sequence's end."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        grid = starts[:, None] + np.arange(lengths.max())[None, :]
        return np.where(np.arange(lengths.max())[None, :] < lengths[:, None], grid, -1)

    def fit(self, features: np.ndarray, lengths: np.ndarray, gold: np.ndarray, rounds: int = 80, rate: float = 0.2, l2: float = 1e-3) -> Crf:
        grid = self.padded(lengths)
        b, steps = grid.shape
        live = grid >= 0
        y = np.where(live, gold[grid], 0)
        labels = self.t.shape[0]
        moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.t)]
        onehot = np.eye(labels)[y] * live[:, :, None]
        both = live[:, 1:] & live[:, :-1]
        seen_t = np.zeros_like(self.t)
        np.add.at(seen_t, (y[:, :-1][both], y[:, 1:][both]), 1)
        for k in range(1, rounds + 1):
            e = self.emissions(features)[grid] * live[:, :, None]
            alpha = np.zeros((b, steps, labels))
            beta = np.zeros((b, steps, labels))
            alpha[:, 0] = e[:, 0]
            for s in range(1, steps):
                x = alpha[:, s - 1, :, None] + self.t[None]
                m = x.max(1)
                new = m + np.log(np.exp(x - m[:, None]).sum(1)) + e[:, s]
                alpha[:, s] = np.where(live[:, s, None], new, alpha[:, s - 1])
            for s in range(steps - 2, -1, -1):
                x = self.t[None] + (e[:, s + 1] + beta[:, s + 1])[:, None, :]
                m = x.max(2)
                beta[:, s] = np.where(live[:, s + 1, None], m + np.log(np.exp(x - m[:, :, None]).sum(2)), 0)
            last = alpha[:, -1]
            z = last.max(1) + np.log(np.exp(last - last.max(1, keepdims=True)).sum(1))
            p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
            pair = np.exp(alpha[:, :-1, :, None] + self.t[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            wrong = (onehot - p)[live]
            order = grid[live]
            g = np.zeros_like(self.w)
            for slot in range(features.shape[1]):
                np.add.at(g, features[order, slot], wrong)
            g[0] = 0
            for i, (param, grad) in enumerate(((self.w, g), (self.t, seen_t - pair.sum((0, 1))))):
                grad = grad / b - l2 * param
                moment[i][0] = 0.9 * moment[i][0] + 0.1 * grad
                moment[i][1] = 0.999 * moment[i][1] + 0.001 * grad**2
                param += rate * (moment[i][0] / (1 - 0.9**k)) / (np.sqrt(moment[i][1] / (1 - 0.999**k)) + 1e-8)
        return self

    def decode(self, features: np.ndarray, lengths: np.ndarray, cells: int = 1 << 18) -> np.ndarray:
        """Best labels of all sequences.

        The sequences are laid end to end, with no transition scores between them, and the chain is cut into blocks of about the root
        of its length. All blocks advance together: first each one's best scores from any label before it to any at its end, which
        give the scores before every block; then the usual Viterbi step in all blocks, and back.
        """
        n, labels = len(features), self.t.shape[0]
        if not n:
            return np.zeros(0, np.int8)
        size = max(1, int(np.sqrt(n)))
        blocks = -(-n // size)
        e = np.zeros((blocks * size, labels))
        for a in range(0, n, cells):
            e[a : min(a + cells, n)] = self.emissions(features[a : a + cells])
        first = np.ones(blocks * size, bool)
        first[:n] = False
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        # step by step, all blocks at a time; blocks lie along the last axis
        e = np.ascontiguousarray(e.reshape(blocks, size, labels).transpose(1, 2, 0))
        inside = ~first.reshape(blocks, size).T

        def moves(k: int) -> np.ndarray:
            return self.t[:, :, None] * inside[k]

        across = moves(0) + e[0]
        for k in range(1, size):
            t = moves(k)
            best = across[:, :1] + t[:1]
            for via in range(1, labels):
                np.maximum(best, across[:, via : via + 1] + t[via : via + 1], out=best)
            across = best + e[k]
        score = np.zeros((labels, blocks))
        for b in range(1, blocks):
            x = (score[:, b - 1, None] + across[:, :, b - 1]).max(0)
            score[:, b] = x - x.max()
        back = np.zeros((size, labels, blocks), np.int8)
        for k in range(size):
            x = score[:, None] + moves(k)
            best = x[0]
            for via in range(1, labels):
                better = x[via] > best
                back[k][better] = via
                best = np.maximum(best, x[via])
            score = best + e[k]
        # each label at a block's end leads back to one before the block
        origin = np.repeat(np.arange(labels)[:, None], blocks, 1)
        for k in range(size - 1, -1, -1):
            origin = np.take_along_axis(back[k], origin, 0).astype(np.int64)
        label = np.zeros(blocks, np.int64)
        label[-1] = score[:, -1].argmax()
        for b in range(blocks - 1, 0, -1):
            label[b - 1] = origin[label[b], b]
        out = np.zeros((size, blocks), np.int8)
        for k in range(size - 1, -1, -1):
            out[k] = label
            label = back[k][label, np.arange(blocks)]
        return out.T.reshape(-1)[:n]
