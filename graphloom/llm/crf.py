"""A small linear-chain conditional random field over sequences of feature sets."""

from __future__ import annotations

import numpy as np


class Crf:
    """Label weights per feature and label-to-label weights; decoded by Viterbi."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.emit: dict[str, np.ndarray] = {}
        n = len(labels)
        self.move, self.first = np.zeros((n, n)), np.zeros(n)

    def _scores(self, sequence: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(sequence), len(self.labels)))
        for t, names in enumerate(sequence):
            for f in names:
                w = self.emit.get(f)
                if w is not None:
                    out[t] += w
        return out

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-3, seed: int = 5) -> Crf:
        """Stochastic gradient steps on the log-likelihood, with per-weight step sizes."""
        n = len(self.labels)
        seen = {f: np.full(n, 0.1) for page, _ in pages for names in page for f in names}
        self.emit = {f: np.zeros(n) for f in seen}
        seen_move, seen_first = np.full((n, n), 0.1), np.full(n, 0.1)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                page, gold = pages[k]
                if not page:
                    continue
                node, pair = self._marginals(self._scores(page))
                for t, names in enumerate(page):
                    g = -node[t]
                    g[gold[t]] += 1
                    for f in names:
                        seen[f] += g * g
                        self.emit[f] += rate * (g - decay * self.emit[f]) / np.sqrt(seen[f])
                g = -node[0]
                g[gold[0]] += 1
                seen_first += g * g
                self.first += rate * g / np.sqrt(seen_first)
                g = -pair
                for a, b in zip(gold[:-1], gold[1:]):
                    g[a, b] += 1
                seen_move += g * g
                self.move += rate * (g - decay * self.move) / np.sqrt(seen_move)
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = e.shape
        ahead, behind = np.zeros((n, k)), np.zeros((n, k))
        ahead[0] = self.first + e[0]
        for t in range(1, n):
            x = ahead[t - 1][:, None] + self.move
            top = x.max(0)
            ahead[t] = top + np.log(np.exp(x - top).sum(0)) + e[t]
        for t in range(n - 2, -1, -1):
            x = self.move + (e[t + 1] + behind[t + 1])[None, :]
            top = x.max(1)
            behind[t] = top + np.log(np.exp(x - top[:, None]).sum(1))
        top = ahead[-1].max()
        z = top + np.log(np.exp(ahead[-1] - top).sum())
        node = np.exp(ahead + behind - z)
        pair = np.zeros((k, k))
        for t in range(n - 1):
            pair += np.exp(ahead[t][:, None] + self.move + (e[t + 1] + behind[t + 1])[None, :] - z)
        return node, pair

    def decode(self, sequence: list[list[str]]) -> list[str]:
        """The best label sequence."""
        if not sequence:
            return []
        e = self._scores(sequence)
        best, back = self.first + e[0], []
        for t in range(1, len(e)):
            x = best[:, None] + self.move
            back.append(x.argmax(0))
            best = x.max(0) + e[t]
        at = int(best.argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        return [self.labels[i] for i in reversed(path)]
