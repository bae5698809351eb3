"""Additive quantisation of vectors: codebooks, beam-search encoding, lookup-table scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Codebooks after the first, codewords of each, width of the beam.
STAGES, WORDS, BEAM = 6, 256, 4
#: Vectors a cell and a shard of neighbouring cells should hold; most codewords of cells, beyond which cells are divided.
CELL, SHARD, MOST_CELLS = 400, 3000, 1024
#: Vectors encoded at once, so that the errors of a beam stay in the cache.
AT_ONCE = 256


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances without the term that all words of a row share."""
    return (words**2).sum(1)[None] - 2 * (x @ words.T)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, words).argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(count) - count, len(x) - 1), axis=0)
        full = count > 0
        words[full] = sums[full] / count[full, None]
        words[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return words


@dataclass
class Quantiser:
    """``coarse`` gives each vector its cell; ``books`` are full-dimensional codebooks for what remains.

    ``shards`` puts neighbouring cells together. Where the cells alone would make shards too large, each is divided by
    what remains, by its nearest one of ``middles``, and a cell is such a part and a shard of its own. A query looks into
    the shards of its ``probes`` nearest cells.
    """

    kind: str
    coarse: np.ndarray
    books: np.ndarray  # stages x words x dim
    shards: np.ndarray  # of each coarse codeword
    middles: np.ndarray  # parts x dim, one part if cells are not divided
    total: int
    probes: int = 1

    def shard_of(self, cells: np.ndarray) -> np.ndarray:
        return self.shards[cells] if len(self.middles) == 1 else cells

    def cells(self, x: np.ndarray, probes: int, asks: bool = False) -> np.ndarray:
        """The ``probes`` nearest cells of each vector, the nearest first. Of vectors that ask under Dot: the nearest
        cell, where their copies are, and the ``probes`` cells whose middles have the highest products with them."""
        if not asks or self.kind != "Dot":
            return self._best_cells(x, probes, False)
        return np.concatenate((self._best_cells(x, 1, False), self._best_cells(x, probes, True)), 1)

    def _best_cells(self, x: np.ndarray, probes: int, by_product: bool) -> np.ndarray:
        near = -(x @ self.coarse.T) if by_product else squared(x, self.coarse)
        parts = len(self.middles)
        if parts == 1:
            return _least(near, min(probes, near.shape[1]))
        first = _least(near, min(max(16, 2 * probes), near.shape[1]))
        far = np.empty((len(x), first.shape[1] * parts), np.float32)
        for j in range(first.shape[1]):
            rest = x - self.coarse[first[:, j]]
            if by_product:
                found = np.take_along_axis(near, first[:, j : j + 1], 1) - x @ self.middles.T
            else:
                found = squared(rest, self.middles) + (rest**2).sum(1)[:, None]
            far[:, j * parts : (j + 1) * parts] = found
        best = _least(far, min(probes, far.shape[1]))
        return np.take_along_axis(first, best // parts, 1) * parts + best % parts

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (the coarse one first) and squared norms of the decoded vectors.

        Beam search: of all ways to extend the ``BEAM`` best partial sums by a codeword, the ``BEAM`` best are kept.
        """
        n, dim = x.shape
        if n > AT_ONCE:
            parts = [self.encode(x[k : k + AT_ONCE]) for k in range(0, n, AT_ONCE)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        code0 = squared(x, self.coarse).argmin(1) if n else np.zeros(0, np.int64)
        rest = (x - self.coarse[code0])[:, None, :]
        codes = np.zeros((n, 1, 0), np.int16)
        for words in self.books:
            width = rest.shape[1]
            error = squared(rest.reshape(-1, dim), words).reshape(n, width, -1) + (rest**2).sum(2)[:, :, None]
            best = _least(error.reshape(n, -1), min(BEAM, width * len(words)))
            parent, word = best // len(words), best % len(words)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.int16)), 2)
        one = (rest**2).sum(2).argmin(1) if n else np.zeros(0, np.int64)
        chosen = np.concatenate((code0[:, None].astype(np.int16), codes[np.arange(n), one]), 1)
        return chosen, (self.decode(chosen) ** 2).sum(1).astype(np.float32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[codes[:, 0]].copy()
        for m, words in enumerate(self.books):
            out += words[codes[:, m + 1]]
        return out

    def scores(self, queries: np.ndarray, columns: list[np.ndarray], norms: np.ndarray) -> np.ndarray:
        """Approximate scores (queries x codes), more being nearer, by sums of table entries and the stored norms.

        ``columns`` are the codes of each codebook. Tables and sums hold the queries side by side, so what a code looks up
        is a run of memory.
        """
        side = np.ascontiguousarray(queries.T)
        total = np.take(self.coarse @ side, columns[0], axis=0)
        found = np.empty_like(total)
        for words, codes in zip(self.books, columns[1:]):
            np.take(words @ side, codes, axis=0, out=found, mode="clip")
            total += found
        if self.kind != "Dot":
            total *= 2
            total -= norms[:, None]
        return np.ascontiguousarray(total.T)


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least entries of each row, in order."""
    if k >= x.shape[1]:
        return np.argsort(x, 1, kind="stable")
    part = np.argpartition(x, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(x, part, 1), 1, kind="stable"), 1)


def train(x: np.ndarray, kind: str, total: int, seed: int = 1) -> Quantiser:
    """Fits the codebooks on a sample ``x`` of ``total`` vectors: residual k-means, then the books are solved jointly by
    least squares for the codes that beam search finds."""
    rng = np.random.default_rng(seed)
    wanted = max(1, total // CELL)
    coarse = kmeans(x, min(wanted, MOST_CELLS, max(1, len(x) // 8)), rng)
    rest = x - coarse[squared(x, coarse).argmin(1)]
    size = max(1, min(WORDS, len(x) // 4))
    books, left = [], rest
    for _ in range(STAGES):
        words = kmeans(left, size, rng, 5)
        left = left - words[squared(left, words).argmin(1)]
        books.append(words)
    groups = kmeans(coarse, max(1, min(len(coarse), total // SHARD)), rng)
    parts = max(1, min(len(rest), -(-total // (SHARD * len(coarse))))) if total > SHARD * MOST_CELLS else 1
    middles = kmeans(rest, parts, rng) if parts > 1 else np.zeros((1, x.shape[1]), np.float32)
    model = Quantiser(kind, coarse, np.stack(books), squared(coarse, groups).argmin(1), middles, total)
    codes, _ = model.encode(x)
    column = codes[:, 1:].astype(np.int64) + np.arange(STAGES) * size
    gram = np.zeros((STAGES * size, STAGES * size))
    for a in range(STAGES):
        for b in range(STAGES):
            np.add.at(gram, (column[:, a], column[:, b]), 1)
    right = np.zeros((STAGES * size, x.shape[1]))
    target = x - coarse[codes[:, 0]]
    for a in range(STAGES):
        np.add.at(right, column[:, a], target)
    prior = model.books.reshape(-1, x.shape[1])
    solved = np.linalg.solve(gram + np.eye(len(gram)), right + prior)
    model.books = solved.reshape(model.books.shape).astype(np.float32)
    return model
