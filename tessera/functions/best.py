"""The best rows of each query among all that pass through a task, so that no more leave it."""

from __future__ import annotations

import numpy as np

#: Cells of a matrix of queries and rows that are looked at together.
CELLS = 1 << 21


class Best:
    """The ``k`` rows of highest score of each of ``queries`` queries, kept while rows pass.

    Scores are compared to ``digits`` digits, those that are no number before
    all others as in Spark, equal ones by the rows' ids; those that aren't over
    ``above``, if given, take no part.
    What is held is bounded by a few times ``queries * k``: once a query has
    ``k`` rows, only such as reach the least of them are taken on.
    """

    def __init__(self, queries: int, k: int, digits: int, above: float | None = None) -> None:
        self.k, self.digits, self.above = k, digits, above
        self.bound = np.full(queries, -np.inf)  # rounded score that a row has to reach
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, max(4 * queries * k, 1 << 16)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take on a matrix of scores, a row a query and a column an id."""
        slack = 10.0**-self.digits
        taken = ~(scores < (self.bound - slack)[:, None])
        if self.k < scores.shape[1] and taken.sum() > self.most:  # the first matrices, mostly
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            taken &= ~(scores < (least - 2 * slack)[:, None])
        if self.above is not None:
            taken &= scores > self.above
        query, at = np.nonzero(taken)
        if len(query):
            self.held.append((query, ids[at], scores[query, at]))
            self.waiting += len(query)
            if self.waiting > self.most:
                self._shrink()

    def _shrink(self) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        rounded = np.round(scores, self.digits)
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], np.where(np.isnan(rounded), -np.inf, -rounded), query))
        query, ids, scores, rounded = query[order], ids[order], scores[order], rounded[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.bound[query[last]] = rounded[last]
        kept = place < self.k
        self.held, self.waiting = [(query[kept], ids[kept], scores[kept])], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Number of the query, id and score; nothing if no row was taken on."""
        if not self.held:
            return None
        self._shrink()
        return self.held[0]
