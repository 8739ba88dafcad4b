"""Best-k selection inside one task: blocked matrix products over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUESTION_BLOCK = 256
#: Matches that wait for a selection, at least; from there on as many as are kept.
PENDING_ROWS = 8_192
#: Decimals to which sums of doubles agree in whatever order they are added.
EXACT_DIGITS = 12


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.float64)


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and the mask of rows that had a length."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = norms > 0
    return matrix / np.where(usable, norms, 1.0)[:, None], usable


class BestMatches:
    """Running best-k per question over any number of vector blocks.

    Memory is bounded by questions x k rows plus one block, whatever the number of
    vectors and of ties. Scores are rounded so that equal vectors tie wherever they are
    computed; ties go to the smaller id, so the result does not depend on block order.
    """

    def __init__(
        self,
        question_ids: pa.Array,
        questions: np.ndarray,
        k: int,
        digits: int = EXACT_DIGITS,
        floor: np.ndarray | None = None,
    ):
        """``floor``: for each question a score that its k-th match reaches at least."""
        self.ids = question_ids
        unit, usable = unit_rows(questions)
        self.rows = np.nonzero(usable)[0]
        self.unit = unit[self.rows]
        self.k, self.digits = k, digits
        self.floor = np.full(len(self.rows), -np.inf) if floor is None else floor[self.rows].copy()
        self.kept: pa.Table | None = None
        self.pending: list[pa.Table] = []
        self.pending_rows = 0

    def offer(self, vectors: np.ndarray, payload: pa.Table, only: np.ndarray | None = None) -> None:
        """Vectors with their ``id`` and payload; ``only`` names the questions that they concern."""
        unit, usable = unit_rows(vectors)
        if not usable.all():
            keep = np.nonzero(usable)[0]
            unit, payload = unit[keep], payload.take(pa.array(keep))
        n = len(unit)
        if n == 0:
            return
        # By id, so that the first of equal scores are those with the smaller ids.
        order = pc.sort_indices(payload, sort_keys=[("id", "ascending")])
        unit, payload = unit[order.to_numpy()], payload.take(order)
        asked = np.arange(len(self.unit))
        if only is not None:
            asked = asked[np.isin(self.rows, only)]
        for lo in range(0, len(asked), QUESTION_BLOCK):
            some = asked[lo : lo + QUESTION_BLOCK]
            scores = np.round(self.unit[some] @ unit.T, self.digits) + 0.0
            picked = scores >= self.floor[some, None]
            if n > self.k:
                kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k, None]
                above, equal = scores > kth, scores == kth
                equal &= np.cumsum(equal, axis=1) <= self.k - above.sum(axis=1, keepdims=True)
                picked &= above | equal
            q, v = np.nonzero(picked)
            found = payload.take(pa.array(v))
            found = found.append_column("_q", pa.array(some[q]))
            found = found.append_column("score", pa.array(scores[q, v]))
            self.pending.append(found)
            self.pending_rows += len(found)
            if self.pending_rows > max(PENDING_ROWS, self.k * len(self.unit)):
                self._compact()

    def _compact(self) -> None:
        parts = ([self.kept] if self.kept is not None else []) + self.pending
        table = pa.concat_tables(parts)
        order = pc.sort_indices(
            table.select(["_q", "score", "id"]),
            sort_keys=[("_q", "ascending"), ("score", "descending"), ("id", "ascending")],
        )
        q = table.column("_q").to_numpy()[order.to_numpy()]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        self.kept = table.take(order.take(pa.array(np.nonzero(rank < self.k)[0])))
        last = np.nonzero(rank == self.k - 1)[0]
        scores = table.column("score").to_numpy()[order.to_numpy()]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last])
        self.pending, self.pending_rows = [], 0

    def result(self) -> pa.Table | None:
        """Rows ``question_id, score`` plus the payload columns; none if nothing matched."""
        if self.pending:
            self._compact()
        if self.kept is None:
            return None
        rows = pa.array(self.rows[self.kept.column("_q").to_numpy()])
        return self.kept.drop_columns(["_q"]).append_column("question_id", self.ids.take(rows))
