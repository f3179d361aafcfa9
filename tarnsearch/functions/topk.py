"""Per-task top-k: what a task keeps of its share of the corpus."""

from __future__ import annotations

import numpy as np

# Cells of one score block (rows x questions) held at a time, some six times over while it is scored.
BLOCK_CELLS = 1_000_000
QUESTIONS_AT_A_TIME = 4096


def round_half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero, after scaling in binary: exact decimal halves may differ from SQL ``round``."""
    factor = 10.0**digits
    return np.sign(values) * np.floor(np.abs(values) * factor + 0.5) / factor + 0.0


class RunningTopK:
    """Best ``k`` rows per question over all blocks seen, ties to the smaller id."""

    def __init__(self, n_questions: int, k: int):
        self.k = k
        self.n_questions = n_questions
        self.floor = np.full(n_questions, -np.inf)
        self.question = np.empty(0, dtype=np.int64)
        self.row_id = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.float64)
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n_waiting = 0

    def offer(self, ids: np.ndarray, scores: np.ndarray, questions: np.ndarray | None = None) -> None:
        """Take a (rows x questions) block; minus infinity marks pairs to leave out.

        ``questions`` names the block's questions where it does not hold them all.
        """
        rows = len(ids)
        floor = self.floor if questions is None else self.floor[questions]
        if rows > self.k:
            kth = np.partition(scores, rows - self.k, axis=0)[rows - self.k]
            floor = np.maximum(floor, kth)
        # Everything level with the floor stays in: ids decide ties later.
        row, question = np.nonzero((scores >= floor) & ~np.isneginf(scores))
        if len(row) == 0:
            return
        named = question if questions is None else questions[question]
        self._waiting.append((named, ids[row], scores[row, question]))
        self._n_waiting += len(row)
        if self._n_waiting >= self.k * self.n_questions:
            self._settle()

    def _settle(self) -> None:
        """Sort what is waiting into the best so far, and raise the floor."""
        parts = [(self.question, self.row_id, self.score), *self._waiting]
        self._waiting, self._n_waiting = [], 0
        question, row_id, score = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((row_id, -score, question))
        question, row_id, score = question[order], row_id[order], score[order]
        place = np.arange(len(question)) - np.searchsorted(question, question, side="left")
        keep = place < self.k
        self.question, self.row_id, self.score = question[keep], row_id[keep], score[keep]
        last = place[keep] == self.k - 1
        self.floor[self.question[last]] = self.score[last]

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question numbers, row ids and scores of the best, question by question."""
        self._settle()
        return self.question, self.row_id, self.score


class ProductTopK:
    """Best ``k`` inner products per question, scored block by block."""

    def __init__(self, questions: np.ndarray, k: int, digits: int):
        self.questions = questions
        self.digits = digits
        starts = range(0, len(questions), QUESTIONS_AT_A_TIME)
        self.slices = [slice(s, min(s + QUESTIONS_AT_A_TIME, len(questions))) for s in starts]
        self.best = [RunningTopK(s.stop - s.start, k) for s in self.slices]

    def offer(self, ids: np.ndarray, vectors: np.ndarray, allowed=None) -> None:
        """``allowed(row_slice, question_slice)`` may give a mask of pairs to consider."""
        if not self.slices:
            return
        height = max(1, BLOCK_CELLS // (self.slices[0].stop - self.slices[0].start))
        for start in range(0, len(ids), height):
            rows = slice(start, start + height)
            block = vectors[rows].astype(np.float64)
            for cols, best in zip(self.slices, self.best):
                scores = round_half_up(block @ self.questions[cols].T, self.digits)
                if allowed is not None:
                    scores = np.where(allowed(rows, cols), scores, -np.inf)
                best.offer(ids[rows], scores)

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [best.finish() for best in self.best] or [RunningTopK(0, 1).finish()]
        for part, cols in zip(parts, self.slices):
            part[0][:] += cols.start
        return tuple(np.concatenate(column) for column in zip(*parts))
