"""Colour cards in boxes: exact nearest cards by CIEDE2000 without a look at most of them. NumPy, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cards of a box, boxes of a group, readings that are looked up together.
BOX_CARDS, GROUP_BOXES, CHUNK = 16, 32, 256


def delta_e_2000(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """CIEDE2000 of rows of two Lab arrays, by the published formula."""

    def weight(c):
        return np.sqrt(c**7 / (c**7 + 25.0**7))

    g = 1 + 0.5 * (1 - weight((np.hypot(x[:, 1], x[:, 2]) + np.hypot(y[:, 1], y[:, 2])) / 2))
    p1, p2 = x[:, 1] * g, y[:, 1] * g
    c1, c2 = np.hypot(p1, x[:, 2]), np.hypot(p2, y[:, 2])
    h1, h2 = (np.degrees(np.arctan2(b, p)) % 360 for p, b in ((p1, x[:, 2]), (p2, y[:, 2])))
    flat, gap, total = c1 * c2 == 0, h2 - h1, h1 + h2
    wide = np.abs(gap) > 180
    turn = np.where(flat, 0, gap - 360 * wide * np.sign(gap))
    mean = np.where(flat, total, np.where(~wide, total / 2, np.where(total < 360, (total + 360) / 2, (total - 360) / 2)))
    lm, cm = (x[:, 0] + y[:, 0]) / 2, (c1 + c2) / 2
    away = (lm - 50) ** 2
    dl = (y[:, 0] - x[:, 0]) / (1 + 0.015 * away / np.sqrt(20 + away))
    dc = (c2 - c1) / (1 + 0.045 * cm)
    t = 1 - 0.17 * np.cos(np.radians(mean - 30)) + 0.24 * np.cos(np.radians(2 * mean)) + 0.32 * np.cos(np.radians(3 * mean + 6)) - 0.20 * np.cos(np.radians(4 * mean - 63))
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * cm * t)
    rt = -2 * weight(cm) * np.sin(np.radians(60 * np.exp(-(((mean - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(dl * dl + dc * dc + dh * dh + rt * dc * dh, 0))


class Boxes:
    """Boxes in Lab space (low and high corners, cards inside), with a lower bound of dE00 from a colour to anything inside.

    dE00^2 >= (dL/S_L)^2 + (1 - |R_T|/2) * (dC'^2 + dH'^2) / max(S_C, S_H)^2, where dC'^2 + dH'^2 >= da^2 + db^2,
    S_H <= S_C = 1 + 0.045*C', and |R_T|/2 <= sin(60 deg) * sqrt(C'^7 / (C'^7 + 25^7)). C' is at most (1+G)*C for
    the mean chroma C of the pair, which grows with C, so the cell's largest chroma gives a valid bound.
    """

    def __init__(self, low, high, n):
        self.n = np.asarray(n, dtype=np.float64)
        self.low = np.asarray(low, dtype=np.float64).reshape(-1, 3)
        self.high = np.asarray(high, dtype=np.float64).reshape(-1, 3)
        far = np.maximum(np.abs(self.low[:, 1:]), np.abs(self.high[:, 1:]))
        self.chroma = np.hypot(far[:, 0], far[:, 1])
        self.off = np.maximum(np.abs(self.low[:, 0] - 50), np.abs(self.high[:, 0] - 50))

    def part(self, which: np.ndarray) -> Boxes:
        return Boxes(self.low[which], self.high[which], self.n[which])

    def lower_bound(self, lab: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[None] - lab[:, None], lab[:, None] - self.high[None]), 0.0)
        off = np.maximum(np.abs(lab[:, :1] - 50), self.off[None])
        s_l = 1 + 0.015 * off**2 / np.sqrt(20 + off**2)
        c = (np.hypot(lab[:, 1], lab[:, 2])[:, None] + self.chroma[None]) / 2

        def weight(x):
            cube = x * x * x
            seventh = cube * cube * x
            return np.sqrt(seventh / (seventh + 25.0**7))

        c = c * (1.5 - 0.5 * weight(c))
        ab2 = (gap[..., 1] ** 2 + gap[..., 2] ** 2) * (1 - np.sin(np.radians(60)) * weight(c)) / (1 + 0.045 * c) ** 2
        return np.sqrt((gap[..., 0] / s_l) ** 2 + ab2)


def pair_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bound of ``Boxes`` for rows of two Lab arrays: a card is a box without size. No angle is taken."""
    away = ((x[:, 0] + y[:, 0]) / 2 - 50) ** 2
    light = (x[:, 0] - y[:, 0]) / (1 + 0.015 * away / np.sqrt(20 + away))

    def weight(c):
        cube = c * c * c
        seventh = cube * cube * c
        return np.sqrt(seventh / (seventh + 25.0**7))

    c = (np.sqrt(x[:, 1] ** 2 + x[:, 2] ** 2) + np.sqrt(y[:, 1] ** 2 + y[:, 2] ** 2)) / 2
    c = c * (1.5 - 0.5 * weight(c))
    ab2 = ((x[:, 1] - y[:, 1]) ** 2 + (x[:, 2] - y[:, 2]) ** 2) * (1 - np.sin(np.radians(60)) * weight(c)) / (1 + 0.045 * c) ** 2
    return np.sqrt(light * light + ab2)


class Shelf:
    """Cards (rows of Lab, in the order that decides ties), cut into boxes that follow their number."""

    def __init__(self, lab: np.ndarray):
        parts, todo = [], [np.arange(len(lab))] if len(lab) else []
        while todo:  # halves along the longest edge, in an order that keeps neighbours together
            part = todo.pop()
            if len(part) <= BOX_CARDS:
                parts.append(part)
                continue
            edge = np.ptp(lab[part], axis=0).argmax()
            part = part[np.argsort(lab[part, edge], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.lab, self.scored = lab, 0
        self.cards = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        self.start = np.cumsum([0, *map(len, parts)])
        self.boxes = Boxes([lab[p].min(axis=0) for p in parts], [lab[p].max(axis=0) for p in parts], [len(p) for p in parts])
        at = np.arange(0, len(parts), GROUP_BOXES)
        if len(at):
            self.groups = Boxes(np.minimum.reduceat(self.boxes.low, at), np.maximum.reduceat(self.boxes.high, at), np.add.reduceat(self.boxes.n, at))
        self.group_of = np.arange(len(parts)) // GROUP_BOXES

    def chunks(self, asked: np.ndarray) -> Iterator[np.ndarray]:
        """Positions of readings that lie close together."""
        todo = [np.arange(len(asked))] if len(asked) else []
        while todo:
            part = todo.pop()
            if len(part) <= CHUNK:
                yield part
                continue
            edge = np.ptp(asked[part], axis=0).argmax()
            part = part[np.argsort(asked[part, edge], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]

    def _score(self, asked: np.ndarray, row: np.ndarray, box: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, card, rounded distance) of all cards in the boxes, but for those whose bound is beyond ``reach``."""
        size = self.start[box + 1] - self.start[box]
        row = np.repeat(row, size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[box], size)
        card = self.cards[place]
        if reach is not None:
            near = pair_bound(asked[row], self.lab[card]) <= reach[row] + 1e-6
            row, card = row[near], card[near]
        self.scored += len(card)
        return row, card, np.round(delta_e_2000(asked[row], self.lab[card]), 6)

    @staticmethod
    def _best(row: np.ndarray, card: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """The k first by (distance, card) of every row, with their ranks from 1."""
        order = np.lexsort((card, distance, row))
        row, card, distance = row[order], card[order], distance[order]
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, dtype=bool)
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else np.empty(0, dtype=np.int64)
        keep = rank < k
        return row[keep], card[keep], distance[keep], (rank[keep] + 1).astype(np.int32)

    def closest(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(row, card, distance, rank) of the k closest cards of each reading."""
        if not len(self.cards):
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0), none.astype(np.int32)
        m, far = len(asked), self.groups.lower_bound(asked)

        def covering(bound: np.ndarray, n: np.ndarray) -> np.ndarray:
            """The boxes with the lowest bounds that together hold k cards."""
            order, out = np.argsort(bound, axis=1, kind="stable"), np.zeros(bound.shape, dtype=bool)
            n = n[order]
            np.put_along_axis(out, order, np.cumsum(n, axis=1) - n < k, axis=1)
            return out

        near = np.flatnonzero(covering(far, self.groups.n).any(axis=0)[self.group_of])
        bound = self.boxes.part(near).lower_bound(asked)
        home = covering(bound, self.boxes.n[near])
        row, box = np.nonzero(home)
        found = self._best(*self._score(asked, row, near[box]), k)
        reach = np.full(m, np.inf)
        full = found[3] == k
        reach[found[0][full]] = found[2][full]
        # everything that may hold a card as close as the k-th, but for what has been seen
        within = np.flatnonzero((far <= reach[:, None] + 1e-6).any(axis=0)[self.group_of])
        pick = self.boxes.part(within).lower_bound(asked) <= reach[:, None] + 1e-6
        seen = np.zeros((m, len(self.boxes.n)), dtype=bool)
        seen[:, near] = home
        row, box = np.nonzero(pick & ~seen[:, within])
        more = self._score(asked, row, within[box], reach)
        return self._best(*(np.concatenate([a, b]) for a, b in zip(found[:3], more, strict=True)), k)
