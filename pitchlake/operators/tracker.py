"""The tracker of one match: filtered boxes with covariance, staged association, appearance for crossing players.

``Tracker.step`` takes one frame; the batch form (``tracking.track``) and the stream (``live.live_tracks``) run the same
steps, the stream with its state packed between batches. The noise of a box is independent in its four coordinates (centre,
aspect, height) and a velocity only moves its own coordinate, so the 8 x 8 covariance stays four 2 x 2 blocks: the filter
below keeps their three entries for all tracks at once and is equal to the full matrix form.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, fields

import numpy as np

#: Standard deviations of noise, in box heights a frame (aspect: plain). Fixed values.
POSITION, VELOCITY, ASPECT, ASPECT_VELOCITY, ASPECT_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs of two box arrays."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    inside = np.maximum(high - low, 0)
    meet = inside[..., 0] * inside[..., 1]
    area = lambda r: np.maximum(r[:, 2] - r[:, 0], 0) * np.maximum(r[:, 3] - r[:, 1], 0)
    return meet / np.maximum(area(a)[:, None] + area(b)[None] - meet, 1e-9)


def assign(cost: np.ndarray, worst: float) -> list[tuple[int, int]]:
    """Least-cost one-to-one pairs of cost at most ``worst``, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if not n or not m or not (cost <= worst).any():
        return []
    if n == 1 or m == 1:
        best = int(cost.argmin())
        return [(best, 0) if m == 1 else (0, best)]
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T, worst))
    c = np.minimum(cost, worst * 10 + 1)
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], j = i, m
        reach, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            done[j] = True
            row = owner[j]
            free = np.flatnonzero(~done[:m])
            slack = c[row, free] - u[row] - v[free]
            closer = slack < reach[free]
            reach[free[closer]], before[free[closer]] = slack[closer], j
            j = free[reach[free].argmin()]
            step = reach[j]
            u[owner[done]] += step
            v[done] -= step
            reach[~done[:m]] -= step
        while j != m:
            owner[j], j = owner[before[j]], before[j]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and cost[owner[j], j] <= worst)


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, aspect and height of boxes."""
    size = np.maximum(boxes[:, 2:] - boxes[:, :2], 1e-3)
    return np.column_stack([(boxes[:, :2] + boxes[:, 2:]) / 2, size[:, 0] / size[:, 1], size[:, 1]])


def corners(state: np.ndarray) -> np.ndarray:
    half = np.column_stack([state[:, 2] * state[:, 3], state[:, 3]]) / 2
    return np.column_stack([state[:, :2] - half, state[:, :2] + half])


def _apart(held: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of all centres, and both sides' heights, at least one."""
    far = (held[:, None, :2] + held[:, None, 2:] - boxes[None, :, :2] - boxes[None, :, 2:]) / 2
    return np.linalg.norm(far, axis=2), np.maximum(held[:, 3] - held[:, 1], 1.0)[:, None], np.maximum(boxes[:, 3] - boxes[:, 1], 1.0)[None]


def _deviation(height: np.ndarray, of_height: float, of_aspect: float) -> np.ndarray:
    out = np.empty((len(height), 4))
    out[:] = (of_height * height)[:, None]
    out[:, 2] = of_aspect
    return out


class Filter:
    """Positions, velocities and the three covariance entries of each coordinate: arrays (tracks, 4)."""

    PARTS = ("at", "speed", "var", "cross", "speed_var")

    def __init__(self, seen: np.ndarray):
        self.at, self.speed, self.cross = seen.copy(), np.zeros_like(seen), np.zeros_like(seen)
        self.var = _deviation(seen[:, 3], 2 * POSITION, ASPECT) ** 2
        self.speed_var = _deviation(seen[:, 3], 10 * VELOCITY, ASPECT_VELOCITY) ** 2

    def predict(self) -> None:
        height = self.at[:, 3].copy()
        self.at = self.at + self.speed
        self.var = self.var + 2 * self.cross + self.speed_var + _deviation(height, POSITION, ASPECT) ** 2
        self.cross = self.cross + self.speed_var
        self.speed_var = self.speed_var + _deviation(height, VELOCITY, ASPECT_VELOCITY) ** 2

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """The variance of what should be seen."""
        return self.var[rows] + _deviation(self.at[rows, 3], POSITION, ASPECT_SEEN) ** 2

    def update(self, rows: np.ndarray, seen: np.ndarray) -> None:
        total, error = self.spread(rows), seen - self.at[rows]
        gain, speed_gain, cross = self.var[rows] / total, self.cross[rows] / total, self.cross[rows].copy()
        self.at[rows] += gain * error
        self.speed[rows] += speed_gain * error
        self.speed_var[rows] -= speed_gain * cross
        self.cross[rows] -= gain * cross
        self.var[rows] *= 1 - gain

    def surprise(self, rows: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of measurements (tracks x seen)."""
        return (((seen[None] - self.at[rows][:, None]) ** 2) / self.spread(rows)[:, None]).sum(2)

    def keep(self, rows: np.ndarray) -> None:
        for part in self.PARTS:
            setattr(self, part, getattr(self, part)[rows])

    def extend(self, other: Filter) -> None:
        for part in self.PARTS:
            setattr(self, part, np.concatenate([getattr(self, part), getattr(other, part)]))


@dataclass
class Settings:
    """Thresholds of the association; scores are detector confidences, distances are in box heights. Fixed values."""

    sure: float = 0.3
    doubtful: float = 0.1
    new: float = 0.4
    worst: float = 0.8  # cost of a pair of the first stage, 1 - overlap x score
    doubtful_overlap: float = 0.5
    worst_unconfirmed: float = 0.7
    reach: float = 0.6  # of the last stage
    resize: float = 1.5  # of the last stage: heights differ by this factor at most
    lost: int = 45  # frames
    decay: float = 0.9  # of a lost track's velocity
    centre: float = 0.5
    look: float = 0.5
    look_every: int = 5
    look_share: float = 0.2
    apart: float = 0.05  # a box with more overlap shows two players
    confirm: int = 2


class Tracker:
    """Tracks of one match. A track is told once it has ``confirm`` detections in successive frames; those of the first frame at once."""

    def __init__(self, settings: Settings | None = None):
        self.set = settings or Settings()
        self.filter = Filter(np.zeros((0, 4)))
        self.ids, self.seen, self.hits, self.looked = (np.zeros(0, np.int64) for _ in range(4))
        self.looks: list[np.ndarray | None] = []
        self.waiting: list[list[tuple[int, int]]] = []  # rows of tracks that aren't confirmed yet
        self.told = np.zeros(0, bool)
        self.next_id, self.steps = 0, 0
        self.last: int | None = None

    def _looks_apart(self, tracks: np.ndarray, gate: np.ndarray, looks: list) -> np.ndarray:
        """Extra cost of pairs that look different, where a track or a detection has more than one choice."""
        extra = np.zeros(gate.shape)
        unclear = gate & ((gate.sum(1) > 1)[:, None] | (gate.sum(0) > 1)[None])
        for i, j in np.argwhere(unclear):
            own, other = self.looks[tracks[i]], looks[j]
            if own is not None and other is not None and len(own) == len(other):
                extra[i, j] = self.set.look * (1 - float(np.sqrt(own * other).sum()))
        return extra

    def _take(self, tracks: np.ndarray, free: np.ndarray, pairs: list, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if pairs:
            i, j = np.array(pairs).T
            taken[free[j]] = tracks[i]
            tracks, free = np.delete(tracks, i), np.delete(free, j)
        return tracks, free

    def step(self, frame: int, dets: list, boxes: np.ndarray, scores: np.ndarray, looks: list | None = None) -> list[tuple[int, object, int]]:
        """(frame, det, track) of what is known after this frame; ``looks`` are histograms that sum to one, or None."""
        s, self.steps = self.set, self.steps + 1
        # frames without any row have passed too
        passed = 1 if self.last is None else max(1, int(frame - self.last))
        self.last = int(frame)
        alive = frame - 1 - self.seen <= s.lost
        if not alive.all():
            self._keep(np.flatnonzero(alive))  # some may have run out in frames without rows
        boxes, looks = np.asarray(boxes, float).reshape(-1, 4), looks if looks is not None else [None] * len(boxes)
        for k in range(passed):
            lost = self.seen < frame - passed + k
            if lost.any():
                self.filter.speed[lost] *= s.decay
                self.filter.speed[lost, 2] = 0
            self.filter.predict()
        whole = ((boxes[:, 2:] - boxes[:, :2]) > 1e-3).all(1)
        taken = np.full(len(boxes), -1)
        known, fresh = np.flatnonzero(self.told), np.flatnonzero(~self.told)
        held = corners(self.filter.at)

        # sure detections by overlap, ranked by distance and look
        free = np.flatnonzero(whole & (scores >= s.sure))
        cost = 1 - iou(held[known], boxes[free]) * scores[free][None]
        gate = cost <= s.worst
        if gate.any():  # as below, stages without pairs are left out: most frames have a few boxes
            gap, tall, other = _apart(held[known], boxes[free])
            cost = cost + s.centre * gap / ((tall + other) / 2)
            if any(x is not None for x in looks):
                cost = cost + self._looks_apart(known, gate, [looks[j] for j in free])
            known, free = self._take(known, free, assign(np.where(gate, cost, np.inf), 100.0), taken)

        # doubtful ones for tracks that were seen in the frame before
        low = np.flatnonzero(whole & (scores > s.doubtful) & (scores < s.sure))
        if len(low):
            recent = known[self.seen[known] == frame - passed]
            left, _ = self._take(recent, low, assign(1 - iou(held[recent], boxes[low]), 1 - s.doubtful_overlap), taken)
            known = known[~np.isin(known, np.setdiff1d(recent, left))]

        # near centres of like size, for boxes that don't overlap
        if len(known) and len(free):
            gap, tall, other = _apart(held[known], boxes[free])
            alike = np.maximum(tall, other) <= s.resize * np.minimum(tall, other)
            known, free = self._take(known, free, assign(np.where(alike, gap / tall, np.inf), s.reach), taken)

        # what is left confirms new tracks, or begins some
        gone = fresh
        if len(fresh) and len(free):
            cost = 1 - iou(held[fresh], boxes[free]) * scores[free][None]
            gone, free = self._take(fresh, free, assign(cost, s.worst_unconfirmed), taken)
        out = self._record(frame, dets, boxes, looks, taken) if (taken >= 0).any() else []
        stay = frame - self.seen <= s.lost
        stay[gone] = False
        if not stay.all():
            self._keep(np.flatnonzero(stay))
        born = free[scores[free] >= s.new]
        if not len(born):
            return out
        out += self._begin(frame, [dets[j] for j in born], boxes[born], [looks[j] if self._alone(boxes, j) else None for j in born])
        return out

    def _alone(self, boxes: np.ndarray, j: int) -> bool:
        overlap = iou(boxes[[j]], boxes)[0]
        overlap[j] = 0
        return not (overlap > self.set.apart).any()

    def _record(self, frame: int, dets: list, boxes: np.ndarray, looks: list, taken: np.ndarray) -> list:
        out, found = [], np.flatnonzero(taken >= 0)
        rows = taken[found]
        self.filter.update(rows, measured(boxes[found]))
        self.seen[rows] = frame
        self.hits[rows] += 1
        for j, k in zip(found.tolist(), rows.tolist()):
            if looks[j] is not None and (self.looks[k] is None or self.steps - self.looked[k] >= self.set.look_every) and self._alone(boxes, j):
                own, new = self.looks[k], np.asarray(looks[j], float)
                self.looks[k] = new if own is None or len(own) != len(new) else (1 - self.set.look_share) * own + self.set.look_share * new
                self.looked[k] = self.steps
            self.waiting[k].append((frame, dets[j]))
            if self.hits[k] >= self.set.confirm:
                self.told[k] = True
            if self.told[k]:
                out += [(f, d, int(self.ids[k])) for f, d in self.waiting[k]]
                self.waiting[k] = []
        return out

    def _keep(self, rows: np.ndarray) -> None:
        self.filter.keep(rows)
        for part in ("ids", "seen", "hits", "looked", "told"):
            setattr(self, part, getattr(self, part)[rows])
        self.looks, self.waiting = [self.looks[k] for k in rows], [self.waiting[k] for k in rows]

    def _begin(self, frame: int, dets: list, boxes: np.ndarray, looks: list) -> list:
        n, at_once = len(dets), self.steps == 1 or self.set.confirm <= 1
        self.filter.extend(Filter(measured(boxes)))
        ids = self.next_id + np.arange(n)
        self.next_id += n
        for part, values in (("ids", ids), ("seen", np.full(n, frame)), ("hits", np.ones(n)), ("looked", np.full(n, self.steps))):
            setattr(self, part, np.concatenate([getattr(self, part), values]).astype(np.int64))
        self.told = np.concatenate([self.told, np.full(n, at_once)])
        self.looks += [None if x is None else np.asarray(x, float) for x in looks]
        self.waiting += [[] if at_once else [(frame, d)] for d in dets]
        return [(frame, d, int(i)) for d, i in zip(dets, ids)] if at_once else []

    # the state between batches of a stream

    def pack(self) -> bytes:
        """All of the state; its size is bounded by the tracks alive."""
        width = max((len(x) for x in self.looks if x is not None), default=0)
        looks = np.array([np.full(width, np.nan) if x is None or len(x) != width else x for x in self.looks]).reshape(len(self.looks), width)
        waiting = np.array([(k, f, d) for k, rows in enumerate(self.waiting) for f, d in rows], np.int64).reshape(-1, 3)
        counts = np.array([self.next_id, self.steps, -1 if self.last is None else self.last, self.last is not None], np.int64)
        settings = np.array([float(getattr(self.set, f.name)) for f in fields(self.set)])
        out = io.BytesIO()
        np.savez(out, ids=self.ids, seen=self.seen, hits=self.hits, looked=self.looked, told=self.told, looks=looks, waiting=waiting, counts=counts, settings=settings, **{f"f_{p}": getattr(self.filter, p) for p in Filter.PARTS})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tracker:
        z = np.load(io.BytesIO(data))
        types = {"lost": int, "look_every": int, "confirm": int}
        self = cls(Settings(**{f.name: types.get(f.name, float)(v) for f, v in zip(fields(Settings), z["settings"])}))
        for part in ("ids", "seen", "hits", "looked", "told"):
            setattr(self, part, z[part])
        for part in Filter.PARTS:
            setattr(self.filter, part, z[f"f_{part}"])
        self.looks = [None if not len(x) or np.isnan(x).any() else x for x in z["looks"]]
        self.waiting = [[] for _ in self.ids]
        for k, f, d in z["waiting"].tolist():
            self.waiting[k].append((f, d))
        next_id, steps, last, begun = z["counts"].tolist()
        self.next_id, self.steps, self.last = next_id, steps, last if begun else None
        return self
