"""Size arithmetic of pictures and key points as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: People that are compared at once, and kept ones with whom.
PEOPLE_AT_ONCE, KEPT_AT_ONCE = 64, 2048


def thumb_size(w: Column, h: Column, limit: int = 1200) -> tuple[Column, Column]:
    """Unchanged if both sides fit, else the longest side becomes ``limit``; truncated."""
    fits = (w <= limit) & (h <= limit)
    scale = F.lit(float(limit)) / F.greatest(w, h)
    return F.when(fits, w).otherwise((w * scale).cast("int")), F.when(fits, h).otherwise((h * scale).cast("int"))


def crop_box(w: Column, h: Column, dx: Column, dy: Column, target: int) -> dict[str, Column]:
    """Resize so that the picture covers target x target, then the box at the normalised shift from the centre."""
    scale = F.greatest(F.lit(float(target)) / w, F.lit(float(target)) / h)
    rw, rh = (w * scale).cast("int"), (h * scale).cast("int")
    x, y = dx * rw + (rw - target) / 2, dy * rh + (rh - target) / 2
    return {"resized_w": rw, "resized_h": rh, "x0": x, "y0": y, "x1": x + target, "y1": y + target}


def letterbox_box(w: Column, h: Column, target: int) -> dict[str, Column]:
    scale = F.least(F.lit(float(target)) / w, F.lit(float(target)) / h)
    nw, nh = (w * scale).cast("int"), (h * scale).cast("int")
    return {"new_w": nw, "new_h": nh, "off_x": F.floor((target - nw) / 2).cast("int"), "off_y": F.floor((target - nh) / 2).cast("int")}


def pair_points(flat: Column) -> Column:
    """(x, y, conf)… to an array of structs."""
    n = (F.size(flat) / 3).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, i * 3).alias("x"), F.get(flat, i * 3 + 1).alias("y"), F.get(flat, i * 3 + 2).alias("conf")))


def keypoint_normalize(points: Column, w: Column, h: Column, score: Column, visible_over: float = 0.1) -> tuple[Column, Column]:
    """(landmarks scaled to the picture, confidence): the mean confidence of visible points, or the detection's if larger."""
    landmarks = F.flatten(F.transform(points, lambda p: F.array(p["x"] / w, p["y"] / h)))
    seen = F.filter(points, lambda p: p["conf"] > visible_over)
    mean = F.aggregate(seen, F.lit(0.0), lambda a, p: a + p["conf"]) / F.greatest(F.size(seen), F.lit(1))
    return landmarks, F.greatest(F.when(F.size(seen) > 0, mean).otherwise(0.0), score)


def detection_filter(detections: Column, classes: list[str]) -> Column:
    return detections if "all" in classes else F.filter(detections, lambda d: d["class_name"].isin(*classes))


def primary_person(people: Column) -> Column:
    """The person with the best confidence; on ties the first."""
    best = F.array_max(F.transform(people, lambda p: p["pose_confidence"]))
    return F.get(F.filter(people, lambda p: p["pose_confidence"] == best), F.lit(0))


def mean_distance(a: Column, b: Column) -> Column:
    """Mean distance of corresponding (x, y) pairs of two flat arrays of equal length."""
    n = (F.size(a) / 2).cast("int")
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sqrt(F.pow(F.get(a, i * 2) - F.get(b, i * 2), 2) + F.pow(F.get(a, i * 2 + 1) - F.get(b, i * 2 + 1), 2)))
    return F.when(n > 0, F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n).otherwise(F.lit(float("inf")))


def _near(kept: np.ndarray, people: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the people (columns of components, as kept) are nearer than the threshold to any kept one; sums go joint by joint."""
    joints, out = len(kept) // 2, np.zeros(people.shape[1], bool)
    for c in range(0, kept.shape[1] if joints else 0, KEPT_AT_ONCE):
        k, s = kept[:, c : c + KEPT_AT_ONCE], 0.0
        for i in range(0, joints * 2, 2):
            dx, dy = people[i][:, None] - k[i][None], people[i + 1][:, None] - k[i + 1][None]
            s = s + np.sqrt(dx * dx + dy * dy)
        out |= (s / joints < threshold).any(1)
    return out


def _kept_people(landmarks: pa.Array, threshold: float) -> list[int]:
    """Positions of the people of one array whom a fold in order keeps, given their landmarks. Kept ones are held as matrices by their
    number of landmarks; people are looked at in parts, against all kept before the part at once."""
    widths = [-1 if n is None else n for n in pc.list_value_length(landmarks).to_pylist()]
    values, ends = landmarks.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.maximum(widths, 0))
    vector = lambda i: values[ends[i] - max(widths[i], 0) : ends[i]]
    held, count, out = {}, {}, []

    def keep(i):
        w = max(widths[i], 0)
        if count.setdefault(w, 0) == (held[w].shape[1] if w in held else 0):
            held[w] = np.concatenate([held.get(w, np.zeros((w, 0))), np.zeros((w, max(64, count[w])))], axis=1)
        held[w][:, count[w]] = vector(i)
        count[w] += 1
        out.append(i)

    def near(some, since):
        """Of people of one width, who is near a kept one of at most that width, from the given numbers of kept ones on."""
        x, found = np.stack([vector(i) for i in some], 1), np.zeros(len(some), bool)
        for w, n in count.items():
            if w <= len(x) and since.get(w, 0) < n:
                found |= _near(held[w][:, since.get(w, 0) : n], x[:w], threshold)
        return found

    for a in range(0, len(widths), PEOPLE_AT_ONCE):
        part = range(a, min(a + PEOPLE_AT_ONCE, len(widths)))
        before, gone = dict(count), set()
        for w in {widths[i] for i in part} - {-1}:
            same = [i for i in part if widths[i] == w]
            gone |= {i for i, x in zip(same, near(same, {})) if x}
        for i in part:
            if i not in gone and (widths[i] == -1 or not near([i], before)[0]):
                keep(i)
    return out


def dedupe_people(people: Column, kind: str, threshold: float = 0.1) -> Column:
    """Greedy in order: a person nearer than ``threshold`` to one already kept is dropped. ``kind`` is the array's DDL type.

    Landmarks are compared by their mean distance, as in ``mean_distance``; with fewer than a kept person has, or with gaps, a
    person is near to none."""

    @F.arrow_udf("array<int>")
    def kept(landmarks: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _kept_people(x, threshold) for x in (landmarks[i].values for i in range(len(landmarks)))], pa.list_(pa.int32()))

    marks = F.transform(people, lambda p: p["landmarks"].cast("array<double>"))
    return F.transform(kept(marks), lambda i: F.get(people, i)).cast(kind)
