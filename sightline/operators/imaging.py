"""Kernels over grey images (numpy arrays of 0 to 255), and a wrapper that runs one over a table of images."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour."""
    ys, xs = np.arange(height) * img.shape[0] // height, np.arange(width) * img.shape[1] // width
    return img[ys[:, None], xs[None, :]]


def equalise(img: np.ndarray) -> np.ndarray:
    """Histogram equalisation by an integer table."""
    hist = np.bincount(img.ravel(), minlength=256)
    cdf = np.cumsum(hist)
    low = int(cdf[hist > 0][0]) if img.size else 0
    span = img.size - low
    return img.copy() if span <= 0 else (np.clip(cdf - low, 0, None) * 255 // span).astype(np.uint8)[img]


def threshold(img: np.ndarray, block: int = 25, less: int = 10) -> np.ndarray:
    """White where a pixel exceeds the whole mean of the surrounding square less a constant, black elsewhere; squares are cut off at the edges."""
    radius = max(block, 1) // 2
    total = np.pad(np.cumsum(np.cumsum(img.astype(np.int64), 0), 1), ((1, 0), (1, 0)))
    h, w = img.shape
    y0, y1 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    box = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return np.where(img > box // area - less, 255, 0).astype(np.uint8)


def invert(img: np.ndarray) -> np.ndarray:
    return 255 - img


def upscale(img: np.ndarray, factor: int) -> np.ndarray:
    return img.repeat(max(factor, 1), 0).repeat(max(factor, 1), 1)


def crop(img: np.ndarray, rect: tuple[float, float, float, float]) -> np.ndarray:
    """The pixels of a rectangle (x1, y1, x2, y2) in fractions, cut off towards 0."""
    h, w = img.shape[:2]
    x1, y1, x2, y2 = rect
    return img[max(0, int(y1 * h)) : int(y2 * h), max(0, int(x1 * w)) : int(x2 * w)]


def grey(img: np.ndarray) -> np.ndarray:
    """Luma of a colour image (height, width, 3); a grey one stays."""
    return img if img.ndim == 2 else ((img.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000).astype(np.uint8)


def saturation(img: np.ndarray) -> np.ndarray:
    """Distance of the strongest to the weakest colour."""
    return img.max(2).astype(np.int16) - img.min(2)


def white_ink(img: np.ndarray, least_luma: int, most_saturation: int) -> np.ndarray:
    """Black where a pixel is bright and nearly without colour, white elsewhere."""
    return np.where((grey(img) >= least_luma) & (saturation(img) <= most_saturation), 0, 255).astype(np.uint8)


def saturated_ink(img: np.ndarray, least: int) -> np.ndarray:
    return np.where(saturation(img) >= least, 0, 255).astype(np.uint8)


def preprocess(img: np.ndarray, rect: tuple | None = None, block: int = 25, less: int = 10, factor: int = 3, equalised: bool = True, thresholded: bool = True, inverted: bool = True) -> np.ndarray:
    """Crop, grey, then equalise, threshold and invert unless left out, and enlarge."""
    out = grey(img if rect is None else crop(img, rect))
    for wanted, step in ((equalised, equalise), (thresholded, lambda x: threshold(x, block, less)), (inverted, invert)):
        out = step(out) if wanted else out
    return upscale(out, factor)


def trim_to_ink(img: np.ndarray, rect: tuple[float, float, float, float], least: int, margin: float) -> tuple[float, float, float, float]:
    """The rectangle, its right edge drawn in to the rightmost saturated column and a margin; as it was without one."""
    h, w = img.shape[:2]
    x1, y1, x2, y2 = rect
    left, right = int(x1 * w), int(x2 * w)
    inked = np.flatnonzero((saturation(img[int(y1 * h) : int(y2 * h), left:right]) >= least).any(0)) if right > left else []
    edge = left + int(inked[-1]) + 1 + int(margin * w) if len(inked) else right
    return (x1, y1, edge / w, y2) if edge < right else rect


def correlate(img: np.ndarray, template: np.ndarray, rect: tuple[float, float, float, float] = (0, 0, 1, 1), reference_height: int | None = None) -> tuple[float, int, int]:
    """Best normalised cross-correlation of a template in a region, and its place (y, x), the first of equals; a flat window scores 0, as does a negative best.

    A template cut from frames of another height is scaled first; a region too
    small for it is moved into the frame. Sums over windows come from running sums, dot products from one transform.
    """
    if reference_height and reference_height != img.shape[0]:
        scale = img.shape[0] / reference_height
        template = resize(template, *(max(1, int(n * scale + 0.5)) for n in template.shape))
    th, tw = template.shape
    h, w = img.shape
    if th > h or tw > w or template.std() == 0:
        raise ValueError("the template is larger than the frame, or flat")
    x1, x2 = sorted_into(rect[0], rect[2], tw, w)
    y1, y2 = sorted_into(rect[1], rect[3], th, h)
    part = img[y1:y2, x1:x2].astype(np.float64)
    part = part - part.mean()  # keeps the sums of squares small
    t = template.astype(np.float64) - template.mean()
    boxes = []
    for values in (part, part * part):
        total = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        boxes.append(total[th:, tw:] - total[:-th, tw:] - total[th:, :-tw] + total[:-th, :-tw])
    var = boxes[1] - boxes[0] ** 2 / (th * tw)
    size = part.shape
    dots = np.fft.irfft2(np.fft.rfft2(part) * np.conj(np.fft.rfft2(t, size)), size)[: size[0] - th + 1, : size[1] - tw + 1]
    flat = var < 1e-6 * th * tw
    score = np.round(np.where(flat, 0.0, dots / np.sqrt(np.where(flat, 1.0, var) * (t * t).sum())), 9)
    y, x = np.unravel_index(int(np.argmax(score)), score.shape)
    return max(0.0, float(score[y, x])), int(y) + y1, int(x) + x1


def sorted_into(lo: float, hi: float, least: int, size: int) -> tuple[int, int]:
    """Pixels of a range in fractions, made wide enough and moved into the frame."""
    a, b = int(lo * size + 0.5), int(hi * size + 0.5)
    b = max(b, a + least)
    a = max(0, a - max(0, b - size))
    return a, min(b, size)


def phase(profile: np.ndarray, pitch: int) -> tuple[int, float, int]:
    """Phase at which rows spaced by the pitch are brightest (the first of equals), its contrast to the darkest phase, and its number of rows."""
    means = np.array([profile[p::pitch].mean() for p in range(min(pitch, len(profile)))])
    if not len(means):
        return 0, 0.0, 0
    best = int(means.argmax())
    return best, float(means.max() - means.min()), len(profile[best::pitch])


def best_pitch(profile: np.ndarray, nominal: int) -> tuple[int, float]:
    """Pitch from three quarters to one and a half of the nominal one, by contrast times the root of the rows at its phase, two at least; and its contrast."""
    found = [(c * np.sqrt(n), -p, c) for p in range(max(1, nominal * 3 // 4), nominal * 3 // 2 + 1) for _, c, n in [phase(profile, p)] if n > 1]
    best = max(found, default=(0.0, 0, 0.0))
    return -best[1], best[2]


#: Contrast from which rows repeat, how far below the brightest row a boundary may lie, and how often the rest is searched again.
CONTRAST, DARKER, AGAIN = 35.0, 15.0, 1


class PitchMismatch(ValueError):
    """Rows repeat, but at another distance than expected."""


def bands_of(profile: np.ndarray, pitch: int, brightest: float, again: int = AGAIN) -> list[tuple[int, int]]:
    """Rows between the boundaries of the longest run that are bright enough, and those found once more above and below it."""
    start, contrast, n = phase(profile, pitch)
    if contrast < CONTRAST or n < 2:
        return []
    at = np.arange(start, len(profile), pitch)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], profile[at] >= brightest - DARKER, [0]))))
    runs = edges.reshape(-1, 2)
    lo, hi = max(runs.tolist(), key=lambda r: (r[1] - r[0], -r[0]), default=(0, 0))
    if hi - lo < 2:
        return []
    found = [(int(a), int(b)) for a, b in zip(at[lo : hi - 1], at[lo + 1 : hi], strict=True)]
    top, bottom = found[0][0], found[-1][1]
    if again:
        if top >= pitch:
            found += bands_of(profile[:top], pitch, brightest, again - 1)
        if len(profile) - bottom >= pitch:
            found += [(bottom + a, bottom + b) for a, b in bands_of(profile[bottom:], pitch, brightest, again - 1)]
    return sorted(found)


def segment_rows(img: np.ndarray, rect: tuple[float, float, float, float], pitch: int) -> list[tuple[int, int]]:
    """Rows of a list by the bright gaps between them, in pixels of the frame; none in a region without repetition, PitchMismatch if it repeats otherwise."""
    h, w = img.shape[:2]
    top, bottom, left, right = int(rect[1] * h), int(rect[3] * h), int(rect[0] * w), int(rect[2] * w)
    if pitch <= 0:
        raise ValueError("the pitch must be positive")
    if bottom - top < pitch // 2 or right <= left:
        return []
    profile = grey(img)[top:bottom, left:right].mean(1)
    if phase(profile, pitch)[1] < CONTRAST:
        other, contrast = best_pitch(profile, pitch)
        if contrast >= CONTRAST:
            raise PitchMismatch(f"rows repeat every {other} pixels, not {pitch}")
        return []
    return [(top + a, top + b) for a, b in bands_of(profile, pitch, float(profile.max()))]


def scroll_offset(before: np.ndarray, after: np.ndarray, rect: tuple[float, float, float, float] = (0, 0, 1, 1), strips: int = 3, share: float = 0.12, within: int = 4, least: float = 0.5, flat: float = 100.0) -> int | None:
    """Pixels by which the content of a region moved up from one frame to the next; None if it can't be told.

    Strips from the top of the region in the later frame are searched in the
    earlier one. The first strip, which reaches furthest, names the offset; at least one other that can reach it must be there, and all such must
    agree. Flat strips don't count, and an offset within a strip of the reach isn't believed.
    """
    h, w = after.shape
    top, bottom = int(rect[1] * h + 0.5), int(rect[3] * h + 0.5)
    high = int(share * (bottom - top))
    if before.shape != after.shape or high < 8 or bottom - top < 4 * high:
        return None
    found = {}
    for k in range(strips):
        y = top + k * high
        strip = after[y : y + high, int(rect[0] * w) : int(rect[2] * w)]
        if bottom - y - high >= 0 and strip.var() >= flat:
            score, at, _ = correlate(before, strip, (rect[0], y / h, rect[2], rect[3]))
            found[k] = max(0, at - y), score, bottom - y - high
    if 0 not in found:
        return None
    offset, score, reach = found.pop(0)
    others = [d for d, _, r in found.values() if r >= offset]
    if offset > reach - high or not others or score < least or any(abs(d - offset) > within for d in others):
        return None
    return offset


def clear_winner(scores: dict[str, float], gap: float = 0.20) -> str | None:
    """The name of the best score if it leads the next by the gap."""
    first, second = (sorted(((s, n) for n, s in scores.items()), key=lambda x: -x[0]) + [(0.0, ""), (0.0, "")])[:2]
    return first[1] if first[1] and first[0] - second[0] >= gap else None


def agreed_total(by_digit: list[str], word: str) -> int | None:
    """A count that two readings agree on: digit by digit, each exactly one, and as a word."""
    joined = "".join(d.strip() for d in by_digit)
    single = all(len(d.strip()) == 1 and d.strip() in "0123456789" for d in by_digit)
    return int(joined) if single and joined and joined == "".join(c for c in word if c in "0123456789") and int(joined) > 0 else None


def over_images(df: DataFrame, kernel: Callable[[np.ndarray], dict], key: str, schema: str) -> DataFrame:
    """Applies a kernel to images (key, height, width, pixels as bytes); the kernel's dict makes the columns of schema besides the key."""

    def run(batches):
        for pdf in batches:
            rows = [{key: k, **kernel(np.frombuffer(p, np.uint8).reshape(h, w))} for k, h, w, p in zip(pdf[key], pdf["height"], pdf["width"], pdf["pixels"], strict=True)]
            if rows:
                yield pd.DataFrame(rows)

    return df.select(key, "height", "width", "pixels").mapInPandas(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
