"""Page image operators on grey arrays, and their Arrow forms.

Models and colour codecs stay outside; these need numpy alone.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters of the page preparation.
WINDOW, K, RANGE = 25, 0.2, 0.5
WHITE, PADDING, HEIGHT, RATIO = 250, 10, 384, 10.0
CLIP, TILES = 2.0, 8
DOUBLE, CUT_MARGIN = 1.2, 20
NOISE_AREA = 40 * 10
LEAST_ANGLE, PIPELINE_ANGLE, MOST_ANGLE = 0.1, 0.5, 10.0
VOTES, LINE_LENGTH, LINE_GAP = 100, 100, 20
#: Degrees between the angles that are tried.
ANGLE_STEP = 0.25
#: Weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)

SCHEMA = "page_id string, height int, width int, pixels binary"


def grey(image: np.ndarray, order: str = "BGR") -> np.ndarray:
    """Two dimensions: a colour image's luma, the only or first channel of others."""
    if image.ndim == 2:
        return image
    if image.ndim != 3:
        raise TypeError(f"an image has 2 or 3 dimensions, not {image.ndim}")
    if image.shape[2] not in (3, 4):
        return image[:, :, 0]
    r, g, b = (image[:, :, order.index(c)].astype(np.float64) for c in "RGB")
    return np.clip(np.rint(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b), 0, 255).astype(np.uint8)


def otsu_threshold(image: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between both sides."""
    h = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def otsu(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu_threshold(image), 255, 0).astype(np.uint8)


def sauvola(image: np.ndarray, window: int = WINDOW, k: float = K) -> np.ndarray:
    """255 above the local threshold mean * (1 + k * (deviation / range - 1)), by integral images over mirrored borders."""
    window += window % 2 == 0
    x, half = image.astype(np.float64) / 255.0, window // 2
    p = np.pad(x, half, mode="reflect" if min(x.shape) > half else "symmetric")

    def sums(a: np.ndarray) -> np.ndarray:
        s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]

    mean = sums(p) / window**2
    deviation = np.sqrt(np.maximum(sums(p * p) / window**2 - mean**2, 0))
    return np.where(x > mean * (1 + k * (deviation / RANGE - 1)), 255, 0).astype(np.uint8)


def clahe(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited equalisation in tiles, mapped bilinearly between their centres (Zuiderveld, 1994)."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) > 1 else "edge")
    area = th * tw
    limit = max(1, int(clip * area / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + excess // 256
            rest = excess % 256
            if rest:
                hist[:: max(1, 256 // rest)][:rest] += 1
            maps[i, j] = np.clip(np.rint(hist.cumsum() * 255.0 / area), 0, 255)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, th), between(w, tw)
    fy, fx = fy[:, None], fx[None, :]
    get = lambda a, b: maps[a[:, None], b[None, :], image]
    out = (get(y0, x0) * (1 - fx) + get(y0, x1) * fx) * (1 - fy) + (get(y1, x0) * (1 - fx) + get(y1, x1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def crop_white(image: np.ndarray, padding: int = PADDING, white: int = WHITE) -> np.ndarray:
    """The box around all that is not white, padded; a white page as it is."""
    ink = grey(image) <= white
    rows, cols = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    if not len(rows):
        return image.copy()
    return image[max(0, rows[0] - padding) : rows[-1] + 1 + padding, max(0, cols[0] - padding) : cols[-1] + 1 + padding]


def _cubic(t: np.ndarray) -> np.ndarray:
    a, t = -0.75, np.abs(t)
    return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a, 0.0))


def _sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cubic interpolation at places given for each pixel, borders repeated."""
    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros(y.shape)
    h, w = image.shape
    for dy in range(-1, 3):
        wy = _cubic(y - (iy + dy))
        row = np.clip(iy + dy, 0, h - 1)
        for dx in range(-1, 3):
            out += wy * _cubic(x - (ix + dx)) * image[row, np.clip(ix + dx, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def target_size(height: int, width: int, target: int = HEIGHT, ratio: float | None = RATIO) -> tuple[int, int]:
    """(height, width) of a line scaled to the target height, its width capped."""
    new = int(width * (target / height))
    return target, int(target * ratio) if ratio and new / target > ratio else new


def resize(image: np.ndarray, target: int = HEIGHT, ratio: float | None = RATIO) -> np.ndarray:
    if not image.shape[0]:
        return image.copy()
    h, w = target_size(*image.shape, target, ratio)
    y = (np.arange(h) + 0.5) * image.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * image.shape[1] / max(1, w) - 0.5
    return _sampled(image, np.broadcast_to(y[:, None], (h, w)), np.broadcast_to(x[None, :], (h, w)))


def is_double(height: int, width: int) -> bool:
    return (width / height if height > 0 else 0) > DOUBLE


def split_double(image: np.ndarray, margin: int = CUT_MARGIN) -> tuple[np.ndarray, np.ndarray]:
    if not is_double(*image.shape[:2]):
        raise ValueError("not a double page")
    mid = image.shape[1] // 2
    return image[:, : mid + margin], image[:, mid - margin :]


def remove_noise(image: np.ndarray, area: int = NOISE_AREA) -> np.ndarray:
    """Keeps bright components, joined along edges, of at least this many pixels."""
    ink, out = image > 128, np.zeros(image.shape, np.uint8)
    seen = ~ink
    h, w = image.shape
    for y0, x0 in zip(*np.nonzero(ink), strict=True):
        if seen[y0, x0]:
            continue
        seen[y0, x0], part, queue = True, [(y0, x0)], deque([(y0, x0)])
        while queue:
            y, x = queue.popleft()
            for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= a < h and 0 <= b < w and not seen[a, b]:
                    seen[a, b] = True
                    part.append((a, b))
                    queue.append((a, b))
        if len(part) >= area:
            out[tuple(np.array(part).T)] = 255
    return out


def edges(image: np.ndarray) -> np.ndarray:
    """Where ink, as Otsu's threshold parts it, meets paper above, below, left or right."""
    ink = np.pad(image <= otsu_threshold(image), 1, mode="edge")
    inner = ink[1:-1, 1:-1]
    return inner & ~(ink[:-2, 1:-1] & ink[2:, 1:-1] & ink[1:-1, :-2] & ink[1:-1, 2:])


def line_angles(image: np.ndarray, most: float = MOST_ANGLE) -> np.ndarray:
    """Angles in degrees of the straight edges that are nearly level.

    Each edge pixel votes, for each angle, for its distance from the origin; a line is a
    peak of votes whose pixels run on for long enough without a large gap.
    """
    y, x = np.nonzero(edges(image))
    if len(x) < VOTES:
        return np.empty(0)
    angles = np.arange(-most, most + ANGLE_STEP / 2, ANGLE_STEP)
    reach = int(np.hypot(*image.shape)) + 1
    votes = np.zeros((len(angles), 2 * reach + 1), np.int32)
    for k, a in enumerate(np.radians(angles)):
        votes[k] = np.bincount(np.rint(y * np.cos(a) - x * np.sin(a)).astype(np.int64) + reach, minlength=2 * reach + 1)
    around = np.pad(votes, ((1, 1), (2, 2)))
    top = np.max([around[i : i + votes.shape[0], j : j + votes.shape[1]] for i in range(3) for j in range(5)], axis=0)
    least = max(image.shape[1] // 4, LINE_LENGTH)
    found = []
    for k, r in zip(*np.nonzero((votes >= VOTES) & (votes == top)), strict=True):
        a = np.radians(angles[k])
        on = np.abs(y * np.cos(a) - x * np.sin(a) + reach - r) <= 0.5
        at = np.sort(x[on] * np.cos(a) + y[on] * np.sin(a))
        runs = np.split(at, np.flatnonzero(np.diff(at) > LINE_GAP) + 1)
        if max(part[-1] - part[0] for part in runs) >= least:
            found.append(angles[k])
    return np.array(found)


def detect_skew(image: np.ndarray, most: float = MOST_ANGLE) -> float:
    """By how many degrees a page's lines are turned; 0 where no line is found."""
    return median_skew(line_angles(grey(image), most), most)


def median_skew(angles: np.ndarray, most: float = MOST_ANGLE) -> float:
    """The median of the nearly level angles, 0 where there is none."""
    level = angles[(angles > -most) & (angles < most)]
    return float(np.median(level)) if len(level) else 0.0


def deskew(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned by the angle on a canvas that holds all of it; small angles change nothing."""
    if abs(angle) < LEAST_ANGLE:
        return image.copy()
    h, w = image.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    cx, cy = w // 2, h // 2
    x, y = np.meshgrid(np.arange(nw) - (nw - w) / 2 - cx, np.arange(nh) - (nh - h) / 2 - cy)
    return _sampled(image, s * x + c * y + cy, c * x - s * y + cx)


def prepare(image: np.ndarray, *, angle: float | None = None, contrast: bool = True, binarise: bool = False, crop: bool = True, target: int | None = None) -> np.ndarray:
    """Deskew (by the angle that is found, if none is given), contrast, binarise (off unless asked for), crop, resize: in this order."""
    out = grey(image)
    angle = detect_skew(out) if angle is None else angle
    if abs(angle) > PIPELINE_ANGLE:
        out = deskew(out, angle)
    if contrast:
        out = clahe(out)
    if binarise:
        out = sauvola(out)
    if crop:
        out = crop_white(out)
    return resize(out, target) if target else out


def png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.pad(image, ((0, 0), (1, 0))).tobytes()  # each row begins with its filter, none
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def mapped(images: DataFrame, function, **options) -> DataFrame:
    """Applies an operator to (page_id, height, width, pixels), grey bytes by rows, a page at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                made = function(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width), **options)
                for x in made if isinstance(made, tuple) else (made,):
                    rows.append((r.page_id, x.shape[0], x.shape[1], x.tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "height", "width", "pixels"])

    return images.select("page_id", "height", "width", "pixels").mapInPandas(run, SCHEMA)


def statistics(images: DataFrame) -> DataFrame:
    """(page_id, height, width, mean, std, min, max, ratio); std is the population's."""

    @F.pandas_udf("mean double, std double, min int, max int")
    def of(pixels: pd.Series) -> pd.DataFrame:
        x = [np.frombuffer(p, np.uint8) for p in pixels]
        return pd.DataFrame({"mean": [float(v.mean()) for v in x], "std": [float(v.std()) for v in x], "min": [int(v.min()) for v in x], "max": [int(v.max()) for v in x]})

    ratio = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(0.0)
    return images.select("page_id", "height", "width", of("pixels").alias("s"), ratio.alias("ratio")).select("page_id", "height", "width", "s.*", "ratio")


def line_crops(pages: DataFrame, lines: DataFrame, *, target: int = HEIGHT) -> DataFrame:
    """(page_id, line_id, height, width, pixels): the crops of a page's lines; boxes are cut to the page, empty ones skipped.

    A page's boxes travel to its image as one array, so no image is copied for each line.
    """
    boxes = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "line_id", "x0", "y0", "x1", "y1"))).alias("boxes"))
    out = T.StructType.fromDDL("page_id string, line_id string, height int, width int, pixels binary")
    names = out.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                page = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
                for b in r.boxes:
                    part = page[max(0, b["y0"]) : min(r.height, b["y1"]), max(0, b["x0"]) : min(r.width, b["x1"])]
                    if part.size:
                        x = resize(part, target, None)
                        rows.append((r.page_id, b["line_id"], x.shape[0], x.shape[1], x.tobytes()))
            yield pd.DataFrame(rows, columns=names)

    return pages.join(boxes, "page_id").select("page_id", "height", "width", "pixels", "boxes").mapInPandas(run, out)


def otsu_thresholds(pixels: DataFrame) -> DataFrame:
    """(page_id, threshold) from rows (page_id, level, n): the histogram form, in SQL."""
    from pyspark.sql import Window

    up = Window.partitionBy("page_id").orderBy("level")
    whole = Window.partitionBy("page_id")
    h = pixels.groupBy("page_id", "level").agg(F.sum("n").cast("double").alias("n"))
    h = h.withColumns({"b": F.sum("n").over(up), "m": F.sum(F.col("n") * F.col("level")).over(up), "bt": F.sum("n").over(whole), "mt": F.sum(F.col("n") * F.col("level")).over(whole)})
    a = F.col("bt") - F.col("b")
    between = F.when(a > 0, F.col("b") * a * F.pow(F.col("m") / F.col("b") - (F.col("mt") - F.col("m")) / F.when(a > 0, a), 2)).otherwise(0.0)
    return h.withColumn("v", between).groupBy("page_id").agg(F.min_by("level", F.struct(-F.col("v"), "level")).alias("threshold"))
