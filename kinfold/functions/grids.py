"""Kernels on pixel grids: an array of ints, row after row, with a width and a height known to the plan.

Each function takes Columns and gives a Column of built-in expressions. Values that a lambda needs for every pixel are
columns of their own, computed once a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8
#: Frequencies of the cosine hash in either direction.
LOW = 8


def round_half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity, negative ones too."""
    return F.floor(c + 0.5)


def gray(r: Column, g: Column, b: Column) -> Column:
    return round_half_up(r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def grid_of_vector(vector: Column) -> Column:
    """A gray grid of a vector: components from -1/4 to 1/4 spread over 0 to 255."""
    return F.transform(vector, lambda e: round_half_up((F.least(F.lit(1.0), F.greatest(F.lit(-1.0), e.cast("double") * 4)) + 1) / 2 * 255).cast("int"))


def turned(grid: Column, by: int) -> Column:
    """The grid read from position ``by`` on, and around."""
    return F.concat(F.slice(grid, by + 1, 10**6), F.slice(grid, 1, by)) if by else grid


def mean(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0).cast("long"), lambda a, x: a + x).cast("double") / F.size(grid)


def fold_bits(n: int, bit) -> Column:
    """A long with bit i set where bit(i) holds, the lowest first."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(bit(i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def average_hash(grid: Column, average: Column, side: int = SIDE, high_first: bool = False) -> Column:
    """Pixels from the average on. ``high_first``: the first pixel is the highest bit."""
    n = side * side
    return fold_bits(n, lambda i: F.get(grid, n - 1 - i if high_first else i) >= average)


def difference_hash(grid: Column, width: int = SIDE, height: int = SIDE, high_first: bool = False) -> Column:
    """Pixels above their right neighbour, row after row; a grid of 9 x 8 gives 64 bits."""
    n = height * (width - 1)

    def at(i: Column) -> Column:
        return F.floor(i / (width - 1)).cast("int") * width + i % (width - 1)

    return fold_bits(n, lambda i: F.get(grid, at(n - 1 - i if high_first else i)) > F.get(grid, at(n - 1 - i if high_first else i) + 1))


def enlarged(grid: Column, side: int, times: int) -> Column:
    """Each pixel as a square of ``times`` pixels."""
    wide = side * times
    return F.transform(F.sequence(F.lit(0), F.lit(wide * wide - 1)), lambda i: F.get(grid, (F.floor(F.floor(i / wide) / times) * side + F.floor((i % wide) / times)).cast("int")))


def cosine_hash(grid: Column, high_first: bool = False) -> Column:
    """The low frequencies of a square grid above their mean, the constant part left out: 63 bits, or 64 with the first
    place empty and highest where ``high_first``. Products of matrices, a batch at a time."""

    @F.arrow_udf("long")
    def fold(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros(len(sizes), np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for i, end in enumerate(np.cumsum(sizes.astype(np.int64))):
            n = int(round(float(sizes[i]) ** 0.5))
            u = np.arange(min(LOW, n // 2))[:, None]
            basis = np.cos((2 * np.arange(n)[None] + 1) * u * np.pi / (2 * n)) * np.where(u == 0, 1, np.sqrt(2)) / np.sqrt(n)
            low = (basis @ flat[end - n * n : end].reshape(n, n) @ basis.T).ravel()
            bits = low >= low[1:].mean() if high_first else low > low[1:].mean()
            places = np.arange(len(low))
            value = sum(1 << int(len(low) - 1 - k if high_first else k - 1) for k in places[1:][bits[1:]])
            out[i] = value - (1 << 64) if value >= 1 << 63 else value
        return pa.array(out)

    return fold(grid)


def merged_boxes(boxes: Column) -> Column:
    """Boxes (x, y, width, height, weight) of one item, overlapping ones as one around both with the larger weight, until
    none overlap; largest first."""
    kind = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("weight", pa.float64())])

    def merge(rest: list[dict]) -> list[dict]:
        rest, out = sorted(rest, key=lambda b: -b["width"] * b["height"]), []
        while rest:
            now = dict(rest.pop(0))
            while True:
                other = next((b for b in rest if b["x"] < now["x"] + now["width"] and now["x"] < b["x"] + b["width"] and b["y"] < now["y"] + now["height"] and now["y"] < b["y"] + b["height"]), None)
                if other is None:
                    break
                rest.remove(other)
                x, y = min(now["x"], other["x"]), min(now["y"], other["y"])
                right, low = max(now["x"] + now["width"], other["x"] + other["width"]), max(now["y"] + now["height"], other["y"] + other["height"])
                now = {"x": x, "y": y, "width": right - x, "height": low - y, "weight": max(now["weight"], other["weight"])}
            out.append(now)
        return out

    @F.arrow_udf("array<struct<x:int,y:int,width:int,height:int,weight:double>>")
    def fold(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else merge(b) for b in column.to_pylist()], pa.list_(kind))

    return fold(boxes)


def block_means(grid: Column, side: int = SIDE) -> Column:
    """The mean of the block that each pixel is in; blocks are a quarter of the side, 2 at least."""
    size = max(2, side // 4)
    rows = range(side)
    means = {}
    for by in range(0, side, size):
        for bx in range(0, side, size):
            cells = [y * side + x for y in rows[by : by + size] for x in rows[bx : bx + size]]
            means[by // size, bx // size] = sum((F.get(grid, F.lit(i)) for i in cells), F.lit(0)) / len(cells)
    return F.array(*[means[y // size, x // size] for y in rows for x in rows])


def block_hash(grid: Column, means: Column, side: int = SIDE) -> Column:
    return fold_bits(side * side, lambda i: F.get(grid, i) > F.get(means, i))


def hex_of(bits: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(bits)), digits, "0")


def interior(width: int, height: int) -> list[int]:
    return [y * width + x for y in range(1, height - 1) for x in range(1, width - 1)]


def over_interior(grid: Column, width: int, height: int, value) -> Column:
    """value(at) at each inner pixel, where at(dx, dy) is the pixel beside it."""
    inner = F.array(*[F.lit(i) for i in interior(width, height)])
    return F.transform(inner, lambda i: value(lambda dx=0, dy=0: F.get(grid, i + (dx + dy * width))))


def histogram(grid: Column, bins: int = 8) -> Column:
    """Share of pixels in each of ``bins`` ranges of 0 to 255."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(grid, lambda p: F.floor(p * bins / 256) == b)) / F.size(grid))


def texture(grid: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Shares of the 16 local binary patterns of four neighbours, over the inner pixels."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    codes = over_interior(grid, width, height, lambda at: bit(at(0, -1) >= at(), 1) + bit(at(0, 1) >= at(), 2) + bit(at(-1, 0) >= at(), 4) + bit(at(1, 0) >= at(), 8))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(codes, lambda c: c == b)) / float((width - 2) * (height - 2)))


def sobel(grid: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Gradient of the inner pixels, 255 at most, rounded to whole numbers."""

    def value(at):
        gx = -at(-1, -1) + at(1, -1) - 2 * at(-1, 0) + 2 * at(1, 0) - at(-1, 1) + at(1, 1)
        gy = -at(-1, -1) - 2 * at(0, -1) - at(1, -1) + at(-1, 1) + 2 * at(0, 1) + at(1, 1)
        return F.round(F.least(F.lit(255.0), F.sqrt((gx * gx + gy * gy).cast("double")))).cast("int")

    return over_interior(grid, width, height, value)


def sharpened(grid: Column, amount: float, width: int = SIDE, height: int = SIDE) -> Column:
    """Sharpening by the four neighbours, inner pixels, within 0 to 255."""
    return over_interior(grid, width, height, lambda at: F.greatest(F.lit(0.0), F.least(F.lit(255.0), at() * (1 + 4 * amount) - amount * (at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0)))))


def laplacian(grid: Column, width: int = SIDE, height: int = SIDE) -> Column:
    return over_interior(grid, width, height, lambda at: 4 * at() - at(0, -1) - at(0, 1) - at(-1, 0) - at(1, 0))


def edge_ratio(grid: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Share of pixels whose differences to the right and below exceed 30 together."""
    edges = over_interior(grid, width, height, lambda at: F.when(F.abs(at() - at(1, 0)) + F.abs(at() - at(0, 1)) > 30, 1).otherwise(0))
    return F.size(F.filter(edges, lambda e: e == 1)) / float(width * height)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def quality_by_curves(grid: Column, average: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Sharpness, brightness, contrast and score of a gray grid, by the Laplacian and two curves."""
    edge = total(F.transform(laplacian(grid, width, height), lambda v: F.sqrt((3 * v * v).cast("double"))))
    sharpness = F.least(F.lit(100.0), F.greatest(F.lit(0.0), edge / (width * height) / 5)) * 1.2
    brightness = F.least(F.lit(100.0), F.greatest(F.lit(0.0), average / 255 * 100))
    contrast = F.sqrt(total(F.transform(grid, lambda v: (v - average) * (v - average))) / (width * height)) / 255 * 100
    bright = F.when(brightness > 50, (1 - F.abs(brightness - 65) / 35) * 100).otherwise(brightness * 1.5)
    depth = F.when(contrast > 15, (1 - F.abs(contrast - 25) / 25) * 100).otherwise(contrast * 5)
    score = F.least(F.lit(100.0), round_half_up(sharpness * 0.5 + bright * 0.25 + depth * 0.25))
    return F.struct(round_half_up(sharpness).cast("int").alias("sharpness"), round_half_up(brightness).cast("int").alias("brightness"), round_half_up(contrast).cast("int").alias("contrast"), score.cast("int").alias("score"))


def quality_by_samples(grid: Column, average: Column, file_size: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """The other quality score: brightness, contrast, edges at a step, resolution and file size."""
    contrast = F.sqrt(total(F.transform(grid, lambda v: (v - average) * (v - average))) / F.size(grid))
    step = max(2, int((width * height) ** 0.5 / 50))
    pairs, samples = [], 0
    for y in range(1, height - 1, step):
        for x in range(1, width - 1, step):
            samples += 2
            if x + step < width:
                pairs.append((y * width + x, y * width + x + step))
            if y + step < height:
                pairs.append((y * width + x, (y + step) * width + x))
    edges = sum((F.when(F.abs(F.get(grid, F.lit(a)) - F.get(grid, F.lit(b))) > 20, 1).otherwise(0) for a, b in pairs), F.lit(0))
    sharp = F.least(F.lit(100.0), edges / float(samples) * 200)
    bright = F.greatest(F.lit(0.0), 100 - F.abs(average - 128) / 128 * 100)
    depth = F.least(F.lit(100.0), contrast / 50 * 100)
    area = min(100.0, width * height / 2073600 * 50)
    weight = F.least(F.lit(100.0), F.when(file_size > 0, file_size / 1048576 * 25).otherwise(50.0))
    return round_half_up(bright * 0.2 + depth * 0.2 + sharp * 0.3 + area * 0.2 + weight * 0.1).cast("int")


def visual_complexity(r: Column, g: Column, b: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Edges and colours of the inner pixels, 0 to 100."""
    inner = F.array(*[F.lit(i) for i in interior(width, height)])

    def change(i: Column) -> Column:
        parts = [F.abs(F.get(c, i) - F.get(c, i - width)) + F.abs(F.get(c, i) - F.get(c, i + 1)) for c in (r, g, b)]
        return (parts[0] + parts[1] + parts[2]) / 6 > 20

    edges = F.size(F.filter(inner, change)) / float(width * height)
    colours = F.size(F.array_distinct(F.transform(inner, lambda i: F.floor(F.get(r, i) / 16) * 256 + F.floor(F.get(g, i) / 16) * 16 + F.floor(F.get(b, i) / 16))))
    return F.least(F.lit(100.0), round_half_up((edges * 70 + F.least(colours / 256.0, F.lit(1.0)) * 30) * 100)).cast("int")


def fit_inside(width: Column, height: Column, most: int) -> Column:
    """Width and height scaled so that the longer side is ``most`` at most."""
    wide = (width > height) & (width > most)
    tall = ~wide & (height > most)
    return F.struct(
        F.when(wide, F.lit(float(most))).when(tall, width * float(most) / height).otherwise(width.cast("double")).alias("width"),
        F.when(wide, height * float(most) / width).when(tall, F.lit(float(most))).otherwise(height.cast("double")).alias("height"),
    )


def adjustments(brightness: Column, contrast: Column, sharpness: Column) -> Column:
    """What a picture needs: brightness 20 up below 40 or 10 down above 80, contrast 15 up below 30, sharpness 25 up below 50."""
    return F.struct(
        F.when(brightness < 40, 20).when(brightness > 80, -10).otherwise(0).alias("brightness"),
        F.when(contrast < 30, 15).otherwise(0).alias("contrast"),
        F.when(sharpness < 50, 25).otherwise(0).alias("sharpness"),
    )


def bilinear(grid: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """The grid resized by bilinear interpolation, rounded."""

    def weight(size: int, to: int, k: int) -> tuple[int, int, float]:
        at = k * (size - 1) / max(1, to - 1)
        low = min(int(at), size - 1)
        return low, min(low + 1, size - 1), at - low

    cells = []
    for y in range(to_height):
        y0, y1, v = weight(height, to_height, y)
        for x in range(to_width):
            x0, x1, u = weight(width, to_width, x)
            corner = [F.get(grid, F.lit(i)) for i in (y0 * width + x0, y0 * width + x1, y1 * width + x0, y1 * width + x1)]
            share = [(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v]
            cells.append(round_half_up(sum((c * w for c, w in zip(corner[1:], share[1:], strict=True)), corner[0] * share[0])).cast("int"))
    return F.array(*cells)
