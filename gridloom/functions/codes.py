"""Spatial codes: tiles, quadkeys, geohashes, locators, curves and cells, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geodesy import unit_vector
from gridloom.functions.projections import web_mercator

# Fixed values
GEOHASH_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"
PLUS_LETTERS = "23456789CFGHJMPQRVWX"
PLUS_STEPS = (20.0, 1.0, 0.05, 0.0025, 0.000125)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOCATOR_SPANS = ((20.0, 10.0), (2.0, 1.0), (5.0 / 60.0, 2.5 / 60.0), (5.0 / 600.0, 2.5 / 600.0))
MERCATOR_RADIUS_M = 6378137.0
EQUATOR_M = 40075016.686


def letter(alphabet: str, index: Column) -> Column:
    return F.substring(F.lit(alphabet), (index + 1).cast("int"), F.lit(1))


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    x, y = web_mercator(lat, lon)
    n = 1 << zoom
    return F.least((x * n).cast("long"), F.lit(n - 1)), F.least((y * n).cast("long"), F.lit(n - 1))


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east."""
    n = 1 << zoom
    lat = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return lat(y + 1), x / n * 360.0 - 180.0, lat(y), (x + 1) / n * 360.0 - 180.0


def ground_resolution(lat: Column, zoom: int, pixels: int = 256) -> Column:
    return F.cos(F.radians(lat)) * (2 * math.pi * MERCATOR_RADIUS_M) / (pixels * (1 << zoom))


def metres_per_pixel(lat: Column, zoom: float) -> Column:
    return EQUATOR_M * F.cos(F.radians(lat)) / (256 * 2.0**zoom)


def interleaved(x: Column, y: Column, bits: int) -> Column:
    """Morton number: the bits of x at even places, of y at odd ones; up to 31 bits each."""
    total = F.lit(0).cast("long")
    for b in range(bits):
        total = total + F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), 2 * b) + F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1)), 2 * b + 1)
    return total


def deinterleaved(code: Column, bits: int) -> tuple[Column, Column]:
    part = lambda odd: sum((F.shiftleft(F.shiftright(code, 2 * b + odd).bitwiseAND(F.lit(1)), b) for b in range(bits)), F.lit(0).cast("long"))
    return part(0), part(1)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    digits = [F.shiftright(x, b).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, b).bitwiseAND(F.lit(1)) for b in reversed(range(zoom))]
    return F.concat(*[d.cast("string") for d in digits])


def digits_of(code: Column, alphabet: str, length: int, start: int = 1) -> list[Column]:
    """The places of a code's characters in its alphabet; null where one is not in it."""
    at = [F.instr(F.lit(alphabet), F.substring(code, start + k, 1)) - 1 for k in range(length)]
    return [F.when(a >= 0, a.cast("long")) for a in at]


def quadkey_tile(key: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of a quadkey of ``zoom`` digits."""
    d = digits_of(key, "0123", zoom)
    part = lambda b: sum((F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), zoom - 1 - k) for k, v in enumerate(d)), F.lit(0).cast("long"))
    return part(0), part(1)


def quadkey_parent(key: Column) -> Column:
    return F.when(F.length(key) > 0, F.substring(key, F.lit(1), F.length(key) - 1))


def quadkey_children(key: Column) -> Column:
    return F.array(*[F.concat(key, F.lit(d)) for d in "0123"])


def to_pixels(lat: Column, lon: Column, zoom: float) -> tuple[Column, Column]:
    """Pixels from the map's north-west corner."""
    scale = 256 * 2.0**zoom
    phi = F.radians(lat)
    return (lon + 180) / 360 * scale, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * scale


def from_pixels(x: Column, y: Column, zoom: float) -> tuple[Column, Column]:
    scale = 256 * 2.0**zoom
    return F.degrees(F.atan(F.sinh(math.pi - 2 * math.pi * y / scale))), x / scale * 360 - 180


def fitting_zoom(south: Column, west: Column, north: Column, east: Column, width: int, height: int) -> Column:
    """The largest whole zoom at which a box fits a window of so many pixels, 0 at least; null for a box without extent."""
    (x0, y0), (x1, y1) = to_pixels(north, west, 0), to_pixels(south, east, 0)
    room = F.least(F.try_divide(F.lit(float(width)), x1 - x0), F.try_divide(F.lit(float(height)), y1 - y0))
    return F.when((north > south) & (east > west), F.greatest(F.lit(0), F.floor(F.log2(room)).cast("long")))


def quadkey_cover(x0: Column, y0: Column, x1: Column, y1: Column, zoom: int) -> Column:
    """The fewest quadkeys that are exactly the tiles x0..x1, y0..y1 of ``zoom``: array of structs (key, level), shorter keys where all four children belong.

    At each level the squares inside the range are a rectangle, and so are those whose parent is inside too; what lies between the two are four strips, so work
    grows with the range's rim and not with its tiles.
    """
    parts = []
    for up in range(zoom + 1):
        # columns a..b and rows c..d of the squares inside; of those, a2..b2 and c2..d2 have their parent inside
        a, b, c, d = first_in(x0, up), last_in(x1, up), first_in(y0, up), last_in(y1, up)
        a2, b2, c2, d2 = 2 * first_in(x0, up + 1), 2 * last_in(x1, up + 1) + 1, 2 * first_in(y0, up + 1), 2 * last_in(y1, up + 1) + 1
        whole = (a2 <= b2) & (c2 <= d2) if up < zoom else F.lit(False)
        strips = [(a, b, c, c2 - 1), (a, b, d2 + 1, d), (a, a2 - 1, c2, d2), (b2 + 1, b, c2, d2)]
        box = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
        boxes = F.filter(F.when(whole, F.array(*[box(*s) for s in strips])).otherwise(F.array(box(a, b, c, d))), lambda s: (s["a"] <= s["b"]) & (s["c"] <= s["d"]))
        level = zoom - up
        cells = F.flatten(F.transform(boxes, squares))
        # the functions run at once, while ``level`` is this level
        parts.append(F.transform(cells, lambda t: F.struct((quadkey(t["i"], t["j"], level) if level else F.lit("")).alias("key"), F.lit(level).alias("level"))))  # noqa: B023
    return F.concat(*parts)


def squares(box: Column) -> Column:
    """All (i, j) of a box of columns a..b and rows c..d."""
    column = lambda i: F.transform(F.sequence(box["c"], box["d"]), lambda j: F.struct(i.alias("i"), j.alias("j")))
    return F.flatten(F.transform(F.sequence(box["a"], box["b"]), column))


def first_in(low: Column, up: int) -> Column:
    """The first square of 2**up tiles a side that begins at ``low`` or after."""
    return F.shiftright(low + ((1 << up) - 1), up)


def last_in(high: Column, up: int) -> Column:
    """The last one that ends at ``high`` or before."""
    return F.shiftright(high + 1, up) - 1


def front_coded(codes: DataFrame, code: str, block: str, length: int) -> DataFrame:
    """``codes`` with shared and suffix: in each block, in order of the code, how many leading characters the one before has too, and the rest."""
    before = F.lag(code).over(Window.partitionBy(block).orderBy(code, "id"))
    same = [F.when(F.substring(code, 1, k) == F.substring(before, 1, k), 1).otherwise(0) for k in range(1, length + 1)]
    coded = codes.withColumn("shared", sum(same[1:], same[0]).cast("long"))
    return coded.withColumn("suffix", F.substring(F.col(code), F.col("shared").cast("int") + 1, F.lit(length)))


def front_decoded(coded: DataFrame, block: str, order: list[str], length: int) -> DataFrame:
    """``coded`` (shared, suffix) with code restored: each character is that of the last row so far whose suffix reaches to its place. Null where a
    row shares more than the one before has."""
    so_far = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda k: F.substring(F.col("suffix"), F.lit(k) - F.col("shared").cast("int"), F.lit(1))
    characters = [F.last(F.when(F.col("shared") < k, at(k)), ignorenulls=True).over(so_far) for k in range(1, length + 1)]
    whole = F.col("shared") + F.length("suffix")
    fits = F.col("shared") <= F.coalesce(F.lag(whole).over(Window.partitionBy(block).orderBy(*order)), F.lit(0))
    return coded.withColumn("code", F.when(fits, F.substring(F.concat(*characters), F.lit(1), whole.cast("int"))))


def hilbert_cell(d: Column, order: int) -> tuple[Column, Column]:
    """Cell at a distance along the curve: ``hilbert`` from the smallest square outwards."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), d.cast("long").alias("t"))

    def level(s: Column, b: Column) -> Column:
        side = F.pow(F.lit(2.0), b).cast("long")
        rx = F.shiftright(s["t"], 1).bitwiseAND(F.lit(1))
        ry = s["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1))
        flip, swap = (ry == 0) & (rx == 1), ry == 0
        fx, fy = F.when(flip, side - 1 - s["x"]).otherwise(s["x"]), F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct((F.when(swap, fy).otherwise(fx) + side * rx).alias("x"), (F.when(swap, fx).otherwise(fy) + side * ry).alias("y"), F.shiftright(s["t"], 2).alias("t"))

    cell = F.aggregate(F.array(*[F.lit(b) for b in range(order)]), start, level)
    return cell["x"], cell["y"]


def hilbert_steps() -> list[int]:
    """Three levels of the curve at once: what a state and three bits of x and of y give, as the six bits of the distance and the next state. A state is two bits:
    whether bits are flipped, and whether x and y are swapped."""
    out = []
    for state, x, y in ((s, x, y) for s in range(4) for x in range(8) for y in range(8)):
        flip, swap, d = state >> 1, state & 1, 0
        for b in (2, 1, 0):
            rx, ry = x >> b & 1 ^ flip, y >> b & 1 ^ flip
            if swap:
                rx, ry = ry, rx
            d = d * 4 + (3 * rx ^ ry)
            if not ry:
                flip, swap = flip ^ rx, swap ^ 1
        out.append(d << 2 | flip << 1 | swap)
    return out


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Distance along the Hilbert curve, three levels a look-up, so it stays inside code generation; null where a coordinate is."""
    x, y, steps = x.cast("long"), y.cast("long"), F.array(*[F.lit(v) for v in hilbert_steps()])
    # levels of zeros before the first only swap
    pad, parts = -order % 3, -(-order // 3)
    state, d = F.lit(pad & 1), F.lit(0).cast("long")
    for k in reversed(range(parts)):
        part = lambda v, k=k: F.shiftright(v, 3 * k).bitwiseAND(F.lit(7 >> pad if k == parts - 1 else 7)).cast("int")
        step = F.get(steps, state * 64 + part(x) * 8 + part(y))
        state, d = step.bitwiseAND(F.lit(3)), d + F.shiftleft(F.shiftright(step, 2).cast("long"), 6 * k)
    return d


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Five bits a letter, longitude first; a bit is 1 from the middle on."""
    bits = 5 * precision
    nx, ny = -(-bits // 2), bits // 2
    ix = F.least(F.floor((lon + 180.0) / 360.0 * 2.0**nx), F.lit(2**nx - 1))
    iy = F.least(F.floor((lat + 90.0) / 180.0 * 2.0**ny), F.lit(2**ny - 1))
    out = []
    for k in range(precision):
        value = F.lit(0)
        for b in range(5 * k, 5 * k + 5):
            bit = F.shiftright(ix, nx - 1 - b // 2) if b % 2 == 0 else F.shiftright(iy, ny - 1 - b // 2)
            value = value * 2 + bit.bitwiseAND(F.lit(1))
        out.append(letter(GEOHASH_LETTERS, value))
    return F.concat(*out)


def geohash_bounds(code: Column, precision: int) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a code of ``precision`` letters: three bits of a letter go to one axis and two to the other, in turn."""
    ix, iy = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k, v in enumerate(digits_of(code, GEOHASH_LETTERS, precision)):
        bit = lambda b, v=v: F.shiftright(v, b).bitwiseAND(F.lit(1))
        three, two = bit(4) * 4 + bit(2) * 2 + bit(0), bit(3) * 2 + bit(1)
        ix, iy = (ix * 8 + three, iy * 4 + two) if k % 2 == 0 else (ix * 4 + two, iy * 8 + three)
    width, height = 360.0 / 2.0 ** -(-5 * precision // 2), 180.0 / 2.0 ** (5 * precision // 2)
    return iy * height - 90.0, ix * width - 180.0, (iy + 1) * height - 90.0, (ix + 1) * width - 180.0


def middle(bounds: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Latitude and longitude of a box's centre."""
    south, west, north, east = bounds
    return (south + north) / 2, (west + east) / 2


def geohash_around(lat: Column, lon: Column, precision: int) -> dict[str, Column]:
    """The eight cells round a position's own, by direction."""
    steps = {"n": (1, 0), "ne": (1, 1), "e": (0, 1), "se": (-1, 1), "s": (-1, 0), "sw": (-1, -1), "w": (0, -1), "nw": (1, -1)}
    return {name: geohash_neighbour(lat, lon, precision, *step) for name, step in steps.items()}


def geohash_step(lat: Column, lon: Column, precision: int, north: int, east: int) -> tuple[Column, Column]:
    """Centre of the cell so many cells north and east; longitude wraps, and latitude stays inside."""
    bits = 5 * precision
    width, height = 360.0 / 2.0 ** -(-bits // 2), 180.0 / 2.0 ** (bits // 2)
    y = F.least(F.greatest((F.floor((lat + 90.0) / height) + north + 0.5) * height - 90.0, F.lit(-90.0)), F.lit(90.0))
    return y, F.pmod((F.floor((lon + 180.0) / width) + east + 0.5) * width, F.lit(360.0)) - 180.0


def geohash_neighbour(lat: Column, lon: Column, precision: int, north: int, east: int) -> Column:
    """The code of the cell so many cells north and east."""
    return geohash(*geohash_step(lat, lon, precision, north, east), precision)


def plus_code(lat: Column, lon: Column) -> Column:
    """Ten characters with the plus sign after eight."""
    a = F.least(lat, F.lit(90.0 - 1e-9)) + 90.0
    b = F.when(lon == 180.0, -180.0).otherwise(lon) + 180.0
    out: list[Column] = []
    for step in PLUS_STEPS:
        i, j = F.floor(a / step), F.floor(b / step)
        out += [letter(PLUS_LETTERS, i), letter(PLUS_LETTERS, j)]
        if len(out) == 8:
            out.append(F.lit("+"))
        a, b = a - i * step, b - j * step
    return F.concat(*out)


def plus_bounds(code: Column) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a full code: ten letters, a plus sign after eight."""
    d = digits_of(F.replace(code, F.lit("+"), F.lit("")), PLUS_LETTERS, 2 * len(PLUS_STEPS))
    south = sum((d[2 * k] * step for k, step in enumerate(PLUS_STEPS)), F.lit(-90.0))
    west = sum((d[2 * k + 1] * step for k, step in enumerate(PLUS_STEPS)), F.lit(-180.0))
    return south, west, south + PLUS_STEPS[-1], west + PLUS_STEPS[-1]


def locator_bounds(code: Column, pairs: int = 3) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a locator; letters may be of either case."""
    south, west = F.lit(-90.0), F.lit(-180.0)
    for k, (w, h) in enumerate(LOCATOR_SPANS[:pairs]):
        i, j = digits_of(F.upper(code), LETTERS if k % 2 == 0 else "0123456789", 2, 2 * k + 1)
        south, west = south + j * h, west + i * w
    w, h = LOCATOR_SPANS[pairs - 1]
    return south, west, south + h, west + w


def within(lat: Column, lon: Column, bounds: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a box holds a position; its south and west edges belong to it."""
    south, west, north, east = bounds
    return (lat >= south) & (lat < north) & (lon >= west) & (lon < east)


def locator(lat: Column, lon: Column, pairs: int = 3) -> Column:
    """Maidenhead locator of two to eight characters."""
    a, b = F.least(lon, F.lit(180.0 - 1e-9)) + 180.0, F.least(lat, F.lit(90.0 - 1e-9)) + 90.0
    out: list[Column] = []
    for k, (w, h) in enumerate(LOCATOR_SPANS[:pairs]):
        i, j = F.floor(a / w), F.floor(b / h)
        out += [letter(LETTERS, i), letter(LETTERS, j)] if k % 2 == 0 else [i.cast("string"), j.cast("string")]
        a, b = a - i * w, b - j * h
    return F.concat(*out)


def sheet_name(col: Column, row: Column) -> Column:
    """Row letters (A to Z, then AA on) and the three-digit column, counted from 1."""
    one = letter(LETTERS, row)
    two = F.concat(letter(LETTERS, F.floor(row / 26) - 1), letter(LETTERS, row % 26))
    return F.concat(F.when(row < 26, one).otherwise(two), F.lpad((col + 1).cast("string"), 3, "0"))


def cube_cell(lat: Column, lon: Column, level: int) -> tuple[Column, Column, Column]:
    """Face and quadratic cell of a cube: face by the largest component, i and j at the level."""
    x, y, z = unit_vector(lat, lon)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    main = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    face = axis + F.when(main > 0, 0).otherwise(3)
    u = F.when(face == 0, F.try_divide(y, x)).when(face == 1, F.try_divide(-x, y)).when(face == 2, F.try_divide(-x, z)).when(face == 3, F.try_divide(z, x)).when(face == 4, F.try_divide(z, y)).otherwise(F.try_divide(y, z))
    v = F.when(face == 0, F.try_divide(z, x)).when(face == 1, F.try_divide(z, y)).when(face == 2, F.try_divide(-y, z)).when(face == 3, F.try_divide(y, x)).when(face == 4, F.try_divide(-x, y)).otherwise(F.try_divide(x, z))
    even = lambda w: F.when(w >= 0, F.sqrt(1 + 3 * F.greatest(w, F.lit(0.0))) - 1).otherwise(1 - F.sqrt(1 - 3 * F.least(w, F.lit(0.0))))
    n = 1 << level
    return face.cast("long"), F.least(((even(u) + 1) / 2 * n).cast("long"), F.lit(n - 1)), F.least(((even(v) + 1) / 2 * n).cast("long"), F.lit(n - 1))
