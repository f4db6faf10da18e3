"""Scalar and array column functions: guarded arithmetic, vectors, grids, optics, text cells, seeds.

ANSI mode raises on a division by zero; the guarded forms say in a flag whether a value is defined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int


def _c(x: ColumnLike) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _fold(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v.cast("double")))


# guarded arithmetic ---------------------------------------------------------------------------


def safe_div(a: ColumnLike, b: ColumnLike) -> Column:
    """struct(value, defined): a / b, or a with defined = false where b is 0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.struct(F.when(b != 0, a / F.when(b != 0, b)).otherwise(a).alias("value"), (b != 0).alias("defined"))


def safe_sqrt(x: ColumnLike) -> Column:
    """struct(value, defined): the root, or 1 with defined = false of a negative number."""
    x = _c(x).cast("double")
    return F.struct(F.when(x >= 0, F.sqrt(F.greatest(x, F.lit(0.0)))).otherwise(1.0).alias("value"), (x >= 0).alias("defined"))


def safe_mul(a: ColumnLike, b: ColumnLike) -> Column:
    """The product, where 0 times infinity is 0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a * b)


def safe_dot(a: Column, b: Column) -> Column:
    """The sum of safe products; +inf or -inf if only such products occur, NaN if both do."""
    p = F.zip_with(a, b, lambda x, y: safe_mul(x, y))
    up, down = F.exists(p, lambda v: v == float("inf")), F.exists(p, lambda v: v == float("-inf"))
    finite = _fold(F.filter(p, lambda v: F.abs(v) < float("inf")))
    return F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(finite)


def quadratic_roots(a: ColumnLike, b: ColumnLike, c: ColumnLike, ordered: bool = False) -> Column:
    """struct(first, second, defined) of a x^2 + b x + c = 0 with a other than 0, without cancellation."""
    a, b, c = (_c(x).cast("double") for x in (a, b, c))
    root = safe_sqrt(b * b - 4 * a * c)
    q = -0.5 * (b + F.when(b >= 0, root["value"]).otherwise(-root["value"]))
    x, y = F.try_divide(q, a), F.when(q != 0, F.try_divide(c, q)).otherwise(F.lit(0.0))
    first, second = (F.least(x, y), F.greatest(x, y)) if ordered else (x, y)
    return F.struct(first.alias("first"), second.alias("second"), root["defined"].alias("defined"))


def ordered_pair(x: ColumnLike, y: ColumnLike) -> Column:
    return F.struct(F.least(_c(x), _c(y)).alias("low"), F.greatest(_c(x), _c(y)).alias("high"))


# vectors (arrays of numbers) --------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm_squared(a: Column) -> Column:
    return _fold(a, lambda v: v * v)


def norm(a: Column) -> Column:
    return F.sqrt(norm_squared(a))


def unit(a: Column) -> Column:
    """The vector divided by its norm; null where the norm is 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n))


def norm_and_direction(a: Column) -> Column:
    return F.struct(norm(a).alias("norm"), unit(a).alias("direction"))


def modulus_squared(z: Column) -> Column:
    """Of struct(re, im)."""
    return z["re"] * z["re"] + z["im"] * z["im"]


def to_polar(x: ColumnLike, y: ColumnLike) -> Column:
    """struct(r, angle); the angle at the origin is 0."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.struct(F.hypot(x, y).alias("r"), F.when((x == 0) & (y == 0), 0.0).otherwise(F.atan2(y, x)).alias("angle"))


def from_polar(r: ColumnLike, angle: ColumnLike) -> Column:
    return F.struct((_c(r) * F.cos(_c(angle))).alias("x"), (_c(r) * F.sin(_c(angle))).alias("y"))


# numbers and grids ------------------------------------------------------------------------------


def next_power_of_two(n: ColumnLike) -> Column:
    """The smallest power of two that is at least n, 1 for n <= 1; exact, by the number of binary digits."""
    n = _c(n).cast("long")
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def next_multiple(m: ColumnLike, n: ColumnLike) -> Column:
    """The smallest multiple of m that is at least n."""
    return (F.ceil(_c(n) / _c(m)) * _c(m)).cast("long")


def index_to_world(index: ColumnLike, origin: ColumnLike, step: ColumnLike) -> Column:
    return _c(origin) + _c(index) * _c(step)


def world_to_index(point: ColumnLike, origin: ColumnLike, step: ColumnLike) -> Column:
    return (_c(point) - _c(origin)) / _c(step)


def quantize(point: ColumnLike, origin: ColumnLike, step: ColumnLike) -> Column:
    """struct(index, coordinate) of the nearest grid point; ties go to the even index."""
    i = F.rint(world_to_index(point, origin, step))
    return F.struct(i.cast("long").alias("index"), index_to_world(i, origin, step).alias("coordinate"))


def in_bounds(index: ColumnLike, n: ColumnLike) -> Column:
    return (_c(index) >= 0) & (_c(index) < _c(n))


def box_inside(i: ColumnLike, j: ColumnLike, half_i: ColumnLike, half_j: ColumnLike, height: ColumnLike, width: ColumnLike) -> Column:
    """Whether a box about (i, j) lies inside an image."""
    return (_c(i) - _c(half_i) >= 0) & (_c(i) + _c(half_i) <= _c(height) - 1) & (_c(j) - _c(half_j) >= 0) & (_c(j) + _c(half_j) <= _c(width) - 1)


def signed_ball_distance(x: Column, y: Column, z: Column, radius: ColumnLike) -> Column:
    return F.sqrt(x * x + y * y + z * z) - _c(radius)


# optics -----------------------------------------------------------------------------------------


def conjugate(z: ColumnLike, power: ColumnLike, sign: int = 1) -> Column:
    """The image distance 1 / (1 / z + power) (sign -1: the object distance); null where it is infinite."""
    return F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), _c(z).cast("double")) + sign * _c(power))


def signed_blur_radius(z_obj: ColumnLike, z_focus: ColumnLike, power: ColumnLike, pupil_z: ColumnLike, pupil_r: ColumnLike, back: ColumnLike = 0.0) -> Column:
    """pupil_r * (d(focus) - d(object)) / d(object) with d(z) = image(z) + back - pupil_z."""
    d = lambda z: conjugate(z, power) + _c(back) - _c(pupil_z)
    return _c(pupil_r) * F.try_divide(d(z_focus) - d(z_obj), d(z_obj))


def object_of_blur(coc: ColumnLike, z_focus: ColumnLike, power: ColumnLike, pupil_z: ColumnLike, pupil_r: ColumnLike, back: ColumnLike = 0.0) -> Column:
    """The object distance whose signed blur radius is `coc`: the inverse of signed_blur_radius."""
    focus = conjugate(z_focus, power) + _c(back) - _c(pupil_z)
    image = F.try_divide(focus * _c(pupil_r), _c(pupil_r) + _c(coc)) - _c(back) + _c(pupil_z)
    return conjugate(image, power, -1)


def numerical_aperture(pupil_r: ColumnLike, sphere_r: ColumnLike, ior: ColumnLike = 1.0) -> Column:
    return _c(ior) * F.try_divide(_c(pupil_r), _c(sphere_r))


def sampling_bound(z_a: ColumnLike, z_b: ColumnLike, z_focus: ColumnLike, power: ColumnLike, pupil_z: ColumnLike, pupil_r: ColumnLike, tan_field: ColumnLike, field: ColumnLike, wavelength: ColumnLike, back: ColumnLike = 0.0, scale: float = 4.0) -> Column:
    """The larger of the sampling needs at two depths (the off-axis term is linear in image * tangent)."""

    def need(z: ColumnLike) -> Column:
        image = conjugate(z, power)
        d = image + _c(back) - _c(pupil_z)
        na2 = F.try_divide(_c(pupil_r) * _c(pupil_r), _c(pupil_r) * _c(pupil_r) + d * d + image * _c(tan_field) * _c(field))
        return F.try_divide(4 * scale * na2 * F.abs(conjugate(z_focus, power) - image), F.sqrt(F.greatest(1 - na2, F.lit(0.0))) * _c(wavelength))

    return F.greatest(need(z_a), need(z_b))


def cauchy_terms(nd: ColumnLike, vd: ColumnLike) -> Column:
    """struct(a, b) of n(l) = a + b / l^2 (l in micrometres) from the index and the Abbe number at d."""
    f, d, c = 0.4861327, 0.5875618, 0.6562725  # fixed values: the F, d and C spectral lines
    b = F.try_divide(_c(nd) - 1, _c(vd) * (1 / f**2 - 1 / c**2))
    return F.struct((_c(nd) - b / d**2).alias("a"), b.alias("b"))


def project_to_plane(plane: ColumnLike, x: ColumnLike, y: ColumnLike, z: ColumnLike, dx: ColumnLike, dy: ColumnLike, dz: ColumnLike) -> Column:
    """struct(x, y, t): where a ray meets a plane of constant z; null for a ray along the plane."""
    t = F.try_divide(_c(plane) - _c(z), _c(dz))
    return F.struct((_c(x) + t * _c(dx)).alias("x"), (_c(y) + t * _c(dy)).alias("y"), t.alias("t"))


def focus_transform(z: ColumnLike, z_min: ColumnLike) -> Column:
    return F.try_divide(F.lit(1.0), _c(z) - _c(z_min) + 1)


def focus_inverse(u: ColumnLike, z_min: ColumnLike) -> Column:
    return F.try_divide(F.lit(1.0), _c(u)) - 1 + _c(z_min)


def classify_lens(efl: ColumnLike, fnum: ColumnLike, imgrad: ColumnLike, ttl: ColumnLike) -> Column:
    """struct(category, subcategory) by focal length, f-number, image radius and track length (mm).

    The first branch that holds wins. NaN compares as false, as in the source of the rule; a null
    makes the lens unknown.
    """
    # fixed values: the thresholds and labels of the rule
    efl, fnum, imgrad, ttl = (F.when(F.isnan(_c(x).cast("double")), F.lit(None)).otherwise(_c(x).cast("double")) for x in (efl, fnum, imgrad, ttl))
    half = F.degrees(F.atan(F.try_divide(imgrad, efl)))
    name = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("subcategory"))
    unknown = name("Unknown", "N/A")
    mobile = F.when(half > 40, name("Mobile", "Ultra-Wide")).when(half > 30, name("Mobile", "Wide (Main)")).when(half > 10, name("Mobile", "Telephoto")).otherwise(name("Mobile", "Super-Tele (Periscope)"))
    long = F.try_divide(ttl, efl)
    wide = F.when(long > 1.2, name("System Camera", "Retrofocus Wide")).otherwise(name("System Camera", "Wide"))
    tele = F.when(long < 1, name("System Camera", "Compact Telephoto")).otherwise(name("System Camera", "Telephoto"))
    system = F.when(half > 35, wide).when(half >= 18, name("System Camera", "Standard/Normal")).otherwise(tele)
    return F.when(half.isNull() | ttl.isNull() | (fnum > 8), unknown).when(imgrad.between(2.5, 8) & (ttl <= 15), mobile).when((imgrad >= 10) & (ttl >= 25), system).otherwise(unknown)


# text cells and keys ----------------------------------------------------------------------------


def coerce_cell(token: ColumnLike) -> Column:
    """struct(kind, number): - is null, INF is infinity, then int, double, and string last."""
    t = F.trim(_c(token))
    # \z, since $ also stands before a last line separator (U+0085, U+2028, U+2029)
    integer = t.rlike(r"^[+-]?\d+\z")
    real = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), t.try_cast("double"))
    kind = F.when(t.isNull() | (t == "-"), "null").when(F.upper(t) == "INF", "inf").when(integer, "int").when(real.isNotNull(), "double").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(F.upper(t) == "INF", float("inf")).otherwise(real).alias("number"))


def split_fields(line: ColumnLike) -> Column:
    """Fields between tabs or runs of at least two spaces."""
    return F.split(F.trim(_c(line)), r"\t+|\s{2,}")


def quoted_tokens(line: ColumnLike) -> Column:
    """Words and double-quoted strings (without their quotes)."""
    found = F.regexp_extract_all(_c(line), F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0))
    return F.transform(found, lambda t: F.when(t.startswith('"'), F.regexp_replace(t, '^"|"$', "")).otherwise(t))


def format_cell(value: ColumnLike, digits: int = 5) -> Column:
    """A number as text: - for null and NaN, INF, an exponent for tiny and huge ones, no trailing zeros."""
    v = _c(value).cast("double")
    size = F.abs(v)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", v), "0+$", ""), r"\.$", "")
    text = F.when(size == 0, "0").when((size < 1e-4) | (size >= 1e6), F.format_string(f"%.{digits}E", v)).otherwise(fixed)
    return F.when(v.isNull() | F.isnan(v), "-").when(size == float("inf"), "INF").otherwise(text)


def file_stem(path: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def rerooted(path: ColumnLike, old: str, new: str) -> Column:
    """The path with its leading folder replaced."""
    p = _c(path)
    return F.when(p.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(p, F.lit(len(old.rstrip("/")) + 1), F.length(p)))).otherwise(p)


def scene_key(name: ColumnLike) -> Column:
    """The part before `_f_<digit>` of names with a known prefix; null otherwise."""
    n = _c(name)
    known = n.rlike("^(MIDDLEBURRY|MPI|SYNTHIA)_")  # fixed values: the prefixes
    return F.when(known, F.when(n.rlike(r"_f_\d"), F.regexp_extract(n, r"^(.*?)_f_\d", 1)).otherwise(n))


def size_text(n_bytes: ColumnLike) -> Column:
    """Bytes for people: 512.0 B, 1.5 KB ..."""
    n = _c(n_bytes).cast("double")
    units = ["", "K", "M", "G", "T", "P", "E", "Z"]
    out = F.format_string("%.1f YB", n / 1024.0**8)
    for k in reversed(range(len(units))):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), F.format_string(f"%.1f {units[k]}B", n / 1024.0**k)).otherwise(out)
    return out


def padded_id(prefix: str, *parts: tuple[ColumnLike, int]) -> Column:
    """prefix and numbers with leading zeros, joined by __; a width of 0 leaves a part as it is."""
    return F.concat_ws("__", F.lit(prefix), *[F.lpad(_c(c).cast("string"), w, "0") if w else _c(c).cast("string") for c, w in parts])


# seeds ------------------------------------------------------------------------------------------


def _first_word(digest: Column) -> Column:
    """The first four bytes of a hexadecimal digest as a little-endian number."""
    return F.conv(F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def tag_seed(seed: ColumnLike, tag: ColumnLike) -> Column:
    return _first_word(F.sha2(F.concat_ws("/", _c(seed).cast("string"), _c(tag)).cast("binary"), 256))


def text_seed(text: ColumnLike) -> Column:
    return _first_word(F.sha2(_c(text).cast("binary"), 256))


def uniform(*keys: ColumnLike) -> Column:
    """A number in [0, 1) from a SHA-256 of the keys: the same for the same keys, in any engine."""
    h = F.sha2(F.concat_ws("/", *[_c(k).cast("string") for k in keys]).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


def normal(*keys: ColumnLike) -> Column:
    """A standard normal number from two uniforms."""
    return F.sqrt(-2 * F.ln(1 - uniform(*keys, F.lit("radius")))) * F.cos(2 * math.pi * uniform(*keys, F.lit("angle")))


# colours ----------------------------------------------------------------------------------------


def luma(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    """The Y channel of the studio-range transform, inputs in [0, 1], result about [16, 235]."""
    # fixed values: the coefficients of the transform
    return 65.481 * _c(r) + 128.553 * _c(g) + 24.966 * _c(b) + 16.0


def rgb_to_hsv(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    """struct(h, s, v), all in [0, 1]."""
    r, g, b = (_c(x).cast("double") for x in (r, g, b))
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    turn = F.when(span == 0, 0.0).when(top == r, F.try_divide(g - b, span)).when(top == g, 2 + F.try_divide(b - r, span)).otherwise(4 + F.try_divide(r - g, span))
    return F.struct(F.pmod(turn / 6, F.lit(1.0)).alias("h"), F.coalesce(F.try_divide(span, top), F.lit(0.0)).alias("s"), top.alias("v"))


def hsv_to_rgb(h: ColumnLike, s: ColumnLike, v: ColumnLike) -> Column:
    """struct(r, g, b)."""
    h, s, v = (_c(x).cast("double") for x in (h, s, v))

    def channel(n: int) -> Column:
        k = F.pmod(n + 6 * h, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def standardized(x: ColumnLike, mean: float, std: float) -> Column:
    return (_c(x) - mean) / std


# rays -------------------------------------------------------------------------------------------------


def refracted(direction: Column, normal: Column, ratio: ColumnLike) -> Column:
    """struct(direction, defined): a unit direction behind a surface by Snell's law.

    `ratio` is the index before the surface over the one behind it; the unit normal points against the
    ray. Not defined beyond total reflection, where the ray goes along the surface.
    """
    eta = _c(ratio)
    cos_in = -dot(normal, direction)
    rest = 1 - eta * eta * (1 - cos_in * cos_in)
    along = eta * cos_in - F.sqrt(F.greatest(rest, F.lit(0.0)))
    out = F.zip_with(direction, normal, lambda d, n: eta * d.cast("double") + along * n.cast("double"))
    return F.struct(unit(out).alias("direction"), (rest >= 0).alias("defined"))


def sphere_hit(origin: Column, direction: Column, curvature: ColumnLike) -> Column:
    """struct(t, point, normal, defined): where a ray meets a sphere (or, of curvature 0, the plane) through z = 0.

    The vertex is the origin. Of the two meetings it is the one on the vertex's side; the unit normal points
    against the ray. Not defined where the ray passes by, or runs along the plane.
    """
    c = _c(curvature).cast("double")
    z = lambda v: v[2].cast("double")
    # c |o + t d|^2 = 2 z: a t^2 + 2 b t + f = 0
    a, b, f = c * dot(direction, direction), c * dot(origin, direction) - z(direction), c * dot(origin, origin) - 2 * z(origin)
    disc = b * b - a * f
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    # in this form the root on the vertex's side stays exact as the curvature goes to 0
    t = F.try_divide(f, F.when(z(direction) < 0, -root).otherwise(root) - b)
    point = F.zip_with(origin, direction, lambda o, d: o.cast("double") + t * d.cast("double"))
    outward = F.array(-c * point[0], -c * point[1], 1 - c * point[2])
    facing = F.when(dot(outward, direction) > 0, F.transform(outward, lambda v: -v)).otherwise(outward)
    return F.struct(t.alias("t"), point.alias("point"), unit(facing).alias("normal"), F.coalesce((disc >= 0) & t.isNotNull(), F.lit(False)).alias("defined"))


def zernike_mode(j: ColumnLike) -> Column:
    """struct(n, m, norm) of the mode number j (from 1) in Noll's order: by radial order, then |m|; even j have m > 0, odd ones m < 0.

    `norm` gives the mode unit variance over the disk.
    """
    k = _c(j).cast("long")
    n = F.floor((F.sqrt(8 * (k - 1) + 1.0) - 1) / 2).cast("long")
    inside = k - 1 - (n * (n + 1) / 2).cast("long")
    size = F.when(n % 2 == 0, 2 * F.floor((inside + 1) / 2)).otherwise(2 * F.floor(inside / 2) + 1).cast("long")
    m = F.when(k % 2 == 0, size).otherwise(-size)
    return F.struct(n.alias("n"), m.alias("m"), F.when(size == 0, F.sqrt(n + 1.0)).otherwise(F.sqrt(2 * (n + 1.0))).alias("norm"))


#: The studio-range transform, rows Y, Cb, Cr of red, green, blue and an offset.
YCBCR = ((65.481, 128.553, 24.966, 16.0), (-37.797, -74.203, 112.0, 128.0), (112.0, -93.786, -18.214, 128.0))


def ycbcr(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    """struct(y, cb, cr) of the studio-range transform, inputs in [0, 1]."""
    return F.struct(*[(a * _c(r) + k * _c(g) + c * _c(b) + d).alias(n) for n, (a, k, c, d) in zip(("y", "cb", "cr"), YCBCR, strict=True)])
