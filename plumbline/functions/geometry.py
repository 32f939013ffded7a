"""Geometry as well-known binary: readers for WKT, WKB and GeoJSON, points, bounds and display.

Points in WKT and coordinate pairs stay in Catalyst expressions; other shapes
are read by Arrow-batched functions over a small codec.
"""

from __future__ import annotations

import json
import math
import re
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.types import typed

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v.upper(): k for k, v in NAMES.items()} | {"LINEARRING": 2}
#: How deeply coordinates are nested.
_DEPTH = {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 6: 3}
#: Column names that suggest coordinates.
COORDINATE_HINT = re.compile(r"(?i)(?:^|[_\s-])(?:geo|geom|geometry|location|loc|coord|coords|coordinate|coordinates|point|position|lonlat|latlon|lon_lat|lat_lon|lnglat|lng_lat|lat_lng)(?:$|[_\s-]|\d)")
_WKT_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


@dataclass(frozen=True)
class Shape:
    code: int
    dims: int  # numbers in each position
    coords: tuple  # nested positions, or shapes in a collection; () is empty

    def positions(self):
        def walk(x, depth):
            if depth == 0:
                yield x
            else:
                for y in x:
                    yield from walk(y, depth - 1)

        if self.code == 7:
            for s in self.coords:
                yield from s.positions()
        elif self.coords:
            yield from walk(self.coords, _DEPTH[self.code])

    @property
    def name(self) -> str:
        return NAMES[self.code]


def read_wkt(text: str) -> Shape | None:
    """A shape, or None if the text isn't WKT of one."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _WKT_TOKEN.match(text, at)
        if not m:
            return None
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()
    try:
        shape = _wkt_shape(tokens)
    except (IndexError, ValueError, KeyError):
        return None
    return None if tokens else shape


def _wkt_shape(tokens: list[str]) -> Shape:
    word = tokens.pop().upper()
    dims = 2
    if word not in CODES and word[-1:] in "ZM":  # POINTZ
        word, flag = (word[:-2], "ZM") if word.endswith("ZM") else (word[:-1], word[-1])
        dims += len(flag)
    code = CODES[word]
    if tokens and tokens[-1].upper() in ("Z", "M", "ZM"):
        dims += len(tokens.pop())
    if tokens and tokens[-1].upper() == "EMPTY":
        tokens.pop()
        return Shape(code, dims, ())
    if code == 7:
        return Shape(7, dims, tuple(_wkt_list(tokens, lambda: _wkt_shape(tokens))))
    if code == 1:
        found = _wkt_list(tokens, lambda: _wkt_position(tokens))
        if len(found) != 1:
            raise ValueError
        coords = found[0]
    else:
        coords = _wkt_nested(tokens, _DEPTH[code], code == 4)
    shape = Shape(code, dims, coords)
    sizes = {len(p) for p in shape.positions()}
    if len(sizes) > 1 or (dims > 2 and sizes != {dims}) or not sizes <= {2, 3, 4}:
        raise ValueError
    return Shape(code, max(sizes), coords) if _sound(shape) else _fail()


def _fail():
    raise ValueError


def _wkt_list(tokens: list[str], item) -> list:
    if tokens.pop() != "(":
        raise ValueError
    out = [item()]
    while (t := tokens.pop()) == ",":
        out.append(item())
    if t != ")":
        raise ValueError
    return out


def _wkt_position(tokens: list[str]) -> tuple:
    out = []
    while tokens[-1] not in "(),":
        out.append(float(tokens.pop()))
    if not 2 <= len(out) <= 4:
        raise ValueError
    return tuple(out)


def _wkt_nested(tokens: list[str], depth: int, points: bool) -> tuple:
    if depth == 1:

        def position():
            if points and tokens[-1] == "(":
                return _wkt_list(tokens, lambda: _wkt_position(tokens))[0]
            return _wkt_position(tokens)

        return tuple(_wkt_list(tokens, position))
    return tuple(_wkt_list(tokens, lambda: _wkt_nested(tokens, depth - 1, points)))


def _sound(shape: Shape) -> bool:
    """Lines have two positions, rings four and end where they begin."""
    line = lambda x: len(x) != 1
    ring = lambda x: not x or (len(x) >= 4 and x[0][:2] == x[-1][:2])
    c = shape.coords
    return {2: lambda: line(c), 3: lambda: all(map(ring, c)), 5: lambda: all(map(line, c)), 6: lambda: all(ring(r) for p in c for r in p)}.get(shape.code, lambda: True)()


def write_wkb(shape: Shape) -> bytes:
    """Little-endian ISO well-known binary."""
    kind = shape.code + {2: 0, 3: 1000, 4: 3000}[shape.dims]
    head = struct.pack("<BI", 1, kind)
    point = lambda p: struct.pack(f"<{shape.dims}d", *p)
    many = lambda xs, f: struct.pack("<I", len(xs)) + b"".join(map(f, xs))
    if shape.code == 1:
        return head + point(shape.coords or (math.nan,) * shape.dims)
    if shape.code == 2:
        return head + many(shape.coords, point)
    if shape.code == 3:
        return head + many(shape.coords, lambda r: many(r, point))
    if shape.code == 7:
        return head + many(shape.coords, write_wkb)
    return head + many(shape.coords, lambda c: write_wkb(Shape(shape.code - 3, shape.dims, c)))


def read_wkb(raw: bytes | None) -> Shape | None:
    """A shape from ISO or extended well-known binary, or None."""
    try:
        shape, at = _wkb(bytes(raw), 0)
    except (struct.error, KeyError, ValueError, IndexError, TypeError):
        return None
    return shape if at == len(raw) and _sound(shape) else None


def _wkb(raw: bytes, at: int) -> tuple[Shape, int]:
    order = {0: ">", 1: "<"}[raw[at]]
    (kind,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    z, m = bool(kind & 0x80000000), bool(kind & 0x40000000)
    if kind & 0x20000000:
        at += 4  # a reference system's number
    kind &= 0x1FFFFFFF
    thousands, code = divmod(kind, 1000)
    dims = 2 + (z or thousands in (1, 3)) + (m or thousands in (2, 3))
    if code not in NAMES or thousands > 3:
        raise ValueError

    def count():
        nonlocal at
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        if n > (len(raw) - at) // 4 + 1:
            raise ValueError
        return n

    def point():
        nonlocal at
        p = struct.unpack_from(f"{order}{dims}d", raw, at)
        at += 8 * dims
        return p

    def inner():
        nonlocal at
        s, at = _wkb(raw, at)
        return s

    if code == 1:
        p = point()
        return Shape(1, dims, () if all(map(math.isnan, p)) else p), at
    if code == 2:
        return Shape(2, dims, tuple(point() for _ in range(count()))), at
    if code == 3:
        return Shape(3, dims, tuple(tuple(point() for _ in range(count())) for _ in range(count()))), at
    parts = tuple(inner() for _ in range(count()))
    if code == 7:
        return Shape(7, dims, parts), at
    if any(p.code != code - 3 for p in parts):
        raise ValueError
    return Shape(code, dims, tuple(p.coords for p in parts)), at


def read_geojson(text: str) -> Shape | None:
    """A shape from a GeoJSON geometry; features aren't geometries."""
    try:
        value = json.loads(text) if isinstance(text, str) else text
        return _geojson(value)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _geojson(value: dict) -> Shape:
    code = {v: k for k, v in NAMES.items()}[value["type"]]
    if code == 7:
        shapes = tuple(map(_geojson, value["geometries"]))
        return Shape(7, max([2, *(s.dims for s in shapes)]), shapes)

    def nested(x, depth):
        return tuple(map(float, x)) if depth == 0 else tuple(nested(y, depth - 1) for y in x)

    shape = Shape(code, 2, nested(value["coordinates"], _DEPTH[code]))
    sizes = {len(p) for p in shape.positions()} or {2}
    if len(sizes) > 1 or not sizes <= {2, 3} or not _sound(shape):
        raise ValueError
    return Shape(code, sizes.pop(), shape.coords)


def write_wkt(shape: Shape) -> str:
    number = lambda x: repr(int(x)) if x == int(x) else repr(x)
    position = lambda p: " ".join(map(number, p))

    def body(x, depth):
        return position(x) if depth == 0 else "(" + ", ".join(body(y, depth - 1) for y in x) + ")"

    head = shape.name.upper() + {2: "", 3: " Z", 4: " ZM"}[shape.dims]
    if not shape.coords:
        return head + " EMPTY"
    if shape.code == 7:
        return f"{head} ({', '.join(map(write_wkt, shape.coords))})"
    if shape.code == 4:
        return f"{head} ({', '.join(f'({position(p)})' for p in shape.coords)})"
    return f"{head} ({position(shape.coords)})" if shape.code == 1 else f"{head} {body(shape.coords, _DEPTH[shape.code])}"


# --- columns

READERS = {"wkt": read_wkt, "geojson": read_geojson, "wkb": read_wkb}


def hex_bytes(column: Column) -> Column:
    """Bytes of hexadecimal text, with or without 0x."""
    return F.try_to_binary(F.regexp_replace(F.trim(column), "^0[xX]", ""), F.lit("hex"))


def to_wkb(column: Column, representation: str) -> Column:
    """Well-known binary of a column of WKT or GeoJSON text, or of binary; missing where it isn't geometry."""
    reader = READERS[representation]

    @F.pandas_udf("binary")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or (shape := reader(v)) is None else write_wkb(shape))

    return convert(column)


def kind_of(column: Column) -> Column:
    """The shape's name, read from the head of its binary form."""
    little = F.substring(column, 1, 1) == F.lit(bytearray(b"\x01"))
    head = F.substring(column, 2, 4)
    number = F.conv(F.hex(head), 16, 10).cast("long")
    swapped = F.conv(F.concat(*[F.substring(F.hex(head), i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    code = F.when(little, swapped).otherwise(number)
    code = F.pmod(F.pmod(code, F.lit(0x20000000)), F.lit(1000)).cast("int")
    return F.get(F.array(F.lit(None).cast("string"), *[F.lit(NAMES[i]) for i in range(1, 8)]), code)


def bounds(column: Column) -> Column:
    """A struct of minx, miny, maxx, maxy."""

    @F.pandas_udf("minx double, miny double, maxx double, maxy double")
    def box(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            found = [*s.positions()] if v is not None and (s := read_wkb(v)) is not None else []
            out.append((min(p[0] for p in found), min(p[1] for p in found), max(p[0] for p in found), max(p[1] for p in found)) if found else (None,) * 4)
        return pd.DataFrame(out, columns=["minx", "miny", "maxx", "maxy"], dtype=float)

    return box(column)


def to_wkt(column: Column) -> Column:
    @F.pandas_udf("string")
    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or (s := read_wkb(v)) is None else write_wkt(s))

    return write(column)


def display(column: Column, full: bool = False) -> Column:
    """WKT, or a point's position, or a shape's name and bounds, to four decimals."""
    if full:
        return to_wkt(column)
    b = bounds(column)
    kind = kind_of(column)
    return F.when(kind == "Point", F.format_string("Point(%.4f, %.4f)", b["minx"], b["miny"])).when(kind.isNotNull(), F.format_string("%s bound by %.4f,%.4f to %.4f,%.4f", kind, b["minx"], b["miny"], b["maxx"], b["maxy"]))


def point_xy(column: Column) -> Column:
    """x and y of WKT points, without leaving the JVM; missing for other text."""
    number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    pattern = rf"(?i)^\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*{number}\s+{number}(?:\s+{number}){{0,2}}\s*\)\s*$"
    part = lambda i: F.regexp_extract(column, pattern, i).try_cast("double")
    return F.when(column.rlike(pattern), F.struct(part(1).alias("x"), part(2).alias("y")))


def _orders(order: str) -> None:
    if order not in ("lon-lat", "lat-lon", "either"):
        raise ValueError("order must be 'lon-lat', 'lat-lon', or 'either'")


def is_coordinate(column: Column, *, order: str = "either", allow_longitude_360: bool = False, min_decimal_places: int | None = None, require_both_precise: bool = False, allow_z: bool = True) -> Column:
    """Whether an array of numbers can be a place on earth."""
    from plumbline.functions.numbers import decimal_places

    _orders(order)
    if min_decimal_places is not None:
        if isinstance(min_decimal_places, bool) or not isinstance(min_decimal_places, int):
            raise TypeError("min_decimal_places must be an integer or None")
        if min_decimal_places < 0:
            raise ValueError("min_decimal_places must be non-negative")
    a, b = F.get(column, F.lit(0)), F.get(column, F.lit(1))
    lat = lambda x: x.between(-90, 90)
    lon = lambda x: x.between(-180, 360 if allow_longitude_360 else 180)
    fits = {"lon-lat": lon(a) & lat(b), "lat-lon": lat(a) & lon(b), "either": (lon(a) & lat(b)) | (lat(a) & lon(b))}[order]
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    ok = F.size(column).isin([2, 3] if allow_z else [2]) & finite & fits
    if min_decimal_places is not None:
        precise = [F.coalesce(decimal_places(x) >= min_decimal_places, F.lit(False)) for x in (a, b)]
        ok = ok & ((precise[0] & precise[1]) if require_both_precise else (precise[0] | precise[1]))
    return F.when(column.isNotNull(), F.coalesce(ok, F.lit(False)))


def coordinate_point(column: Column, **options) -> Column:
    """A struct x, y of a plausible coordinate; others are an error."""
    order = options.get("order", "either")
    a, b = F.get(column, F.lit(0)).cast("double"), F.get(column, F.lit(1)).cast("double")
    swap = {"lon-lat": F.lit(False), "lat-lon": F.lit(True), "either": (F.abs(a) <= 90) & (F.abs(b) > 90)}
    _orders(order)
    point = F.struct(F.when(swap[order], b).otherwise(a).alias("x"), F.when(swap[order], a).otherwise(b).alias("y"))
    message = F.concat(F.to_json(column), F.lit(" is not a plausible coordinate pair"))
    return F.when(column.isNull(), None).when(is_coordinate(column, **options), point).otherwise(F.raise_error(message))


def point_wkb(x: Column, y: Column) -> Column:
    """Well-known binary of points."""

    @F.pandas_udf("binary")
    def pack(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(xs, ys, strict=True)], dtype=object)

    return pack(x, y)


def as_geometry(column: Column, name: str, representation: str, *, crs: str | None = None, **coordinate_options) -> Column:
    """A column as geometry; blank text is missing, other values that aren't geometry are an error."""
    if representation == "coordinate-pair":
        p = coordinate_point(column, **coordinate_options)
        found = point_wkb(p["x"], p["y"])
        source = column
    elif representation in ("wkt", "geojson"):
        source = F.nullif(F.trim(column), F.lit(""))
        found = to_wkb(source, representation)
    elif representation == "wkb":
        source = column
        found = to_wkb(column, "wkb")
    elif representation == "wkb-hex":
        source = F.nullif(F.trim(column), F.lit(""))
        found = to_wkb(hex_bytes(source), "wkb")
    else:
        raise ValueError("representation must be one of 'coordinate-pair', 'geojson', 'wkb', 'wkb-hex', 'wkt'")
    kept = found
    if representation != "coordinate-pair":
        kept = F.when(source.isNull(), None).when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"not valid {representation.upper()} geometry: "), source.cast("string"))))
    more = {"crs": crs} if crs else {}
    return typed(kept, name, "geometry", **more)
