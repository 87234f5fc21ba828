"""Coordinate systems from their text form (WKT 1, as .prj files hold it) and back."""

from __future__ import annotations

import math
import re

from .projections import Projection

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|([\[\](),]))')

#: Names of projections, of parameters and of the lists of parameters that a projection needs (fixed values of the format).
KINDS = {
    "polar_stereographic": "stere", "stereographic_north_pole": "stere", "stereographic_south_pole": "stere",
    "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic": "lcc",
    "albers_conic_equal_area": "aea", "albers": "aea",
}
PARAMETERS = {
    "central_meridian": "lon_0", "longitude_of_center": "lon_0", "longitude_of_origin": "lon_0", "straight_vertical_longitude_from_pole": "lon_0",
    "latitude_of_origin": "lat_0", "latitude_of_center": "lat_0", "standard_parallel_1": "lat_1", "standard_parallel_2": "lat_2",
    "false_easting": "x_0", "false_northing": "y_0", "scale_factor": "k_0",
}


def parse_wkt(text: str) -> tuple[str, list]:
    """The tree of a WKT text: (keyword in capitals, [texts, numbers and trees]); ValueError where it is none."""
    at = 0

    def fail(what: str):
        raise ValueError(f"WKT: {what} at {at}: {text[at : at + 20]!r}")

    def token():
        nonlocal at
        found = _TOKEN.match(text, at)
        if found is None:
            fail("end" if not text[at:].strip() else "unknown sign")
        at = found.end()
        return found

    def peek() -> str | None:
        found = _TOKEN.match(text, at)
        return found.group(4) if found else None

    def value():
        found = token()
        quoted, number, word, sign = found.groups()
        if quoted is not None:
            return quoted.replace('""', '"')
        if number is not None:
            return float(number)
        if sign is not None:
            fail("a value was expected")
        if peek() not in ("[", "("):
            return word.upper()
        close, items = {"[": "]", "(": ")"}[token().group(4)], []
        while True:
            items.append(value())
            sign = token().group(4)
            if sign == close:
                return word.upper(), items
            if sign != ",":
                fail("a comma was expected")

    tree = value()
    if not isinstance(tree, tuple) or text[at:].strip():
        fail("not one tree")
    return tree


def _child(tree: tuple[str, list], name: str, needed: bool = True) -> list | None:
    for item in tree[1]:
        if isinstance(item, tuple) and item[0] == name:
            return item[1]
    if needed:
        raise ValueError(f"WKT: {tree[0]} without {name}")
    return None


def _geographic(tree: tuple[str, list]) -> tuple[tuple[float, float], float]:
    """(a, e) of the ellipsoid, and degrees of an angle's unit."""
    _, a, inverse_f = _child(("DATUM", _child(tree, "DATUM")), "SPHEROID")[:3]
    if (_child(tree, "PRIMEM", False) or ["", 0.0])[1]:
        raise ValueError("WKT: only Greenwich is known as prime meridian")
    f = 1 / inverse_f if inverse_f else 0.0
    unit = math.degrees(_child(tree, "UNIT")[1])
    return (a, math.sqrt(f * (2 - f))), (1.0 if abs(unit - 1) < 1e-9 else unit)


def projection_of(wkt: str) -> Projection:
    """The projection of a WKT text; ValueError for projections, or forms of them, that are not known."""
    tree = parse_wkt(wkt)
    if tree[0] == "GEOGCS":
        ellipsoid, degrees = _geographic(tree)
        return Projection("longlat", (), ellipsoid, unit=degrees)
    if tree[0] != "PROJCS":
        raise ValueError(f"WKT: {tree[0]} is no coordinate system that is known")
    ellipsoid, degrees = _geographic(("GEOGCS", _child(tree, "GEOGCS")))
    name = _child(tree, "PROJECTION")[0]
    kind = KINDS.get(name.lower())
    if kind is None:
        raise ValueError(f"WKT: projection {name} is not known")
    given = {PARAMETERS.get(p[1][0].lower(), p[1][0].lower()): p[1][1] for p in tree[1] if isinstance(p, tuple) and p[0] == "PARAMETER"}
    if unknown := set(given) - set(PARAMETERS.values()):
        raise ValueError(f"WKT: parameters {sorted(unknown)} are not known")
    get = lambda key, default=0.0: given.get(key, default) * (degrees if key[:3] in ("lat", "lon") else 1.0)
    if given.get("k_0", 1.0) != 1.0:
        raise ValueError("WKT: a scale factor other than 1 is not known")
    if kind == "stere":
        # the parallel that is true to scale is a parameter of its own in one form, the latitude of origin in the other
        parameters = (get("lat_1") if "lat_1" in given else get("lat_0", 90.0), get("lon_0"))
    else:
        first = get("lat_1") if "lat_1" in given else get("lat_0")
        parameters = (first, get("lat_2") if "lat_2" in given else first, get("lat_0"), get("lon_0"))
    unit = _child(tree, "UNIT")[1]
    return Projection(kind, parameters, ellipsoid, given.get("x_0", 0.0), given.get("y_0", 0.0), unit)


def wkt_of(p: Projection, name: str = "unnamed") -> str:
    """A WKT text of a projection."""
    a, e = p.ellipsoid
    inverse_f = 1 / (1 - math.sqrt(1 - e * e)) if e else 0.0
    degree = math.radians(p.unit if p.kind == "longlat" else 1.0)
    base = f'GEOGCS["{name}",DATUM["{name}",SPHEROID["{name}",{a!r},{inverse_f!r}]],PRIMEM["Greenwich",0],UNIT["degree",{degree!r}]]'
    if p.kind == "longlat":
        return base
    names = {"stere": ("latitude_of_origin", "central_meridian")}.get(p.kind, ("standard_parallel_1", "standard_parallel_2", "latitude_of_origin", "central_meridian"))
    kind = {"stere": "Polar_Stereographic", "lcc": "Lambert_Conformal_Conic_2SP", "aea": "Albers_Conic_Equal_Area"}[p.kind]
    values = [*zip(names, p.parameters), ("false_easting", p.x_0), ("false_northing", p.y_0)]
    parameters = "".join(f',PARAMETER["{k}",{v!r}]' for k, v in values)
    return f'PROJCS["{name}",{base},PROJECTION["{kind}"]{parameters},UNIT["metre",{p.unit!r}]]'
