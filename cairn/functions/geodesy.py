"""UTM coordinates to degrees, by the series of the footpoint latitude: one formula for numbers here and for columns in ``operators.graph``."""

from __future__ import annotations

import math
from types import SimpleNamespace
from typing import Any

_MATH = SimpleNamespace(**{k: getattr(math, k) for k in ("sin", "cos", "tan", "sqrt", "degrees")})
_A, _F = 6378137.0, 1 / 298.257223563


def footpoint(easting: Any, northing: Any, zone: int, f: Any) -> tuple[Any, Any]:
    """Latitude and longitude in degrees on the northern half; ``f`` gives sin, cos, tan, sqrt, degrees."""
    e2 = _F * (2 - _F)
    root = math.sqrt(1 - e2)
    e1, ep = (1 - root) / (1 + root), e2 / (1 - e2)
    mu = northing / 0.9996 / (_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * f.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * f.sin(4 * mu) + 151 * e1**3 / 96 * f.sin(6 * mu) + 1097 * e1**4 / 512 * f.sin(8 * mu)
    s, t, c = e2 * f.sin(phi) ** 2, f.tan(phi) ** 2, ep * f.cos(phi) ** 2
    n, r = _A / f.sqrt(1 - s), _A * (1 - e2) / (1 - s) ** 1.5
    d = (easting - 500000.0) / (n * 0.9996)
    lat = phi - n * f.tan(phi) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep + 24 * t**2) * d**5 / 120) / f.cos(phi)
    return f.degrees(lat), zone * 6 - 183 + f.degrees(lon)


def utm_to_degrees(easting: float, northing: float, zone: int = 30) -> tuple[float, float]:
    """Degrees, not rounded: a reader that rounds would round twice."""
    return footpoint(easting, northing, zone, _MATH)
