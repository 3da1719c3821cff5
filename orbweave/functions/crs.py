"""Coordinate systems in closed form: geographic WGS 84 (EPSG:4326), web Mercator (3857), the equal-area cylinder (6933) and UTM (326xx, 327xx).

Formulas: Snyder, Map Projections: A Working Manual (1987); Karney, Transverse Mercator with an accuracy of a few nanometers (2011), for the series.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
K0_6933 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Coefficients of the transverse Mercator series, forward and back.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
UTM_SCALE, UTM_EAST, UTM_NORTH = 0.9996, 500000.0, 10000000.0


def code(crs: str | int | None) -> int:
    """The EPSG number of a label like `EPSG:32633`; none means geographic. Anything else than the systems above is an error."""
    if crs is None:
        return 4326
    found = re.fullmatch(r"\s*(?:epsg:+|urn:ogc:def:crs:epsg:[\d.]*:)?(\d+)\s*", str(crs), re.I)
    if not found and re.search(r"CRS:?84$", str(crs), re.I):
        return 4326
    if not found:
        raise ValueError(f"Unknown coordinate system: {crs!r}")
    n = int(found[1])
    if n not in (4326, 3857, 6933) and not (1 <= n % 100 <= 60 and n // 100 in (326, 327)):
        raise ValueError(f"Unsupported coordinate system: EPSG:{n}")
    return n


def label(crs: str | int) -> str:
    """`EPSG:n` where the system is known by number, else the text itself."""
    found = re.fullmatch(r"\s*(?:epsg:+)?(\d+)\s*", str(crs), re.I)
    return f"EPSG:{int(found[1])}" if found else str(crs)


def _q(s):
    return (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E * s) / (1 + E * s)) / (2 * E))


def _utm_zone(n: int) -> tuple[float, float]:
    return math.radians(n % 100 * 6 - 183), UTM_NORTH if n // 100 == 327 else 0.0


def forward(n: int, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to the system's coordinates."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    lam, phi = np.radians(lon), np.radians(lat)
    if n == 4326:
        return lon, lat
    if n == 3857:
        return A * lam, A * np.arcsinh(np.tan(phi))
    if n == 6933:
        return A * K0_6933 * lam, A * _q(np.sin(phi)) / (2 * K0_6933)
    lam0, north = _utm_zone(n)
    s = np.sin(phi)
    t = np.sinh(np.arctanh(s) - E * np.arctanh(E * s))
    xi, eta = np.arctan2(t, np.cos(lam - lam0)), np.arctanh(np.sin(lam - lam0) / np.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(ALPHA, 1):
        x, y = x + a * np.cos(2 * k * xi) * np.sinh(2 * k * eta), y + a * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    return UTM_EAST + UTM_SCALE * RECTIFYING * x, north + UTM_SCALE * RECTIFYING * y


def inverse(n: int, x, y) -> tuple[np.ndarray, np.ndarray]:
    """The system's coordinates to degrees."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if n == 4326:
        return x, y
    if n == 3857:
        return np.degrees(x / A), np.degrees(np.arctan(np.sinh(y / A)))
    if n == 6933:
        q = np.clip(2 * K0_6933 * y / A, -_q(1.0), _q(1.0))
        phi = np.arcsin(np.clip(q / 2, -1, 1))
        for _ in range(12):
            s = np.sin(phi)
            step = (1 - E2 * s * s) ** 2 / (2 * np.maximum(np.cos(phi), 1e-12)) * (q - _q(s)) / (1 - E2)
            phi = np.clip(phi + step, -np.pi / 2, np.pi / 2)
        return np.degrees(x / (A * K0_6933)), np.degrees(phi)
    lam0, north = _utm_zone(n)
    xi, eta = (y - north) / (UTM_SCALE * RECTIFYING), (x - UTM_EAST) / (UTM_SCALE * RECTIFYING)
    a, b = eta, xi
    for k, c in enumerate(BETA, 1):
        a, b = a - c * np.cos(2 * k * xi) * np.sinh(2 * k * eta), b - c * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    chi = np.arcsin(np.sin(b) / np.cosh(a))
    t = np.tan(chi)
    tau = t
    for _ in range(6):  # the conformal latitude's inverse, by Newton's method
        sigma = np.sinh(E * np.arctanh(E * tau / np.sqrt(1 + tau * tau)))
        now = tau * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + tau * tau)
        tau = tau + (t - now) / np.sqrt(1 + now * now) * (1 + (1 - E2) * tau * tau) / ((1 - E2) * np.sqrt(1 + tau * tau))
    return np.degrees(lam0 + np.arctan2(np.sinh(a), np.cos(b))), np.degrees(np.arctan(tau))


def transform(source: str | int | None, target: str | int, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of one system in another; unchanged if they are the same."""
    a, b = code(source), code(target)
    if a == b:
        return np.asarray(x, float), np.asarray(y, float)
    return forward(b, *inverse(a, x, y))


def to_6933(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to the equal-area cylinder, as columns."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    return A * K0_6933 * F.radians(lon), A * q / (2 * K0_6933)


def to_3857(lon: Column, lat: Column) -> tuple[Column, Column]:
    return A * F.radians(lon), A * F.asinh(F.tan(F.radians(lat)))
