"""Lattice expressions: indexing, cells and settings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillframe.functions import lin3

#: Fixed values of the acceptance rules.
HKL_TOL = 0.15
GATE_FRACTION, GATE_LEAST = 0.25, 10
LIVE_FRACTION = 0.15
Q_FLOOR = 1e-6
LEAST_VOLUME, LEAST_SHAPE = 1.0, 0.1
LENGTH_TOL, COSINE_TOL, VOLUME_TOL = 0.05, 0.06, 0.10
#: h c in eV angstrom.
HC = 12398.419843320026
FLOORS = {"cxidb17": (0.0246, 5.39, 1.188), "live": (0.0224, 5.32, 1.211)}


def fractional(q: lin3.Vector, m: lin3.Matrix) -> lin3.Vector:
    """Fractional Miller indices of a reciprocal vector in a basis."""
    return lin3.times(q, m)


def miss(h: lin3.Vector) -> Column:
    """Largest distance of an index from its nearest integer."""
    return F.greatest(*(F.abs(x - F.rint(x)) for x in h))


def is_inlier(q: lin3.Vector, m: lin3.Matrix, tol: float = HKL_TOL) -> Column:
    return miss(fractional(q, m)) < tol


def row_ok(q: lin3.Vector) -> Column:
    """Finite rows with a length above the floor."""
    n = lin3.dot(q, q)
    return ~F.isnan(n) & (n > Q_FLOOR**2) & (n < F.lit(float("inf")))


def has_cell(m: lin3.Matrix) -> Column:
    """Finite, of at least 1 cubic angstrom, and not flat."""
    d = F.abs(lin3.det(m))
    a, b, c = (lin3.norm(v) for v in lin3.columns(m))
    return F.coalesce(~F.isnan(d) & (d < F.lit(float("inf"))) & (d >= LEAST_VOLUME) & (d >= LEAST_SHAPE * a * b * c), F.lit(False))


def part(share: float, n: Column) -> Column:
    """A share of a whole number, exact: counts that are just that share reach it."""
    return F.lit(Decimal(str(share))) * n.cast("long")


def strict(matched: Column, peaks: Column) -> Column:
    return (matched >= GATE_LEAST) & (matched >= GATE_FRACTION * peaks)


def chance_floor(peaks: Column, name: str = "cxidb17") -> Column:
    """Matches that a lattice-free frame reaches by chance: a n + b + c sqrt(n)."""
    a, b, c = FLOORS[name]
    return (part(a, peaks) + F.lit(Decimal(str(b)))).cast("double") + c * F.sqrt(peaks.cast("double"))


def basis_of_cell(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column) -> lin3.Matrix:
    """Basis with a along x and b in the xy plane (lengths, degrees)."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (al, be, ga))
    sg = F.sin(F.radians(ga))
    room = F.greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, F.lit(1e-12))
    zero = F.lit(0.0)
    return [a, b * cg, c * cb, zero, b * sg, c * F.try_divide(ca - cb * cg, sg), zero, zero, c * F.try_divide(F.sqrt(room), sg)]


def cell_of_basis(m: lin3.Matrix) -> list[Column]:
    """a, b, c, alpha, beta, gamma."""
    a, b, c = lin3.columns(m)
    return [lin3.norm(a), lin3.norm(b), lin3.norm(c), lin3.angle(b, c), lin3.angle(a, c), lin3.angle(a, b)]


def same_lattice(d1: Column, l1: list[Column], c1: list[Column], d2: Column, l2: list[Column], c2: list[Column]) -> Column:
    """Tolerant equality of fingerprints (volume, sorted lengths, sorted |cosines|).
    Symmetric, not transitive."""
    out = F.abs(d1 - d2) <= VOLUME_TOL * (d1 + d2) / 2
    for x, y in zip(l1, l2):
        out = out & (F.abs(x - y) <= LENGTH_TOL * (x + y) / 2)
    for x, y in zip(c1, c2):
        out = out & (F.abs(x - y) <= COSINE_TOL)
    return out


def wavelength_of_energy(ev: Column) -> Column:
    return F.try_divide(F.lit(HC), ev)


def ewald_error(q: lin3.Vector, wavelength: float) -> Column:
    return q[2] + wavelength / 2 * lin3.dot(q, q)


def centering_allows(h: Column, k: Column, l: Column, centering: str) -> Column:
    """Parity conditions of a centring."""
    even = lambda x: F.pmod(x, F.lit(2)) == 0
    return {
        "P": F.lit(True), "I": even(h + k + l), "A": even(k + l), "B": even(h + l), "C": even(h + k),
        "F": even(h + k) & even(h + l) & even(k + l), "R": F.pmod(-h + k + l, F.lit(3)) == 0,
    }[centering]


def peaks_to_q(fs: Column, ss: Column, panel: dict[str, Column], clen: Column, wavelength: Column) -> lin3.Vector:
    """Reciprocal vector of a pixel on a panel (corner, fs and ss directions, resolution)."""
    lf, ls = fs - panel["min_fs"], ss - panel["min_ss"]
    x = (panel["corner_x"] + lf * panel["fsx"] + ls * panel["ssx"]) / panel["res"]
    y = (panel["corner_y"] + lf * panel["fsy"] + ls * panel["ssy"]) / panel["res"]
    r = F.sqrt(x * x + y * y + clen * clen)
    return [x / r / wavelength, y / r / wavelength, (clen / r - 1) / wavelength]


def sigma_p(q: Column, eta: float, bandwidth: float, inverse_size: float = 0.0, wavelength: float = 1.0) -> Column:
    """Width of the excitation profile at |q|: crystal size, mosaicity (full width, radians)
    and relative bandwidth, in quadrature."""
    mosaic, spread = q * (eta / 2), q * q * (wavelength * bandwidth / 2)
    return F.sqrt(mosaic * mosaic + spread * spread + inverse_size * inverse_size)


def partiality(excitation: Column, width: Column, least: float = 0.02) -> Column:
    return lin3.clip(F.exp(-excitation * excitation / (2 * width * width)), least, 1.0)
