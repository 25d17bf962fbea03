"""Point groups acting on Miller indices, and the symmetry-unique key of a reflection.

An operation is written as the triple that h, k, l become.  With axes at 120 degrees the
length of q goes as h2 + h k + k2, so the three-fold takes (h, k) to (k, i) with
i = -h - k, and not to (-k, h - k), which is what it does to coordinates.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rotations that generate each class, as images of h,k,l (fixed values); the inversion is
#: added.  Hexagonal axes for the trigonal classes unless the name ends in _R; the unique
#: axis of 2/m is in its name.
GENERATORS: dict[str, list[str]] = {
    "-1": [],
    "2/m": ["-h,k,-l"],
    "mmm": ["h,-k,-l", "-h,k,-l"],
    "4/m": ["-k,h,l"],
    "4/mmm": ["-k,h,l", "h,-k,-l"],
    "-3": ["k,-h-k,l"],
    "-3m": ["k,-h-k,l", "h,-h-k,-l"],
    "6/m": ["h+k,-h,l"],
    "6/mmm": ["h+k,-h,l", "h,-h-k,-l"],
    "m-3": ["k,l,h", "-h,-k,l"],
    "m-3m": ["k,l,h", "-k,h,l"],
    "2/m_uaa": ["h,-k,-l"],
    "2/m_uac": ["-h,-k,l"],
    "-31m": ["k,-h-k,l", "-k,-h,-l"],
    "-3_R": ["k,l,h"],
    "-3m_R": ["k,l,h", "-k,-h,-l"],
}
#: The eleven classes in their usual settings.
CLASSES = list(GENERATORS)[:11]
#: Other names of settings (fixed values).
ALIASES = {"2/m_uab": "2/m", "-3m1": "-3m", "-3_H": "-3", "-3m_H": "-3m", "-3m1_H": "-3m", "-31m_H": "-31m", "m3": "m-3", "m3m": "m-3m"}
#: Lattice type and the class of its full symmetry (fixed values).
HOLOHEDRY = {
    "triclinic": "-1", "monoclinic": "2/m", "orthorhombic": "mmm", "tetragonal": "4/mmm", "trigonal": "-3m", "rhombohedral": "-3m_R",
    "hexagonal": "6/mmm", "cubic": "m-3m",
}


def class_name(name: str) -> str:
    """The setting a name stands for; ValueError if there is none."""
    key = ALIASES.get(name.strip(), name.strip())
    if key not in GENERATORS:
        raise ValueError(f"no Laue class {name!r}; there are {', '.join(GENERATORS)}")
    return key


def holohedry(lattice: str | None, centering: str | None = "P", axis: str | None = "*") -> str | None:
    """The class of a lattice's full symmetry (None: no lattice named).

    A hexagonal lattice centred H or R is a rhombohedral one on hexagonal axes, of class
    -3m.  A monoclinic one follows its unique axis; without one it is b.
    """
    if lattice is None:
        return None
    lattice, axis = lattice.strip().lower(), (axis or "*").strip().lower()
    if lattice not in HOLOHEDRY:
        raise ValueError(f"no lattice type {lattice!r}; there are {', '.join(HOLOHEDRY)}")
    if lattice == "monoclinic":
        if axis not in "*abc":
            raise ValueError(f"no unique axis {axis!r}")
        return class_name(f"2/m_ua{axis}" if axis != "*" else "2/m")
    if lattice == "hexagonal" and (centering or "P").strip().upper() in ("H", "R"):
        return "-3m"
    return HOLOHEDRY[lattice]


def matrix(image: str) -> np.ndarray:
    """The integer matrix of an operation written as the images of h, k, l."""
    rows = []
    for part in image.split(","):
        row = [0, 0, 0]
        for sign, index in re.findall(r"([+-]?)([hkl])", part):
            row["hkl".index(index)] += -1 if sign == "-" else 1
        rows.append(row)
    return np.array(rows)


@cache
def operators(laue: str) -> tuple[tuple[int, ...], ...]:
    """All operators of a class as nine integers (rows give the new h, k, l): what its
    generators and the inversion make."""
    start = [np.eye(3, dtype=int), -np.eye(3, dtype=int), *map(matrix, GENERATORS[class_name(laue)])]
    group = {tuple(int(x) for x in m.ravel()) for m in start}
    while True:
        more = {tuple(int(x) for x in (np.reshape(a, (3, 3)) @ np.reshape(b, (3, 3))).ravel()) for a in group for b in group}
        if more <= group:
            return tuple(sorted(group))
        group |= more


def is_subgroup(small: str, large: str) -> bool:
    """Whether every operator of one class is one of the other."""
    return set(operators(small)) <= set(operators(large))


def unique_key(h: Column, k: Column, l: Column, laue: str) -> Column:
    """The largest h 1e8 + k 1e4 + l among the equivalents of a reflection, as a long.

    An operator's key is a sum of three products.  Each class has the inversion, so that the larger key of
    an operator and its opposite is the absolute value of either: half of them are written out."""
    keys, seen = [], set()
    for m in operators(laue):
        if tuple(-x for x in m) not in seen:
            seen.add(m)
            a, b, c = (m[i] * 100_000_000 + m[3 + i] * 10_000 + m[6 + i] for i in range(3))
            keys.append(F.abs(h.cast("long") * a + k.cast("long") * b + l.cast("long") * c))
    return F.greatest(*keys) if len(keys) > 1 else keys[0]
