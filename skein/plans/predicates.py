"""Constraints as one Catalyst predicate: extensions are alternatives, everything else must hold."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.paths import DIRTY, STAGED, WT_NEW, has_bits, name_of
from skein.functions.text import fold_ascii, fold_text
from skein.plans.dsl import Constraint
from skein.plans.glob import glob_regex


def predicate(c: Constraint, path: Column, status: Column | None = None) -> Column:
    """Never null. ``type`` filters hold for every file; without a status column every file is clean."""
    low = fold_ascii(path)
    if c.kind == "not":
        return ~predicate(c.inner, path, status)
    if c.kind == "extension":
        name = name_of(low)
        out = name.endswith("." + fold_text(c.value)) & (F.length(name) > len(c.value) + 1)
    elif c.kind == "segment":
        out = F.concat(F.lit("/"), low).contains("/" + fold_text(c.value) + "/")
    elif c.kind == "file":
        out = F.concat(F.lit("/"), low).endswith("/" + fold_text(c.value))
    elif c.kind == "glob":
        out = path.rlike(glob_regex(c.value))
    elif c.kind == "text":
        out = low.contains(fold_text(c.value))
    elif c.kind == "status":
        bits = F.lit(None).cast("int") if status is None else status
        out = {"modified": has_bits(bits, DIRTY), "untracked": has_bits(bits, WT_NEW), "staged": has_bits(bits, STAGED), "clean": F.coalesce(bits, F.lit(0)) == 0}[c.value]
    else:
        out = F.lit(True)
    return F.coalesce(out, F.lit(False))


def conjunction(constraints: tuple[Constraint, ...], path: Column, status: Column | None = None) -> Column:
    extensions = [predicate(c, path, status) for c in constraints if c.kind == "extension"]
    others = [predicate(c, path, status) for c in constraints if c.kind != "extension"]
    return reduce(and_, others + ([reduce(or_, extensions)] if extensions else []), F.lit(True))
