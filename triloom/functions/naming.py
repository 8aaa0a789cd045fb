"""Canonical spellings of identifiers, as Catalyst expressions (no Python at run time).

Nulls stay null; a name of nothing but blanks and punctuation becomes null as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks and punctuation between and around the parts of a name.
_SEP = r"[\s\p{Punct} ​﻿]"
_TAIL = _SEP + r"+o0*([0-9]+)" + _SEP + r"+run0*([0-9]+)" + _SEP + "*$"
#: Stands between the parts of a key; no name holds it.
_MARK = "\u0001"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(name: Column | str) -> Column:
    """Lower case without blanks and punctuation: ``N400-r50x8 `` and ``n400_r50x8`` are one name."""
    s = F.regexp_replace(F.lower(_c(name)), _SEP + "+", "")
    return F.when(s != "", s)


def trajectory_key(traj_id: Column | str) -> Column:
    """Shape, overlap and run of a trajectory id however it is spelled, as one key.

    Case, separators, surrounding blanks and leading zeros of the two numbers are
    ignored. An id that has not the form ``<shape>_o<overlap>_run<run>`` is squeezed.
    """
    s = F.regexp_replace(F.lower(_c(traj_id)), _TAIL, f"{_MARK}$1{_MARK}$2")
    s = F.regexp_replace(s, _SEP + "+", "")
    return F.when(s != "", s)


def trajectory_shape(traj_id: Column | str) -> Column:
    """The squeezed shape part of an id, null if the id has not the usual form."""
    parts = F.split(trajectory_key(traj_id), _MARK)
    return F.when(F.size(parts) == 3, parts[0])


def trajectory_run(traj_id: Column | str) -> Column:
    """The run number in an id, null if the id has not the usual form."""
    parts = F.split(trajectory_key(traj_id), _MARK)
    return F.when(F.size(parts) == 3, parts[2].try_cast("bigint"))


def micro_units(x: Column | str) -> Column:
    """A double to six decimals as a whole number; null for null and NaN."""
    x = _c(x)
    return F.when(~F.isnan(x), F.round(x * F.lit(1e6)).cast("bigint"))


def path_parts(path: Column | str) -> Column:
    """Parts of a path written with either separator, empty and ``.`` parts left out."""
    return F.filter(F.split(_c(path), r"[\\/]+"), lambda p: (p != "") & (p != "."))


def complete_object(text: Column | str) -> Column:
    """The text as a VARIANT if it is one complete JSON object, else null.

    The text is parsed as the only element of a list, so that anything after the
    object makes it incomplete.
    """
    v = F.try_parse_json(F.concat(F.lit("["), _c(text), F.lit("]")))
    whole = F.variant_get(v, "$[0]", "variant")
    return F.when(
        F.schema_of_variant(whole).startswith("OBJECT") & F.variant_get(v, "$[1]", "variant").isNull(), whole
    )
