"""The search of published records by the parameters of the service's interface, as predicates that reach the scan."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters that equal a column (one value or several), flags that a column holds, columns that must be filled, and lists that must hold something.
EQUAL = ("enr_cab_createur", "enr_ge_createur", "enr_code_insee", "enr_statut", "enr_ref_dossier")
FLAGS = ("enr_visible", "enr_grand_public", "enr_rfu", "enr_perimetre_obligatoire")
FILLED = ("enr_polygone_emprise", "enr_memo")
LISTS = ("localisants", "dmpc", "references_cadastrales", "documents_joints", "clients", "operations")
BOUNDS = {"enr_date_min": ">=", "enr_date_max": "<="}
#: The order of the results.
ORDER = ("enr_cab_createur", "enr_ref_dossier")


def day(text: str) -> datetime.date:
    """AAAA-MM-JJ or JJ-MM-AAAA."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})|(\d{2})-(\d{2})-(\d{4})", text.strip())
    if not m:
        raise ValueError(f"no day: {text!r}")
    parts = [int(x) for x in m.groups() if x]
    return datetime.date(*(parts if m[1] else reversed(parts)))


def flag(text: str | bool) -> bool:
    value = {"true": True, "false": False}.get(str(text).strip().lower())
    if value is None:
        raise ValueError(f"neither true nor false: {text!r}")
    return value


def extra(text: str, column: str = "enr_extra") -> Column:
    """``champ:valeur`` asks for one field of the further information (a map), other texts are looked for in all of them, in any case."""
    field, colon, value = text.partition(":")
    if colon and field.strip():
        return F.lower(F.try_element_at(F.col(column), F.lit(field.strip()))) == value.strip().lower()
    return F.exists(F.map_values(column), lambda v: F.contains(F.lower(v), F.lit(text.strip().lower())))


def predicates(params: dict[str, object], date: str = "enr_date_dossier") -> list[Column]:
    """A predicate for each parameter; unknown ones and values of a wrong form raise an error."""
    out = []
    for name, given in params.items():
        if name in ("offset", "limit"):
            continue
        values = given if isinstance(given, (list, tuple)) else [given]
        if name in EQUAL:
            out.append(F.col(name).isin(*values) if len(values) > 1 else F.col(name) == values[0])
        elif name in BOUNDS:
            bound = F.lit(day(str(values[0])))
            out.append(F.col(date) >= bound if BOUNDS[name] == ">=" else F.col(date) <= bound)
        elif name in FLAGS:
            out.append(F.col(name) == flag(values[0]))
        elif name in FILLED:
            out.append(F.col(name).isNotNull() if flag(values[0]) else F.col(name).isNull())
        elif name in LISTS:
            n = F.coalesce(F.size(name), F.lit(0))
            out.append(n > 0 if flag(values[0]) else n <= 0)
        elif name == "enr_extra":
            out += [extra(str(v)) for v in values]
        else:
            raise ValueError(f"unknown parameter {name!r}")
    return out


def matching(records: DataFrame, params: dict[str, object], date: str = "enr_date_dossier") -> DataFrame:
    """All records that meet every parameter, in no order."""
    for p in predicates(params, date):
        records = records.filter(p)
    return records


def found(records: DataFrame, params: dict[str, object], date: str = "enr_date_dossier") -> tuple[DataFrame, dict[str, int | None]]:
    """A page of matching() in order, and count, next and previous (offsets, null where there is no such page)."""
    hits = matching(records, params, date)
    offset, limit = int(params.get("offset", 0)), params.get("limit")
    page, count = hits.orderBy(*ORDER).offset(offset), hits.count()
    if limit is None:
        return page, {"count": count, "next": None, "previous": None}
    n = int(limit)
    return page.limit(n), {"count": count, "next": offset + n if offset + n < count else None, "previous": max(0, offset - n) if offset else None}
