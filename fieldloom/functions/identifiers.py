"""Identifiers, labels and repair of types, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the files' formats: a crop's name (field without underscores, patch, cell line, local id) and the words
# that stand for true.
CROP_NAME = r"^field_([^_]+)_patch_(\d+)_cellline_(.+?)_localid_(\d+)$"
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def _group(column: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def fov_token(name: Column) -> Column:
    """``F<digits>`` from ``FOV<digits>``, else from the first ``F<digits>``; digits as they are. Null if neither."""
    return F.concat(F.lit("F"), F.coalesce(_group(name, r"FOV(\d+)"), _group(name, r"F(\d+)")))


def fov_index(name: Column, any_digits: bool = False) -> Column:
    """Number of a field of view: ``FOV<digits>``, else ``F<digits>`` at a word's start, else any digits if asked."""
    found = [_group(name, r"FOV(\d+)"), _group(name, r"\bF(\d+)\b")] + ([_group(name, r"(\d+)")] if any_digits else [])
    return F.coalesce(*found).cast("int")


def patch_index(name: Column) -> Column:
    return _group(name, r"patch_(\d+)").cast("int")


def of_fov(name: Column, fov: Column) -> Column:
    """Whether a file belongs to a field: its name holds ``_<fov>_``."""
    return F.contains(name, F.concat(F.lit("_"), fov, F.lit("_")))


def image_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def safe_text(value: Column) -> Column:
    """Spaces as underscores; only letters, digits, ``_``, ``-`` and ``.`` stay."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), " ", "_"), r"[^A-Za-z0-9_.\-]", "")


def crop_key(field: Column, patch: Column, cell_line: Column, local_id: Column) -> Column:
    parts = [F.lit("field_"), safe_text(field), F.lit("_patch_"), safe_text(patch), F.lit("_cellline_"), safe_text(cell_line), F.lit("_localid_"), safe_text(local_id)]
    return F.concat(*parts)


def crop_fields(stem: Column) -> dict[str, Column]:
    """field, patch_idx, cell_line and local_id of a crop's name; all null if it isn't one."""
    return {
        "field": _group(stem, CROP_NAME, 1),
        "patch_idx": _group(stem, CROP_NAME, 2).cast("int"),
        "cell_line": _group(stem, CROP_NAME, 3),
        "local_id": _group(stem, CROP_NAME, 4).cast("int"),
    }


def object_key(fov: Column, kind: str, index: Column) -> Column:
    return F.concat_ws("_", fov, F.lit(kind), index.cast("string"))


def patch_object_key(fov: Column, patch: Column, kind: str, local_id: Column) -> Column:
    return F.concat_ws("_", fov, F.lit("patch"), patch.cast("string"), F.lit(kind), local_id.cast("string"))


def as_key(value: Column) -> Column:
    return F.trim(value.cast("string"))


def normalised_label(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def slide_key(value: Column) -> Column:
    """Slides are compared in upper case: one side writes them in lower case."""
    return F.upper(F.trim(value.cast("string")))


def as_flag(value: Column, kind: str) -> Column:
    """A boolean from a column of ``kind`` (boolean, a number or string); null is false."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "string":
        return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS), F.lit(False))
    return F.coalesce(value == 1, F.lit(False))


def column_fragment(value: str) -> str:
    """A class value as part of a column name."""
    return re.sub(r"[^A-Za-z0-9]+", "_", value).strip("_")


def lenient_double(value: Column) -> Column:
    """Text to a number; null where it isn't one."""
    return value.cast("string").try_cast("double")


def lenient_int(value: Column) -> Column:
    """Text to a whole number through a double, so that "0.7" is 0; null where it isn't a number."""
    return lenient_double(value).try_cast("int")


def binary_class(value: Column) -> Column:
    """0 or 1 from a number or from normal and abnormal; null for all else."""
    label = normalised_label(value)
    named = F.when(label.isin("normal", "0"), F.lit(0)).when(label.isin("abnormal", "1"), F.lit(1))
    found = F.coalesce(lenient_int(value), named)
    return F.when(found.isin(0, 1), found)


def class_group(value: Column, normal: Sequence[str], abnormal: Sequence[str]) -> Column:
    """Normal or Abnormal by lists of labels; null for others."""
    label = normalised_label(value)
    return F.when(label.isin(*[x.lower().strip() for x in normal]), F.lit("Normal")).when(label.isin(*[x.lower().strip() for x in abnormal]), F.lit("Abnormal"))


def in_tube(myotube_id: Column) -> Column:
    """Whether a nucleus lies in a tube: its id is a number other than -1, or text that isn't "-1". Null: no."""
    number = lenient_double(myotube_id)
    return F.coalesce(F.when(number.isNotNull(), number != -1).otherwise(F.trim(myotube_id.cast("string")) != "-1"), F.lit(False))


def natural_key(name: Column) -> Column:
    """Sorts like the name with its runs of digits as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def require_columns(df: DataFrame, needed: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` itself; an error that lists the columns it lacks."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """``df`` with each canonical name taken from the first of its candidates that is there; null if optional."""
    chosen: dict[str, Column] = {}
    for name, names in candidates.items():
        found = next((c for c in names if c in df.columns), None)
        if found is None and name not in optional:
            raise ValueError(f"none of {list(names)} is a column for {name}")
        chosen[name] = F.col(f"`{found}`") if found is not None else F.lit(None).cast("string")
    return df.withColumns(chosen)
