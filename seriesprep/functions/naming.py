"""File names, hash ids, dataset versions and split names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesprep.schema import (
    CLASS_NAMES,
    SOURCE_NAMES,
    VERSION_PREFIX,
    class_label,
    source_label,
)

HASH_ID_LENGTH = 7


def decoded_path(path: Column) -> Column:
    """A path as it is named, from the URL-encoded form of ``_metadata.file_path``."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def plain_path(path: Column) -> Column:
    """Whole path without scheme: the same text however a reader spells it."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def class_folder(path: Column) -> Column:
    """Numeric class folder right above the file, null when it is not a number."""
    digits = F.regexp_extract(path, r"/([0-9]+)/[^/]+$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def event_key(path: Column) -> Column:
    """Collision-free key of an event: full sha-256 of ``<class folder>/<file stem>``."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.sha2(F.concat_ws("/", folder, file_stem(path)), 256)


def hash_id(path: Column) -> Column:
    """Seven-character display id. It collides at scale; join on :func:`event_key`."""
    return F.substring(event_key(path), 1, HASH_ID_LENGTH)


def source_of(stem: Column) -> Column:
    return (
        F.when(stem.startswith("WELL"), SOURCE_NAMES[0])
        .when(stem.startswith("SIMULATED"), SOURCE_NAMES[1])
        .when(stem.startswith("DRAWN"), SOURCE_NAMES[2])
    )


def well_id_of(stem: Column) -> Column:
    digits = F.regexp_extract(stem, r"^WELL-([0-9]+)_", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def recorded_at(stem: Column) -> Column:
    digits = F.regexp_extract(stem, r"^WELL-[0-9]+_([0-9]{14})$", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))


def directory_version(name: Column) -> Column:
    """Dotted version in a converted-dataset folder name, null when there is none."""
    pattern = VERSION_PREFIX + r"([0-9]+(\.[0-9]+)*)"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def version_number(version: Column) -> Column:
    """``a.b.c`` as ``a*10000 + b*100 + c``; a single number is taken as it is."""
    parts = F.split(version, r"\.")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    dotted = part(0) * 10000 + part(1) * 100 + part(2)
    return F.when(F.size(parts) > 1, dotted).when(version.isNotNull(), part(0))


def split_base_name(
    version: str,
    test_size: float,
    class_types: Sequence[int | str] | None = None,
    sources: Sequence[int | str] | None = None,
    well_ids: Sequence[int] | None = None,
) -> str:
    """Name shared by the folders of one split; no filter or a full set reads ``all``."""
    parts = {"source": "all", "class": "all", "well": "all"}
    if sources is not None:
        chosen = {source_label(s) for s in sources}
        if len(chosen) < len(SOURCE_NAMES):
            initials = {"REAL": "r", "SIMULATED": "s", "HAND_DRAWN": "d"}
            parts["source"] = "-".join(initials[n] for n in SOURCE_NAMES if n in chosen)
    if class_types is not None and len(class_types) != len(CLASS_NAMES):
        codes = sorted(CLASS_NAMES.index(class_label(c)) for c in class_types)
        parts["class"] = "-".join(str(c) for c in codes)
    if well_ids is not None:
        parts["well"] = "-".join(str(w) for w in sorted(well_ids))
    filters = [f"{name}-{text}" for name, text in parts.items()]
    return "_".join([f"{VERSION_PREFIX}{version}", f"split-{int(test_size * 100)}", *filters])


def split_name(base: str, split: Column) -> Column:
    return F.concat_ws("_", F.lit(base), split)
