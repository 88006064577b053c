"""The eight search labels over hand metadata: predicates, opposites, types and true labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label, its opposite, its type.
LABELS = {
    "left-hand": ("right-hand", "left-right"),
    "right-hand": ("left-hand", "left-right"),
    "dorsal": ("palmar", "side"),
    "palmar": ("dorsal", "side"),
    "with-accessories": ("without-accessories", "accessories"),
    "without-accessories": ("with-accessories", "accessories"),
    "male": ("female", "gender"),
    "female": ("male", "gender"),
}


def known(label: str) -> str:
    if label not in LABELS:
        raise ValueError(f"unknown label {label!r}; known: {', '.join(LABELS)}")
    return label


def condition(label: str, aspect: str = "aspect_of_hand", accessories: str = "accessories", gender: str = "gender") -> Column:
    """Rows that carry the label. Rows without the metadata field never do."""
    kind = LABELS[known(label)][1]
    if kind == "gender":
        return F.col(gender) == label
    if kind == "accessories":
        return F.col(accessories) == int(label == "with-accessories")
    return F.col(aspect).contains(label.removesuffix("-hand"))


def _lookup(label: Column, of: int) -> Column:
    pairs = [F.lit(x) for k, v in LABELS.items() for x in (k, v[of])]
    return F.element_at(F.create_map(*pairs), label)


def opposite(label: Column) -> Column:
    return _lookup(label, 0)


def type_of(label: Column) -> Column:
    return _lookup(label, 1)


def true_label(kind: Column, aspect: Column, accessories: Column, gender: Column) -> Column:
    """The label of a type that the metadata give."""
    parts = F.split(aspect, " ", 2)
    return (
        F.when(kind == "left-right", F.concat(F.element_at(parts, 2), F.lit("-hand")))
        .when(kind == "side", F.element_at(parts, 1))
        .when(kind == "accessories", F.when(accessories == 1, "with-accessories").otherwise("without-accessories"))
        .when(kind == "gender", gender)
    )


def side_of(aspect: Column) -> Column:
    """dorsal if the text says so, else palmar."""
    return F.when(aspect.contains("dorsal"), "dorsal").otherwise("palmar")


def mentions(aspect: Column, label: str) -> Column:
    """The label, in any case, somewhere in the text; false without text."""
    return F.coalesce(F.lower(aspect).contains(label.lower()), F.lit(False))
