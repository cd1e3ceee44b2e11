"""Labels by a fixed alphabet of characters."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

ALPHABET = string.digits + string.ascii_uppercase + string.ascii_lowercase


def label_to_id(label: Column, alphabet: str = ALPHABET) -> Column:
    """Place of a character in the alphabet, -1 if it isn't there."""
    return (F.instr(F.lit(alphabet), label) - 1).cast("int")


def id_to_label(number: Column, alphabet: str = ALPHABET) -> Column:
    return F.substring(F.lit(alphabet), number + 1, F.lit(1))
