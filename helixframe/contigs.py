"""Contig labels: the closed, ordered set that every object is split by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels in canonical order, and labels that are recognised and dropped.
CONTIGS = (*(str(i) for i in range(1, 23)), "X")
IGNORED = ("Y", "MT")
CHRX_SEXES = ("female", "male", "combined")


def chr_rank(label: Column) -> Column:
    """1 to 23 for 1-22 and X; null for other labels."""
    return F.when(label == "X", F.lit(23)).when(label.isin(*CONTIGS), label.try_cast("int"))


def is_styled(label: Column) -> Column:
    """Labels such as chr1, which are never normalised."""
    return F.startswith(F.lower(label), F.lit("chr"))


def check_request(requested: Sequence[str], available: Sequence[str], where: str) -> list[str]:
    """The requested labels, if they are a non-empty, duplicate-free part of the available ones in canonical order."""
    wanted = [requested] if isinstance(requested, str) else list(requested)
    if not wanted:
        raise ValueError(f"{where}: at least one shard must be requested")
    if len(set(wanted)) != len(wanted):
        raise ValueError(f"{where}: duplicate shard labels")
    for label in wanted:
        if label not in CONTIGS:
            raise ValueError(f"{where}: unknown shard label {label!r}")
        if label not in available:
            raise ValueError(f"{where}: shard {label!r} is not there")
    if wanted != sorted(wanted, key=CONTIGS.index):
        raise ValueError(f"{where}: shards must be in canonical order")
    return wanted
