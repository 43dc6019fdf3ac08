"""Alignment of summary statistics that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.variants import neg_log10
from helixframe.operators.align import KEY, with_match_key
from helixframe.reference import ReferencePanel


def align_stream(stream: DataFrame, reference: ReferencePanel) -> DataFrame:
    """stream: chr, bp, a1, a2, p and more. The rows that match a variant, with its place and logp.

    A stream-static inner join without state: each row is matched when it comes. Uniqueness is not checked here, since
    rows that come later may repeat a key.
    """
    own = with_match_key(reference.variants).select("chr", "bp", "m1", "m2", "local_idx", "snp")
    rest = [c for c in stream.columns if c not in (*KEY, "p")]
    found = with_match_key(stream).join(own, ["chr", "bp", "m1", "m2"])
    return found.select("chr", "local_idx", "snp", neg_log10(F.col("p")).alias("logp"), *rest)
