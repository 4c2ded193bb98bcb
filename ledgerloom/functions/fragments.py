"""Cutting long texts, blocks and page images into pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import packed
from .positions import given_back, placed


def fragment_text(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """A row for each piece of at most size characters: frag_no, start, fragment and all
    other columns. Neighbours share overlap characters. An empty or null text has one empty
    piece. Everything happens within a row, without a shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    whole = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(whole) - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    # cut before the rows are made, so that a row needn't carry the whole text
    parts = F.transform(starts, lambda s, i: F.struct(i.alias("frag_no"), s.alias("start"), F.substring(whole, s + 1, F.lit(size)).alias("fragment")))
    return df.select("*", F.inline(parts))


def pack_blocks(df: DataFrame, file: str, block_no: str, text: str, size: int) -> DataFrame:
    """df with frag_no: blocks in order fill a fragment until the next one would exceed size; a
    block longer than size has a fragment of its own, with empty blocks before it. Blocks of one
    number are in the order of a hash of their rows. Lengths alone are sorted, in parts that
    may begin in the middle of a file, so a file of any length is packed by all tasks."""
    places = placed(df, [file, block_no], n=F.coalesce(F.length(text), F.lit(0)).cast("long"))
    return given_back(df, [file, block_no], packed(places, size), ["frag_no"])


def neighbour_context(df: DataFrame, file: str, order: str, text: str, n: int) -> DataFrame:
    """df with before and after: the last n characters of the piece before, the first n of the
    one after (null at the file's ends). Pieces of one place are in the order of a hash of their
    rows. Keys and these characters alone are sorted, in parts that may begin in the middle
    of a file; of each part its first and last row are shown to its neighbours."""
    places = placed(df, [file, order], head=F.left(text, F.lit(n)), tail=F.right(text, F.lit(n)))
    at = F.struct("k0", "k1", "h", "occ")
    first, last = F.struct("k0", F.col("head").alias("x")), F.struct("k0", F.col("tail").alias("x"))
    ends = places.groupBy("part").agg(F.min_by(first, at).alias("first"), F.max_by(last, at).alias("last"))
    parts = Window.orderBy("part")  # a row a part
    ends = ends.select("part", F.lag("last").over(parts).alias("last"), F.lead("first").over(parts).alias("first"))
    own = Window.partitionBy("part").orderBy("k0", "k1", "h", "occ")
    near = places.select("*", F.lag(last).over(own).alias("a"), F.lead(first).over(own).alias("z")).join(F.broadcast(ends), "part")
    near = near.withColumn("a", F.coalesce("a", "last")).withColumn("z", F.coalesce("z", "first"))
    found = near.select("k0", "k1", "h", *(F.when(F.col(c)["k0"].eqNullSafe(F.col("k0")) & F.col(c).isNotNull(), F.col(c)["x"]).alias(name) for c, name in (("a", "before"), ("z", "after"))))
    return given_back(df, [file, order], found, ["before", "after"])


def image_regions(df: DataFrame, width: str, height: str, tile: int, overlap: int) -> DataFrame:
    """A row for each region x0, y0, x1, y1 of a grid over each page image."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be smaller than tile")

    def starts(size: str):
        return F.sequence(F.lit(0), F.greatest(F.col(size) - overlap, F.lit(1)) - 1, F.lit(tile - overlap))

    grid = df.select("*", F.explode(starts(width)).alias("x0")).select("*", F.explode(starts(height)).alias("y0"))
    return grid.withColumn("x1", F.least(F.col("x0") + tile, F.col(width))).withColumn("y1", F.least(F.col("y0") + tile, F.col(height)))
