"""Approximate top-n: vectors in cells around trained centres, and a search of the cells nearest to a question.

The stored table is laid out by cell, so a search reads the row groups of the probed cells only, and ranks what it finds
exactly. More probes find more of the true neighbours and score more rows.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from listingloom.operators.centres import nearest_centres, trained
from listingloom.operators.nearest import top_hits


def build_cell_table(vectors: DataFrame, path: str, cells: int) -> tuple[DataFrame, np.ndarray]:
    """A copy of a stored vector table laid out by cell, and the centres. A crowded cell spreads over files by chunk id."""
    centres = trained(vectors, "chunk_id", "embedding", cells)
    celled = vectors.withColumn("cell", nearest_centres(F.col("embedding"), centres, 1)[0])
    laid_out = celled.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")
    laid_out.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path), centres


def approximate_top_hits(
    questions: DataFrame, cells: DataFrame, centres: np.ndarray, probes: int, carry: tuple[str, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """top_hits over the cells of the `probes` centres nearest to each question."""
    return top_hits(questions.withColumn("cells", nearest_centres(F.col("vector"), centres, probes)), cells, carry, keep=keep)
