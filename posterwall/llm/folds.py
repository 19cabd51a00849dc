"""Hold-out folds that depend on the document's id alone."""

from pyspark.sql import Column, functions as F


def held_out(id_column: str, fold: int, of: int) -> Column:
    """True where crc32 of the id as text leaves `fold` modulo `of`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % of == fold, F.lit(False))
