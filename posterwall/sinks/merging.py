"""Merging of duplicates across batches: a table of mergeable states.

Each batch brings one state per event that it has seen (first row, bounds, set of days) and publishes
them by one rename. A merged event is what the states of its key combine to. States combine in any
order and however often one is combined, so a batch that is repeated after a failure changes nothing,
and a crash between the two steps of `compact` leaves states twice at worst.

Orders must be comparable across batches: the smallest one supplies the first row.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from posterwall import versions
from posterwall.operators.grouping import combine_states, finish_states


@dataclass(frozen=True)
class MergeTable:
    """States below a folder, all of the schema that `event_states` gives."""

    path: str
    schema: StructType

    @property
    def _batches(self) -> str:
        return f"{self.path}/batches"

    @property
    def _compacted(self) -> str:
        return f"{self.path}/compacted"

    def add_batch(self, states: DataFrame, batch: int) -> bool:
        """Publish the states of a batch; False if that batch is there already."""
        spark, target = states.sparkSession, f"{self._batches}/b{batch:010d}"
        if versions.exists(spark, target):
            return False
        aside = f"{self.path}/_new-{uuid.uuid4().hex}"
        states.select(*self.schema.names).write.parquet(aside)
        try:
            versions.rename(spark, aside, target)
        except versions.WriteConflict:
            return False
        return True

    def _states(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        states = versions.read(spark, self._compacted, self.schema)
        return states.unionByName(spark.read.schema(self.schema).parquet(*folders)) if folders else states

    def states(self, spark: SparkSession) -> DataFrame:
        """One state per event of all batches."""
        return combine_states(self._states(spark, versions.folders(spark, self._batches)))

    def merged(self, spark: SparkSession, chronological: bool = False, genitive: bool = False) -> DataFrame:
        """The events that merging all batches at once would give."""
        return finish_states(self.states(spark), chronological, genitive)

    def compact(self, spark: SparkSession) -> None:
        """Combine what is there into one version; only the batches in it are dropped."""
        taken = versions.folders(spark, self._batches)
        if not taken:
            return
        base = versions.version(spark, self._compacted)
        versions.publish(combine_states(self._states(spark, taken)), self._compacted, base)
        versions.drop(spark, taken)
        versions.forget(spark, self._compacted)
