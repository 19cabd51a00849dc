"""What the three sources share: parameters and the event contract."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from posterwall.constants import DEFAULT_SPECIALIZATION
from posterwall.schemas import EVENT_FIELDS


@dataclass(frozen=True)
class RunParameters:
    run_id: str
    admin_id: str | None = None
    country_id: str | None = None
    city_id: str | None = None
    city_name: str | None = None
    specialization: str = DEFAULT_SPECIALIZATION
    max_cities: int | None = None


def to_events(df: DataFrame, params: RunParameters, source: str, order: str = "ord") -> DataFrame:
    """Exactly the event columns plus `ord`; columns a source does not fill are NULL."""
    filled = df.withColumns(
        {
            "operationId": F.lit(params.run_id),
            "admin_id": F.lit(params.admin_id),
            "source": F.lit(source),
        }
    )
    columns = [
        (F.col(c) if c in filled.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in EVENT_FIELDS.items()
    ]
    return filled.select(*columns, F.col(order).alias("ord"))


def union_events(*parts: DataFrame) -> DataFrame:
    """Events of several sources as one table."""
    result, *rest = (p.drop("ord") for p in parts)
    for part in rest:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
