"""Registration of queries and of the SQL they are checked against."""

from functools import wraps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame under a name, with its SQL if there is one."""

    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
