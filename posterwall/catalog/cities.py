"""City dimension: tokens, filters, lookups, sync."""

from pyspark.sql import functions as F

from posterwall.catalog import fixtures as fx
from posterwall.catalog.registry import query
from posterwall.functions.text import city_tokens
from posterwall.operators import sync
from posterwall.operators.citymatch import resolve_city, resolve_city_of_address
from posterwall.operators.filters import choose_cities, cities_with_ids, city_funnel, eligible_cities
from posterwall.session import shared_dir
from posterwall.sinks import tables
from posterwall.sources.tables import read_cities


@query("city_tokens", f"WITH {fx.CITIES} SELECT c._id, t.tok AS token FROM tokens t JOIN cities c USING (city_ord)")
def tokens(spark, sf_dir):
    return fx.cities(spark, sf_dir).select("_id", F.explode(city_tokens("name")).alias("token"))


def _supplier_names(spark, sf_dir):
    key = F.col("s_suppkey")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("Удаленно | "), "s_name"))
        .when(key % 5 == 1, F.concat("s_name", F.lit(" (все города)")))
        .when(key % 5 == 2, F.col("s_name"))
        .otherwise(F.concat(F.lit("Город | "), "s_name"))
    )
    return fx.table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("_id"), name.alias("name"), key.alias("city_ord")
    )


@query(
    "city_filter_funnel",
    """SELECT count(*) AS total, count(*) FILTER (WHERE s_suppkey % 5 < 2) AS excluded_phrase,
              count(*) FILTER (WHERE s_suppkey % 5 = 2) AS excluded_no_original,
              count(*) FILTER (WHERE s_suppkey % 5 > 2) AS eligible FROM supplier""",
)
def funnel(spark, sf_dir):
    return city_funnel(_supplier_names(spark, sf_dir))


@query(
    "city_choices",
    """WITH named AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 5 > 2)
       SELECT 'ids' AS choice, cast(k AS VARCHAR) AS _id FROM named WHERE k IN (SELECT c_custkey * 2 FROM customer)
       UNION ALL SELECT 'id', '3' FROM named WHERE k = 3
       UNION ALL SELECT 'name', cast(k AS VARCHAR) FROM named WHERE contains(lower(s_name), '#00000000')
       UNION ALL SELECT 'first', cast(k AS VARCHAR) FROM (SELECT k FROM named ORDER BY k LIMIT 7)""",
)
def choices(spark, sf_dir):
    """The ways to narrow the dimension: a set of ids, one id, a part of the name, the first ones."""
    cities = eligible_cities(_supplier_names(spark, sf_dir))
    ids = fx.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("string").alias("_id"))
    chosen = {
        "ids": cities_with_ids(cities, ids),
        "id": choose_cities(cities, city_id="3", city_name="ignored"),
        "name": choose_cities(cities, city_name="#00000000"),
        "first": choose_cities(cities, first=7),
    }
    first, *rest = [df.select(F.lit(how).alias("choice"), "_id") for how, df in chosen.items()]
    for part in rest:
        first = first.unionByName(part)
    return first


_ADDRESS_SQL = """CASE c_custkey % 5 WHEN 0 THEN c_name || ', ' || c_mktsegment || ', ' || n_name
        WHEN 1 THEN 'Bar Город ' || c_nationkey || ' • ' || c_mktsegment
        WHEN 2 THEN n_name || ' Hall, ' || c_mktsegment || ', ' || c_name
        WHEN 3 THEN c_mktsegment || ', floor ' || (c_custkey % 9) ELSE '' END"""


def _addresses(spark, sf_dir):
    key = F.col("c_custkey")
    nation = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = fx.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    address = (
        F.when(key % 5 == 0, F.concat_ws(", ", "c_name", "c_mktsegment", "n_name"))
        .when(key % 5 == 1, F.concat(F.lit("Bar Город "), "c_nationkey", F.lit(" • "), "c_mktsegment"))
        .when(key % 5 == 2, F.concat("n_name", F.lit(" Hall, "), "c_mktsegment", F.lit(", "), "c_name"))
        .when(key % 5 == 3, F.concat("c_mktsegment", F.lit(", floor "), key % 9))
        .otherwise("")
    )
    return customer.select("c_custkey", address.alias("address"))


_ADDRESSES = f"""addresses AS (
  SELECT c_custkey, {_ADDRESS_SQL} AS address FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "resolve_city_simple",
    f"""WITH {fx.CITIES}, {_ADDRESSES}, {fx.city_lookup_sql("city_of", "addresses", "address")}
        SELECT c_custkey, c._id AS city_id, c.country_id FROM addresses LEFT JOIN city_of c ON c.target = address""",
)
def resolve_simple(spark, sf_dir):
    resolved = resolve_city(_addresses(spark, sf_dir), fx.cities(spark, sf_dir), "address")
    return resolved.select("c_custkey", F.col("city._id").alias("city_id"), F.col("city.country_id").alias("country_id"))


@query(
    "resolve_city_address",
    f"""WITH {fx.CITIES}, {_ADDRESSES},
        targets AS (SELECT DISTINCT address, trim(lower(address)) AS target FROM addresses),
        parts AS (SELECT address, part, row_number() OVER (PARTITION BY address ORDER BY i DESC) AS p FROM (
          SELECT address, trim(unnest(regexp_split_to_array(target, '[,•]'))) AS part,
                 generate_subscripts(regexp_split_to_array(target, '[,•]'), 1) AS i FROM targets) WHERE part <> ''),
        last_parts AS (SELECT * FROM parts WHERE p <= 3),
        words AS (SELECT address, p, word, row_number() OVER (PARTITION BY address, p ORDER BY i DESC) AS w,
                         lead(word) OVER (PARTITION BY address, p ORDER BY i DESC) AS before FROM (
          SELECT address, p, unnest(string_split(part, ' ')) AS word, generate_subscripts(string_split(part, ' '), 1) AS i
          FROM last_parts) WHERE length(word) > 2),
        probes AS (
          SELECT address, p, 2 * w AS step, 'word' AS kind, word AS txt FROM words
          UNION ALL SELECT address, p, 2 * w + 1, 'pair', before || ' ' || word FROM words WHERE before IS NOT NULL
          UNION ALL SELECT address, p, 1000000, 'part', part FROM last_parts),
        hits AS (
          SELECT address, arg_min(city_ord, row(p, step, city_ord)) AS city_ord FROM probes
          JOIN tokens ON (contains(tok, txt) OR contains(txt, tok))
            AND (kind = 'pair' OR (kind = 'word' AND txt = tok) OR length(txt) >= 4 OR length(tok) >= 4)
          GROUP BY address)
        SELECT c_custkey, c._id AS city_id, c.country_id FROM addresses
        LEFT JOIN hits USING (address) LEFT JOIN cities c ON c.city_ord = hits.city_ord""",
)
def resolve_address(spark, sf_dir):
    resolved = resolve_city_of_address(_addresses(spark, sf_dir), fx.cities(spark, sf_dir), "address")
    return resolved.select("c_custkey", F.col("city._id").alias("city_id"), F.col("city.country_id").alias("country_id"))


# Sync: customers as incoming cities, two per id; every third id is present already.

def _incoming(spark, sf_dir):
    key = F.col("c_custkey")
    known = F.struct(F.lit("1.5").alias("lat"), F.lit("2.5").alias("lon"))
    return fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key - key % 2).alias("_id"),
        F.col("c_nationkey").cast("string").alias("country_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("sort"),
        F.when(key % 4 == 0, known).alias("coordinates"),
        key.alias("input_ord"),
    )


def _existing(spark, sf_dir):
    key = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").where(key % 6 == 0).select(
        F.concat(F.lit("c"), key).alias("_id"), (key / 6 + 1).cast("bigint").alias("city_ord")
    )


_INCOMING = """first_rows AS (
  SELECT 'c' || c_custkey AS _id, c_name AS name, c_custkey AS ord, CASE WHEN c_nationkey = 0 THEN 999 ELSE c_nationkey END AS sort,
         CASE WHEN c_custkey % 4 = 0 THEN '1.5' ELSE '0' END AS lat FROM customer WHERE c_custkey % 2 = 0),
existing AS (SELECT 'c' || c_custkey AS _id, c_custkey // 6 + 1 AS city_ord FROM customer WHERE c_custkey % 6 = 0)"""


@query(
    "sync_insert_only",
    f"""WITH {_INCOMING}
        SELECT _id, name, sort, lat, row_number() OVER (ORDER BY ord) + (SELECT max(city_ord) FROM existing) AS city_ord
        FROM first_rows WHERE _id NOT IN (SELECT _id FROM existing)""",
)
def sync_insert_only(spark, sf_dir):
    existing = _existing(spark, sf_dir)
    new = sync.rows_to_insert(_incoming(spark, sf_dir), existing)
    rows = sync.city_defaults(sync.number_cities(new, existing))
    return rows.select("_id", "name", "sort", F.col("coordinates.lat").alias("lat"), "city_ord")


@query("sync_replace_all", f"WITH {_INCOMING} SELECT _id, name, sort, lat, row_number() OVER (ORDER BY ord) AS city_ord FROM first_rows")
def sync_replace_all(spark, sf_dir):
    nothing = _existing(spark, sf_dir).limit(0)
    rows = sync.city_defaults(sync.number_cities(sync.first_per_id(_incoming(spark, sf_dir)), nothing))
    return rows.select("_id", "name", "sort", F.col("coordinates.lat").alias("lat"), "city_ord")


@query(
    "sync_statistics",
    f"""WITH {_INCOMING}
        SELECT 'insert' AS mode, count(*) FILTER (WHERE _id NOT IN (SELECT _id FROM existing)) AS created, 0 AS deleted FROM first_rows
        UNION ALL SELECT 'replace', count(*), (SELECT count(*) FROM existing) FROM first_rows""",
)
def sync_statistics(spark, sf_dir):
    incoming, existing = _incoming(spark, sf_dir), _existing(spark, sf_dir)
    parts = [
        sync.sync_statistics(incoming, existing, replace).select(F.lit(mode).alias("mode"), "created", "deleted")
        for mode, replace in (("insert", False), ("replace", True))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "sync_city_table",
    f"""WITH {_INCOMING}
        SELECT _id, 'known' AS name, city_ord FROM existing
        UNION ALL
        SELECT _id, name, row_number() OVER (ORDER BY ord) + (SELECT max(city_ord) FROM existing)
        FROM first_rows WHERE _id NOT IN (SELECT _id FROM existing)""",
)
def sync_city_table(spark, sf_dir):
    """Insert-only sync of a written table."""
    path = shared_dir(spark, "cities")
    incoming = _incoming(spark, sf_dir)
    known = _existing(spark, sf_dir).withColumn("name", F.lit("known"))
    columns = ("_id", "country_id", "name", "sort", "coordinates", "city_ord")
    known.unionByName(incoming.limit(0), allowMissingColumns=True).select(*columns).write.parquet(path)
    tables.sync_cities(spark, incoming, path)
    return read_cities(spark, path).select("_id", "name", "city_ord")
