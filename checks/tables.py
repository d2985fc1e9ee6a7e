"""Play history, tracks and genres derived from the given tables, in Spark and as SQL.

``ev`` has ids, hours and a month of plays; ``li`` has years of plays, at midnight and without ids.
Both add the NULLs, zero plays and old release dates that the given tables lack.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.sources.genres import genre_dimension, track_genre_bridge
from playtrail.sources.history import MUSIC_URI, TS_PATTERN

PLAYS_PER_DOCUMENT = 250
COUNTRIES = ("US", "NO", "ES", "DE", "FR", "IT", "GB")


# The given tables. A fixed schema spares a job per read that would infer it from the files.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders":
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem":
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:
            path = f"{self.folder}/{name}.parquet"
            self._read[name] = self.spark.read.schema(GIVEN[name]).parquet(path)
        return self._read[name]

    def _named(self, plays: DataFrame) -> DataFrame:
        part = self.raw("part").selectExpr(
            "p_partkey",
            "p_name AS track",
            "nullif(p_brand, 'Brand#13') AS artist",
            "nullif(p_type, 'PROMO') AS album",
            "cast(p_partkey AS string) AS track_uri",
        )
        return plays.join(part, "p_partkey").drop("p_partkey")

    @cached_property
    def ev(self) -> DataFrame:
        countries = ", ".join(f"'{c}'" for c in COUNTRIES)
        plays = self.raw("events").selectExpr(
            "cast(get_json_object(props, '$.k') AS bigint) AS p_partkey",
            "event_id AS id",
            "ts",
            "if(event_id % 50 = 0, 0L, floor(value * 1000)) AS ms_played",
            "decode(event_type, 'error', 'forward', 'signup', 'back', 'trackdone') AS reason_end",
            "if(event_type = 'view', NULL, event_type IN ('error', 'signup')) AS skipped",
            f"element_at(array({countries}), cast(user_id % 7 + 1 AS int)) AS country",
        )
        return self._named(plays)

    @cached_property
    def li(self) -> DataFrame:
        plays = self.raw("lineitem").selectExpr(
            "l_partkey AS p_partkey",
            "l_shipdate AS ts",
            "floor(l_extendedprice) AS ms_played",
            "decode(l_returnflag, 'R', true, 'A', false) AS skipped",
        )
        return self._named(plays)

    @cached_property
    def tracks(self) -> DataFrame:
        words = "split(p_name, ' ')"
        return self.raw("part").selectExpr(
            "cast(p_partkey AS string) AS track_uri",
            "p_name AS track",
            "nullif(p_brand, 'Brand#13') AS artist",
            "p_size AS track_popularity",
            "CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN date'1899-06-01' "
            "ELSE date_add(date'1950-01-01', cast(p_partkey * 37 % 18800 AS int)) END AS album_release_date",
            "p_type AS album",
            "p_size * 1000 AS duration_ms",
            "p_partkey % 2 = 0 AS explicit",
            "lower(p_type) AS album_type",
            "p_size AS total_tracks",
            f"if(p_partkey % 19 = 0, '', concat('[\"', {words}[0], '\",\"', {words}[1], '\"]')) AS genres",
            "cast(floor(p_retailprice) % 101 AS int) AS artist_popularity",
            "concat('artist:', p_brand) AS artist_uri",
            "p_partkey * 10 AS artist_followers",
        )

    @cached_property
    def genres(self) -> DataFrame:
        return genre_dimension(self.tracks)

    @cached_property
    def track_genres(self) -> DataFrame:
        return track_genre_bridge(self.tracks)

    @cached_property
    def documents(self) -> DataFrame:
        """Events as export documents of a fixed number of plays; some are cut, some are no JSON, some go on after the end.

        Of every ten documents three are whole, one has text behind its array, two are cut inside their last play, two after
        the last comma, and two are no JSON. Every tenth play is no music. A view has no end reason, a click a null one.
        """
        return self._documents(broken=True)

    @cached_property
    def readable_documents(self) -> DataFrame:
        """The documents without text behind an array and with the last kind whole, so that every one can be read."""
        return self._documents(broken=False)

    def _documents(self, broken: bool) -> DataFrame:
        kind, no = F.col("event_type"), F.col("no")
        reason = (
            F.when(kind == "error", "forward").when(kind == "signup", "back")
            .when(kind == "click", "~null~").when(kind == "purchase", "trackdone")
        )
        uri = F.concat(F.lit(MUSIC_URI), F.get_json_object("props", "$.k"))
        item = F.to_json(F.struct(
            F.date_format("ts", TS_PATTERN).alias("ts"),
            F.floor(F.col("value") * 1000).alias("ms_played"),
            F.concat(F.lit("user "), F.col("user_id").cast("string"))
            .alias("master_metadata_album_artist_name"),
            F.when(F.col("event_id") % 10 != 7, uri).alias("spotify_track_uri"),
            reason.alias("reason_end"),
            kind.isin("error", "signup").alias("skipped"),
            F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("user_id") % 7 + 1).cast("int"))
            .alias("conn_country"),
        ))
        item = F.replace(item, F.lit('"~null~"'), F.lit("null"))
        # A document holds a fixed number of plays, so the groups are bounded.
        gathered = (
            self.raw("events")
            .select((F.col("event_id") / PLAYS_PER_DOCUMENT).cast("bigint").alias("no"), "event_id",
                    item.alias("item"))
            .groupBy("no")
            .agg(F.sort_array(F.collect_list(F.struct("event_id", "item")))["item"].alias("items"))
        )
        whole = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
        fewer = F.slice(F.col("items"), F.lit(1), F.size("items") - 1)
        after_comma = F.concat(F.lit("["), F.array_join(fewer, ","),
                               F.when(F.size("items") > 1, ",").otherwise(""))
        body = (
            F.when(no % 5 == 2, F.left(whole, F.length(whole) - 20))
            .when(no % 5 == 3, after_comma)
            .when((no % 5 == 4) & broken, "invalid json")
            .when((no % 10 == 5) & broken, F.concat(whole, F.lit(" x")))
            .otherwise(whole)
        )
        return gathered.select(no.cast("string").alias("source_file"), body.alias("body"))


_NAMED = """p_name AS track, NULLIF(p_brand, 'Brand#13') AS artist,
    NULLIF(p_type, 'PROMO') AS album, CAST(p_partkey AS VARCHAR) AS track_uri"""

_COUNTRY = "(['" + "', '".join(COUNTRIES) + "'])[CAST(user_id % 7 + 1 AS INTEGER)]"

_EV = f"""SELECT event_id AS id, ts,
    CASE WHEN event_id % 50 = 0 THEN 0 ELSE CAST(FLOOR(value * 1000) AS BIGINT) END AS ms_played,
    CASE event_type WHEN 'error' THEN 'forward' WHEN 'signup' THEN 'back' ELSE 'trackdone' END
      AS reason_end,
    CASE WHEN event_type <> 'view' THEN event_type IN ('error', 'signup') END AS skipped,
    {_COUNTRY} AS country, {_NAMED}
  FROM events JOIN part ON CAST(json_extract(props, '$.k') AS BIGINT) = p_partkey"""

_LI = f"""SELECT l_shipdate AS ts, CAST(FLOOR(l_extendedprice) AS BIGINT) AS ms_played,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS skipped, {_NAMED}
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

_TRACKS = """SELECT CAST(p_partkey AS VARCHAR) AS track_uri, p_name AS track,
    NULLIF(p_brand, 'Brand#13') AS artist, CAST(p_size AS BIGINT) AS track_popularity,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN DATE '1899-06-01'
      ELSE DATE '1950-01-01' + CAST(p_partkey * 37 % 18800 AS INTEGER) END AS album_release_date,
    p_type AS album, CAST(p_size AS BIGINT) * 1000 AS duration_ms, p_partkey % 2 = 0 AS explicit,
    LOWER(p_type) AS album_type, CAST(p_size AS BIGINT) AS total_tracks,
    CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '["' || split_part(p_name, ' ', 1) || '","'
      || split_part(p_name, ' ', 2) || '"]' END AS genres,
    CAST(FLOOR(p_retailprice) AS BIGINT) % 101 AS artist_popularity,
    'artist:' || p_brand AS artist_uri, p_partkey * 10 AS artist_followers FROM part"""

# The SQL side uses the name itself as the genre id.
_TRACK_GENRES = """SELECT DISTINCT track_uri, name FROM (
    SELECT track_uri, UNNEST(CAST(json(genres) AS VARCHAR[])) AS name FROM tracks WHERE genres <> '')"""

# ``whole``: whether documents that cannot be read, or only up to text behind their array, count with all their items.
_ITEMS = f"""SELECT *, CAST(event_id // {PLAYS_PER_DOCUMENT} AS BIGINT) AS no,
    event_id % 10 <> 7 AS music, date_trunc('second', ts) AS at_second,
    CAST(FLOOR(value * 1000) AS BIGINT) AS ms, {_COUNTRY} AS country,
    CASE event_type WHEN 'error' THEN 'forward' WHEN 'signup' THEN 'back'
      WHEN 'purchase' THEN 'trackdone' END AS reason_end FROM events
  QUALIFY CASE WHEN no % 5 = 4 THEN {{whole}} WHEN no % 5 = 1 OR no % 10 = 0 THEN true WHEN no % 10 = 5 AND {{whole}} THEN true
    ELSE ROW_NUMBER() OVER (PARTITION BY no ORDER BY event_id DESC) > 1 END"""


def sql(body: str, plays: str = "ev") -> str:
    """``body`` (a SELECT, or ``name AS (...), ... SELECT``) over the derived tables."""
    tables = {
        "plays": _EV if plays == "ev" else _LI,
        "tracks": _TRACKS,
        "track_genres": _TRACK_GENRES,
        "items": _ITEMS.replace("{whole}", "false"),
        "readable_items": _ITEMS.replace("{whole}", "true"),
    }
    used = {n for n in tables if n in body} | ({"tracks"} if "track_genres" in body else set())
    head = ",\n".join(f"{n} AS (\n  {q})" for n, q in tables.items() if n in used)
    body = body.strip()
    joiner = "\n" if body.startswith("SELECT") else ",\n"
    return f"WITH {head}{joiner}{body}" if head else body


def number(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6)"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, doubles to six decimals, dates as text, so both engines compare."""

    def shown(field):
        column, kind = F.col(field.name), field.dataType.typeName()
        if kind in ("byte", "short", "integer"):
            column = column.cast("bigint")
        elif kind in ("float", "double"):
            column = F.round(column.cast("double"), 6)
        elif kind == "date":
            column = column.cast("string")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])
