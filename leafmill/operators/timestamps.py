"""Written dates of every origin to one instant in UTC, through a dictionary.

Distinct (source, zone, written date) triples are parsed once by built-in
expressions, kept as a table that grows with later runs, and joined back to the
rows.  Written dates that make up a large share of all rows are few by
definition, so their part of the dictionary is broadcast; the rest is joined by
key without a hot partition.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import exists, fresh_path

DEFAULT_ZONE = "Europe/Zurich"
#: A written date is hot from 1/HOT_PARTS of all rows on, so at most HOT_PARTS are broadcast.
HOT_PARTS = 64

# Offsets of the usual zone abbreviations.
ABBREVIATIONS = {
    "Z": "+00:00", "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00",
    "WEST": "+01:00", "BST": "+01:00", "IST": "+01:00", "CET": "+01:00", "MEZ": "+01:00",
    "CEST": "+02:00", "MESZ": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "TRT": "+03:00",
    "NST": "-03:30", "NDT": "-02:30", "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00",
    "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "HDT": "-09:00",
    "JST": "+09:00", "AWST": "+08:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00",
}
# First three letters of month names, English and German, umlauts without dots.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mrz": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}

_WEEKDAY = r"(?:(?:mo|tu|we|th|fr|sa|su|di|mi|do|so)[a-z]{0,8}\.?,? )?"
_MONTH = r"((?:jan|feb|m[aä]r|mrz|maer|apr|ma[yi]|jun|jul|aug|sep|o[ck]t|nov|de[cz])[a-z]*)\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?: ?((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}|[a-z_]+(?:/[a-z0-9_+-]+)+))?(?: ?[\[(]([^\])]*)[\])])?"
_REST = rf"(?:(?:T|,? (?:at |um )?){_CLOCK}(?: ?([ap])\.?m\b\.?)?(?: ?uhr)?{_ZONE})?$"
#: (pattern, places of year, month, day, hour, minute, second, fraction, a or p, zone, bracket in it; 0: none)
_SHAPES = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_REST}", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_REST}", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_REST}", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^{_WEEKDAY}(\d{{1,2}})\. ?(\d{{1,2}})\. ?(\d{{4}}|\d{{2}}){_REST}", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^{_WEEKDAY}(\d{{1,2}})\.?[ -]{_MONTH}[ -](\d{{4}}|\d{{2}}){_REST}", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_REST}", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}) {_CLOCK}{_ZONE} (\d{{4}})$", (9, 1, 2, 3, 4, 5, 6, 0, 7, 8)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
]


def _zone_names() -> list[str]:
    return sorted(zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"})


def zone_id(written: Column) -> Column:
    """A zone id for a written offset, abbreviation or region; null where it is none."""
    clean = F.upper(F.trim(written))
    offset = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    digits = F.regexp_replace(clean, offset, "$2:$3")
    hours, minutes = F.lpad(F.split_part(digits, F.lit(":"), F.lit(1)), 2, "0"), F.rpad(F.split_part(digits, F.lit(":"), F.lit(2)), 2, "0")
    sign = F.when(clean.contains("-"), "-").otherwise("+")
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    names = F.create_map(*[F.lit(x) for name in _zone_names() for x in (name.upper(), name)])
    fixed = F.when((hours <= "14") & (minutes < "60"), F.concat(sign, hours, F.lit(":"), minutes))
    return F.when(clean.rlike(offset), fixed).otherwise(F.coalesce(table[clean], names[clean]))


def with_utc(df: DataFrame, written: str = "raw", zone: str = "zone", out: str = "utc") -> DataFrame:
    """``df`` with the written date as ``2024-05-06T07:08:09.000000Z`` in ``out``.

    Null where it denotes no instant.  ``zone`` holds where the text has no zone
    of its own; an unknown one counts as the default zone.  Null, empty and
    blank texts, words and impossible dates give null.  A local time that occurs
    twice means the first, a skipped one is read with the offset before the
    change.  Works in stages, each a projection that uses the one before, so
    that no pattern is matched twice for a row.
    """
    names = df.columns
    text = F.trim(F.regexp_replace(F.col(written), r"[\s  ]+", " "))
    parts = F.lit(None).cast("string")
    for pattern, places in reversed(_SHAPES):
        pattern = "(?iu)" + pattern
        order = "|".join(f"${p}" if p else "" for p in places)
        parts = F.when(F.col("__text").rlike(pattern), F.regexp_replace("__text", pattern, order)).otherwise(parts)
    df = df.withColumn("__text", text).withColumn("__part", F.split(parts, r"\|"))
    df = df.select(
        *names,
        "__text",
        *[F.col("__part")[at].try_cast("int").alias(f"__{name}") for at, name in ((0, "y"), (1, "mo"), (2, "d"), (3, "h"), (4, "mi"))],
        F.length(F.col("__part")[0]).alias("__digits"),
        F.substring(F.translate(F.lower(F.col("__part")[1]), "ä", "a"), 1, 3).alias("__name"),
        F.concat(F.when(F.col("__part")[5] == "", "0").otherwise(F.col("__part")[5]), F.lit("."), F.rpad(F.substring(F.col("__part")[6], 1, 6), 6, "0")).try_cast("decimal(8,6)").alias("__s"),
        F.lower(F.col("__part")[7]).alias("__half"),
        F.when(F.col("__part")[8] != "", F.col("__part")[8]).when(F.col("__part")[9] != "", F.col("__part")[9]).alias("__own"),
    )
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    h, half = F.col("__h"), F.col("__half")
    hour = F.when(half == "", F.coalesce(h, F.lit(0))).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    local = F.try_make_timestamp_ntz(F.col("__year"), F.col("__month"), F.col("__d"), F.col("__hour"), F.coalesce("__mi", F.lit(0)), F.col("__s"))
    digits = F.regexp_extract("__text", r"^-?(\d{1,17})$", 1)
    unit = F.when(F.length(digits) <= 11, 1_000_000).when(F.length(digits) <= 14, 1_000).otherwise(1)
    df = (
        df.withColumn("__year", F.when(F.col("__digits") == 2, F.col("__y") + 2000).otherwise(F.col("__y")))
        .withColumn("__month", F.coalesce("__mo", months[F.col("__name")]))
        .withColumn("__hour", hour)
        .withColumn("__from", F.when(F.col("__own").isNotNull(), zone_id(F.col("__own"))).otherwise(F.coalesce(zone_id(F.col(zone)), F.lit(DEFAULT_ZONE))))
        .withColumn("__local", F.when((F.col("__year") >= 1) & (F.col("__s") < 60), local))
        .withColumn("__micros", F.when(digits != "", F.col("__text").try_cast("bigint") * unit))
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    counted = epoch + F.make_dt_interval(secs=(F.col("__micros").cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    moved = F.when(F.col("__from").isNotNull() & F.col("__local").isNotNull(), F.convert_timezone(F.col("__from"), F.lit("UTC"), F.col("__local")))
    df = df.withColumn("__plain", F.when(F.col("__micros").isNotNull(), counted).otherwise(moved).cast("string"))
    plain = F.col("__plain")
    full = F.concat(F.substring(plain, 1, 10), F.lit("T"), F.substring(plain, 12, 8), F.lit("."), F.rpad(F.substring(plain, 21, 6), 6, "0"), F.lit("Z"))
    return df.select(*names, F.when(plain.rlike(r"^\d{4}-"), full).alias(out))


class TimestampDictionary:
    """Distinct written dates with their instants, kept as a growing Parquet table.

    ``path`` None makes a dictionary of one run in the session's shared folder.
    """

    KEYS = ("src", "zone", "raw")

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or fresh_path(spark, "timestamp-dictionary")
        self.fresh = path is None

    def read(self) -> DataFrame:
        """``src, zone, raw, utc`` of all earlier runs; empty before the first."""
        schema = "src string, zone string, raw string, utc string, n bigint"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def refresh(self, rows: DataFrame) -> DataFrame:
        """Parse and append what is new in ``rows`` (``src, zone, raw``); returns ``KEYS, utc, n``.

        ``n`` is the number of rows of this run with the triple, known or new.
        """
        keys = list(self.KEYS)
        counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        new = counted if self.fresh else counted.join(self.read(), keys, "left_anti")
        with_utc(new).select(*keys, "utc", "n").write.mode("append").parquet(self.path)
        if self.fresh:
            return self.read()
        return self.read().drop("n").dropDuplicates(keys).join(counted, keys)


def normalise(rows: DataFrame, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """Rows (``src STRING, zone STRING, raw STRING`` and more) with ``utc`` added.

    Rows whose ``raw`` is null or denotes no instant are left out; repeated rows
    stay.  A null zone means the default zone.  An empty table gives an empty
    result.
    """
    rows = rows.where(F.col("raw").isNotNull()).withColumn("zone", F.coalesce("zone", F.lit(DEFAULT_ZONE)))
    dictionary = dictionary or TimestampDictionary(rows.sparkSession)
    known = dictionary.refresh(rows.select("src", "zone", "raw"))
    total = known.agg(F.sum("n")).first()[0] or 0
    keys = list(TimestampDictionary.KEYS)
    is_hot = F.col("n") * HOT_PARTS >= total
    hot = known.where(is_hot).select(*keys, F.coalesce("utc", F.lit("")).alias("__hot"))
    cold = known.where(~is_hot & F.col("utc").isNotNull()).select(*keys, "utc")
    marked = rows.join(F.broadcast(hot), keys, "left")
    first = marked.where(F.col("__hot") != "").withColumnRenamed("__hot", "utc")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, keys)
    return first.select(*rows.columns, "utc").unionByName(rest.select(*rows.columns, "utc"))


def dated_rows(tables: dict[str, tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """``src, row_key, zone, raw`` of tables given as name: (table, key, date, zone column)."""
    parts = [
        df.select(F.lit(name).alias("src"), F.col(key).alias("row_key"), (F.col(zone) if zone else F.lit(None)).cast("string").alias("zone"), F.col(date).cast("string").alias("raw"))
        for name, (df, key, date, zone) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
