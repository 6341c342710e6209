"""Raw time stamps in mixed notations to exact instants.

Every notation is one branch of a single regular expression. One
``regexp_replace`` turns a stamp into its components, calendar ranges are
checked on integers, and the instant is assembled by day arithmetic. The whole
path consists of built-in expressions; no row passes through Python.

Defined results: null, empty, blank or unreadable stamps, impossible dates or
times, unknown zones and local times without a usable zone give null. A local
time that occurs twice gives the earlier instant; one that is skipped moves
forward by the gap. Digits beyond microseconds are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names of the site languages, longest spellings first within a month.
MONTHS = {
    1: "january januar janvier jänner janv jan",
    2: "february februar février fevrier févr feb fév",
    3: "march märz maerz mars mär mar",
    4: "april avril avr apr",
    5: "may mai",
    6: "june juni juin jun",
    7: "july juli juillet juil jul",
    8: "august août aout aug",
    9: "september septembre sept sep",
    10: "october oktober octobre oct okt",
    11: "november novembre nov",
    12: "december dezember décembre decembre dec dez déc",
}
# Day names of the same languages, as stems.
DAYS = "mon tue wed thu fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim mo di mi do fr sa so"
# Minutes east of Greenwich of the abbreviations used in the sites' zones.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "IST": 330, "NPT": 345, "JST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Words that make a stamp vague instead of leading in to it.
VAGUE = "before after until since about around circa approx ca vor nach bis seit um avant après vers env spring summer autumn fall winter early mid late"

PARTS = ("y", "yy", "mo", "name", "d", "doy", "wk", "wd", "a", "b", "h", "mi", "s", "f", "ap", "zone", "epoch")
SEP = "\x1f"
WS = r"[\s\p{Z}\x{200b}\x{feff}]"


def stamp_pattern() -> tuple[str, str]:
    """The alternation over all notations, and the replacement that lists its components in the order of PARTS."""
    names = "|".join(sorted((w for v in MONTHS.values() for w in v.split()), key=len, reverse=True))
    days = "|".join(sorted(set(DAYS.split()), key=len, reverse=True))
    ws = WS
    groups: dict[str, list[str]] = {p: [] for p in PARTS}

    def g(part: str, pattern: str) -> str:
        name = f"{part}x{len(groups[part])}"
        groups[part].append(name)
        return f"(?<{name}>{pattern})"

    dates = [
        g("y", r"\d{4}") + "-" + g("mo", r"\d{1,2}") + "-" + g("d", r"\d{1,2}"),
        g("y", r"\d{4}") + "/" + g("mo", r"\d{1,2}") + "/" + g("d", r"\d{1,2}"),
        g("y", r"\d{4}") + "-?W" + g("wk", r"\d{2}") + "-?" + g("wd", r"\d"),
        g("y", r"\d{4}") + "-" + g("doy", r"\d{3}"),
        g("y", r"\d{4}") + g("mo", r"\d{2}") + g("d", r"\d{2}"),
        g("d", r"\d{1,2}") + r"\." + ws + "?" + g("mo", r"\d{1,2}") + r"\." + ws + "?(?:" + g("y", r"\d{4}") + "|" + g("yy", r"\d{2}") + ")",
        g("a", r"\d{1,2}") + "/" + g("b", r"\d{1,2}") + "/(?:" + g("y", r"\d{4}") + "|" + g("yy", r"\d{2}") + ")",
        g("d", r"\d{1,2}") + rf"(?:st|nd|rd|th|er|\.)?[\s\p{{Z}}-]*(?:of{ws}++)?" + g("name", names) + rf"\.?,?[\s\p{{Z}}-]*" + g("y", r"\d{4}"),
        g("name", names) + rf"\.?{ws}++" + g("d", r"\d{1,2}") + rf"(?:st|nd|rd|th)?,?{ws}++" + g("y", r"\d{4}"),
    ]
    clock = (
        "(?:" + g("h", r"\d{1,2}") + r"(?::|h)" + g("mi", r"\d{2}") + r"(?::" + g("s", r"\d{2}") + r"(?:[.,]" + g("f", r"\d+") + ")?)?"
        + "|" + g("h", r"\d{2}") + g("mi", r"\d{2}") + g("s", r"\d{2}") + r"(?:[.,]" + g("f", r"\d+") + ")?)"
        + rf"(?:{ws}*+" + g("ap", r"[ap]\.?m\.?(?!\p{L})") + rf")?(?:{ws}*+uhr)?"
    )
    zone = rf"(?:{ws}*+\(?" + g("zone", r"[a-z_]+/[a-z_]+(?:/[a-z_]+)?|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|[a-z]{1,5}") + rf"\)?)?(?:{ws}*+\[[^\]]*\])?"
    body = rf"(?:(?:{days})[a-zé]*\.?,?{ws}++)?(?:" + "|".join(dates) + rf")(?:(?:t|,?{ws}++(?:at{ws}++|à{ws}++|um{ws}++)?|,)" + clock + ")?" + zone
    lead = rf"(?:(?!(?:{'|'.join(VAGUE.split())})\b)\p{{L}}+:?{ws}++)?"
    pattern = rf"(?iu)^{ws}*+{lead}(?:" + g("epoch", r"\d{16}|\d{13}|\d{10}") + "|" + body + rf"){ws}*+$"
    return pattern, SEP + SEP.join("".join(f"${{{n}}}" for n in groups[p]) for p in PARTS) + SEP


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, in integers."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    month = m + F.when(m <= 2, 9).otherwise(-3)
    leap = lambda n: F.floor(shifted / n)
    return (shifted * 365 + leap(4) - leap(100) + leap(400) + F.floor((month * 153 + 2) / 5) + d - 719469).cast("long")


def known_zones(spark: SparkSession) -> list[str]:
    return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def normalize_timestamps(df: DataFrame, value: str, zone: str, order: str, out: str) -> DataFrame:
    """``df`` with ``out``, the instant of ``value`` in microseconds since 1970 UTC.

    ``zone`` is the column with the zone of local times, ``order`` the one with
    ``dmy`` or ``mdy`` for days and months between slashes (null: ``dmy``).
    A stamp may be of any length; white space around it costs no backtracking.
    """
    spark = df.sparkSession
    pattern, replacement = stamp_pattern()
    held = f"__{out}_parts"
    stamp = F.when(~F.contains(F.col(value), F.lit(SEP)), F.col(value))  # the separator stands in no stamp
    df = df.withColumn(held, F.split(F.regexp_replace(stamp, pattern, replacement.replace("\\", "\\\\")), SEP))
    text = lambda p: F.get(F.col(held), F.lit(PARTS.index(p) + 1))
    num = lambda p: F.when(text(p) != "", text(p)).try_cast("long")
    p = lambda k: F.col(f"{held}_{k}")
    # Each step is columns of its own: a later step uses them often, so the optimizer keeps them apart.
    step = lambda frame, **columns: frame.withColumns({f"{held}_{k}": c for k, c in columns.items()})
    name = F.lower(text("name"))
    month_of = F.create_map(*[x for m, ws in MONTHS.items() for w in ws.split() for x in (F.lit(w), F.lit(m))])
    first, second = num("a"), num("b")
    mdy = F.coalesce(F.lower(F.col(order)), F.lit("dmy")) == "mdy"
    df = step(
        df,
        y=F.coalesce(num("y"), num("yy") + 2000),
        m=F.coalesce(num("mo"), F.when(name != "", F.try_element_at(month_of, name)), F.when(mdy, first).otherwise(second)),
        d=F.coalesce(num("d"), F.when(mdy, second).otherwise(first)),
        doy=num("doy"), wk=num("wk"), wd=num("wd"),
        h=F.coalesce(num("h"), F.lit(0)), mi=F.coalesce(num("mi"), F.lit(0)), s=F.coalesce(num("s"), F.lit(0)),
        us=F.coalesce(F.substring(F.rpad(text("f"), 6, "0"), 1, 6).try_cast("long"), F.lit(0)),
        ap=F.lower(F.substring(text("ap"), 1, 1)), z=text("zone"), epoch=num("epoch"), digits=F.length(text("epoch")),
    )
    leap = ((p("y") % 4 == 0) & (p("y") % 100 != 0)) | (p("y") % 400 == 0)
    last = F.when(p("m") == 2, F.when(leap, 29).otherwise(28)).when(p("m").isin(4, 6, 9, 11), 30).otherwise(31)
    valid = (
        F.when(p("doy").isNotNull(), p("doy").between(1, F.when(leap, 366).otherwise(365)))
        .when(p("wk").isNotNull(), (p("wk") >= 1) & p("wd").between(1, 7))
        .otherwise((p("y") >= 1) & p("m").between(1, 12) & p("d").between(1, last))
    )
    # a day of the year counts from 1 January, a week from 4 January, which is always in the first
    month = F.when(p("doy").isNotNull() | p("wk").isNotNull(), 1).otherwise(p("m"))
    day = F.when(p("doy").isNotNull(), p("doy")).when(p("wk").isNotNull(), 4).otherwise(p("d"))
    df = step(df, ok=valid, m=month, d=day)
    df = step(df, base=F.when(p("ok"), civil_days(p("y"), p("m"), p("d"))))
    monday = p("base") - F.pmod(p("base") + 3, F.lit(7)) + (p("wk") - 1) * 7
    df = step(df, day=F.when(p("wk").isNotNull(), monday + p("wd") - 1).otherwise(p("base")), monday=monday)
    # the Thursday of a week lies in the year that the week belongs to
    own_year = p("wk").isNull() | (p("wk") <= 52) | (p("monday") + 3 <= civil_days(p("y"), F.lit(12), F.lit(31)))
    hour = F.when(p("ap") == "", F.when(p("h") <= 23, p("h"))).otherwise(F.when(p("h").between(1, 12), p("h") % 12 + F.when(p("ap") == "p", 12).otherwise(0)))
    sound = own_year & (p("mi") <= 59) & (p("s") <= 59)
    df = step(df, local=F.when(sound, ((p("day") * 24 + hour) * 60 + p("mi")) * 60_000_000 + p("s") * 1_000_000 + p("us")))
    abbreviation = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    sign = F.regexp_extract(p("z"), r"([+-])\d", 1)
    oh, om = (F.regexp_extract(p("z"), r"[+-](\d{2}):?(\d{2})?", k).try_cast("long") for k in (1, 2))
    df = step(df, named=p("z").contains("/"), sign=sign, oh=oh, om=F.coalesce(om, F.lit(0)))
    numeric = F.when((p("oh") <= 18) & (p("om") <= 59), F.when(p("sign") == "-", -1).otherwise(1) * (p("oh") * 60 + p("om")))
    offset = F.when(p("sign") != "", numeric).otherwise(F.try_element_at(abbreviation, F.upper(p("z"))))
    canonical = F.when(p("named"), p("z")).when(p("z") == "", F.col(zone))
    df = step(df, offset=offset, zone=F.when(canonical.isin(known_zones(spark)), canonical))
    at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(p("local")), p("zone")))
    whole = F.when(p("digits") == 10, 1_000_000).when(p("digits") == 13, 1_000).otherwise(1)
    instant = F.when(p("epoch").isNotNull(), p("epoch") * whole).when((p("z") != "") & ~p("named"), p("local") - p("offset").cast("long") * 60_000_000).otherwise(at)
    return df.withColumn(out, F.when(F.size(held) == len(PARTS) + 2, instant).cast("long")).drop(held, *[c for c in df.columns if c.startswith(f"{held}_")])


def published_instants(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, published_us), one row for each distinct page_id whose ``published`` names an instant.

    Copies and re-crawls of a page fall together; should they differ, the
    earliest instant stands. Rows without page_id are left out. Pages of an
    unknown source still count if their stamp carries its own zone.
    """
    zones = sites.groupBy("source").agg(F.min(F.struct("tz", "date_order")).alias("__site")).select("source", "__site.tz", "__site.date_order")
    stamps = pages.where("page_id IS NOT NULL AND published IS NOT NULL").select("page_id", "source", "published")
    read = normalize_timestamps(stamps.join(zones, "source", "left"), "published", "tz", "date_order", "published_us")
    # the filter stands behind the aggregate: before it, it would be pushed down and repeat the whole reading
    return read.groupBy("page_id").agg(F.min("published_us").alias("published_us")).where("published_us IS NOT NULL")
