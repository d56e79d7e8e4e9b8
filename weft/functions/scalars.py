"""Column functions: text, numbers, dates and URLs. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

#: Fixed value: words that convert to false; any other text is true.
FALSE_WORDS = ("", "0", "false", "no", "n", "f", "off", "none", "null", "nan", "假", "否", "不")
#: Fixed value: query parameters that identify a click, not a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "share_source", "fbclid", "gclid")
_SPACE = r"[\s\p{Z}]+"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def number(c: Column) -> Column:
    """The cell as a double; null where it is no number (NaN included)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def folded(c: Column) -> Column:
    """Runs of white space of any script as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def counted(c: Column) -> Column:
    """A count as pages show it: separators, and 万, 千, 亿, K, M or B as multipliers; null without a digit."""
    plain = F.regexp_replace(c.cast("string"), "[,，\\s]", "")
    digits, unit = F.regexp_extract(plain, r"(\d+(?:\.\d+)?)\s*(万|千|亿|[wWkKmMbB])?", 1), F.upper(F.regexp_extract(plain, r"(\d+(?:\.\d+)?)\s*(万|千|亿|[wWkKmMbB])?", 2))
    factor = F.when(unit.isin("万", "W"), 1e4).when(unit.isin("千", "K"), 1e3).when(unit == "亿", 1e8).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.round(digits.try_cast("double") * factor).cast("long")


def leading_number(c: Column) -> Column:
    """The first number of a decorated cell such as ``1,234 times``."""
    return F.regexp_extract(F.regexp_replace(c.cast("string"), "[,，]", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def year_of(c: Column) -> Column:
    """The first year from 1800 to 2099 anywhere in a cell."""
    return F.regexp_extract(c.cast("string"), r"(1[89]\d{2}|20\d{2})", 1).try_cast("int")


def truth(c: Column) -> Column:
    """False for null and the ``FALSE_WORDS``, else true."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin(*FALSE_WORDS), F.lit(False))


def moment(c: Column, kind) -> Column:
    """A timestamp from a timestamp, a date or a text in one of the usual spellings; null where unreadable."""
    if isinstance(kind, TimestampNTZType):
        return c
    if isinstance(kind, (TimestampType, DateType)):
        return c.cast("timestamp_ntz")
    if not isinstance(kind, StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"(\d{4})\s*[年/.]\s*(\d{1,2})\s*[月/.]\s*(\d{1,2})\s*日?", "$1-$2-$3 "), "(时|点)|分(?=\\d)", ":"))
    parts = [F.regexp_extract(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?.*)?\s*$", i) for i in range(1, 7)]
    number_of = lambda i: F.coalesce(F.nullif(parts[i], F.lit("")), F.lit("0"))
    built = F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0"), F.lit(" "), *[x for i in (3, 4, 5) for x in (F.lpad(number_of(i), 2, "0"), F.lit(":"))])
    return F.when(parts[0] != "", F.substr(built, F.lit(1), F.lit(19)).try_cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))


#: Hours that the names of time zones in message dates stand for.
_ZONES = {"GMT": 0, "UT": 0, "UTC": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def message_date(c: Column) -> Column:
    """A timestamp from a date as in messages and feeds (``Thu, 1 May 2025 10:20:30 +0800``); the weekday and the seconds may be left out.

    Years of two digits are from 1950 to 2049, a missing or unknown zone counts as GMT. Null where unreadable, and for days that there are not.
    """
    pattern = r"(?i)^\s*(?:[a-z]{3},?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[a-z]{1,4})\b)?"
    part = [F.regexp_extract(c, pattern, i) for i in range(1, 8)]
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    month = F.array_position(months, F.lower(part[1]))
    year = part[2].try_cast("int")
    year = F.when(F.length(part[2]) == 2, year + F.when(year < 50, 2000).otherwise(1900)).otherwise(year)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, part[0].try_cast("int"), part[3].try_cast("int"), part[4].try_cast("int"), F.coalesce(part[5].try_cast("int"), F.lit(0)))
    zone = F.upper(part[6])
    named = F.coalesce(*[F.when(zone == name, hours * 60) for name, hours in _ZONES.items()], F.lit(0))
    minutes = F.when(zone.rlike(r"^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(zone, F.lit(4), F.lit(2)).try_cast("int"))).otherwise(named)
    return F.when((part[0] != "") & (month > 0), text.try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes))


def ago(label: Column, now: Column) -> Column:
    """A moment from a relative label (``3 hours ago``, ``3小时前``, ``yesterday``, ``昨天``), counted back from ``now``."""
    n = F.regexp_extract(label, r"(\d+)", 1).try_cast("int")
    step = lambda *words: F.lower(label).rlike("|".join(words))
    back = (
        F.when(step("秒", "second"), F.make_dt_interval(secs=n.cast("decimal(18,6)")))
        .when(step("分", "minute"), F.make_dt_interval(mins=n))
        .when(step("小时", "hour"), F.make_dt_interval(hours=n))
        .when(step("天前", "day"), F.make_dt_interval(days=F.when(step("yesterday"), 1).otherwise(n)))
        .when(step("昨"), F.make_dt_interval(days=F.lit(1)))
        .when(step("周", "week"), F.make_dt_interval(days=n * 7))
        .when(step("刚", "just now"), F.make_dt_interval(days=F.lit(0)))
    )
    return now - back


def url_key(c: Column) -> Column:
    """One spelling of a URL: lower-case host without ``www.``, no default port, fragment, tracking
    parameters or closing slash, other parameters sorted; null where there is no host."""
    u = F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.trim(c)).otherwise(F.concat(F.lit("http://"), F.trim(c)))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(host.contains("."), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def finite(c: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def parts_of(c: Column) -> Column:
    """The items of a delimited cell (``;``, ``；``, ``,``, ``，`` or ``、``), trimmed, none of them blank."""
    return F.filter(F.transform(F.split(c, "[;；,，、]+"), lambda x: strip(x)), lambda x: x != "")


def word_weights(c: Column) -> Column:
    """A map from the text ``word:weight word:weight``; a word without a weight counts 1."""
    pairs = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1), F.coalesce(F.regexp_extract(x, r":([-+0-9.eE]+)$", 1).try_cast("double"), F.lit(1.0))))
    return F.map_from_entries(F.array_distinct(entries))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, in bits, of two maps of weights from text, each scaled to 1."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
    share = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)) / total(m)
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    one = lambda k: (term(share(p, k), (share(p, k) + share(q, k)) / 2) + term(share(q, k), (share(p, k) + share(q, k)) / 2)) / 2
    return F.aggregate(F.transform(keys, one), F.lit(0.0), lambda a, x: a + x)


def value_at(c: Column, path: str) -> Column:
    """The value at a dotted path (``a.b.1.c``, numbers count list items from 0) of a JSON text; null if any step misses."""
    steps = [s for s in path.split(".") if s]
    if not steps:
        return F.lit(None).cast("string")
    found = []
    for shape in range(1 << sum(s.isdigit() for s in steps)):  # a number names a list item, or a key
        out = "$"
        for s in steps:
            if s.isdigit():
                out, shape = out + (f"['{s}']" if shape & 1 else f"[{s}]"), shape >> 1
            else:
                out += f"['{s}']"
        found.append(F.get_json_object(c, out))
    return F.coalesce(*found)


def names_of(value) -> list[str]:
    """Column names from a list or from a comma-separated text; blank ones go, nothing gives none."""
    parts = value if isinstance(value, (list, tuple, set)) else str(value or "").split(",")
    return [str(x).strip() for x in parts if str(x).strip()]
