"""Text, date and scoring functions as Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from ipaddress import ip_network

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[\\p{L}\\p{N}_]+"
MAX_TERM = 64
#: Months as they are written in texts (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SIGMA_DAYS = 15.0
#: What a query may put before the things it doesn't want (fixed values): phrases, and verbs with the relations that may
#: follow them. "not" alone counts only before two spaces.
CUES = ("beside", "besides", "but not", "except", "except for", "excluding", "other than", "without")
NOT_RELATIONS = ("about", "including", "related to", "using")
DENIED, DENIED_RELATIONS = ("isn't", "aren't", "wasn't", "weren't"), ("about", "related to", "using")


def _cue_pattern() -> str:
    phrases = [*CUES, "not ", *[f"not {r}" for r in NOT_RELATIONS], *DENIED, *[f"{d} {r}" for d in DENIED for r in DENIED_RELATIONS]]
    spelled = [p.replace("'", "['’]").replace(" ", "\\s+") for p in sorted(phrases, key=len, reverse=True)]
    return f"(?i)(?<![\\p{{L}}\\p{{N}}_])(?:{'|'.join(spelled)})\\s+(.+)"


EXCLUSION = _cue_pattern()
#: Capitalised terms, with whole parts after hyphens. What gives nothing back needs no stack on long terms; each part is
#: held against the border by itself, so the same terms are found as by backtracking.
SPECIFIC = "(?<![\\p{L}\\p{N}_])[A-Z][A-Za-z0-9]{2,}+(?![\\p{L}\\p{N}_])(?:-[A-Za-z0-9]++(?![\\p{L}\\p{N}_]))*+"
#: File extensions and their languages (fixed values).
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby"}
#: English function words that feedback terms leave out.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their "
    "them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


def terms(text: str | Column) -> Column:
    """Lower-cased runs of word characters of at most 64 characters."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: F.length(t) <= MAX_TERM)


def doc_id(text: str | Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16))


def _fnv1a(text: str) -> str:
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return str(h)


def fnv1a(text: str | Column) -> Column:
    """FNV-1a of the UTF-8 bytes as an unsigned 64-bit number in decimal digits; xxhash64 is faster where parity is not
    asked for."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield series.map(_fnv1a, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def lead(text: str | Column, most: int = 200) -> Column:
    """First sentence if it is short enough, else the whole if that is, else a cut at the last space before `most`."""
    whole = F.regexp_replace(text, "^\\s+|\\s+$", "")
    first = F.regexp_extract(whole, "^[^.!?]*[.!?]", 0)
    cut = F.regexp_replace(F.substring(whole, 1, most), "\\s+\\S*$", "")
    return F.when((F.length(first) > 0) & (F.length(first) <= most), first).when(F.length(whole) <= most, whole).otherwise(F.concat(cut, F.lit("…")))


def first_line(text: str | Column, most: int = 120) -> Column:
    line = F.substring_index(F.trim(text), "\n", 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def dates(text: str | Column) -> Column:
    """Sorted distinct dates: valid ISO days, and the 15th of every `Month YYYY`."""
    iso = F.transform(F.regexp_extract_all(text, F.lit("\\b\\d{4}-\\d{2}-\\d{2}\\b"), F.lit(0)), lambda d: d.try_cast("date"))
    month = F.regexp_extract_all(text, F.lit(f"(?i)\\b({'|'.join(MONTHS)})\\s+\\d{{4}}\\b"), F.lit(0))
    number = lambda m: F.array_position(F.array(*[F.lit(x.lower()) for x in MONTHS]), F.lower(F.regexp_extract(m, "^\\p{L}+", 0)))
    named = F.transform(month, lambda m: F.make_date(F.regexp_extract(m, "\\d{4}$", 0).cast("int"), number(m).cast("int"), F.lit(15)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(iso, named), lambda d: d.isNotNull())))


def periods(days: str | Column) -> Column:
    """Sorted distinct month, quarter and year ids of an array of dates."""
    of = lambda d: F.array(F.concat(F.lit("month:"), F.date_format(d, "yyyy-MM")), F.concat(F.lit("quarter:"), F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string")), F.concat(F.lit("year:"), F.date_format(d, "yyyy")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(days, of))))


def day_periods(day: str | Column) -> Column:
    """periods() of a single date, with years formatted as numbers where both are alike."""
    d = F.col(day) if isinstance(day, str) else day
    year = F.when(F.year(d).between(1000, 9999), F.year(d).cast("string")).otherwise(F.date_format(d, "yyyy"))
    month = F.concat(F.lit("month:"), year, F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))
    quarter = F.concat(F.lit("quarter:"), year, F.lit("-Q"), F.quarter(d).cast("string"))
    return F.when(d.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(month, quarter, F.concat(F.lit("year:"), year)))


def query_ranges(text: str | Column) -> Column:
    """Arrays of struct(start, end) that a query names: days, months (`May 2026`) and quarters (`Q2 2026`)."""
    iso = F.filter(F.transform(F.regexp_extract_all(text, F.lit("\\b\\d{4}-\\d{2}-\\d{2}\\b"), F.lit(0)), lambda d: d.try_cast("date")), lambda d: d.isNotNull())
    days = F.transform(iso, lambda d: F.struct(d.alias("start"), d.alias("end")))
    middle = dates(F.regexp_replace(text, "\\b\\d{4}-\\d{2}-\\d{2}\\b", " "))
    months = F.transform(middle, lambda d: F.struct(F.trunc(d, "MM").alias("start"), F.last_day(d).alias("end")))
    quarter = F.regexp_extract_all(text, F.lit("(?i)\\bQ[1-4]\\s+\\d{4}\\b"), F.lit(0))
    first = lambda q: F.make_date(F.regexp_extract(q, "\\d{4}$", 0).cast("int"), F.substring(q, 2, 1).cast("int") * 3 - 2, F.lit(1))
    quarters = F.transform(quarter, lambda q: F.struct(first(q).alias("start"), F.last_day(F.add_months(first(q), 2)).alias("end")))
    return F.concat(days, months, quarters)


def range_periods(ranges: str | Column) -> Column:
    """Month and quarter ids that ranges overlap; no years."""
    months = F.flatten(F.transform(ranges, lambda r: F.sequence(F.to_date(F.trunc(r["start"], "MM")), r["end"], F.expr("interval 1 month"))))
    return F.filter(periods(months), lambda p: ~p.startswith("year:"))


def proximity(days: str | Column, ranges: str | Column, sigma: float = SIGMA_DAYS) -> Column:
    """Largest exp(-d^2 / (2 sigma^2)) over dates and ranges, d the days outside the range; 0 without either."""
    off = lambda d, r: F.greatest(F.lit(0), F.datediff(r["start"], d), F.datediff(d, r["end"]))
    scores = F.flatten(F.transform(days, lambda d: F.transform(ranges, lambda r: F.exp(-F.pow(off(d, r), F.lit(2)) / (2 * sigma * sigma)))))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def negation(text: str | Column) -> Column:
    """struct(clean, excluded): the query before its exclusion and the excluded terms, lower-cased."""
    hit = F.regexp_extract(text, EXCLUSION, 0)
    whole = text if isinstance(text, Column) else F.col(text)
    before = F.trim(F.when(hit != "", F.substr(whole, F.lit(1), F.position(hit, whole) - 1)).otherwise(F.lit("")))
    listed = F.split(F.trim(F.regexp_extract(text, EXCLUSION, 1)), "(?i)\\s+(?:and|or)\\s+|,\\s*")
    listed = F.filter(F.transform(listed, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    clean = F.when((hit != "") & (before != ""), before).otherwise(whole)
    return F.struct(clean.alias("clean"), F.when(hit != "", listed).otherwise(F.array().cast("array<string>")).alias("excluded"))


def negation_penalty(body: str | Column, excluded: str | Column) -> Column:
    """0.1 to the power of how many excluded terms the body contains."""
    lowered = F.lower(body)
    return F.pow(F.lit(0.1), F.size(F.filter(excluded, lambda t: F.contains(lowered, t))).cast("double"))


def should_expand(text: str | Column) -> Column:
    """Two words or fewer: yes; two specific capitalised terms or more: no; else yes."""
    words = F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))
    return (words <= 2) | (F.regexp_count(text, F.lit(SPECIFIC)) < 2)


def usage_decay(count: Column, last: Column, as_of: Column) -> Column:
    """Linear decay with days since the last access (365 if none), and a small gain with accesses."""
    age = F.coalesce((F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(86400e6), F.lit(365.0))
    return F.greatest(F.lit(0.3), 1 - 0.5 * age / 365) * F.least(F.lit(1.3), 1 + 0.02 * F.coalesce(count, F.lit(0)))


def without_images(text: str | Column) -> Column:
    """Inline data-URI images as [IMG], parenthesised ones first."""
    data = "data:image/[^;]+;base64,[A-Za-z0-9+/=]+"
    return F.regexp_replace(F.regexp_replace(text, f"\\({data}\\)", "[IMG]"), data, "[IMG]")


#: Hosts that must not be fetched: names, and the networks that are private, of this host or link-local (fixed values),
#: with the parts of them that are public after all.
LOCAL_NAMES = ("localhost", "metadata.google.internal")
LOCAL_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
LOCAL_V6 = ("::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MAPPED = "::ffff:0:0/96"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(address: Column) -> Column:
    """The eight 16-bit words of an IPv6 address, null if it is none; a dotted end counts as two words."""
    tail = F.regexp_extract(address, ":([0-9]{1,3}(?:[.][0-9]{1,3}){3})$", 1)
    octets = let(tail, lambda t: F.when(t != "", F.transform(F.split(t, "[.]"), lambda o: o.cast("int"))))
    pair = lambda o, i: F.lower(F.hex(F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))))
    dotted = lambda o: F.concat(F.regexp_extract(address, "^(.*:)[^:]*$", 1), pair(o, 0), F.lit(":"), pair(o, 2))
    plain = let(octets, lambda o: F.when(F.array_max(o) <= 255, dotted(o)).otherwise(address))
    of = lambda side: let(side, lambda s: F.filter(F.split(s, ":", -1), lambda w: (s != "") | (w != "")))

    def filled(p: Column) -> Column:
        gap = 8 - F.size(p["left"]) - F.size(p["right"])
        whole = F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), p["right"])
        return F.when((p["n"] == 2) & (gap > 0), whole).when((p["n"] == 1) & (F.size(p["left"]) == 8), p["left"])

    parts = let(F.split(plain, "::", -1), lambda s: F.struct(F.size(s).alias("n"), of(F.get(s, F.lit(0))).alias("left"), of(F.element_at(s, -1)).alias("right")))
    return let(let(parts, filled), lambda ws: F.when(F.forall(ws, lambda w: w.rlike("^[0-9a-f]{1,4}$")), F.transform(ws, lambda w: F.conv(w, 16, 10).cast("int"))))


def _inside(words: Column, networks: tuple[str, ...], width: int) -> Column:
    """Whether an address, as numbers of `width` bits each, lies in one of the networks."""
    found = F.lit(False)
    for network in map(ip_network, networks):
        start, hit = int(network.network_address), F.lit(True)
        for i in range(-(-network.prefixlen // width)):
            kept = min(width, network.prefixlen - i * width)
            word = start >> (network.max_prefixlen - (i + 1) * width) & (1 << width) - 1
            hit = hit & (F.shiftright(F.get(words, F.lit(i)), width - kept) == word >> (width - kept))
        found = found | hit
    return found


def blocked_url(url: str | Column) -> Column:
    """Hosts that must not be fetched, by name or as an IPv4, IPv6 or IPv4-mapped address. A dot at a name's end is left
    out, as resolvers do."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]]*\\]|[^/:?#]+)", 1))
    name = lambda h: F.regexp_replace(F.regexp_replace(h, "^\\[|\\]$|%[^\\]]*", ""), "[.]$", "")
    dotted = "^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[.](?!$)|$)){4}$"

    def judged(a: Column) -> Column:
        """a: host, bare (its name), v4 and v6 (the numbers of its address)."""
        last = lambda i: F.get(a["v6"], F.lit(i))
        low = F.when(_inside(a["v6"], (MAPPED,), 16), F.array(F.shiftright(last(6), 8), last(6) % 256, F.shiftright(last(7), 8), last(7) % 256))
        by_v4 = let(F.coalesce(a["v4"], low), lambda v4: _inside(v4, LOCAL_V4, 8) & ~_inside(v4, PUBLIC_V4, 8))
        by_v6 = _inside(a["v6"], LOCAL_V6, 16) & ~_inside(a["v6"], PUBLIC_V6, 16)
        # Brackets around what is no address are blocked.
        return a["bare"].isin(*LOCAL_NAMES) | F.coalesce(by_v4, by_v6, a["host"].startswith("["))

    def parsed(h: Column, bare: Column) -> Column:
        v4 = F.when(bare.rlike(dotted), F.transform(F.split(bare, "[.]"), lambda o: o.cast("int")))
        return F.struct(h.alias("host"), bare.alias("bare"), v4.alias("v4"), F.when(h.startswith("["), _words(bare)).alias("v6"))

    return let(let(host, lambda h: let(name(h), lambda bare: parsed(h, bare))), judged)


def sign_tokens(vec: str | Column) -> Column:
    """A token per dimension that says whether the component is positive."""
    return F.transform(vec, lambda v, i: F.concat(F.when(v > 0, F.lit("embedding_one_")).otherwise(F.lit("embedding_zero_")), i.cast("string")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays in double precision; zero vectors give 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-12, dot(a, b) / norm).otherwise(0.0)


def language_of(path: str | Column) -> Column:
    """Programming language by file extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1)))
