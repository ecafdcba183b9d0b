"""Personal data found with Spark expressions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs, number ranges for
addresses), and words nearby adjust a score. Spans of the four plain kinds stay whenever they are valid; the other
kinds stay if their score reaches the threshold. Patterns are possessive and anchored at the start of a run, so
that long runs of digits or letters are passed once; they match what the plain forms beside them match. An IBAN is
tried at every possible start, whatever was tried before it.

Positions come from splitting the text at the matches and summing lengths, in code points, end exclusive.

Defined results: a null text is an empty text without spans; spans of one kind never overlap, spans of different
kinds may; masking merges overlapping spans into one, named after the first; equal rows get equal results; an empty
table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

#: kind: (pattern, cheap test that a text without a match fails). Plain forms:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
BASE = ["email", "ip", "card", "phone"]
#: Kinds in order of output. short_card: 13 to 15 digits passing Luhn, as some issuers have them.
KINDS = [*BASE, "iban", "ssn", "short_card"]
#: Score of a valid span without context, and the words nearby that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "short_card": 0.4}
RAISE = {
    "email": r"mail|contact|kontakt|correo|courriel",
    "ip": r"\b(?:ip|host|server|address|adresse)\b",
    "card": r"card|visa|karte|carte|tarjeta|credit|kredit",
    "phone": r"phone|call|tel\b|tel[.:]|telefon|fax|mobil|m[óo]vil|t[ée]l[ée]phone",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "ssn": r"\bssn\b|social security",
    "short_card": r"card|visa|karte|carte|tarjeta|credit|kredit|amex",
}
LOWER = {"ip": r"version|release", "iban": r"\b(?:serial|part) ", "ssn": r"\b(?:order|part|invoice) ", "short_card": r"\b(?:order|invoice|isbn|serial) "}
UP, DOWN, THRESHOLD, NEAR = 0.3, 0.3, 0.6, 48
#: Lengths of IBANs by country, from the IBAN registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d, i):
        x = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether a compact IBAN has the remainder 1: its first four characters moved to the end, letters from 10 on."""
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    number = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _found(text: Column, kind: str) -> Column:
    """array<struct<match, start>> of a pattern's matches, leftmost and non-overlapping. An IBAN's pattern takes the first
    four characters only and looks ahead for the others (group 1), so that each possible start is a match of its own."""
    pattern, test = PATTERNS[kind]
    ahead = kind == "iban"
    empty = F.array().cast("array<struct<match:string,start:bigint>>")

    def placed(s):
        m, p = s.m, s.p
        starts = prefix_sums(F.zip_with(p, m, lambda a, b: F.length(a) + F.coalesce(F.lit(4) if ahead else F.length(b), F.lit(0))))
        return F.transform(
            F.arrays_zip(m.alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("b"), F.slice(starts, F.lit(1), F.size(m)).alias("s")),
            lambda z: F.struct(z.m.alias("match"), (z.s + F.length(z.b)).alias("start")),
        )

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(int(ahead))).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(test), let(parts, placed)).otherwise(empty)


def _cut(wide: Column, start: Column, n: Column) -> Column:
    """n code points from start of a text in UTF-32, where any place is reached at once."""
    first = F.encode(F.lit("x"), "UTF-32")  # see chat.masked_texts
    return F.substr(F.decode(F.concat(first, F.substr(wide, (start * 4 + 1).cast("int"), (n * 4).cast("int"))), "UTF-32"), F.lit(2))


def _placed(text: Column, kind: str, hits: Column, length) -> Column:
    """The spans of confirmed hits, scored by the words within NEAR code points of the whole text on either side."""

    def span(wide, x):
        low, end = F.greatest(x.start - NEAR, F.lit(0)), x.start + length(x)
        near = F.lower(F.concat(_cut(wide, low, x.start - low), F.lit(" \n "), _cut(wide, end, F.lit(NEAR))))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(RAISE[kind]), UP).otherwise(0.0)
        if kind in LOWER:
            score = score - F.when(near.rlike(LOWER[kind]), DOWN).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), end.alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    def placed(hits):
        parts = F.struct(hits.alias("hits"), F.when(F.size(hits) > 0, F.encode(text, "UTF-32")).alias("wide"))
        return let(parts, lambda s: F.transform(s.hits, lambda x: span(s.wide, x)))

    return let(hits, placed)


def _ibans(hits: Column) -> Column:
    """Confirmed IBANs as struct<match, start>, of their country's length: leftmost and non-overlapping ones."""

    def own(x):
        compact = F.regexp_replace(x.match, " ", "")
        size = F.try_element_at(F.create_map(*[F.lit(v) for kv in IBAN_LENGTH.items() for v in kv]), F.substring(x.match, 1, 2))
        match = F.get(F.regexp_extract_all(x.match, F.concat(F.lit(r"^(?:\x20?[A-Z0-9]){"), size.cast("string"), F.lit("}")), F.lit(0)), 0)
        ok = size.isNotNull() & (F.length(compact) >= size) & mod97(F.substr(compact, F.lit(1), size))
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(match.alias("match"), x.start.alias("start")))

    def apart(good):
        end = lambda x: x.start + F.length(x.match)
        empty = F.slice(good, F.lit(1), F.lit(0))
        kept = F.aggregate(good, empty, lambda acc, x: F.when((F.size(acc) == 0) | (end(F.element_at(acc, -1)) <= x.start), F.concat(acc, F.array(x))).otherwise(acc))
        return F.when(F.size(good) > 1, kept).otherwise(good)

    return let(F.filter(F.transform(hits, own), lambda x: x.isNotNull()), apart)


def spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>>, by kind in the order of KINDS, then start."""
    whole = F.coalesce(text, F.lit(""))
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "phone": lambda m: F.length(_digits(m)).between(8, 15),
        "ssn": lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    }

    def plain(kind):
        return _placed(whole, kind, F.filter(_found(whole, kind), lambda x: valid[kind](x.match)), lambda x: F.length(x.match))

    def cards(low, high, kind, hits):
        good = F.filter(hits, lambda x: F.when(F.length(_digits(x.match)).between(low, high), luhn(_digits(x.match))).otherwise(False))
        return _placed(whole, kind, good, lambda x: F.length(x.match))

    both = let(_found(whole, "card"), lambda hits: F.struct(cards(16, 19, "card", hits).alias("card"), cards(13, 15, "short_card", hits).alias("short")))
    ibans = _placed(whole, "iban", _ibans(_found(whole, "iban")), lambda x: F.length(x.match))
    likely = lambda xs: F.filter(xs, lambda x: x.score >= THRESHOLD)
    return let(both, lambda c: F.concat(plain("email"), plain("ip"), c.card, plain("phone"), likely(ibans), likely(plain("ssn")), likely(c.short)))


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with the spans of each whole text."""
    return df.withColumn(out, spans(F.col(text)))


def masked(text: Column, found: Column) -> Column:
    """The text with each region of overlapping spans replaced by the name of its first kind, as in [EMAIL]."""
    opened = F.transform(found, lambda s: F.struct(s.start.alias("at"), F.lit(1).alias("delta"), s.kind.alias("kind")))
    closed = F.transform(found, lambda s: F.struct(s.end.alias("at"), F.lit(-1).alias("delta"), s.kind.alias("kind")))

    def regions(events):
        depth = prefix_sums(F.transform(events, lambda e: e.delta))
        marked = F.zip_with(events, depth, lambda e, d: F.struct(e.at.alias("at"), e.delta.alias("delta"), e.kind.alias("kind"), d.alias("depth")))
        starts = F.filter(marked, lambda e: (e.depth == 0) & (e.delta == 1))
        ends = F.filter(marked, lambda e: (e.depth == 1) & (e.delta == -1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.at.alias("start"), e.at.alias("end"), s.kind.alias("kind")))

    def rebuilt(s):
        cut = lambda a, n: _cut(s.wide, a, n)
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(s.regions, lambda r: r.end))
        pieces = F.zip_with(s.regions, F.slice(before, F.lit(1), F.size(s.regions)), lambda r, b: F.concat(cut(b, r.start - b), F.lit("["), F.upper(r.kind), F.lit("]")))
        tail = F.element_at(before, -1)
        return F.concat(F.array_join(pieces, ""), cut(tail, F.octet_length(s.wide) / 4 - tail))

    parts = F.struct(F.encode(text, "UTF-32").alias("wide"), let(F.array_sort(F.concat(opened, closed)), regions).alias("regions"))
    return F.when(F.size(found) == 0, text).otherwise(let(parts, rebuilt))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text masked; a null text stays null."""
    new = let(F.struct(F.col(text).alias("t"), spans(F.col(text)).alias("s")), lambda x: F.when(x.t.isNotNull(), masked(x.t, x.s)))
    return docs.withColumn(text, new)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
