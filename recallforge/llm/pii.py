r"""Personal data by proposing patterns, confirming checks and context words; DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, part
and digit counts for the rest) and context words near a span raise or lower its score. Nothing is
shuffled, and all of a text's spans come from its own row.

The patterns are written so that Java's matcher needs neither recursion nor retries inside a run
(possessive groups, starts only at the edge of a run or of the last match); they find the same
leftmost, non-overlapping matches as the plain patterns in the comments and take linear time on very
long runs. A span's place comes from the lengths of the matches and of the parts between them.

An IBAN is cut at its country's length, so words in capitals that follow it don't spoil it; one whose
country isn't in LENGTHS is taken as far as letters and digits go.

Defined cases: null text counts as empty (no spans, digest of the empty string); equal rows get equal
values; matches of several kinds at one place (ties) are all listed, in the order of KINDS; very long texts take
time and memory in proportion to their length; extra columns aren't read; an empty table gives an empty result;
offsets count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Base kinds in the order that ties are listed in, then what the method adds.
KINDS = ("email", "ip", "card", "phone", "iban")

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ where it has 14 to 19 digits: whole runs only, as failing matches drop
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Lengths of IBANs by country (fixed values, the public IBAN registry).
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """Country, check digits, then the country's number of letters or digits in groups that single spaces may part."""
    by_length: dict[int, list[str]] = {}
    for country, n in LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    known = [rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in sorted(by_length.items())]
    other = rf"(?!{'|'.join(LENGTHS)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


PATTERNS["iban"] = _iban()
#: What a text must hold for the pattern to be worth running: a cheap test with no false negatives.
_HINTS = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")), "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: F.lit(True)}
#: Score of a confirmed span before context, and the words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": r"e-?mail|contact|write|reach|address",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|credit|debit|visa|payment|account",
    "phone": r"phone|call|mobile|\btel|fax|contact",
    "iban": r"iban|bank|account|transfer",
}
#: Code points before and after a span that are searched for such words.
NEAR = 40
AGAINST = r"version|example|sample|isbn|serial|order no|invoice"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the digits pass Luhn's check; digits only, null where there are none."""
    def added(total: Column, i: Column) -> Column:
        d = F.substring(number, -1 - i, F.lit(1)).cast("int") * (1 + i % 2)
        return (total + d - F.when(d > 9, 9).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0).cast("int"), added) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an IBAN without blanks leaves 1 modulo 97 (first four to the end, letters 10 to 35)."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0).cast("int"), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def confirmed(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        bare = F.translate(value, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


#: Elements that one step of a running sum appends to at most: appending copies what is there.
RUN = 128


def running(lengths: Column) -> Column:
    """Sums of what stands before each number of an array (a plain column); in runs of RUN, whose own sums come first."""
    cut = lambda j: F.slice(lengths, j * RUN + 1, F.lit(RUN))
    append = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    first = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    runs = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))
    sums = F.transform(runs, lambda j: F.aggregate(cut(j), F.lit(0), lambda s, x: s + x))
    offsets = F.aggregate(sums, first(F.lit(0)), append, lambda s: s["out"])
    each = F.transform(F.arrays_zip(runs.alias("j"), offsets.alias("o")), lambda z: F.aggregate(cut(z["j"]), first(z["o"]), append, lambda s: s["out"]))
    return F.when(F.size(lengths) > 0, F.flatten(each)).otherwise(F.array().cast("array<int>"))


def _spans(found: Column, parts: Column, starts: Column, kind: str) -> Column:
    """array<struct<start, kind, end, value, score>> of the confirmed matches, in text order.

    found: the matches, parts: what stands between them, starts: the places of the parts. A match's context is
    the NEAR code points on either side, as far as the neighbouring matches and the parts beyond them go.
    """
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def place(value: Column, i: Column) -> Column:
        before = F.right(F.concat(F.right(at(parts, i - 1), F.lit(NEAR)), at(found, i - 1), F.right(at(parts, i), F.lit(NEAR))), F.lit(NEAR))
        after = F.left(F.concat(F.left(at(parts, i + 1), F.lit(NEAR)), F.when(F.length(at(parts, i + 1)) < NEAR, F.concat(at(found, i + 1), F.left(at(parts, i + 2), F.lit(NEAR)))).otherwise("")), F.lit(NEAR))
        start = F.get(starts, i) + F.length(at(parts, i))
        near = F.lower(F.concat(before, F.lit("\n"), after))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.1).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), F.round(score, 2).alias("score"))

    return F.filter(F.transform(found, place), lambda s: confirmed(kind, s["value"]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans, array<struct<start, kind, end, value, score>> ordered by start, then kind.

    kind is a place in KINDS; score is the prior of the kind, adjusted by words within NEAR code
    points on either side of the span, 0 to 1.
    """
    rows = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.select("*", *[F.when(_HINTS[k](F.col("text")), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"found_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("*", *[F.when(F.size(f"found_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"parts_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("*", *[F.zip_with(f"found_{k}", F.slice(f"parts_{k}", F.lit(1), F.size(f"found_{k}")), lambda v, part: F.length(v) + F.length(part)).alias(f"lengths_{k}") for k in KINDS])
    rows = rows.select("*", *[running(F.col(f"lengths_{k}")).alias(f"starts_{k}") for k in KINDS])
    spans = F.concat(*[_spans(F.col(f"found_{k}"), F.col(f"parts_{k}"), F.col(f"starts_{k}"), k) for k in KINDS])
    return rows.select("doc_id", F.array_sort(spans).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    """How many of the spans are of that kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
