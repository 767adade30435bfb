"""Personal data in texts, with built-in column functions only.

Regular expressions propose spans, checks confirm them (octets of addresses, Luhn for cards, remainder
by 97 for bank accounts, numbers of digits), and words shortly before or after adjust the score. Spans
below :data:`LEAST` are dropped. The kinds ``email``, ``ip``, ``card`` and ``phone`` are certain by
their check alone; ``ssn`` needs such a word.

The patterns use possessive repeats and start where a run of characters starts, or where the last match
ended. They find the same matches as their plain forms, but a long run costs one pass, not one pass per
character. Places are code points, end exclusive.

Defined results: null and empty texts have no spans, and masking leaves them as they are. Spans of
different kinds may overlap; masking then covers both with the mark of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.5
#: Characters on either side of a match that are searched for context words.
NEAR = 40
SPAN = "array<struct<start: int, end: int, kind: string, value: string, score: double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column, width: int = 128) -> Column:
    """The sums of the first 1, 2, ... ``numbers``; by blocks, so long arrays stay cheap."""

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda a, x: a + x)

    def sums(n: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / width).cast("int"))
        return let(
            F.transform(blocks, lambda b: total(F.slice(n, b * width + 1, F.lit(width)))),
            lambda heads: let(
                F.transform(blocks, lambda b: total(F.slice(heads, F.lit(1), b))),
                lambda before: F.transform(
                    n,
                    lambda _, i: F.get(before, F.floor(i / width).cast("int"))
                    + total(
                        F.slice(
                            n, F.floor(i / width).cast("int") * width + 1, F.pmod(i, F.lit(width)) + 1
                        )
                    ),
                ),
            ),
        )

    return F.when(F.size(numbers) > 0, let(numbers, sums)).otherwise(F.array().cast("array<int>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(value, r"\."), fits)


def _luhn(value: Column) -> Column:
    def valid(digits: Column) -> Column:
        each = F.transform(
            F.reverse(F.split(digits, "")),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.floor(d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10
            ),
        )
        total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
        return F.length(digits).between(14, 19) & (total % 10 == 0)

    return let(_digits(value), valid)


def _remainder_97(value: Column) -> Column:
    def valid(code: Column) -> Column:
        moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
        numbers = F.transform(
            F.split(moved, ""),
            lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
        )
        rest = F.aggregate(
            numbers, F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97))
        )
        return F.length(code).between(15, 34) & (rest == 1)

    return let(F.regexp_replace(value, " ", ""), valid)


def _always(value: Column) -> Column:
    return F.lit(True)


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


#: kind: (pattern, a sign without which no match is possible, check, score, context words).
KINDS: dict[str, tuple] = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", _always, 0.9, "mail|contact|write to",
    ),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
        "[0-9]", _octets, 0.7, "address|server|host|ip",
    ),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])++",
        "[0-9]", _luhn, 0.8, "card|visa|credit|payment",
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+", _phone, 0.7, "call|phone|tel|mobile",
    ),
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
        r"(?![A-Za-z0-9])",
        "[0-9]", _remainder_97, 0.8, "iban|account|bank",
    ),
    "ssn": (
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "[0-9]", _always, 0.4, "ssn|social|security",
    ),
}
BASE = ("email", "ip", "card", "phone")


def _spans(text: Column, kind: str) -> Column:
    pattern, sign, check, score, words = KINDS[kind]
    none = F.array().cast(SPAN)

    def located(found: Column, gaps: Column) -> Column:
        lengths = F.transform(
            found,
            lambda m, i: F.length(F.get(gaps, i))
            + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0),
        )

        def build(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                near = F.lower(
                    F.concat(
                        F.right(F.get(gaps, i), F.lit(NEAR)),
                        F.lit("\n"),
                        F.left(F.get(gaps, i + 1), F.lit(NEAR)),
                    )
                )
                context = F.when(near.rlike(rf"\b(?:{words})"), 0.2).otherwise(0.0)
                return F.struct(
                    F.get(starts, i).alias("start"),
                    (F.get(starts, i) + F.length(m)).alias("end"),
                    F.lit(kind).alias("kind"),
                    m.alias("value"),
                    F.least(F.lit(1.0), F.lit(score) + context).alias("score"),
                )

            return F.transform(found, one)

        return F.filter(
            let(running_sums(lengths), build),
            lambda s: check(s["value"]) & (s["score"] >= LEAST),
        )

    def search(found: Column) -> Column:
        split = F.split(text, pattern, -1)
        return F.when(F.size(found) > 0, let(split, lambda gaps: located(found, gaps))).otherwise(none)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(sign), let(matches, search)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with the confirmed spans (start, end, kind, value, score), by start, then kind."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def before(a: Column, b: Column) -> Column:
        order = F.array_position(kinds, a["kind"]) - F.array_position(kinds, b["kind"])
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order).cast("int")

    spans = F.concat(*[_spans(whole, kind) for kind in KINDS])
    return docs.withColumn(name, F.array_sort(spans, before))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(each, ",")


def mask_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by marks such as ``[EMAIL]``."""
    whole, spans = F.col(f"`{text}`"), F.col(f"`{name}`")

    def replace(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        piece = F.concat(
            F.substring(whole, done["at"] + 1, span["start"] - done["at"]),
            F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")),
        )
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.array_append(done["parts"], piece)).otherwise(done["parts"]).alias("parts"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    masked = F.aggregate(
        spans,
        first,
        replace,
        lambda d: F.concat(
            F.array_join(d["parts"], ""), F.substring(whole, d["at"] + 1, F.length(whole))
        ),
    )
    return docs.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(whole))
