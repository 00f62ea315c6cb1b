"""Personal data in texts, with DataFrame functions only.

A regular expression proposes spans, a checksum or range check confirms them, and words nearby move their score. The texts
stay where they are: the matches of a pattern come from one pass of regexp_extract_all, their places from the lengths of the
pieces that split leaves between them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """What is looked for. Patterns are possessive and start at the edge of a run, so that they need time in proportion to the
    text and no stack, and match as the plain pattern in the comment. `needs` is a substring of every match, if there is one.
    Spans below `least` are dropped."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    context: str
    needs: str = ""
    score: float = 0.6
    least: float = 0.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high) & F.call_function("luhn_check", _digits(m))


def mod_97(m: Column) -> Column:
    """Whether the check digits of an international bank account number are right: letters count 10 to 35, and the number
    with its first four characters at the end is 1 modulo 97."""
    plain = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


#: Kinds of the base, in the order of the results: emails, addresses, cards, phone numbers.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "mail|contact|write|reach", "@", 0.9),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255), "ip|host|server|address|login", "."),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card(16, 19), "card|visa|master|credit|debit|pay", "", 0.7),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), "phone|call|tel|mobile|fax|whatsapp", "+"),
)
#: Kinds beyond the base.
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod_97, "iban|bank|account|konto|compte|cuenta", "", 0.9, 0.5),
    Kind("short_card", r"(?<![0-9][\x20-])(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", _card(13, 15), "card|visa|amex|american express|credit|debit", "", 0.4, 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn|social security", "-", 0.3, 0.5),
)
#: Characters before a span in which context words count, and what they add to the score.
NEAR, BONUS = 40, 0.3


def _spans(text: Column, matches: Column, pieces: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of the confirmed matches; offsets in code points."""
    rows = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(matches)), F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(matches, kind.valid).alias("ok"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["gap"]
        span = F.struct(start.alias("start"), (start + row["size"]).alias("end"))
        return F.struct((start + row["size"]).alias("at"), F.when(row["ok"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])

    def scored(s: Column) -> Column:
        start = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.lower(F.substring(text, start + 1, s["start"] - start))
        score = F.lit(kind.score) + F.when(near.rlike(rf"(?<![a-z])(?:{kind.context})"), F.lit(min(BONUS, 1 - kind.score))).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 2).alias("score"))

    return F.filter(F.transform(found, scored), lambda s: s["score"] >= kind.least)


def find(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE + MORE, out: str = "pii_") -> DataFrame:
    """docs with one array column `pii_<kind>` of (kind, start, end, score) for each kind, in order of start. Null texts are
    empty. Columns of those names are replaced, others stay; rows never move."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_pattern = {f"__{k}": (kind.pattern, kind.needs) for k, kind in enumerate(kinds)}
    found = docs
    for name, (pattern, needs) in by_pattern.items():
        here = F.contains(text, F.lit(needs)) if needs else F.lit(True)
        found = found.withColumns({
            f"{name}m": F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")),
            f"{name}p": F.when(here, F.split(text, pattern, -1)).otherwise(F.expr("cast(array() as array<string>)")),
        })
    found = found.withColumns({f"{out}{kind.name}": _spans(text, F.col(f"__{k}m"), F.col(f"__{k}p"), kind) for k, kind in enumerate(kinds)})
    return found.drop(*(f"__{k}{x}" for k in range(len(kinds)) for x in "mp"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every row; repeated rows give repeated results."""
    found = find(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text").drop("__text")

    def written(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    base, more = ([F.col(f"pii_{k.name}") for k in kinds] for kinds in (BASE, MORE))
    counts = [F.size(c).cast("bigint").alias(f"n_{k.name}") for c, k in zip(base, BASE)]
    return found.select(
        id_col, *counts,
        F.sha2(F.array_join(F.concat(*map(written, base)), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(written, base + more)), ",").alias("spans"),
        F.array_join(F.concat(*(F.transform(c, lambda s: s["score"].cast("string")) for c in base + more)), ",").alias("scores"),
    )
