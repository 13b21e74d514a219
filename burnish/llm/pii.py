"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions. A pattern runs over the whole text once; the text between its matches
gives the offsets (code points, end exclusive). Patterns start only where a run of their own
characters starts (or where the last match ended) and use possessive quantifiers, which changes
no match but keeps the work linear in the text, also for very long runs. Sums of lengths are taken
in blocks, so the work grows with the number of matches, also for texts of numbers only.

Defined results: a null text is an empty text and has no spans; spans of different kinds may
overlap; an empty table gives an empty result; other columns are kept, and columns named like an
added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span, after the last match of its kind, in which a context word raises its
#: score.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """``pattern`` is what may match, ``words`` raise the score of a span that follows them."""

    name: str
    pattern: str
    score: float
    words: str


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        r"mail|contact|write|kontakt|courriel|correo",
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.5,
        r"\bip\b|address|host|server|login|adresse",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"card|visa|credit|pay|karte|carte|tarjeta"),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.6,
        r"phone|call|tel|mobile|fax|ruf",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
        r"(?![A-Za-z0-9])",
        0.9,
        r"iban|account|konto|compte|cuenta|bank",
    ),
)
BASE = ("email", "ip", "card", "phone")
_RANK = {k.name: i for i, k in enumerate(KINDS)}
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"
#: Entries of an array that are combined at a time, and characters of a piece of text.
BLOCK, CHUNK = 128, 1024


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an account number: first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    codes = F.transform(
        F.split(turned, ""),
        lambda c: F.when(c == "", F.lit("")).otherwise(
            F.conv(c, 36, 10)
        ),
    )
    return F.aggregate(
        F.split(F.array_join(codes, ""), ""),
        F.lit(0),
        lambda rest, c: F.when(c == "", rest).otherwise((rest * 10 + c.cast("int")) % 97),
    )


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(
            r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$"
        )
    if kind == "card":
        digits = _digits(value)
        return (
            (F.length(value) >= 12)
            & F.length(digits).between(12, 19)
            & F.call_function("luhn_check", digits)
        )
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (_mod97(value) == 1)
    return F.lit(True)


def _scanned(df: DataFrame, arrays: dict[str, str], combine, zero: int) -> DataFrame:
    """Add, for each array, one that combines for each entry those before it: its value's column.

    An aggregate that appends copies its list at each step, so it only ever runs over ``BLOCK``
    entries: blocks are combined, blocks of blocks too, and each level starts the one below.
    A null array stays null.
    """

    def blocks(name: str) -> Column:
        whole = F.col(name)
        firsts = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"))
        cut = F.transform(firsts, lambda b: F.slice(whole, b * BLOCK + 1, BLOCK))
        return F.when(F.size(whole) > 0, cut).when(whole.isNotNull(), F.slice(F.array(whole), 1, 0))

    def totals(name: str) -> Column:
        return F.transform(F.col(name), lambda s: F.aggregate(s, F.lit(zero), combine))

    def within(block: Column, start: Column) -> Column:
        run = F.aggregate(
            block, F.array(start),
            lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))),
        )
        return F.slice(run, 1, F.size(block))

    def placed(out: str) -> Column:
        starts = F.flatten(
            F.zip_with(F.col(f"{out}_c"), within(F.col(f"{out}_d"), F.lit(zero)), within)
        )
        return F.flatten(F.zip_with(F.col(f"{out}_a"), starts, within))

    outs = list(arrays.values())
    df = df.withColumns({f"{out}_a": blocks(name) for name, out in arrays.items()})
    df = df.withColumns({f"{out}_b": totals(f"{out}_a") for out in outs})
    df = df.withColumns({f"{out}_c": blocks(f"{out}_b") for out in outs})
    df = df.withColumns({f"{out}_d": totals(f"{out}_c") for out in outs})
    df = df.withColumns({out: placed(out) for out in outs})
    return df.drop(*[f"{out}_{x}" for out in outs for x in "abcd"])


def find_pii(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array of ``(start, rank, end, kind, value, score)`` in text order."""
    names = df.columns
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<string>")
    needs = {"email": "@", "phone": "+"}
    df = df.withColumn("__text", whole)

    def matches(kind: Kind) -> Column:
        found = F.regexp_extract_all(F.col("__text"), F.lit(kind.pattern), F.lit(0))
        if kind.name in needs:
            found = F.when(F.col("__text").contains(needs[kind.name]), found).otherwise(none)
        return found

    def gaps(kind: Kind) -> Column:
        """Null, as all that follows from it, in texts without a span of the kind."""
        m = F.col(f"__m_{kind.name}")
        cut = F.slice(F.split(F.col("__text"), kind.pattern, -1), F.lit(1), F.size(m))
        return F.when(F.exists(m, lambda v: _confirmed(kind.name, v)), cut)

    def lengths(kind: Kind) -> Column:
        return F.zip_with(f"__g_{kind.name}", f"__m_{kind.name}",
                          lambda x, y: F.length(x) + F.length(y))

    df = df.withColumns({f"__m_{k.name}": matches(k) for k in KINDS})
    df = df.withColumns({f"__g_{k.name}": gaps(k) for k in KINDS})
    df = df.withColumns({f"__n_{k.name}": lengths(k) for k in KINDS})
    arrays = {f"__n_{k.name}": f"__s_{k.name}" for k in KINDS}
    df = _scanned(df, arrays, lambda x, y: x + y, 0)
    df = df.withColumn("__spans", F.array_sort(F.concat(*[_checked(k) for k in KINDS])))
    kept = [F.col(f"`{c}`") for c in names if c != out]
    return df.select(*kept, F.col("__spans").alias(out))


def _checked(kind: Kind) -> Column:
    """The confirmed matches of a kind with offsets and scores."""
    parts = F.zip_with(
        F.col(f"__g_{kind.name}"), F.col(f"__m_{kind.name}"),
        lambda g, m: F.struct(g.alias("gap"), m.alias("value")),
    )
    placed = F.zip_with(
        F.col(f"__s_{kind.name}"), parts,
        lambda at, p: F.struct((at + F.length(p["gap"])).alias("start"), p["gap"].alias("gap"),
                               p["value"].alias("value")),
    )
    kept = F.filter(placed, lambda s: _confirmed(kind.name, s["value"]))
    none = F.from_json(F.lit("[]"), _SPANS)
    return F.coalesce(F.transform(kept, lambda s: _scored(kind, s)), none)


def _scored(kind: Kind, s: Column) -> Column:
    helped = F.lower(F.substring(s["gap"], -CONTEXT, CONTEXT)).rlike(kind.words)
    score = F.lit(kind.score) + F.when(helped, F.lit(1 - kind.score) / 2).otherwise(F.lit(0.0))
    return F.struct(
        s["start"].alias("start"),
        F.lit(_RANK[kind.name]).alias("rank"),
        (s["start"] + F.length(s["value"])).alias("end"),
        F.lit(kind.name).alias("kind"),
        s["value"].alias("value"),
        score.alias("score"),
    )


def named(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(one, ",")


def redact(df: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """Replace the spans that score at least ``least`` by their kind in angle brackets.

    Overlapping spans give one replacement, named after the first. A null text stays null.
    """
    names = df.columns
    df = find_pii(df.select("*", F.col(f"`{text}`").alias("__whole")), "__whole", "__found")
    whole = F.col("__whole")
    chosen = F.filter("__found", lambda s: s["score"] >= least)
    df = df.withColumn("__chosen", F.when(F.size("__found") > 0, chosen))
    df = df.withColumn("__ends", F.transform("__chosen", lambda s: s["end"]))
    df = _scanned(df, {"__ends": "__done"}, lambda x, y: F.greatest(x, y), 0)
    # a piece of the text is read from the chunks that it lies in, not from the text's start
    chunks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    df = df.withColumn("__chunks", F.when(F.size("__chosen") > 0, chunks))

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        last = F.floor(end / CHUNK).cast("int")
        near = F.array_join(F.slice(F.col("__chunks"), first + 1, last - first + 1), "")
        return F.substring(near, start - first * CHUNK + 1, end - start)

    def step(s: Column, at: Column) -> Column:
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= at, F.concat(piece(at, s["start"]), mark)).otherwise("")

    tail = piece(F.array_max("__ends"), F.length(whole))
    rebuilt = F.concat(F.array_join(F.zip_with("__chosen", "__done", step), ""), tail)
    out = F.when(F.size("__chosen") > 0, rebuilt).otherwise(whole)
    return df.select(
        *[out.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    )
