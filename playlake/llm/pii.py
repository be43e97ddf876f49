"""Personal data: regular expressions propose, checksums confirm, nearby words adjust a score; DataFrame functions only.

A kind is a pattern, a test of the matched text, a prior, and context words.  Positions come from splitting the text at
the pattern: the pieces between the matches and the matches themselves alternate, so running lengths give each match's
place in code points.  The patterns use possessive quantifiers and a guard against starts within a run, so a text of any
length is scanned in linear time.

Base kinds are kept whenever their test passes.  The added kinds (``iban`` with mod-97, ``national_phone``, ``secret``)
are kept from a score of :data:`MIN_SCORE`; the score is a prior, raised when a context word stands within
:data:`CONTEXT_CHARS` characters before the span, or after it up to the next match of its kind, lowered when an opposing word does.

Defined results: a null text is the empty text; overlapping spans of different kinds are all reported; rows that repeat
are scored one by one; columns beside the id and the text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT_CHARS, MIN_SCORE = 40, 0.6
#: Matches that are folded at once.
RUN = 128


@dataclass(frozen=True)
class Kind:
    """How to find one kind of personal data."""

    name: str
    pattern: str
    #: A cheap test of the whole text without which the pattern can't match.
    needs: str
    prior: float
    context: tuple[str, ...]
    against: tuple[str, ...] = ()
    base: bool = True


# The lengths of IBANs without spaces by country, as registered or in use.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE IM ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DJ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BF BI BJ CF CG CI CM FR GA GF GP GR IT KM MC MG ML MQ MR NC NE PF PM RE SM SN TD TF TG WF YT", 28: "AL AZ BY CY DO GT HN HU LB MA NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A known country bounds the span by its length; of any other, a span ends at a word's end, the farthest first."""
    known = [(n, codes.replace(" ", "|")) for n, codes in IBAN_COUNTRIES.items()]
    fixed = "|".join(f"(?:{codes})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in known)
    other = f"(?!{'|'.join(codes for _, codes in known)})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}"
    return f"(?<![A-Za-z0-9])(?:{fixed}|{other})(?![A-Za-z0-9])"


# The four base kinds in the order in which ties of a start are listed, then the added ones.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "contact", "write to")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", 0.7, ("ip", "host", "server", "address"), ("version", "release")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9](?:[ -]?[0-9]){13}", 0.8, ("card", "visa", "credit", "payment"), ("order", "isbn")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.8, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", _iban(), "[A-Z][A-Z][0-9][0-9]", 0.7, ("iban", "account", "konto", "compte", "cuenta"), (), False),
    Kind("national_phone", r"(?<![+0-9A-Za-z().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-]", 0.4, ("phone", "tel", "call", "mobile", "fax"), ("order", "part", "isbn"), False),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])", "[0-9a-f]{32}", 0.4, ("token", "key", "secret", "password"), ("sha", "md5", "commit", "checksum", "hash"), False),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, _doubled(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def _doubled(digit: Column) -> Column:
    return digit * 2 - F.when(digit > 4, 9).otherwise(0)


def mod97(text: Column) -> Column:
    """The ISO 7064 remainder of an IBAN: its first four characters go to the end, letters count 10 to 35."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(F.lit(1), F.lit(4)))

    def step(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c <= 57, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _confirmed(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(text)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(text, " ", "")).between(15, 34), mod97(text) == 1).otherwise(False)
    if kind == "secret":
        return text.rlike("[0-9]") & text.rlike("[a-f]")
    return F.lit(True)


def _possible(kind: Kind, text: Column) -> Column:
    return text.rlike(kind.needs) if len(kind.needs) > 1 else text.contains(kind.needs)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    def near(words):
        pattern = r"(?i)\b(?:" + "|".join(words) + ")"
        return before.rlike(pattern) | after.rlike(pattern)

    score = F.lit(kind.prior)
    if kind.context:
        score += F.when(near(kind.context), 0.3).otherwise(0.0)
    if kind.against:
        score -= F.when(near(kind.against), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(kind: Kind, text: Column) -> Column:
    """Array of struct(kind, start, end, text, score) of one kind's confirmed matches, in order."""
    schema = "array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>"
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("text"), F.slice(pieces, 2, F.size(matches)).alias("after"))
    length = lambda x: F.char_length(x["gap"]) + F.char_length(x["text"])
    last = lambda *parts: F.right(F.concat(*parts), F.lit(CONTEXT_CHARS))

    def fold(items: Column, first: Column, at: Column) -> Column:
        """The spans of a run of matches: running end of piece and match, where each starts and ends.  The last characters are carried along, so that the
        context reaches over earlier matches and the text isn't cut from its beginning for each."""
        earlier = F.slice(items, F.greatest(first - CONTEXT_CHARS, F.lit(0)) + 1, F.least(first, F.lit(CONTEXT_CHARS)))  # each has a character at least
        before = F.right(F.array_join(F.transform(earlier, lambda x: F.concat(x["gap"], x["text"])), ""), F.lit(CONTEXT_CHARS))
        return F.aggregate(
            F.slice(items, first + 1, RUN),
            F.struct(at.alias("at"), before.alias("before"), F.array().cast(schema).alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + length(x)).alias("at"),
                last(acc["before"], x["gap"], x["text"]).alias("before"),
                F.when(
                    _confirmed(kind.name, x["text"]),
                    F.concat(acc["spans"], F.array(F.struct(
                        (acc["at"] + F.char_length(x["gap"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"),
                        (acc["at"] + length(x)).alias("end"), x["text"].alias("text"),
                        _score(kind, last(acc["before"], x["gap"]), F.left(x["after"], F.lit(CONTEXT_CHARS))).alias("score"),
                    )).cast(schema)),
                ).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    total = lambda xs, of: F.aggregate(xs, F.lit(0), lambda acc, x: acc + of(x))

    def in_runs(items: Column) -> Column:
        """An array that grows by one is copied each time, so matches are folded in runs of a fixed length, each from where the runs before end."""
        firsts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(RUN))
        sizes = F.transform(firsts, lambda first: total(F.slice(items, first + 1, RUN), length))
        folded = _let(sizes, lambda held: F.transform(firsts, lambda first: fold(items, first, total(F.slice(held, 1, F.floor(first / RUN).cast("int")), lambda n: n))))
        return F.when(F.size(items) > 0, F.flatten(folded)).otherwise(F.array().cast(schema))

    found = _let(zipped, in_runs)
    found = F.when(_possible(kind, text), found).otherwise(F.array().cast(schema))
    return found if kind.base else F.filter(found, lambda s: s["score"] >= MIN_SCORE)


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", kinds=KINDS) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans`` (arrays of struct(start, rank, kind, end, text, score), by start and kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = {k.name: spans_of(k, F.col("text")) for k in kinds}
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", *[c.alias(f"k_{n}") for n, c in columns.items()])
    base = [f"k_{k.name}" for k in kinds if k.base]
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{c[2:]}") for c in base],
        F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*[f"k_{n}" for n in columns])).alias("spans"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """The counts of base kinds, the digest of their spans, and all spans as text."""
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """``docs`` with each confirmed span of the base kinds replaced by its kind's name in angle brackets (kinds in order)."""
    for kind in (k for k in kinds if k.base):
        docs = docs.withColumn(text_col, _without(kind, F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _without(kind: Kind, text: Column) -> Column:
    def cut(spans: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
        kept = F.transform(spans, lambda s, i: F.concat(text.substr(end(i) + 1, s["start"] - end(i)), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(kept, ""), text.substr(end(F.size(spans)) + 1, F.char_length(text)))

    return _let(spans_of(kind, text), cut)
