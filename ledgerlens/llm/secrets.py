"""Secret scans: three fixed kinds, and high entropy of sliding windows over candidate strings.

Base kinds: `assign` (a named value), `access` (an access key), `hex` (a long number). The method adds candidates: runs of
a character class, hexadecimal or base64, of `WINDOW` characters or more, that are not harmless as a whole (`HARMLESS`) and
in which some window of `WINDOW` characters that touches no sample word (`SAMPLES`) has a Shannon entropy of at least the
threshold of the class. The counts of a window are kept from one window to the next: the character that enters adds one, the
one that leaves takes one away, and the entropy follows from the terms of these two.

Everything is Column expressions: a text is split at the matches of a pattern, so that places follow from lengths.
Places are code points, end exclusive; the same in bytes serves `redact`.

Defined results: a null or empty text has no spans; spans of several kinds may overlap and are all given, ordered by
start, then kind; repeated rows are scanned each; other columns are kept by `redact` and not read otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# The shortest value of an assignment; shorter ones are matched, and dropped.
VALUE = 6
WINDOW = 20
# An entropy is a sum of rounded terms; one this close to a threshold reaches it.
ROUNDING = 1e-9
# Class, its characters, least entropy in bits of a window.
DIGITS = "0123456789"
CLASSES = (("entropy_hex", "[0-9A-Fa-f]", DIGITS + "abcdefABCDEF", 3.0),
           ("entropy_base64", "[A-Za-z0-9+/_=-]",
            DIGITS + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7))
# The allow list. Numbers, words joined by signs and rulers of signs are no secrets as a whole; a sample word frees the windows
# that it overlaps and no others.
HARMLESS = r"^([0-9]+|[A-Za-z]+([-_/=+][A-Za-z]+)*|[-_=+/]+)$"
SAMPLES = "example|EXAMPLE|sample|0123456789|abcdefgh"
KINDS = ("assign", "access", "hex", *(name for name, *_ in CLASSES))
MARK = "[SECRET]"
# Matches of a text whose spans are put together at a time.
BLOCK = 256

SPAN = "struct<start:int,rank:int,end:int,from:int,to:int,value:string>"


def matches(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """All matches, leftmost and apart, with their places in code points (start, end) and bytes (from, to)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")

    def state(at, byte, spans):
        return F.struct(at.alias("at"), byte.alias("byte"), spans.alias("spans"))

    def step(acc, p):
        start, first = acc["at"] + F.length(p["gap"]), acc["byte"] + F.octet_length(p["gap"])
        end, last = start + F.length(p["match"]), first + F.octet_length(p["match"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                        first.alias("from"), last.alias("to"), p["value"].alias("value")).cast(SPAN)
        return F.when(p["match"].isNull(), acc).otherwise(state(end, last, F.concat(acc["spans"], F.array(span))))

    # Appending copies an array, so it goes on in blocks.
    def block(acc, b):
        return F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), state(acc["at"], acc["byte"], none), step,
                           lambda own: state(own["at"], own["byte"], F.concat(acc["spans"], own["spans"])))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    return F.when(text.rlike(pattern), F.aggregate(blocks, state(F.lit(0), F.lit(0), none), block)["spans"]).otherwise(none)


def top_entropy(value: Column, alphabet: str) -> Column:
    """The largest entropy of a window, in bits; -1 where there is none. Counts are kept by place in the alphabet."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    table = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)))
    term = lambda k: F.element_at(table, k + 1)

    def step(acc, i):  # i from 1; the window ends at i
        new, old = F.element_at(codes, i), F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(0)
        more = F.element_at(acc["counts"], new)
        less = F.element_at(acc["counts"], F.greatest(old, F.lit(1))) + (new == old).cast("int")
        total = (acc["sum"] + term(more + 1) - term(more)
                 + F.when(old > 0, term(less - 1) - term(less)).otherwise(0.0))
        counts = F.transform(acc["counts"], lambda n, at: n + (at + 1 == new).cast("int") - (at + 1 == old).cast("int"))
        return F.struct(total.alias("sum"), counts.alias("counts"))

    def after(acc, i):
        now = step(acc, i)
        least = F.when(i >= WINDOW, F.least(acc["least"], now["sum"])).otherwise(acc["least"])
        return F.struct(now["sum"].alias("sum"), now["counts"].alias("counts"), least.alias("least"))

    zero = F.struct(F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
                    F.lit(float(WINDOW * WINDOW)).alias("least"))
    entropy = F.lit(math.log2(WINDOW)) - F.aggregate(F.sequence(F.lit(1), F.length(value)), zero, after)["least"] / WINDOW
    return F.when(F.length(value) >= WINDOW, entropy).otherwise(-1.0)


def base_spans(text: Column) -> list[Column]:
    assign = F.filter(matches(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= VALUE)
    return [assign, matches(text, "access", ACCESS), matches(text, "hex", HEX)]


def strong(alphabet: str, least: float):
    """Whether a candidate is a secret: some window between its sample words reaches the threshold."""
    def test(span):
        return ~span["value"].rlike(HARMLESS) & F.exists(F.split(span["value"], SAMPLES),
                                                         lambda piece: top_entropy(piece, alphabet) >= least)

    return test


def entropy_spans(text: Column) -> list[Column]:
    return [F.filter(matches(text, kind, f"{one}{{{WINDOW},}}"), strong(alphabet, least - ROUNDING))
            for kind, one, alphabet, least in CLASSES]


def spans(docs: DataFrame) -> DataFrame:
    """Adds `base` and `spans`, arrays of spans in order, to the documents."""
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumn("base", F.array_sort(F.concat(*base_spans(text))))
    return base.withColumn("spans", F.array_sort(F.concat("base", *entropy_spans(text))))


def listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with a mark in place of every secret; `n_chars` follows the text where there is one."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = spans(docs.select(own.alias("own"), "text"))
    raw = F.col("text").cast("binary")
    piece = lambda first, size: raw.substr(first + 1, size).cast("string")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        apart = F.concat(acc["parts"], F.array(piece(acc["at"], s["from"] - acc["at"]), F.lit(MARK)))
        return F.struct(F.greatest(acc["at"], s["to"]).alias("at"),
                        F.when(s["from"] >= acc["at"], apart).otherwise(acc["parts"]).alias("parts"))

    def finish(acc):
        return F.concat(F.array_join(acc["parts"], ""), piece(acc["at"], F.octet_length("text")))

    clean = found.withColumn("clean", F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, finish))
                             .otherwise(F.col("text")))
    out = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long"))
           .otherwise(F.col("own.n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*(out[c].alias(c) if c in out else F.col(f"own.`{c}`").alias(c) for c in docs.columns))
