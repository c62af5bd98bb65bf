"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a DataFrame expression. A pattern's places come from splitting the text at its matches: the pieces between
them and the matches themselves, in turn, add up to code point offsets. A candidate (a run of credential characters) is
walked once: the counts of the window's symbols are kept, twelve of them in a number, and each step changes two, with the sum
of c * log2 c beside it, so the entropy of every window costs a constant number of steps. Thresholds differ by character class;
an allow-list (identifiers in words, UUIDs, placeholders, counting sequences) suppresses candidates.

Defined cases: a null text is empty and has no spans; a null id is kept; every row gives one row, repeated ones too; an
empty table gives an empty result; further columns are not read by ``scan``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, text_of, upto

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGNED = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of five bits that share a number.
PER_CELL = 12
#: Characters of the sliding window, and the least entropy in bits of its fullest place, by character class.
WINDOW = 20
CLASSES = (("entropy_hex", r"^[0-9a-fA-F]+$", 3.0), ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.6), ("entropy_base64", r"^.+$", 3.7))
#: A candidate that matches one of these is no secret.
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[A-Za-z_=+/-]+$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[_-]",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghij",
    r"^(?:/?[A-Za-z]+[0-9]{0,4}[/_=-])++[A-Za-z]*[0-9]{0,4}$",
)
SPAN = "array<struct<s:int,e:int,k:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _places(text: Column, pattern: str, found: Column, keep, kind: str, rank: int) -> Column:
    """Spans of the matches ``found`` that ``keep`` (by number) accepts."""

    def spans(before, gap):
        def span(i):
            s = F.get(before, i) + F.get(gap, i)
            return F.struct(s.alias("s"), (s + F.length(F.get(found, i))).alias("e"), F.lit(rank).alias("k"), F.lit(kind).alias("kind"))

        return F.transform(F.filter(upto(F.size(found)), keep), span).cast(SPAN)

    def walk(gap):
        steps = F.transform(gap, lambda n, i: n + F.coalesce(F.length(F.get(found, i)), F.lit(0)))
        return let(running(steps, lambda a, b: a + b, F.lit(0)), lambda before: spans(before, gap))

    return let(F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece)), walk)


def _matched(text: Column, pattern: str, kind: str, rank: int) -> Column:
    def spans(found):
        return F.when(F.size(found) == 0, _none()).otherwise(_places(text, pattern, found, lambda i: F.lit(True), kind, rank))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _assigned(text: Column) -> Column:
    def spans(found):
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        return let(values, lambda v: _places(text, ASSIGN, found, lambda i: F.length(F.get(v, i)) >= ASSIGNED, "assign", 0))

    low = F.lower(text)
    likely = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in KEYWORDS)) & (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    return F.when(likely, let(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), lambda m: F.when(F.size(m) == 0, _none()).otherwise(spans(m)))).otherwise(_none())


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of ``window`` characters (30 at most); 0 for shorter strings."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    cells = len(ALPHABET) // PER_CELL + 1
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (code % PER_CELL))
    cell = lambda code: F.floor(code / PER_CELL).cast("int")
    count = lambda n, code: F.call_function("shiftright", F.get(n, cell(code)), 5 * (code % PER_CELL)).bitwiseAND(F.lit(31)).cast("int")

    def walk(codes):
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), cells).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(a, i):
            new, old = F.get(codes, i), F.get(codes, i - window)
            # The new symbol enters, then the old one leaves: only their own counts, and their own terms of the sum, change.
            c_in = count(a["n"], new)
            c_out = count(a["n"], old) + F.when(old == new, 1).otherwise(0)
            n = F.transform(a["n"], lambda c, j: c + F.when(j == cell(new), one(new)).otherwise(F.lit(0)) - F.when(j == cell(old), one(old)).otherwise(F.lit(0)))
            s = a["sum"] + F.get(weight, c_in + 1) - F.get(weight, c_in) + F.when(old.isNotNull(), F.get(weight, c_out - 1) - F.get(weight, c_out)).otherwise(0.0)
            best = F.when(i + 1 >= window, F.greatest(a["best"], F.lit(math.log2(window)) - s / window)).otherwise(a["best"])
            return F.struct(n.alias("n"), s.alias("sum"), best.alias("best"))

        return F.aggregate(upto(F.size(codes)), start, step, lambda a: a["best"])

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(codes, walk)


def _kind_of(candidate: Column) -> Column:
    """The name of the class under which a candidate counts as a secret, or null."""
    allowed = reduce(lambda a, b: a | b, (candidate.rlike(p) for p in ALLOWED))

    def by_class(bits):
        out = None
        for kind, pattern, least in CLASSES:
            hit = F.when(bits >= least, F.lit(kind))
            out = F.when(candidate.rlike(pattern), hit) if out is None else out.when(candidate.rlike(pattern), hit)
        return out

    return F.when(~allowed, let(window_entropy(candidate), by_class))


def _apart(own: Column, base: Column) -> Column:
    """The spans of ``own`` that no span of ``base`` meets. All are put in one order, an own span by its end, before base spans
    that begin there: it is met if one of the base spans before it ends after its start."""
    mine = F.transform(own, lambda x, i: F.struct(x["e"].alias("at"), F.lit(0).alias("base"), x["s"].alias("other"), i.alias("i")))
    theirs = F.transform(base, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("base"), x["e"].alias("other"), F.lit(-1).alias("i")))

    def judged(events):
        ends = F.transform(events, lambda x: F.when(x["base"] == 1, x["other"]).otherwise(F.lit(0)))

        def kept(last):
            free = F.filter(events, lambda x, i: (x["base"] == 0) & (F.get(last, i) <= x["other"]))
            return F.transform(free, lambda x: F.get(own, x["i"]))

        return let(running(ends, lambda a, b: F.greatest(a, b), F.lit(0)), kept)

    return let(F.array_sort(F.concat(mine, theirs)), judged)


def _entropic(text: Column, base: Column) -> Column:
    """Spans of candidates of high entropy that no base span meets."""

    def spans(found):
        def named(kinds):
            placed = _places(text, CANDIDATE, found, lambda i: F.get(kinds, i).isNotNull(), "", 3)
            # _places drops candidates without a kind, so the kinds that are left stand in the same order.
            return let(F.filter(kinds, lambda k: k.isNotNull()), lambda left: F.transform(placed, lambda x, i: x.withField("kind", F.get(left, i))))

        kinds = F.transform(found, _kind_of)
        own = let(kinds, lambda k: F.when(F.exists(k, lambda x: x.isNotNull()), named(k)).otherwise(_none()))
        return F.when((F.size(base) == 0) | (F.size(own) == 0), own).otherwise(let(own, lambda o: _apart(o, base)))

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: F.when(F.size(m) == 0, _none()).otherwise(spans(m)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and more: arrays of spans (s, e: code points, end exclusive; k: rank of the kind; kind)."""
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    t = F.col("t")
    access = F.when(F.contains(t, F.lit("AKIA")), _matched(t, ACCESS, "access", 1)).otherwise(_none())
    base = text.select("doc_id", "t", F.array_sort(F.concat(_assigned(t), access, _matched(t, HEX, "hex", 2))).alias("found"))
    by_start = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    ordered = base.select("doc_id", "t", by_start.alias("base"))
    return ordered.select("doc_id", "base", _entropic(t, F.col("base")).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of a scan, one row per document."""
    line = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    every = F.array_sort(F.concat("base", F.transform("more", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform("base", line), ","), 256).alias("base_sha256"), F.array_join(F.transform(every, line), ",").alias("spans"),
    )
