"""Secret scan with DataFrame functions only.

Fixed patterns give the base spans. Beside them, candidate strings (runs of
base64 or hex characters) are measured by the Shannon entropy of a sliding
window, for each character class with its own alphabet, windows and thresholds.
The window's symbol counts, five bits each in a few integers, and the sum of
``c * log2(c)`` over them are carried along and changed for the character that
enters and the one that leaves. An allow-list (identifiers, numbers, alphabets)
suppresses candidates, and a placeholder word the part of a candidate between
separators that holds it; candidates inside a base span are reported already.

Positions are code points, ends exclusive. They are running sums of the lengths
of the matches and of what lies between them, by doubling, so the work grows
with the text and with n * log(n) for n matches. Long candidates are measured
in overlapping pieces. No pattern repeats a group, which Java's matcher would
answer with its stack.

Edge cases: a null text is empty; no span gives an empty string, whose digest
is that of the empty string; a text of any length, with any number of secrets
or one run of any length, is scanned whole; repeated rows are scanned one by
one, and of equal spans of two classes one is given; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of their ranks.
KINDS = ("assign", "access", "hex", "entropy")

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_SECRET = 8

#: Candidates by class: pattern, alphabet, and (window, least bits): the longest window that a candidate fills counts.
CLASSES = {
    "base64": (r"[A-Za-z0-9+/_=-]{16,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", ((24, 3.9), (16, 3.6))),
    "hex": (r"[0-9A-Fa-f]{24,}", "0123456789abcdefABCDEF", ((24, 3.1),)),
}

#: Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[A-Za-z_=/+-]+$",
    r"^[0-9_=/+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z][A-Za-z/_-]*[0-9]{1,4}$",
)

#: The part of a candidate that holds one of these is no secret.
PLACEHOLDER = r"(?i:example|placeholder|changeme|xxxx|yourkey|dummy|sample|abcdefghijkl|0123456789)"

#: Candidates are measured, and texts cut, in pieces of so many characters.
PIECE = 4096

#: The longest window: five bits hold its counts.
MOST_WINDOW = 31

_SPAN = "array<struct<start:int,rank:int,end:int>>"
_NO_SPANS = f"cast(array() as {_SPAN})"
_PER_COUNTER = 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``values`` combined from the first to each, by doubling the reach of every element."""

    def scan(given: Column) -> Column:
        widths = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda w: w < F.size(given))
        return F.aggregate(widths, given, lambda acc, w: F.transform(acc, lambda x, i: F.when(i >= w, combine(F.get(acc, i - w), x)).otherwise(x)))

    return _let(values, scan)


def _matches(text: Column, found: Column, pattern: str) -> Column:
    """(start, end, inner) of ``found``, all matches of ``pattern`` in ``text``."""
    sizes = F.struct(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"), F.transform(found, lambda m: F.length(m)).alias("sizes"))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x["sizes"], lambda n, i: n + F.get(x["gaps"], i)), lambda a, b: a + b)
        return F.transform(ends, lambda end, i: F.struct((end - F.get(x["sizes"], i)).alias("start"), end.alias("end"), F.get(found, i).alias("inner")))

    return _let(sizes, placed)


def _spans(text: Column, pattern: str, kind: str, test: Callable[[Column], Column]) -> Column:
    """The spans of ``pattern`` whose string passes ``test``."""

    def placed(found: Column) -> Column:
        def kept(passed: Column) -> Column:
            spans = F.filter(_matches(text, found, pattern), lambda m, i: F.get(passed, i))
            ranked = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))
            return F.when(F.exists(passed, lambda p: p), ranked).otherwise(F.expr(_NO_SPANS))

        return _let(F.transform(found, test), kept)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def most_entropy(candidate: Column, alphabet: str, window: int | Column) -> Column:
    """The largest entropy, in bits, of ``window`` consecutive characters of a candidate; ``window``: MOST_WINDOW at most."""
    window = F.lit(window) if isinstance(window, int) else window
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(MOST_WINDOW + 2)])
    symbols = F.transform(F.split(candidate, ""), lambda ch: F.call_function("instr", F.lit(alphabet), ch) - 1)
    counters = -(-len(alphabet) // _PER_COUNTER)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), counters).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("seen"))
    counter = lambda s: (s / _PER_COUNTER).cast("int")
    unit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s % _PER_COUNTER * 5)
    held = lambda counts, s: F.call_function("shiftright", F.get(counts, counter(s)), s % _PER_COUNTER * 5).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def measure(chars: Column) -> Column:
        def step(acc, new):
            old = F.when(acc["seen"] >= window, F.get(chars, acc["seen"] - window)).otherwise(F.lit(-1))
            up, down = held(acc["counts"], new), held(acc["counts"], F.greatest(old, F.lit(0)))
            gain = F.get(weight, up + 1) - F.get(weight, up)
            loss = F.when(old >= 0, F.get(weight, down) - F.get(weight, down - 1)).otherwise(F.lit(0.0))
            zero = F.lit(0).cast("long")
            moved = F.transform(acc["counts"], lambda c, k: c + F.when(k == counter(new), unit(new)).otherwise(zero) - F.when((old >= 0) & (k == counter(old)), unit(old)).otherwise(zero))
            total = F.when(new == old, acc["sum"]).otherwise(acc["sum"] + gain - loss)
            bits = F.log2(window) - total / window
            best = F.when(acc["seen"] + 1 >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"])
            return F.struct(F.when(new == old, acc["counts"]).otherwise(moved).alias("counts"), total.alias("sum"), best.alias("best"), (acc["seen"] + 1).alias("seen"))

        return F.aggregate(chars, start, step)["best"]

    return _let(symbols, measure)


def _strong(run: Column, alphabet: str, windows: tuple) -> Column:
    """Whether a run reaches the bits of the longest window that it fills. Pieces overlap, so that each window is in one."""
    window, least = F.lit(MOST_WINDOW), F.lit(100.0)
    for size, bits in sorted(windows):
        window, least = F.when(F.length(run) >= size, F.lit(size)).otherwise(window), F.when(F.length(run) >= size, F.lit(bits)).otherwise(least)
    pieces = F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{1,{PIECE + MOST_WINDOW}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.exists(pieces, lambda p: most_entropy(p, alphabet, window) >= least)


def _suspect(candidate: Column, alphabet: str, windows: tuple) -> Column:
    """Whether a candidate, without the parts that hold a placeholder, has a window of much entropy."""
    plain = F.lit(False)
    for pattern in ALLOWED:
        plain = plain | candidate.rlike(pattern)
    parts = F.transform(F.regexp_extract_all(candidate, F.lit(r"[^/_=-]*[/_=-]*"), F.lit(0)), lambda p: F.when(p.rlike(PLACEHOLDER), F.lit(" ")).otherwise(p))
    runs = F.when(candidate.rlike(PLACEHOLDER), F.split(F.array_join(parts, ""), " ")).otherwise(F.array(candidate))
    return F.when(plain, F.lit(False)).otherwise(F.exists(runs, lambda run: _strong(run, alphabet, windows)))


def _beyond(spans: Column, base: Column) -> Column:
    """The spans that no base span holds. Base spans come first where both begin at one place."""
    order = lambda which: lambda s: F.struct(s["start"].alias("start"), F.lit(which).alias("own"), s["end"].alias("end"), s["rank"].alias("rank"))

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b))
        new = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("reach"))), lambda x: (x["e"]["own"] == 1) & (x["reach"] < x["e"]["end"]))
        return F.transform(new, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["rank"].alias("rank"), x["e"]["end"].alias("end")))

    merged = F.sort_array(F.concat(F.transform(base, order(0)), F.transform(spans, order(1))))
    return F.when(F.size(spans) > 0, _let(merged, free)).otherwise(spans)


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``spans``, sorted arrays of (start, rank of the kind, end)."""
    out = docs.withColumn("scan_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("scan_text")
    whole = lambda m: F.lit(True)
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_SECRET
    base = F.concat(_spans(text, ASSIGN, "assign", long_enough), _spans(text, ACCESS, "access", whole), _spans(text, HEX, "hex", whole))
    out = out.withColumn("base", F.sort_array(base))
    suspect = lambda alphabet, windows: lambda m: _suspect(m, alphabet, windows)
    more = [_spans(text, pattern, "entropy", suspect(alphabet, windows)) for pattern, alphabet, windows in CLASSES.values()]
    out = out.withColumn("scan_more", F.sort_array(F.concat(*more)))
    once = F.filter("scan_more", lambda s, i: (i == 0) | (F.get(F.col("scan_more"), i - 1) != s))
    out = out.withColumn("scan_new", _beyond(once, F.col("base")))
    return out.withColumn("spans", F.sort_array(F.concat("base", "scan_new")))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, and all spans."""
    found = with_spans(docs.select(F.col("doc_id").cast("long"), "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _between(blocks: Column, first: Column, last: Column) -> Column:
    """Characters [first, last) of a text in blocks of PIECE characters."""
    block = (first / PIECE).cast("int")
    held = F.slice(blocks, block + 1, F.ceil(last / PIECE).cast("int") - block)

    def part(x: Column, k: Column) -> Column:
        at = (block + k) * PIECE
        return F.when((first <= at) & (last >= at + PIECE), x).otherwise(F.substring(x, F.greatest(first - at, F.lit(0)) + 1, last - F.greatest(first, at)))

    return F.when(last > first, F.array_join(F.transform(held, part), "")).otherwise(F.lit(""))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one. Other texts stay as they are."""
    columns = docs.columns
    held = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))  # other columns can't clash
    found = with_spans(held).withColumn("reach", running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b)))
    starts = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), i.alias("i")))
    before = lambda i: F.when(i > 0, F.get(F.col("reach"), i - 1)).otherwise(F.lit(0))
    found = found.withColumn("cuts", F.filter(starts, lambda s: (s["i"] == 0) | (s["start"] >= before(s["i"]))))
    found = found.withColumn("blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("scan_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    kept = F.transform("cuts", lambda s: _between(F.col("blocks"), before(s["i"]), s["start"]))
    rest = _between(F.col("blocks"), F.element_at("reach", -1), F.length("scan_text"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(mark))), ""), rest)).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])
