"""Secrets in text: patterns, and a battery of randomness tests under false-discovery control.

DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the patterns asked for, in the order of their kinds, and the least lengths of their matches
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
_ACCESS = r"(AKIA[A-Z0-9]+)"
_HEX = r"([0-9a-f]+)"
LEAST = {"assign": 12, "access": 18, "hex": 16}
_SIEVE = {
    "assign": r"(?i:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "random": r"[A-Za-z0-9+/_=-]{20}",
}
_RANDOM = r"([A-Za-z0-9+/_=-]+)"
LEAST_RANDOM = 20
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# encodings tried in this order: the characters a token may have, what it must have one of, its alphabet
ENCODINGS = (
    ("hex", r"[0-9a-f]+", ("[0-9]", "[a-f]"), _DIGITS + "abcdef"),
    ("HEX", r"[0-9A-F]+", ("[0-9]", "[A-F]"), _DIGITS + "ABCDEF"),
    ("base32", r"[A-Z2-7]+=*", ("[2-7]", "[A-Z]"), _UPPER + "234567"),
    ("base36", r"[A-Z0-9]+", ("[0-9]", "[A-Z]"), _DIGITS + _UPPER),
    ("base36lower", r"[a-z0-9]+", ("[0-9]", "[a-z]"), _DIGITS + _LOWER),
    ("base62", r"[A-Za-z0-9]+", ("[0-9]", "[a-z]", "[A-Z]"), _DIGITS + _UPPER + _LOWER),
    ("base64", r"[A-Za-z0-9+/]+=*", ("[0-9]", "[a-z]", "[A-Z]"), _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"[A-Za-z0-9_-]+=*", ("[0-9]", "[a-z]", "[A-Z]"), _UPPER + _LOWER + _DIGITS + "-_"),
)
FALSE_DISCOVERIES = 0.05
BINS = 400
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _spans(text: Column, kind: str, pattern: str, value: int, least: int) -> Column:
    """Leftmost non-overlapping matches with their places; those with a shorter ``value`` group are dropped.

    ``\\G`` ties every match to the end of the one before, so that the gaps and the
    matches together are the text, their lengths give the places, and a text is read once.
    """
    whole = rf"(?s)\G(.*?)({pattern})"
    parts = [F.regexp_extract_all(text, F.lit(whole), F.lit(g)) for g in dict.fromkeys((1, 2, value))]
    names = ("gap", "hit", "value") if value != 2 else ("gap", "hit")
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names)])
    number = KINDS.index(kind)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(_SPAN).alias("found"))

    def step(state: Column, part: Column) -> Column:
        gap, hit, val = part[names[0]], part[names[1]], part[names[-1]]
        begin = state["at"] + F.length(gap)
        end = begin + F.length(hit)
        span = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"), val.alias("value")))
        kept = F.coalesce(state["found"], F.array().cast(_SPAN))
        return F.struct(end.alias("at"), F.when(F.length(val) >= least, F.concat(kept, span)).otherwise(kept).cast(_SPAN).alias("found"))

    found = F.aggregate(zipped, start, step)["found"]
    return F.when(text.rlike(_SIEVE[kind]), F.coalesce(found, F.array().cast(_SPAN))).otherwise(F.array().cast(_SPAN))


def _above(z: Column) -> Column:
    """The upper tail of the normal distribution, by the usual five-term approximation."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _symbols(token: Column, alphabet: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))


def _total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def _tests(v: Column, size: Column) -> Column:
    """Three times the smallest p-value of three tests over the symbols ``v`` of an alphabet, at most 1."""
    n = F.size(v).cast("double")
    free = size - 1
    squares = F.aggregate(
        F.sequence(F.lit(0), size.cast("int") - 1), F.lit(0.0), lambda s, k: s + F.pow(F.size(F.filter(v, lambda x: x == k)), F.lit(2))
    )
    chi = F.greatest(size / n * squares - n, F.lit(0.0))
    z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    bits = F.array_join(F.transform(v, lambda x: F.when(x >= size / 2, "1").otherwise("0")), "")

    def runs(b: Column) -> Column:
        high = F.length(F.replace(b, F.lit("0"), F.lit(""))).cast("double")
        both = 2 * high * (n - high)
        spread = F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9))
        z = (F.length(F.regexp_replace(b, "0+|1+", "r")) - (both / n + 1)) / F.sqrt(spread)
        return F.when((high == 0) | (high == n), F.lit(0.0)).otherwise(2 * _above(F.abs(z)))

    def serial(mean: Column) -> Column:
        count = F.size(v)
        pairs = F.zip_with(F.slice(v, F.lit(1), count - 1), F.slice(v, F.lit(2), count - 1), lambda x, y: (x - mean) * (y - mean))
        spread = _total(v, lambda x: (x - mean) * (x - mean))
        return F.when(spread == 0, F.lit(0.0)).otherwise(2 * _above(F.abs((_total(pairs) / spread + 1 / n) * F.sqrt(n))))

    return F.least(F.lit(1.0), 3 * F.least(_above(z_chi), _let(bits, runs), _let(_total(v) / n, serial)))


def randomness(token: Column) -> Column:
    """``(encoding, length, p)`` of a token; null where no encoding fits.

    ``p`` is the probability of at least so unlikely a token among random ones of its
    encoding: chi-squared for equal use of the alphabet (Wilson and Hilferty), runs above
    and below the alphabet's middle, and lag-one serial correlation, each over the
    symbols without padding.
    """

    def of(e: Column) -> Column:
        body = F.regexp_replace(token, "=+$", "")
        p = _let(_symbols(body, e["alphabet"]), lambda v: _tests(v, F.length(e["alphabet"]).cast("double")))
        return F.when(e["name"].isNotNull() & (F.length(body) >= 3), F.struct(e["name"].alias("encoding"), F.length(body).alias("length"), p.alias("p")))

    fits = [
        F.when(
            token.rlike(f"^(?:{allowed})$") & reduce(lambda a, b: a & b, [token.rlike(m) for m in musts]),
            F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet")),
        )
        for name, allowed, musts, alphabet in ENCODINGS
    ]
    nothing = F.struct(F.lit(None).cast("string").alias("name"), F.lit("01").alias("alphabet"))
    return _let(F.coalesce(*fits, nothing), of)


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-60))))).cast("int")


def _stratum(length: Column) -> Column:
    """Lengths that double from one stratum to the next: longer tokens carry more evidence and are held to their own."""
    return F.least(F.lit(16), F.floor(F.log2(length.cast("double")))).cast("int")


def rejected_from(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For every stratum of lengths the least bin of p-values that is rejected as not random.

    ``tested`` has ``length`` and ``p``. Benjamini and Hochberg's step-up rule in every
    stratum: of the tokens put aside as not random, at most the share ``rate`` is expected
    to be random after all. P-values are rounded up to tenths of a power of ten, so what
    is sorted is a count per stratum and bin: at most 16 x 401 rows, whatever the number
    of tokens.
    """
    counts = tested.groupBy(_stratum(F.col("length")).alias("s"), _bin(F.col("p")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, dict[int, int]] = {}
    for s, b, n in counts.collect():
        by.setdefault(s, {})[b] = n
    out = {}
    for s, bins in by.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / 10) <= seen * rate / total:
                out[s] = b
    return out


def find_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of ``(start, kind, end)`` by start, then kind.

    Kinds 0 to 2 are the patterns; kind 3 is a token of 20 or more characters that touches
    none of those, fits an encoding, and is not rejected as random by the tests. Places
    count code points, the end is exclusive. Null and empty texts have no spans. All rows
    and other columns stay; repeated rows count each, also in the false-discovery rule.
    A column named ``spans`` is replaced. Texts are read twice, once for the rule's
    bounds and once for the result, and nothing but counts is ever shuffled.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    base = F.concat(*[_spans(text, k, p, v, LEAST[k]) for k, p, v in (("assign", _ASSIGN, 4), ("access", _ACCESS, 2), ("hex", _HEX, 2))])

    def free(tokens: Column, found: Column) -> Column:
        return F.filter(tokens, lambda t: ~F.exists(found, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def tried(tokens: Column) -> Column:
        out = F.transform(tokens, lambda t: F.struct(t["start"], t["kind"], t["end"], randomness(t["value"]).alias("test")))
        return F.filter(out, lambda t: t["test"].isNotNull())

    tokens = F.when(
        text.rlike(_SIEVE["random"]), tried(free(_spans(text, "random", _RANDOM, 2, LEAST_RANDOM), base))
    )
    tested = docs.where(text.rlike(_SIEVE["random"])).select(F.explode(tokens).alias("t")).select("t.test.length", "t.test.p")
    bounds = rejected_from(tested)

    def random(t: Column) -> Column:
        stratum = _stratum(t["test"]["length"])
        least = F.coalesce(*[F.when(stratum == s, F.lit(b)) for s, b in sorted(bounds.items())], F.lit(BINS + 1))
        return _bin(t["test"]["p"]) < least

    def places(found: Column) -> Column:
        return F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    extra = F.coalesce(places(F.filter(tokens, random)), none)
    return docs.select(*kept, F.array_sort(F.concat(places(base), extra)).alias("spans"))


def listed(spans: Column, kinds: int = len(KINDS)) -> Column:
    """``kind:start:end`` of the spans of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with its spans, overlapping ones as one, replaced by ``mask``; null stays null."""
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        # what lies between the spans so far and this one; a span that begins inside an earlier one only moves the end
        gap = F.substring(text, state["at"].cast("int"), F.greatest(F.lit(0), s["start"] + 1 - state["at"]).cast("int"))
        new = F.when(s["start"] + 1 >= state["at"], F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"] + 1).alias("at"), new.alias("out"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
