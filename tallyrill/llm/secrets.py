"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns (``KINDS``), leftmost and non-overlapping for each kind.
The method then tests every run of 20 or more of `[A-Za-z0-9+/_=-]` that no base span touches
and that mixes letters with digits.  Its encoding (hex, base32, alnum of one case or base64) is
inferred from its characters.  Each statistic of a token of n characters has the expected value and
spread that ordinary text written in that encoding has (ORDINARY):

* chi-squared alphabet uniformity, as the collision rate C = sum c(c-1) / n(n-1): an evenly used
  alphabet of k collides at 1/k, ordinary text more often;
* letter use: the mean log ratio of an even use of the encoding's letters to LETTERS;
* runs: changes between lower case, upper case, digits and others for each neighbouring pair;
* serial correlation r of neighbouring positions in the encoding's alphabet, tested against the
  correlation PATTERN of sequences; where |r| sqrt(n) exceeds SERIAL_LIMIT the token drops out.

The first three become z scores against ordinary text, with deviations that shrink as n grows,
and add up (Stouffer, with the correlation of the two on the alphabet) to one p-value.  A token must
be neither ordinary text nor a sequence, so its p-value is the larger of that one and the serial
test's (intersection-union).  Benjamini-Hochberg at ALPHA, separately by length class
(LENGTHS), decides: the corpus-wide ranking is a histogram of at most 4 x 1201 counts, so it
covers all tokens and takes the same space at any size.  The threshold is a bin's lower edge,
so control holds; nothing is sampled.

Only DataFrame functions run; positions come from the gaps between matches, in code points.  Every step is linear in a
text's matches, but for running sums, which are taken in blocks.

Cases: null or empty text has no spans; repeated rows get equal spans (each counts in the
ranking); an empty table gives no rows; any doc_id, null too, is passed through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.workspace import Workspace, require

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern, in the order of the contract.  Longer-than conditions that can't change where
#: matches lie are in the pattern; ``assign`` needs its matches first and their length after.
KINDS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Ordinary text in each encoding: (collision rate, changes for each neighbouring pair).
ORDINARY = {"hex": (0.11, 0.25), "base32": (0.055, 0.12), "alnum": (0.055, 0.12), "base64": (0.046, 0.3)}
#: Letters per thousand, a to z, on average in English, German, French and Spanish; rare ones, which names and numbers favour, count as 10.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (85, 16, 32, 45, 140, 14, 19, 30, 71, 10, 10, 45, 28, 76, 61, 19, 10, 67, 74, 68, 41, 11, 11, 10, 10, 10), strict=True))
#: Correlation of letter use with the collision rate in ordinary text.
SHARED = 0.5
PATTERN, SERIAL_LIMIT, ALPHA = 0.9, 3.5, 0.001
LENGTHS = (20, 28, 40, 64)
#: Elements that one running sum copies, and the character that stands for masked ones.
BLOCK, MARK = 64, "\x01"
BIN, BINS = 0.025, 1200
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def running(values: Column, depth: int = 3) -> Column:
    """Sum of the elements before each one.  Concatenation copies, so sums run within blocks of BLOCK, and over block sums by the same means."""
    start = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    if not depth:
        return F.slice(start(values), 1, F.size(values))
    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(firsts, lambda k: F.slice(values, k, BLOCK))
    before = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)), depth - 1)
    return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(F.slice(start(b), 1, F.size(b)), lambda x: x + s)))


def located(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """array<struct(s, e, kind, body)> of the pattern's matches; ``keep`` is a group number's length condition."""
    p = F.lit(pattern)
    bodies = F.regexp_extract_all(text, p, 0)
    values = F.regexp_extract_all(text, p, 2) if keep is not None else bodies
    matches = F.arrays_zip(bodies.alias("b"), values.alias("v"))
    # how far each gap and its match reach; the last gap has no match
    steps = F.zip_with(F.split(text, pattern, -1), bodies, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
    begin = _let(steps, lambda x: F.zip_with(x, running(F.transform(x, lambda y: y["g"] + y["m"])), lambda y, at: at + y["g"]))
    span = lambda m, s: F.struct(s.alias("s"), (s + F.length(m["b"])).alias("e"), F.lit(kind).alias("kind"), m["b"].alias("body"), m["v"].alias("v"))
    walked = F.filter(F.zip_with(matches, begin, span), lambda x: x["body"].isNotNull())
    spans = F.transform(walked if keep is None else F.filter(walked, lambda x: F.length(x["v"]) >= 12), lambda x: x.dropFields("v"))
    none = F.array().cast("array<struct<s:int,e:int,kind:string,body:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def masked(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """The text with every character of TOKEN's class inside the kept matches replaced by MARK."""
    clean, p = F.translate(text, MARK, "\x02"), F.lit(pattern)
    bodies = F.regexp_extract_all(clean, p, 0)
    marked = lambda b: F.regexp_replace(b, "[A-Za-z0-9+/_=-]", MARK)
    if keep is None:
        bodies = F.transform(bodies, marked)
    else:
        bodies = F.zip_with(bodies, F.regexp_extract_all(clean, p, 2), lambda b, v: F.when(F.length(v) >= 12, marked(b)).otherwise(b))
    return F.array_join(F.flatten(F.zip_with(F.split(clean, pattern, -1), bodies, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not again in every lambda."""
    return F.transform(F.array(value), use)[0]


def _by_encoding(encoding: Column, values: dict) -> Column:
    out = F.lit(values["base64"])
    for name, value in values.items():
        out = F.when(encoding == name, F.lit(value)).otherwise(out)
    return out


def letter_use(alphabet: str) -> tuple[dict[str, float], float, float]:
    """Log ratio of even to ordinary use for each letter of an alphabet, and its mean and deviation in ordinary text."""
    share = {c: LETTERS[c] for c in LETTERS if c in alphabet.lower()}
    total = sum(share.values())
    ratio = {c: math.log(total / (len(share) * v)) for c, v in share.items()}
    mean = sum(v / total * ratio[c] for c, v in share.items())
    return ratio, mean, math.sqrt(sum(v / total * (ratio[c] - mean) ** 2 for c, v in share.items()))


def z_score(token: Column) -> Column:
    """Combined evidence that a token is random rather than ordinary text; null if a pattern shows."""
    encoding = F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(token.rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
    encoding = encoding.when(token.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)=*$"), F.lit("alnum")).otherwise(F.lit("base64"))
    body = F.when(encoding.isin("hex", "alnum"), F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    known = F.struct(F.split(F.regexp_replace(body, "=+$", ""), "").alias("chars"), encoding.alias("encoding"), _by_encoding(encoding, ALPHABETS).alias("alphabet"))
    return _let(known, lambda x: _scored(x["chars"], x["encoding"], x["alphabet"]))


def _scored(chars: Column, encoding: Column, alphabet: Column) -> Column:
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    zero = F.lit(0.0)
    rate = F.aggregate(counts, zero, lambda a, c: a + c * (c - 1)) / (n * (n - 1))
    q = _by_encoding(encoding, {e: v[0] for e, v in ORDINARY.items()})
    spread = F.sqrt(2 * q * (1 - q) / (n * (n - 1)) + 4 * (n - 2) / (n * (n - 1)) * q * q * 0.4)
    z1 = (q - rate) / spread
    used = {e: letter_use(a) for e, a in ALPHABETS.items()}
    letters = F.filter(F.transform(chars, F.lower), lambda c: c.rlike("[a-z]"))
    few = {e: F.create_map(*(F.lit(x) for pair in u[0].items() for x in pair)) for e, u in used.items()}
    ratio = F.when(encoding == "hex", few["hex"]).otherwise(few["base64"])  # the others hold all letters
    m = F.size(letters).cast("double")
    mean, deviation = (_by_encoding(encoding, {e: u[k] for e, u in used.items()}) for k in (1, 2))
    z3 = F.when(m > 0, (F.aggregate(letters, zero, lambda a, c: a + ratio[c]) - m * mean) / (deviation * F.sqrt(m))).otherwise(0.0)
    kinds = F.transform(chars, lambda c: F.when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4))
    pairs = n - 1
    usual = _by_encoding(encoding, {e: v[1] for e, v in ORDINARY.items()})
    changes = F.aggregate(F.zip_with(F.slice(kinds, 2, F.size(chars)), F.slice(kinds, 1, F.size(chars) - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), zero, lambda a, x: a + F.coalesce(x, zero))
    z2 = (changes - pairs * usual) / F.sqrt(pairs * usual * (1 - usual))
    place = F.transform(chars, lambda c: F.call_function("instr", alphabet, c).cast("double"))
    center = F.aggregate(place, zero, lambda a, x: a + x) / n
    r = _let(F.struct(place.alias("p"), center.alias("c")), lambda x: _serial(x["p"], x["c"]))
    pattern = _let(r, lambda x: F.when(F.abs(x) * F.sqrt(n) <= SERIAL_LIMIT, (PATTERN - F.abs(x)) * F.sqrt(n) / math.sqrt(1 - PATTERN**2)))
    ordinary = (z1 + z2 + z3) / math.sqrt(3 + 2 * SHARED)
    return F.when(pattern.isNotNull(), F.least(ordinary, pattern))


def _serial(place: Column, center: Column) -> Column:
    zero = F.lit(0.0)
    off = F.transform(place, lambda x: x - center)
    var = F.aggregate(off, zero, lambda a, x: a + x * x)
    cov = F.aggregate(F.zip_with(F.slice(off, 2, F.size(off)), F.slice(off, 1, F.size(off) - 1), lambda a, b: a * b), zero, lambda a, x: a + F.coalesce(x, zero))
    return F.when(var > 0, cov / var).otherwise(1.0)


def upper_tail(z: float) -> float:
    """P(N(0, 1) > z)."""
    return math.erfc(z / math.sqrt(2)) / 2


def _class(n: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(LENGTHS):
        out = F.when(n >= low, k).otherwise(out)
    return out


def thresholds(candidates: DataFrame) -> dict[int, float]:
    """Smallest accepted z by length class: Benjamini-Hochberg over all candidates (array column ``tokens``)."""
    each = candidates.select(F.explode("tokens").alias("t")).select(_class(F.length("t.body")).alias("c"), F.least(F.greatest(F.floor(F.coalesce("t.z", F.lit(-1.0)) / BIN), F.lit(-1)), F.lit(BINS)).cast("int").alias("bin"))
    counted: dict[int, dict[int, int]] = {}
    for row in each.groupBy("c", "bin").count().collect():  # at most len(LENGTHS) x (BINS + 2) rows
        counted.setdefault(row.c, {})[row.bin] = row["count"]
    out = {}
    for c, bins in counted.items():
        total, above, best = sum(bins.values()), 0, None
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            above += bins[b]
            if total * upper_tail(b * BIN) <= ALPHA * above:
                best = b * BIN
        if best is not None:
            out[c] = best
    return out


def scan(df: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): base spans by start, and scored tokens that touch none of them."""
    docs = require(df, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    parts = docs.select("doc_id", "text", *(located(F.col("text"), p, k, F.lit(12) if k == "assign" else None).alias(k) for k, p in KINDS.items()))
    order = {k: i for i, k in enumerate(KINDS)}
    tagged = F.transform(F.concat(*KINDS), lambda x: F.struct(x["s"].alias("s"), F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).otherwise(len(order) - 1).alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    # a base span touches a token if it masks a character of it; masking moves no token's ends
    seen = [F.when(F.size(k) > 0, F.regexp_extract_all(masked(F.col("text"), p, F.lit(12) if k == "assign" else None), F.lit(TOKEN.replace("=-]", f"={MARK}-]")), 0)).alias(k) for k, p in KINDS.items()]
    based = parts.select("doc_id", *KINDS, F.array_sort(tagged).alias("base"), located(F.col("text"), TOKEN, "random").alias("runs"), *(c.alias(f"{k}_masked") for k, c in zip(KINDS, seen, strict=True)))
    zipped = F.arrays_zip("runs", *(F.coalesce(f"{k}_masked", F.array().cast("array<string>")).alias(k) for k in KINDS))
    untouched = lambda x: x["runs"]["body"].rlike("[0-9]") & x["runs"]["body"].rlike("[A-Za-z]") & ~F.greatest(*(F.coalesce(F.contains(x[k], F.lit(MARK)), F.lit(False)) for k in KINDS))
    free = F.transform(F.filter(zipped, untouched), lambda x: x["runs"])
    free = based.select("doc_id", *KINDS, "base", free.alias("free"))
    return free.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), "base", F.transform("free", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["body"].alias("body"), z_score(x["body"]).alias("z"))).alias("tokens"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(df: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): base and all spans, as arrays of (s, o, e, kind)."""
    ws = Workspace(df.sparkSession, "secrets")
    scanned = ws.table(scan(df), "scanned")
    limits = thresholds(scanned)

    def good(x):
        limit = F.lit(None).cast("double")
        for c, z in limits.items():
            limit = F.when(_class(F.length(x["body"])) == c, F.lit(z)).otherwise(limit)
        return F.coalesce(x["z"] >= limit, F.lit(False))

    added = F.transform(F.filter("tokens", good), lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), x["e"].alias("e"), F.lit("random").alias("kind")))
    return scanned.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.array_sort(F.concat("base", added)).alias("spans"))
