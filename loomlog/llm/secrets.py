"""Secrets in text: fixed patterns, and a battery of randomness tests. DataFrame functions only.

The fixed patterns give the base spans. Beside them, every other long run of token characters is a candidate: its encoding
is inferred from its characters, and three tests ask whether its symbols could be random over that encoding's alphabet:
chi-squared uniformity, runs above and below the middle of the alphabet, and lag-one serial correlation. A candidate's
p-value is three times the smallest of the three. Rejections ("not random") are controlled for false discoveries by the
Benjamini-Hochberg step-up within each class of lengths, over the candidates of all documents: of the strings discarded as
no secrets, at most a share of alpha are expected to be random ones. What is not rejected is reported. So the control is
on secrets lost; how many reported strings are none has no such bound, and only the demands on a candidate keep it low
(its length, at least `least_bits` bits, and a digit where an alphabet has letters of one case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 characters
# A whole run of the alphabet of URLs or else of base64, or what of the former precedes other characters; runs of more than
# 4,096 characters are taken in stretches of so many.
CANDIDATE = r"[A-Za-z0-9_-]{20,4096}+(?![+/])|[A-Za-z0-9+/]{20,4096}+={0,2}|[A-Za-z0-9_-]{20,4096}+"
# Texts without a run of 20 candidate characters, which one look at each run's beginning tells, are searched no further.
GATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
MASK = "\u0001"  # stands for the characters of base spans where candidates are looked for
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32low": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# Lower ends of the length classes.
CLASSES = (20, 24, 32, 40, 64, 128)
GRID = 60  # p-values are told apart down to exp(-GRID / 2), in steps of half a natural log


def let(value: Column, then) -> Column:
    """then(value) with value computed once: inside a lambda, Spark would compute a repeated expression each time."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, block: int = 512) -> Column:
    """Sums of an array of numbers up to and with each place. An array that grows by one element is copied each time, so
    sums are taken in blocks, then over the blocks: a million values cost some 10^8 copied elements, not 10^12."""
    none = F.array().cast("array<bigint>")

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def blocks(whole: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / block).cast("int"))
        return F.transform(places, lambda i: sums(F.slice(whole, i * block + 1, F.lit(block))))

    def shifted(within: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), sums(F.transform(within, lambda w: F.element_at(w, -1))))
        return F.flatten(F.zip_with(within, F.slice(before, F.lit(1), F.size(within)), lambda w, o: F.transform(w, lambda v: v + o)))

    return let(values, lambda whole: F.when(F.size(whole) > block, let(blocks(whole), shifted)).otherwise(sums(whole)))


def spans(text: Column, pattern: str, kind: str, at_least: int = 0, group: int = 0) -> Column:
    """array<start, end, rank, kind, found> of the matches, leftmost first and not overlapping; matches whose `group` is
    shorter than at_least are dropped. Places follow from the lengths of the matches and of what lies between."""
    rank = KINDS.index(kind)
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    counted = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,found:string>>")
    rows = F.zip_with(found, counted, lambda a, b: F.struct(a.alias("found"), (F.length(b) >= at_least).alias("ok")))
    rows = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), rows, lambda g, r: F.struct(F.length(g).alias("gap"), r["found"].alias("found"), r["ok"].alias("ok")))

    def placed(matches: Column) -> Column:
        ends = running(F.transform(matches, lambda x: (x["gap"] + F.length(x["found"])).cast("bigint")))
        span = lambda x, end: F.struct((end - F.length(x["found"])).cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["found"].alias("found"), x["ok"].alias("ok"))
        kept = F.filter(F.zip_with(matches, ends, span), lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "rank", "kind", "found")]))

    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(empty)


def masked(text: Column, pattern: str, at_least: int = 0, group: int = 0) -> Column:
    """text with the characters of the matches that count (see spans) replaced by MASK, so that places stay."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    blank = lambda f: F.repeat(F.lit(MASK), F.length(f))
    if group:
        counted = F.regexp_extract_all(text, p, F.lit(group))
        blanks = F.zip_with(found, counted, lambda f, c: F.when(F.length(c) >= at_least, blank(f)).otherwise(f))
    else:
        blanks = F.transform(found, blank)
    whole = let(F.split(text, pattern, -1), lambda gaps: F.array_join(F.zip_with(gaps, blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), ""))
    return F.when(text.rlike(pattern), whole).otherwise(text)


def without_base(text: Column) -> Column:
    """text with its base spans masked. A run that ends in a masked key (as "api" may end one) is as long as it was."""
    assigned = masked(text, ASSIGN, 6, 2)
    return let(assigned, lambda t: masked(t, f"AKIA[A-Z0-9]{{13,}}+(?={MASK})|AKIA[A-Z0-9]{{16,}}+|[0-9a-f]{{23}}+(?={MASK})|{HEX}"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to seven digits (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def upper_tail(z: Column) -> Column:
    return F.when(z >= 0, normal_tail(F.abs(z))).otherwise(1 - normal_tail(F.abs(z)))


def encoding(s: Column) -> Column:
    """The smallest alphabet that holds all characters; null where none does. One with letters of one case only is taken
    for strings with a digit and a letter, as words have its letters too."""
    bare = F.rtrim(s, F.lit("="))
    mixed = lambda pattern: bare.rlike(pattern) & bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    out = F.when(bare.rlike("^[0-9a-f]+$"), "hex").when(bare.rlike("^[0-9A-F]+$"), "HEX")
    out = out.when(mixed("^[A-Z2-7]+$"), "base32").when(mixed("^[a-z2-7]+$"), "base32low").when(mixed("^[a-z0-9]+$"), "base36").when(bare.rlike("^[A-Za-z0-9]+$"), "base62")
    return out.when(bare.rlike("^[A-Za-z0-9+/]+$"), "base64").when(bare.rlike("^[A-Za-z0-9_-]+$"), "base64url")


def battery(s: Column) -> Column:
    """struct<encoding, n, p_chi2, p_runs, p_serial, p> of a candidate; p is null where no encoding fits."""
    names = F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, v)])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def first(x: Column) -> Column:
        """Symbols as numbers, and how often each of the alphabet occurs."""
        bare, alphabet = x["bare"], x["alphabet"]
        symbols = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        counts = F.transform(F.filter(F.split(alphabet, ""), lambda c: c != ""), lambda c: F.length(bare) - F.length(F.replace(bare, c, F.lit(""))))
        return F.struct(
            x["kind"].alias("kind"),
            F.length(bare).cast("double").alias("n"),
            F.length(alphabet).cast("double").alias("size"),
            symbols.alias("symbols"),
            total(F.transform(counts, lambda k: k.cast("double") * k.cast("double"))).alias("squares"),
        )

    def second(x: Column) -> Column:
        middle, n = x["size"] / 2, x["n"]
        bits = F.transform(x["symbols"], lambda v: (v >= middle).cast("double"))
        df = x["size"] - 1
        chi2 = F.greatest(x["size"] / n * x["squares"] - n, F.lit(0.0))
        return F.struct(x["kind"].alias("kind"), n.alias("n"), x["symbols"].alias("symbols"), bits.alias("bits"), (chi2 / df).alias("ratio"), (2 / (9 * df)).alias("w"), (total(x["symbols"]) / n).alias("average"))

    def third(x: Column) -> Column:
        average, rest = x["average"], F.size(x["symbols"]) - 1
        pairs = lambda values, f: total(F.zip_with(F.slice(values, F.lit(1), rest), F.slice(values, F.lit(2), rest), f))
        spread = total(F.transform(x["symbols"], lambda v: (v - average) * (v - average)))
        return F.struct(
            x["kind"].alias("kind"),
            x["n"].alias("n"),
            total(x["bits"]).alias("n1"),
            (1 + pairs(x["bits"], lambda a, b: F.abs(a - b))).alias("runs"),
            spread.alias("spread"),
            pairs(x["symbols"], lambda a, b: (a - average) * (b - average)).alias("together"),
            ((F.pow(x["ratio"], F.lit(1 / 3)) - (1 - x["w"])) / F.sqrt(x["w"])).alias("z_chi2"),
        )

    def fourth(x: Column) -> Column:
        n, n1 = x["n"], x["n1"]
        mean = 2 * n1 * (n - n1) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.struct(
            x["kind"].alias("kind"),
            n.alias("n"),
            x["z_chi2"].alias("z_chi2"),
            F.when(var > 0, F.abs(x["runs"] - mean) / F.sqrt(var)).alias("z_runs"),
            F.when(x["spread"] > 0, F.abs(x["together"] / x["spread"] + 1 / n) * F.sqrt(n)).alias("z_serial"),
        )

    def fifth(x: Column) -> Column:
        two_sided = lambda z: F.least(F.lit(1.0), 2 * upper_tail(z))
        # One symbol throughout, or all on one side of the middle: as unlikely as that many equal tosses of a coin.
        p_runs = F.when(x["z_runs"].isNotNull(), two_sided(x["z_runs"])).otherwise(F.pow(F.lit(0.5), x["n"] - 1))
        p_serial = F.when(x["z_serial"].isNotNull(), two_sided(x["z_serial"])).otherwise(F.lit(0.0))
        return F.struct(x["kind"].alias("encoding"), x["n"].cast("int").alias("n"), upper_tail(x["z_chi2"]).alias("p_chi2"), p_runs.alias("p_runs"), p_serial.alias("p_serial"))

    def last(x: Column) -> Column:
        p = F.least(F.lit(1.0), 3 * F.least(x["p_chi2"], x["p_runs"], x["p_serial"]))
        return F.struct(*[x[c].alias(c) for c in ("encoding", "n", "p_chi2", "p_runs", "p_serial")], F.when(x["encoding"].isNotNull(), p).alias("p"))

    kind = encoding(s)
    out = F.struct(kind.alias("kind"), F.rtrim(s, F.lit("=")).alias("bare"), F.element_at(names, kind).alias("alphabet"))
    for step in (first, second, third, fourth, fifth, last):
        out = let(out, step)
    return out


def length_class(n: Column) -> Column:
    out = F.lit(None).cast("int")
    for low in CLASSES:
        out = F.when(n >= low, F.lit(low)).otherwise(out)
    return out


def thresholds(candidates: DataFrame, alpha: float) -> dict[int, float]:
    """Benjamini-Hochberg cut of each length class, from a histogram of p-values: what comes to the driver are at most
    len(CLASSES) * (GRID + 1) counts, whatever the input."""
    cell = F.least(F.lit(GRID), F.greatest(F.lit(0), F.floor(-2 * F.log(F.greatest("p", F.lit(1e-30)))))).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for low, c, n in candidates.where("p is not null").groupBy(length_class(F.col("n")).alias("class"), cell.alias("cell")).count().collect():
        counts.setdefault(low, {})[c] = n
    cuts = {}
    for low, cells in counts.items():
        total, below, cuts[low] = sum(cells.values()), 0, 0.0
        for c in range(GRID, -1, -1):  # cell c holds p-values up to exp(-c / 2)
            below += cells.get(c, 0)
            edge = 2.718281828459045 ** (-c / 2)
            if below and total * edge / below <= alpha:
                cuts[low] = edge
    return cuts


def scan(docs: DataFrame, alpha: float = 0.01, least_bits: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, counts of the base kinds, base_sha256, spans (text) and found (array of spans).

    Ends are exclusive and count code points. Null counts as empty; documents without spans have counts 0, empty spans
    and the digest of the empty text. Candidates are looked for outside of the base spans; one of fewer than
    least_bits bits (symbols times bits a symbol) is left out, as too few symbols are there to test; a run of more than 4,096
    candidate characters is tested in stretches of that many. Texts of any length are searched whole; the cost grows
    little more than in proportion to a text's length and matches. Rows may repeat; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    t = F.col("text")
    rest = F.when(t.rlike(GATE), without_base(t)).otherwise(F.lit(""))
    tested = F.transform(F.regexp_extract_all("rest", F.lit(CANDIDATE), F.lit(0)), battery)
    candidates = rows.where(t.rlike(GATE)).select(without_base(t).alias("rest")).where(F.col("rest").rlike(CANDIDATE))
    cuts = thresholds(candidates.select(F.explode(tested).alias("t")).select("t.n", "t.p"), alpha)
    base = F.sort_array(F.concat(spans(t, ASSIGN, "assign", 6, 2), spans(t, ACCESS, "access", 20), spans(t, HEX, "hex")))
    rows = rows.select("doc_id", base.alias("base"), let(rest, lambda r: spans(r, CANDIDATE, "random")).alias("candidates"))

    def random(c: Column) -> Column:
        def decide(test: Column) -> Column:
            limit = F.lit(1.0)
            for low, edge in sorted(cuts.items()):
                limit = F.when(test["n"] >= low, F.lit(edge)).otherwise(limit)
            bits = F.when(test["encoding"].isin("hex", "HEX"), 4).when(test["encoding"].startswith("base3"), 5).otherwise(6) * test["n"]
            return F.coalesce((test["p"] > limit) & (bits >= least_bits), F.lit(False))

        return let(battery(c["found"]), decide)

    rows = rows.withColumn("found", F.when(F.size("candidates") > 0, F.sort_array(F.concat("base", F.filter("candidates", random)))).otherwise(F.col("base")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )
