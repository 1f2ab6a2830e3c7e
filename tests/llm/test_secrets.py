import hashlib
import math
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from loomlog.llm.secrets import battery, running, scan, thresholds

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?ai:", "(?i:"), re.ASCII)
PARTS = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", "=", ":", "AKIA", "ABCDEF1234567890", "0123456789abcdef", "é", "😀", "x", "abcdefgh", "-", "_", "token=token:abcdefg", "\n", "passwd = ", "deadbeef" * 3]


def brute(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in out)
    return (*(sum(o[3] == k for o in out) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()), joined


def test_base_spans_equal_brute_force(spark, rng, odd_docs, no_docs):
    texts = ["", 'token = "abc" token=secret=abcdefgh', *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan(docs).collect():
        counts, joined = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == counts
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]
    odd = scan(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r.n_assign == 0 for r in odd) and scan(no_docs).count() == 0


def test_battery_tells_random_strings_from_words(spark, rng):
    base64 = string.ascii_letters + string.digits + "+/"
    draw = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    random_ = [draw(64, base64) for _ in range(40)] + [draw(40, "0123456789abcdef") for _ in range(40)]
    words = ["theheingtionouredentheheingtionoured" + w for w in ("andofthe", "ingwasnot", "shallbeseen")] + ["a" * 40, "ab" * 30, "0" * 40, "0123456789abcdef" * 3]
    df = spark.createDataFrame([(s, k) for s in random_ for k in [1]] + [(s, 0) for s in words], "s string, r int").select("r", battery(F.col("s"))["p"].alias("p"))
    rows = df.collect()
    assert sum(r.p > 0.01 for r in rows if r.r) >= 0.9 * len(random_) and all(r.p < 0.01 for r in rows if not r.r)
    docs = spark.createDataFrame([(k, f"see {s} end") for k, s in enumerate(random_ + words)], "doc_id long, text string")
    rows = scan(docs).collect()
    found, by_tests = {r.doc_id for r in rows if r.spans}, {r.doc_id for r in rows if "random" in r.spans}
    assert len([k for k in found if k < len(random_)]) >= 0.9 * len(random_) and by_tests and max(by_tests) < len(random_)


def plain_battery(s):
    """The three statistics, the plain way."""
    alphabets = {"hex": "0123456789abcdef", "base62": string.ascii_uppercase + string.ascii_lowercase + string.digits, "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"}
    name = next(k for k, v in alphabets.items() if set(s) <= set(v))
    a, n = alphabets[name], len(s)
    phi = lambda z: math.erfc(z / math.sqrt(2)) / 2
    x = [a.index(c) for c in s]
    df = len(a) - 1
    chi2 = sum((s.count(c) - n / len(a)) ** 2 / (n / len(a)) for c in a)
    p_chi2 = phi(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    bits = [v >= len(a) / 2 for v in x]
    n1 = sum(bits)
    runs = 1 + sum(u != v for u, v in zip(bits, bits[1:]))
    mean = 2 * n1 * (n - n1) / n + 1
    p_runs = min(1, 2 * phi(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))))
    average = sum(x) / n
    r = sum((u - average) * (v - average) for u, v in zip(x, x[1:])) / sum((u - average) ** 2 for u in x)
    p_serial = min(1, 2 * phi(abs(r + 1 / n) * math.sqrt(n)))
    return name, n, p_chi2, p_runs, p_serial


def test_battery_equals_the_plain_statistics(spark, rng):
    kinds = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")
    texts = ["A9z" + "".join(rng.choice(rng.choice(kinds[:2]) if k % 3 else kinds[k % 2 + 1]) for _ in range(rng.randint(25, 90))) for k in range(40)]
    texts += ["0a1f" + "".join(rng.choice(kinds[0]) for _ in range(rng.randint(25, 90))) for _ in range(20)]
    for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", battery(F.col("s")).alias("b")).collect():
        name, n, *p = plain_battery(r.s)
        assert (r.b.encoding, r.b.n) == (name, n)
        assert all(abs(x - y) < 1e-5 for x, y in zip(p, (r.b.p_chi2, r.b.p_runs, r.b.p_serial))) and abs(r.b.p - min(1, 3 * min(p))) < 1e-4


def test_cuts_are_those_of_the_step_up(spark, rng):
    """The cut is the largest cell edge e with total * e / (p-values up to e) <= alpha; without any, nothing is discarded."""
    rows = [(24, rng.random() ** 8) for _ in range(300)] + [(70, 0.5 + rng.random() / 2) for _ in range(50)]
    cuts = thresholds(spark.createDataFrame(rows, "n int, p double"), 0.05)
    p = [x for n, x in rows if n == 24]
    edges = [math.exp(-c / 2) for c in range(61)]
    assert cuts[24] == pytest.approx(max(e for e in edges if len(p) * e / max(1, sum(x <= e for x in p)) <= 0.05)) and cuts[64] == 0.0


def test_running_sums(spark):
    for n in (0, 1, 4, 5, 17):
        got = spark.range(1).select(running(F.sequence(F.lit(1), F.lit(17)).cast("array<bigint>") if n == 17 else F.slice(F.sequence(F.lit(1), F.lit(17)).cast("array<bigint>"), 1, n), block=4)).first()[0]
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_candidates_beside_other_characters(spark, rng):
    """Keys in paths, with characters of both alphabets around them, beside base spans, and of letters of one case."""
    draw = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    found = 0
    for _ in range(20):
        key, low = draw(40, string.ascii_letters + string.digits), draw(48, string.ascii_lowercase + string.digits)
        docs = [(0, f"see v1/user-list/{key}_x"), (1, f"token=abcdef01 {low}"), (2, "a long word: internationalizationsandmore and some/path/of/many-parts/in/it")]
        rows = {r.doc_id: [s for s in r.found if s.kind == "random"] for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        found += sum(any(s.start <= docs[k][1].index(x) + 1 and s.end >= docs[k][1].index(x) + len(x) - 1 for s in rows[k]) for k, x in ((0, key), (1, low)))
        assert not rows[2]
        if found >= 4:
            break
    assert found >= 4


def test_long_texts_with_many_matches(spark):
    """A long text with 60,000 matches and a run of 300,000 characters: whole results in seconds."""
    texts = ["token=abcdefgh " * 30_000 + "AKIA" + "B" * 20 + " " + "0a" * 20 + " k" * 10_000 + " ", "Ab9/" * 75_000]
    begin = time.perf_counter()
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (30_000, 1, 1) and rows[0].base_sha256 == brute(texts[0])[0][3]
    assert not rows[1].found and time.perf_counter() - begin < 60


def plain_scan(texts, alpha=0.01, least_bits=80):
    """Reported spans of all documents, the plain way: base spans masked, candidates tested one by one, one cut a class."""

    def tail(z):
        t = 1 / (1 + 0.2316419 * abs(z))
        poly = sum(c * t ** (k + 1) for k, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)))
        upper = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
        return upper if z >= 0 else 1 - upper

    def inferred(s):
        both = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
        order = [(digits + "abcdef", 4, False), (digits + "ABCDEF", 4, False), (upper + "234567", 5, True), (lower + "234567", 5, True), (lower + digits, 5, True)]
        order += [(upper + lower + digits + more, 6, False) for more in ("", "+/", "-_")]
        return next(((a, bits) for a, bits, mixed in order if set(s) <= set(a) and (both or not mixed)), (None, 0))

    def p_value(s, a):
        n, x = len(s), [a.index(c) for c in s]
        df = len(a) - 1
        chi2 = max(sum((s.count(c) - n / len(a)) ** 2 / (n / len(a)) for c in a), 0)
        p = [tail(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
        high = [v >= len(a) / 2 for v in x]
        mean = 2 * sum(high) * (n - sum(high)) / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
        p.append(min(1, 2 * tail(abs(runs - mean) / math.sqrt(variance))) if variance > 0 else 0.5 ** (n - 1))
        average = sum(x) / n
        spread = sum((v - average) ** 2 for v in x)
        r = sum((u - average) * (v - average) for u, v in zip(x, x[1:])) / spread if spread else 0
        p.append(min(1, 2 * tail(abs(r + 1 / n) * math.sqrt(n))) if spread else 0.0)
        return min(1, 3 * min(p))

    tested, out = [], []
    for k, t in enumerate(texts):
        base = [s.split(":") for s in brute(t)[1].split(",") if s]
        out.append([(int(a), int(b), kind) for kind, a, b in base])
        hidden = list(t)
        for a, b, _ in out[k]:
            hidden[a:b] = "\x01" * (b - a)
        for m in re.finditer(r"[A-Za-z0-9_-]{20,4096}+(?![+/])|[A-Za-z0-9+/]{20,4096}+={0,2}|[A-Za-z0-9_-]{20,4096}+", "".join(hidden)):
            s = m[0].rstrip("=")
            a, bits = inferred(s)
            if a:
                tested.append((k, m.start(), m.end(), max(c for c in (20, 24, 32, 40, 64, 128) if c <= len(s)), bits * len(s), p_value(s, a)))
    cuts = {}
    for low in {x[3] for x in tested}:
        p = [x[5] for x in tested if x[3] == low]
        edges = [math.exp(-c / 2) for c in range(61)]
        cuts[low] = max((e for e in edges if any(v <= e for v in p) and len(p) * e / sum(v <= e for v in p) <= alpha), default=0.0)
    for k, start, end, low, bits, p in tested:
        if p > cuts[low] and bits >= least_bits:
            out[k].append((start, end, "random"))
    return [",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(x)) for x in out], [(x[0], x[5]) for x in tested]


def test_reported_spans_equal_the_plain_scan(spark, rng):
    """Whole documents with planted keys of every encoding and length, words run together, paths, and base spans beside them."""
    draw = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alphabets = [digits + "ABCDEF", upper + "234567", lower + "234567", lower + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_"]
    texts, planted = [], {}
    for k in range(160):
        parts = ["the thing is here", "/usr/share/some-folder/with_long_names/of-things", "andtheheingtionouredtheandofshallbethe", "=" * 25, "a" * 30, "ab12" * 9, f"token = {draw(12, lower + digits)}", draw(30, digits + "abcdef"), "20240101-20240102-20240103"]
        words = [rng.choice(parts) for _ in range(rng.randint(0, 6))]
        if k % 2:
            planted[k] = draw(rng.choice((22, 27, 36, 48, 80, 140)), alphabets[k % len(alphabets)]) + "=" * (k % 3)
            words.insert(rng.randint(0, len(words)), planted[k])
        texts.append(rng.choice((" ", "\n", ", ", "; ")).join(words))
    want, tested = plain_scan(texts)
    got = {r.doc_id: r.spans for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))
    reported = {k for k, spans in enumerate(want) if "random" in spans}
    assert len(reported & planted.keys()) >= 0.85 * len(planted) and len(tested) > 2 * len(planted)
