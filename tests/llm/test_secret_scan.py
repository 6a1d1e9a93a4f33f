import bisect
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sluice.llm.secret_scan import BINS, BINS_TEN, CLASSES, ENCODINGS, FALSE, KINDS, RANDOM, TOKEN, places, redacted, scanned, battery


def slow_base(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(s, k, e) for s, _, k, e in sorted(out)]


def slow_p(s):
    """None if it is no token of the battery."""
    if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
        return None
    a = next((a for a in ENCODINGS if set(s) <= set(a)), None)
    if a is None:
        return None
    n, k = len(s), len(a)
    beyond = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((c - n / k) ** 2 / (n / k) for c in (s.count(x) for x in a))
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    d = 2 * mean**2 / var
    p = [beyond(((chi / mean) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))]
    v = [a.index(c) + 1 for c in s]
    bits = [x > k // 2 for x in v]
    ones = sum(bits)
    runs = 1 + sum(x != y for x, y in zip(bits, bits[1:], strict=False))
    mu = 2 * ones * (n - ones) / n + 1
    p.append(0.5 ** (n - 1) if ones in (0, n) else 2 * beyond(max(abs(runs - mu) - 0.5, 0) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))))
    c = np.array(v) - np.mean(v)
    p.append(0.5 ** (n - 1) if (c * c).sum() <= 1e-9 else 2 * beyond(abs((c[1:] * c[:-1]).sum() / (c * c).sum() + 1 / (n - 1)) * math.sqrt(n - 1)))
    return min(1, 3 * min(p))


def slow_spans(texts):
    tokens = [[(m.start(), m.end(), slow_p(m.group())) for m in re.finditer(TOKEN, t or "")] for t in texts]
    cls = lambda n: min(max(math.ceil(math.log2(n)), CLASSES[0]), CLASSES[-1])
    bin_ = lambda p: min(math.floor(-math.log10(max(p, 1e-300)) * BINS_TEN), BINS - 1)
    count = {c: Counter() for c in CLASSES}
    for x in tokens:
        for s, e, p in x:
            if p is not None:
                count[cls(e - s)][bin_(p)] += 1
    limit = {}
    for c, bins in count.items():
        ok = [b for b in bins if 10 ** (-b / BINS_TEN) <= FALSE * sum(n for k, n in bins.items() if k >= b) / sum(bins.values())]
        limit[c] = min(ok, default=BINS)
    out = []
    for t, x in zip(texts, tokens, strict=True):
        base = slow_base(t or "")
        more = [(s, RANDOM, e) for s, e, p in x if p is not None and bin_(p) < limit[cls(e - s)] and not any(b[0] < e and s < b[2] for b in base)]
        order = [k for k, *_ in KINDS] + [RANDOM]
        out.append((base, sorted(base + more, key=lambda y: (y[0], order.index(y[1]), y[2]))))
    return out


def texts():
    r = random.Random(5)
    b64 = ENCODINGS[6]
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n))
    pool = ["token=secret:abcdefgh12", 'PassWord = "hunter2hunter2"', "api_key: " + draw(b64, 30), "apikey=short", "AKIA" + draw("ABC123", 12), "AKIA" + draw("ABC123", 11), "AKIAAKIAAKIAAKIAX", "été", "\U0001f600", "the of and", draw("0123456789abcdef", 40), draw("0123456789abcdef", 31), "a" * 40, "passwd :: x", "secret='", "SECRETtoken=12345678", "1" * 50 + "a" * 50, "/usr/share/lib/python3/dist-packages/x", "_" * 30]
    out = ["", None, "password=" * 30, "x" * 3000 + " AKIA" + "B" * 20, " ".join("token=abcdefgh%d" % i for i in range(900))]
    for _ in range(120):
        out.append(r.choice([" ", "", "\n", ";"]).join(r.choice([*pool, draw(b64, r.randint(20, 90)), draw(ENCODINGS[3], r.randint(20, 60))]) for _ in range(r.randint(1, 12))))
    return out


def test_spans_are_slow_spans(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in enumerate(t)] + [(None, t[5], 2, "s")], "doc_id long, text string, base int, kind string").repartition(3)
    got = scanned(df)
    assert got.columns == ["doc_id", "text", "kind", "base", "spans"]
    want = slow_spans([*t, t[5]])
    for x in got.collect():
        base, spans = want[x.doc_id if x.doc_id is not None else 5]
        assert [(y.start, y.kind, y.end) for y in x.base] == base
        assert [(y.start, y.kind, y.end) for y in x.spans] == spans
    assert got.count() == len(t) + 1 and scanned(df.limit(0)).count() == 0
    hidden = got.select("text", redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("out"), "spans").collect()
    for x in hidden:
        assert x.out == slow_redacted(x.text or "", x.spans)


def slow_redacted(text, spans):
    out, at = "", 0
    for s, _, e in spans:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_very_long_text(spark):
    """Megabytes of checksums and keys, several bytes a character here and there: no step that looks at pairs."""
    r = random.Random(9)
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n))
    lines = []
    while sum(map(len, lines)) < 5 << 20:
        lines.append(draw("0123456789abcdef", 64) + f"  file{len(lines)}é\U0001f600 api_key=" + draw(ENCODINGS[6], 40) + " " + draw(ENCODINGS[6], 44))
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    began = time.time()
    got = scanned(df).withColumn("out", redacted(F.col("text"), F.col("spans"))).filter("doc_id = 1").first()
    took = time.time() - began
    base = slow_base(text)
    assert [(x.start, x.kind, x.end) for x in got.base] == base and len(base) > 20_000
    spans = [(x.start, x.kind, x.end) for x in got.spans]
    ends = [0]
    for _, _, e in base:
        ends.append(max(ends[-1], e))
    more = [x for x in spans if x[1] == RANDOM]
    assert len(more) > 20_000 and [x for x in spans if x[1] != RANDOM] == base
    starts = [s for s, _, _ in base]
    for s, _, e in more:
        k = bisect.bisect_left(starts, s)
        assert ends[k] <= s and (k == len(starts) or starts[k] >= e)
    assert got.out == slow_redacted(text, spans)
    assert took < 120


def test_p_values(spark):
    r = random.Random(6)
    even = ["".join(r.choice(a) for _ in range(r.randint(20, 120))) for a in ENCODINGS for _ in range(60)]
    words = ["index_page2_the_quick_brown_fox_the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abababababababababababababab1212", "2024-01-01-2024-01-02-2024-01-03T"]
    rows = spark.createDataFrame([(x,) for x in even + words], "text string").select("text", F.explode(battery(places(F.col("text"), RANDOM, TOKEN))).alias("t"))
    got = {x.text: x.t.p for x in rows.collect()}
    for s, p in got.items():
        assert abs(p - slow_p(s)) < 1e-6 + 1e-3 * slow_p(s)
    p = np.array([got[s] for s in even if s in got])
    assert len(p) > 400 and (p < 0.05).mean() < 0.08
    assert all(got[w] < 0.05 for w in words if w in got) and len([w for w in words if w in got]) >= 3


def test_query_digest(spark):
    from sluice.llm.secret_scan import op7_secrets

    got = {x.doc_id: x for x in op7_secrets(spark, "/root/testdata/sf0.001").collect()}
    for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        base = slow_base(x.text)
        assert got[x.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert got[x.doc_id].n_hex == sum(k == "hex" for _, k, _ in base)
