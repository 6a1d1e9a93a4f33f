import random
import re

from sluice.llm.licences import LEAST_RUN, LEAST_SHARE, LEAST_WORDS, PHRASES, TEMPLATES, Automaton, Scanner, best, scan

import pyarrow as pa


def slow_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_base(text):
    w = slow_words(text)
    return len(w), sorted((i, x) for p, x in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_matching_statistics():
    r = random.Random(4)
    for _ in range(60):
        seqs = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(4)]
        phrases = [[r.randrange(3) for _ in range(r.randint(1, 3))] for _ in range(2)]
        a = Automaton(seqs, phrases)
        text = [r.randrange(4) for _ in range(40)]
        inside = lambda x: any(s[i : i + len(x)] == x for s in [*seqs, *phrases] for i in range(len(s)))
        for k, (s, n) in enumerate(a.stream(text), 1):
            want = max(m for m in range(k + 1) if m == 0 or inside(text[k - m : k]))
            assert n == want
            assert {p for p in a.states[s].phrases if n >= len(phrases[p])} == {p for p, x in enumerate(phrases) if text[max(0, k - len(x)) : k] == x}
            for t, end in a.states[s].ends.items():
                assert seqs[t][end - n + 1 : end + 1] == text[k - n : k]


def texts():
    r = random.Random(7)
    pool = "mit license apache general public License, GNU MIT été the of version 2.0 permission-is xLICENSE".split(" ")
    return ["", "MIT LICENSE", "mit_license", "mit licenseé", "Apache\nLicense; General--Public license"] + [" ".join(r.choice(pool) for _ in range(r.randint(1, 80))) for _ in range(200)]


def test_frame(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, "a") for i, x in enumerate(t)] + [(None, None, "b"), (0, "", "c")], "doc_id long, text string, id string")
    got = scan(df).collect()
    assert len(got) == len(t) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, [(p.word, p.label) for p in r.phrases]) == slow_base(t[r.doc_id])
    assert scan(df.limit(0)).count() == 0


def slow_runs(words, templates):
    """Longest runs of words that stand in some template: (start, words, {template: where it first ends there})."""
    inside = lambda x: {t: next(i + len(x) - 1 for i in range(len(y) - len(x) + 1) if y[i : i + len(x)] == x) for t, y in enumerate(templates) if any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))}
    reach = [next(n for n in range(k + 1, -1, -1) if n == 0 or inside(words[k + 1 - n : k + 1])) for k in range(len(words))]
    out = []
    for k, n in enumerate(reach):
        if n >= LEAST_RUN and (k + 1 == len(words) or reach[k + 1] <= n):
            out.append((k + 1 - n, n, inside(words[k + 1 - n : k + 1])))
    return out


def slow_spans(words, templates, names):
    """Chains by the rules: a run joins the chain of its template if it lies further on there and the gap is no longer than
    the run or what the chain has; what repeats a part of the chain is passed over; else a new chain begins."""
    found = set()
    for t, template in enumerate(templates):
        chains, now = [], None
        for start, n, ends in slow_runs(words, templates):
            if t not in ends:
                continue
            last = ends[t]
            if now is not None:
                gap = start - now["end"]
                ahead = last > now["upto"] and last - n + 1 > now["upto"] - n
                if ahead and gap <= max(n, now["have"]):
                    overlap = start < now["end"] or last - n + 1 <= now["upto"]
                    now["have"] += min(n, last - now["upto"], start + n - now["end"]) if overlap else n
                    now["end"], now["upto"] = start + n, last
                    continue
                if now["have"] >= n and gap <= now["have"] and last <= now["upto"]:
                    continue
                chains.append(now)
            now = {"start": start, "end": start + n, "upto": last, "have": n}
        for c in [*chains, *([now] if now else [])]:
            if c["have"] >= LEAST_WORDS and c["have"] >= LEAST_SHARE * len(template):
                found.add((names[t], c["start"], c["end"], min(1.0, c["have"] / len(template))))
    return sorted(found, key=lambda x: (x[1], x[0]))


def test_chains_are_slow_chains():
    r = random.Random(12)
    abc = [f"w{i}" for i in range(14)]
    seen = 0
    for _ in range(150):
        templates = [(f"l{k % 3}", " ".join(r.choice(abc) for _ in range(r.randint(6, 30)))) for k in range(r.randint(1, 5))]
        split = [t.split() for _, t in templates]
        words = []
        for _ in range(r.randint(1, 9)):
            t = r.choice(split)
            a = r.randrange(len(t))
            words += r.choice([t, t[a:], t[:a], t[a : a + 5], [r.choice([*abc, "other"]) for _ in range(r.randint(1, 8))]])
        s = Scanner(templates, {"w1 w2": "p"})
        (got,) = s.scan(pa.array([" ".join(words)]))
        # words that no template has end a run in both; the phrase is a sequence of the automaton too
        want = slow_spans(words, split, [x for x, _ in templates])
        assert s.spans_of(got["runs"]) == want, (templates, words)
        seen += len(want)
    assert seen > 100


def test_phrases_of_one_word_and_whole_licences(spark):
    df = spark.createDataFrame([(1, "under GPLv3 or the mit license, gplv3"), (2, "nothing")], "doc_id long, text string")
    got = {x.doc_id: [(p.word, p.label) for p in x.phrases] for x in scan(df, phrases={"gplv3": "gpl", "mit license": "mit"}).collect()}
    assert got == {1: [(1, "gpl"), (4, "mit"), (6, "gpl")], 2: []}
    s = Scanner(TEMPLATES, PHRASES)
    for label, template in TEMPLATES:
        spans = s.spans_of(s.scan(pa.array([f"Copyright (c) 2020 A. Nother. {template} End."]))[0]["runs"])
        assert any(x[0] == label and x[3] == 1.0 for x in spans), label


def test_best():
    r = random.Random(3)
    for _ in range(200):
        spans = list({(r.choice("abc"), a := r.randrange(20), a + r.randint(1, 9), r.choice([0.6, 0.8, 1.0])) for _ in range(r.randint(0, 14))})
        want = [x for x in spans if not any(y[0] != x[0] and y[1] <= x[1] and y[2] >= x[2] and y[3] > x[3] for y in spans)]
        assert sorted(best(spans)) == sorted(want)
    s = Scanner(TEMPLATES, PHRASES)
    for label in ("isc", "0bsd", "gpl", "cc-by", "cc-by-sa", "zlib", "mpl"):
        for text in [t for x, t in TEMPLATES if x == label]:
            assert {x[0] for x in best(s.spans_of(s.scan(pa.array([text]))[0]["runs"]))} == {label}


def test_very_long_text(spark):
    """Megabytes in one text, licences at its ends and in the middle; the hot words of templates everywhere."""
    r = random.Random(1)
    prose = " ".join(r.choice("the software of is provided as copy license terms and été".split()) for _ in range(300_000))
    whole = f"{TEMPLATES[0][1]} {prose} mit license {prose} {TEMPLATES[0][1]}"
    (got,) = scan(spark.createDataFrame([(1, whole)], "doc_id long, text string")).collect()
    words = whole.split()
    assert got.n_words == len(words)
    assert [(p.word, p.label) for p in got.phrases] == slow_base(whole)[1]
    spans = [x for x in got.spans if x.label == "mit"]
    assert spans[0].word == 0 and spans[-1].end == len(words) and all(x.share > 0.9 for x in (spans[0], spans[-1]))


def labels(text):
    s = Scanner(TEMPLATES, PHRASES)
    return {x[0] for x in s.spans_of(s.scan(pa.array([text]))[0]["runs"])}


def test_chains():
    prose = "the software of this and to the use of a copy in the terms of one license as is "
    for label, template in TEMPLATES:
        assert label in labels(prose * 3 + template + prose)
    words = dict(TEMPLATES[::-1])["bsd"].split()
    changed = words[:20] + ["holder", "name"] + words[22:]
    assert "bsd" in labels(" ".join(changed))
    assert labels(prose * 20) == set()
    assert labels(" ".join(words[:12])) == set()
