import math
import random
import zlib

import numpy as np

from sluice.llm.language import SAMPLE_CHARS, STRETCH, Model, automaton, letters_only, op10_langid, predict, samples


def slow_phrases(text, sample):
    """Greedy longest matches; a phrase ends where the next symbol can't be added, and a symbol that the sample lacks opens
    the next one."""
    body = letters_only(text)
    if body and not text.lower()[-1].isalpha():
        body += " "
    n, now = int(bool(body)), ""
    for c in body:
        if now + c in sample:
            now += c
        else:
            n += 1
            now = c if c in sample else ""
    return n


def slow_predict(text, samples):
    """Language, score, entropies by the definition."""
    size = len(letters_only(text)) + (bool(letters_only(text)) and not text.lower()[-1].isalpha())
    if not size:
        return "und", 0.0, None
    h = {x: slow_phrases(text, s) * math.log2(max(2, len(s))) / size for x, s in samples.items()}
    first, *rest = sorted(h, key=lambda x: (h[x], x))
    return first, 1 - h[first] / h[rest[0]] if rest else 1.0, h


def test_automaton_knows_substrings():
    r = random.Random(1)
    s = [r.randrange(3) for _ in range(60)]
    a = automaton(s)
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(500):
        x = [r.randrange(3) for _ in range(r.randint(1, 8))]
        state = 0
        for c in x:
            state = a[state].get(c) if state is not None else None
        assert (state is not None) == (tuple(x) in subs)


def test_phrases_are_slow_phrases():
    r = random.Random(2)
    word = lambda abc: "".join(r.choice(abc) for _ in range(r.randint(1, 6)))
    samples = {"a": " ".join(word("abcde") for _ in range(400)), "b": " ".join(word("cdefé") for _ in range(300))}
    m = Model(samples)
    texts = [" ".join(word("abcdefé") for _ in range(r.randint(1, 400))) + r.choice(["", ".", "12"]) for _ in range(40)] + ["", "123 !", "b", " a", "É."]
    size, total = m.phrases(texts)
    for t, s, row in zip(texts, size, total, strict=True):
        assert (s == 0) == (not any(c.isalpha() for c in t))
        for lang, n in zip(m.languages, row, strict=True):
            assert n == slow_phrases(t, samples[lang]), (t, lang)


def test_stretches_that_never_agree():
    """Texts whose parse from a stretch's start differs from the whole one's for all of the stretch, or many."""
    samples = {"a": "abc" * 7 + "x", "b": "ab" * 50, "c": "c"}
    m = Model(samples)
    r = random.Random(5)
    texts = ["abc" * 3000, "a" + "abc" * 2000 + "cab" * 2000, "c" * (3 * STRETCH), "ab" * STRETCH + "z" + "ba" * STRETCH, "".join(r.choice("abcxz ") for _ in range(20_000)), "a" * STRETCH, "b" * (STRETCH + 1)]
    _, total = m.phrases(texts)
    assert total.tolist() == [[slow_phrases(t, samples[x]) for x in m.languages] for t in texts]


def test_predictions_are_slow_predictions(spark):
    r = random.Random(3)
    word = lambda abc: "".join(r.choice(abc) for _ in range(r.randint(1, 6)))
    learned = {k: " ".join(word(abc) for _ in range(300)) for k, abc in (("p", "abcde"), ("q", "cdefg"), ("r", "aceg"))}
    learned |= {"s": learned["p"]}  # a tie: the one that sorts first
    texts = [" ".join(word("abcdefgh") for _ in range(r.randint(1, 900))) for _ in range(40)] + ["", "1 2", "zz!", None, "abc " * 2000]
    got = predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).collect()
    for x in got:
        lang, score, h = slow_predict(texts[x.doc_id] or "", learned)
        assert x.lang_pred == lang and abs(x.score - score) < 1e-12
        assert h is None or all(abs(x.entropies[k] - h[k]) < 1e-9 for k in h)
    (one,) = predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {"p": "abcabc"}).collect()
    assert (one.lang_pred, one.score) == ("p", 1.0)


def test_samples(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    long = "".join(chr(0x4E00 + i % 5000) for i in range(200_000))
    rows = [(held, "heldout", "x", 1), (None, "noid", "x", 1), (free[0], "nolang", None, 1), (free[1], None, "x", 1), (free[2], "", "x", 1), (free[3], "word", "x", 1), (free[3], "word", "x", 1), (free[4], long, "y", 1), (free[5], "12 !", "z", 1)]
    rows += [(i, f"many{'abcdefghij'[i % 10]} " * 100, "w", 1) for i in free[10:]]
    got = samples(spark.createDataFrame(rows, "doc_id long, text string, lang string, id int"), "doc_id", "text", "lang")
    assert set(got) == {"x", "y", "w"} and got["x"] == "word"
    assert len(got["y"]) == SAMPLE_CHARS and got["y"] in long and not long.startswith(got["y"])
    assert len(got["w"]) <= SAMPLE_CHARS
    assert samples(spark.createDataFrame(rows, "doc_id long, text string, lang string, id int").limit(0), "doc_id", "text", "lang") == {}


def test_frame(spark):
    df = spark.createDataFrame([(1, "abab", "x"), (1, "abab", "x"), (None, "cdcd", None), (3, None, "x"), (4, "12 .", "x"), (5, "", "x")], "doc_id long, text string, score string")
    got = predict(df, {"one": "abababab ab", "two": "cdcdcd cd"}).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "two"), (1, "one"), (1, "one"), (3, "und"), (4, "und"), (5, "und")]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in predict(df, {}).collect()} == {"und"}
    assert predict(df.limit(0), {"one": "ab"}).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op10_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").toPandas()
    assert len(got) > 100 and np.mean(got.lang == got.lang_pred) > 0.97


def test_more_languages_than_any_bound(spark):
    """A hundred languages with letters of their own, the last ones rarer."""
    r = random.Random(6)
    abc = {f"l{k:03}": [chr(0x4E00 + 8 * k + j) for j in range(8)] for k in range(100)}
    word = lambda a: "".join(r.choice(a) for _ in range(5))
    rows = [(i, " ".join(word(abc[lang]) for _ in range(30)), lang) for i, lang in enumerate(x for k, x in enumerate(abc) for _ in range(24 if k < 64 else 16))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = samples(df, "doc_id", "text", "lang")
    assert set(learned) == set(abc)
    want = {i: lang for i, _, lang in rows}
    assert all(x.lang_pred == want[x.doc_id] for x in predict(df, learned).collect())


def test_phrases_of_many_symbols(monkeypatch):
    r = random.Random(7)
    abc = [chr(0x4E00 + 16 * j) for j in range(200)]
    word = lambda n: "".join(r.choice(abc[:n]) for _ in range(r.randint(1, 6)))
    texts = {"a": " ".join(word(200) for _ in range(500)), "b": " ".join(word(150) for _ in range(500))}
    tried = [" ".join(word(200) for _ in range(r.randint(1, 300))) for _ in range(20)] + [texts["a"][50:300], texts["b"]]
    want = [[slow_phrases(t, texts[x]) for x in "ab"] for t in tried]
    for most in (1 << 27, 0):
        monkeypatch.setattr("sluice.llm.language.MOST_DENSE", most)
        assert Model(texts).phrases(tried)[1].tolist() == want
