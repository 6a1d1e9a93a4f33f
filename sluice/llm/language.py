"""Language ID by cross-parsing: a text is cut into the longest phrases that stand in a language's labelled text.

A suffix automaton of each language's sample gives the parse: follow transitions as long as there are any, else a phrase
ends and the next one begins at the root. Phrases are normalised by log2(sample length) / text length, so they estimate a
cross-entropy; the language with the fewest wins. The automata become a dense table whose entries already hold the restart
and a flag for it, so many stretches of text advance together, a symbol at a time. With many languages or symbols the
table holds only the transitions there are, sorted by state and symbol; what is not found restarts.

A long text's stretches are parsed from the root first, each for itself. Then each is parsed from where the one before
really ends, beside the first parse, until both are in the same state: from there on they agree. The phrases are those of
the whole text, parsed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cached, over_batches

UNKNOWN = "und"
#: Bounds of the labelled sample, for each language: documents, and characters in all, which the documents share.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 1 << 15
#: Bytes of the dense table of transitions at most; larger ones are kept as sorted keys.
MOST_DENSE = 128 << 20
#: Symbols of a stretch; longer texts have several.
STRETCH = 512


def letters_only(text: str) -> str:
    """Lower-cased, with each run of anything but letters made one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


class Model:
    """Languages, their samples' sizes, the symbol classes and one table of all automata."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        own = sorted(set("".join(samples.values())))
        self.classes = len(own) + 1  # the last: symbols that no sample has
        self.symbol = np.full(0x110000, len(own), np.int32)
        self.symbol[[ord(c) for c in own]] = np.arange(len(own))
        self.log_size = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        keys, nexts, roots, sizes, self.roots = [], [], [], [], []
        base = 0
        for x in self.languages:
            states = automaton(self.symbol[np.frombuffer(samples[x].encode("utf-32-le"), np.uint32)].tolist())
            #: next state * 2, + 1 if a phrase ended; a symbol unknown even at the root is a phrase of its own.
            root = np.full(self.classes, base * 2 + 1, np.int32)
            for c, to in states[0].items():
                root[c] = (base + to) * 2 + 1
            many = np.fromiter(map(len, states), np.int64, len(states))
            symbol = np.fromiter((c for out in states for c in out), np.int64, many.sum())
            keys.append((base + np.repeat(np.arange(len(states)), many)) * self.classes + symbol)
            nexts.append((base + np.fromiter((to for out in states for to in out.values()), np.int64, many.sum())).astype(np.int32) * 2)
            roots.append(root)
            sizes.append(len(states))
            self.roots.append(base)
            base += len(states)
        self.dense = base * self.classes * 4 <= MOST_DENSE
        key, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nexts))
        if self.dense:
            self.table = np.repeat(np.array(roots, np.int32).reshape(len(roots), self.classes), sizes, axis=0).reshape(-1)
            self.table[key] = to
        else:
            order = np.argsort(key)
            self.keys, self.nexts, self.restarts = key[order], to[order], np.stack(roots)

    def _step(self, lang: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next state * 2, + 1 if a phrase ended; ``lang``: the number of the language that a state is of."""
        if self.dense:
            return self.table[state * self.classes + symbol]
        key = state.astype(np.int64) * self.classes + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nexts[at], self.restarts[lang, symbol])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text (0: no letter), and the phrases that each language needs for it."""
        rows, langs = len(texts), len(self.languages)
        size = np.zeros(rows, np.int64)
        total = np.zeros((rows, langs), np.int64)
        code = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(c) for c in code])])
        every = np.concatenate(code) if code else np.zeros(0, np.uint32)
        if not len(every) or not langs:
            size = np.array([int(self.letter[c].any()) for c in code], np.int64)
            return size, total
        row = np.repeat(np.arange(rows), np.diff(offs))
        letter = self.letter[every]
        first = np.zeros(len(every), bool)
        first[offs[:-1][np.diff(offs) > 0]] = True
        after = np.concatenate([[False], letter[:-1]])
        keep = letter | (after & ~first)  # a run of others is one blank; those before the first letter go
        symbols = np.where(letter, self.symbol[every], self.symbol[ord(" ")])[keep]
        row = row[keep]
        size = np.bincount(row, minlength=rows)
        begin = np.concatenate([[0], np.cumsum(size)])
        pieces = -(-size // STRETCH)
        owner = np.repeat(np.arange(rows), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[:-1][owner] + nth * STRETCH
        length = np.minimum(STRETCH, begin[1:][owner] - at)
        order = np.argsort(-length, kind="stable")
        n = len(at)
        roots = np.array(self.roots, np.int32)[:, None]
        state, missed = np.tile(roots, (1, n)), np.zeros((langs, n), np.int64)
        active = np.searchsorted(-length[order], -np.arange(STRETCH), side="left")
        own, begins, numbers = state.copy(), at[order], np.arange(langs)[:, None]
        for k in range(STRETCH):
            m = int(active[k])
            if not m:
                break
            to = self._step(numbers, own[:, :m], symbols[begins[:m] + k])
            missed[:, order[:m]] += to & 1
            own[:, :m] = to >> 1
        state[:, order] = own
        self._continue(state, missed, symbols, at, length, nth)
        for x in range(langs):
            total[:, x] = np.bincount(owner, weights=missed[x], minlength=rows).astype(np.int64) + (size > 0)
        return size, total

    def _continue(self, end: np.ndarray, missed: np.ndarray, symbols: np.ndarray, at: np.ndarray, length: np.ndarray, nth: np.ndarray) -> None:
        """Corrects the end states and phrases of stretches that were parsed from the root: each begins where the one
        before it ends. ``nth``: a stretch's number in its text."""
        start = np.tile(np.array(self.roots, np.int32)[:, None], (1, len(at)))
        lang, of = np.nonzero(np.broadcast_to(nth > 0, start.shape))
        while True:
            wrong = start[lang, of] != end[lang, of - 1]
            lang, of = lang[wrong], of[wrong]
            if not len(of):
                return
            old, new = start[lang, of], end[lang, of - 1]
            start[lang, of] = new
            going, ended = np.arange(len(of)), np.zeros(len(of), bool)
            more = np.zeros(len(of), np.int64)
            for k in range(STRETCH):
                if not len(going):
                    break
                now = symbols[at[of[going]] + k]
                x, y = self._step(lang[going], old[going], now), self._step(lang[going], new[going], now)
                more[going] += (y & 1).astype(np.int64) - (x & 1)
                old[going], new[going] = x >> 1, y >> 1
                apart = (x >> 1) != (y >> 1)
                done = apart & (length[of[going]] == k + 1)
                ended[going[done]] = True
                going = going[apart & ~done]
            missed[lang, of] += more
            end[lang[ended], of[ended]] = new[ended]
            # only stretches after one whose end has changed may be wrong now
            lang, of = lang[ended], of[ended] + 1
            inside = of < len(nth)
            lang, of = lang[inside], of[inside]
            lang, of = lang[nth[of] > 0], of[nth[of] > 0]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1: how far the next language's phrases exceed the winner's) and cross-entropies."""
        size, total = self.phrases(texts)
        entropy = total * self.log_size / np.maximum(size, 1)[:, None] if self.languages else np.zeros((len(texts), 0))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), entropy
        best = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        rest = entropy.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1) if len(self.languages) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(size > 0, 1 - low / second, 0.0)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, size, strict=True)], np.clip(score, 0.0, 1.0), entropy


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Bounded labelled text of each language, from rows that are not held out: the SAMPLE_DOCS documents with the smallest
    hashes of their ids. These share SAMPLE_CHARS characters; of a document that is longer than its share, a passage that
    begins at a place drawn by the same hash."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.filter(F.col("id").isNotNull() & ~held_out("id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = d.groupBy("lang").count().collect()
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1 << 40))
    below = [(r["lang"], int((1 << 40) * min(1.0, SAMPLE_DOCS / r["count"])), SAMPLE_CHARS // min(SAMPLE_DOCS, r["count"])) for r in counts]
    below = d.sparkSession.createDataFrame(below, "lang string, below long, part int")
    rows = d.join(F.broadcast(below), "lang").withColumn("place", place).filter(F.col("place") < F.col("below"))
    start = F.floor(F.col("place") / F.col("below") * F.greatest(F.length("text") - F.col("part") + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", "place", F.substring("text", start, F.col("part")).alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place, r.text)):
        part = letters_only(r.text)
        have = out.get(r.lang, "")
        if part and part not in have and len(have) < SAMPLE_CHARS:
            out[r.lang] = f"{have} {part}".strip()[:SAMPLE_CHARS].strip()
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, learned: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``held_out, lang_pred, score`` and ``entropies`` (by language) of each whole text, from the text alone.

    Null texts and those without a letter: ``und``, score 0; so all texts if nothing could be learned. Ties go to the
    language that sorts first. Rows are kept as they are, repeated or with null ids; other columns are not read."""
    key = ("language", tuple(sorted(learned.items())))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = cached(key, lambda: Model(learned))
        best, score, entropy = model.predict([t or "" for t in batch.column(1).to_pylist()])
        by = [dict(zip(model.languages, row, strict=True)) for row in entropy.tolist()]
        cols = [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array([list(x.items()) for x in by], pa.map_(pa.string(), pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score", "entropies"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = over_batches(d, run, "id long, lang_pred string, score double, entropies map<string,double>", 1 << 20)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "entropies")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, samples(docs, "doc_id", "text", "lang")).drop("entropies")
