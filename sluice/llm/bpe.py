"""BPE encoding and decoding, with long texts encoded by tree concatenation.

A text is first cut at the vocabulary's special strings. A stretch longer than ``leaf`` is halved again and again, the
leaves are encoded by themselves, and neighbours are joined bottom-up. The leaves of a text longer than ``spread`` are rows
of a stage of their own, so its halves run in parallel on all executors; those of shorter texts, of which a task has many
anyway, run one after the other in one worker. The two ways give the same ids. At a join a
window of tokens on both sides is encoded anew and grown until its outermost tokens agree with both sides. The window's
text then starts and ends where tokens surely start and end: at an end of the stretch, where white space follows
something else, or inside one run of a single kind of character, where merges alone decide and equal outer tokens make
all neighbouring tokens compatible. The result equals that of the whole text encoded at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow, cached, over_batches, written

#: Characters (code points) of a leaf; texts above it are halved.
LEAF = 1 << 14
#: Code points above which a text's leaves are dealt to all executors.
SPREAD = 1 << 18
#: Code points on each side of a join to begin with.
WINDOW = 64
#: Pieces that a worker remembers at most.
MOST_KNOWN = 200_000


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others are
    numbered from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if token in added or any(c not in alphabet for c in token) else bytes(alphabet[c] for c in token)
        self.decimal = [str(i) for i in range(size)]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added

        # The library's own kinds of the characters that most texts have; its merges never cross pieces of these.
        one = lambda x: len(self.library.pre_tokenizer.pre_tokenize_str(x)) == 1
        kinds: dict[str, list[str]] = {"L": [], "N": [], "O": [], "S": []}
        for c in map(chr, [*range(0x250), *range(0x2010, 0x2030)]):
            kinds["L" if one("a" + c) else "N" if one("1" + c) else "O" if one("!" + c) else "S"].append(c)
        letter, digit, other, space = ("".join(map(re.escape, kinds[k])) for k in "LNOS")
        self.usual = re.compile(f"[{letter}{digit}{other}{space}]*")
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        #: Of pieces met: ids, these in decimal with commas between, and those pieces that don't decode to themselves.
        #: Each id is one object, however many pieces have it.
        self.numbers = list(range(size))
        self.known: dict[str, tuple[int, ...]] = {}
        self.written: dict[str, str] = {}
        self.unlike: set[str] = set()

    def pieces_of(self, texts: list[str]) -> dict[int, list[str]]:
        """Of texts whose characters are all of a known kind, by number, the pieces, which ``known`` then has: those that
        have not been met are given to the library, many at once with line ends between, which no piece's merges cross.
        Where these become too many, those of the texts at hand stay, which common ones are among."""
        split = {i: self.pieces.findall(t) for i, t in enumerate(texts) if self.usual.fullmatch(t) and not (self.special and self.special.search(t))}
        met = set(chain.from_iterable(split.values()))
        if len(self.known) > MOST_KNOWN:
            self.known = {w: self.known[w] for w in met if w in self.known}
            self.written = {w: self.written[w] for w in self.known}
        new = list(met.difference(self.known))
        self._learn([w for w in new if not w.isspace() and "\n" not in w])
        spaces = [w for w in new if w not in self.known]
        self._know(spaces, self._ids(spaces))
        return split

    def leaves(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text: from its pieces, or by the library."""
        split, known = self.pieces_of(texts), self.known
        rest = [i for i in range(len(texts)) if i not in split]
        out: list[list[int]] = [[]] * len(texts)
        for i, ids in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            out[i] = ids
        for i, words in split.items():
            out[i] = list(chain.from_iterable(map(known.__getitem__, words)))
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], at_once: int = 256) -> None:
        (end,) = self.newline
        groups = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        for group, ids in zip(groups, self._ids(["\n".join(g) for g in groups]), strict=True):
            at, parts = 0, []
            for _ in group[:-1]:
                to = ids.index(end, at)
                parts.append(ids[at:to])
                at = to + 1
            self._know(group, [*parts, ids[at:]])

    def _know(self, words: list[str], ids: list[list[int]]) -> None:
        for w, own in zip(words, ids, strict=True):
            self.known[w], self.written[w] = tuple([self.numbers[i] for i in own]), ",".join([self.decimal[i] for i in own])
            if b"".join([self.bytes_of[i] for i in own]) != w.encode():
                self.unlike.add(w)

    def described(self, texts: list[str], leaf: int = LEAF, want_ids: bool = True) -> list[tuple[int, str, bytes, list[int] | None]]:
        """Of each text: the number of its ids, these in decimal, the bytes that they decode to, and themselves."""
        short = [i for i, t in enumerate(texts) if len(t) <= leaf]
        split = self.pieces_of([texts[i] for i in short])
        ids_of, written = self.known.__getitem__, self.written.__getitem__
        out: list = [None] * len(texts)
        for k, words in split.items():
            if self.unlike.isdisjoint(words):  # each piece was decoded when it was met: the text is what it decodes to
                text = ",".join(map(written, words))
                out[short[k]] = text.count(",") + bool(text), text, texts[short[k]].encode(), list(chain.from_iterable(map(ids_of, words))) if want_ids else None
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.encode_many([texts[i] for i in rest], leaf), strict=True):
            out[i] = self.of_ids(ids)
        return out

    def of_ids(self, ids: list[int]) -> tuple[int, str, bytes, list[int]]:
        return len(ids), ",".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids)), ids

    def encode_many(self, texts: list[str], leaf: int = LEAF, window: int = WINDOW) -> list[list[int]]:
        """Ids of each text."""
        parts: list[str] = []
        plans: list[list[tuple[int, int, int]]] = []
        for text in texts:
            plan = []
            for special, leaves in self.cut(text, leaf):
                plan.append((special, len(parts), len(leaves)))
                parts += leaves
            plans.append(plan)
        coded = self.leaves(parts)
        return [self.joined([(special, parts[at : at + n], coded[at : at + n]) for special, at, n in plan], window) for plan in plans]

    def cut(self, text: str, leaf: int = LEAF) -> Iterator[tuple[int, list[str]]]:
        """The stretches of a text: the id of a special string and no leaves, or -1 and the leaves between two of them. A
        text that is a leaf itself stays whole, special strings and all."""
        if len(text) <= leaf:
            yield -1, [text]
            return
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.added:
                yield self.added[piece], []
            elif piece:
                yield -1, [piece[a:b] for a, b in _halves(len(piece), leaf)]

    def joined(self, stretches: list[tuple[int, list[str], list[list[int]]]], window: int = WINDOW) -> list[int]:
        """Ids of a text from those of its stretches' leaves."""
        ids: list[int] = []
        for special, leaves, coded in stretches:
            if special >= 0:
                ids.append(special)
            elif len(leaves) == 1:
                ids += coded[0]
            else:
                at = [0]
                for x in leaves:
                    at.append(at[-1] + len(x))
                ids += self._tree("".join(leaves), list(zip(at, at[1:], strict=False)), coded, window)
        return ids

    def _tree(self, text: str, cuts: list[tuple[int, int]], coded: list[list[int]], window: int) -> list[int]:
        """Joins neighbouring leaves, then neighbouring pairs, and so on. Nodes: (start, end, ids, start of each id)."""
        nodes = [(a, b, ids, self._starts(text, a, ids)) for (a, b), ids in zip(cuts, coded, strict=True)]
        while len(nodes) > 1:
            joined = [self._join(text, x, y, window) for x, y in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = joined + nodes[len(joined) * 2 :]
        return nodes[0][2]

    def _starts(self, text: str, at: int, ids: list[int]) -> list[int]:
        """The code point at which each id starts; -1 where it starts within a character."""
        out, left, bytes_of = [], 0, self.bytes_of
        for i in ids:
            out.append(at if left == 0 else -1)
            for b in bytes_of[i]:
                if left:
                    left -= 1
                    if not left:
                        at += 1
                elif b < 0x80:
                    at += 1
                else:
                    left = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        return out

    def _join(self, text: str, x: tuple, y: tuple, window: int) -> tuple:
        a, mid, xi, xs = x
        _, b, yi, ys = y
        reach = window
        while True:
            i, left_sure = self._left(text, a, mid, xs, reach)
            j, right_sure = self._right(text, mid, b, ys, reach)
            lo, hi = (xs[i] if i else a), (ys[j] if j < len(ys) else b)
            ids = self.leaves([text[lo:hi]])[0] if hi > lo else []
            ok = True
            if not left_sure:
                ok &= bool(ids) and ids[0] == xi[i] and i + 1 < len(xi) and _one_kind(text, lo - 1, lo + 1)
            if not right_sure:
                ok &= bool(ids) and ids[-1] == yi[j - 1] and j > 1 and _one_kind(text, hi - 1, hi + 1)
            if ok:
                return a, b, xi[:i] + ids + yi[j:], xs[:i] + self._starts(text, lo, ids) + ys[j:]
            if i == 0 and j == len(ys):
                return a, b, ids, self._starts(text, lo, ids)
            reach *= 2

    @staticmethod
    def _left(text: str, a: int, mid: int, xs: list[int], reach: int) -> tuple[int, bool]:
        """The first token of the window, and whether a token surely starts there."""
        import bisect

        want = mid - reach
        if want <= a:
            return 0, True
        known = [(s, i) for i, s in enumerate(xs[-4 * reach :], max(0, len(xs) - 4 * reach)) if s >= 0]
        at = bisect.bisect_right(known, (want, len(xs))) - 1
        if at < 0:
            return 0, True
        for s, i in reversed(known[max(0, at - reach) : at + 1]):
            if s == a:
                return 0, True
            if text[s].isspace() and not text[s - 1].isspace():
                return i, True
        return (known[at][1], False) if known[at][1] else (0, True)

    @staticmethod
    def _right(text: str, mid: int, b: int, ys: list[int], reach: int) -> tuple[int, bool]:
        """The token after the window, and whether one surely starts there."""
        want = mid + reach
        if want >= b:
            return len(ys), True
        known = [(s, i) for i, s in enumerate(ys[: 8 * reach]) if s >= want]
        for s, i in known[:reach]:
            if s > mid and text[s].isspace() and not text[s - 1].isspace():
                return i, True
        return (known[0][1], False) if known and known[0][1] else (len(ys), True)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """Equal leaves of 0..n, a power of two in number."""
    count = 1
    while n > count * leaf:
        count *= 2
    edges = [n * k // count for k in range(count + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _one_kind(text: str, a: int, b: int) -> bool:
    """Whether the characters from a to b (end exclusive) are all letters: no token can end between them but by merges."""
    return a >= 0 and b <= len(text) and text[a:b].isalpha() and bool(regex.fullmatch(r"\p{L}+", text[a:b]))


def encode(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, spread: int = SPREAD, longest: int | None = None, keep_ids: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded`` of each whole text.

    ``vocabulary``: the contents of a byte-level vocabulary file. Null and empty texts have no ids and decode to the
    empty text. Null ids and repeated rows are kept as they are; other columns than ``keep``, which may be called anything,
    are not read. ``longest``: the
    code points of the longest text, if known, else a pass over the texts finds it. No shuffle, but for texts longer than
    ``spread``: these are written, their leaves dealt, and brought together again by text.
    """
    kept = [f"kept_{i}_" for i in range(len(keep))]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    if longest is None:
        longest = d.agg(F.max(F.length("text"))).first()[0] or 0
    beside = "".join(f", {k} {d.schema[k].dataType.simpleString()}" for k in kept)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    key = ("bpe", hashlib.sha256(vocabulary.encode()).digest())

    def columns(found: list[tuple[int, str, bytes, list[int] | None]]) -> list[pa.Array]:
        decoded = [x[2].decode("utf-8", "replace") for x in found]
        cols = [
            pa.array([x[0] for x in found], pa.int64()),
            pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in found]),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
        ]
        return cols + [pa.array([x[3] for x in found], pa.list_(pa.int32())), pa.array(decoded, pa.string())] if keep_ids else cols

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = cached(key, lambda: Codec(vocabulary))
        found = codec.described([t or "" for t in batch.column(1).to_pylist()], leaf, keep_ids)
        return pa.RecordBatch.from_arrays([batch.column(0), *columns(found), *batch.columns[2:]], names=["id", *names, *kept])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached(key, lambda: Codec(vocabulary))
        for batch in batches:
            for uid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(uid, n, -1 if special < 0 else special, x) for n, (special, leaves) in enumerate(codec.cut(text, leaf)) for x in (leaves or [""])]
                for at in range(0, len(rows), 64):
                    part = rows[at : at + 64]
                    cols = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(range(at, at + len(part)), pa.int64())], names=["uid", "stretch", "special", "leaf", "place"])

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = cached(key, lambda: Codec(vocabulary))
        special, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ids = codec.leaves([t if s < 0 else "" for s, t in zip(special, texts, strict=True)])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["uid", "stretch", "special", "leaf", "place", "ids"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached(key, lambda: Codec(vocabulary))
        now, stretches, last = None, [], None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *columns([codec.of_ids(codec.joined(stretches))])], names=["uid", *names])

        for batch in batches:
            for uid, stretch, special, text, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True):
                if uid != now:
                    if now is not None:
                        yield made()
                    now, stretches, last = uid, [], None
                if stretch != last:
                    stretches.append((special, [], []))
                    last = stretch
                stretches[-1][1].append(text)
                stretches[-1][2].append(ids)
        if now is not None:
            yield made()

    if longest <= spread:
        return over_batches(d, whole, f"id long, {kinds}{beside}", 1 << 20).toDF(id_col, *names, *keep)
    short = over_batches(d.filter(F.coalesce(F.length("text") <= spread, F.lit(True))), whole, f"id long, {kinds}{beside}", 1 << 20)
    rows = written(d.filter(F.length("text") > spread).withColumn("uid_", F.monotonically_increasing_id()), "long")
    dealt = arrow(rows.select("uid_", "text"), cut, "uid long, stretch long, special int, leaf string, place long")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = written(over_batches(dealt.repartition(parts, "uid", "place"), coded, "uid long, stretch long, special int, leaf string, place long, ids array<int>"), "leaves")
    found = arrow(leaves.repartition(parts, "uid").sortWithinPartitions("uid", "place"), together, f"uid long, {kinds}")
    long = rows.drop("text").join(found, rows["uid_"] == found["uid"])
    return short.unionByName(long.select("id", *names, *kept)).toDF(id_col, *names, *keep)


def read_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The contents of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return text


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_vocabulary(), keep_ids=False)
