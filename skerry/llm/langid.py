"""Language identification of whole texts, with spans for mixed-language text.

Texts are cut at white space, and what stands between where the script changes; in scripts that don't part words, every PIECE letters.
Each such word gets a score for every language from its character n-grams (naive Bayes with hashed n-grams of one to three
characters). The word's script narrows the candidates to the languages that were seen in it. Viterbi over the words,
with a penalty for each change of language, labels the spans. The language with the most letters is the document's.

The model learns from a bounded sample: at most SAMPLE documents of each language, those with the least hashes of
doc_id. Defined results: a null text or one without letters is `und` with score 0 and no spans; documents with null lang
don't teach; equal scores go to the language first in the alphabet; with nothing to learn from, every
text is `und`; repeated rows give repeated results; null doc_ids stay null and count as the empty id text.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import U64, Memo, arrow, forget, mix, only, split_words

#: At most so many documents of each language teach the model.
SAMPLE = 400
#: Hashed n-grams, the price of a change of language in nats, the most that one word can say against a language.
BUCKETS, SWITCH, FLOOR = 1 << 15, 14.0, 7.0
#: Letters in a word of a script that puts no spaces between words.
PIECE = 4
UNKNOWN = "und"

# First code points of Unicode script ranges and their scripts ("" for none in particular).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, ""), (0xFB50, "arabic"), (0xFE00, ""), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"), (0x30000, ""),
]
_STARTS = [s for s, _ in SCRIPTS]


def script(char: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(char)) - 1][1]


#: Scripts without spaces between words; Japanese mixes the first two.
UNSPACED = frozenset(("han", "kana", "thai", "lao", "khmer", "myanmar", "tibetan"))


def pieces(token: str) -> list[tuple[int, str]]:
    """The words of a token without white space: where each begins, and its letters. There is always one, if only without letters."""
    if max(token, default="") < "\u0370":
        return [(0, "".join(filter(str.isalpha, token)).lower())]
    out, begin, held, now = [], 0, [], ""
    for at, c in enumerate(token):
        if not c.isalpha():
            continue
        kind = script(c) or now
        kind = "han" if kind == "kana" else kind
        if held and (kind != now or kind in UNSPACED and len(held) >= PIECE):
            out.append((begin, "".join(held).lower()))
            begin, held = at, []
        now = kind
        held.append(c)
    return [*out, (begin, "".join(held).lower())]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words, and the word that each is of; words are fenced by a mark."""
    joined = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    word = np.cumsum(joined == 10) - 1
    out, of = [], []
    inside = joined != 10
    for n in (1, 2, 3):
        code = np.zeros(len(joined) - n + 1, U64)
        with np.errstate(over="ignore"):
            for k in range(n):
                code = code * U64(0x110000) + joined[k : len(joined) - n + 1 + k]
        # a fence may be the first or the last character of an n-gram, no other
        good = inside[: len(code)].copy() if n == 1 else np.ones(len(code), bool)
        if n == 2:
            good &= inside[:-1] | inside[1:]
        if n == 3:
            good &= inside[1:-1]
        out.append((mix(code + U64(n << 60)) % U64(BUCKETS)).astype(np.int64)[good])
        of.append((word[: len(code)] if n == 1 else word[: len(code)])[good])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: log probabilities
    scripts: dict[str, np.ndarray]  # script -> which languages use it

    def words(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages, the best is 0) of words of letters, and how many letters each has."""
        counts = np.array([len(w) for w in plain], np.int64)
        scores = np.zeros((len(plain), len(self.languages)), np.float32)
        some = np.flatnonzero(counts) if self.languages else []
        if len(some):
            buckets, of = grams([plain[i] for i in some])
            sums = np.zeros((len(some), len(self.languages)))
            for j in range(len(self.languages)):
                sums[:, j] = np.bincount(of, self.table[buckets, j], len(some))
            none = np.zeros(len(self.languages), bool)
            use = np.array([self.scripts.get(script(plain[i][0]), none) for i in some])
            use[~use.any(axis=1)] = True
            sums = np.where(use, sums, -np.inf)
            sums -= sums.max(axis=1, keepdims=True)
            scores[some] = np.maximum(sums, -FLOOR)
        return scores, counts


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of languages over the words; ties stay, then go to the first."""
    n, k = scores.shape
    sums = np.cumsum(scores, axis=0, dtype=np.float64)
    best = int(np.argmax(sums[-1]))
    # Beside runs of the best language each other run costs a change, so it must gain more than that. Without any, n runs cost n - 1 changes,
    # so the first and the last together must gain more than one. Where neither can be, one language is the best path.
    ahead = sums - sums[:, best : best + 1]
    lowest = np.minimum.accumulate(np.vstack([np.zeros(k), ahead[:-1]]), axis=0)
    ends = ahead.max() + (ahead[-1] - lowest[-1]).max()
    if (ahead - lowest).max() <= switch and ends <= switch:
        return np.full(n, best)
    back = np.empty((n, k), np.int64)
    value, own = scores[0].astype(np.float64), np.arange(k)
    for t in range(1, n):
        top = int(np.argmax(value))
        change = value[top] - switch > value
        back[t] = np.where(change, top, own)
        value = np.where(change, value[top] - switch, value) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(np.argmax(value))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit(docs: DataFrame) -> Model:
    """Learns from docs(doc_id, text, lang); rows with null text or lang don't count."""
    spark = docs.sparkSession
    arrow(spark)
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.xxhash64("doc_id").alias("h"), "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), {})
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(2.0**64 * min(1.0, SAMPLE / n) - 2.0**63)) for x, n in sizes.items()))
    sample = known.filter(F.col("h").cast("double") < share[F.col("lang")]).select("lang", "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        totals: dict[str, np.ndarray] = {}
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                plain = [w for token in text.split() for _, w in pieces(token) if w]
                for w in plain:
                    seen[lang, script(w[0])] = seen.get((lang, script(w[0])), 0) + len(w)
                if plain:
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    totals[lang] += np.bincount(grams(plain)[0], minlength=BUCKETS)
        rows = [(lang, int(b), "", int(c[b])) for lang, c in totals.items() for b in np.flatnonzero(c)] + [(lang, -1, s, n) for (lang, s), n in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "bucket", "script", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most BUCKETS rows and a few scripts for each language
    counts, scripts = np.zeros((BUCKETS, len(languages))), {}
    at = {x: i for i, x in enumerate(languages)}
    bucket = got.column("bucket").to_numpy()
    for row in got.filter(pa.array(bucket < 0)).to_pylist():
        scripts.setdefault(row["script"], np.zeros(len(languages)))[at[row["lang"]]] = row["n"]
    grams_seen = got.filter(pa.array(bucket >= 0))
    counts[grams_seen.column("bucket").to_numpy(), [at[x] for x in grams_seen.column("lang").to_pylist()]] = grams_seen.column("n").to_numpy()
    used = sum(scripts.values(), np.zeros(len(languages)))
    return Model(languages, np.log((counts + 0.3) / (counts.sum(axis=0) + 0.3 * BUCKETS)).astype(np.float32), {s: n > 0.01 * used for s, n in scripts.items()})


_LABELS = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long,letters:long>>"
_WORD = re.compile(r"\S+")


class Labeller:
    """Labels texts in one worker; scores of words are remembered. A token's words stand in rows one after the other."""

    def __init__(self, model: Model, most: int = 220_000):
        self.model = model
        self._clear()
        self.memo = Memo(self._fill, most)

    def _clear(self) -> None:
        self.used = 0
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters, self.begins, self.several = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.ones(1024, np.int64)

    def _fill(self, tokens: list[str]) -> list[int]:
        """The first row of each token."""
        if not self.memo:
            self._clear()
        parts = [pieces(x) for x in tokens]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        firsts = self.used + np.cumsum(sizes) - sizes
        a, b = self.used, self.used + int(sizes.sum())
        if b > len(self.letters):
            room = max(b, 2 * len(self.letters)) - a
            self.scores = np.vstack([self.scores[:a], np.zeros((room, self.scores.shape[1]), np.float32)])
            self.letters, self.begins, self.several = (np.concatenate([x[:a], np.ones(room, np.int64)]) for x in (self.letters, self.begins, self.several))
        flat = [p for x in parts for p in x]
        self.scores[a:b], self.letters[a:b] = self.model.words([w for _, w in flat])
        self.begins[a:b] = [at for at, _ in flat]
        self.several[firsts] = sizes
        self.used = b
        return firsts.tolist()

    def label(self, texts: pa.Array) -> list[tuple[str, float, list[dict]]]:
        distinct, at, ends = split_words(texts)
        tokens = distinct.to_pylist()
        self.memo.learn(tokens)
        rows = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))[at]
        sizes, token = self.several[rows], None
        if len(sizes) and sizes.max() > 1:
            behind = np.concatenate([[0], np.cumsum(sizes)])
            token = np.repeat(np.arange(len(rows)), sizes)
            rows = np.repeat(rows - behind[:-1], sizes) + np.arange(behind[-1])
            first, ends = ends, behind[ends]
        else:
            first = ends
        return [self._one(texts[i], rows[a:b], None if token is None else token[a:b] - f) for i, (f, a, b) in enumerate(zip(first[:-1], ends[:-1], ends[1:], strict=True))]

    def _one(self, text: pa.Scalar, at: np.ndarray, token: np.ndarray | None) -> tuple[str, float, list[dict]]:
        counts = self.letters[at]
        all_letters = int(counts.sum())
        if not all_letters or not self.model.languages:
            return UNKNOWN, 0.0, []
        path = viterbi(self.scores[at])
        of = np.bincount(path, counts, len(self.model.languages))
        best = int(np.argmax(of))
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(at)]
        text = text.as_py()
        if len(edges) == 2:
            spans = [{"lang": self.model.languages[path[0]], "start": 0, "end": len(text), "letters": all_letters}]
        else:
            places = [m.start() for m in _WORD.finditer(text)]
            cuts = [0, *(places[e if token is None else token[e]] + int(self.begins[at[e]]) for e in edges[1:-1]), len(text)]
            spans = [{"lang": self.model.languages[path[e]], "start": a, "end": b, "letters": int(counts[e:f].sum())} for a, b, e, f in zip(cuts, cuts[1:], edges, edges[1:], strict=False)]
        return self.model.languages[best], float(of[best] / all_letters), spans


def label(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) as (doc_id, lang_pred, score, spans); score is the share of letters in spans of lang_pred."""
    arrow(docs.sparkSession)
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = only(key, lambda: Labeller(held.value))
        spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("letters", pa.int64())]))
        for batch in batches:
            out = labeller.label(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], spans)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _LABELS)


def kept(docs: DataFrame, model: Model, share: float) -> DataFrame:
    """The rows of docs, with all their columns, whose main language is known and has at least that share of the letters."""
    arrow(docs.sparkSession)
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = only(key, lambda: Labeller(held.value))
        for batch in batches:
            yield batch.filter(pa.array([lang != UNKNOWN and score >= share for lang, score, _ in labeller.label(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
