"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Sentences are cut into units: words, runs of single characters joined ("i d i o t"), long words in overlapping windows. The
kernel counts common subsequences of two and three characters, each weighted by DECAY to the length it spans in
both strings, so gaps and inserted characters only lower it. A unit's features are its normalised kernel values with the
landmarks, whitened by the landmarks' own kernel matrix. The machine is trained on units of labelled sentences: toxic
labels hold for whole documents, so the units that explain them are found first, by greedy cover with character n-grams that toxic
documents share and clean ones lack; then clean units that score highest are added in rounds. A document scores as its worst
unit, turned into a probability by a logistic fit on the training documents.

Training takes a bounded sample: about SAMPLE documents of each label, those with the least hashes of doc_id; texts of more than LONGEST characters
don't teach, as a label says little about any one sentence of theirs. It runs in one task; the driver gets the model alone.
Defined results: null, empty and wordless texts get the score of a text with no suspicious unit; labels that are
null don't teach; without labels of both kinds every score is 0; repeated rows give repeated results.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import Memo, arrow, forget, only, split_words

#: At most about so many labelled documents, clean and toxic, teach the model; of the clean ones' units, so many.
SAMPLE, CLEAN_UNITS, LONGEST = (3000, 1500), 30_000, 50_000
#: Kernel: weight of a character spanned, weight of common pairs against common triples, most characters in a unit.
DECAY, PAIRS, WINDOW = 0.6, 0.5, 9
LANDMARKS = 40
#: Of these, as many are kept for clean units that earlier rounds took for toxic.
HARD = 15
#: Stands before the first unit of a word, so that the kernel knows beginnings.
BEGIN = "\x02"
#: What an n-gram must say for toxicity, in nats, above the logarithm of how many n-grams there are.
EVIDENCE = 1.5
#: At most this share of clean documents may have log odds above LOW, which is a score of 0.25; but margins above SURE may always.
CALM, LOW, SURE = 0.01, -1.1, 0.8

_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]{0,2}[ \t]+){2,}\w(?!\w)")
#: In every text with such a run, in the syntax of Arrow's regular expressions.
SPACED_HINT = r"(^|\s)[\pL\pN_]\S{0,2}[ \t]+[\pL\pN_]\S{0,2}[ \t]+[\pL\pN_]"
#: Trimmed from words before they are looked up.
MARKS = ".,;:!?$%&*#()-+=/@_\"'"
_EDGES = re.compile(r"^\W+|\W+$")


def units_of(word: str) -> list[str]:
    """The units of one word: itself, or windows of WINDOW characters that overlap by more than half.

    A word with marks between its letters gives those of its letters alone as well, for the kernel bridges only gaps within a window.
    """
    w = word.lower()
    if not w.isalnum():
        w = _EDGES.sub("", w)
    if len(w) < 3:
        return []
    forms = (BEGIN + w,) if w.isalnum() else dict.fromkeys((BEGIN + w, BEGIN + "".join(filter(str.isalnum, w))))
    step = WINDOW // 3
    return [x[a : a + WINDOW] for x in forms for a in range(0, max(1, len(x) - WINDOW + step), step)]


def words_of(text: str | None) -> list[str]:
    """Words of a text, with runs of single characters joined as further words."""
    if not text:
        return []
    return text.split() + joined(text)


def joined(text: str) -> list[str]:
    return ["".join(m.split()) for m in _SPACED.findall(text)]


def codes(strings: list[str], size: int) -> np.ndarray:
    """Code points, padded with -1."""
    out = np.full((len(strings), size), -1, np.int32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.arange(size) < lengths[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def _kernel(u: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of code rows that broadcast against each other but for the last axis; -1 in t matches nothing.

    sums[q][j] holds the subsequences of q+1 characters that end at or before (i, j), decayed to (i, j), for the row before;
    along a row they build up in line[q].
    """
    shape, m = np.broadcast_shapes(u.shape[:-1], t.shape[:-1]), t.shape[-1]
    d, dd = np.float32(DECAY), np.float32(DECAY * DECAY)
    new = lambda: np.zeros(shape, np.float32)
    sums, following = ([[new() for _ in range(m)] for _ in range(2)] for _ in range(2))
    pairs, triples, line = new(), new(), [new(), new()]
    match, two = new(), new()
    for i in range(u.shape[-1]):
        line[0][...] = 0
        line[1][...] = 0
        for j in range(m):
            np.multiply(u[..., i] == t[..., j], dd, out=match)
            line[0] *= d
            line[0] += match
            np.multiply(sums[0][j], d, out=following[0][j])
            following[0][j] += line[0]
            line[1] *= d
            if i and j:
                np.multiply(match, sums[0][j - 1], out=two)
                pairs += two
                line[1] += two
                match *= sums[1][j - 1]
                triples += match
            np.multiply(sums[1][j], d, out=following[1][j])
            following[1][j] += line[1]
        sums, following = following, sums
    pairs *= np.float32(PAIRS)
    return pairs + triples


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel matrix; units that share nothing, even with themselves, have 0."""
    out = np.zeros((len(left), len(right)), np.float32)
    t = codes(right, max(map(len, right), default=1))
    own = np.ones(len(right), np.float32)
    for i, s in enumerate(right):
        c = codes([s], len(s))
        own[i] = np.sqrt(max(float(_kernel(c, c)[0]), 1e-12))
    by_length = defaultdict(list)
    for i, s in enumerate(left):
        by_length[len(s)].append(i)
    for n, which in by_length.items():
        for a in range(0, len(which), 256):
            part = which[a : a + 256]
            u = codes([left[i] for i in part], n)
            mine = np.sqrt(np.maximum(_kernel(u, u), 1e-12))
            out[part] = _kernel(u[:, None], t[None]) / (mine[:, None] * own[None])
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    floor: float

    @cached_property
    def subsequences(self) -> tuple[np.ndarray, ...]:
        """What each subsequence adds to the margin of a unit that has it, over all landmarks.

        The letters of landmarks in order; the number of each pair of them (by place in letters + 1; 0 stands for all others) that a landmark has; what a
        pair adds, by number; what a pair adds with a third letter after it, by number and letter. At most some thousand pairs, as landmarks are few and short.
        """
        letters = sorted(set(map(ord, "".join(self.landmarks))))
        place = {c: k for k, c in enumerate(letters, 1)}
        twos, threes = defaultdict(float), defaultdict(float)
        for t, weight in zip(self.landmarks, self.weights.tolist(), strict=True):
            c = codes([t], len(t))
            weight /= np.sqrt(max(float(_kernel(c, c)[0]), 1e-12))
            at = [place[ord(x)] for x in t]
            for i, j in combinations(range(len(t)), 2):
                twos[at[i], at[j]] += PAIRS * DECAY ** (j - i + 1) * weight
                for k in range(j + 1, len(t)):
                    threes[at[i], at[j], at[k]] += DECAY ** (k - i + 1) * weight
        number = {p: k for k, p in enumerate(twos, 1)}
        size = len(letters) + 1
        pair, two, three = np.zeros((size, size), np.int64), np.zeros(len(number) + 1), np.zeros((len(number) + 1, size))
        for (a, b), k in number.items():
            pair[a, b], two[k] = k, twos[a, b]
        for (a, b, c), v in threes.items():
            three[number[a, b], c] = v
        return np.array(letters, np.int32), pair, two, three

    def margins(self, units: list[str]) -> np.ndarray:
        """kernel(units, self.landmarks) @ self.weights + self.bias; the sum over landmarks is made once for each subsequence, not for each unit."""
        letters, pair, two, three = self.subsequences
        out, by_length = np.zeros(len(units)), defaultdict(list)
        for i, s in enumerate(units):
            by_length[len(s)].append(i)
        for n, which in by_length.items():
            for a in range(0, len(which), 4096):
                part = which[a : a + 4096]
                u = codes([units[i] for i in part], n)
                near = np.minimum(np.searchsorted(letters, u), max(len(letters) - 1, 0))
                at = np.ascontiguousarray(np.where(letters[near] == u, near + 1, 0).T) if len(letters) else np.zeros(u.T.shape, np.int64)
                total = np.zeros(len(part))
                for i, j in combinations(range(n), 2):
                    p = pair[at[i], at[j]]
                    total += two[p] * DECAY ** (j - i + 1)
                    row = p * three.shape[1]
                    for k in range(j + 1, n):
                        total += three.ravel()[row + at[k]] * DECAY ** (k - i + 1)
                out[part] = total / np.sqrt(np.maximum(_kernel(u, u), 1e-12))
        return out + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.tanh(margin) + self.shift, -40, 40)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton's method; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, ridge = np.zeros(x1.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        active = y * (x1 @ w) < 1
        xa = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + 2 * cost * xa.T @ x1[active], 2 * cost * xa.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = 0.5 * w + 0.5 * new if _ > 25 else new
    return w[:-1], float(w[-1])


def witnesses(toxic: list[list[str]], clean: Counter, clean_docs: int) -> list[str]:
    """Character n-grams that toxic documents share and clean ones lack, the weightiest first.

    toxic has the words of each document in order; clean has the words of clean documents and in how many each is. An n-gram
    counts once for each document and for each pair of words around it, whichever is less, so that what near copies of
    one toxic document share doesn't look like evidence. It must stand out beyond chance, given how many n-grams there are. Words that one
    n-gram explains say nothing for others.
    """
    places, docs = defaultdict(set), defaultdict(set)
    for k, words in enumerate(toxic):
        for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            if w not in clean and len(w) > 3:
                places[w].add(hash_of(before, after))
                docs[w].add(k)
    holders = defaultdict(set)
    for w in places:
        for g in grams_of([w]):
            holders[g].add(w)
    rate = max(0.2, len(toxic) / (len(toxic) + clean_docs))
    enough = EVIDENCE + np.log(len(holders) + 1)
    holders = {g: s for g, s in holders.items() if sum(len(docs[w]) for w in s) * -np.log(rate) >= enough}
    found: Counter = Counter()
    for w, n in clean.items():
        for g in grams_of([w]):
            if g in holders:
                found[g] += n

    def evidence(g: str) -> float:
        k, c = min(len(set().union(*(x[w] for w in holders[g]))) for x in (places, docs)), found[g]
        share = k / (k + c) if k else 0.0
        return 0.0 if share <= max(rate, 0.5) else k * np.log(share / rate) + (c * np.log((1 - share) / (1 - rate)) if c else 0.0)

    chosen: list[str] = []
    ranked = {g: evidence(g) for g in holders}
    while ranked and len(chosen) < 3 * LANDMARKS:
        g = max(ranked, key=lambda x: (ranked[x], len(x), x))
        if ranked[g] < enough:
            break
        chosen.append(g)
        explained = holders[g]
        for x in [x for x, s in holders.items() if not s.isdisjoint(explained)]:
            holders[x] = holders[x] - explained
            ranked[x] = evidence(x)
        ranked = {x: v for x, v in ranked.items() if v >= enough}
        holders = {x: holders[x] for x in ranked}
    return chosen


def hash_of(*parts: str) -> int:
    return zlib.crc32("\n".join(parts).encode("utf-8", "surrogatepass"))


def grams_of(words: list[str]) -> set[str]:
    return {w[a : a + n] for w in words for n in (4, 5, 6) for a in range(len(w) - n + 1)}


def train(docs: list[tuple[str, int]]) -> Model | None:
    """Fits the model to (text, label 0 or 1) of the sample."""
    plain = lambda text: [w for x in words_of(text) if len(w := _EDGES.sub("", x.lower())) > 2]
    toxic = [plain(t) for t, y in docs if y == 1]
    clean = [sorted(set(plain(t))) for t, y in docs if y == 0]
    if not toxic or not clean:
        return None
    # Two thirds of the clean documents teach the machine; the others show what its margins are worth.
    shown = clean[::3] if len(clean) > 2 else clean
    clean = [w for k, w in enumerate(clean) if k % 3] if len(clean) > 2 else clean
    frequent = Counter(chain.from_iterable(clean))
    marks = witnesses(toxic, frequent, len(clean))
    toxic = [sorted(set(words)) for words in toxic]
    if not marks:
        return None
    find = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True))))
    seen = Counter(u for words in toxic for w in words if find.search(w) for u in units_of(w) if find.search(u))
    positive = [u for u, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    held_by: Counter = Counter()  # clean units, and in about how many documents each is
    for w, n in frequent.items():
        for u in units_of(w):
            held_by[u] += n
    for u in positive:
        held_by.pop(u, None)
    # all clean units that several documents hold, and of the others some
    pool = sorted(u for u, n in held_by.items() if n > 2)
    rest = sorted(u for u, n in held_by.items() if n <= 2)
    rng = np.random.default_rng(7)
    if len(pool) > CLEAN_UNITS:
        pool = sorted(sorted(pool, key=lambda u: (-held_by[u], u))[:CLEAN_UNITS])
    if len(rest) > CLEAN_UNITS:
        rest = [rest[i] for i in sorted(rng.choice(len(rest), CLEAN_UNITS, replace=False))]
    pool += rest
    share = np.array([held_by[u] for u in pool], float) / len(clean)
    # Landmarks: for each n-gram in turn its commonest unit, then the clean units most like those, by turns.
    landmarks: list[str] = []
    for g in marks[: LANDMARKS // 2]:
        if (u := next((p for p in positive if g in p and p not in landmarks), None)) is not None:
            landmarks.append(u)
    alike = kernel(pool, landmarks)
    nearest = [pool[i] for row in np.argsort(-alike, axis=0, kind="stable")[:8] for i in row]
    landmarks += [u for u in dict.fromkeys(nearest) if u not in landmarks][: max(0, LANDMARKS - HARD - len(landmarks))]
    # Rounds: units that score as toxic become examples, and the most widespread of them landmarks.
    chosen = set(np.argsort(-share, kind="stable")[:3000].tolist()) | set(range(0, len(pool), max(1, len(pool) // 2000)))
    pool_k, positive_k = kernel(pool, landmarks), kernel(positive, landmarks)
    rounds = 4
    for turn in range(rounds):
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
        near = sorted(chosen)
        x = np.vstack([positive_k, pool_k[near]]) @ whiten
        y = np.array([1.0] * len(positive) + [-1.0] * len(near))
        spread = 1 + np.minimum(50 * np.sqrt(share[near]), 10)
        weight = np.concatenate([np.full(len(positive), 500 / len(positive)), 500 * spread / spread.sum()])
        w, bias = machine(x, y, weight)
        margins = pool_k @ (whiten @ w) + bias
        chosen |= set(np.argsort(-margins, kind="stable")[:1500].tolist())
        if turn < rounds - 1:
            worst = np.argsort(-np.maximum(margins + 0.7, 0) * np.sqrt(share), kind="stable")
            fresh = [pool[i] for i in worst[: 3 * LANDMARKS] if pool[i] not in landmarks and margins[i] > -0.7][: -(-HARD // (rounds - 1))]
            fresh = fresh[: LANDMARKS - len(landmarks)]
            if fresh:
                landmarks += fresh
                pool_k, positive_k = np.hstack([pool_k, kernel(pool, fresh)]), np.hstack([positive_k, kernel(positive, fresh)])
    model = Model(landmarks, (whiten @ w).astype(np.float32), bias, 1.0, 0.0, -2.0)
    # The worst unit of each document, by one bulk pass over the distinct units.
    units = sorted({u for words in toxic + shown for w in words for u in units_of(w)})
    margin = dict(zip(units, model.margins(units).tolist(), strict=True))
    worst_of = np.array([max((margin[u] for w in words for u in units_of(w)), default=model.floor) for words in toxic + shown])
    label = np.array([1.0] * len(toxic) + [0.0] * len(shown))
    bounded = np.tanh(np.maximum(worst_of, model.floor))
    model.slope, model.shift = logistic(bounded, label, np.array([1.0] * len(toxic) + [3.0] * len(shown)))
    # of the clean documents kept aside no more than CALM may come near the usual limit of 0.3, unless they look toxic through and through
    calm = min(float(np.quantile(bounded[len(toxic) :], 1 - CALM)), np.tanh(SURE))
    if model.slope * calm + model.shift > LOW:
        model.slope = max(model.slope, -LOW / (np.tanh(1.0) - calm))  # a margin of 1 still means more likely toxic than not
        model.shift = LOW - model.slope * calm
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, with Platt's softened targets; the slope is not negative."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.column_stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2), z.T @ (weight * (target - p)) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.1), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(2.0**64 * min(1.0, SAMPLE[k] / max(sizes.get(k, 0), 1)) - 2.0**63)) for k in (0, 1)))
    sample = known.filter(F.xxhash64("doc_id").cast("double") < share[F.col("toxic")])
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    arrow(spark)
    made = rows.repartition(1).mapInArrow(_train, "model binary").collect()  # about sum(SAMPLE) rows in one task, and one row from it
    return pickle.loads(bytes(made[0]["model"])) if made else None


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    docs = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    model = train([(text, toxic) for _, text, toxic in docs])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


class Scorer:
    """Scores texts in one worker; what words say is remembered."""

    def __init__(self, model: Model | None, most: int = 220_000):
        self.model, self.floor = model, model.floor if model else 0.0
        self.memo = Memo(self._margins, most)

    def _margins(self, words: list[str]) -> list[float]:
        units = [units_of(w) for w in words]
        flat = list(dict.fromkeys(chain.from_iterable(units)))
        values = dict(zip(flat, np.maximum(self.model.margins(flat), self.floor).tolist(), strict=True))
        return [max((values[u] for u in us), default=self.floor) for us in units]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        """Scores, and the words that they come from."""
        worst, which = np.full(len(texts), self.floor), [None] * len(texts)
        if not self.model:
            return worst, which
        distinct, at, ends = split_words(texts)
        coded = pc.utf8_lower(pc.utf8_trim(distinct, MARKS)).dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[at]
        spaced = {i: joined(texts[i].as_py()) for i in np.flatnonzero(pc.match_substring_regex(texts.fill_null(""), SPACED_HINT).to_numpy(zero_copy_only=False))}
        self.memo.learn([*words, *chain.from_iterable(spaced.values())])
        values = np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))[at]
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a and values[top := a + int(np.argmax(values[a:b]))] > self.floor:
                worst[i], which[i] = values[top], words[at[top]]
            for w in spaced.get(i, ()):
                if self.memo[w] > worst[i]:
                    worst[i], which[i] = self.memo[w], w
        return self.model.probability(worst), which


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) as (doc_id, score, worst): score from 0 to 1, and the word that it comes from."""
    arrow(docs.sparkSession)
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = only(key, lambda: Scorer(held.value))
        for batch in batches:
            scores, which = scorer.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(which, pa.string())], ["doc_id", "score", "worst"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst string")


def kept(docs: DataFrame, model: Model | None, limit: float) -> DataFrame:
    """The rows of docs, with all their columns, that score below limit."""
    arrow(docs.sparkSession)
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = only(key, lambda: Scorer(held.value))
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column("text"))[0] < limit))

    return docs.mapInArrow(sift, docs.schema)
