"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The model's pieces and scores come from a sentencepiece file; segmentation is done here. Adjacent symbols whose joined text is a
piece are candidates on an agenda, the best score first, the leftmost among equals. A candidate that comes up is skipped if a hash
of (seed, key of its document, place, unit, start, end) falls below the dropout rate, else merged. A unit is a word with the space before it:
no piece reaches across that. So each occurrence of a word is drawn anew, the same way on every run. With dropout 0 the ids are sentencepiece's own.

Units of a batch are processed side by side: each round takes the best candidate of every unit (`lockstep`). What comes of a unit depends only
on which candidates were skipped, so occurrences share the work as long as their draws skip the same ones (`Encoder._drawn`); long units use
an agenda of their own for each occurrence (`agenda`). Characters without a piece, and the space mark U+2581 itself, become byte pieces, so decoding gives back every text.
Defined results: null text counts as empty; an empty text has no ids; repeated rows get equal ids; the key of a document is its doc_id (null: 0).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import U64, arrow, mix, only
from skerry.llm.shingles import string_hashes

SPACE = "▁"
DROPOUT, SEED = 0.1, 42
#: Units of more symbols than this go to an agenda of their own.
LONG = 128
#: Units that go side by side.
CHUNK = 1 << 14
#: Texts that are encoded together; their working memory is many times their size.
TOGETHER = 2500


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores, and the table of pairs of pieces that make a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        bytes_of = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = np.array([model.get_score(i) for i in range(size)], np.float32)
        self.worth = np.append(self.score, np.float32(-np.inf))  # that of no piece, -1, is the last
        self.byte = np.array([bytes_of[b] for b in range(256)], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, i in self.ids.items():
            if len(name) == 1 and name != SPACE:
                self.of_char[ord(name)] = i
        self.space = self.ids[SPACE]
        pairs = {}
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                a, b = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = i
        self.pairs = pairs
        # open addressing, for looking up many pairs at once
        bits = max(12, (4 * len(pairs)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, U64(64 - bits)
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        for (key, i), at in zip(pairs.items(), self._cells(np.fromiter(pairs, np.int64, len(pairs))).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, i
        texts = [b""] * size
        for name, i in self.ids.items():
            texts[i] = name.replace(SPACE, " ").encode()
        for b, i in bytes_of.items():
            texts[i] = bytes((b,))
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_size = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size

    def _cells(self, key: np.ndarray) -> np.ndarray:
        """Where in the table the search for each key begins."""
        with np.errstate(over="ignore"):
            return (key.view(U64) * U64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1; negative symbols make none."""
        key = a << 16 | b  # negative where a symbol is, and so in no cell of the table; -1 marks its free cells, which hold -1
        at = self._cells(key)
        there = self.keys.take(at)
        hit = there == key
        out = np.where(hit, self.values.take(at), np.int32(-1))
        open_ = np.flatnonzero(~hit & (there >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            there = self.keys.take(at)
            hit = there == key[open_]
            out[open_[hit]] = self.values.take(at[hit])
            more = ~hit & (there >= 0)
            open_, at = open_[more], at[more]
        return out


def skipped(keys: np.ndarray, start: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Which candidates dropout skips."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.asarray(start, U64) * U64(0x9E3779B97F4A7C15) + np.asarray(end, U64) * U64(0xD6E8FEB86659FD93))
    return (h >> U64(11)).astype(np.float64) * 2.0**-53 < rate


def agenda(v: Vocabulary, symbols: list[int], key: int, rate: float) -> list[int]:
    """The symbols of one unit after merging, with a heap."""
    n = len(symbols)
    sym, left, right, end = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (made := v.pairs.get(sym[i] << 16 | sym[j])) is not None:
            heapq.heappush(heap, (-float(v.score[made]), i, end[j], end[i], made))

    alive = [True] * n
    for i in range(n - 1):
        offer(i)
    k = np.array([key], U64)
    while heap:
        _, i, stop, middle, made = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or end[i] != middle or end[j] != stop or skipped(k, np.array([i]), np.array([stop]), rate)[0]:
            continue
        sym[i], end[i], alive[j] = made, stop, False
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [s for s, a in zip(sym, alive, strict=True) if a]


def lockstep(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float, forced: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The same for many units at once: symbols is units x columns, filled with -1 behind each length. Returns symbols and which are alive.

    With `forced`, units x skips, a unit skips just these candidates (start * 256 + end) in the order in which they come up, and the candidates
    merged after the last of them are returned too: their units and names, by unit and then in order.
    """
    units, columns = symbols.shape
    # cells in one line, a unit after the other, with an empty cell (-1, which joins nothing) behind each; what lies before the first is the last of these
    width = columns + 1
    grid = np.full((units, width), -1, np.int64)
    grid[:, :columns] = symbols
    sym, place = grid.ravel(), np.arange(units * width)
    live = np.zeros((units, width), bool)
    live[:, :columns] = np.arange(columns) < lengths[:, None]
    alive, right, left = live.ravel(), place + 1, place - 1
    end = np.tile(np.arange(1, width + 1), units)
    made = np.full(units * width, -1, np.int32)
    made[:-1] = v.join(sym[:-1], sym[1:])
    score = v.worth.take(made)
    table, rows = score.reshape(units, width), np.arange(units)
    if forced is not None:
        forced = np.concatenate([forced, np.full((units, 1), -1, np.int64)], axis=1)
        free = forced.shape[1] == 1
        passed, trace = np.zeros(units, np.int64), []
    while len(rows):
        i = np.argmax(table.take(rows, axis=0), axis=1)
        cell = rows * width + i
        some = score.take(cell) > -np.inf
        if not some.all():
            rows, i, cell = rows[some], i[some], cell[some]
            if not len(rows):
                break
        other = right.take(cell)
        stop = end.take(other)
        if forced is not None and free:
            trace.append((rows, i * 256 + stop))
        else:
            if forced is None:
                skip = skipped(keys[rows], i, stop, rate)
            else:
                name = i * 256 + stop
                skip = name == forced[rows, passed[rows]]
                passed[rows[skip]] += 1
                late = ~skip & (passed[rows] == forced.shape[1] - 1)
                trace.append((rows[late], name[late]))
            score[cell[skip]] = -np.inf
            cell, other, stop = cell[~skip], other[~skip], stop[~skip]
        sym[cell], end[cell] = made.take(cell), stop
        alive[other] = False
        score[other] = -np.inf
        after, before = right.take(other), left.take(cell)
        right[cell] = after
        left[after] = cell
        first, second = np.concatenate([cell, before]), np.concatenate([after, cell])
        m = v.join(sym.take(first), sym.take(second))
        made[first] = m
        score[first] = v.worth.take(m)
    sym, alive = grid[:, :columns], live[:, :columns]
    if forced is None:
        return sym, alive
    of, names = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in trace)]) for k in (0, 1))
    order = np.argsort(of, kind="stable")
    return sym, alive, of[order], names[order]


class Encoder:
    def __init__(self, path: str, rate: float = DROPOUT, seed: int = SEED, variants: int | None = None):
        self.v, self.rate, self.seed, self.variants = Vocabulary(path), rate, seed, variants

    def _units(self, units: list[str], at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units at[k] drawn with keys[k], for all k: ids one result after the other, how many each has, and the result of each k.

        A unit is given without the spaces that it begins with, as "\\x00" for each.
        """
        lengths = np.array(list(map(len, units)), np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        symbols = self.v.of_char[points].astype(np.int64)
        symbols = np.where(symbols < 0, -2 - points, symbols)
        symbols[points == _MARK] = self.v.space
        result = np.zeros(len(at), np.int64)
        pools, made = [], 0
        # bands of similar length, so that little is padding
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, 72), (72, LONG)):
            mine = np.flatnonzero((lengths[at] > low) & (lengths[at] <= high))
            # node: a unit and what was skipped so far
            which, node = np.unique(at[mine], return_inverse=True)
            forced = np.zeros((len(which), 0), np.int64)
            while len(mine):
                result[mine] = made + node
                traces, counts = [], np.zeros(len(which), np.int64)
                for a in range(0, len(which), CHUNK):
                    part = which[a : a + CHUNK]
                    n = lengths[part]
                    cells = np.arange(high)[None, :] < n[:, None]
                    dense = np.full(cells.shape, -1, np.int64)
                    dense[cells] = symbols[np.repeat(begins[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    sym, alive, of, names = lockstep(self.v, dense, n, None, self.rate, forced[a : a + CHUNK])
                    pools.append((made + a + np.arange(len(part)), sym[alive], alive.sum(axis=1)))
                    traces.append(names)
                    counts[a : a + CHUNK] = np.bincount(of, minlength=len(part))
                made += len(which)
                if not self.rate:
                    break
                mine, node, which, forced = self._drawn(keys, mine, node, which, forced, np.concatenate(traces), counts)
        for k in np.flatnonzero(lengths[at] > LONG):
            u = at[k]
            got = agenda(self.v, symbols[begins[u] : begins[u] + lengths[u]].tolist(), int(keys[k]), self.rate)
            pools.append((np.array([made]), np.array(got, np.int64), np.array([len(got)])))
            result[k], made = made, made + 1
        flat = np.concatenate([p[1] for p in pools]) if pools else np.zeros(0, np.int64)
        owner = np.concatenate([np.repeat(p[0], p[2]) for p in pools]) if pools else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order], owner[order]
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            encoded = [chr(-2 - c).encode("utf-8", "surrogatepass") for c in flat[odd].tolist()]
            copies = np.ones(len(flat), np.int64)
            copies[odd] = list(map(len, encoded))
            at = np.repeat(flat < 0, copies)
            flat, owner = np.repeat(flat, copies), np.repeat(owner, copies)
            flat[at] = self.v.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        return flat, np.bincount(owner, minlength=made), result

    def _drawn(self, keys, mine, node, which, forced, names, counts):
        """The occurrences that skip one more candidate of their node's trace, and the nodes that the first such candidate leads to."""
        first = np.cumsum(counts) - counts
        hit = np.full(len(mine), -1, np.int64)
        for a in range(0, len(mine), CHUNK):
            n = counts[node[a : a + CHUNK]]
            owner = np.repeat(np.arange(a, a + len(n)), n)
            spot = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[node[owner]]
            skip = np.flatnonzero(skipped(keys[mine[owner]], names[spot] >> 8, names[spot] & 255, self.rate))
            who, where = np.unique(owner[skip], return_index=True)
            hit[who] = spot[skip[where]]
        more = np.flatnonzero(hit >= 0)
        # a place in the traces names a node and a candidate
        spots, child = np.unique(hit[more], return_inverse=True)
        parent = np.searchsorted(np.cumsum(counts), spots, "right")
        return mine[more], child, which[parent], np.concatenate([forced[parent], names[spots, None]], axis=1)

    def encode(self, texts: pa.Array, doc_keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; doc_keys has a 64-bit number for each."""
        texts = texts.cast(pa.large_string()).fill_null("")
        parts = pc.split_pattern(texts, " ")
        cuts = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(parts.offsets) else 0)
        coded = parts.flatten().dictionary_encode()
        strings, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        units = [chr(_MARK) + s for s in strings.to_pylist()]
        # runs of spaces belong to the word after them
        empty = pc.index(strings, "").as_py()
        if empty >= 0:
            hollow = at == empty
            last = np.zeros(len(at), bool)
            last[cuts[1:] - 1] = True
            run = hollow & ~last
            whole = np.flatnonzero(~run)
            before = np.diff(np.concatenate([[-1], whole])) - 1
            more: dict[tuple[int, int], int] = {}
            fresh = at[whole].copy()
            for w in np.flatnonzero(before):
                key = (int(fresh[w]), int(before[w]))
                if key not in more:
                    more[key] = len(units)
                    units.append(chr(_MARK) * key[1] + units[key[0]])
                fresh[w] = more[key]
            kept = np.concatenate([[0], np.cumsum(~run)])[cuts]
            # an empty text has no unit at all
            blank = np.asarray(pc.equal(texts, "").to_numpy(zero_copy_only=False), bool)
            drop = np.zeros(len(whole), bool)
            drop[kept[:-1][blank]] = True
            at, cuts = fresh[~drop], np.concatenate([[0], np.cumsum(~drop)])[kept]
        hashes = string_hashes(pa.array(units, pa.large_string())) if units else np.zeros(0, U64)
        with np.errstate(over="ignore"):
            place = np.arange(len(at)) - np.repeat(cuts[:-1], np.diff(cuts))
            draw = mix(np.repeat(np.asarray(doc_keys, U64), np.diff(cuts)) + mix(place.astype(U64) + U64(self.seed)))
            if self.variants:
                draw = draw % U64(self.variants)
            keys = mix(hashes[at] + mix(draw + U64(self.seed)))
        flat, sizes, which = self._units(units, at, keys)
        first, n = np.cumsum(sizes) - sizes, sizes[which]
        until = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[which] - until[:-1], n) + np.arange(until[-1])].astype(np.int32)
        ends = until[cuts]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the text that ids stand for."""
        n = self.v.text_size[ids]
        until = np.cumsum(n)
        raw = self.v.text[np.repeat(self.v.text_at[ids] - (until - n), n) + np.arange(until[-1] if len(until) else 0)].tobytes()
        return raw[1:]


#: Stands for one leading space in a unit; a code point that no text holds.
_MARK = 0x10FFFF


def encoder(*key) -> Encoder:
    """The worker process's encoder for a set of parameters."""
    return only(("pieces", *key), lambda: Encoder(*key))


def encode(docs: DataFrame, path: str, rate: float = DROPOUT, seed: int = SEED, variants: int | None = None) -> DataFrame:
    """docs(doc_id, text) as (doc_id, text, ids)."""
    arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, rate, seed, variants)
        for batch in batches:
            for part in (batch.slice(a, TOGETHER) for a in range(0, batch.num_rows, TOGETHER)):
                keys = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).view(U64)
                ids = coder.encode(part.column("text"), keys)
                ends = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), lists], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def digests(encoded: DataFrame, path: str, rate: float = DROPOUT, seed: int = SEED, variants: int | None = None) -> DataFrame:
    """encoded(doc_id, text, ids) as (doc_id, n_tokens, ids_crc32, text_crc32, lossless): ids are decoded, and lossless says whether that gives text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, rate, seed, variants)
        for batch in batches:
            lists = batch.column("ids")
            cuts, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            rows = []
            for a, b, text in zip(cuts[:-1], cuts[1:], batch.column("text").to_pylist(), strict=True):
                back = coder.decode(ids[a:b])
                rows.append((int(b - a), zlib.crc32(ids[a:b].astype("<u4")), zlib.crc32(back), back == (text or "").encode("utf-8", "surrogatepass")))
            n, crc, text_crc, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "text_crc32", "lossless"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, lossless boolean")
