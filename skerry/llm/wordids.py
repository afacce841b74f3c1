"""Token ids of whole texts by the tokenizers library, with its work on repeated words remembered."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skerry.llm.common import Memo, only, split_words

#: Characters at which str.split() parts a text but the tokenizer's white space does not, and the marks of added tokens.
_UNSAFE = "[\\x1c-\\x1f]|<\\|"


STOPS = ".,;:!?$%&*#()-+=/@_"
_TAIL = r"(?P<stops>[.,;:!?$%&*#()\-+=/@_]*)$"
#: Letters below U+0600 but for three: each is in normal form, and its lower case is one letter wherever it stands.
_CASED = r"^[^\x{0130}\x{0374}\x{03A3}\x{0600}-\x{10FFFF}]*$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Little-endian unsigned 32-bit ids of texts.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its words,
    one after the other. A word of letters with plain stops behind it parts into just those two. New letter runs go
    through the library's model together, already lower-cased; other words go through the whole of the library, and so do texts
    with characters for which the above does not hold. Null and empty texts: no ids. At most about `most` runs are remembered.
    """

    def __init__(self, path: str, most: int = 220_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        #: The file's own steps before the model, and those that letter runs need: none but the byte alphabet.
        self._own = (self._tokenizer.normalizer, self._tokenizer.pre_tokenizer)
        self._bare = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        ids = self._tokenizer.get_vocab()
        self._last = np.zeros(max(ids.values()) + 1, bool)
        self._last[[i for word, i in ids.items() if word.endswith("</w>")]] = True
        self._runs, self._others = Memo(self._of_runs, most), Memo(lambda words: list(map(self._library, words)), most // 4)

    def _library(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_runs(self, runs: list[str]) -> list[bytes]:
        self._tokenizer.normalizer, self._tokenizer.pre_tokenizer = self._bare
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        self._tokenizer.normalizer, self._tokenizer.pre_tokenizer = self._own
        cuts = np.concatenate([[0], np.flatnonzero(self._last[ids]) + 1])
        if len(cuts) != len(runs) + 1:  # a run that the pre-tokenizer parts once more
            return list(map(self._library, runs))
        places, raw = (4 * cuts).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip(places, places[1:], strict=False)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        distinct, at, ends = split_words(texts)
        core = pc.utf8_rtrim(distinct, STOPS)
        plain = pc.and_(pc.utf8_is_alpha(core), pc.match_substring_regex(core, _CASED))
        runs = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        stops = pc.struct_field(pc.extract_regex(distinct.filter(plain), _TAIL), 0).dictionary_encode()
        rest = distinct.filter(pc.invert(plain)).to_pylist()
        run_list, stop_list = runs.dictionary.to_pylist(), stops.dictionary.to_pylist()
        self._runs.learn(run_list)
        self._others.learn([*rest, *stop_list])
        pool = [*map(self._runs.__getitem__, run_list), *map(self._others.__getitem__, stop_list), *map(self._others.__getitem__, rest), b""]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        first, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pool), "<u4")
        # each word is two entries of the pool: a run and its stops, or another word and nothing
        is_plain = plain.to_numpy(zero_copy_only=False)
        two = np.full((len(is_plain), 2), len(pool) - 1)
        two[is_plain, 0] = runs.indices.to_numpy()
        two[is_plain, 1] = len(run_list) + stops.indices.to_numpy()
        two[~is_plain, 0] = len(run_list) + len(stop_list) + np.arange(len(rest))
        entries = two[at].ravel()
        entries = entries[sizes[entries] > 0] if (some := sizes[two].sum(axis=1)).size else entries
        n = sizes[entries]
        until = np.cumsum(n)
        flat = ids[np.repeat(first[entries] - (until - n), n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], np.cumsum(some[at])])[ends]
        unsafe = set(np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)))
        return [self._library(texts[i].as_py()) if i in unsafe else flat[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def word_ids(path: str) -> WordIds:
    """The worker process's encoder for a file."""
    return only(("word ids", path), lambda: WordIds(path))
