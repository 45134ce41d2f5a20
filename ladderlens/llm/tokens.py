"""Token ids of whole texts by a public tokenizer with word ends.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words
in order. Arrow splits a block of texts and numbers its different words; only words that the worker has
not met lately are encoded, all of a block together, and the ids are put in place by numbers.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ladderlens.llm.common import claim

END_ID = 2
#: Words, and words without case and marks, that a worker keeps in each of two generations.
KEPT_WORDS = 300_000
#: Bytes of text whose words are numbered together.
WORDS_AT_ONCE = 3 << 20
#: Marks that may follow a word's letters; a run of them is one piece of its own.
TAIL = ".,!?;:)]}\"|"

OWNER = "tokens"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    """The worker's own encoder for a tokenizer file."""
    kept = claim(OWNER)
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


class Recent(dict):
    """A dictionary that lets go of what was not asked for during the last KEPT_WORDS additions."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def found(self, keys: list[str]) -> tuple[list, list[int]]:
        """The value of each key, and the places of keys that have none."""
        values, old, lacking = list(map(self.get, keys)), self.old.get, []
        for i in [i for i, x in enumerate(values) if x is None]:
            value = old(keys[i])
            if value is None:
                lacking.append(i)
            else:
                values[i] = self[keys[i]] = value
        return values, lacking

    def settle(self) -> None:
        if len(self) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.words, self.cores, self.tails = Recent(), Recent(), {"": b""}

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """A word of letters and a run of marks is one closed piece, whatever its case, and the marks' ids, so
        the letters of such words are encoded as one text and told apart by the pieces' ends; other words
        are encoded one by one."""
        plain, rest, lows = [], [], []
        for word in words:
            core = word.rstrip(TAIL)
            if core.isalpha() and (core.isascii() or max(core) < "İ"):
                plain.append(word)
                low = core.lower()
                lows.append(word if low == word else low)  # a word that is its own core shares the string
            else:
                rest.append(word)
        _, lacking = self.cores.found(lows)
        fresh = dict.fromkeys([lows[i] for i in lacking])
        fresh = list(fresh)
        texts = [" ".join(fresh[i : i + 500]) for i in range(0, len(fresh), 500)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), dtype=self.kind)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(fresh):
            raise ValueError("the tokenizer does not close each word once")
        raw, low = ids.tobytes(), 0
        for core, high in zip(fresh, (ends * self.kind.itemsize).tolist()):
            self.cores[core] = raw[low:high]
            low = high
        tails = [word[len(low) :] for word, low in zip(plain, lows)]
        new = [x for x in set(tails) if x not in self.tails]
        self.tails.update(zip(new, self._encoded(new)))
        cores, known = self.cores, self.tails
        self.words.update((word, cores[low] + known[tail] if tail else cores[low]) for word, low, tail in zip(plain, lows, tails))
        self.words.update(zip(rest, self._encoded(rest)))

    @staticmethod
    def _listed(words: pa.StringArray) -> list[str]:
        """The words as Python strings: none has a line end, so one joined string is cut again."""
        if not len(words):
            return []
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")

    def encode(self, texts: list[bytes] | list[str]) -> list[np.ndarray]:
        """The ids of each text, each with END_ID appended."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        words = self._listed(coded.dictionary)
        known = self.words
        ids, lacking = known.found(words)
        if lacking:
            self._learn([words[i] for i in lacking])
            for i in lacking:
                ids[i] = known[words[i]]
        known.settle()
        self.cores.settle()
        if len(self.tails) > KEPT_WORDS:
            self.tails = {"": b""}
        # each word's ids, one word after the other
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.kind.itemsize
        flat, first = np.frombuffer(b"".join(ids), dtype=self.kind), np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        size = sizes[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        of_text = np.diff(ends[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])])
        out = np.full(int(ends[-1]) + len(texts), END_ID, dtype=self.kind)
        out[np.arange(ends[-1]) + np.repeat(np.arange(len(texts)), of_text)] = flat[np.arange(ends[-1]) + np.repeat(first[code] - ends[:-1], size)]
        return np.split(out, np.cumsum(of_text + 1)[:-1]) if texts else []
