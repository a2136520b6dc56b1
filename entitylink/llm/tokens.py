"""Whole texts to token ids with the tokenizers library, each distinct word encoded once.

A vocabulary of words lower-cases texts and cuts them at white space before anything else, so the
ids of a text are those of its words in order.  Words are cut at ASCII white space only, punctuation
after them is set apart, and they are looked up in a table that is bounded by a number of words and kept by a worker between tasks.  A tokenizer
whose normaliser, pre-tokenizer or answers to PROBES are not so encodes whole texts instead.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Words that a worker's table may hold when a new chunk of texts starts.
TABLE_WORDS = 200_000
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 1 << 20


#: Texts that tell whether a tokenizer cuts words as this module does.
PROBES = (b"One word, TWO  words.\n\tthree's 12 words...?! a*b=c$ d_# e", b"(x) 'y' z'! 7% q\"", "Ünïcode wörds\r\n\x0band 漢字 with — marks".encode(), b" leading don't  trailing ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Table(dict):
    """Word -> number; new words are numbered in the order they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    _kept: dict[str, WordEncoder] = {}

    def __init__(self, path: str, table_words: int = TABLE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.reserved = [text.lower().encode() for _, text in special]
        self.mark_id, self.mark = special[-1] if special else (-1, "")
        self.table_words = table_words
        settings = json.loads(self.tokenizer.to_str())
        self.by_words = bool(special) and all(b"<" in x for x in self.reserved) and self._cuts_words(settings)
        suffix = settings["model"].get("end_of_word_suffix")
        self.ends = None  # ids that end a pre-token
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word.endswith(suffix)]] = True
        self._reset()

    @classmethod
    def of(cls, path: str, table_words: int = TABLE_WORDS) -> WordEncoder:
        """The worker's encoder for a vocabulary."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        cls._kept[path].table_words = table_words
        return cls._kept[path]

    def _cuts_words(self, settings: dict) -> bool:
        """Whether the ids of a text are those of its lower-cased words in order."""
        steps = settings.get("normalizer") or {}
        kinds = {x.get("type") for x in [steps, *steps.get("normalizers", [])]}
        if "Lowercase" not in kinds or not settings.get("pre_tokenizer") or kinds & {"Prepend", "Precompiled"}:
            return False
        return all(
            np.array_equal(self._whole(text), np.concatenate([self._whole(w) for w in _words(text.lower())]))
            and np.array_equal(self._whole(self.mark.encode().join(text.split())), np.concatenate([x for w in text.split() for x in (self._whole(w), [self.mark_id])][:-1]))
            for text in PROBES
        )

    def _reset(self) -> None:
        self.table = _Table()
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def _whole(self, text: bytes) -> np.ndarray:
        one = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0]
        return np.array(one.ids, np.uint32)

    def _sure(self, words: list[bytes], pre_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts for words with known numbers of pre-tokens: a line each, told
        apart by the ids that end a pre-token."""
        ids = self._whole(b"\n".join(words))
        last = np.flatnonzero(self.ends[ids])[np.cumsum(pre_tokens) - 1]
        return ids, np.diff(last, prepend=-1)

    def _any(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For other words: set apart by a special token that none of them holds, which is slower."""
        ids = self._whole(self.mark.encode().join(words))
        cuts = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1

    def _learn(self) -> None:
        """Encode the words that are new."""
        words = self.table.new
        known = np.array([1 if w.isalpha() else _pre_tokens(w) for w in words] if self.ends is not None else [0] * len(words))
        # letters and then stops or commas have the ids of both, if the letters are in the table
        built = [(n, core, words[n]) for n in np.flatnonzero(known == 2).tolist() if (core := self.table.get(words[n].rstrip(b",."))) is not None]
        known[[n for n, _, _ in built]] = -1
        parts, counts, order = [self.ids], [], []
        for sure in (True, False):
            batch = np.flatnonzero(known > 0 if sure else known == 0)
            for i in range(0, len(batch), 4096):
                own = batch[i : i + 4096]
                text = [words[n] for n in own.tolist()]
                ids, each = self._sure(text, known[own]) if sure else self._any(text)
                parts.append(ids)
                counts.append(each)
                order.append(own)
        count, place = np.concatenate([np.empty(0, np.int64), *counts]), np.concatenate([np.empty(0, np.int64), *order])
        fresh = np.zeros((2, len(words)), np.int64)
        fresh[0, place] = count
        fresh[1, place] = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate(parts)
        self.counts, self.starts = np.concatenate((self.counts, fresh[0])), np.concatenate((self.starts, fresh[1]))
        if built:
            self._build(len(self.counts) - len(words), built)
        self.table.new = []

    def _build(self, old: int, built: list[tuple[int, int, bytes]]) -> None:
        """Words made of a word of the table and a tail: (number among the new, word, bytes)."""
        at, core = np.array([b[0] for b in built]) + old, np.array([b[1] for b in built])
        tails = [w[len(w.rstrip(b",.")) :] for _, _, w in built]
        ids_of = {t: self._whole(t) for t in set(tails)}
        own, more = self.counts[core], np.array([len(ids_of[t]) for t in tails])
        ends = np.cumsum(own + more)
        out = np.empty(ends[-1], np.uint32)
        body = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(ends - own - more, own) + body] = self.ids[np.repeat(self.starts[core], own) + body]
        out[np.repeat(ends - more, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)] = np.concatenate([ids_of[t] for t in tails])
        self.counts[at], self.starts[at] = own + more, len(self.ids) + ends - own - more
        self.ids = np.concatenate((self.ids, out))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if not self.by_words:
            found = [self._whole(t) if t else np.empty(0, np.uint32) for t in texts]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        if len(self.table) > self.table_words:
            self._reset()
        words: list[bytes] = []
        ends, odd = [], {}
        for n, text in enumerate(texts):
            if text:
                # Lower-casing merges words; where accents stand alone it could hinder composition.
                low = text if b"\xcc" in text or b"\xcd" in text else text.lower()
                if b"<" in low and any(mark in text.lower() for mark in self.reserved):
                    odd[n] = self._whole(text)
                else:
                    words += _words(low)
            ends.append(len(words))
        at = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        if self.table.new:
            self._learn()
        counts = self.counts[at]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.starts[at] - total[:-1], counts) + np.arange(total[-1])]
        each = np.diff(total[np.concatenate(([0], ends))])
        if odd:
            pieces = np.split(ids, np.cumsum(each)[:-1])
            for n, own in odd.items():
                pieces[n], each[n] = own, len(own)
            ids = np.concatenate(pieces)
        return ids, each


#: ASCII punctuation but the apostrophe, after a-z and before white space: a piece of its own.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[ \t\n\r\x0b\f]|$)")


def _words(low: bytes) -> list[bytes]:
    """The words of a lower-cased text, with the punctuation after plain words set apart, so that a
    word is the same word before a comma."""
    return _TAIL.sub(rb" \g<0>", low).split()


def _pre_tokens(word: bytes) -> int:
    """1 for letters, 2 for letters and then full stops or commas, 0 if it is neither."""
    core = word.rstrip(b",.")
    if core.isalpha() or (text := core.decode("utf-8", "replace")).isalpha() and max(text) <= "\xff":
        return 1 + (len(core) < len(word))
    return 0


def with_end(ids: np.ndarray, each: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text."""
    return np.insert(ids, np.cumsum(each), end_id).astype("<u4"), each + 1


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES, words: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about `most` bytes of text, and their texts (a binary column).

    Workers are kept between tasks; what a task has freed goes back to the system at its end.  The
    tables of words that an earlier stage left behind go, too, unless `words` are to be encoded."""
    if not words:
        WordEncoder._kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.flatnonzero(np.diff(np.cumsum(_sizes(batch.column(text))) // most)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            yield part, part.column(text).to_pylist()
    batch = part = None
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
