"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a tokenizer treats a single space between two words.
DROPPED = "dropped"  # white space is removed: words are encoded on their own
LEADING = "leading"  # the space belongs to the word that follows
WHOLE = "whole"  # nothing is known: texts are encoded as they are
CACHE_WORDS = 300_000
LONGEST_WORD = 48
GROUP_CHARS = 1 << 22
#: Letters whose class no Unicode version disputes; punctuation that every pre-tokenizer here splits off after them.
_PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,;:!?"
_ODD_SPACE = re.compile(r"\s\s| $|^ |[^\S ] | [^\S ]")
_LOADED: dict[tuple[str, str], WordEncoder] = {}


class WordEncoder:
    """Encodes texts as the tokenizer would, word by word where its pre-tokenizer cannot reach across a space.

    A text that holds the literal of an added token ('<|endoftext|>') is encoded whole: the literal splits what is around it.
    Words recur within and across tasks of a worker process, so their ids are kept, up to ``CACHE_WORDS`` words. A new word
    is first cut where every pre-tokenizer cuts it (lines, punctuation after letters) and, if the tokenizer lower-cases,
    lower-cased, so that few pieces are really new.
    """

    def __init__(self, path: str, spaces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # How letters of a word (and the space before it) are written for the model itself.
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in (" ", *map(chr, range(0xC0, 0x100)))}
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces = spaces
        self.lower = spaces == DROPPED and self._ids("ABCÀÞ") == self._ids("abcàþ")
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Native-endian ids, two or four bytes each (``code``)."""
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars > GROUP_CHARS:
                out += self._group(group)
                group, chars = [], 0
        return out + self._group(group)

    def _whole(self, text: str) -> bool:
        """Whether a text must be encoded as it is."""
        return self.spaces == WHOLE or any(a in text for a in self.added) or (self.spaces == LEADING and _ODD_SPACE.search(text) is not None)

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        for i, x in zip(whole, self._encoded([texts[i] for i in whole]), strict=True):
            out[i] = x
        skipped = set(whole)
        cut = [i for i in range(len(texts)) if i not in skipped]
        if cut:
            for i, x in zip(cut, self._by_words([texts[i] for i in cut]), strict=True):
                out[i] = x
        return out

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of runs of letters that are already as the normalizer leaves them: the model alone decides them."""
        tokenize, letters, code = self.model.tokenize, self.letters, self.code
        if self.spaces == DROPPED:
            return [array(code, [t.id for t in tokenize(p if p.isascii() else p.translate(letters))]).tobytes() for p in pieces]
        return [array(code, [t.id for t in tokenize(p.translate(letters))]).tobytes() for p in pieces]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Words are numbered and gathered by Arrow and numpy; only the group's different pieces are touched one by one."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        counts = pc.list_value_length(lists).to_numpy()
        words = lists.flatten().dictionary_encode()
        number, names = words.indices.to_numpy(), words.dictionary
        if self.spaces == LEADING:
            # Every word but a text's first has its space.
            follows = np.ones(len(number), bool)
            follows[np.cumsum(counts) - counts] = False
            used, number = np.unique(number + follows * len(names), return_inverse=True)
            spaced = pc.binary_join_element_wise(pa.array(np.where(used >= len(names), " ", ""), pa.large_string()), names.take(pa.array(used % len(names))), pa.scalar("", pa.large_string()))
            names = spaced
        ids, starts, sizes = self._word_ids(names)
        ids, lengths = _gathered(ids, starts[number], sizes[number]), sizes[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])] * ids.itemsize
        buffer = ids.tobytes()
        return [buffer[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _word_ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words end to end, with start and number for each. A word's pieces, in a row: lines, letters, marks after them."""
        lines = pc.split_pattern(names, "\n")
        count = pc.list_value_length(lines).to_numpy()
        line = lines.flatten()
        head = pc.utf8_rtrim(line, _MARKS)
        plain = pc.match_substring_regex(head, _PLAIN)
        lowered = pc.utf8_lower(head) if self.lower else head
        size = pc.utf8_length(head).to_numpy()
        rest = np.flatnonzero((pc.utf8_length(line).to_numpy() > size) & plain.to_numpy(zero_copy_only=False))
        first = pc.if_else(plain, lowered, line)
        marks = pa.array([x[n:] for x, n in zip(line.take(pa.array(rest)).to_pylist(), size[rest].tolist(), strict=True)], pa.large_string())
        tail = np.zeros(len(line), np.int64)  # 0 stands for no piece
        every = pa.concat_arrays([pa.array(["", "\n"], pa.large_string()), first, marks]).dictionary_encode()
        code, pieces = every.indices.to_numpy().astype(np.int64), every.dictionary.to_pylist()
        tail[rest] = code[2 + len(line):]
        found = [self.known.get(p) for p in pieces]
        new = [i for i, x in enumerate(found) if x is None]
        letters = np.zeros(len(pieces), bool)
        letters[code[2:2 + len(line)][plain.to_numpy(zero_copy_only=False)]] = True
        room = CACHE_WORDS - len(self.known)
        for run, some in ((self._letters, [i for i in new if letters[i]]), (self._encoded, [i for i in new if not letters[i]])):
            for i, x in zip(some, run([pieces[i] for i in some]), strict=True):
                found[i] = x
                if room > 0 and len(pieces[i]) <= LONGEST_WORD:
                    self.known[pieces[i]] = x
                    room -= 1
        pool = np.frombuffer(b"".join(found), np.uint16 if self.code == "H" else np.uint32)
        width = np.array([len(x) for x in found], np.int64) // pool.itemsize
        begin = np.cumsum(width) - width
        # Three pieces a line: letters, marks, and the line break after all but a word's last line where it has ids.
        last = np.zeros(len(line), bool)
        last[np.cumsum(count) - 1] = True
        sequence = np.stack([code[2:2 + len(line)], tail, np.where(last | (self.spaces != LEADING), 0, code[1])], axis=1).ravel()
        ids = _gathered(pool, begin[sequence], width[sequence])
        edges = np.concatenate([[0], np.cumsum(width[sequence])])[np.concatenate([[0], 3 * np.cumsum(count)])]
        return ids, edges[:-1], np.diff(edges)


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``pool`` end to end."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return pool[:0]
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def encoder(path: str, spaces: str = WHOLE) -> WordEncoder:
    key = (path, spaces)
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(path, spaces)
    return _LOADED[key]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterable[pa.RecordBatch]:
    """Parts of few rows, so that texts and ids of a whole batch are never held together."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def encode_all(path: str, texts: Iterable[str | None], spaces: str = WHOLE) -> tuple[list[bytes], str]:
    e = encoder(path, spaces)
    return e.encode([t or "" for t in texts]), e.code
