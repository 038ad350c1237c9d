"""Token ids of two libraries' tokenizers, made from the distinct words of a task's texts where that gives the same."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of these characters only are cut into the same words by both byte-level libraries (tested one by one).
_PLAIN = re.compile("[\x00-ɏ]*").fullmatch
#: The same for words between spaces, without the white space that may melt into one.
_SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*").fullmatch
#: Words, at most, whose ids a task keeps.
KNOWN_WORDS = 400_000


class WordEncoder:
    """Ids of whole texts by a model that puts a space before each text, each distinct word encoded once.

    ``words`` gives the ids of some words, each with a space before it, ``whole`` those of any
    text. Where no word between single spaces is empty or begins with white space, tokens
    never cross the place before a space, so a text's ids are those of its words. All other
    texts, and texts of other characters, go to ``whole``, as do all if not ``parted``.
    """

    def __init__(self, words: Callable[[list[str]], list[list[int]]], whole: Callable[[str], list[int]], parted: bool = True):
        self.words, self.whole, self.parted = words, whole, parted
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        fit = [i for i, t in enumerate(texts) if t and self.parted and _SIMPLE(t)]
        if fit:
            for i, ids in zip(fit, self._by_words([texts[i] for i in fit]), strict=True):
                out[i] = ids
        return [np.array(self.whole(t), np.int32) if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def _by_words(self, texts: list[str]) -> list[np.ndarray | None]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        values = split.flatten()
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        size = np.diff(ends)
        begin = np.zeros(len(values), np.uint8)
        begin[size > 0] = data[ends[:-1][size > 0]]
        start = np.cumsum(count) - count
        odd = np.add.reduceat((size == 0) | (begin <= 0x20), start) > 0
        coded = values.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        table = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.int32)
        runs = sizes[code]
        total = np.cumsum(runs)
        made = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - (total - runs), runs) + np.arange(total[-1])]
        pieces = np.split(made, total[start + count - 1][:-1])
        return [None if o else ids for o, ids in zip(odd.tolist(), pieces, strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        known.update(zip(new, (array("i", ids).tobytes() for ids in self.words(new)), strict=True))
        return [known[w] for w in words]


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level vocabulary, as data that travels in tasks; its size is bounded by the vocabulary.

    ``definition`` is the JSON text of a ``tokenizers`` file, ``ranks`` the same vocabulary as
    byte strings and ``pattern`` its word pattern. ``special`` holds the strings of special
    tokens; unless ``plain_special`` they are single tokens wherever a text has them.
    """

    definition: str
    ranks: dict[bytes, int]
    pattern: str
    special: tuple[str, ...] = ()
    plain_special: bool = False

    def encoder(self, lead: bool = False) -> Callable[[list[str]], list[np.ndarray]]:
        """A function from texts to their ids; made once per task. With ``lead``, a space is put before each text."""
        import tiktoken

        quick = tiktoken.Encoding("words", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_ordinary
        special = () if self.plain_special else self.special
        made = []

        def whole(text: str) -> list[int]:
            if not made:
                from tokenizers import Tokenizer

                made.append(Tokenizer.from_str(self.definition))
                made[0].encode_special_tokens = self.plain_special
            return made[0].encode(text, add_special_tokens=False).ids

        def encode(texts: list[str]) -> list[np.ndarray]:
            given = (" " + t if lead else t for t in texts)
            return [np.array(quick(t) if _PLAIN(t) and not any(s in t for s in special) else whole(t), np.int32) for t in given]

        return encode


def piece_encoder(model) -> WordEncoder:
    """For a loaded SentencePiece model, which puts a space before each text itself."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    # A piece that goes on behind a space would join words.
    parted = not any("▁" in p.lstrip("▁") for p in pieces)
    return WordEncoder(lambda words: model.encode(words, num_threads=1), model.encode, parted)


def read_byte_level(json_path: str, ranks: dict[bytes, int], pattern: str, plain_special: bool = False) -> ByteLevel:
    import json

    with open(json_path, encoding="utf-8") as lines:
        definition = lines.read()
    added = json.loads(definition).get("added_tokens", [])
    return ByteLevel(definition, ranks, pattern, tuple(t["content"] for t in added), plain_special)
