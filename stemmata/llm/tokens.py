"""Token ids of whole texts with the tokenizers library, remembered per word.

Both vocabularies cut a text into words by a pattern before they merge, and a word's ids depend on the word alone. So a
text of PLAIN characters, where Python's and the library's ideas of letters, digits and white space are the same, is cut
here and each new word goes to the library's merge model once; any other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Latin letters of one code point that lower-case to one code point.
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ǃ"
#: Anything else, and the beginning of special tokens, is left to the library.
NOT_PLAIN = re.compile(f"[^{LETTER}0-9\\x20-/:-@\\[-`{{-~\\t\\n\\r¡§©«®°±´¶·»¿×÷–—‘-„•…€]|<\\|")
# The word patterns of the two vocabularies, for plain texts.
BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\\s{LETTER}0-9]+|\\s+(?!\\S)|\\s+")
LOWER_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s{LETTER}0-9]+")
LIMIT = 300_000


def _byte_names() -> dict[int, str]:
    """Printable stand-ins for bytes: those of visible Latin-1 characters stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids(texts) -> one uint16 array a text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.lower = json.load(f)["normalizer"] is not None
        self.pattern = LOWER_WORDS if self.lower else BYTE_LEVEL
        self.names = str.maketrans(_byte_names())
        self.known: dict[str, bytes] = {}
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids over 65535 are not supported")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        known, merge, names = self.known, self.library.model.tokenize, self.names
        out = []
        for text in texts:
            text = text or ""
            if NOT_PLAIN.search(text):
                out.append(self._whole(text))
                continue
            words = self.pattern.findall(text.lower() if self.lower else text)
            try:
                out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16))
                continue
            except KeyError:
                pass
            if len(known) > LIMIT:
                known.clear()
            for word in {w for w in words if w not in known}:
                known[word] = np.array([t.id for t in merge(word.encode().decode("latin-1").translate(names))], np.uint16).tobytes()
            out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary. The library runs in one thread: Spark has the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
