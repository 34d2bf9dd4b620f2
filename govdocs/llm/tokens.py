"""Token ids of whole texts by the tokenizers library, with a bounded cache of words inside each worker."""

from __future__ import annotations

import os
import re
from array import array

#: The byte-level vocabulary's file, as the tokenizers package names it.
VOCABULARY = "byte_bpe_50k.json"
#: Distinct words whose ids a worker keeps; beyond that it starts anew.
CACHE_WORDS = 600_000
#: Longest word that is kept.
CACHE_CHARS = 64
#: White space beside a space or line end: there, the pieces between them aren't encoded alike on their own.
_JOINED = re.compile(r"[ \n]\s|\s[ \n]")
#: A word that begins with letters, and what an ASCII sign or digit begins after them: the pattern of the vocabulary always cuts there.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\[-`{-~].*)?", re.DOTALL)
#: Byte-level names have one character for each byte: itself if it is printable in Latin-1, else one from 256 on, in order.
_ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_NAMES = {b: 256 + i for i, b in enumerate(_ODD)}
_SPACE = chr(_NAMES[32])

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Little-endian 32-bit ids of texts.

    Byte-level pre-tokenisation always cuts before a single space or line end that stands between two
    other characters, so that a text is the concatenation of its words, each led by one of them. A word
    is cut again where its first letters end. Letters are one piece of the pattern and go to the
    library's model as they are, all else to the whole library; a word is kept once it is known.
    Texts with longer runs of white space at a space or line end are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.line_end = self.whole("\n")
        #: Words without the space that leads them, or with the line end; letters after a line end; what follows letters. Letters after a space are a word.
        self.words, self.heads, self.ends = Known(self.word), Known(self.letters), Known(self.after)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def letters(self, word: str) -> bytes:
        """Ids of letters, with a space at the front or without."""
        name = word.replace(" ", _SPACE) if word.isascii() else word.encode().decode("latin-1").translate(_NAMES)
        return array("I", [t.id for t in self.model.tokenize(name)]).tobytes()

    def after(self, text: str) -> bytes:
        """Ids of what follows letters: after a line end, which is one id, as nothing may come before it."""
        return self.whole("\n" + text)[4:]

    def word(self, w: str) -> bytes:
        line = w[0] == "\n"
        m = _WORD.fullmatch(w, line)
        if m is None:
            return self.whole(w if line else f" {w}")
        head, rest = m[1], m[2]
        if line:
            return self.line_end + (self.heads[head] + self.ends[rest] if rest else self.letters(head))
        return self.words[head] + self.ends[rest] if rest else self.letters(f" {head}")

    def encode(self, text: str) -> bytes:
        if not text or text[0] in " \n" or text[-1].isspace() or _JOINED.search(text):
            return self.whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, words))


class Known(dict):
    """What `make` gives for a text; kept for texts of CACHE_CHARS at most, and begun anew after CACHE_WORDS of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[text] = out
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of the texts."""
    return [encoder(path).encode(t) for t in texts]
