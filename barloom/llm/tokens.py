"""Token ids of whole texts through a memo of white-space-delimited chunks.

The word-BPE vocabulary folds runs of white space and never lets a token cross
one, and its special strings hold no white space, so the ids of a text are the
ids of its chunks one after another. Only chunks that a Python worker has not
met before reach the tokenizers library.
"""

from __future__ import annotations

import functools
import re
from array import array

#: str.split() also splits at these; the vocabulary's white space leaves them out.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Marks that end a chunk whose last letter is one of LETTERS: the vocabulary splits between them.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: A text with all that ``chunks``, ``folded`` and ``Memo`` rely on.
PROBE = "Héllo  WÖRLD's x\x85y\tit's a.b!! (yes), no? 1234 ÀÉ Ünï\x1cz \n end."


@functools.cache
def fits(path: str) -> bool:
    """Whether the vocabulary works as this module needs: case folded, white space dropped, no token across it or between letters and marks."""
    library = library_tokenizer(path)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    apart = [x for c in chunks(folded(PROBE)) for part in _core_and_tail(c) for x in ids(part)]
    return apart == ids(PROBE) and bool(apart)


def _core_and_tail(chunk: str) -> tuple[str, ...]:
    core = chunk.rstrip(TAIL)
    return (core, chunk[len(core) :]) if core != chunk and core and core[-1] in LETTERS else (chunk,)


def chunks(text: str) -> list[str]:
    if any(c in text for c in ODD_SPACE):
        return [c for c in SPACE.split(text) if c]
    return text.split()


def folded(text: str) -> str:
    """The text in lower case where that surely changes no id; the vocabulary folds case itself.

    So it is for Latin-1 texts without the opening of a special string: special
    strings are matched before case is folded.
    """
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Memo:
    """Chunk to its ids as little-endian unsigned 32-bit bytes.

    Two generations: when the younger is full it becomes the older, from which
    chunks that are still met come back, so the frequent ones stay known.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most, self.known, self.older = library_tokenizer(path), most, {}, {}
        self.fits = fits(path)

    def learn(self, parts: list[str]) -> None:
        """Make sure that all of ``parts`` are known."""
        wanted = {c for c in parts if c not in self.known}
        if len(self.known) + len(wanted) > self.most:
            self.older, self.known = self.known, {}
            wanted = set(parts)
        new, with_tail = set(), []
        for c in wanted:
            ids = self.older.get(c)
            if ids is not None:
                self.known[c] = ids
                continue
            parts_of = _core_and_tail(c)
            if len(parts_of) == 2:
                with_tail.append((c, *parts_of))
                new.update(x for x in parts_of if x not in self.known)
            else:
                new.add(c)
        listed = list(new)
        for at in range(0, len(listed), 20_000):
            part = listed[at : at + 20_000]
            for chunk, made in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[chunk] = array("I", made.ids).tobytes()
        for c, core, tail in with_tail:  # letters and such marks never share a token
            self.known[c] = self.known[core] + self.known[tail]

    def encode(self, text: str) -> bytes:
        if not self.fits:  # another kind of vocabulary: whole texts go to the library
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = chunks(folded(text))
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            return b"".join(map(self.known.__getitem__, parts))


@functools.cache
def memo(path: str) -> Memo:
    """One memo for each Python worker and vocabulary."""
    return Memo(path)
