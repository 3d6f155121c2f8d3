"""Token ids of whole texts from the tokenizers library, one call a distinct word.

Both vocabularies here cut a text before they merge, never across a single ASCII space between two other characters
(the lower-casing one drops white space altogether), so the ids of a text are the ids of its space-separated parts,
one after the other. A part that is one word of Latin letters goes straight to the library's merging model, in the
byte characters the vocabulary is written in; any other part goes through the whole library, and so does a text in
which white space stands next to a space. A worker keeps the ids of parts it has met lately.
"""

from __future__ import annotations

import contextlib
import re
from array import array
from itertools import compress, count, repeat
from operator import is_

import numpy as np

#: bytes of parts a worker remembers: of a vocabulary, and of words at the head of texts; a vocabulary's marks take a little more
ROOM, HEADS, MARKS = 72 << 20, 16 << 20, 2 << 20
#: white space other than the space: in ASCII, and all of it
OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")


def touching(text: str) -> bool:
    """Whether a space stands at an end of the text or next to white space."""
    return text[:1] == " " or text[-1:] == " " or "  " in text or any(
        c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACE[not text.isascii()])


#: a word of letters that no normal form changes, and the ASCII marks behind it, which both vocabularies cut off as one;
#: without the apostrophe, which may begin a pre-token of its own, and what special tokens are made of
WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:;=?@\[-`{}~]*)").fullmatch


#: letters beyond those of ``WORD``, for which lower case is left to the library
BEYOND = re.compile("[^\\x00-\u024f]")


class Recent:
    """Values of texts, as many as fit.

    The first texts met stay, since frequent ones are met early; a fifth of the room is for those met lately and
    emptied when full. After it was emptied ``TURNS`` times the texts have changed: everything starts over.
    """

    TURNS = 40

    def __init__(self, encode, size: int):
        self.encode, self.size = encode, size
        #: values given from outside, looked up first
        self.table: dict[str, object] = {}
        self.now: dict[str, object] = {}
        self.late: dict[str, object] = {}
        self.turns = 0

    def values(self, parts: list[str]) -> list:
        """The values of ``parts``, in order: one look-up each, and one call for those not met."""
        found = list(map((self.table or self.now).get, parts))
        if None in found:
            missed = list(compress(count(), map(is_, found, repeat(None))))
            texts = list(map(parts.__getitem__, missed))
            for held in (self.late, self.now) if self.table else (self.late,):
                got = list(map(held.get, texts))
                for i, v in zip(missed, got):
                    found[i] = v
                open_ = list(map(is_, got, repeat(None)))
                missed, texts = list(compress(missed, open_)), list(compress(texts, open_))
            if texts:
                new = list(dict.fromkeys(texts))
                made = dict(zip(new, self.encode(new)))
                for i, x in zip(missed, texts):
                    found[i] = made[x]
                self.keep(made)
        return found

    def keep(self, made: dict) -> None:
        if len(self.now) < self.size * 4 // 5:
            self.now.update(made)
        else:
            self.late.update(made)
            if len(self.late) > self.size // 5:
                self.late, self.turns = {}, self.turns + 1
                if self.turns == self.TURNS:
                    self.now, self.turns = {}, 0


#: what an entry takes besides its characters and its value's bytes: two objects and a place in a dictionary
ENTRY = 210


def _width(text: str | bytes) -> int:
    """Bytes a character takes at most."""
    return 1 if isinstance(text, bytes) or text.isascii() else 4


class Bounded(Recent):
    """Values of texts, or of their bytes, as bytes: ``size`` bytes of them with their texts and dictionaries; a text beyond a hundredth of that is not kept."""

    def __init__(self, encode, size: int):
        super().__init__(encode, size)
        self.now_bytes = self.late_bytes = 0

    def keep(self, made: dict) -> None:
        # as a rule all of it fits: counted as a whole, each text as wide as the widest
        width = _width(type(next(iter(made)))().join(made))
        most = ENTRY * len(made) + sum(map(len, made)) * width + sum(map(len, made.values()))
        if most <= self.size // 100:
            if self.now_bytes + most <= self.size * 4 // 5:
                self.now.update(made)
                self.now_bytes += most
                return
            if self.late_bytes + most <= self.size // 5:
                self.late.update(made)
                self.late_bytes += most
                return
        sizes = {x: ENTRY + len(x) * _width(x) + len(v) for x, v in made.items()}
        for x in [x for x, n in sizes.items() if n > self.size // 100]:
            del made[x], sizes[x]
        for x, n in sizes.items():
            if self.now_bytes + n <= self.size * 4 // 5:
                self.now[x] = made[x]
                self.now_bytes += n
                continue
            if self.late_bytes + n > self.size // 5:
                self.late, self.late_bytes, self.turns = {}, 0, self.turns + 1
                if self.turns == self.TURNS:
                    self.now, self.now_bytes, self.turns = {}, 0, 0
            self.late[x] = made[x]
            self.late_bytes += n


def byte_characters() -> dict[int, str]:
    """The letters of ``WORD`` as a byte-level vocabulary writes them: printable Latin-1 bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x24F + 1)}


class Coder:
    """``ids(text)`` as a little-endian array of unsigned 16-bit integers (both vocabularies are below 65,536)."""

    def __init__(self, path: str, drops_space: bool, room: int = ROOM):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        assert self.tokenizer.get_vocab_size() <= 1 << 16
        self.model, self.drops_space, self.written = self.tokenizer.model, drops_space, byte_characters()
        self.space = self.written[0x20]
        self.marks = Bounded(self.encode, MARKS)
        self.newline = self.encode(["\n"])[0]
        self.heads = Bounded(lambda new: self.encode_parts(new, self.heads, "", ""), HEADS)
        self.parts = Bounded(lambda new: self.encode_parts(new, self.parts, *(("", "") if drops_space else (" ", self.space))), room)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, new: list[str], known: Recent, lead: str, shown_lead: str) -> list[bytes]:
        """Parts behind ``lead``; a mark behind a word is cut off first, so that the word is met again."""
        now, late, tokenize, written = known.now, known.late, self.model.tokenize, self.written
        out: list[bytes | None] = []
        other = []
        marks, beside = self.marks, {}
        for part in new:
            found = WORD(part)
            if not found:
                lines = part.split("\n") if "\n" in part else ()
                if lines and all(map(WORD, lines)):
                    # a single newline between two words is a pre-token of its own
                    behind = [self.newline + x for x in self.heads.values(lines[1:])]
                    out.append(b"".join([*known.values(lines[:1]), *behind]))
                else:
                    other.append(part)
                    out.append(None)
                continue
            word, mark = found.groups()
            if self.drops_space:
                word = word.lower()
            # a part without a mark was looked up before
            ids = (now.get(word) or late.get(word) or beside.get(word)) if mark or word is not part else beside.get(word)
            if ids is None:
                ids = array("H", [t.id for t in tokenize(shown_lead + (word if word.isascii() else word.translate(written)))]).tobytes()
                if mark:
                    beside[word] = ids
            out.append(ids + (marks.now.get(mark) or marks.values([mark])[0]) if mark else ids)
        if beside:
            known.keep(beside)
        if other:
            rest = iter(self.encode([lead + x for x in other]))
            out = [next(rest) if x is None else x for x in out]
        return out

    def ids(self, text: str) -> np.ndarray:
        if self.drops_space:
            # lower case first, where it cannot change what the library does, so that more parts are met again
            if "<|" not in text and (text.isascii() or BEYOND.search(text) is None):
                text = text.lower()
            return np.frombuffer(b"".join(self.parts.values(text.replace("\n", " ").split(" "))), "<u2")
        if touching(text):
            return np.frombuffer(self.encode([text])[0], "<u2")
        head, *parts = text.split(" ")
        return np.frombuffer(b"".join([*self.heads.values([head]), *self.parts.values(parts)]), "<u2")


#: of this worker process, by vocabulary, and the stage whose tasks filled it
_CODERS: dict[str, Coder] = {}
_OF: list = []


def release() -> None:
    """At the start of a task: drop what tasks of another stage left in this worker."""
    from pyspark import TaskContext

    context = TaskContext.get()
    now = [context.stageId()] if context else []
    if _CODERS and now != _OF:
        import ctypes
        import gc

        _CODERS.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library gives memory back on request
            ctypes.CDLL(None).malloc_trim(0)
    _OF[:] = now


def coder(name: str) -> Coder:
    """The coder of this worker process for a vocabulary file of the public tokenizers, by name or path, while a stage lasts."""
    release()
    if name not in _CODERS:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        path = name if os.path.sep in name else public_tokenizers.path(name)
        _CODERS[name] = Coder(path, drops_space=os.path.basename(path).startswith("word_"))
    return _CODERS[name]


@contextlib.contextmanager
def seldom_collected():
    """Fewer looks for garbage while many short-lived lists stand beside a large dictionary."""
    import gc

    before = gc.get_threshold()
    gc.set_threshold(50_000, 20, 100)
    try:
        yield
    finally:
        gc.set_threshold(*before)
