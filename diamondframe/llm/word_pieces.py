"""Encoding of texts word by word, with a cache in each Python worker.

The tokenizers used here never let a token span white space, so a text's ids are those of
its runs between ASCII white space, one after the other. Each run is given to the library
as it stands (which keeps its handling of special strings, letter case and normal forms) and
is remembered by the worker. A text is read in parts of about a megabyte, and a full cache keeps
the words of the current part only, so memory does not grow with the texts.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable, Iterable, Iterator

#: Characters of a text that are split into words at once.
PART = 1 << 20
#: Words that a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_LETTERS = 1_200_000, 40
#: Marks that close a word.
MARKS = string.punctuation

#: Letters below U+0250 whose small form, as the tokenizer gives it, is one letter below U+0250 too.
_LETTERS = "".join(
    c for c in map(chr, range(0xAA, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250"
)
_BLANK = re.compile(r"[ \t-\r]")
_RUNS = re.compile(r"[^ \t-\r]+")
_ODD = re.compile(f"[^\x00-\x7f{_LETTERS}]|'|<\\|")
_PLAIN = re.compile(f"[a-z{_LETTERS}]+|[^a-z{_LETTERS} \t-\r]+")
_loaded: dict[str, object] = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load(path: str):
    """The tokenizer of a file, once per process; only those that split at white space."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        if [t.ids for t in found.encode_batch(["a b", "a", "b"], add_special_tokens=False)][0] != [
            i for t in found.encode_batch(["a", "b"], add_special_tokens=False) for i in t.ids
        ]:
            raise ValueError(f"{path}: its tokens span white space")
        _loaded[path] = found
    return _loaded[path]


def parts(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of about a megabyte; a run without blanks is never cut.

    In a text of ASCII and common Latin letters, without apostrophes, letters and what stands
    between them are always pieces of their own, and the tokenizer has letters in lower case.
    Elsewhere, and where a special string could be, a word is a run without ASCII blanks.
    """
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, min(at + PART, len(text)))
        end = blank.end() if blank else len(text)
        part = text[at:end]
        yield _RUNS.findall(part) if _ODD.search(part) else _PLAIN.findall(part.lower())
        at = end


def split_end(word: str) -> tuple[str, str]:
    """A word in the form that its copies share, and the marks that close it.

    ASCII letters go to lower case, as the tokenizer has it. ASCII marks after a letter are
    always a piece of their own. Words that could hold a special string stay as they are, and
    so do words with letters that take another form beside a mark.
    """
    if "<|" in word or not word.isascii():
        return word, ""
    core = word.rstrip(MARKS)
    if core and core[-1].isalpha():
        return core.lower(), word[len(core) :]
    return word.lower(), ""


def byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for a byte: itself if it is visible, else
    the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


_CHARACTERS = byte_characters()


def one_piece(form: str) -> str | None:
    """A word of letters below U+0250 as the tokenizer's model reads it: small letters, bytes as
    characters. Such letters have no other normal form, and a run of them is one piece."""
    text = form.lower()
    if not text.isalpha() or max(text) >= "\u0250":
        return None
    return text if text.isascii() else "".join(map(_CHARACTERS.__getitem__, text.encode()))


def takes_lower_letters(tokenizer) -> bool:
    """Whether its model gives for ``one_piece`` what the tokenizer gives for the word."""
    words = ["water", "Straße", "élève", "ÑANDÚ", "łódź", "Íslenska", "a", "zzyzxqj"]
    whole = tokenizer.encode_batch_fast(words, add_special_tokens=False)
    return all(
        [t.id for t in tokenizer.model.tokenize(one_piece(w))] == e.ids
        for w, e in zip(words, whole)
    )


VALUES: dict[str, Callable[[list[int]], object]] = {
    "length": len,
    "bytes": lambda ids: struct.pack(f"<{len(ids)}I", *ids),
}
_caches: dict[tuple[str, str, int | None], WordCache] = {}


def worker_cache(
    path: str, kind: str, known: dict | None = None, limit: int | None = None
) -> WordCache:
    """The cache of this process for a tokenizer and a kind of value; tasks follow each other in it."""
    if (path, kind, limit) not in _caches:
        _caches[path, kind, limit] = WordCache(path, VALUES[kind], known, limit)
    return _caches[path, kind, limit]


class WordCache:
    """What ``value`` makes of each word's ids, remembered within bounds.

    ``value`` maps ids to something that can be added. ``known`` is the first tier: it is always
    kept. The rest, words and their common forms, comes and goes: ``limit`` of each at most.
    """

    def __init__(
        self, path: str, value: Callable[[list[int]], object], known: dict | None = None,
        limit: int | None = None,
    ):
        self.tokenizer, self.value, self.limit = load(path), value, limit or CACHE_WORDS
        self.known = known or {}
        self.words, self.forms, self.passing = dict(self.known), {}, []
        self.lower_letters = takes_lower_letters(self.tokenizer)

    def _encode(self, forms: list[str]) -> dict:
        """Values of forms. What is one piece for the tokenizer goes to its model at once."""
        found, others = {}, []
        tokenize, value = self.tokenizer.model.tokenize, self.value
        for f in forms:
            letters = one_piece(f) if self.lower_letters else None
            if letters:
                found[f] = value([token.id for token in tokenize(letters)])
            else:
                others.append(f)
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        found.update((f, value(e.ids)) for f, e in zip(others, encoded))
        return found

    def _prepare(self, distinct: set[str]) -> None:
        for w in self.passing:
            self.words.pop(w, None)
        missing = [w for w in distinct if w not in self.words]
        if len(self.words) + len(missing) > len(self.known) + self.limit:
            # Frequent words are among those of any megabyte.
            still = {w: self.words[w] for w in distinct if w in self.words}
            self.words = self.known | still
        if len(self.forms) > self.limit:
            self.forms = {}
        words, forms = self.words, self.forms
        ends = [split_end(w) for w in missing]
        new = {f for pair in ends for f in pair if f and f not in words and f not in forms}
        found = self._encode(list(new))
        # A form is its own form, so it may be known as a word.
        made = {}
        for w, (f, end) in zip(missing, ends):
            value = found[f] if f in found else words[f] if f in words else forms[f]
            if end:
                value = value + (found[end] if end in found else words[end] if end in words else forms[end])
            made[w] = value
        forms.update((f, found[f]) for f in found.keys() - made.keys() if len(f) <= CACHE_LETTERS)
        words.update(made)
        # Long words are not remembered.
        self.passing = [w for w in missing if len(w) > CACHE_LETTERS]

    def values(self, texts: Iterable[str]) -> Iterator[tuple[int, Iterator[object]]]:
        """(row, a value per word) for each part of each text, in order; no part for no words."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for words in parts(text):
                held.append((row, words))
            size += len(text)
            if size >= PART:
                yield from self._of(held)
                held, size = [], 0
        yield from self._of(held)

    def _of(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, Iterator[object]]]:
        self._prepare(set().union(*(words for _, words in held)))
        found = self.words.__getitem__
        for row, words in held:
            yield row, map(found, words)
