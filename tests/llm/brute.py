"""Rows of the edge table, and plain rules that the tests hold results against."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, version string, row int, keys string, kept string"

WORDS = "river stone cloud amber field lantern copper meadow harbor winter signal garden thunder paper silver".split()


def prose(seed: int, n: int) -> str:
    made = random.Random(seed)
    return " ".join(made.choice(WORDS) + made.choice(["", "", "s", "ly", ","]) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, repeated rows, rows without id."""
    base = prose(1, 120)
    near = base.replace("river", "brook", 1)
    long_text = "\n".join(prose(100 + k, 40) for k in range(3000))
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t\n "), (7, "two words"),
        (8, "Two\twords"), (9, long_text), (10, long_text + " end"), (None, base), (None, None),
        (11, prose(2, 60)), (11, prose(2, 60)), (12, "Éléphant naïve Straße ÑANDÚ — “quoted” 12.5% …"),
        (13, "a"), (14, "x" * 250), (15, "x" * 250 + "y"), (16, "A common line of text\nother " + prose(3, 30)),
        (17, "  a COMMON line of text \nmore " + prose(4, 30)), (18, "line\nline\nline\r\nline"),
        (19, "<|endoftext|> it's we'll <|ENDOFTEXT|> don't. !!! ..., a.b.c"), (20, "\n"),
    ]
    return [
        (i, t, "en" if i is None or i % 3 else None, "src0", None if t is None else len(t), 7, "v", 1, "k", "z")
        for i, t in texts
    ]


def fold(text: str | None) -> str:
    """A-Z to a-z only."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def edge_table() -> list[tuple]:
    return [(r[0], r[1]) for r in edge_rows()]


def key(doc_id) -> int:
    return -(2**63) if doc_id is None else doc_id
