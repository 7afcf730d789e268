"""The pattern grammar of toxic clauses: weighted transducers, composed one after the other.

A clause is a list of words. The first transducer turns words into symbols with weights: an
insult (learned stems and words, see ``toxicity``), a threat verb, a target, a negation, a
verb of reported speech, or nothing. The following ones rewrite the weights, each with a small
state, reading from left to right or backwards:

* target: a word that addresses somebody marks the words before it, and then, read the other
  way, those after it. So a clause that has a target has it for all its words: in it an insult counts
  in full and a half more, elsewhere it counts half, as a word by itself;
* threat: a threat verb counts if the clause has a target, before or after it, or if an
  announcement ("will", "going") came before; else not;
* negation: within three words after a negation an insult or threat counts a quarter;
* reported speech: a verb of saying halves what stands after it and, read backwards, what stands
  before it, so that "she called him an idiot" and "he is an idiot, she said" weigh the same.

The score of a clause is the sum of the weights that come out. A comma does not end a clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

WORD = re.compile(r"\w+|[.!?;:\n]")
CLAUSE_ENDS = frozenset(".!?;:\n")

# Words of the grammar in English, German, French and Spanish.
NEGATIONS = frozenset("""not no nobody none never neither nor without isn aren wasn don doesn
    nicht kein keine keinen niemand nie niemals ohne pas jamais aucun personne sans nadie nunca jamás sin ningún""".split())
REPORTS = frozenset("""said says wrote writes called claimed reported quoted alleged
    sagte sagt schrieb nannte behauptete dit écrit appelé affirmé dijo dice escribió llamó""".split())
TARGETS = frozenset("""you your yours u thou du dich dir dein deine ihr euch sie
    tu toi te ton ta vous votre tú ti tus usted ustedes vosotros""".split())
ANNOUNCEMENTS = frozenset("will shall gonna going werde werden wird vais va allons voy vas vamos".split())
THREATS = frozenset("""kill hurt destroy beat stab shoot burn töten umbringen schlagen verletzen
    tuer frapper détruire matar golpear destruir""".split())
# End of the fixed values.

THREAT_WEIGHT, NEGATED, REPORTED, AIMED, UNAIMED, REACH = 3.0, 0.25, 0.5, 1.5, 0.5, 3
#: Letters of a stem.
STEMS = range(3, 8)

Symbol = tuple[str, float]
State = object


def stems(word: str) -> list[str]:
    """What the insult lexicon may know a word by: the word, and its beginnings with a hyphen."""
    return [word, *[word[:n] + "-" for n in STEMS if n < len(word)]]


class Transducer:
    """A start state and a step: (state, symbol) to (state, symbol); read backwards if so wanted."""

    def __init__(
        self, start: State, step: Callable[[State, Symbol], tuple[State, Symbol]], backwards: bool = False
    ):
        self.start, self.step, self.backwards = start, step, backwards

    def __call__(self, symbols: Iterable[Symbol]) -> list[Symbol]:
        state, out = self.start, []
        for symbol in reversed(list(symbols)) if self.backwards else symbols:
            state, symbol = self.step(state, symbol)
            out.append(symbol)
        return out[::-1] if self.backwards else out


def _negation(left: int, symbol: Symbol):
    kind, weight = symbol
    if kind == "negation":
        return REACH, symbol
    return max(0, left - 1), (kind, weight * NEGATED if left else weight)


def _report(reported: bool, symbol: Symbol):
    kind, weight = symbol
    return reported or kind == "report", (kind, weight * REPORTED if reported else weight)


def _aim(aimed: bool, symbol: Symbol):
    """Marks weights that a target reaches, as "insult!" and "threat!"."""
    kind, weight = symbol
    marked = aimed and kind in ("insult", "threat")
    return aimed or kind == "target", (kind + "!" if marked else kind, weight)


def _threat(announced: bool, symbol: Symbol):
    kind, weight = symbol
    if kind == "threat" and not announced:
        return announced, (kind, 0.0)
    return announced or kind == "announcement", symbol


def _full(_: None, symbol: Symbol):
    kind, weight = symbol
    return None, (kind, weight * (AIMED if kind.endswith("!") else UNAIMED if kind == "insult" else 1.0))


GRAMMAR = [
    Transducer(False, _aim, backwards=True), Transducer(False, _aim), Transducer(False, _threat),
    Transducer(None, _full), Transducer(0, _negation),
    Transducer(False, _report, backwards=True), Transducer(False, _report),
]


def symbol(word: str, insults: dict[str, float]) -> Symbol:
    """The heaviest of what the lexicon knows a word by, or its place in the grammar."""
    weight = max((insults.get(s, 0.0) for s in stems(word)), default=0.0)
    if weight > 0:
        return "insult", weight
    if word in THREATS:
        return "threat", THREAT_WEIGHT
    for kind, words in (
        ("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("announcement", ANNOUNCEMENTS),
    ):
        if word in words:
            return kind, 0.0
    return "", 0.0


def clause_score(symbols: list[Symbol]) -> float:
    """The weights of a clause after every transducer; a clause without any scores nothing."""
    for transducer in GRAMMAR:
        symbols = transducer(symbols)
    return sum(weight for _, weight in symbols)


class Scorer:
    """Scores whole texts; remembers the symbols of words within a bound."""

    def __init__(self, insults: dict[str, float], most: int = 300_000):
        self.insults, self.most, self.known = insults, most, {}

    def __call__(self, text: str) -> float:
        total, clause, live = 0.0, [], False
        known = self.known
        for match in WORD.finditer(text.lower()):
            word = match.group()
            if word in CLAUSE_ENDS:
                total, clause, live = total + (clause_score(clause) if live else 0.0), [], False
                continue
            found = known.get(word)
            if found is None:
                found = symbol(word, self.insults)
                if len(known) >= self.most:
                    known.clear()
                if len(word) <= 64:
                    known[word] = found
            clause.append(found)
            live = live or found[1] > 0
        return total + (clause_score(clause) if live else 0.0)
