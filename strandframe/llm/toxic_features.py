"""Dense features of a text for the toxicity classifier. Workers load this module and not the library of models."""

from __future__ import annotations

import math
import re

#: Words of abuse in four languages, and pronouns of the second person; parameters of the features.
LEXICON = (
    "idiot idiots moron morons stupid loser losers trash scum worthless pathetic disgusting clown clowns dumb dumbass imbecile fool jerk filth vermin "
    "bastard bitch asshole retard freak ugly garbage crap shit fuck fucking kill die hate dummkopf trottel arschloch abschaum dreck hurensohn versager "
    "connard salaud salope crétin abruti ordure minable idiota imbécil estúpido estúpida basura escoria payaso inútil cabrón gilipollas mierda"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te vous ton ta votre tú ti usted ustedes vosotros".split()
PROXIMITY = 6
FEATURES = ["mark_rate", "mark_hits", "mark_kinds", "log_words", "lexicon_rate", "lexicon_hits", "lexicon_kinds", "near_second_person", "second_person_rate", "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "symbol_rate", "obfuscated_rate", "stretched_rate"]

_HIT = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(sorted(LEXICON, key=len, reverse=True)))
_SECOND = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(sorted(SECOND_PERSON, key=len, reverse=True)))
_SHOUT = re.compile(r"(?<!\w)[A-Z]{3,}(?!\w)")
_OBFUSCATED = re.compile(r"[A-Za-z]+(?:[@$*#]+|[0-9]+)[A-Za-z]+")
_STRETCHED = re.compile(r"([a-z])\1\1")
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace() or chr(b) in ".,;:'\"-!?")


def mark_pattern(marks: list[str]) -> re.Pattern:
    """Finds words that begin with a mark; without marks it finds nothing."""
    if not marks:
        return re.compile(r"(?!)")
    first = "".join(sorted({re.escape(m[0]) for m in marks}))
    return re.compile(r"(?<!\w)(?=[%s])(?:%s)" % (first, "|".join(map(re.escape, sorted(marks, key=len)))))


def features(text: str, marked: re.Pattern) -> tuple[float, ...]:
    """Dense features of one whole text; the empty text has zeros only."""
    raw, low = text.encode("utf-8", "replace"), text.lower()
    words = len(text.split()) or 1
    hits = [(m.start(), m[0]) for m in _HIT.finditer(low)]
    near = 0
    for at, word in hits:  # the lexicon's words with a second person within a few words on either side
        before = " ".join(low[max(0, at - 120) : at].split()[-PROXIMITY:])
        after = " ".join(low[at + len(word) : at + len(word) + 120].split()[:PROXIMITY])
        near += bool(_SECOND.search(before) or _SECOND.search(after))
    chars = max(1, len(raw))
    marks = marked.findall(low)
    return (
        len(marks) / words, float(len(marks)), float(len(set(marks))),
        math.log(words), len(hits) / words, float(len(hits)), float(len({w for _, w in hits})), float(near), sum(1 for _ in _SECOND.finditer(low)) / words,
        len(raw.translate(None, _NOT_CAPITAL)) / chars, len(_SHOUT.findall(text)) / words, text.count("!") / chars, text.count("?") / chars,
        len(raw.translate(None, _PLAIN)) / chars, len(_OBFUSCATED.findall(text)) / words, len(_STRETCHED.findall(low)) / words,
    )
