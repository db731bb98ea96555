"""What the name of a field suggests: types that it supports or speaks against, and how strongly.

A name is read as its words, joined by single spaces. A rule has patterns over that text, by how
they match: the whole name, words in a row or all of some words, its start or end, or one word. A
last word that names a measure of the thing (``email_status``) turns what its start or middle
suggests into a reason against it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

#: How a name matches, strongest first.
STRENGTHS = ("exact", "sequence", "affix", "token")
# Words of measures, the words of each type's rules, and the technical types a hint counts for.
MEASURES = frozenset("status statut length len longueur count nb nombre total sum format type valid invalid validity error errors check hash flag".split())
TEXT, DIGITS, AMOUNTS, DATES = ("text", "mixed"), ("text", "integer", "mixed"), ("text", "integer", "number", "mixed"), ("text", "mixed", "date")


@dataclass(frozen=True)
class Rule:
    """Patterns of whole names, ends, starts, words, rows of words, and words in any order, for one type."""

    target: tuple[str, str | None] | None
    technical: tuple[str, ...]
    whole: str = ""
    end: str = ""
    start: str = ""
    word: str = ""
    row: str = ""
    every: tuple[str, ...] = ()
    against: tuple[tuple[str, str], ...] = ()
    vetoed: bool = True


RULES = (
    Rule(("identifier", "id"), ("text", "integer"), "id|identifiant|identifier", "id|ref|key", "id"),
    Rule(("identifier", "id"), ("text", "integer"), every=("client|customer|order|commande", "id")),
    Rule(("web_network", "uuid"), TEXT, "uuid|guid", "uuid|guid"),
    Rule(("web_network", "url"), TEXT, "url|website|web site|site web", "url"),
    Rule(("contact", "email"), TEXT, "email|e mail|mail|courriel|email address|adresse email|adresse courriel", "email|courriel|mail", word="email|courriel"),
    Rule(("contact", "phone"), DIGITS, "telephone|phone|tel|telephone mobile|mobile phone|phone number|numero telephone", "phone|telephone|tel", word="phone|telephone"),
    Rule(("geographic", "postal_code"), DIGITS, "postal code|code postal|zip code|zip|postcode", row="postal code|code postal|zip code", every=("postal", "code")),
    Rule(("categorical", "boolean"), ("text", "boolean", "integer", "mixed"), end="flag", start="is|has|can|est", vetoed=False),
    Rule(("categorical", "enum"), DIGITS, "sexe|sex|gender|genre", against=(("categorical", "boolean"),)),
    Rule(("temporal", "date"), DATES, "birth date|date naissance|date of birth|dob|date", "date", "date", every=("birth|naissance", "date")),
    Rule(("temporal", "datetime"), DATES, "created at|updated at|modified at|deleted at|timestamp|datetime|date time", "at"),
    Rule(("temporal", "time"), DATES, "time|heure", "time|heure"),
    Rule(None, (), word="year|annee|month|mois|day|jour", against=(("temporal", "date"), ("temporal", "datetime"), ("temporal", "time")), vetoed=False),
    Rule(("text", None), ("text",), "description|commentaire|comment|comments|note|notes|remarque|remarques"),
    Rule(("numeric", "currency"), AMOUNTS, "price|prix|amount|montant|cost|cout", "price|amount|cost|prix|montant", "prix|montant"),
    Rule(("numeric", "quantity"), AMOUNTS, "quantity|quantite|qty", "qty|quantity", "quantite"),
    Rule(("numeric", "percentage"), AMOUNTS, end="pct|percent|percentage|pourcentage", every=("discount|remise", "pct|percent|pourcentage")),
)


@dataclass(frozen=True)
class Hint:
    family: str
    type: str | None
    strength: str
    supports: bool
    technical: tuple[str, ...]

    def about(self, family: str, kind: str) -> bool:
        return self.family == family and self.type in (None, kind)


def words(name: str) -> str:
    """The words of a name without accents, in lower case: capitals after small letters, and ends of acronyms, part words."""
    parted = re.sub(r"(?<=[^\W_A-Z])(?=[A-ZÀ-ÖØ-Þ])|(?<=[A-Z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFC", name))
    bare = "".join(c for c in unicodedata.normalize("NFD", parted) if unicodedata.category(c) != "Mn")
    return " ".join(re.findall(r"[^\W_]+", bare.lower()))


@lru_cache(4096)
def hints(name: str) -> tuple[Hint, ...]:
    """For each type that the name says something of, the strongest hint for it and the strongest against it."""
    text = words(name)
    own = text.split()
    if not own:
        return ()
    best: dict[tuple, Hint] = {}

    def note(target: tuple[str, str | None], strength: str, supports: bool, rule: Rule) -> None:
        key = (*target, supports)
        if key not in best or STRENGTHS.index(strength) < STRENGTHS.index(best[key].strength):
            best[key] = Hint(*target, strength, supports, rule.technical)

    for rule in RULES:
        # (strength, whether a measure at the end turns it round, words of the pattern)
        found: list[tuple[str, bool, str]] = []
        if rule.whole and re.fullmatch(rule.whole, text):
            found.append(("exact", False, rule.whole))
        if rule.end and re.fullmatch(f".+ ({rule.end})", text):
            found.append(("affix", False, rule.end))
        if rule.start and re.fullmatch(f"({rule.start}) .+", text):
            found.append(("affix", True, rule.start))
        if rule.word and set(rule.word.split("|")) & set(own):
            found.append(("token", True, rule.word))
        if rule.row and re.search(f"(^| )({rule.row})( |$)", text):
            found.append(("sequence", True, rule.row))
        if rule.every and all(set(group.split("|")) & set(own) for group in rule.every):
            found.append(("sequence", True, "|".join(rule.every)))
        for strength, open_to_veto, pattern in found:
            turned = rule.vetoed and open_to_veto and len(own) > 1 and own[-1] in MEASURES and own[-1] not in re.split(r"[| ]", pattern)
            if rule.target:
                note(rule.target, strength, not turned, rule)
            if not turned:
                for other in rule.against:
                    note(other, strength, False, rule)
    return tuple(sorted(best.values(), key=lambda h: (STRENGTHS.index(h.strength), h.family, h.type or "", h.supports)))


def chosen(types: list[tuple[str, str]], name: str) -> list[tuple[str, str]]:
    """Which of the types that the values allow the name leaves: those it does not speak against (unless it does against
    all), and of these those it supports, if any."""
    told = hints(name)
    left = [t for t in types if not any(h.about(*t) and not h.supports for h in told)] or list(types)
    return [t for t in left if any(h.about(*t) and h.supports for h in told)] or left
