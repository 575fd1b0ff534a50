"""Personal information inside free text, replaced with typed placeholders.

Regular expressions propose spans. Where a kind of number has check digits (Luhn, mod 97, mod 11, mod 23, mod 31, ISO 7064, Verhoeff), the validator
confirms or refutes it: a confirmed number is accepted without further evidence and goes before what overlaps it, a refuted one only
where its own label stands beside it ("passport no.", "Steuer-ID"), since documents hold misspelt and invented numbers; card numbers and
IBANs are never accepted unconfirmed. Numbers without check digits and names start from a shape score that words nearby raise or lower
("phone" against "order", "build"); spans at or above ACCEPT are kept, and of overlapping ones the best. Names are pairs of a family name
with a given name or an initial: their score comes from a list of names, from the endings that the list's names share (so that names missing
from it are found), and from the words around them.

The text of one row decides alone, so this is one pass without a shuffle. The name list is sent to every task as sets of words.

Defined results: null text gives no spans; positions count code points from 1; ties of overlapping spans go to the longer, then the
earlier; a name inside an email address is no span; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.5
MOST_NAMES = 500_000
SPANS = "doc_id BIGINT, pii_type STRING, start_pos BIGINT, end_pos BIGINT, score DOUBLE"

# ---------------------------------------------------------------- checksums


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(text: str) -> bool:
    """IBAN check: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def mod11(digits: str) -> bool:
    """Two check digits over nine, weighted downwards."""
    for n in (9, 10):
        rest = sum(int(c) * w for c, w in zip(digits[:n], range(n + 1, 1, -1), strict=True)) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def mod23(digits: str, letter: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter


def iso7064(digits: str) -> bool:
    """Modulus 11, 10: one check digit behind ten, of which one comes twice or three times."""
    rest = 10
    for c in digits[:-1]:
        rest = ((int(c) + rest) % 10 or 10) * 2 % 11
    return (11 - rest) % 10 == int(digits[-1]) and len(set(digits[:-1])) in (8, 9)


def mod31(digits: str, letter: str) -> bool:
    return "0123456789ABCDEFHJKLMNPRSTUVWXY"[int(digits) % 31] == letter


def verhoeff(digits: str) -> bool:
    """The dihedral group of ten, with one permutation applied place by place."""
    permutation, c = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        for _ in range(i % 8):
            d = permutation[d]
        c = (c + d) % 5 if c < 5 and d < 5 else (c + d - 5) % 5 + 5 if c < 5 else (c - 5 - d) % 5 + 5 if d < 5 else (c - d) % 5
    return c == 0


# ---------------------------------------------------------------- words nearby (fixed values)

PHONE_WORDS = re.compile(r"(?i)\b(phone|call|tel|tél|téléphone|mobile|cell|fax|telefon|handy|rückruf|anruf|rappeler|appeler|llamar|teléfono|móvil|contact|kontakt|reach|dial)\b")
ID_WORDS = re.compile(r"(?i)(identi|passport|passeport|pasaporte|reisepass|\btax\b|steuer|fiscal|\bdni\b|\bnif\b|\bnie\b|\bssn\b|social|ausweis|documento|\bid\b|insurance|licen[cs]e|\bborn\b|national|sécu)")
NOT_PERSONAL = re.compile(
    r"(?i)\b(orders?|invoices?|builds?|versions?|releases?|devices?|serials?|tickets?|batch|shipments?|tracking|sku|part no|article|models?|firmware|commit|isbn|ports?|"
    r"rechnung(?:snummer)?|bestell(?:ung|nummer)|auftrag|gerät|seriennummer|commande|facture|appareil|pedido|factura|dispositivo)\b"
)
NAME_BEFORE = re.compile(
    r"(?i)(\b(?:by|per|for|from|to|of|with|ask|contact|attention|attn|cc|reported|signed(?:\soff)?|reviewer|tester|owner|assignee|author|holder|name|person)|\bms\.?|\bmr\.?|\bmrs\.?|\bdr\.?|"
    r"\b(?:frau|herrn?|durch|an|von|mit|für|testperson|prüfer|prüferin)|\b(?:mme|madame|monsieur|par|pour|avec|de|personne(?:\sde\stest)?)|\bm\.|"
    r"\b(?:por|con|para|avisó|persona(?:\sde\sprueba)?)|\bsra?\.?|thanks|regards|grüße|gruß|danke|merci|cordialement|saludos|gracias)[\s:;,=>\"]*$"
)
NAME_AFTER = re.compile(
    r"(?i)^[\s\"]*(<|\(|,\s+(?:phone|tél|teléfono|telefon|born|habite|vive|wohnt|lives|\d)|;\s+mobile|(?:at|en)\s+\S+@|mail\b|(?:is|was|has|had|will|would|can|could|did|wants|asked|said|wrote|called|signed|confirmed|lives)\b|"
    r"(?:ist|war|hat|wohnt|schrieb|bat)\b|(?:est|était|habite|a\sécrit)\b|(?:es|era|vive|escribió)\b)"
)
FILE_ENDS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "zip", "js", "css", "html", "json", "xml", "csv", "txt", "md"}

# ---------------------------------------------------------------- shapes

_DOT = r"(?:\.|\sdot\s|\s?[(\[{]\s?dot\s?[)\]}]\s?)"
_LOCAL = r"\w(?:[\w.+'’%-]*[\w+])?(?:(?:\sdot\s|\s?[(\[{]\s?dot\s?[)\]}]\s?)\w(?:[\w.+'’%-]*[\w+])?)*"
EMAIL = re.compile(rf"(?<![\w@/.]){_LOCAL}(?:(?:\s?@\s?|\s?[(\[{{]\s?at\s?[)\]}}]\s?)[\w-]+(?:{_DOT}[\w-]+)*{_DOT}|\sat\s[\w-]+(?:(?:\.|\sdot\s)[\w-]+)*\sdot\s)[^\W\d_]{{2,}}\b(?!\sat\s)", re.I)
#: Where digits are dense enough to be looked at.
DIGITS = re.compile(r"[+(]?\d[\d ()./+-]{5,}[\dA-Za-z]?(?:[A-Z0-9 ]{4,})?")
_AT = re.compile(r"@|[(\[{]\s?[aA][tT]\s?[)\]}]|(?<=[\w]) [aA][tT] (?=[\w.-]+ [dD][oO][tT] |\w+\.\w+ [dD][oO][tT] )")
PHONES = [
    (re.compile(r"(?<![\w+])(?:\+|00)\d{1,3}[ ./-]?(?:\(0\)[ ]?)?\(?\d(?:[ ./()-]{0,2}\d){6,12}(?!\d)"), 0.8),
    (re.compile(r"(?<![\w(])\(\d{3}\)[ -]?\d{3}[ -.]\d{4}(?!\d)"), 0.8),
    (re.compile(r"(?<![\w.+(/-])(?:1[.-])?[2-9]\d{2}([.-])\d{3}\1\d{4}(?![\d-])"), 0.6),
    (re.compile(r"(?<![\w.+/-])0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}(?![\w-])"), 0.55),
    (re.compile(r"(?<![\w.+/-])0\d(?:([. -])\d{2})(?:\1\d{2}){3}(?![\w])"), 0.6),
    (re.compile(r"(?<![\w.+/-])(?:\d{10}|0\d{9,10})(?![\w-])"), 0.2),
]
#: Pattern, shape score, check digits, and whether nothing stands in for them.
IDS = [
    (re.compile(r"(?<![\w.+/-])\d{3}([ -])\d{2}\1\d{4}(?![\w-])"), 0.5, "", False),
    (re.compile(r"(?<![\w.+/-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])"), 0.2, "mod11", False),
    (re.compile(r"(?<![\w.+/-])[A-Za-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Da-d](?!\w)"), 0.55, "", False),
    (re.compile(r"(?<![\w.+/-])[A-Za-z]{1,2}\d{7,8}[A-Za-z]?(?![\w-])"), 0.4, "", False),
    (re.compile(r"(?<![\w.+/-])\d{6}[-+A]\d{3}[0-9A-Y](?!\w)"), 0.2, "mod31", False),
    (re.compile(r"(?<![\w.+/-])(?<!\d[ -])\d{4}([ -])\d{4}\1\d{4}(?!\d|[ -]\d)"), 0.2, "verhoeff", False),
    (re.compile(r"(?<![\w.+/-])(?<!\d[ -])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w-]|[ -]\d)"), 0.2, "iso7064", False),
    (re.compile(r"(?<![\w.+/-])[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w-]|[ -]\d)"), 0.2, "nir", False),
    (re.compile(r"(?<![\w.+/-])[XYZxyz]?\d{7,8}-?[A-Za-z](?!\w)"), 0.3, "mod23", False),
    (re.compile(r"(?<![\w.+/-])(?:\d{4}[ -]?){3}\d{4}(?!\d)"), 0.45, "luhn", True),
    (re.compile(r"(?<![\w.+/-])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"), 0.45, "mod97", True),
]
CONFIRMED, REFUTED, LABELLED = 0.5, -0.1, 0.45
_W = r"[^\W\d_][\w'’-]*"
_STREETS = r"(?:Street|St\.|Ave(?:nue)?\.?|Road|Rd\.?|Lane|Ln\.?|Close|Way|Drive|Dr\.|Court|Place|Square|Boulevard|Blvd\.?|Terrace)"
#: Lower-case marks, where a digit or capital must be seen from a mark before its pattern is tried around it, and the pattern.
ADDRESSES = [
    (" street| st.| ave| road| rd| lane| ln| close| way| drive| dr.| court| place| square| boulevard| blvd| terrace", "digit before",
     re.compile(rf"(?<![\w#])(?:(?:Flat|Unit|Apt\.?|Apartment|Suite)\s\w+,\s)?\d{{1,5}}[A-Za-z]?,?\s(?:(?:North|South|East|West|Old|New|Upper|Lower|Saint|St\.)\s)?{_W}\s{_STREETS}(?!\w)(?!\s(?:level|map))", re.I)),
    ("box |postfach |postale |bp |b.p|apartado |correos |apdo|casilla ", "digit after",
     re.compile(r"(?<!\w)(?:P\.?\s?O\.?\s?Box|Post Office Box|Postfach|Boîte postale|B\.?P\.?|Apartado(?: de Correos)?|Apdo\.?|Casilla)\s(?:n[.ºo°]*\s?)?\d[\d ]{0,6}\d(?!\w)", re.I)),
    ("rue |avenue |av. |boulevard |bd |bd. |impasse |chemin |allée |quai |cours |place |route |square ", "digit before",
     re.compile(rf"(?<![\w#])\d{{1,4}}(?:\s?(?:bis|ter|[A-Da-d]))?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|impasse|chemin|allée|quai|cours|place|route|square)\s(?:(?:de la|de l['’]|du|des|de|d['’])\s?)?{_W}", re.I)),
    ("calle |c/|c. |avda|avenida |av. |plaza |pza|paseo |p.º|camino |ronda |carrer |travesía ", "digit after",
     re.compile(rf"(?<!\w)(?:Calle|C/|C\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Ronda|Carrer|Travesía)\s?(?:(?:de la|de los|de las|del|de)\s)?{_W}(?:\s{_W}){{0,2}},?\s(?:n\.?º?\s?)?\d{{1,4}}(?!\w)", re.I)),
    ("straße |strasse |str. |weg |platz |allee |gasse |ring |ufer |damm |chaussee ", "digit next",
     re.compile(r"(?<!\w)(?:(?:Neue|Alte|Große|Kleine|Obere|Untere)\s)?[^\W\d_][\w'’-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee)\s\d{1,4}\s?[A-Za-z]?(?!\w)", re.I)),
    ("am |an der |an den |im |in der |auf dem |auf der |zum |zur |unter den |beim ", "capital next",
     re.compile(r"(?<!\w)(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Beim|AM|IM)\s[^\W\d_a-z][\w'’-]*\s\d{1,4}\s?[A-Za-z]?(?!\w)(?!\s+[a-zäöü]+\b\s+(?:gilt|lang))")),
]
ADDRESSES = [(marks.split("|"), where, pattern) for marks, where, pattern in ADDRESSES]
_CAP = r"[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’](?=[^\W\d_]))+)?"
#: Two capitalised words, or an initial and one, perhaps with a middle initial or turned round by a comma; matches may overlap.
PAIR = re.compile(rf"(?<![\w@.'’-])(?=(({_CAP}|[^\W\d_a-zß-öø-ÿ]\.)(,?[ \xa0\u2009\u202f]{{1,3}})([^\W\d_a-zß-öø-ÿ]\.[ \xa0]{{1,3}})?({_CAP})(?![\w@])))[^\W\d_a-z]")
_GIVEN_BEFORE = re.compile(rf"(?<![\w@.'’-])({_CAP})[ \xa0]{{1,3}}\Z")
#: Capitalised words that begin sentences or carry titles, never part of a name.
NOT_NAMES = frozenset(
    "the a an in on at of for from to by per with check it if when after before between nobody everybody earlier every each some all any owner reported signed contact please ask reviewer ms mr mrs dr "
    "thanks regards test expected observed actual steps scope ship order build version package see section chapter figure table appendix rollback release note notes open points page item and or not as is this "
    "that there here he she they we you i no yes passport national identity tax number id email phone po box flat unit street close lane way ave avenue rd road old new north south east west "
    "frau herr herrn der die das ein eine und von durch an am im nach wenn zu mit für offen freigabe gemeldet rückfragen bitte ausweis ausweisnummer reisepass telefon danke grüße gruß tester kunde kundin nutzer testperson "
    "mme madame monsieur le la les un une et par pour avec de du des si copie merci rappeler tel tél signalé validé cordialement passeport rue boulevard impasse "
    "sr sra el lo los las una y por con para si copia llamar aprobado consultar saludos gracias pasaporte calle plaza avda".split()
)


@dataclass
class Names:
    """What the list says: names by kind, the endings that several names share, and the words that are also ordinary ones."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    given_ends: set[str] = field(default_factory=set)
    family_ends: set[str] = field(default_factory=set)
    seen: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Names:
        out = cls()
        for name, kind in rows:
            if name:
                (out.given if kind == "given" else out.family).add(name.casefold())
        out.given_ends, out.family_ends = cls._ends(out.given), cls._ends(out.family)
        return out

    @staticmethod
    def _ends(names: set[str], least: int = 4) -> set[str]:
        """Endings of 3 to 6 letters that at least ``least`` names have, and no shorter one if a longer one is as common."""
        counts = Counter(n[-k:] for n in names for k in range(3, 7) if len(n) >= k + 2)
        return {e for e, c in counts.items() if c >= least}

    def kind(self, word: str) -> tuple[float, float]:
        """How far the word is a given and a family name, 0 to 1. Listed words with an ending of their kind are sure."""
        if word not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = self._kind(word)
        return self.seen[word]

    def _kind(self, word: str) -> tuple[float, float]:
        best_g = best_f = 0.0
        for part in word.casefold().split("-"):
            like_g = any(part[-k:] in self.given_ends for k in range(3, 7)) and len(part) >= 4
            like_f = any(part[-k:] in self.family_ends for k in range(3, 7)) and len(part) >= 5
            g = 0.6 if part in self.given else 0.0
            f = 0.6 if part in self.family else 0.0
            best_g, best_f = max(best_g, g + 0.4 if g and like_g else g or 0.5 * like_g), max(best_f, f + 0.4 if f and like_f else f or 0.5 * like_f)
        return best_g, best_f


_LEFT_EDGE, _RIGHT_EDGE = re.compile(r"[\r\n]|(?<=\w{4}[.!?])\s"), re.compile(r"[\r\n]|(?<=\w{4})[.!?]\s")


def _near(text: str, start: int, end: int, before: int = 70, after: int = 45) -> tuple[str, str]:
    """The words before and after a span, not past its line or sentence."""
    left = _LEFT_EDGE.split(text[max(0, start - before) : start])[-1]
    right = _RIGHT_EDGE.split(text[end : end + after], maxsplit=1)[0]
    return left, right


def _alone(left: str, right: str) -> bool:
    return not left.strip(" \t\u200b\ufeff>-*•✅🧪🙂") and not right.strip(" \t.\u200b")


_NEXT_WORDS = re.compile(r"(?: [^\W\d_A-ZÀ-Þ]\w*){0,5}")  # the sentence goes on in lower case
_TELLING = ((PHONE_WORDS, "phone"), (ID_WORDS, "id_number"), (NOT_PERSONAL, "other"))


def _label(before: str, after: str) -> str:
    """What the nearest telling word says that a number is: phone, id_number, other (not personal), or nothing."""
    near = [(len(before) - m.end(), kind) for pattern, kind in _TELLING for m in pattern.finditer(before)]
    near += [(m.start(), kind) for pattern, kind in _TELLING for m in pattern.finditer(after)]
    return min(near)[1] if near else ""


def _numbers(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Spans of digits that may be a phone or an identity number; the shapes are tried only around runs of digits."""
    for run in DIGITS.finditer(text):
        a, b = max(0, run.start() - 4), min(len(text), run.end() + 1)
        tried = [("phone", m, shape, ()) for p, shape in PHONES for m in p.finditer(text, a, b)]
        tried += [("id_number", m, shape, rest) for p, shape, *rest in IDS for m in p.finditer(text, a, b)]
        for kind, m, shape, rest in tried:
            left, right = _near(text, m.start(), m.end())
            said = _label(left, _NEXT_WORDS.match(right).group())
            if kind == "phone":
                if not 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    continue
                score = shape + 0.4 * (said == "phone") - 0.5 * (said in ("id_number", "other")) + 0.35 * _alone(left, right) + 0.1 * bool(re.match(r"\s*(ext|x)\b", right))
            else:
                check, strict = rest
                sound = bool(check) and _sound(check, re.sub(r"[^0-9A-Za-z]", "", m.group()).upper())
                if strict and not sound:
                    continue
                score = shape + (0 if not check else CONFIRMED if sound else REFUTED) + LABELLED * (said == "id_number") - 0.6 * (said == "other") - 0.3 * (said == "phone" and not sound)
            if score >= ACCEPT - 1e-9:
                yield kind, m.start(), m.end(), score


def _sound(check: str, bare: str) -> bool:
    """Whether the check digits of a number (its digits and letters only) are right."""
    if check == "mod23":
        digits, letter = bare[:-1].translate(str.maketrans("XYZ", "012")), bare[-1]
        return len(digits) == 8 and mod23(digits, letter)
    if check == "mod31":
        return mod31(bare.replace("A", "", 1)[:9] if bare[6] == "A" else bare[:9], bare[-1])
    if check == "nir":
        return 97 - int(bare[:13]) % 97 == int(bare[13:])
    return {"mod11": mod11, "verhoeff": verhoeff, "luhn": luhn, "mod97": mod97, "iso7064": iso7064}[check](bare)


def _names(text: str, names: Names, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
    for m in PAIR.finditer(text):
        first, middle, last = m.group(2), m.group(4), m.group(5)
        start, end = m.start(2), m.end(5)
        if any(a < end and start < b for a, b in taken):
            continue
        initial, turned = first[1:2] == ".", "," in m.group(3)
        if turned and (initial or middle):
            continue
        given = _GIVEN_BEFORE.search(text, max(0, start - 25), start) if initial else None
        if given and given.group(1).casefold() not in NOT_NAMES:
            continue  # a middle initial
        one, two = names.kind(first), names.kind(last)
        g, f = (two[0], one[1]) if turned else (0.4 if initial else one[0], two[1])
        if max(g, f) < 0.5 or (initial and not f):
            continue
        words = (first.casefold(), last.casefold())
        if any(w in NOT_NAMES and w not in names.given and w not in names.family for w in words):
            continue
        left, right = _near(text, start, end, 30, 28)
        near = bool(NAME_BEFORE.search(left)) or bool(NAME_AFTER.match(right)) or _alone(left, right)
        if g and f:
            score = 0.5 * (g + f) - 0.1 * turned + 0.25 * near
        elif near:
            score = 0.35 + 0.5 * max(g, f) if not turned else (0.5 if max(g, f) >= 0.6 or NAME_BEFORE.search(left) else 0.0)
        else:
            score = 0.0
        if not near and text[end : end + 2][1:].isdigit():
            score -= 0.6  # a numbered thing, not a person
        if score >= ACCEPT - 1e-9:
            yield "name", start, end, score


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _addresses(text: str) -> set[tuple[int, int]]:
    low, found = _lower(text), set()
    for marks, where, pattern in ADDRESSES:
        for mark in marks:
            i = low.find(mark)
            while i >= 0:
                j = i + len(mark)
                if (
                    (where == "digit next" and text[j : j + 1].isdigit())
                    or (where == "capital next" and text[j : j + 1].isupper())
                    or (where == "digit before" and any(c.isdigit() for c in text[max(0, i - 40) : i]))
                    or (where == "digit after" and any(c.isdigit() for c in text[j : j + 40]))
                ):
                    found.update(m.span() for m in pattern.finditer(text, max(0, i - 60), min(len(text), j + 60)))
                i = low.find(mark, j)
    return found


def find_spans(text: str, names: Names) -> list[tuple[str, int, int, float]]:
    """(type, start, end, score) from 0, not overlapping, in order."""
    found: list[tuple[str, int, int, float]] = []
    for mark in _AT.finditer(text):
        for m in EMAIL.finditer(text, max(0, mark.start() - 80), min(len(text), mark.end() + 120)):
            host = re.split(r"@|[(\[{ ]\s?at[)\]} ]", m.group(), flags=re.I)[-1]
            if m.group().rsplit(".", 1)[-1].casefold() not in FILE_ENDS and not re.match(r"\s?\dx\b", host):
                found.append(("email", m.start(), m.end(), 1.5))
    mail = sorted({(a, b) for _, a, b, _ in found})
    found += [("address", a, b, 0.9) for a, b in _addresses(text)]
    found += _numbers(text)
    found += _names(text, names, mail)
    kept: list[tuple[str, int, int, float]] = []
    for x in sorted(found, key=lambda x: (-x[3], x[1] - x[2], x[1])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[1])


def _list(names: DataFrame) -> Names:
    rows = names.where("person_name IS NOT NULL").select("person_name", "name_kind").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the name list is sent to every task; it may hold at most {MOST_NAMES} names")
    return Names.of([tuple(r) for r in rows])


def pii_spans(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``SPANS`` of every document; positions from 1, ``end_pos`` inclusive."""
    known = _list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, kind, a + 1, b, s) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for kind, a, b, s in find_spans(text, known)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos", "end_pos", "score"])

    return docs.where("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, SPANS)


def redacted(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text, found): every text with ``[EMAIL]``, ``[PHONE]``, ... in the place of what was found."""
    known = _list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = find_spans(text, known) if text else []
                out, at = [], 0
                for kind, a, b, _ in spans:
                    out += [text[at:a], f"[{kind.upper()}]"]
                    at = b
                rows.append((doc, "".join(out) + text[at:] if text is not None else None, len(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "found"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id BIGINT, text STRING, found INT")
