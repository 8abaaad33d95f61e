"""Personal data replaced by surrogates.

Emails, telephone numbers, payment cards (by issuer prefix and Luhn digit), IP addresses of both versions, IBANs, social
security numbers and names are detected: names after forms of address, a known given name with the capitalised words
after it, and all mentions of the parts of such a name in the same document. Each value gets a surrogate that a key and
its canonical value determine, of the same type and format. Canonical is what the spelling doesn't change: digits without
punctuation, letters in lower case, an address as its groups; the spelling is put on again afterwards. So coreference
holds over spellings. An email keeps its shape and gets a reserved domain; a card keeps its issuer digit and a valid Luhn
digit, an IBAN its country and valid check digits, a telephone number its country code, an address its kind. A known
given name or family name becomes another one of its gender, script and length; another name keeps its script, length,
letter case, pattern of vowels and last letter, so that grammatical gender shows as before. The form of address stays.

A surrogate is a keyed permutation without fixed points of the canonical values of a format: a Feistel network with a
keyed hash, a turn by one, and the network backwards, walked until a value is valid; since the value itself is, the walk
ends, at the value itself only where the format has no other. Equal values get equal surrogates and different ones
different surrogates, in every document of a run: coreference and distinctness need no table of what was seen.
``collisions`` checks this over the whole corpus; where one is found, which takes equal hashes of two domains, the query
goes on to the next key until there is none.

The key is the setting spark.nearfield.surrogate.key; without it each run draws its own, so that nobody can undo it.

Defined results: a null text stays null and an empty one empty; texts without personal data are returned as they are;
overlapping finds are resolved leftmost first, then longest. Repeated rows give equal rows, an empty table an empty
result. Only doc_id and text are read, so that other columns, whatever their names, don't matter. Names that no form of
address and no known given name tells aren't found.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The setting that holds the key.
SETTING = "spark.nearfield.surrogate.key"
ROUNDS = 8

#: Forms of address, by gender; fixed values.
MALE = "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don".split()
FEMALE = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Doña".split()
NEUTRAL = "Dr Prof Mx".split()

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[\w-]+(?:\.[\w-]+)+")
NUMBERS = (
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])(?:\d[ -]?){12,18}\d(?![\w])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?<!\d[ .-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])(?![ .-]\d\d)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])")),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)")),
)
#: Where numbers are: every number pattern holds a match of this, and reaches REACH beyond it at most.
DIGITS = re.compile(r"[0-9][0-9 ().+-]{2,}[0-9]")
REACH = 64
IPV6 = re.compile(rf"(?<![\w:.])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}(?:{_OCTET}(?:\.{_OCTET}){{3}}|[0-9A-Fa-f]{{0,4}})(?![\w:])")
FORMS = [*MALE, *FEMALE, *NEUTRAL]
#: Given names by gender, and family names, in lower case; fixed values.
MALE_NAMES = "adam alan alex carl dave dirk eric erik fred gary glen hans henk ivan jack jean jens joel john jorg jose juan karl kurt lars leon luca luis marc mark mats neil nick noah olaf omar otto owen paul pepe rene rolf ryan saul sean seth theo toni aaron alain allan bjorn brian bruce bryan caleb colin craig david diego dylan emile ernst felix frank franz georg heinz henri henry horst jacob james jason jesus jorge josef kevin klaus lewis louis lucas lukas mario mason miguel pablo pedro peter pierre ralph roger ruben simon steve tomas albert andrea andres andrew antoine arthur daniel donald edward enrique ernesto ethan eugene fabian gerard gerald george harold harry helmut jerome joseph joshua julian julien jurgen justin laurent manuel marcel marcos martin mathieu matteo michael michel nathan nicolas oliver olivier pascal patrick philip rafael ramon ricardo richard robert roberto ronald ronan russell samuel sergio stefan steven thomas victor vincent walter werner wilhelm william wolfgang andreas anthony antonio antoine bernard bertrand charles christian christoph dominik fernando francisco francois frederic gregory guillaume gunther heinrich jonathan leonardo matthew matthias maximilian raymond sebastian stephen theodore tobias иван пётр олег юрий глеб илья антон борис вадим денис игорь павел роман семён степан фёдор андрей виктор кирилл максим михаил никита сергей алексей дмитрий николай тимофей владимир григорий александр константин".split()
FEMALE_NAMES = "anna anne cara cleo dana dora ella elsa emma erin gina greta ines inge jane jana joan june kate lara lena lisa lola lucy lynn maja mary maya mila nina nora olga rita rosa ruth sara tina vera adele alice amber angela anita astrid birgit carla chloe clara claire daisy diana edith elena elise ellen emily erika fiona frida gloria grace hanna heidi helen helga irene irina jenny joyce julia julie karen karin kathy katja laura leila linda lucia luisa maria marie marta megan monica nadia nancy nicole paula petra renate sabine sandra sarah silvia sofia sonja susan sylvie ursula abigail adriana agnes amelie andrea barbara beatriz brigitte camille carmen carolina caroline catherine cecile charlotte christa christine claudia cristina deborah dolores dorothy eleanor elizabeth emilie francoise gabriela gertrud hannah heather ingrid isabel isabelle jacqueline jessica josefina juliette katharina lorena madeleine manuela margaret margarita margot martha martina mathilde melissa michelle monika nathalie olivia pamela patricia pauline rebecca rosario sophie stefanie stephanie susanne theresa valerie veronica veronika victoria virginia yvonne анна вера инна лада майя нина ольга алина алёна дарья елена ирина лидия мария софья галина жанна ксения марина оксана полина тамара татьяна людмила наталья светлана анастасия екатерина валентина".split()
FAMILY_NAMES = "bell cole ford gray hall hill king lane long moss page reed ross todd wade ward webb wood adams allen baker bauer brown clark cohen cooper davis evans fischer flores garcia gomez gonzalez green harris hoffmann huber hughes jackson johnson jones keller klein lambert lange leroy lewis lopez martinez mayer meyer miller moore moreau morgan morris muller müller navarro nelson nguyen parker perez peters phillips richter rivera robinson rodriguez rogers roux sanchez schäfer schmidt schmitt schneider schulz schwarz scott simon smith stewart taylor torres turner vogel wagner walker watson weber weiss white williams wilson wolf wright young zimmermann 王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 김 이 박 최 정 강 조 윤 장 임".split()
#: Words of names that stay, and capitalised words that go on after a name but are no part of it; fixed values.
PARTICLES = frozenset("van von der den de del della di da do dos du la le las los el zu zur zum ter ten af av bin ibn al y e".split())
NO_NAMES = "Jr II III IV He She It They We You The This That These Those A An In On At But And Or Er Sie Es Wir Der Die Das Und Aber Il Elle Ils Elles Nous Vous Les Et Mais Ella Ellos Los Las Un Una Pero".split()
_DEGREE = r"(?:[  ]?(?:med|phil|rer|nat|jur|iur|ing|habil|h\. ?c)\.)*"
_FORM = rf"(?:{'|'.join(FORMS)})"
#: Forms that aren't a first name as well.
_NEXT_FORM = rf"(?:{'|'.join(f for f in FORMS if f not in ('Don', 'Sir'))})"
_PART = rf"(?!(?:{_NEXT_FORM}|{'|'.join(NO_NAMES)})(?!\w))(?:(?:[^\W\d_]\.)+(?![^\W\d_]{{2,}}\.)|{_NAME})"
NAMED = re.compile(rf"(?<!\w){_FORM}\.?{_DEGREE}(?:[  ](?:(?:and|und|et|y|e|&)[  ])?{_NEXT_FORM}(?!\w)\.?{_DEGREE})*[  ]((?:(?:{'|'.join(sorted(PARTICLES))})[  ])*{_PART}(?:(?:[  ]|(?<=\.))(?:(?:{'|'.join(sorted(PARTICLES))})[  ])*{_PART})*)")
LETTERS = re.compile(r"[^\W\d_]+")
#: A capitalised word before another one, or before an initial: a name where the first is a given name.
PAIR = re.compile(rf"(?<!\w)([A-ZÀ-ÖØ-ÞЀ-Я][^\W\d_]+)(?=(?:[  ](?:{'|'.join(sorted(PARTICLES))}))*[  ](?:[^\W\d_a-zß-ÿ][^\W\d_]|[^\W\d_a-zß-ÿ]\.))")
GIVEN = frozenset(w.capitalize() for w in [*MALE_NAMES, *FEMALE_NAMES])
AFTER = re.compile(rf"(?:[  ](?:(?:{'|'.join(sorted(PARTICLES))})[  ])*{_PART})+")
MENTION = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
KIND_ORDER = ("email", "iban", "card", "ssn", "phone", "ip", "name")
#: Issuer prefixes of payment cards; fixed values.
ISSUER = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|3[68]|6011|64[4-9]|65|35(?:2[89]|[3-8])")


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    value: str


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return len(digits) in (13, 14, 15, 16, 19) and luhn(digits) and bool(ISSUER.match(digits)) and digits.isascii()
    if kind == "iban":
        flat = value.replace(" ", "")
        return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[-4:] != "0000"
    if kind == "phone":
        return 8 <= sum(c.isdigit() for c in value) <= 15 and value.isascii()
    if kind == "ip" and ":" in value:
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return any(c.isdigit() for c in value) or len(value.replace(":", "")) >= 8
    return value.isascii() if kind == "ip" else True


def _numbers(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, kind, value) of number patterns, looked for around digits only."""
    spans: list[list[int]] = []
    for m in DIGITS.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([start, end])
    for start, end in spans:
        part = text[max(0, start - 1) : end + 1]
        for kind, pattern in NUMBERS:
            for m in pattern.finditer(part):
                yield max(0, start - 1) + m.start(), kind, m.group()


def _names(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, kind, value) of names that follow forms of address, with initials and all their words."""
    if not any(f + " " in text or f + "." in text or f + "\u00a0" in text for f in FORMS):
        return
    for m in NAMED.finditer(text):
        words = list(re.finditer(r"[^\s.]+\.?", m.group(1)))
        n = 0
        for k, w in enumerate(words):
            if w.group()[0].isupper():
                n = k + 1
            elif w.group() not in PARTICLES:
                break
        if n:
            yield m.start(1), "name", m.group(1)[: words[n - 1].end()]


def _given(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, kind, value) of known given names with the capitalised words after them."""
    for m in PAIR.finditer(text):  # few texts hold more than a few capitalised words in a row
        if m.group(1) in GIVEN and (rest := AFTER.match(text, m.end())):
            words, n = list(re.finditer(r"[^\s.]+\.?", rest.group())), 0
            for k, w in enumerate(words):
                if w.group()[0].isupper():
                    n = k + 1
                elif w.group() not in PARTICLES:
                    break
            if n:
                yield m.start(), "name", m.group(1) + rest.group()[: words[n - 1].end()]


def mentions(text: str, found: list[Entity]) -> list[Entity]:
    """Other places of a text where a part of a name that was found in it stands, in any of the usual letter cases."""
    parts = {w for e in found if e.kind == "name" for w in LETTERS.findall(e.value) if len(w) > 1 and w[0].isupper() and w.lower() not in PARTICLES}
    if not parts:
        return []
    parts |= {x for w in parts for x in (w.upper(), w.capitalize())}
    out, k = [], 0
    for m in MENTION.finditer(text):
        while k < len(found) and found[k].end <= m.start():
            k += 1
        if m.group() in parts and (k == len(found) or m.end() <= found[k].start):
            out.append(Entity(m.start(), m.end(), "name", m.group()))
    return out


def entities(text: str | None) -> list[Entity]:
    """All that is replaced in a text, in order: what detect() finds, and the mentions of the names found."""
    found = detect(text)
    return sorted(found + mentions(text, found), key=lambda e: e.start) if found else found


def detect(text: str | None) -> list[Entity]:
    """Personal data of a whole text, in order, without overlap."""
    if not text:
        return []
    found = [(m.start(), "email", m.group().rstrip("._-")) for m in EMAIL.finditer(text)] if "@" in text else []
    found += _numbers(text)
    if "::" in text or text.count(":") >= 6:
        found += [(m.start(), "ip", m.group()) for m in IPV6.finditer(text)]
    found += _names(text)
    found += _given(text)
    out: list[Entity] = []
    for start, kind, value in sorted(found, key=lambda x: (x[0], -len(x[2]), KIND_ORDER.index(x[1]))):
        if _valid(kind, value) and (not out or start >= out[-1].end):
            out.append(Entity(start, start + len(value), kind, value))
    return out


# surrogates


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=hashlib.sha256(key).digest(), digest_size=16).digest(), "big")


def permute(x: int, n: int, key: bytes, label: str, back: bool = False) -> int:
    """A keyed permutation of 0..n-1, or its inverse: a Feistel network on the next power of four, walked until it is below n."""
    if n <= 1:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ (_prf(key, label, n, r, a) & mask), a
            else:
                a, b = b, a ^ (_prf(key, label, n, r, b) & mask)
        x = a << half | b
        if x < n:
            return x


def derange(x: int, n: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0..n-1 that is one cycle, so that nothing stays in its place where n is 2 or more."""
    return permute((permute(x, n, key, label) + 1) % n, n, key, label, back=True) if n > 1 else x


#: Vowels and other letters of scripts whose names keep their pattern; fixed values.
LETTER_GROUPS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
GROUP_OF = {c: g for g in LETTER_GROUPS for c in g}


def _alphabet(c: str) -> str:
    """The lower-case letters that may stand for ``c``: of its script and kind; ``c`` alone where nothing else will do."""
    if (group := GROUP_OF.get(c)) is not None:
        return group
    if c.isascii() or not c.isalpha():
        return "0123456789" if c.isdecimal() and c.isascii() else c
    script, base = unicodedata.name(c, "").split(" ")[0], ord(c) // 16 * 16
    # neighbours in the table of characters, of the same script and case
    near = [chr(x) for x in range(base, base + 16)]
    found = "".join(x for x in near if unicodedata.name(x, "").split(" ")[0] == script and x.isalpha() and x.lower() == x and len(x.upper()) == 1 and x not in GROUP_OF)
    return found if c in found else c


def _move(parts: list[str], sets: list[str | list[str] | range], key: bytes, label: str) -> list[str]:
    """A keyed permutation of all combinations of ``sets``, at ``parts``, which are one of them."""
    x, n = 0, 1
    for c, s in zip(parts, sets, strict=True):
        x, n = x * len(s) + s.index(c), n * len(s)
    x = derange(x, n, key, label + "|" + "".join(f"{s[0]}{len(s)}" for s in sets))
    out = []
    for s in reversed(sets):
        x, k = divmod(x, len(s))
        out.append(s[k])
    return out[::-1]


def _walk(parts: list[str], sets: list, key: bytes, label: str, valid) -> list[str]:
    """_move until the result is valid. The move is one cycle and ``parts`` are valid, so that it ends."""
    while True:
        parts = _move(parts, sets, key, label)
        if valid(parts):
            return parts


DIGIT = "0123456789"
#: Values of an octet by its number of digits.
OCTETS = {n: [str(x) for x in range(low, high)] for n, low, high in ((1, 0, 10), (2, 10, 100), (3, 100, 256))}
#: First two digits of country codes of three digits; all others but 1 and 7 have two. Fixed values.
LONG_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())


def _digits(value: str, kind: str, key: bytes, kept: set[int], valid=lambda d: True) -> str:
    """``value`` with other digits, but for those whose places are in ``kept``; the punctuation stays."""
    own = [c for c in value if c.isdigit()]
    sets = [own[k] if k in kept else DIGIT for k in range(len(own))]
    new = iter(_walk(own, sets, key, kind, lambda d: valid("".join(d))))
    return "".join(next(new) if c.isdigit() else c for c in value)


def _recase(value: str, new: str) -> str:
    """Lower-case ``new`` with the letter case of ``value``."""
    return "".join(b.upper() if a != a.lower() else b for a, b in zip(value, new, strict=True))


def spelled(kind: str, value: str) -> str:
    """``value`` without what its surrogate doesn't show: the letter case of a domain."""
    local, at, host = value.partition("@")
    return local + at + host.lower() if kind == "email" else value


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of a value: keyed, of its kind and format, and different for different values."""
    if kind == "email":
        local, _, host = value.partition("@")
        low = local.lower() if len(local.lower()) == len(local) else local
        sets = [_alphabet(c) for c in low]
        return f"{_recase(local, ''.join(_move(list(low), sets, key, 'email|' + host.lower())))}@{_prf(key, 'host', host.lower()):032x}.example.com"
    if kind == "name":
        return LETTERS.sub(lambda m: _name_part(m.group(), key), value)
    if kind == "card":
        return _digits(value, "card", key, {0}, lambda d: _valid("card", d))
    if kind == "ssn":
        return _digits(value, "ssn", key, set(), lambda d: _valid("ssn", f"{d[:3]}-{d[3:5]}-{d[5:]}"))
    if kind == "phone":
        own = re.sub(r"\D", "", value)
        code = (1 if own[0] in "17" else 3 if own[:2] in LONG_CODES else 2) if value.startswith("+") else 0
        fiction = len(own) in (10, 11) and own[-7:-4] == "555"  # numbers kept for fiction stay fiction
        return _digits(value, f"phone{code}", key, {*range(code), *(range(len(own) - 7, len(own) - 4) if fiction else ())}, lambda d: len(own) not in (10, 11) or (d[-7:-4] == "555") == fiction)
    if kind == "iban":
        flat = value.replace(" ", "")
        body = "".join(_move(list(flat[4:]), [DIGIT if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in flat[4:]], key, "iban" + flat[:2]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
        new = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)
    if ":" in value:
        head, colon, tail = value.rpartition(":")
        if "." in tail:
            return f"{surrogate('ip', head + ':', key)[:-1]}:{surrogate('ip', tail, key)}" if head.strip(":0") else f"{head}:{surrogate('ip', tail, key)}"
        own = [int(g, 16) for g in re.findall(r"[0-9A-Fa-f]+", value) if g.strip("0")]  # groups of zeros stay
        sets = [range(16 ** (len(f"{g:x}") - 1), 16 ** len(f"{g:x}")) for g in own]
        new = iter(_move(own, sets, key, "ip6"))
        upper = any(c.isupper() for c in value)
        return re.sub(r"[0-9A-Fa-f]*[1-9A-Fa-f][0-9A-Fa-f]*", lambda m: f"{next(new):{'X' if upper else 'x'}}".zfill(len(m.group())), value)
    parts = value.split(".")  # octet by octet, so that every surrogate is an address
    return ".".join(_move(parts, [OCTETS[len(p)] for p in parts], key, "ip"))


def _script(word: str) -> str:
    return unicodedata.name(word[0], "").split(" ")[0]


def _listed() -> dict[str, tuple[str, ...]]:
    """For each known name the names that may stand for it: of its gender or family names, its script and its length."""
    out: dict[str, tuple[str, ...]] = {}
    taken: set[str] = set()
    for names in (MALE_NAMES, FEMALE_NAMES, FAMILY_NAMES):
        groups: dict[tuple, list[str]] = {}
        for w in sorted(set(names) - taken):
            groups.setdefault((_script(w), len(w)), []).append(w)
        taken |= set(names)
        out |= {w: tuple(g) for g in groups.values() if len(g) > 1 for w in g}
    return out


LISTED = _listed()


def _name_part(part: str, key: bytes) -> str:
    """The surrogate of one word of a name, the same in every letter case."""
    low = part.lower()
    if len(low) != len(part) or any(a != b and b.upper() != a for a, b in zip(part, low, strict=True)):
        low = part  # letters whose case can't be put on again
    if low in PARTICLES or len(part) == 1 and part.islower() and _script(part) in ("LATIN", "CYRILLIC", "GREEK"):
        return part
    if (group := LISTED.get(low)) is not None:
        new = group[derange(group.index(low), len(group), key, "listed" + group[0])]
    else:
        sets = [_alphabet(c) for c in low]
        if len(low) > 1 and any(len(s) > 1 for s in sets[:-1]):
            sets[-1] = low[-1]
        new = "".join(_walk(list(low), sets, key, "name", lambda w: "".join(w) not in PARTICLES and "".join(w) not in LISTED))
    return _recase(part, new)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[Entity, str]]]:
    """The text with surrogates, and what was detected in it with its surrogates; mentions are replaced and not listed."""
    new, found = replace_all(text, key)
    detected = set(detect(text)) if found else ()
    return new, [x for x in found if x[0] in detected]


def replace_all(text: str | None, key: bytes) -> tuple[str | None, list[tuple[Entity, str]]]:
    """The text with surrogates, and all that was replaced by what."""
    found = [(e, surrogate(e.kind, e.value, key)) for e in entities(text)]
    if not found:
        return text, []
    out, at = [], 0
    for e, s in found:
        out += [text[at : e.start], s]
        at = e.end
    return "".join([*out, text[at:]]), found


SCHEMA = "doc_id long, text string, n_entities long, kinds string"


def pseudonymize(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row: the text with surrogates; kinds as kind:start:end in the old text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, kinds = [], [], []
            for t in b.column("text"):
                text, found = replace_all(t.as_py(), key)
                texts.append(text)
                n.append(len(found))
                kinds.append(",".join(f"{e.kind}:{e.start}:{e.end}" for e, _ in found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_entities", "kinds"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def surrogates(documents: DataFrame, key: bytes) -> DataFrame:
    """(kind, value_hash, surrogate) of every find in every document; the values themselves aren't given out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(e.kind, hashlib.blake2b(spelled(e.kind, e.value).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).hexdigest(), surrogate(e.kind, e.value, key)) for t in b.column("text") for e in entities(t.as_py())}
            kind, value, new = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kind, value, new)], ["kind", "value_hash", "surrogate"])

    ship(documents.sparkSession)
    return documents.select("text").mapInArrow(run, "kind string, value_hash string, surrogate string")


def collisions(documents: DataFrame, key: bytes) -> DataFrame:
    """Surrogates that stand for more than one value anywhere in the corpus; there should be none."""
    spread = surrogates(documents, key).groupBy("kind", "surrogate").agg(F.min("value_hash").alias("low"), F.max("value_hash").alias("high"))
    return spread.filter("low <> high").select("kind", "surrogate")


def run_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one drawn for this run."""
    named = spark.conf.get(SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def pseudonymize_checked(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    """``pseudonymize`` by ``key``, or the next key made from it by which no surrogate stands for two values of the corpus."""
    key = key or run_key(documents.sparkSession)
    while collisions(documents, key).first() is not None:
        key = hashlib.sha256(b"next" + key).digest()
    return pseudonymize(documents, key)
