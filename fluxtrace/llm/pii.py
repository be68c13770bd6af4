"""Personal data replaced by surrogates: keyed, of the same type and format, distinct for distinct entities, the same everywhere.

Kinds: email, phone, ip (both versions), mac, ssn, iban, account (13 to 19 digits), secret (long hexadecimal strings,
quoted values with letters and digits, web tokens and known key prefixes), given and family names (capitalised words after
forms of address, and every later or earlier mention of them in the same text).

A surrogate is a keyed permutation of the strings of the same shape: a Feistel network over the positions that may vary,
so distinct entities of one shape get distinct surrogates without a table and every mention of an entity gets the same one
in every document and run. Types are kept: private addresses stay in their network and public ones public, an IPv6 address
and a MAC keep their scope, Luhn and mod-97 check digits that were valid are valid again, phone numbers keep the country
code (with and without it, or with a leading 0 instead, they are one number). Names of an alphabet are made of its syllables,
with endings by gender, hyphens and apostrophes where they were; names of other scripts get letters and vowel signs of
their own script. Composed and decomposed letters, and both apostrophes, are one. A given name has one stem whatever the gender of its title; within a
text a title of known gender decides.

What a permutation cannot rule out is checked: the distinct entities of the whole corpus are gathered, those whose
surrogate is itself a real entity or another's are drawn again, and only they go into the table of exceptions. From the
third draw on surrogates are longer than what they stand for, so full shapes, or entities without a character that may
vary, are served too and the drawing ends. The table is broadcast up to a stated size; beyond it the documents that mention
an exception meet theirs in a join.

Limits: names are found only in texts that mention them after a form of address (or "my name is"), and every capitalised
word of that text that is one of them goes with them ("Ms May arrives in May" changes the month too: within a text such
a word is one entity); national phone numbers other than North American ones are found in texts that mention the number
with its country code as well; initials and the addresses 0.0.0.0, 127.0.0.1 and 255.255.255.255 stay.

Edge cases: null texts stay null; texts without entities come back unchanged; repeated rows are treated alike; an empty
table gives an empty result; the other columns are kept (`n_entities` is replaced if it is there).
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches, pieces, settle, unwrapped, wrapped

KEY = b"fluxtrace surrogate key 1"
#: Exceptions are broadcast up to this number and so many bytes.
BROADCAST_EXCEPTIONS, BROADCAST_BYTES = 50_000, 8_000_000
#: Surrogates of this attempt and later ones are longer than what they stand for.
LONGER = 3
ROUNDS = 8

# Forms of address by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Signora", "Г-жа", "Κυρία", "MRS", "MS"),
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Signor", "Г-н", "Κύριος", "MR"),
    "n": ("Dr", "Prof", "Mx", "DR", "PROF", "my name is", "My name is", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "je m'appelle", "Je m'appelle"),
}
# First letters, vowels and last letters of the syllables of names, and the endings of given names by gender.
LETTERS = {
    "latin": ("bdfghklmnprstvwz", "aeiou", "lnrs", {"f": "a", "m": "o", "n": "e"}),
    "cyrillic": ("бвгдзклмнпрстфхч", "аеиоу", "лнрс", {"f": "а", "m": "ий", "n": "и"}),
    "greek": ("βγδζθκλμνπρστφχψ", "αεηιο", "λνρσ", {"f": "α", "m": "ος", "n": "ι"}),
}
# Networks that are not public, by first address and prefix length.
NETWORKS = [(int(ipaddress.ip_address(a)), n) for a, n in (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4))]
NOBODY = ("0.0.0.0", "127.0.0.1", "255.255.255.255")
# Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}

_TITLE = "|".join(re.escape(t) for t in sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _ranges(codes: list[int]) -> str:
    """A character class of these code points."""
    begins = [c for c in codes if c - 1 not in set_of] if (set_of := set(codes)) else []
    ends = [c for c in codes if c + 1 not in set_of]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(begins, ends, strict=True))


# Combining marks (categories M*): accents of decomposed letters, vowel signs of Indic scripts and Thai.
_MARK = _ranges([c for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M"])
_IN, _OUT = rf"[\w{_MARK}]", rf"(?![\w{_MARK}])"
_NAME = rf"[^\W\d_]{_IN}*(?:['’]{_IN}{{2,}})?(?:-[^\W\d_]{_IN}*)*"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]+@(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+[^\W\d_]{2,18})"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.[0-9]))"
    r"|(?P<mac>(?<![\w:\-])[0-9A-Fa-f]{2}(?P<m>[:\-])[0-9A-Fa-f]{2}(?:(?P=m)[0-9A-Fa-f]{2}){4}(?![\w:]))"
    r"|(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))"
    r"|(?P<ssn>(?<![\w\-.])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone>(?<!\w)\+[0-9]{1,3}[ .\-]?(?:\(0\) ?)?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,5}){1,4}(?!\w)|(?<![\w(])(?:1[ .\-])?\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?!\w)"
    r"|(?<![\w.\-])(?:1(?P<p>[ .\-]))?[0-9]{3}(?P<q>[ .\-])[0-9]{3}(?P=q)[0-9]{4}(?![\w\-]))"
    r"|(?P<account>(?<![\w.+\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\w\-]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|eyJ[A-Za-z0-9_\-]{8,2000}\.[A-Za-z0-9_\-]{8,8000}\.[A-Za-z0-9_\-]{8,2000}"
    r"|(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128})(?![A-Za-z0-9])"
    r"|(?:(?<=[=:] \")|(?<=[=:]\"))(?=[A-Za-z+/_\-]*[0-9])(?=[0-9+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{16,200}(?=\"))"
    rf"|(?P<titles>(?<!\w)(?:(?:{_TITLE})\.? |M\. )+)(?:[^\W\d_]\.? ){{0,3}}(?P<name>{_NAME}(?: {_NAME}){{0,2}})"
)
# What every text with an entity holds: quick tests that most texts fail, each on a rare first character.
_DIGIT = re.compile(r"[0-9][0-9a-fA-F.()\- ]{5}")
_COLONS, _DASHES = re.compile(r":[0-9a-fA-F]{0,4}:"), re.compile(r"-[0-9a-fA-F]{2}-[0-9a-fA-F]{2}-")
_CAPITAL = sorted((t for t in _GENDER if t[0].isupper() and " " not in t), key=len, reverse=True)
_ADDRESSED = re.compile(rf"(?:{'|'.join(map(re.escape, _CAPITAL))}|M\.)\.? ")
_QUOTES = ('= "', '="', ': "', ':"')
_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ", " name is ", "ch heiße ", "e llamo ", "e m'appelle ")


def suspicious(text: str) -> bool:
    tests = (_DIGIT, _ADDRESSED, _COLONS, _DASHES)
    return "@" in text or any(x in text for x in _QUOTES) or any(x in text for x in _MARKS) or any(t.search(text) for t in tests)


def script(name: str) -> str:
    """The script of the first letter."""
    return next((unicodedata.name(c, "none").split(" ")[0].lower() for c in name if c.isalpha()), "none")


def luhn(digits: str) -> int:
    """The check digit that makes the digits valid."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def mod97(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _names(m: re.Match):
    """(begin, stop, part, name) of the given and family names after a form of address: the last word is the family's. Words in
    small letters and further forms of address end a name."""
    words = list(re.finditer(r"[^ ]+", m["name"]))
    sound = [(w[0][0].isupper() or unicodedata.category(w[0][0]) == "Lo") and w[0] not in _GENDER for w in words]
    words = words[: sound.index(False)] if False in sound else words
    base = m.start("name")
    for w in words:
        yield base + w.start(), base + w.end(), "family" if w is words[-1] else "given", plain_name(w[0])


def plain_name(name: str) -> str:
    """What spellings of a name have in common: small, composed letters and one apostrophe."""
    return unicodedata.normalize("NFC", name.lower()).replace("’", "'")


def national(digits: str) -> tuple[str, str]:
    """Country code and national number of the digits after a plus sign."""
    n = next((n for n in (1, 2) if digits[:n] in CODES), 3)
    return digits[:n], digits[n:]


def _entity(kind: str, found: str) -> str | None:
    """What mentions of the same thing have in common; None where the pattern was too wide."""
    if kind == "email":
        return found.lower()
    if kind == "ip":
        plain = ".".join(str(int(x)) for x in found.split("."))
        return None if plain in NOBODY else plain
    if kind == "mac":
        return re.sub("[:-]", "", found.lower())
    if kind == "ipv6":
        try:
            address = ipaddress.IPv6Address(found) if len(found) > 6 else None
            if address is not None and address.ipv4_mapped:  # written in digits of its own otherwise
                return f"::ffff:{int(address) >> 16 & 0xFFFF:x}:{int(address) & 0xFFFF:x}"
            return address and str(address)
        except ValueError:
            return None
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", found)
        if found[0] != "+" or digits[0] == "1" and len(digits) == 11:
            return digits[-10:]
        code, number = national(digits)
        number = number[1:] if "(0)" in found and number[:1] == "0" else number
        return f"+{code}-{number}" if len(digits) >= 7 and len(number) >= 4 else None
    if kind == "account":
        return re.sub(r"[^0-9]", "", found)
    return found.replace(" ", "") if kind == "iban" else found


def entities(text: str):
    """(begin, end, kind, entity) of every mention, in order. Kinds of given names end in the gender: f, m or n."""
    if not text or not suspicious(text):
        return
    out, names, numbers, at = [], {}, {}, 0
    while m := PATTERN.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "name":
            said = {_GENDER.get(t, "m") for t in re.findall(rf"{_TITLE}|M", m["titles"])}
            gender = "f" if "f" in said else "m" if "m" in said else "n"
            at = m.start("name")  # what follows the name may be another form of address
            for begin, stop, part, entity in _names(m):
                was, sex = names.get(entity, (part, "n"))
                names[entity] = (was, gender if sex == "n" else sex)
                out.append((begin, stop, "name", entity))
                at = stop
            continue
        begin, stop = m.span()
        if kind == "email":
            begin += len(m[0]) - len(m[0].lstrip("._%+-"))
        entity = _entity(kind, text[begin:stop])
        if entity is not None and not (kind == "email" and entity.startswith("@")):
            out.append((begin, stop, kind, entity))
            if kind == "phone" and entity[0] == "+":
                numbers[entity.partition("-")[2]] = entity
    if names:
        spelled = {x for n in names for x in (n.title(), n[0].upper() + n[1:], n.upper())} | {text[b:e] for b, e, kind, _ in out if kind == "name"}
        spelled |= {unicodedata.normalize("NFD", x) for x in spelled}
        spelled |= {x.replace("'", "’") for x in spelled}
        known = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(spelled, key=len, reverse=True)))}){_OUT}")
        sound = lambda m: plain_name(m[0]) in names and "@" not in (text[m.end() : m.end() + 1], text[m.start() - 1 : m.start()])
        out = sorted(out + [(*m.span(), "name", plain_name(m[0])) for m in _between(known, text, out) if sound(m)])
    if numbers:
        # National forms of numbers that stand with their country code somewhere in the text, a 0 before them or not.
        forms = "|".join(r"[ .\-/()]{0,2}".join(x) for x in sorted(numbers, key=len, reverse=True))
        known = re.compile(rf"(?<![\w+.\-])\(?(?:0[ .\-/]?)?(?P<number>{forms})(?![\w\-])")
        out = sorted(out + [(*m.span(), "phone", numbers[re.sub("[^0-9]", "", m["number"])]) for m in _between(known, text, out)])
    for begin, stop, kind, entity in out:
        if kind == "name":
            part, sex = names[entity]
            kind = part if part == "family" else f"given-{sex}"
        yield begin, stop, kind, entity


def _between(pattern: re.Pattern, text: str, mentions: list[tuple]):
    """Matches between the mentions, which are in order."""
    at = 0
    for begin, stop, *_ in [*mentions, (len(text), len(text))]:
        yield from pattern.finditer(text, at, begin)
        at = stop


def _stream(tweak: bytes, text: str, n: int) -> bytes:
    return hashlib.shake_256(tweak + text.encode()).digest(n)


def _permuted(values: list[int], radices: list[int], tweak: bytes) -> list[int]:
    """A keyed permutation of the vectors with these radices: each round adds to one half what the key makes of the other."""
    half = (len(values) + 1) // 2
    parts, sizes = [values[:half], values[half:]], [radices[:half], radices[half:]]
    for i in range(ROUNDS):
        a, b = i % 2, 1 - i % 2
        stream = _stream(tweak, f"{i}|{parts[b]!r}", 4 * len(parts[a]))
        parts[a] = [(v + int.from_bytes(stream[4 * j : 4 * j + 4], "big")) % r for j, (v, r) in enumerate(zip(parts[a], sizes[a], strict=True))]
    return parts[0] + parts[1]


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = (_DIGITS, _LOWER, _UPPER)
_HEX = "0123456789abcdef"


def _shaped(text: str, tweak: bytes, classes: tuple[str, ...] = _CLASSES, fixed: tuple[int, ...] | range = ()) -> str:
    """A string of the same shape: each character of a class becomes one of the class; others, and those at fixed places, stay."""
    at = [(i, c, c.index(x)) for i, x in enumerate(text) for c in classes if x in c and i not in fixed]
    out = list(text)
    for (i, c, _), v in zip(at, _permuted([v for *_, v in at], [len(c) for _, c, _ in at], tweak), strict=True):
        out[i] = c[v]
    return "".join(out)


def _longer(attempt: int, tweak: bytes, entity: str, letters: str) -> str:
    """What later attempts add, so that no shape is ever too full."""
    return "".join(letters[b % len(letters)] for b in _stream(tweak, f"longer|{entity}", max(0, attempt - LONGER + 1)))


def _address(entity: str, attempt: int, tweak: bytes) -> str:
    number = int(ipaddress.IPv4Address(entity))
    inside = lambda x: next(((a, n) for a, n in NETWORKS if x >> (32 - n) == a >> (32 - n)), None)
    if attempt >= 2 * LONGER:  # no address of this version is left
        return str(ipaddress.IPv6Address((0x20010DB8 << 96) | int.from_bytes(_stream(tweak, entity, 12), "big")))
    net = inside(number)
    if net and attempt >= LONGER and ipaddress.IPv4Address(entity).is_private:
        net = (10 << 24, 8)
        number = net[0] | number & 0xFFFFFF
    base, bits = (net[0], 32 - net[1]) if net else (0, 32)
    radices = [1 << (bits % 8)] * (bits % 8 > 0) + [256] * (bits // 8)
    while True:  # walks on until the address is public again
        low, values = number - base, []
        for r in reversed(radices):
            low, v = divmod(low, r)
            values.insert(0, v)
        number = 0
        for v, r in zip(_permuted(values, radices, tweak), radices, strict=True):
            number = number * r + v
        number += base
        if net or inside(number) is None:
            return str(ipaddress.IPv4Address(number))


def _ipv6(entity: str, attempt: int, tweak: bytes) -> str:
    fixed = 2 if entity[0] == "f" else 1
    if attempt >= LONGER:
        digits = entity.replace(":", "")[:fixed] + _stream(tweak, entity, 16).hex()[fixed:]
        return str(ipaddress.IPv6Address(":".join(digits[i : i + 4] for i in range(0, 32, 4))))
    first = {i for i, c in enumerate(entity) if c != ":" and (i == 0 or entity[i - 1] == ":")}
    lead = "".join("x" if i in first and c != "0" else c for i, c in enumerate(entity))
    rest = _shaped(lead, tweak, (_HEX,), range(fixed))
    heads = _shaped("".join(c for i, c in enumerate(entity) if lead[i] == "x"), tweak + rest.encode(), (_HEX[1:],), (0,) if 0 in first else ())
    heads = iter(heads)
    # A group that is 0 stays 0, so that the written form keeps its length.
    return "".join(next(heads) if lead[i] == "x" else c if i in first else rest[i] for i, c in enumerate(entity))


@lru_cache(maxsize=256)
def _block(c: str) -> str:
    """Letters, or combining marks, of the same script and kind around c."""
    at = ord(c)
    low, high = (0x4E00, 0xA000) if 0x4E00 <= at < 0xA000 else (0xAC00, 0xD7A4) if 0xAC00 <= at < 0xD7A4 else (at & ~0xFF, (at & ~0xFF) + 0x100)
    kind = lambda x: (unicodedata.category(x), unicodedata.combining(x), unicodedata.name(x, "").split(" ")[0], "VOWEL" in unicodedata.name(x, ""))
    return "".join(x for x in map(chr, range(low, high)) if kind(x) == kind(c))


def _syllables(number: int, n: int, letters: tuple) -> str:
    """n syllables, told by the number; the last one ends in a consonant, so that they can be told apart."""
    first, vowels, last, _ = letters
    out = ""
    for i in range(n):
        number, a = divmod(number, len(first))
        number, b = divmod(number, len(vowels))
        number, c = divmod(number, len(last) + (i < n - 1))
        out += first[a] + vowels[b] + last[c : c + 1]
    return out


def _name(kind: str, entity: str, attempt: int, tweak: bytes) -> str:
    wanted = script(entity)
    if wanted not in LETTERS:
        classes = tuple(dict.fromkeys(_block(c) for c in entity if unicodedata.category(c)[0] in "LM"))
        extra = next((c for c in classes if c), _LOWER)
        return _shaped(entity, tweak, classes) + _longer(attempt, tweak, entity, extra)
    out = []
    parts = re.split("([-'])", entity)
    for i, part in enumerate(parts):
        if part in ("-", "'", ""):
            out.append(part)
            continue
        if len(part) < 3 and parts[i + 1 : i + 2] == ["'"]:  # the O of O'Neil
            out.append(_syllables(int.from_bytes(_stream(tweak, f"{i}|{entity}", 8), "big"), 1, LETTERS[wanted])[: len(part)])
            continue
        i //= 2
        size = attempt + (2 if kind.startswith("given") else 3)
        made = _syllables(int.from_bytes(_stream(tweak, f"{i}|{entity}", 2 * size + 8), "big"), size, LETTERS[wanted])
        if kind.startswith("given"):
            made += LETTERS[wanted][3][kind[-1]]
        elif wanted == "cyrillic":
            made += "ова" if part[-1:] in ("а", "я") else "ов"
        elif wanted == "greek":
            made += "ου" if part[-1:] in ("υ", "α", "η", "ά", "ή", "ύ") else "ης"
        out.append(made)
    return "".join(out)


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The surrogate of an entity, in the entity's own form (see `_entity`)."""
    tweak = hmac.new(key, f"{kind.split('-')[0]}|{attempt}".encode(), hashlib.sha256).digest()
    more = lambda letters: _longer(attempt, tweak, entity, letters)
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        labels = domain.split(".")
        # The provider's name varies with the local part, the last label stays.
        local, rest = _shaped(f"{local}@{'.'.join(labels[:-1])}", tweak).split("@")
        return f"{local}{more(_LOWER)}@{rest}.{labels[-1]}"
    if kind == "ip":
        return _address(entity, attempt, tweak)
    if kind == "ipv6":
        return _ipv6(entity, attempt, tweak)
    if kind == "phone":
        code, sign, number = entity.rpartition("-")
        rest = _shaped(number[1:], tweak + code.encode())
        first = number[0] if sign and number[0] == "0" else _shaped(number[0], tweak + rest.encode(), (_DIGITS[1:],))
        return code + sign + first + rest + more(_DIGITS)
    if kind == "account":
        if luhn(entity[:-1]) == int(entity[-1]):
            body = _shaped(entity[:-1], tweak) + more(_DIGITS)
            return body + str(luhn(body))
        return _shaped(entity, tweak) + more(_DIGITS)
    if kind == "ssn":
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:11] != "0000"
        now = _shaped(entity, tweak)
        while valid(now) != valid(entity):
            now = _shaped(now, tweak)
        return now + more(_DIGITS)
    if kind == "iban":  # an account stays in its country
        country, check, account = entity[:2], entity[2:4], entity[4:]
        if mod97(country, account) == check:
            account = _shaped(account, tweak) + more(_DIGITS)
            return country + mod97(country, account) + account
        return _shaped(entity, tweak, fixed=range(2)) + more(_DIGITS)
    if kind == "mac":
        return _shaped(entity, tweak, (_HEX,), (1,)) + "".join(f"{ord(c):02x}" for c in more(_LOWER))
    if kind == "secret":
        classes = (_HEX,) if re.fullmatch("[0-9a-f]+", entity) else (_HEX.upper(),) if re.fullmatch("[0-9A-F]+", entity) else _CLASSES
        prefix = re.match("AKIA|ASIA|gh[pousr]_|sk-|eyJ", entity)
        return _shaped(entity, tweak, classes, range(prefix.end() if prefix else 0)) + more(classes[0] if len(classes) == 1 else _UPPER)
    return _name(kind, entity, attempt, tweak)


def written(found: str, kind: str, replacement: str) -> str:
    """The surrogate in the format of the mention: its separators, and its letters' case."""
    if kind in ("phone", "account"):
        code, _, number = replacement.rpartition("-")
        digits = re.sub("[^0-9]", "", found)
        if kind == "account":
            keep = 0
        elif not code:
            keep = len(digits) - 10
        elif found[0] == "+":  # after the code, a 0 in brackets is none of the number's digits
            keep = len(code) - 1 + ("(0)" in found and digits[len(code) - 1 : len(code)] == "0")
        else:
            keep = int(digits[0] == "0" and number[0] != "0")
        out, left = [], list(number)
        for c in found:
            if c in _DIGITS and keep > 0:
                keep -= 1
            elif c in _DIGITS:
                c = left.pop(0)
            out.append(c)
        return "".join(out + left)
    if kind == "iban":
        signs = list(replacement)
        return "".join([" " if c == " " else signs.pop(0) for c in found] + signs)
    if kind == "email":
        local, at = replacement.rsplit("@", 1)[0], found.rfind("@")
        cased = "".join(r.upper() if f.isupper() else r for f, r in zip(found[:at], local, strict=False)) + local[at:]
        rest = replacement[len(local) :]
        return cased + ("".join(r.upper() if f.isupper() else r for f, r in zip(found[at:], rest, strict=True)) if len(rest) == len(found) - at else rest)
    if kind == "mac":
        pairs = found[2].join(replacement[i : i + 2] for i in range(0, len(replacement), 2))
        return pairs.upper() if found.upper() == found else pairs
    if kind == "ipv6":
        return replacement.upper() if found.upper() == found else replacement
    if kind == "family" or kind.startswith("given"):
        if len(found) > 1 and found.isupper():
            return replacement.upper().replace("'", "’" if "’" in found else "'")
        ends = re.sub("σ$|σ(?=-)", "ς", replacement)
        signs = iter(re.findall("['’]", found))
        was = re.split("[-'’]", found)
        now = re.split("([-'])", ends)
        for i in range(0, len(now), 2):
            if i == 0 or len(was) <= i // 2 or not was[i // 2][:1].islower():
                now[i] = now[i][:1].upper() + now[i][1:]
        return "".join(next(signs, x) if x == "'" else x for x in now)
    return replacement


def replaced(text: str | None, attempts: dict[tuple[str, str], int], key: bytes = KEY, seen: dict | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and the number of mentions (a given and a family name are one each)."""
    out, end, n = [], 0, 0
    seen = {} if seen is None else seen
    for begin, stop, kind, entity in entities(text or ""):
        new = seen.get((kind, entity))
        if new is None:
            new = seen[kind, entity] = surrogate(kind, entity, attempts.get((kind.split("-")[0], entity), 0), key)
        out += [text[end:begin], written(text[begin:stop], kind, new)]
        end, n = stop, n + 1
    return ("".join(out) + text[end:], n) if n else (text, 0)


_found = batches({"kind": pa.string(), "entity": pa.string()})
_drawn = batches({"kind": pa.string(), "entity": pa.string(), "attempt": pa.int64(), "space": pa.string(), "new": pa.string()})
#: Kinds that must not meet each other's surrogates share a space.
SPACES = {"given": "name", "family": "name", "ipv6": "ip"}


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind and entity, each once: tasks hand on what is distinct in a batch."""

    def find(parts):
        for batch in pieces(parts):
            found = {(kind.split("-")[0], entity) for text in batch.column(0).to_pylist() for *_, kind, entity in entities(text)}
            yield _found({"kind": [k for k, _ in found], "entity": [e for _, e in found]})

    return docs.select("text").mapInArrow(find, "kind string, entity string").distinct()


def draw(entities_: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity, attempt, space and new: the surrogate of the row's attempt, of given names one for each gender."""

    def make(parts):
        for batch in pieces(parts):
            rows = []
            for kind, entity, attempt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for form in ("given-f", "given-m", "given-n") if kind == "given" else (kind,):
                    rows.append((kind, entity, attempt, SPACES.get(kind, kind), surrogate(form, entity, attempt, key)))
            yield _drawn(dict(zip(("kind", "entity", "attempt", "space", "new"), map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(("kind", "entity", "attempt", "space", "new"), []))

    rows = entities_.select("kind", "entity", "attempt")
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "entity")
    return rows.mapInArrow(make, "kind string, entity string, attempt long, space string, new string")


def _clashing(drawn: DataFrame, taken: DataFrame) -> DataFrame:
    """kind, entity and attempt of what was drawn and is taken, or drawn for several (all but the first of them)."""
    taken = taken.select(F.col("space").alias("_space"), F.col("new").alias("_new"))
    hit = drawn.join(taken, (F.col("space") == F.col("_space")) & (F.col("new") == F.col("_new"))).select("kind", "entity", "attempt")
    first = drawn.groupBy("space", "new").agg(F.min(F.struct("entity", "kind")).alias("holder"), F.max(F.struct("entity", "kind")).alias("other")).where("holder <> other")
    first = first.select(F.col("space").alias("_space"), F.col("new").alias("_new"), "holder")
    lost = drawn.join(first, (F.col("space") == F.col("_space")) & (F.col("new") == F.col("_new"))).where(F.struct("entity", "kind") != F.col("holder"))
    return hit.unionByName(lost.select("kind", "entity", "attempt")).distinct()


def exceptions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity and attempt of the entities that the first draw does not serve.

    Only what clashes is drawn again, and held against the real entities and all that was drawn before. From the third
    attempt on each one makes surrogates longer, so every entity is served in the end.
    """
    space = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in SPACES.items()], F.col("kind"))
    real = found.select(space.alias("space"), F.col("entity").alias("new"))
    drawn = settle(draw(found.withColumn("attempt", F.lit(0).cast("long")), key), "surrogates")
    taken, again = [real, drawn.select("space", "new")], []
    lost = settle(_clashing(drawn, real), "clashes")
    while not lost.isEmpty():
        drawn = settle(draw(lost.withColumn("attempt", F.col("attempt") + 1), key), "surrogates")
        lost = settle(_clashing(drawn, reduce(DataFrame.unionByName, taken)), "clashes")
        taken.append(drawn.select("space", "new"))
        again.append(drawn.select("kind", "entity", "attempt"))
    if not again:
        return found.select("kind", "entity", F.lit(0).cast("long").alias("attempt")).limit(0)
    return reduce(DataFrame.unionByName, again).groupBy("kind", "entity").agg(F.max("attempt").alias("attempt"))


def _surrogated(docs: DataFrame, key: bytes, broadcast_exceptions: int) -> DataFrame:
    """_row, the text with surrogates and n_entities of each row of docs."""
    spark = docs.sparkSession
    again = settle(exceptions(settle(distinct_entities(docs), "entities"), key), "exceptions")
    rows = wrapped(docs, "text")
    size = again.agg(F.count("*").alias("n"), F.sum(F.octet_length("kind") + F.octet_length("entity") + 16).alias("bytes")).first()
    if size["n"] <= broadcast_exceptions and (size["bytes"] or 0) <= BROADCAST_BYTES:
        table = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["attempt"] for r in again.collect()})
        return _replace(rows, lambda batch: [table.value] * batch.num_rows, key)
    own = _with_own_exceptions(rows, again)
    return _replace(own, lambda batch: [{(x["kind"], x["entity"]): x["attempt"] for x in xs or ()} for xs in batch.column(2).to_pylist()], key)


def replace_pii(docs: DataFrame, *, key: bytes = KEY, broadcast_exceptions: int = BROADCAST_EXCEPTIONS) -> DataFrame:
    """docs with surrogates in `text`, and n_entities, the number of mentions replaced."""
    return unwrapped(_surrogated(docs, key, broadcast_exceptions), docs, "n_entities")


def replaced_documents(docs: DataFrame, *, key: bytes = KEY) -> DataFrame:
    """docs with surrogates in `text` and n_chars brought up to date, and no other column changed or added."""
    out = _surrogated(docs, key, BROADCAST_EXCEPTIONS)
    if "n_chars" not in docs.columns:
        return unwrapped(out, docs)
    chars = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unwrapped(out.withColumn("n_chars", chars), docs, "n_chars").select(*[F.col(f"`{c}`") for c in docs.columns])


def _with_own_exceptions(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows (_row, text) with the exceptions that the text mentions, by a join on (kind, entity) and then on the text's digest."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)

    def find(parts):
        for batch in pieces(parts):
            found = [(d, kind, entity) for d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for kind, entity in {(k.split("-")[0], e) for *_, k, e in entities(text)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["digest", "kind", "entity"])

    mentions = rows.select(digest.alias("digest"), "text").mapInArrow(find, "digest string, kind string, entity string").distinct()
    table = mentions.join(again, ["kind", "entity"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("_again"))
    return rows.withColumn("digest", digest).join(table, "digest", "left").select("_row", "text", "_again")


def _replace(rows: DataFrame, attempts, key: bytes) -> DataFrame:
    def work(parts):
        for batch in pieces(parts):
            seen: dict = {}
            done = []
            own = attempts(batch)
            for text, table in zip(batch.column(1).to_pylist(), own, strict=True):
                done.append(replaced(text, table, key, seen if table is own[0] else {}))
            columns = [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "text", "n_entities"])

    return rows.mapInArrow(work, StructType([*rows.schema.fields[:2], StructField("n_entities", LongType())]))
