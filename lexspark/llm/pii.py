"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type and format.  E-mail addresses, phone, card, social
security and bank account numbers, IP addresses and secrets go through a keyed permutation of all strings of their
pattern: every character stays in its class (script and case of letters, digits, hexadecimal digits) and separators
stay, so lengths and formats are kept.  A permutation maps distinct entities to distinct surrogates by construction,
without any state.  Validity is kept by walking the permutation's cycle until it is met again: a card number keeps its
Luhn sum, an address its network class.  A phone number is its country code and its digits, however they are
separated: the code stays, and one number in two formats stays one number.  Digits behind it, parted by no more than a
blank, are taken for a part of it, up to the 15 that such numbers can have (11 in North America).

Personal names (behind titles, or words like "my name is") have no finite pattern.  Each part of a name has one surrogate in the whole corpus,
built from syllables of its script, whatever titles it stands behind; that of a given name ends as its gender asks for, which
the titles of the whole corpus tell, or else the name's own ending.  Drawn surrogates can collide, so the corpus's
distinct parts are checked: of the parts that share a surrogate, or whose surrogate is itself a real part, all but the
first rightful owner draw again, from a name space that grows with the attempts, until none is left.  References to a
person so stay together; within a text that holds for untitled mentions of a titled name's parts too.  Names that
nothing in their text tells aren't found.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import ship
from .common import BROADCAST_ROWS, discard, materialize

TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f",
    **dict.fromkeys(("my name is", "My name is", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "mi nombre es", "меня зовут", "Меня зовут", "με λένε", "Με λένε"), ""),
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: A text without any of these has no title.
TITLE_ROOTS = [t for t in TITLES if not any(t != u and u in t for u in TITLES)]
_WORD = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][a-zß-öø-ÿά-ώа-яё]+"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_PART = rf"(?!(?:{_TITLE})(?:\.|\b)){_WORD}(?![a-zß-öø-ÿά-ώа-яё])"
#: One title or several, and the parts of the name.
NAME = re.compile(rf"\b((?:(?:{_TITLE})\.?[ ])+)({_PART}(?:[ -]{_PART}){{0,2}})")
#: By type, in order of precedence: marks one of which any text with the type has, and the pattern.  Starts are
#: anchored and repeats bounded, so that no run of characters is scanned again from each of its places.
DETECTORS = {
    "email": (("@",), re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}")),
    "aws": (("AKIA",), re.compile(r"(?<![A-Za-z0-9])AKIA([0-9A-Z]{16})(?![A-Za-z0-9])")),
    "secret": (
        ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey"),
        re.compile(r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_\-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?((?:[A-Za-z0-9+/_\-]|\.++(?=[A-Za-z0-9+/_\-])){8,})"),
    ),
    "phone": (
        ("+", "("),
        re.compile(
            r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]?\d{2,5}){1,4}(?!\w)|(?<![\w(+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
            # without + : area code in brackets, North American groups, and national numbers after a trunk 0
            r"|(?<![\w.+\-/(])(?<!\d[ .\-/])(?:\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\(0\d{1,4}\) ?\d{3,9}(?:[ \-]\d{2,5}){0,3}|(?:1[ .\-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})"
            r"|0\d{1,4}(?: ?[/\-] ?| )\d{5,9}|0\d{1,4}(?:[ \-]\d{3,4}){2}|0\d(?:[ .\-]\d{2}){4}|0\d{2} \d{3}(?: \d{2}){2})(?!\w|[ .\-/]?\d)"
        ),
    ),
    "card": (None, re.compile(r"(?<![\w.\-])(?:\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7}|\d{13,19})(?![\w\-])")),
    "ip": (None, re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    "iban": (None, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    "ipv6": ((":",), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
    "ssn": (None, re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")),
}
DIGIT = re.compile("[0-9]")
NETWORKS = tuple(map(ipaddress.ip_network, ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")))
RESERVED = re.compile(r"(?:^|\.)(?:example\.(?:com|org|net)|[a-z]+\.example|invalid|test)$", re.I)

_ALPHABETS = [("digit", "0123456789"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
_CLASS = {c: (name, i, letters) for name, letters in _ALPHABETS for i, c in enumerate(letters)}
_HEX = {c: ("hex", i, "0123456789abcdef") for i, c in enumerate("0123456789abcdef")}
#: Characters permuted at once; their number fits the 128 bits by which a round of :func:`permute` changes a half.
PIECE = 48

_SYLLABLES = {
    "latin": ([a + b for a in "bdfgklmnprstvz" for b in "aeiou"], {"f": "a", "m": "o", "": "e"}),
    "cyrillic": ([a + b for a in "бвгдзклмнпрст" for b in "аеиоу"], {"f": "а", "m": "ий", "": "е"}),
    "greek": ([a + b for a in "βγδζκλμνπρστφ" for b in "αειου"], {"f": "α", "m": "ος", "": "ε"}),
}


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), "sha256")[:16], "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """Keyed permutation of ``range(size)``: a balanced Feistel network, walked until it is back in the range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            left, right = right, left ^ (_prf(key, tweak, size, r, right) & mask)
        value = (left << half) | right
        if value < size:
            return value


def permute_text(key: bytes, tweak: str, text: str, valid: Callable[[str], object] | None = None) -> str:
    """A string of the same character classes, another one where there is one.

    Distinct strings of a pattern stay distinct.  ``valid`` is a property that the result shares with ``text``.
    """
    hexes = len(text) >= 8 and all(c in _HEX for c in text) and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
    table = _HEX if hexes else _CLASS

    def step(whole: str) -> str:
        """Piece by piece, each tweaked by those before it, so that the whole is a permutation too."""
        out, chain = [], ""
        for at in range(0, len(whole), PIECE):
            piece = whole[at : at + PIECE]
            kinds = [table.get(c) for c in piece]
            size, value = 1, 0
            for k in kinds:
                if k:
                    size, value = size * len(k[2]), value * len(k[2]) + k[1]
            # tweaked by the pattern, not by the text: one permutation for all strings of the pattern
            mark = f"{tweak}|{'h' if hexes else ''}|{chain}" + "".join(k[0][0] if k else c for c, k in zip(piece, kinds))
            value = permute(key, mark, value, size)
            new = []
            for c, k in zip(reversed(piece), reversed(kinds)):
                if k:
                    value, i = divmod(value, len(k[2]))
                    c = k[2][i]
                new.append(c)
            out += reversed(new)
            chain = hashlib.sha256(f"{chain}{piece}".encode()).hexdigest() + "|"
        return "".join(out)

    def proper(s: str) -> bool:
        alike = hexes == (len(s) >= 8 and all(c in _HEX for c in s) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s))
        return alike and (valid is None or valid(s) == wanted)

    wanted = valid(text) if valid else None
    out = text
    while True:
        out = step(out)
        if proper(out):
            return out


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def _ip_class(text: str) -> tuple:
    ip = ipaddress.ip_address(text)
    return tuple(ip in net for net in NETWORKS)


def _surrogate_ip(key: bytes, text: str) -> str:
    value, wanted = int(ipaddress.ip_address(text)), _ip_class(text)
    while True:
        value = permute(key, "ip", value, 1 << 32)
        if _ip_class(out := str(ipaddress.ip_address(value))) == wanted:
            return out


def _digits(key: bytes, tweak: str, text: str, valid: Callable[[str], object]) -> str:
    """Digits changed as a number, whatever separates them, so that one number in two formats stays one number."""
    new = iter(permute_text(key, tweak, "".join(c for c in text if c.isdigit()), valid))
    return "".join(next(new) if c.isdigit() else c for c in text)


#: Country calling codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def _phone(key: bytes, text: str) -> str:
    if text[0] != "+":
        # a trunk 0 stays, as it tells a national number
        return _digits(key, "phone", text, lambda s: (s[:1] == "0") + 2 * (s[:1] in "01"))
    digits = "".join(c for c in text if c.isdigit())
    code = country_code(digits)
    new = iter(code + permute_text(key, "phone" + code, digits[len(code) :], lambda s: s[:1] in "01"))
    return "".join(next(new) if c.isdigit() else c for c in text)


def iban_sum(text: str) -> int:
    """1 for a valid account number, without blanks."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    whole = text.replace(" ", "")
    body = permute_text(key, "iban" + whole[:2], whole[4:])
    new = iter(f"{whole[:2]}{98 - iban_sum(whole[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _surrogate_ipv6(key: bytes, text: str) -> str:
    """The first group stays, which tells the class of the address; the rest is one number, however it is written."""
    value, low = int(ipaddress.IPv6Address(text)), (1 << 112) - 1
    out = ipaddress.IPv6Address(value & ~low | permute(key, f"ipv6{value >> 112}", value & low, 1 << 112))
    if "::" in text:
        told = str(out)
    else:
        long = all(len(g) == 4 for g in text.split(":"))
        told = out.exploded if long else ":".join(g.lstrip("0") or "0" for g in out.exploded.split(":"))
    return told.upper() if text != text.lower() else told


def _email(key: bytes, text: str) -> str:
    local, _, domain = text.rpartition("@")
    if not RESERVED.search(domain):
        stem, dot, top = domain.rpartition(".")
        domain = permute_text(key, "domain", stem, lambda s: s.startswith("-") or "-." in s or ".-" in s) + dot + top
    return permute_text(key, "local", local) + "@" + domain


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The surrogate of an entity other than a name.  One that the permutation maps to itself takes a further step."""
    if kind == "email":
        return _email(key, text)
    if kind == "phone":
        return _phone(key, text)
    if kind == "card":
        return text[0] + _digits(key, "card" + text[0], text[1:], lambda s: luhn(text[0] + s))
    if kind == "ip":
        return _surrogate_ip(key, text)
    if kind == "ipv6":
        return _surrogate_ipv6(key, text)
    if kind == "iban":
        return _iban(key, text)
    return permute_text(key, kind, text)


def _script(part: str) -> str:
    return "cyrillic" if re.match("[А-Яа-яЁё]", part) else "greek" if re.match("[Α-Ωά-ώ]", part) else "latin"


def titled_gender(titles: str) -> str:
    """What the first title tells that tells a gender: f, m or nothing."""
    return next((g for t in re.findall(_TITLE, titles) if (g := TITLES[t])), "")


def own_gender(part: str) -> str:
    """What the ending of a given name tells of its gender, where no title does."""
    if _script(part) == "greek":
        return "f" if part[-1] in "αηάή" else "m"
    if _script(part) == "cyrillic":
        return "f" if part[-1] in "ая" else "m"
    return "f" if part[-1] in "ae" else "m" if part[-1] in "orsnkdtlmf" else ""


def name_parts(titles: str, name: str) -> list[tuple[str, str, str]]:
    """``kind, gender, part`` of each part of a name: all but the last are given names."""
    words = re.split("[ -]", name)
    return [("given", titled_gender(titles), w) for w in words[:-1]] + [("family", "", words[-1])]


def draw_name(key: bytes, kind: str, gender: str, part: str, attempt: int) -> str:
    """A name for a part; each four attempts have names of a syllable more, so there is always one left."""
    syllables, ends = _SYLLABLES[_script(part)]
    n, out = _prf(key, "name", part, attempt), []
    for _ in range((3 if kind == "given" else 4) + attempt // 4):
        n, at = divmod(n, len(syllables))
        out.append(syllables[at])
    return "".join(out).capitalize() + (ends[gender] if kind == "given" else "n" if _script(part) == "latin" else "")


def names(text: str) -> Iterator[re.Match]:
    return NAME.finditer(text) if any(t in text for t in TITLE_ROOTS) else iter(())


def name_places(text: str) -> list[tuple[int, int]]:
    """``start, end`` of the names after titles, then of all other places where one of their parts stands alone.

    A genitive s may follow such a part.
    """
    titled = [m.span(2) for m in names(text)]
    if not titled:
        return []
    known = {w for a, b in titled for w in re.split("[ -]", text[a:b])}
    alone = re.compile(rf"\b({'|'.join(sorted(map(re.escape, known), key=len, reverse=True))})(?=s?\b)")
    inside = {i for a, b in titled for i in range(a, b)}
    return titled + [m.span(1) for m in alone.finditer(text) if m.start() not in inside]


def _span(kind: str, text: str, m: re.Match) -> tuple[int, int] | None:
    """Where the entity of a match really is; None where the match turns out to be none."""
    a, b = m.span(m.re.groups)
    if kind == "card":
        # of 13 digits only Visa's are cards; most such numbers are times
        digits = [c for c in text[a:b] if c.isdigit()]
        return (a, b) if luhn(text[a:b]) and (len(digits) > 13 or digits[0] == "4") and len(set(digits)) > 1 else None
    if kind == "phone" and text[a] == "+":
        # a number behind the phone number isn't part of it: 15 digits are the most, 11 those of North America
        most = 11 if text[a + 1] == "1" else 15
        ends = [a + g.end() for g in re.finditer(r"\d+", text[a:b])]
        return next(((a, e) for e in reversed(ends) if sum(c.isdigit() for c in text[a:e]) <= most), None)
    if kind == "iban":
        ends = [b, *(a + g.start() for g in re.finditer(" ", text[a:b]))]
        return next(((a, e) for e in sorted(ends, reverse=True) if 15 <= len(w := text[a:e].replace(" ", "")) <= 34 and iban_sum(w) == 1), None)
    if kind == "ipv6":
        groups = [g for g in text[a:b].split(":") if g]
        try:
            ipaddress.IPv6Address(text[a:b])
        except ValueError:
            return None
        return (a, b) if len(groups) > 1 and any(c.isdigit() for c in text[a:b]) else None
    return a, b


def entities(text: str) -> list[tuple[int, int, str]]:
    """Disjoint ``start, end, type`` by place; of overlapping entities the first stays, of those the first type.

    The type ``name`` spans a name without its title, or a part of such a name elsewhere in the text.
    """
    found: list[tuple[int, int, int, str]] = []
    numbers, low = DIGIT.search(text) is not None, text.lower()
    for rank, (kind, (marks, pattern)) in enumerate(DETECTORS.items()):
        if numbers if marks is None or kind == "phone" else any(m in (low if kind == "secret" else text) for m in marks):
            found += [(span[0], rank, span[1], kind) for m in pattern.finditer(text) if (span := _span(kind, text, m))]
    found += [(a, len(DETECTORS), b, "name") for a, b in name_places(text)]
    out, last = [], 0
    for a, _, b, kind in sorted(found):
        if a >= last:
            out.append((a, b, kind))
            last = b
    return out


def rewrite(text: str, key: bytes, known: dict[str, str], names_only: bool = False) -> tuple[str, int]:
    """``text`` with its entities replaced, and how many there were; parts of names that ``known`` lacks stay."""
    spans = entities(text)
    out, at = [], 0
    for a, b, kind in spans:
        if kind == "name":
            word = re.sub(r"[^ -]+", lambda m: known.get(m[0], m[0]), text[a:b])
        elif names_only:
            continue
        else:
            word = surrogate(key, kind, text[a:b])
        out += [text[at:a], word]
        at = b
    return "".join(out) + text[at:], len(spans)


def parts_of(docs: DataFrame) -> DataFrame:
    """``part, kind, gender``: the distinct parts of the names of a corpus.  What most titled places tell counts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: Counter = Counter(p for t in batch.column(0).to_pylist() if t for m in names(t) for p in name_parts(m[1], m[2]))
            rows = [(*p, own_gender(p[2]), n) for p, n in sorted(told.items())]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(4)), pa.array([r[4] for r in rows], pa.int64())], names=["kind", "gender", "part", "own", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(parts, "kind string, gender string, part string, own string, n bigint")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    votes = found.groupBy("part").agg(of(F.col("kind") == "given").alias("given"), of(F.col("kind") == "family").alias("family"), of(F.col("gender") == "f").alias("f"), of(F.col("gender") == "m").alias("m"), F.min("own").alias("own"))
    return votes.select("part", F.when(F.col("given") >= F.col("family"), "given").otherwise("family").alias("kind"), F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise(F.col("own")).alias("gender"))


def name_surrogates(docs: DataFrame, key: bytes, draw: Callable = draw_name) -> DataFrame:
    """``part, surrogate``: a surrogate of its own for each distinct part of the names of a corpus.

    A surrogate belongs to the part that drew it with the fewest attempts, then the least part; one that equals a real
    part belongs to nobody.  Whoever has none draws again.  By joins, for any number of parts.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([draw(key, kind, gender, part, n) for part, kind, gender, n in rows], pa.string())], names=["part", "kind", "gender", "attempt", "surrogate"])

    real = materialize(parts_of(docs), "names")
    now, last = real.withColumn("attempt", F.lit(0)), None
    while True:
        tried = now.mapInArrow(drawn, "part string, kind string, gender string, attempt int, surrogate string")
        owner = tried.groupBy("surrogate").agg(F.min(F.struct("attempt", "part")).alias("owner"))
        taken = real.select(F.col("part").alias("surrogate"), F.lit(True).alias("real"))
        judged = tried.join(owner, "surrogate").join(taken, "surrogate", "left")
        loses = F.col("real").isNotNull() | (F.col("owner.part") != F.col("part"))
        done = materialize(judged.select("part", "kind", "gender", (F.col("attempt") + loses.cast("int")).alias("attempt"), loses.alias("lost"), "surrogate"), "draws")
        if last is not None:
            discard(last)
        last = done
        if not done.filter("lost").limit(1).count():
            return done.select("part", "surrogate")
        now = done.select("part", "kind", "gender", "attempt")


def pseudonymise(docs: DataFrame, key: bytes, columns: tuple = ("doc_id",), draw: Callable = draw_name, most: int = BROADCAST_ROWS) -> DataFrame:
    """Columns ``columns`` of ``docs``, then ``text`` with surrogates and ``n_entities``; one row for each row.

    Null text stays null with 0 entities, empty text empty; texts without entities are unchanged, very long ones are
    rewritten whole.  Repeated rows are rewritten alike, extra columns are ignored, ids may be null, and an empty table
    gives no rows.  Two passes over the texts, neither shuffles them: the first gathers the distinct parts of names, the
    second rewrites.  No more than about ``most`` parts are broadcast at once: where a corpus has more, the parts are
    split by hash and each share takes a pass of its own over the texts.
    """
    table = name_surrogates(docs, key, draw)
    shares = max(1, -(-table.count() // most))
    kept = [c for c in columns if c != "text"]
    out = docs.select(*kept, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields) + ", n_entities int"

    def share(of: DataFrame, k: int) -> DataFrame:
        rows = table.filter(F.pmod(F.xxhash64("part"), F.lit(shares)) == k).collect()  # about ``most``
        known = ship(docs.sparkSession, {r.part: r.surrogate for r in rows})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names_known = known()
            for batch in batches:
                done = [(None, 0) if t is None else rewrite(t, key, names_known, k > 0) for t in batch.column(len(kept)).to_pylist()]
                counts = batch.column(len(kept) + 1) if k else pa.array([d[1] for d in done], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([d[0] for d in done], pa.string()), counts], names=[*kept, "text", "n_entities"])

        return of.mapInArrow(run, schema)

    for k in range(shares):
        out = share(out, k)
    return out


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with surrogates; ``n_chars`` counts the new text, other columns and their order stay.

    Nulls, empty and long texts, repeated rows, empty tables and clashing columns: as in :func:`pseudonymise`; the
    ``n_chars`` of a null text is null.
    """
    place = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}  # no column can clash with n_entities
    done = pseudonymise(docs.toDF(*place.values()), key, tuple(place.values()))
    known = {c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(at) for c, at in place.items()}
    return done.select(*[column.alias(c) for c, column in known.items()])


def demo_key() -> bytes:
    """Key of the queries; production passes its own secret."""
    return hashlib.sha256(b"lexspark queries").digest()
