"""PII surrogates: keyed, type-consistent replacements.

One pass finds entities (mail addresses, IP addresses, card and account numbers, national ids, phone
numbers, birth dates, names of persons) and reduces each to a canonical form, so that all mentions of an entity
are one. A surrogate is drawn from an HMAC of the canonical form: digits for digits, letters for letters
of the same script, octets for octets, a check digit where there was one; it is written back in the mention's own
format and case. As it depends on the key and
the entity only, texts need no join to get it, and mentions in all documents agree.

A name stands after a title, or is a known given name and a capitalised word. Inside a document its short forms are the
same person: a surname after a title, an initial, and the bare surname or given name belong to the
full name that bears them (of several, to one of the title's gender, else the last before). A surname's surrogate depends on
the surname alone, so all forms agree; the given name's is of the person's gender, which a title or the given name tells.

Distinctness is checked over the whole corpus: the distinct entities are shuffled by their
surrogate, and where two meet, or a surrogate is itself an entity of the corpus (a surname: any word of a name), all but the
first draw again with the next attempt number, until no such pair is left; persons of one surname draw other given names. Only
entities that had to draw again, a small share, must be known when texts are
rewritten: they are broadcast if they are few and joined by document if not.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import dropped, fresh, released, written

#: Entities that drew again beyond which they are joined to documents instead of broadcast.
BROADCAST_AGAIN = 500_000
#: From this attempt on a surrogate may be longer than its entity, or leave its network, as its format has too few values.
LONGER_FROM = 8
#: An entity that finds no free surrogate in so many attempts stops the job.
MOST_ATTEMPTS = 64

# Titles by gender, given names by gender and script.
TITLES = {"m": "Mr Mister Herr Monsieur Sr Señor", "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Sra Señora", "": "Dr Prof"}
GIVEN = {
    ("m", "LATIN"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karim Leon Marco Noel Oscar Pablo Ralf Simon Tomas Victor Walter".split(),
    ("f", "LATIN"): "Alma Bella Clara Diana Elena Flora Greta Helen Irene Julia Klara Laura Maria Nadia Olga Paula Rosa Sofia Tanya Vera".split(),
    ("m", "CYRILLIC"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("f", "CYRILLIC"): "Алла Вера Галина Дарья Елена Жанна Ирина Лариса Мария Нина".split(),
    ("m", "GREEK"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας".split(),
    ("f", "GREEK"): "Άννα Ελένη Ζωή Κατερίνα Μαρία".split(),
}
# Further given names by which a person is known.
KNOWN = {
    "m": "Alexander Andrew Anthony Arthur Benjamin Charles Christopher Daniel Edward Frank George Hans Harry Henry Jack Jacob James Jean John Joseph José Juan Klaus Kevin Louis Lucas Luis Mark Martin Matthew Michael Nicholas Patrick Paul Peter Philip Pierre Richard Robert Samuel Stefan Steven Thomas Timothy William".split(),
    "f": "Alice Amanda Amelia Angela Anna Anne Barbara Carmen Catherine Charlotte Christine Claire Deborah Elizabeth Emily Emma Eva Hannah Helena Isabel Jane Jennifer Jessica Karen Katherine Linda Lisa Louise Lucy Margaret Marie Martha Mary Michelle Monika Nancy Nicole Olivia Patricia Rachel Rebecca Sandra Sarah Sophie Susan Teresa Ursula Victoria".split(),
}
#: Letters that stand in for lower-case letters of a script; others keep to their own block of 32.
LETTERS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "LATIN+": "àáâãäåçèéêëìíîïñòóôõöùúûü", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшщэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}

DOMAIN = re.compile(r"\w[\w-]*(?:\.\w[\w-]*)+")
LOCAL_BACK = re.compile(r"\w[\w.+%-]*")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)", re.A)
IP6 = re.compile(r"(?<![\w:.])(?=[0-9a-f:]{0,39}:)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?)(?![\w:]|\.\d)", re.I | re.A)
BIRTH = re.compile(r"\b(?:born|birth|birthday|d\.?o\.?b|geboren|geb|née?|nacido|nacida)\b[^\w\n]{0,3}(?:(?:on|am|le|el|date)\b[^\w\n]{1,3})?(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?!\w)", re.I)
TOLD_PHONE = re.compile(r"\b(?:tel|telephone|telefon|teléfono|téléphone|phone|mobile|handy|fax)\b[.:]{0,2} ?(\+?[\d(][\d ()./-]{4,20}\d)(?![\w])", re.I)
NATIONAL = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
CARD = re.compile(r"(?<!\w)(?<!\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)", re.A)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)", re.A)
BIG = "A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ"
REST = r"(?:\w|[’'-](?!s\b)\w)"  # of a word, less a possessive s
WORD = rf"[{BIG}]{REST}+"
NAME = re.compile(r"(?<!\w)(" + "|".join(sorted((t for ts in TITLES.values() for t in ts.split()), key=len, reverse=True)) + rf")\.? ((?:[{BIG}]\. ?){{0,2}}[^\W\d_]{REST}+(?: {WORD}){{0,2}})")
#: A capitalised word before another; whether it is a given name is looked up.
PERHAPS = re.compile(rf"\b[{BIG}]\w++(?= (?:[{BIG}]\. ?)?[{BIG}][\w’'])")
INITIALS = re.compile(rf"(?<!\w)(?:[{BIG}]\. ?){{1,2}}\Z")
FULL = re.compile(rf"[{BIG}]\w+ (?:[{BIG}]\. ?)?{WORD}")
PIECE = re.compile(rf"[^\W\d_](?=\.)|[^\W_]{REST}*")
GENDER = {t: g for g, ts in TITLES.items() for t in ts.split()}
GIVEN_GENDER = {n.casefold(): g for g in "mf" for n in [*KNOWN[g], *(x for (h, _), xs in GIVEN.items() if h == g for x in xs)]}
DIGIT = re.compile("[0-9]")


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of mail addresses, in time that grows with the text alone: each is sought from its @, back to the one before."""
    last = 0
    at = text.find("@")
    while at >= 0:
        back = LOCAL_BACK.match(text[last:at][::-1])
        local = back[0][::-1].lstrip("_.+%-") if back else ""
        if local and (m := DOMAIN.match(text, at + 1)):
            yield at - len(local), m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of persons: (start, end, "name", "gender:given names surname" of the person)."""
    found: list[tuple[int, int, str]] = []  # start, end, the title's gender
    for m in NAME.finditer(text):
        if m[2][0].isupper():
            found.append((*m.span(2), GENDER[m[1]]))
    titled, i, last_end = found[:], 0, 0
    for m in PERHAPS.finditer(text):
        if m[0].casefold() in GIVEN_GENDER:
            full = FULL.match(text, m.start())
            while i < len(titled) and titled[i][1] <= m.start():  # both lists go through the text once
                i += 1
            if full and last_end <= m.start() and (i == len(titled) or full.end() <= titled[i][0]):
                found.append((*full.span(), ""))
                last_end = full.end()
    if not found:
        return []
    mentions, people = [], {}  # people: (given names, surname) -> gender
    of_surname: dict[str, list[tuple[str, str]]] = {}
    for a, b, gender in sorted(found):
        words = [x.casefold() for x in PIECE.findall(text[a:b])]
        if len(words) == 1 and words[0] in GIVEN_GENDER:
            words.append("")
        mentions.append((a, b, gender, words))
        given = [x for x in words[:-1] if len(x) > 1]
        if given:
            key = (given[0], words[-1])
            if key not in people:
                of_surname.setdefault(key[1], []).append(key)
            people[key] = people.get(key) or gender or GIVEN_GENDER.get(given[0], "")
    out, last = [], {}
    fitting: dict[tuple, dict] = {}  # (surname, initial, gender) -> who it may be, while none of that surname gets another gender

    def may_be(surname: str, initial: str, gender: str) -> dict:
        key = (surname, initial, gender)
        if key not in fitting:
            known = [k for k in of_surname.get(surname, ()) if k[0].startswith(initial)]
            fitting[key] = dict.fromkeys([k for k in known if gender and people[k] == gender] or [k for k in known if not gender or not people[k]])
        return fitting[key]

    for a, b, gender, words in mentions:
        surname, given = words[-1], [x for x in words[:-1] if len(x) > 1]
        if given:
            who = (given[0], surname)
        else:
            fits = may_be(surname, words[0][0] if words[:-1] else "", gender)
            who = last.get(surname) if last.get(surname) in fits else next(iter(fits), ("", surname))
        if who[0] and gender and not people[who]:
            people[who] = gender
            for key in [k for k in fitting if k[0] == surname]:
                del fitting[key]
        last[surname] = who
        out.append((a, b, who, gender))
    # words of these persons that stand alone
    alone = {}
    for who in [*people, *(w for _, _, w, _ in out)]:
        for x in who:
            if len(x) > 1:
                alone.setdefault(x, {})[who] = None
    taken = [(a, b) for a, b, *_ in out]
    i = 0
    for m in re.finditer(rf"(?<!\w){WORD}", text) if alone else ():
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if (i == len(taken) or m.end() <= taken[i][0]) and (fits := alone.get(m[0].casefold())):
            start = m.start()
            if m[0].casefold() == next(iter(fits))[1] and (first := INITIALS.search(text, max(start - 6, taken[i - 1][1] if i else 0), start)):
                start = first.start()
                who = next((w for w in fits if w[0][:1] == first[0][0].casefold()), next(iter(fits)))
            else:
                who = next(iter(fits))
            out.append((start, m.end(), who, ""))
    return [(a, b, "name", f"{people.get(who) or gender}:{' '.join(x for x in who if x)}" if who[0] else f"{gender}:{who[1]}") for a, b, who, gender in out]


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), by start, without overlap; an earlier kind goes first."""
    text, found = text or "", []
    if "@" in text:
        found += [(a, b, "mail", text[a:b].lower()) for a, b in mails(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "ip", m[0]) for m in IP.finditer(text)]
        if "::" in text or text.count(":") > 6:
            found += [(*m.span(), "ip6", m[0].lower()) for m in IP6.finditer(text) if m[0].count(":") > 2]
        found += [(*m.span(1), "birth", m[1]) for m in BIRTH.finditer(text)]
        found += [(*m.span(), "national", m[0]) for m in NATIONAL.finditer(text)]
        found += [(*m.span(), "card", re.sub(r"\D", "", m[0])) for m in CARD.finditer(text)]
        found += [(*m.span(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text)]
        found += [(*m.span(), "phone", re.sub(r"[^\d+]", "", m[0])) for m in PHONE.finditer(text)]
        found += [(*m.span(1), "phone", re.sub(r"[^\d+]", "", m[1])) for m in TOLD_PHONE.finditer(text) if sum(map(str.isdigit, m[1])) >= 6]
    found += _names(text)
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text)) if found else b""
    for x in sorted(found, key=lambda x: (ORDER.index(x[2]), x[0])):
        if not any(taken[x[0] : x[1]]):
            taken[x[0] : x[1]] = b"\1" * (x[1] - x[0])
            out.append(x)
    return sorted(out)


ORDER = ("mail", "ip", "ip6", "birth", "national", "card", "iban", "phone", "name")


def parts(kind: str, entity: str) -> list[tuple[str, str]]:
    """What draws a surrogate of its own: a name's surname, and its given names beside it."""
    if kind != "name":
        return [(kind, entity)]
    gender, name = entity.split(":", 1)
    words = name.split(" ")
    return [("surname", words[-1])] + [("name", entity)] * (len(words) > 1)


class _Draw:
    """Numbers from HMACs of an entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int) -> None:
        self.key, self.seed, self.n, self.pool, self.left = key, f"{kind}\0{entity}\0{attempt}\0".encode(), 0, 0, 0

    def below(self, n: int) -> int:
        if self.left < 32:
            self.pool, self.left, self.n = int.from_bytes(hmac.digest(self.key, self.seed + str(self.n).encode(), "sha256"), "big"), 256, self.n + 1
        self.pool, x, self.left = self.pool >> 32, self.pool & 0xFFFFFFFF, self.left - 32
        return x * n >> 32


@lru_cache(4096)
def _script(c: str) -> str:
    if c < "\x80":
        return "LATIN"
    name = unicodedata.name(c, "?").split(" ")[0]
    return "LATIN+" if name == "LATIN" else name


def _letter(draw: _Draw, c: str) -> str:
    letters = LETTERS.get(_script(c))
    if letters is None:
        for _ in range(8):  # another letter of its block
            x = chr((ord(c) & ~31) + draw.below(32))
            if x.isalpha() and not (c.islower() and x.isupper()):
                return x
        return c
    return letters[draw.below(len(letters))]


def _shaped(draw: _Draw, text: str) -> str:
    return "".join(str(draw.below(10)) if c.isdigit() else _letter(draw, c) if c.isalpha() else c for c in text)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """Canonical form of the replacement."""
    draw = _Draw(key, kind, entity, attempt)
    more = "".join(str(draw.below(10)) for _ in range(max(0, attempt - LONGER_FROM + 1)))
    if kind == "mail":
        local, domain = entity.split("@", 1)
        host, _, top = domain.rpartition(".")
        near = _Draw(key, "domain", domain, 0)  # addresses of one domain stay together
        return f"{_shaped(draw, local)}{more}@{_shaped(near, host)}.{top}"
    if kind == "ip":
        own = entity.split(".")
        first = own[0] if own[0] in ("10", "127") and attempt < LONGER_FROM else str(1 + draw.below(223))
        return ".".join([first, *(str(draw.below(256)) for _ in range(2)), str(1 + draw.below(254))])
    if kind == "ip6":
        made = "".join("0123456789abcdef"[draw.below(16)] if c != ":" else c for c in entity)
        return made if attempt < LONGER_FROM else ":".join(f"{1 + draw.below(0xFFFF):x}" for _ in range(8))
    if kind == "birth":
        first, mark, rest = re.match(r"(\d+)(\D)(.*)", entity).groups()
        year, month, day = str(1930 + draw.below(80 + 20 * attempt)), f"{1 + draw.below(12):02}", f"{1 + draw.below(28):02}"
        return mark.join((year, month, day) if len(first) == 4 else (day, month, year))
    if kind == "card":
        x = _shaped(draw, entity)[:-1] + more
        check = next(d for d in "0123456789" if _luhn(x + d) == 0)
        valid = _luhn(entity) == 0
        return x + (check if valid else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        return entity[:2] + "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in entity[2:]) + more
    if kind == "phone":
        keep = 2 if entity.startswith("+") else 0  # the plus and the first digit of the country
        return entity[:keep] + _shaped(draw, entity[keep:]) + more
    if kind == "surname":
        script = _script_of(entity)
        if ("m", script) not in GIVEN:
            return _shaped(draw, entity) + more
        vowels, others = _syllables(script)
        return "".join(others[draw.below(len(others))] + vowels[draw.below(len(vowels))] for _ in range(3 + attempt // 4))
    if kind == "name":  # given names, before the true surname: they need to differ among persons of one surname only
        gender, name = entity.split(":", 1)
        *own, surname = name.split(" ")
        given = GIVEN.get((gender or "mf"[draw.below(2)], _script_of(own[0])))
        if not given:
            return " ".join([*(_shaped(draw, x) for x in own), surname])
        names = [x.lower() for x in given if x.lower() not in own]
        return " ".join([*("-".join(names[draw.below(len(names))] for _ in range(1 + max(0, attempt - 3) // 4)) for _ in own), surname])
    return _shaped(draw, entity) + more


def _script_of(name: str) -> str:
    return _script(next((c for c in name if ord(c) > 127 and _script(c) != "LATIN+"), "a"))


def _syllables(script: str) -> tuple[str, str]:
    return {"CYRILLIC": ("аеиоу", "бвгдзклмнпрст"), "GREEK": ("αεηιο", "βγδκλμνπρστ")}.get(script, ("aeiou", "bdfgklmnprst"))


def rendered(mention: str, kind: str, made: str) -> str:
    """The surrogate in the mention's format: its separators, its case."""
    if kind in ("card", "phone", "iban"):
        own = iter(made)
        out = [next(own, "") if c.isalnum() or (c == "+" and kind == "phone") else c for c in mention]
        return "".join([*out, *own])
    return made.upper() if mention.isupper() else made


def _cased(mention: str, made: str) -> str:
    return made.upper() if mention.isupper() and len(mention) > 1 else re.sub(r"(^|-)(\w)", lambda m: m[1] + m[2].upper(), made)


def _name(key: bytes, mention: str, entity: str, attempts: dict[tuple[str, str], int]) -> str:
    """The mention with the surrogates of its words; an initial stays an initial."""
    made = {k: surrogate(key, k, e, attempts.get((k, e), 0)) for k, e in parts("name", entity)}
    *given, surname = entity.split(":", 1)[1].split(" ")
    firsts = made["name"].split(" ")[:-1] if given else []
    known = {surname: made["surname"]} | dict(zip(given, firsts))

    def word(m: re.Match) -> str:
        x = m[0].casefold()
        if x in known:
            return _cased(m[0], known[x])
        if len(x) == 1 and firsts:
            return firsts[0][0].upper()
        if len(x) == 1:
            return _letter(_Draw(key, "initial", f"{x} {surname}", 0), x).upper()
        return _cased(m[0], surrogate(key, "surname", x, attempts.get(("surname", x), 0)))

    return PIECE.sub(word, mention)


def replaced(key: bytes, text: str | None, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, entity in found:
        mention = text[start:end]
        made = _name(key, mention, entity, attempts) if kind == "name" else rendered(mention, kind, surrogate(key, kind, entity, attempts.get((kind, entity), 0)))
        out += [text[at:start], made]
        at = end
    return "".join(out) + text[at:], [k for _, _, k, _ in found]


def _drawn(mention: str, kind: str, entity: str) -> list[tuple[str, str]]:
    """Of a mention: the parts of its entity, and words of a name that are no part of it."""
    out = parts(kind, entity)
    if kind == "name":
        own = entity.split(":", 1)[1].split(" ")
        out += [("surname", x) for m in PIECE.finditer(mention) if len(x := m[0].casefold()) > 1 and x not in own]
    return out


def _all_drawn(text: str | None) -> list[tuple[str, str]]:
    return sorted({x for a, b, k, e in entities(text) for x in _drawn(text[a:b], k, e)})


@released
def _entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, h, k, e) for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) for k, e in _all_drawn(t.as_py())]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "hash", "kind", "entity"])


def assigned(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of distinct entities, such that surrogates are distinct and none is an entity."""

    @released
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "entity", "attempt", "made"])

    kinds = "kind string, entity string, attempt int"
    now = written(known.withColumn("attempt", F.lit(0)).select("kind", "entity", "attempt").mapInArrow(draw, f"{kinds}, made string"), "surrogates")
    # a surname's surrogate is no word of any name; given names differ among persons of one surname, whose own surrogate is no one's
    bare = F.regexp_replace("entity", "^[^:]*:", "")
    taken = known.where("kind not in ('name', 'surname')").select("kind", F.col("entity").alias("made"))
    taken = taken.union(known.where("kind in ('name', 'surname')").select(F.lit("surname").alias("kind"), F.explode(F.split(bare, " ")).alias("made"))).distinct()
    taken = written(taken, "taken")
    for _ in range(MOST_ATTEMPTS):
        # the first of those that share a surrogate keeps it: the one that has had it longest
        firsts = now.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity")).alias("keep")).where("n > 1")
        shared = now.join(firsts, ["kind", "made"]).where("entity <> keep.entity").select("kind", "entity")
        real = now.join(taken, ["kind", "made"], "left_semi").select("kind", "entity")
        again = written(shared.union(real).distinct(), "again")
        if again.isEmpty():
            dropped(taken)
            return now.select("kind", "entity", "attempt")
        drawn = now.join(again, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, f"{kinds}, made string")
        new = written(now.join(again, ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "made").unionByName(drawn), "surrogates")
        dropped(now)
        dropped(again)
        now = new
    raise ValueError("a kind of entity has too few free surrogates")


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in its text, and kinds array<string>: the kind of each mention replaced.

    All rows and other columns stay; a column kinds of docs is replaced. Null texts stay null, texts without
    entities stay as they are, repeated rows become alike, an empty table stays empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    mentions = written(rows.mapInArrow(_entity_rows, "doc_id long, hash long, kind string, entity string"), "mentions")
    known = written(mentions.select("kind", "entity").distinct(), "entities")
    again = written(assigned(known, key).where("attempt > 0"), "again")
    few = again.limit(BROADCAST_AGAIN + 1).count() <= BROADCAST_AGAIN
    docs = docs.drop("kinds")
    more = fresh(docs, "_again")
    if few:
        shared = spark.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in again.collect()})
        own = docs.withColumn(more, F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        shared = spark.sparkContext.broadcast({})
        by_doc = mentions.join(again, ["kind", "entity"]).groupBy("doc_id", "hash").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias(more))
        by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), more)
        own = docs.join(by_doc, docs[id_col].cast("long").eqNullSafe(by_doc["_id"]) & (F.xxhash64(docs[text_col]) == by_doc["_hash"]), "left").select(*(docs[c] for c in docs.columns), by_doc[more])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, last = b.schema.get_field_index(text_col), b.num_columns - 1
            texts, kinds = [], []
            for text, again in zip(b.column(at), b.column(last)):
                attempts = {(x["kind"], x["entity"]): x["attempt"] for x in again.as_py()} if again.is_valid else shared.value
                t, k = replaced(key, text.as_py(), attempts)
                texts.append(t)
                kinds.append(k)
            cols = [*b.columns[:last], pa.array(kinds, pa.list_(pa.string()))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:last], "kinds"])

    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return own.mapInArrow(run, f"{told}, kinds array<string>")
