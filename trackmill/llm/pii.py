"""Personal data replaced by keyed surrogates. DataFrame functions only."""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, spare, stored

#: The session's setting with the key. A key that is published makes surrogates of short forms easy to guess.
KEY_SETTING = "trackmill.pii.key"

# First names by script and gender.
FIRST_NAMES = {
    "latin_f": ("Mary", "Anna", "Laura", "Emma", "Julia", "Sofia", "Clara", "Marie", "Sarah", "Linda", "Carmen", "Ingrid", "Helen", "Alice"),
    "latin_m": ("John", "Peter", "Thomas", "David", "Michael", "Robert", "James", "Pierre", "Hans", "Carlos", "Paul", "Daniel", "Mark", "Oliver"),
    "cyrillic_f": ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
    "cyrillic_m": ("Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Андрей", "Михаил"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Sr", "Sra", "Mme", "г-н", "г-жа")
# Parts of invented names.
STARTS = {
    "latin": ("B", "D", "F", "G", "H", "K", "L", "M", "N", "P", "R", "S", "T", "V", "W", "Br", "St", "Tr"),
    "cyrillic": ("Б", "В", "Г", "Д", "З", "К", "Л", "М", "Н", "П", "Р", "С", "Т", "Ф", "Бр", "Ст", "Тр"),
}
RIMES = {
    "latin": ("a", "e", "o", "u", "al", "an", "ar", "el", "en", "er", "im", "in", "ol", "on", "or", "un"),
    "cyrillic": ("а", "е", "о", "у", "ал", "ан", "ар", "ел", "ен", "ер", "им", "ин", "ол", "он", "ор", "ун"),
}

#: Titles that tell the gender; lower-case words that may stand between the words of a name.
GENDERS = {"f": ("Mrs", "Ms", "Miss", "Frau", "Sra", "Mme", "г-жа"), "m": ("Mr", "Herr", "Sr", "г-н")}
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "das", "do", "dos", "du", "la", "le", "los", "bin", "ibn", "al", "el", "ter", "ten", "zu", "zum", "zur", "af", "av", "y", "e")

# No pattern repeats a group without a bound: Java calls itself for each repeat. What is one sign for one sign replaced has a length bound too.
# A word of a name may have inner capitals, an apostrophe (but a genitive's), a hyphen; it ends where the word does.
_LETTER, _STOP = r"[\p{L}\p{M}]", r"(?![\p{L}\p{M}\p{N}_])"
_NAME = rf"(?:\p{{L}}['’]|(?:al|el)-)?\p{{Lu}}{_LETTER}+(?:['’]\p{{Lu}}{_LETTER}*|-\p{{Lu}}{_LETTER}*|-\p{{Ll}}{{1,3}}(?!{_LETTER})){{0,8}}+{_STOP}"
_INITIAL = r"\p{Lu}(?:\.-?\p{Lu})*\.?"
_both = lambda words: "|".join(dict.fromkeys(x for w in words for x in (w, w.upper())))
_HEADS = _both(n for names in FIRST_NAMES.values() for n in names)
_TITLE = rf"(?:{_both(TITLES)})\.?"
_NAMES = rf"(?:(?:{_NAME}|{_INITIAL}|{'|'.join(PARTICLES)}) ){{0,6}}{_NAME}"
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    "secret": r"(?<!\w)[0-9a-f]{40}(?!\w)",
    "key": r"(?<![\w-])(?:A[KS]IA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{30,255}|xox[a-z]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255})(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w.+-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:(?:[ .-]\d{2}){3,5}|(?:[ .-]\d{3,4}){2}|[ .-]?\d{5,8})|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\w)",
    "ssn": r"(?<![\w.+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "card": r"(?<![\w+-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ip6": rf"(?<![\w:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "person": rf"(?<!\w)(?=[\p{{Lu}}г])(?:(?:{_TITLE} ){{1,8}}|(?:{_HEADS})(?:-{_NAME})? ){_NAMES}",
}
# What all have in common is asked first: no letter or digit before, and a first sign that one of them has.
PATTERN = rf"(?<!\w)(?=[0-9A-Za-z(+г]|\p{{Lu}})(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"
_CAPITALS = r"^[\p{Lu}\p{M}'’-]{2,}$"
#: Stands around matches while a text is cut up. Its first character is followed by _OWN where a text has it itself.
_CUT, _OWN = "\ue000\uf8ff\ue001\uf8fe", "\ue002"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder by 97 with its first four signs at its end, letters as 10 to 35."""
    signs = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4))), "")
    step = lambda r, c: F.when(c == "", r).when(c.rlike("[0-9]"), (r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(signs, F.lit(0), step)


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\D", "")


def kind_of(raw: Column) -> Column:
    """The type of a match; null for numbers that only look like a card or an IBAN."""
    full = lambda k: raw.rlike(f"^(?:{PATTERNS[k]})$")
    card = luhn(_digits(raw)) & _digits(raw).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")
    return (
        F.when(raw.contains("@"), "email").when(full("key"), "key").when(full("ip"), "ip").when(full("ip6"), "ip6").when(full("secret"), "secret").when(full("ssn"), "ssn")
        .when(full("iban"), F.when(_mod97(F.replace(raw, F.lit(" "))) == 1, "iban"))
        .when(full("card") & card, "card")
        .when(full("phone") & F.length(_digits(raw)).between(7, 15) & ~raw.rlike(r"^\d+$"), "phone")
        .when(raw.rlike(r"^\p{L}"), "person")
    )


def form_of(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity share: a phone's digits (without the North American country code, after another one), the
    digits of a card or a social security number, an IBAN without spaces, lower case of addresses."""
    code = F.regexp_extract(raw, r"^\+\d{1,3}", 0)
    digits = _digits(raw)
    phone = F.when(~raw.startswith("+"), digits).when(digits.rlike(r"^1\d{10}$"), F.substring(digits, 2, 10)).otherwise(F.concat(code, F.lit(" "), _digits(F.substring(raw, F.length(code) + 1, F.length(raw)))))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(raw, F.lit(" "))).when(kind == "key", raw).otherwise(F.lower(raw))


def _name_form(word: Column, surname: bool) -> Column:
    """A name's word with capitals as in other names; of a Russian surname without the feminine ending."""
    own = F.when(word.rlike(_CAPITALS), F.initcap(F.lower(word))).otherwise(word)
    return F.when(own.rlike("[Ѐ-ӿ]$"), F.regexp_replace(own, "(?<=[вн])а$", "")).otherwise(own) if surname else own


def _byte(stream: Column, i: Column | int) -> Column:
    """Byte i of a hash of 64 bytes in hexadecimal, over and over."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(stream, 2 * at + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _invented(script: str, stream: Column, syllables: int) -> Column:
    parts = [_pick(STARTS[script] if k == 0 else tuple(s.lower() for s in STARTS[script]), _byte(stream, 2 * k)) for k in range(syllables)]
    rimes = [_pick(RIMES[script], _byte(stream, 2 * k + 1)) for k in range(syllables)]
    return F.concat(*[x for pair in zip(parts, rimes) for x in pair])


def surrogate(kind: Column, form: Column, attempt: Column, key: str, gender: Column | None = None) -> Column:
    """A replacement of the same type and shape, from a keyed hash. Letters stay letters and digits digits; the last
    label of an address, a phone number's country code and length, a card's issuer digit, an IBAN's country and a key's prefix
    stay, check digits are right. First names end as the gender's do."""
    gender = F.lit(None).cast("string") if gender is None else gender
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 512)
    chars = F.split(form, "")
    same = F.transform(
        chars,
        lambda c, i: F.when((kind == "phone") & (i < F.instr(form, " ")), c)
        .when((kind == "ip6") & c.rlike("[0-9a-f]"), F.lower(F.hex((1 + _byte(stream, i) % 15).cast("long"))))
        .when(c.rlike("[0-9]"), F.char(48 + _byte(stream, i) % 10))
        .when(c.rlike("[a-z]"), F.char(97 + _byte(stream, i) % 26))
        .when(c.rlike("[A-Z]"), F.char(65 + _byte(stream, i) % 26))
        .otherwise(c),
    )
    plain = F.array_join(same, "")
    whole = F.length(form)
    email = F.concat(F.regexp_replace(plain, r"[^.]*$", ""), F.substring_index(form, ".", -1))
    secret = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.char(48 + _byte(stream, i) % 10)).otherwise(F.char(97 + _byte(stream, i) % 6))), "")
    ip = F.concat_ws(".", *[(1 + _byte(stream, i) % 254).cast("string") for i in range(4)])
    body = F.concat(F.substring(form, F.lit(1), F.lit(1)), F.substring(plain, F.lit(2), whole - 2))
    card = reduce(lambda out, d: F.when(luhn(F.concat(body, F.lit(str(d)))), F.concat(body, F.lit(str(d)))).otherwise(out), range(10), body)
    head = F.regexp_extract(form, r"^(?:A[KS]IA|gh[a-z]_|xox[a-z]-|sk-)", 0)
    api = F.concat(head, F.substring(plain, F.length(head) + 1, whole))
    account = F.concat(F.substring(form, F.lit(1), F.lit(2)), F.lit("00"), F.substring(plain, F.lit(5), whole))
    iban = F.concat(F.substring(form, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(account)).cast("string"), 2, "0"), F.substring(plain, F.lit(5), whole))
    ssn = F.concat((1 + _byte(stream, 0) % 5).cast("string"), F.substring(plain, F.lit(2), F.lit(2)), (1 + _byte(stream, 3) % 9).cast("string"), F.substring(plain, F.lit(5), F.lit(1)), (1 + _byte(stream, 5) % 9).cast("string"), F.substring(plain, F.lit(7), F.lit(3)))
    phone = F.when(form.rlike(r"^\d{10}$"), F.concat((2 + _byte(stream, 0) % 8).cast("string"), F.substring(plain, F.lit(2), whole))).otherwise(plain)
    named = {}
    for script, f, m, end in (("latin", "a", "n", ""), ("cyrillic", "а", "н", "ов")):
        named[f"surname_{script}"] = F.concat(_invented(script, stream, 3), F.lit(end))
        named[f"given_{script}"] = F.concat(_invented(script, stream, 2), F.when(gender == "f", f).when(gender == "m", m).otherwise(""))
    out = F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card).when(kind == "key", api).when(kind == "iban", iban).when(kind == "ssn", ssn).when(kind == "phone", phone)
    for k, c in named.items():
        out = out.when(kind == k, c)
    return out.otherwise(plain)


def listed_names(key: str) -> dict[str, str]:
    """For each listed first name another of its script and gender: a keyed order of each list, in which the next one stands for
    each, so that no two meet."""
    out = {}
    for group, names in FIRST_NAMES.items():
        own = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{group}|{n}".encode()).digest())
        out |= dict(zip(own, own[1:] + own[:1]))
    return out


def _gender(raw: Column) -> Column:
    """f or m as the title says, or else the listed first name that stands first; null where neither does."""
    out = F.lit(None).cast("string")
    for group, names in FIRST_NAMES.items():
        out = F.when(raw.rlike(rf"^(?:{_both(names)})(?!\p{{L}})"), group[-1]).otherwise(out)
    for g, titles in GENDERS.items():
        out = F.when(raw.rlike(rf"^(?:{_TITLE} ){{0,8}}?(?:{_both(titles)})(?:\.| )"), g).otherwise(out)
    return out


_PART = "struct<text:string,kind:string,form:string,gender:string>"


def _part(text: Column, kind: Column | None = None, form: Column | None = None, gender: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(text.alias("text"), (null if kind is None else kind).alias("kind"), (null if form is None else form).alias("form"), (null if gender is None else gender).alias("gender"))


def _script(word: Column) -> Column:
    return F.when(word.rlike("[Ѐ-ӿ]"), "cyrillic").otherwise("latin")


def _first(word: Column, gender: Column) -> Column:
    """A word before the surname: a listed first name, an initial, a title or particle (which stay), or any other name."""
    form = _name_form(word, False)
    listed = form.isin([n for names in FIRST_NAMES.values() for n in names])
    stays = word.rlike(rf"^(?:{_TITLE}|{'|'.join(PARTICLES)})$")
    kind = F.when(stays, F.lit(None)).when(listed, "listed").when(word.rlike(rf"^{_INITIAL}$"), "initial").otherwise(F.concat(F.lit("given_"), _script(word)))
    return _part(word, kind, F.when(kind.isNotNull(), form), gender)


def _person(raw: Column) -> Column:
    """Parts of a person's name: each word, and the spaces between."""
    words, gender = F.split(raw, " "), _gender(raw)
    last = F.element_at(words, -1)
    before = F.flatten(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.array(_first(w, gender), _part(F.lit(" ")))))
    return F.concat(before, F.array(_part(last, F.concat(F.lit("surname_"), _script(last)), _name_form(last, True), gender)))


def parts_of(text: Column) -> Column:
    """A text as parts, in order: what is matched, and what is between. Matches are found in one pass."""
    pieces = F.split(F.regexp_replace(text, f"({PATTERN})", f"{_CUT}$1{_CUT}"), _CUT)

    def one(x: Column, i: Column) -> Column:
        kind = kind_of(x)
        other = F.array(_part(x, kind, F.when(kind.isNotNull(), form_of(kind, x))))
        return F.when(i % 2 == 0, F.array(_part(x))).when(kind == "person", _person(x)).otherwise(other).cast(f"array<{_PART}>")

    return F.flatten(F.transform(pieces, one))


def with_mentions(rows: DataFrame, ents: str) -> DataFrame:
    """rows, in whose parts `ents` single words that are a name of a person found in the same text (the surname, a first name; in capitals too, and a
    Russian surname in either gender) are parts of their own, of the same kind and form. Only names whose first letters up to a sign are a word of the rest of the text
    are looked for. What a text's words share is a column of its own, or each word would work it out again."""
    names, words, found = spare(rows, "names", "words", "found")
    spelt = lambda p: F.array_compact(F.array(p["text"], p["form"], F.upper(p["form"]), *[F.when(p["kind"] == "surname_cyrillic", x) for x in (F.concat(p["form"], F.lit("а")), F.upper(F.concat(p["form"], F.lit("а"))))]))
    first = lambda w: F.regexp_extract(w, r"^[\p{L}\p{M}\p{N}_]*", 0)
    is_name = lambda p: p["kind"].isNotNull() & p["kind"].rlike("^(?:surname|given|listed)") & (F.length(p["text"]) > 1)
    rows = rows.withColumn(names, F.array_distinct(F.filter(ents, is_name)))
    there = F.flatten(F.transform(F.filter(ents, lambda p: p["kind"].isNull() & (F.length(p["text"]) > 1)), lambda p: F.split(p["text"], r"[^\p{L}\p{M}\p{N}_]+")))
    rows = rows.withColumn(words, F.when(F.size(names) > 0, F.array_intersect(F.flatten(F.transform(names, lambda p: F.transform(spelt(p), first))), there)))
    said = lambda p: F.filter(spelt(p), lambda w: F.array_contains(words, first(w)))
    rows = rows.withColumn(names, F.when(F.size(words) > 0, F.filter(names, lambda p: F.arrays_overlap(F.transform(spelt(p), first), F.col(words)))))
    each = F.array_distinct(F.flatten(F.transform(names, said)))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])("), F.array_join(F.transform(each, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}_])"))
    rows = rows.withColumn(found, F.when(F.size(words) > 0, pattern))

    def mention(word: Column) -> Column:
        known = lambda surname: F.filter(names, lambda p: (p["kind"].startswith("surname") == surname) & (p["form"] == _name_form(word, surname)))
        p = F.coalesce(F.get(known(True), F.lit(0)), F.get(known(False), F.lit(0)))
        return _part(word, p["kind"], p["form"], p["gender"])

    def cut(p: Column) -> Column:
        pieces = F.split(F.regexp_replace(p["text"], F.col(found), F.lit(f"{_CUT}$1{_CUT}")), _CUT)
        return F.transform(pieces, lambda x, i: F.when(i % 2 == 0, _part(x)).otherwise(mention(x)).cast(_PART))

    more = F.transform(ents, lambda p: F.when(p["kind"].isNull() & (F.length(p["text"]) > 1), cut(p)).otherwise(F.array(p)))
    return rows.withColumn(ents, F.when(F.col(found).isNotNull(), F.flatten(more)).otherwise(F.col(ents))).drop(names, words, found)


def _dressed(kind: Column, raw: Column, form: Column, new: Column, key: str) -> Column:
    """A surrogate form in the format of the occurrence: its punctuation, case and ending. Listed first names and initials, which need
    no surrogate of their own, get theirs here."""
    chars = F.split(raw, "")
    signs = F.regexp_replace(new, "[^0-9A-Z]", "")
    stay = F.length(F.regexp_replace(raw, "[^0-9A-Z]", "")) - F.length(signs)  # a country code that the form leaves out
    count = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Z]") & (count(i) > stay), F.substring(signs, count(i) - stay, F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    listed = F.element_at(F.create_map(*[F.lit(x) for pair in listed_names(key).items() for x in pair]), form)
    n = F.pmod(F.xxhash64(F.lit(key), F.lit("initial"), form), F.lit(1 << 30))
    letter = F.when(raw.rlike("[Ѐ-ӿ]"), _pick(tuple("АБВГДЕИКЛМНОПРСТ"), n)).otherwise(_pick(tuple("ABCDEFGHIJKLMNOPRSTVW"), n))
    initial = F.concat(letter, F.when(raw.endswith("."), ".").otherwise(""))
    ending = F.when((kind == "surname_cyrillic") & F.lower(raw).rlike("[вн]а$") & ~F.lower(form).rlike("[вн]а$"), "а").otherwise("")
    name = F.when(kind == "listed", listed).otherwise(F.concat(new, ending))
    name = F.when(raw.rlike(_CAPITALS), F.upper(name)).otherwise(name)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), numbers).when(kind == "email", cased).when(kind == "initial", initial).when(kind.rlike("^(?:listed|surname|given)"), name).otherwise(new)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate): one row for each distinct entity (kind, form, gender), no two of a kind with the same surrogate, and none
    whose surrogate is another entity of the input or a listed first name. Rows with a null kind are left out.

    Candidates come from a keyed hash. Those that are taken, or that two entities share, are drawn again by all but
    the smallest, until none is left; after 50 rounds a kind has no room left, which is an error. An entity met with two
    genders has the first by name."""
    todo = stored(entities.where("kind IS NOT NULL").groupBy("kind", "form").agg(F.min("gender").alias("gender")), "entities")
    spark = entities.sparkSession
    listed = spark.createDataFrame([(f"given_{group[:-2]}", n) for group, names in FIRST_NAMES.items() for n in names], "kind string, surrogate string")
    real = todo.select("kind", F.col("form").alias("surrogate")).unionByName(listed)
    done = None
    for attempt in range(50):
        drawn = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.lit(attempt), key, F.col("gender")))
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate"))
        first = Window.partitionBy("kind", "surrogate").orderBy("form")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        new = stored(free.select("kind", "form", "surrogate"), "surrogates")
        done = new if done is None else done.unionByName(new)
        left = todo.join(new, ["kind", "form"], "left_anti")
        if left.isEmpty():
            return done
        todo = stored(left, "entities")
    raise RuntimeError("a kind of entity has more members than surrogates")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every entity in the text replaced, and n_entities, the replaced pieces of each text (where docs has such a column,
    with underscores before it).

    Entities are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards and IBANs (with right check digits), social
    security numbers, secrets of 40 hexadecimal digits, access keys with a known prefix, and persons after a title or with a
    known first name: all words of the name, middle ones and initials included, of which the last is the surname. Where a
    person is found, the same text's single mentions of the surname and the first names are replaced alike. One entity has
    one surrogate in all documents, however it is spelt, and two entities never have the same. Texts without entities are
    not touched and stay where they are; the others are cut up once, stored, and meet their surrogates. Null texts stay null,
    with 0 entities; very long texts are cut up whole (an address has 64 signs before the @ and 127 labels at most, a key 255 signs, a name 8 hyphens and 8 titles). Repeated rows are rows of their own, treated alike. An empty table
    gives an empty result.
    """
    n_entities, gaps, ents, row, at_row, news = spare(docs, "n_entities", "gaps", "ents", "row_number_", "to_row", "news")
    body = F.col(f"`{text}`")
    has = F.coalesce(body.rlike(PATTERN), F.lit(False))
    kept = [f"`{c}`" for c in docs.columns if c != text]
    cut = docs.where(has).select(*kept, parts_of(F.replace(body, F.lit(_CUT[0]), F.lit(_CUT[0] + _OWN))).alias(ents))
    cut = with_mentions(cut, ents).withColumn(row, F.monotonically_increasing_id())
    whole = F.array_join(F.transform(ents, lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(F.lit(_CUT))), "")
    cut = stored(cut.select(*kept, row, F.split(whole, _CUT).alias(gaps), F.filter(ents, lambda p: p["kind"].isNotNull()).alias(ents)), "cut")
    each = cut.select(F.col(row).alias("row"), F.posexplode(ents).alias("at", "e")).select("row", "at", "e.*")
    plain = F.col("kind").isin("listed", "initial")
    named = surrogates(each.where(~plain), key).withColumnsRenamed({"kind": "s_kind", "form": "s_form"})
    told = each.join(named, (F.col("kind") == F.col("s_kind")) & (F.col("form") == F.col("s_form")), "left")
    new = _dressed(F.col("kind"), F.col("text"), F.col("form"), F.col("surrogate"), key)
    told = told.select(F.col("row").alias(at_row), F.struct("at", new.alias("new")).alias("new")).groupBy(at_row).agg(F.array_sort(F.collect_list("new")).alias(news))  # a text's own
    filled = F.zip_with(gaps, F.concat(F.coalesce(F.transform(F.col(news), lambda x: x["new"]), F.array().cast("array<string>")), F.array(F.lit(""))), lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    changed = cut.join(told, F.col(row) == F.col(at_row), "left").withColumns({text: F.replace(F.array_join(filled, ""), F.lit(_CUT[0] + _OWN), F.lit(_CUT[0])), n_entities: F.size(ents)})
    columns = [*(f"`{c}`" for c in docs.columns), n_entities]
    return docs.where(~has).withColumn(n_entities, F.lit(0)).select(*columns).unionByName(changed.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, the whole text with surrogates, n_entities and the text's hash, for all documents. The key is the session's setting;
    without one it is drawn anew for each run, and no two runs agree."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    out = replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "n_entities", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
