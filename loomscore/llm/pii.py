"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Detected are e-mail addresses, IPv4 and IPv6 addresses, telephone, card and
social security numbers, IBANs, access keys, long hexadecimal strings, values
given to words like "password", names that follow a title, and given names of
``GIVEN`` with a capitalised word after them.  Card numbers are those with a
valid check digit.  An entity is known by its kind and canonical form (digits
only, lower case, an IPv6 address in full, one word of a name), so it gets one
surrogate wherever and however it is written.  The words of a person's name
are replaced wherever they stand in that document, with or without a title,
capitalised as there or in capitals.

A surrogate is drawn from a keyed hash and keeps the kind, length, punctuation
and case of what it replaces: digits for digits, letters for letters, a valid
check digit for a card number that has one, a reserved domain for an e-mail
address, for an IPv6 address one written in full, and for a name's words
invented ones of the same script (Latin, Cyrillic, Greek), given names with the
ending of the title's or the name's gender.  The hash's key must be given.

All different entities of the table are checked for collisions: no two of a
kind (all words of names being of one) may share a surrogate, and none may be
another's original.  Those that do
are drawn again, with the number of the attempt in the hash, until none is
left; late attempts are longer than what they replace, so that short values
can't run out of surrogates.  Only the few with a second attempt are joined to the texts in which
they occur; all others are a function of the text itself.

Null and empty texts stay as they are; texts without an entity stay the same
byte for byte, and so do texts of any length around their entities; repeated rows and
equal texts are replaced alike; other columns stay, and those
with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins, scratch

#: Attempts from LONGER on add a digit each, so that a free surrogate always exists.
LONGER = 8
#: Session setting with the key of the registered queries; and what they take where none is set, which keeps nothing secret.
KEY_SETTING, PUBLIC_KEY = "spark.loomscore.pii.key", "surrogates"
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "госпожа", "Госпожа", "κυρία", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "Господин", "κύριος", "Κύριος", "κύριο", "Κύριο")
EITHER = ("Dr", "Prof")
TITLES = "|".join(sorted((*FEMALE, *MALE, *EITHER), key=len, reverse=True))
STARTS = f"[{''.join(sorted({t[0] for t in (*FEMALE, *MALE, *EITHER)}))}]"
# Common given names by gender; a rare one is found by its title or not at all.
GIVEN_FEMALE = (
    "Alexandra", "Alice", "Amanda", "Amélie", "Andrea", "Angela", "Anna", "Anne", "Barbara", "Brigitte", "Camille", "Carmen", "Carolina", "Caroline", "Catherine", "Charlotte", "Chiara", "Christina", "Claudia", "Deborah", "Diana", "Dorothy", "Elena", "Elisabeth", "Elizabeth",
    "Emily", "Emma", "Francesca", "Françoise", "Giulia", "Hannah", "Helen", "Helena", "Isabel", "Isabelle", "Jennifer", "Jessica", "Joanna", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lucía", "Margaret", "Maria", "María", "Marie", "Martha", "Michelle", "Monika",
    "Nancy", "Natalie", "Olivia", "Patricia", "Rachel", "Rebecca", "Rosa", "Sabine", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Susanne", "Teresa", "Ursula", "Valentina", "Victoria", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Екатерина", "Татьяна", "Ирина", "Μαρία", "Ελένη", "Άννα", "Αικατερίνη",
    "Aisha", "Amina", "Anjali", "Ayşe", "Fatima", "Lakshmi", "Mei", "Ngozi", "Priya", "Sakura", "Yuki",
)
GIVEN_MALE = (
    "Alberto", "Alejandro", "Alexander", "Andreas", "Andrew", "Anthony", "Antonio", "Benjamin", "Carlos", "Charles", "Christian", "Christopher", "Daniel", "David", "Diego", "Edward", "Fernando", "Francesco", "Francisco", "François", "Frank", "Friedrich", "George", "Giovanni",
    "Giuseppe", "Hans", "Heinrich", "Henri", "Henry", "Jacques", "James", "Jean", "John", "Johann", "Jorge", "José", "Joseph", "Juan", "Kevin", "Klaus", "Louis", "Luca", "Luis", "Manuel", "Marco", "Martin", "Matteo", "Matthew", "Michael", "Michel", "Miguel", "Nicolas",
    "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Roberto", "Samuel", "Stefan", "Stephen", "Steven", "Thomas", "William", "Wolfgang", "Александр", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей", "Андрей", "Владимир", "Γιώργος", "Ιωάννης", "Νίκος", "Κώστας",
    "Ahmed", "Arjun", "Deepak", "Hassan", "Hiroshi", "Kenji", "Kwame", "Mehmet", "Mohammed", "Omar", "Rahul", "Sanjay", "Takeshi", "Wei", "Xin",
)
GIVEN = "|".join(sorted((*GIVEN_FEMALE, *GIVEN_MALE), key=len, reverse=True))
# Words that make a given name beside them a place or a house: before it, and in a family name's place.
PLACE_BEFORE = ("Cape", "East", "El", "Fort", "Lake", "Las", "Los", "Mount", "Mt", "New", "North", "Port", "Saint", "Sainte", "San", "Sankt", "Santa", "South", "St", r"St\.", "West")
PLACE_AFTER = (
    "Airport", "Avenue", "Bay", "Beach", "Boulevard", "Bridge", "Building", "Canal", "Castle", "Cathedral", "Center", "Centre", "Church", "City", "Club", "College", "County", "Cup", "Falls", "Foundation", "Gardens", "Hall", "Harbor", "Harbour", "Hill", "Hills", "Hornets", "Hospital",
    "Hotel", "Island", "Islands", "Lake", "Library", "Line", "Monument", "Mountain", "Mountains", "Museum", "Opera", "Palace", "Panthers", "Park", "Peninsula", "Plaza", "Police", "Province", "Railway", "Region", "River", "Road", "School", "Sound", "Square", "Stadium", "Station", "Street",
    "Theater", "Theatre", "Tower", "University", "Valley", "Vuitton", "Zoo",
)
# Names that are common words too: replaced in a name, but not where they stand alone.
COMMON = (
    "April", "Art", "August", "Bill", "Black", "Brown", "Chase", "Dawn", "Day", "Drew", "Faith", "Frank", "Gene", "Grace", "Grant", "Gray", "Green", "Guy", "Hope", "Jack", "Joy", "June", "King", "Lane", "Long", "Love", "Major", "March", "Mark", "May", "Miles", "Pat", "Price", "Ray", "Rich", "Rob",
    "Rose", "Rush", "Short", "Sky", "Stone", "Sue", "Summer", "Violet", "Wade", "West", "White", "Will", "Winter", "Wood", "Young",
)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
#: IPv6 with "::": groups before and after it, seven at most.
SHORTENED = "|".join([*(f"(?:{GROUP}:){{{n}}}(?::{GROUP}){{1,{7 - n}}}" for n in range(1, 7)), f"(?:{GROUP}:){{1,7}}:", f":(?::{GROUP}){{1,7}}"])
#: Before and after national numbers: not within a longer number or a list of numbers.
NOT_AFTER, NOT_BEFORE = r"(?<![0-9A-Za-z+.,/-])(?<![0-9] )", r"(?![0-9]|[.,/-][0-9]| [0-9]{2}(?![0-9]))"
ASSIGNED = r"(?:password|passwd|pwd|secret|token|api_key|apikey)"
#: In order: where two begin at the same place, the first counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": rf"(?<=[=:\"']|[=:] )(?<=(?i:{ASSIGNED})[=:] ?[\"']?)(?=[_\-./+]*+[A-Za-z0-9])[A-Za-z0-9_\-./+]{{6,}}",
    "key": r"(?<![A-Z0-9])A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ipv6_short": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?=[0-9A-Fa-f]{{3,4}}:|(?:[0-9A-Fa-f]{{0,4}}:){{3}})(?:{SHORTENED})(?![0-9A-Za-z]|:[0-9A-Fa-f:]|\.[0-9])",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "hex": r"(?<![0-9A-Za-z])(?=[A-Fa-f]{0,64}[0-9])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9])",
    "phone_international": r"(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9])",
    "phone_pairs": rf"{NOT_AFTER}0[1-9](?:(?: [0-9]{{2}}){{4}}|(?:\.[0-9]{{2}}){{4}}|(?:-[0-9]{{2}}){{4}}){NOT_BEFORE}",
    "phone_run": rf"{NOT_AFTER}(?:0[1-9][0-9]{{1,4}}[ /-]|\((?:0[1-9][0-9]{{1,4}}|[2-9][0-9]{{2}})\) ?)[0-9]{{5,8}}{NOT_BEFORE}",
    "phone_spanish": rf"{NOT_AFTER}(?:[6-9][0-9]{{2}}(?: [0-9]{{2}}){{3}}|9[1-8] [0-9]{{3}}(?: [0-9]{{2}}){{2}}){NOT_BEFORE}",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9])",
    "phone_plain": r"(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])",
    "phone_local": r"(?=[0-9]{3}[ -][0-9])(?<=(?i:telephone|phone|tel|call|fax|mobile|cell|telefon|teléfono|tél|móvil|handy)[.:]? {0,2}(?:at |no\.? )?)[0-9]{3}[ -][0-9]{4}(?![0-9-])",
    "name": rf"(?={STARTS})(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'-]{{1,40}})?",
    "person": rf"(?=\p{{Lu}})(?<![\p{{L}}])(?<!(?<![\p{{L}}])(?:{'|'.join(PLACE_BEFORE)}) )(?:{GIVEN}) (?:\p{{Lu}}\. )?(?!(?:{'|'.join(PLACE_AFTER)})(?![\p{{L}}]))\p{{Lu}}[\p{{L}}'-]{{1,40}}",
}
#: No entity starts at a lower-case letter within a word, which keeps most places in a text from being tried further.
ANY = "(?:(?<![a-z])|(?=[0-9A-Z+(:]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Every entity has one of these.
HINT = rf"[0-9@=:]|(?=[\p{{Lu}}{STARTS[1:]})(?:A[KS]IA|(?:{TITLES})\.? \p{{Lu}}|(?:{GIVEN}) \p{{Lu}})"

CARD = r"^(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})$"
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζκλμνπρστφ", "αειου")}
ENDINGS = {
    "latin": {"f": "na", "m": "rik", "n": "ren", "family": "sen"}, "cyrillic": {"f": "на", "m": "рий", "n": "лин", "family": "ко"}, "greek": {"f": "να", "m": "ριος", "n": "λις", "family": "δης"},
}


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting names."""
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def kind_of(v: Column) -> Column:
    """Of a match, null if it is to stay; the tests are on the match alone, in an order in which none is taken for another."""
    return (
        F.when(v.contains("@"), "email")
        .when(v.rlike(rf"^(?:{TITLES})\.? \p{{Lu}}"), "name")
        .when(v.rlike(rf"^(?:{GIVEN}) \p{{Lu}}"), "person")
        .when(v.rlike(r"^A(?:KIA|SIA)[0-9A-Z]{16}$"), "key")
        .when(v.rlike(r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}$"), "ipv6")
        .when(v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ipv4")
        .when(v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{12,}$"), "iban")
        .when(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(v.rlike(CARD), F.when(luhn_valid(F.regexp_replace(v, "[^0-9]", "")), "card"))
        .when(v.rlike(r"^(?:\+?[0-9(][0-9() .-]{6,}|0[0-9]{2,5}/[0-9]{5,8})$"), "phone")
        .when(v.rlike(r"^[0-9A-Fa-f]{32,128}$"), "hex")
        .otherwise("secret")
    )


# -- parts: (kind, canonical form) of a match --------------------------------


def part(kind: Column | str, canon: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"))


def name_words(v: Column, kind: Column) -> Column:
    """The words of a name as written, without title and initials."""
    words = F.split(v, " ")
    return F.when(kind == "name", F.slice(words, 2, 2)).otherwise(F.array(F.element_at(words, 1), F.element_at(words, -1)))


def name_parts(v: Column, kind: Column) -> Column:
    first = F.regexp_replace(F.substring_index(v, " ", 1), r"\.$", "")
    gender = F.when(first.isin(*FEMALE, *GIVEN_FEMALE), "f").when(first.isin(*MALE, *GIVEN_MALE), "m").otherwise("n")
    words = name_words(v, kind)
    return F.transform(words, lambda w, i: part(F.when(i + 1 == F.size(words), "name:family").otherwise(F.concat(F.lit("name:"), gender)), F.lower(w)))


def full_address(v: Column) -> Column:
    """An IPv6 address as eight groups of four digits."""

    def groups(x: Column) -> Column:
        return F.filter(F.split(x, ":"), lambda g: g != "")

    before, after = groups(F.substring_index(v, "::", 1)), groups(F.substring_index(v, "::", -1))
    all_groups = F.when(F.contains(v, F.lit("::")), F.concat(before, F.array_repeat(F.lit("0"), 8 - F.size(before) - F.size(after)), after)).otherwise(groups(v))
    return F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), ":")


def tagged(found: Column | str) -> Column:
    """(v, kind) of each match."""
    return F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))


def parts(match: Column) -> Column:
    v, kind = match.getField("v"), match.getField("kind")
    canon = F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(v, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(v, " ", "")).when(kind == "email", F.lower(v)).when(kind == "ipv6", full_address(F.lower(v))).otherwise(v)
    return F.when(kind.isin("name", "person"), name_parts(v, kind)).when(kind.isNull(), F.array().cast("array<struct<kind:string,canon:string>>")).otherwise(F.array(part(kind, canon)))


# -- surrogates of canonical forms -------------------------------------------


def pick(letters: str, at: Column) -> Column:
    return F.lit(letters).substr(F.pmod(at, F.lit(len(letters))) + 1, F.lit(1))


def drawn(key: str, *of: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *of), 512)


class Draw:
    """Bytes of a hash that ``drawn`` made of an entity and the attempt."""

    def __init__(self, hex_digits: Column):
        self.hex = hex_digits

    def at(self, i: Column | int) -> Column:
        i = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)).cast("int")
        return F.conv(self.hex.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def same_classes(v: Column, draw: Draw, keep: int | Column = 0) -> Column:
    """Each letter or digit after the first ``keep`` drawn anew from its class."""
    keep = F.lit(keep) if isinstance(keep, int) else keep

    def one(i: Column) -> Column:
        c, b = v.substr(i, F.lit(1)), draw.at(i)
        new = F.when(c.rlike("[0-9]"), pick(DIGITS, b)).when(c.rlike("[a-z]"), pick(LOWER, b)).when(c.rlike("[A-Z]"), pick(UPPER, b)).otherwise(c)
        return F.when(i <= keep, c).otherwise(new)

    return F.when(F.length(v) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), one), "")).otherwise("")


def hex_digits(v: Column, draw: Draw) -> Column:
    lower = F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.when(v.substr(i, F.lit(1)).rlike("[0-9A-Fa-f]"), pick(HEX, draw.at(i) + F.floor(i / 64).cast("int"))).otherwise(v.substr(i, F.lit(1)))), "")
    return F.when(v == F.upper(v), F.upper(lower)).otherwise(lower)


def luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` with it a valid card number."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10, F.lit(10)).cast("string")


def luhn_valid(digits: Column) -> Column:
    return luhn_digit(digits.substr(F.lit(1), F.length(digits) - 1)) == digits.substr(F.length(digits), F.lit(1))


def iban_checked(s: Column) -> Column:
    """``s`` with the check digits of its country and account: 98 less the number modulo 97, letters counting from 10."""
    turned = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(2)), F.lit("00"))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    check = 98 - F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)
    return F.concat(s.substr(F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), s.substr(F.lit(5), F.length(s)))


def invented(kind: Column, canon: Column, attempt: Column, draw: Draw) -> Column:
    """A word for a name, one syllable longer with each attempt."""

    def word(script: str) -> Column:
        consonants, vowels = SOUNDS[script]
        ends = ENDINGS[script]
        body = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: F.concat(pick(consonants, draw.at(2 * i)), pick(vowels, draw.at(2 * i + 1)))), "")
        end = F.when(kind == "name:f", ends["f"]).when(kind == "name:m", ends["m"]).when(kind == "name:n", ends["n"]).otherwise(ends["family"])
        return F.concat(body, end)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), word("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), word("greek")).otherwise(word("latin"))


def surrogates(entities: Column, key: str) -> Column:
    """Of an array of (kind, canon, attempt).  Hashes are taken once an entity, before its letters are drawn."""
    hashed = F.transform(entities, lambda e: F.struct(e["kind"].alias("kind"), e["canon"].alias("canon"), e["attempt"].alias("attempt"), drawn(key, e["kind"], e["canon"], e["attempt"].cast("string")).alias("hex")))
    return F.transform(hashed, lambda e: surrogate(e["kind"], e["canon"], e["attempt"], e["hex"], key))


def of_entity(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    return F.element_at(surrogates(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"))), key), 1)


def surrogate(kind: Column, canon: Column, attempt: Column, hashed: Column, key: str) -> Column:
    draw = Draw(hashed)
    domain = F.substring_index(canon, "@", -1)
    email = F.concat(same_classes(F.substring_index(canon, "@", 1), draw), F.lit("@"), F.lit("h"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain, attempt.cast("string")), 256), 1, 10), F.lit(".example"))
    octets = F.concat_ws(".", *((draw.at(k) % 254 + 1).cast("string") for k in range(4)))
    digits = same_classes(canon, draw, 1)
    front = digits.substr(F.lit(1), F.length(digits) - 1)
    same_form = (
        F.when(kind == "email", email)
        .when(kind == "ipv4", octets)
        .when(kind.isin("hex", "ipv6"), hex_digits(canon, draw))
        .when(kind == "key", same_classes(canon, draw, 4))
        .when(kind == "iban", iban_checked(same_classes(canon, draw, 2)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(same_classes(canon, draw), 2, 8)))
        .when(kind == "card", F.concat(front, luhn_digit(front)))
        .when(kind == "phone", digits)
        .when(kind.startswith("name:"), invented(kind, canon, attempt, draw))
        .otherwise(same_classes(canon, draw))
    )
    more = F.translate(hashed.substr(F.lit(1), attempt - LONGER + 1), "abcdef", "012345")
    # new domains and words of names differ without end as they are
    return F.when((attempt >= LONGER) & (kind != "email") & ~kind.startswith("name:"), F.concat(same_form, more)).otherwise(same_form)


def laid_out(v: Column, s: Column) -> Column:
    """The letters and digits of ``s`` in the places of those of ``v``, and what is left of them at the end."""

    def one(i: Column) -> Column:
        c = v.substr(i, F.lit(1))
        before = F.length(F.regexp_replace(v.substr(F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), s.substr(before, F.lit(1))).otherwise(c)

    places = F.length(F.regexp_replace(v, "[^0-9A-Za-z]", ""))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), one), ""), s.substr(places + 1, F.length(s)))


def cased(v: Column, s: Column) -> Column:
    return F.when((v == F.upper(v)) & (F.length(v) > 1), F.upper(s)).otherwise(s)


def capitalised(w: Column, s: Column) -> Column:
    """``s`` in the case of the name ``w``."""
    return F.when(w == F.upper(w), F.upper(s)).otherwise(F.concat(F.upper(s.substr(F.lit(1), F.lit(1))), s.substr(F.lit(2), F.lit(60))))


def with_surrogates(found: Column, attempts: Column | None, key: str) -> Column:
    """(v, kind, new) of each match, ``new`` the surrogates of its parts; ``attempts``: kind and canonical form to attempt, where it isn't 0."""

    def tried(p: Column) -> Column:
        kind, canon = p.getField("kind"), p.getField("canon")
        attempt = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat_ws("|", kind, canon)), F.lit(0))
        return F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"))

    return F.transform(found, lambda m: F.struct(m["v"].alias("v"), m["kind"].alias("kind"), surrogates(F.transform(parts(m), tried), key).alias("new")))


def written(m: Column) -> Column:
    """What stands for a match."""
    v, kind, new = m["v"], m["kind"], m["new"]
    words, one = F.split(v, " "), F.element_at(new, 1)
    named = F.zip_with(name_words(v, kind), new, capitalised)
    initial = F.when(F.size(words) == 3, F.concat(F.upper(F.element_at(new, -1).substr(F.lit(2), F.lit(1))), F.lit(".")))
    return (
        F.when(kind == "name", F.concat_ws(" ", F.element_at(words, 1), named))
        .when(kind == "person", F.concat_ws(" ", F.element_at(named, 1), initial, F.element_at(named, 2)))
        .when(kind.isin("card", "phone", "ssn", "iban"), laid_out(v, one))
        .when(kind.isin("email", "ipv6"), cased(v, one))
        .when(kind.isNull(), v)
        .otherwise(one)
    )


def named_elsewhere(found: Column) -> Column:
    """(pattern, new) for each word of the persons named in a text, from ``with_surrogates``; the longest words first."""
    persons = F.filter(found, lambda m: m["kind"].isin("name", "person"))
    pairs = F.flatten(F.transform(persons, lambda m: F.zip_with(name_words(m["v"], m["kind"]), m["new"], lambda w, s: F.struct(F.length(w).alias("n"), w.alias("w"), s.alias("s")))))
    forms = F.flatten(F.transform(pairs, lambda p: F.array(F.struct((-p["n"]).alias("n"), p["w"].alias("w"), capitalised(p["w"], p["s"]).alias("s")), F.struct((-p["n"]).alias("n"), F.upper(p["w"]).alias("w"), F.upper(p["s"]).alias("s")))))
    common = [*COMMON, *map(str.upper, COMMON)]
    return F.array_sort(F.array_distinct(F.filter(forms, lambda p: (p["n"] < -1) & ~p["w"].isin(*common))))


def renamed(piece: Column, names: Column) -> Column:
    """Text between matches with the words of ``named_elsewhere`` replaced."""
    return F.aggregate(names, piece, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), p["w"], F.lit(r"\E(?![\p{L}\p{N}])")), p["s"]))


# -- tables ------------------------------------------------------------------


def matches(text: str) -> Column:
    """All entities of a text, as written, in order, with their kinds; null if there is no hint of any."""
    return tagged(F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))


def second_attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of those entities whose first surrogate collides with another's surrogate or original."""
    sort = F.substring_index("kind", ":", 1).alias("sort")  # words of names are of one sort
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be folded into one task
    held = scratch.written(entities.repartition(tasks, "kind", "canon").withColumn("attempt", F.lit(0)).withColumn("s", of_entity(F.col("kind"), F.col("canon"), F.lit(0), key)))
    originals = entities.select(sort, F.col("canon").alias("s")).distinct().withColumn("taken", F.lit(True))
    while True:
        order = W.partitionBy("sort", "s").orderBy("attempt", "kind", "canon")
        marked = held.select("*", sort).withColumn("n", F.row_number().over(order)).join(originals, ["sort", "s"], "left")
        marked = scratch.written(marked.select("kind", "canon", "attempt", "s", ((F.col("n") > 1) | F.coalesce("taken", F.lit(False))).alias("again")))
        if marked.filter("again").isEmpty():
            return held.filter("attempt > 0").select("kind", "canon", "attempt")
        attempt = F.col("attempt") + F.col("again").cast("int")
        held = scratch.written(marked.select("kind", "canon", attempt.alias("attempt"), F.when(F.col("again"), of_entity(F.col("kind"), F.col("canon"), attempt, key)).otherwise(F.col("s")).alias("s")))


def replace(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the entities of ``text`` replaced, and n_pii and pii_kinds (different kinds, sorted, joined by commas).

    n_pii counts what the patterns find, not further mentions of a name.
    """
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in df.columns if c not in ("n_pii", "pii_kinds")]
    hinted = df.filter(F.col(text).rlike(HINT)).select(text)
    # explode_outer: no filter on its input is inferred, which would look for the matches a second time
    each = hinted.select(F.col(text), F.explode_outer(F.flatten(F.transform(matches(text), parts))).alias("p"))
    entities = each.select("p.kind", "p.canon").filter("kind IS NOT NULL").distinct()
    again = second_attempts(scratch.written(entities), key)
    rows, attempts = df.select(*keep).withColumn("__m", matches(text)), None
    if not again.isEmpty():
        of_text = each.select(F.xxhash64(text).alias("__h"), "p.kind", "p.canon").join(joins.sized(again), ["kind", "canon"]).distinct()
        of_text = of_text.groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__a"))
        rows = rows.withColumn("__h", F.when(F.size("__m") > 0, F.xxhash64(text))).join(joins.sized(scratch.written(of_text)), "__h", "left")
        attempts = F.col("__a")
    hit = F.size("__m") > 0
    rows = rows.withColumn("__n", F.when(hit, with_surrogates(F.col("__m"), attempts, key))).withColumn("__p", F.when(hit, named_elsewhere(F.col("__n"))))
    between = F.split(F.col(text), ANY, -1)
    between = F.when(F.size("__p") > 0, F.transform(between, lambda x: renamed(x, F.col("__p")))).otherwise(between)
    new = F.array_join(F.zip_with(between, F.transform("__n", written), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    shown = F.transform(F.filter("__m", lambda m: m.getField("kind").isNotNull()), lambda m: F.when(m.getField("kind") == "person", "name").otherwise(m.getField("kind")))
    return rows.select(
        *(F.when(hit, new).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in keep),
        F.when(hit, F.size(shown)).otherwise(0).cast("long").alias("n_pii"),
        F.when(hit, F.array_join(F.array_sort(F.array_distinct(shown)), ",")).otherwise("").alias("pii_kinds"),
    )
