"""PII surrogates, in DataFrame operations only.

Entities are e-mail addresses, IP addresses of both kinds, phone, card, social-security
and account (IBAN) numbers, secrets, and persons' names. A name is found by a title, by a
known given name, by words that announce one ("my name is", "Dear"), by a verb of saying
or living beside two capitalised words, or by standing right before a mail address. In a
text where it was found, each of its words is an entity wherever it stands alone, unless
it is an ordinary word there: one that the text also has in lower case, one that is
capitalised as a month, a day or a German noun, or an English word that may begin a
sentence, where it does. Each distinct entity of the table gets one surrogate, made
from a keyed digest (HMAC-SHA-256) of its type and normal form, so that every mention,
however written and whatever the title, gets the same one. Surrogates keep type and
format: length, case, separators, character classes, a phone's country code, an account's
country with check digits that are right, a card's first digit with a check digit that is
right (a number whose check digit is wrong is none and stays), a mail address's top
domain; an IP address stays one, of any length; names keep title, hyphens, particles,
script and case. A given name's gender is that of its titles and of the lists of given
names over the whole table, none where these disagree; it chooses the form of the
surrogate, not the surrogate. A Cyrillic surname keeps the gender of its ending.

Collision checks: a surrogate must not be an entity of the table, nor that of
another entity of its type. Entities for which it is are given the next attempt's
surrogate, round by round, until none is left; as a format may have fewer strings than
entities, every ``GROW`` attempts make surrogates one character longer. Texts are
searched once and written with their mentions; only rows with mentions are joined with
the later attempts, at every size by the same plan.

Defined results: null text stays null; empty text stays empty; other columns are
kept, whatever their names; rows without doc_id, ties and repeated rows are like any
other, as no column but the text is read; very long texts are searched whole, by
patterns that match in linear time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bound, free_name, table

#: Setting that holds the secret key, and the key of tests and examples, where it is unset.
KEY_SETTING, EXAMPLE_KEY = "spark.quern.surrogate.key", "example-key"
#: Attempts after which surrogates grow by a character.
GROW = 4

# Titles by gender, given names by gender and script, syllables of made-up names.
TITLES_F = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Sra Госпожа".split()
TITLES_M = "Mr Herr Monsieur Señor Sr Господин".split()
TITLES_ANY = "Dr Prof Professor Doctor Sir Judge Captain Pastor".split()
GIVEN_F = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Emma Sophie Julia Laura Marie Claire Camille Carmen Lucía Sofía Katharina Ursula Olivia Alice Emily Grace Fatima Aisha Priya Ananya Mei Yuki Ingrid Chiara Giulia Zeynep Анна Мария Елена Ольга Наталья Ирина".split()
GIVEN_M = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Peter Paul Hans Klaus Jürgen Wolfgang Pierre Jean François Louis Carlos Juan José Miguel Antonio Henry George Edward Mohammed Ahmed Omar Wei Hiroshi Kenji Raj Arjun Sven Lars Giovanni Marco Mehmet Иван Сергей Алексей Дмитрий Николай Андрей".split()
#: Small words inside names, words that announce a name.
PARTICLES = "von van der den de del della di da la le bin ibn al".split()
ANNOUNCED = ["my name is", "name is", "name:", "contact person", "contact:", "signed by", "written by", "yours sincerely,", "sincerely,", "kind regards,", "regards,", "attn:", "mein name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es"]
#: Words that come before or behind a person, and words that begin a sentence before such a one.
ADDRESSED = "Dear Hi Hello Liebe Lieber Chère Cher Estimada Estimado Querida Querido said says asked replied wrote added".split()
VERBS = "said says wrote writes called calls replied asked asks told lives lived works worked signed added".split()
OPENERS = "The A An In On At By For From To And But Or Then Later Yesterday Today Tomorrow When While After Before Now Once Here There This That These Those My Your His Her Our Their It He She They We You I As If So Also Only Even Not No Yes Meanwhile However Finally Mister Der Die Das Ein Eine Und Aber Dann Gestern Heute Le La Les Un Une Et Mais Puis Hier El Los Las Una Y Pero Luego Ayer Hoy".split()
#: Words that are capitalised though no name, and English words that are names too.
CAPITALISED = "January March April May June July August Sunday Monday Christmas Easter Stein Berg Wolf König Kaiser Richter Koch Schneider Fischer Weber Müller Wagner Bauer Zimmermann Krieger Vogel Fuchs Busch Baum Winter Sommer Herbst Mai Juni".split()
ORDINARY = "Will Mark Bill Frank Grant Rich Art Jack Drew Chase Hunter Mason Miles Dale Glen Cliff Pat Sue Rob Gene Ray Dawn Eve Ivy Iris Lily Daisy Violet Pearl Ruby Amber Jade Rose Grace Faith Hope Joy Love Day King Bishop Hill Wood Woods Stone Rivers Field Fields Baker Cook Page Price Rice Bush Banks Green Brown White Black Gray Young Long Short Summer Autumn Major Carter Fisher Gardener Marsh Lane Street Park Parks Church Bell Ball Brook Brooks Rock Rush Sharp Small Little Noble Savage Swift Wise".split()
LATIN = "ba be bo da de di do fa fe fi ga ge ka ke ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo za".split()
CYRILLIC = "ба бе бо ва ве ви во га ге да де ди до за ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то".split()



def _any_case(words: list[str]) -> str:
    """A pattern of words as they are and in capitals."""
    return "|".join(dict.fromkeys([*words, *(w.upper() for w in words)]))


_TITLE = f"(?:{_any_case(TITLES_F + TITLES_M + TITLES_ANY)})" + r"\b\.?"
_GIVEN = f"(?:{_any_case(GIVEN_F + GIVEN_M)})"
_CAPITAL = r"\p{Lu}[\p{L}'’]{1,40}(?:-\p{Lu}[\p{L}'’]{1,40}){0,2}"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
_REST = rf"(?: \p{{Lu}}\.)?(?: {_PARTICLE}){{0,2}} {_CAPITAL}"
_CUE = "(?:(?i:" + "|".join(ANNOUNCED) + r")|(?<![\p{L}])(?:" + "|".join(ADDRESSED) + "))"
_VERB = r"(?:" + "|".join(VERBS) + r")(?![\p{L}])"
_NO_OPENER = r"(?<!(?<![\p{L}])(?:[Tt]he|[Aa]n?|[Dd]er|[Dd]ie|[Dd]as|[Ll][ae]|[Ee]l) )(?!(?:" + "|".join(OPENERS) + r")(?![\p{L}]))"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around a double colon and a digit somewhere, as in no word.
_V6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{7}}{_H}|(?=[A-Fa-f:]{{0,39}}[0-9])(?:{_H}(?::{_H}){{0,5}}::(?:{_H}(?::{_H}){{0,5}})?|::{_H}(?::{_H}){{1,6}}))(?![\p{{L}}\p{{N}}:])"
#: Types and patterns, in order of precedence. Runs are possessive and begin at a border, so that matching stays linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)++\p{L}{2,24}",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_+/=-]{8,}+",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?:(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|{_V6})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[2-6][0-9]{3}(?:[ -][0-9]{4}){3}|[2-6][0-9]{3}[ -][0-9]{6}[ -][0-9]{5}|[2-6][0-9]{12,18})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|(?<![0-9+])\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![0-9.,+/-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}-])(?:{_TITLE} {_CAPITAL}(?:{_REST})?|(?:\p{{Lu}}[\p{{L}}]{{1,40}}-)?{_GIVEN}(?:-\p{{Lu}}[\p{{L}}]{{1,40}})?{_REST}|(?=\p{{Lu}})(?:(?<={_CUE} ){_CAPITAL}(?:{_REST})?|{_NO_OPENER}{_CAPITAL}{_REST}(?= {_VERB})|{_CAPITAL}{_REST}(?=,? [(<]?[\p{{L}}\p{{N}}._%+-]{{1,64}}+@)))(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(PATTERNS.values())
#: What a text of each type holds; a text with none of it has no entity.
HINTS = {
    "digit or address": "[0-9@]",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)",
    "hex": "[a-f]{32}|[A-F]{32}",
    "name": rf"\b(?:{_TITLE}|{_GIVEN})[ -]|{_CUE} \p{{Lu}}|\p{{Lu}}[\p{{L}}'’-]++ {_VERB}",
}
HINT = "|".join(HINTS.values())


def _keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 as hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _hex(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return _keyed(key, F.concat_ws("|", kind, norm, attempt.cast("string")))


def _number(digest: Column, i: Column, digits: int = 3) -> Column:
    """A number from the digest's i-th place (0-based, going round)."""
    start = (i * F.lit(2)) % F.lit(63 - digits) + F.lit(1)
    return F.conv(F.substr(digest, start, F.lit(digits)), 16, 10).cast("int")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _like(x: Column, digest: Column, letters: int = 26) -> Column:
    """A string of the same length and character classes."""

    def one(c: Column, i: Column) -> Column:
        d = _number(digest, i)
        lower, upper = F.char(d % letters + 97), F.char(d % letters + 65)
        other = F.when(F.rlike(c, F.lit(r"\p{Lu}")), upper).when(F.rlike(c, F.lit(r"\p{L}")), lower).when(F.rlike(c, F.lit(r"\p{N}")), F.char(d % 10 + 48)).otherwise(c)
        return F.when(c.between("0", "9"), F.char(d % 10 + 48)).when(c.between("a", "z"), lower).when(c.between("A", "Z"), upper).when(c.between("!", "~"), c).otherwise(other)

    return F.array_join(F.transform(_chars(x), one), "")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _laid_out(x: Column, digits: Column, skip: Column) -> Column:
    """``x`` with its digits after the first ``skip`` replaced by those of ``digits`` in turn."""

    def one(c: Column, i: Column) -> Column:
        k = F.length(_digits(F.substr(x, F.lit(1), i + 1)))
        return F.when(c.between("0", "9") & (k > skip), F.substr(digits, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(x), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, the last digit counted once, modulo 10."""

    def one(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when((F.length(digits) - 1 - i) % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(_chars(digits), one), F.lit(0), lambda s, v: s + v) % 10


def _card(norm: Column, digest: Column) -> Column:
    """The first digit, others, and the check digit that is right."""
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(_like(norm, digest), F.lit(2), F.length(norm) - 2))
    return F.concat(body, ((F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))


def _syllables(digest: Column, n: Column, which: list[str]) -> Column:
    held = F.array(*map(F.lit, which))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(held, _number(digest, i * 2) % len(which) + 1)), "")


def _is_cyrillic(x: Column) -> Column:
    return F.rlike(x, F.lit(r"\p{IsCyrillic}"))


def _iban(norm: Column, digest: Column) -> Column:
    """The country, check digits that are right, and an account of the same classes."""
    country, account = F.substr(norm, F.lit(1), F.lit(2)), _like(F.substr(norm, F.lit(5)), digest)
    values = F.transform(_chars(F.concat(account, country, F.lit("00"))), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)


def normal(kind: Column, x: Column) -> Column:
    """The form in which mentions of one entity agree."""
    return (
        F.when(kind == "email", F.lower(x))
        .when(kind.isin("card", "phone", "ssn"), _digits(x))
        .when(kind == "iban", F.regexp_replace(x, " ", ""))
        .when(kind.isin("surname", "given") | ((kind == "ip") & F.contains(x, F.lit(":"))), F.lower(x))
        .otherwise(x)
    )


def surrogate(kind: Column, norm: Column, attempt: Column, key: str = EXAMPLE_KEY) -> Column:
    """The surrogate of a normal form; given names of a gender are of the kind ``given_f`` or ``given_m``. Digests are bound, as they are read for every character."""
    host = F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1)
    digests = F.struct(_hex(key, F.regexp_replace(kind, "_[fm]$", ""), norm, attempt).alias("own"), F.when(kind == "email", _hex(key, F.lit("host"), host, F.lit(0))).alias("host"))
    return bound(digests, lambda h: _surrogate(kind, norm, attempt, h.own, host, h.host))


def _surrogate(kind: Column, norm: Column, attempt: Column, h: Column, host: Column, of_host: Column) -> Column:
    more = F.floor(attempt / GROW).cast("int")
    grown = lambda x: F.concat(x, F.repeat(F.right(x, F.lit(1)), more))
    local = F.regexp_extract(norm, "^(.*)@", 1)

    def named(shared: int, ends: tuple[str, str]) -> Column:
        return F.when(_is_cyrillic(norm), F.concat(_syllables(h, F.lit(shared) + more, CYRILLIC), F.lit(ends[1]))).otherwise(F.concat(_syllables(h, F.lit(shared) + more, LATIN), F.lit(ends[0])))

    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: (_number(h, i) % 254 + 1).cast("string")), ".")
    return (
        F.when(kind == "email", F.concat(_like(F.concat(local, F.repeat(F.lit("a"), more)), h), F.lit("@"), _like(host, of_host), F.regexp_extract(norm, r"(\.[^.]*)$", 1)))
        .when(kind.isin("secret", "hex"), F.when(F.rlike(norm, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), _like(grown(norm), h, 6)).otherwise(_like(grown(norm), h)))
        .when((kind == "ip") & F.contains(norm, F.lit(":")), F.concat(_like(norm, h, 6), F.when(more > 0, F.concat(F.lit(":"), F.lower(F.hex(attempt)))).otherwise("")))
        .when(kind == "ip", F.when(more < 16, octets).otherwise(F.concat(octets, F.lit(":"), F.lpad((_number(h, F.lit(9)) + attempt).cast("string"), 4, "0"))))
        .when(kind == "iban", _iban(grown(norm), h))
        .when(kind == "card", _card(grown(norm), h))
        .when(kind.isin("phone", "ssn", "initial"), _like(grown(norm), h))
        .when(kind == "given_f", named(2, ("na", "на")))
        .when(kind == "given_m", named(2, ("n", "н")))
        .when(kind == "given", named(2, ("l", "л")))
        .when(_is_cyrillic(norm) & F.rlike(norm, F.lit("(?:а|ая)$")), named(3, ("r", "рова")))
        .otherwise(named(3, ("r", "ров")))
    )


def _kind(x: Column) -> Column:
    """The type of a mention; ``none`` for a number like a card's whose check digit is wrong."""
    is_a = lambda kind: F.rlike(x, F.lit(f"^(?:{PATTERNS[kind]})$"))
    out = F.when(F.contains(x, F.lit("@")), "email")
    for kind in ("secret", "hex", "iban", "ip", "ssn"):
        out = out.when(is_a(kind), kind)
    return out.when(is_a("card"), F.when(_luhn(_digits(x)) == 0, "card").otherwise("none")).when(is_a("phone"), "phone").otherwise("name")


_SECRET_HEAD = r"^(.*?[:=]\s{0,3}[\"']?)(.*)$"


def words(name: Column) -> Column:
    """(word, kind, gender) of a name behind its title: given names, then the surname; particles are ``keep``, single letters ``initial``. The gender, f, m or empty, is that of the title or of a listed given name."""
    title = F.regexp_extract(name, rf"^({_TITLE} )", 1)

    def split(n: Column) -> Column:
        first = F.split(F.substr(n.x, F.length(n.title) + 1), " ")
        title_word = F.lower(F.regexp_replace(n.title, r"\.? $", ""))
        given = F.when(F.size(first) > 1, F.get(first, F.lit(0)))
        alone = F.lower(F.coalesce(given, F.lit("")))
        low = lambda listed: [w.lower() for w in listed]
        has = lambda listed: F.exists(F.split(alone, "-"), lambda w: w.isin(low(listed)))
        gender = F.when(title_word.isin(low(TITLES_F)) | has(GIVEN_F), "f").when(title_word.isin(low(TITLES_M)) | has(GIVEN_M), "m").otherwise("")
        return F.struct(first.alias("parts"), gender.alias("gender"))

    def roles(n: Column) -> Column:
        def of(w: Column, i: Column) -> Column:
            kind = F.when(i == F.size(n.parts) - 1, "surname").when(w.isin(PARTICLES), "keep").when(F.rlike(w, F.lit(r"^.\.?$")), "initial").otherwise("given")
            gender = F.when(kind == "given", n.gender).otherwise("")
            return F.transform(F.split(w, "-"), lambda v: F.struct(v.alias("word"), kind.alias("kind"), gender.alias("gender")))

        return F.flatten(F.transform(n.parts, of))

    return bound(bound(F.struct(name.alias("x"), title.alias("title")), split), roles)


def names_in(found: Column) -> Column:
    """The distinct (word, kind, gender) of the names among mentions, without particles and initials."""
    named = F.filter(found, lambda x: _kind(x) == "name")
    return F.array_distinct(F.filter(F.flatten(F.transform(named, words)), lambda w: ~w.kind.isin("keep", "initial")))


def telling(names: Column, text: Column) -> Column:
    """Those of the names whose words, alone, are no ordinary words of the text: neither capitalised anyway nor there in lower case."""
    spelt = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}'’._%+@-])"), F.lower(n.word), F.lit(r"(?![\p{L}\p{N}_%+@-]|\.[\p{L}\p{N}])"))
    return F.filter(names, lambda n: ~n.word.isin(CAPITALISED) & ((F.lower(n.word) == n.word) | ~F.rlike(text, spelt(n))))


#: Where no sentence begins.
_INSIDE = r"(?<!\A)(?<![.!?…:\n][\s]{0,3})(?<![\n][\s\p{P}]{0,3})"


def with_bare(names: Column) -> Column:
    """The pattern of a text in which these names were found: their words, alone, are mentions too."""
    longer = lambda a, b: F.length(b) - F.length(a)
    some = lambda ordinary: F.array_join(F.array_sort(F.transform(F.filter(names, lambda n: n.word.isin(ORDINARY) == ordinary), lambda n: n.word), longer), "|")
    alone = lambda head, pick: F.when(F.length(pick) > 0, F.concat(F.lit(rf"|(?<![\p{{L}}\p{{N}}-]){head}(?:"), pick, F.lit(r")(?![\p{L}\p{N}])"))).otherwise("")
    return F.when(F.size(names) > 0, F.concat(F.lit(PATTERN), alone("", some(False)), alone(_INSIDE, some(True)))).otherwise(F.lit(PATTERN))


def parsed(found: Column, names: Column) -> Column:
    """Mentions as structs: the mention ``x``, its ``kind``, and ``keys``, its types and normal forms.

    Each step binds what the next ones read more than once.
    """
    kinds = F.transform(found, lambda x: F.struct(x.alias("x"), F.filter(names, lambda n: n.word == x).alias("bare")))
    kinds = F.transform(kinds, lambda m: F.struct(m.x.alias("x"), m.bare.alias("bare"), F.when(F.size(m.bare) > 0, "name").otherwise(_kind(m.x)).alias("kind")))

    def keyed(m: Column) -> Column:
        value = F.when(m.kind == "secret", F.regexp_extract(m.x, _SECRET_HEAD, 2)).otherwise(m.x)
        one = F.array(F.struct(value.alias("word"), m.kind.alias("kind"), F.lit("").alias("gender")))
        parts = F.when(m.kind == "none", F.slice(one, 1, 0)).when(m.kind != "name", one).when(F.size(m.bare) > 0, F.slice(m.bare, 1, 1)).otherwise(words(m.x))
        return F.struct(m.x.alias("x"), m.kind.alias("kind"), F.transform(parts, lambda k: F.struct(k.kind.alias("kind"), normal(k.kind, k.word).alias("norm"), k.word.alias("word"), k.gender.alias("gender"))).alias("keys"))

    return F.transform(kinds, keyed)


def _cased(new: Column, old: Column) -> Column:
    return F.when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))


def rewritten(found: Column, later: Column, key: str) -> Column:
    """Parsed mentions as strings with their surrogates. ``later``: attempt and form by ``kind|norm`` where they are not 0 and empty; null for none."""

    def make(k: Column) -> Column:
        said = F.try_element_at(later, F.concat_ws("|", k.kind, k.norm))
        attempt, form = F.coalesce(said["attempt"], F.lit(0)), F.coalesce(said["form"], F.lit(""))
        new = F.when(k.kind == "keep", k.word).otherwise(surrogate(F.concat(k.kind, form), k.norm, attempt, key))
        return F.struct(new.alias("new"), k.word.alias("word"), k.kind.alias("kind"))

    made = F.transform(found, lambda m: F.struct(m.x.alias("x"), m.kind.alias("kind"), F.transform(m["keys"], make).alias("made")))

    def lay(m: Column) -> Column:
        x, kind, new = m.x, m.kind, F.get(m.made, F.lit(0))["new"]
        title = F.regexp_extract(x, rf"^({_TITLE} )", 1)
        borders = F.regexp_extract_all(F.substr(x, F.length(title) + 1), F.lit("[ -]"), 0)
        laid = F.zip_with(m.made, borders, lambda w, b: F.concat(F.when(w.kind == "keep", w["new"]).otherwise(_cased(w["new"], w.word)), F.coalesce(b, F.lit(""))))
        apart = F.length(F.regexp_extract(x, r"^\+([0-9]{1,3})[ .(-]", 1))
        country = F.when((kind != "phone") | ~F.startswith(x, F.lit("+")), 0).when(apart > 0, apart).otherwise(F.when(F.rlike(x, F.lit(r"^\+[17]")), 1).otherwise(2))
        grouped = F.array_join(F.regexp_extract_all(new, F.lit("(.{1,4})"), 1), " ")
        return (
            F.when(kind == "none", x)
            .when(kind == "name", F.concat(title, F.array_join(laid, "")))
            .when(kind == "secret", F.concat(F.regexp_extract(x, _SECRET_HEAD, 1), new))
            .when(kind.isin("card", "ssn", "phone"), _laid_out(x, new, country))
            .when((kind == "iban") & F.contains(x, F.lit(" ")), grouped)
            .when((kind == "email") | ((kind == "ip") & F.contains(x, F.lit(":"))), _with_case(x, new))
            .otherwise(new)
        )

    return F.transform(made, lay)


def _with_case(x: Column, new: Column) -> Column:
    old = _chars(x)
    return F.when(F.lower(x) == x, new).otherwise(F.array_join(F.zip_with(old, _chars(new), lambda o, n: F.when(F.rlike(o, F.lit(r"\p{Lu}")), F.upper(n)).otherwise(n)), ""))


def mentions(text: Column) -> Column:
    """The text's mentions in order, but for bare names; none for a text that fails the cheap test."""
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def resolve(entities: DataFrame, scratch: Scratch, make=surrogate) -> DataFrame:
    """Attempts above 0 that give distinct entities (kind, norm) distinct surrogates, none of them an entity.

    ``make`` must have endless many surrogates for an entity, or as many as make do.
    """
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = entities.select("kind", F.col("norm").alias("made"))
    taken = real.limit(0)
    todo, later = entities, None
    for attempt in itertools.count():
        tried = todo.repartition(parts, "kind", "norm").withColumn("made", make(F.col("kind"), F.col("norm"), F.lit(attempt)))
        fresh = tried.join(real, ["kind", "made"], "left_anti").join(taken, ["kind", "made"], "left_anti")
        won = scratch.keep(fresh.groupBy("kind", "made").agg(F.min("norm").alias("norm")).select("kind", "norm", "made"))
        todo = scratch.keep(todo.join(won, ["kind", "norm"], "left_anti"))
        if attempt:
            now = won.select("kind", "norm", F.lit(attempt).alias("attempt"))
            later = now if later is None else later.union(now)
        taken = taken.union(won.select("kind", "made"))
        if todo.isEmpty():
            break
    return scratch.keep(later if later is not None else entities.limit(0).select("kind", "norm", F.lit(0).alias("attempt")))


def replace(spark: SparkSession, docs: DataFrame, key: str | None = None, scratch: Scratch | None = None, text: str = "text", count: str = "n_entities") -> DataFrame:
    """The documents with surrogates in ``text``, and the number of mentions replaced.

    ``key`` is the secret that surrogates derive from; None takes it from KEY_SETTING. The number's column is named
    ``count``, with underscores behind it as long as the documents have such a column.
    """
    scratch = scratch or Scratch(spark, "pii")
    key = spark.conf.get(KEY_SETTING, EXAMPLE_KEY) if key is None else key
    doc = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    first = docs.select(doc.alias("doc")).withColumn("found", mentions(F.col("doc")[text])).withColumn("names", telling(names_in(F.col("found")), F.col("doc")[text]))
    every = F.when(F.size("names") > 0, F.regexp_extract_all(F.col("doc")[text], with_bare(F.col("names")), F.lit(0))).otherwise(F.col("found"))
    real = F.size(F.filter("found", lambda x: ~x.rlike("^[0-9 -]+$") | (_kind(x) != "none"))).cast("long")
    held = scratch.keep(first.withColumn("found", every).withColumn("n", real).withColumn("row", F.monotonically_increasing_id()))
    some = held.where("n > 0")
    mentioned = some.select("row", F.explode(parsed(F.col("found"), F.col("names"))).alias("m")).select("row", F.explode("m.keys").alias("k")).where("k.kind NOT IN ('keep', 'initial')").select("row", "k.kind", "k.norm", "k.gender")
    mentioned = scratch.keep(mentioned.distinct())
    told = lambda g: F.max(F.col("gender") == g)
    form = F.when(told("f") & ~told("m"), "_f").when(told("m") & ~told("f"), "_m").otherwise("")
    entities = scratch.keep(mentioned.groupBy("kind", "norm").agg(form.alias("form")))
    later = resolve(entities, scratch, lambda k, n, a: surrogate(F.concat(k, F.col("form")), n, a, key))
    special = entities.join(later, ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))).where("form <> '' OR attempt <> 0")
    by_row = mentioned.select("row", "kind", "norm").distinct().join(special, ["kind", "norm"])
    by_row = by_row.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), F.struct("attempt", "form")))).alias("later"))
    pieces = F.split(F.col("doc")[text], with_bare(F.col("names")), -1)
    new = rewritten(parsed(F.col("found"), F.col("names")), F.col("later"), key)
    whole = F.array_join(F.zip_with(pieces, new, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    count = free_name(count, docs.columns)
    out = lambda df, value: df.select(*[(value if c == text else F.col("doc")[c]).alias(c) for c in docs.columns], F.col("n").alias(count))
    return out(held.where("n = 0"), F.col("doc")[text]).union(out(some.join(by_row, "row", "left"), whole))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents with surrogates, by the key in KEY_SETTING."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(spark, docs).select("doc_id", "n_entities", "text")
