"""Personal data replaced by surrogates.

Detected entities get replacements of their own kind: keyed, so that nobody without the key can undo them; the same for every detected
mention of an entity, in all texts (coreference); different for different entities (distinctness).

Entities of a format (mail addresses, phone numbers, card, account and social security numbers, IP addresses, secrets) go through a
keyed permutation of all strings of the same format: digits stay digits, letters letters, case, separators, calling code, top-level
domain, a card's check digit, the range of an address (private ones stay private) and the beginning of an access key stay valid. A permutation cannot collide, and this one has no fixed point. Names (behind one or more
titles such as Mr., Frau or Prof. Dr.; any number of tokens, initials too) become made-up names of the same gender (none behind a title
that tells none), script and case, token by token, so "Mrs. Ann Lee", later "Mrs. Lee" and elsewhere "Mrs. Ann" still agree: a token that is found both
as a given name and as the last one has one class in all texts, the given one found most often. In the same text every other
capitalised mention of a token of two letters or more ("Ann Lee said", "Lee's"), before or after, becomes the same; so does an ordinary
word that is spelled like it, unless it opens a sentence and the text has it in lower case as well. A person without a title anywhere in a text is not found there. Initials go through a keyed permutation
of their alphabet. Made-up names can collide: all distinct names are found first, surrogates that two names share (or that are names
of the corpus themselves) are drawn anew until there are none, by distributed aggregation. What the texts need to know of that (tokens
of several classes or later draws) is sent to every task if it is small, else joined to the texts by a shuffle.

Defined results: a null text stays null, an empty one empty; a null doc_id is carried through; repeated rows are replaced alike; all
other columns are as they were; an empty table gives no rows; a text of any length is searched whole; overlapping finds: the leftmost,
then the first kind of KINDS."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm._durable import durable, renamed, tidied

KEY = b"parlux surrogates"
ROUNDS = 8
#: Measured bytes of name choices that are sent to every task; larger ones are joined by a shuffle.
CHOICES_BYTES = 16 << 20
#: Characters that are permuted together: so many that half of them have fewer bits than a round's number.
PIECE = 64
#: Titles before names; a capitalised word that is none of them.
_TITLES = "Mr|Mrs|Ms|Miss|Mx|Dra?|Doctor|Doktor|Professor|Profesora?|Prof|Sir|Herr|Herrn|Frau|Fräulein|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señorita|Señora?|Srta|Sra?|Господин|Госпожа|Доктор|Профессор"
#: The same, and in capitals.
TITLES = f"{_TITLES}|{_TITLES.upper()}"
UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
CAPITAL = rf"(?!(?:{TITLES})\b)[{UPPER}][^\W\d_]*(?:['’](?=[{UPPER}])[^\W\d_]+)*"
#: Lower-case words inside names. White space in names and behind titles: a few blanks, or a line's end.
PARTICLES = "von|van|vom|zu|zum|zur|der|den|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|ten|ter|af|av|y|e|bin|ibn|al|el"
GAP = r"(?:[ \t\xa0]{1,3}|[ \t]?\r?\n[ \t]?)"
#: A name's tokens: initials with a full stop, or capitalised words; particles may stand before any but the first.
NAME = rf"(?:[{UPPER}]\.|{CAPITAL})(?:(?:-|{GAP}(?:(?:{PARTICLES}){GAP}){{0,3}}|(?<=\.)(?<!\w\w\.))(?:[{UPPER}]\.|{CAPITAL}))*"
#: Patterns of the kinds, in order of precedence.
KINDS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "secret": r"""\b(?:token|api_?key|API_KEY|TOKEN)["']?(?:\s?=\s?["']?|\s?:\s?["'])(?P<value>[0-9A-Za-z_+/=-]{16,})|\bAKIA[0-9A-Z]{16}\b""",
    "ipv6": r"(?a:(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[Ff][Ee]80|[Ff][CcDd][0-9A-Fa-f]{2}|2[0-9A-Fa-f]{3})(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:]))",
    "ipv4": r"(?a:(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))",
    "phone": r"(?a:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))",
    "ssn": r"(?a:(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    "iban": r"(?a:\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "card": r"(?a:(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]))",
    "name": rf"\b(?:{TITLES})\.?(?:{GAP}(?:{TITLES})\b\.?)*{GAP}(?:(?:{PARTICLES}){GAP}){{0,3}}{NAME}",
}
#: Titles of women, and those that tell no gender; all others of the pattern are men's.
FEMALE = {"Mrs", "Ms", "Miss", "Dra", "Profesora", "Frau", "Fräulein", "Madame", "Mademoiselle", "Mme", "Mlle", "Señorita", "Señora", "Srta", "Sra", "Госпожа"}
NEUTRAL = {"Mx", "Dr", "Doctor", "Doktor", "Professor", "Profesor", "Prof", "Доктор", "Профессор"}
#: The alphabets of initials.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
#: Consonants, vowels, and name endings of women and men, by script.
SYLLABLES = {"latin": ("bdfghjklmnprstvz", "aeiou", "na", "ro"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоу", "на", "ов")}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rf"(?<![^\W\d_])[{UPPER}][^\W\d_]+")
_PLAIN = re.compile(r"(?<![^\W\d_])[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+")
#: What stands before a word that opens a sentence.
_OPENS = re.compile(r"(?:[.!?…:]['\"”’»)]*\s{1,3}|\n\s?)['\"“‘«(]*\Z")
_TITLE = re.compile(rf"(?:{TITLES})\b")
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
#: What Spark looks for before Python: a capital that titles begin with, letters, and a capital behind a blank. A text without holds no name.
_TITLED = rf"[{''.join(sorted({t[0] for t in TITLES.split('|')}))}]\p{{L}}+\.?(?:[ \t\u00a0]|\r?\n)[\s\u00a0]{{0,2}}(?:[{UPPER}]|(?:{PARTICLES})[\s\u00a0])"
#: Calling codes of one and two digits; all others have three.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: A text without any of these holds no entity.
_HINT = re.compile(r"@|[0-9][0-9 .()-]{6}|[0-9A-Fa-f]:|token|TOKEN|api_?key|API_KEY|AKIA|\b(?:M[rsxRSX]|M(?:iss|ISS)|D(?:r|R|octor|oktor|OCTOR|OKTOR)|P(?:rof|ROF)|S(?:ir|IR)|H(?:err|ERR)|F(?:rau|räul|RAU|RÄUL)|M(?:onsieur|ONSIEUR)|M(?:adame|ademoi|ADAME|ADEMOI)|M(?:me|lle|ME|LLE)|S(?:eñor|EÑOR|r|R)|Господин|Госпожа|Доктор|Профессор|ГОСПОДИН|ГОСПОЖА|ДОКТОР|ПРОФЕССОР)")


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(blake2b(repr(parts).encode(), key=key, digest_size=32).digest(), "little")


def _cipher(key: bytes, kind: str, x: int, n: int, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network on a * b >= n pairs, walked until it is inside."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS)[:: -1 if back else 1]:
            if r % 2:
                right = (right + (-1 if back else 1) * _number(key, kind, n, r, left)) % b
            else:
                left = (left + (-1 if back else 1) * _number(key, kind, n, r, right)) % a
        x = left * b + right
        if x < n:
            return x


def moved(key: bytes, kind: str, x: int, n: int) -> int:
    """A keyed permutation of 0..n-1 without a fixed point (for n > 1): a shift seen through the cipher."""
    if n < 2:
        return x
    return _cipher(key, kind, (_cipher(key, kind, x, n) + 1 + _number(key, kind, n) % (n - 1)) % n, n, back=True)


def _shaped(key: bytes, kind: str, text: str, hexadecimal: bool = False) -> str:
    """Another string of the same format: ASCII letters and digits are permuted together, case and everything else stays. A long text
    goes piece by piece, each through a permutation of its own."""
    if len(text) > PIECE:
        return "".join(_shaped(key, f"{kind} {k}", text[k : k + PIECE], hexadecimal) for k in range(0, len(text), PIECE))
    low = text.translate(_LOWER)
    sets = ["0123456789abcdef" if hexadecimal else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" for c in low if c.isascii() and c.isalnum()]
    spots = [i for i, c in enumerate(low) if c.isascii() and c.isalnum()]
    shape = "".join("0" if c in "0123456789" or hexadecimal and c in "abcdef" else "a" if c.isascii() and c.isalpha() else c for c in low)
    x, n = 0, 1
    for i, s in zip(spots, sets, strict=True):
        x, n = x * len(s) + s.index(low[i]), n * len(s)
    x = moved(key, f"{kind} {shape}", x, n)
    out = list(text)
    for i, s in zip(reversed(spots), reversed(sets), strict=True):
        x, k = divmod(x, len(s))
        out[i] = s[k].upper() if text[i].isupper() or hexadecimal and low != text else s[k]
    return "".join(out)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _card(key: bytes, text: str) -> str:
    """Valid check digits stay valid and invalid ones invalid; both ways it is a permutation."""
    digits = "".join(c for c in text if c.isdigit())
    if luhn(digits):
        body = _shaped(key, "card", digits[:-1])
        return _digits(text, next(body + d for d in "0123456789" if luhn(body + d)))
    other = _shaped(key, "number", digits)
    while luhn(other):
        other = _shaped(key, "number", other)
    return _digits(text, other)


#: What access keys begin with; ranges of addresses of special use, with their bits that are free.
ACCESS = "AKIA"
RANGES = [(10 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16), (127 << 24, 24), ((169 << 24) + (254 << 16), 16), ((100 << 24) + (64 << 16), 22), (224 << 24, 28), (240 << 24, 28), (0, 24)]


def _range(x: int) -> tuple[int, int]:
    """(first address, free bits) of the range of special use that an address is in; no bits outside of them."""
    return next(((first, bits) for first, bits in RANGES if first <= x < first + (1 << bits)), (0, 0))


def _upper_like(text: str, new: str) -> str:
    """new in capitals if text has any."""
    return new.upper() if text.lower() != text else new


@lru_cache(maxsize=10_000)
def surrogate(key: bytes, kind: str, text: str) -> str:
    """The replacement of an entity of any kind but name."""
    if kind == "email":
        local, _, domain = text.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_shaped(key, 'local', local)}@{_shaped(key, 'host', host)}.{top}"
    if kind == "ipv4":
        x = 0
        for part in text.split("."):
            x = x * 256 + int(part)
        first, bits = _range(x)
        if bits:  # inside its range
            x = first + moved(key, f"ipv4 {first}", x - first, 1 << bits)
        else:  # walked until it is outside of all ranges again, which keeps it a permutation
            x = moved(key, "ipv4", x, 1 << 32)
            while _range(x)[1]:
                x = moved(key, "ipv4", x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        return _card(key, text)
    if kind == "ipv6":
        kept = re.match("(?i)(?:fe80|f[cd][0-9a-f]{2}|2[0-9a-f]{3})(?=:)", text)
        head = kept[0] if kept else ""  # the kind of network stays
        return head + _upper_like(text, _shaped(key, f"{kind} {head.lower()}", text[len(head) :], True))
    if kind == "secret" and text.startswith(ACCESS):
        return ACCESS + _shaped(key, f"{kind} {ACCESS}", text[len(ACCESS) :])
    if kind == "phone" and text[0] == "+":
        digits = re.match("[0-9]*", text[1:])[0]
        code = "+" + next((digits[:k] for k in (1, 2) if digits[:k] in CALLING), digits[:3])
        return code + _shaped(key, f"phone {code}", text[len(code) :])
    if kind == "iban":
        return text[:2] + _shaped(key, f"iban {text[:2]}", text[2:])
    hexadecimal = kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) is not None
    return _shaped(key, kind, text, hexadecimal)


def name_tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the tokens of a find of kind name that are part of the name; class: gender, if given, and script, or initial."""
    words = list(re.finditer(r"[^\W\d_]+", text))
    titles = 1
    while titles < len(words) and _TITLE.fullmatch(words[titles][0]):
        titles += 1
    told = [name for t in words[:titles] if (name := t[0][0] + t[0][1:].lower()) not in NEUTRAL]
    gender = "s" if not told else "f" if FEMALE.intersection(told) else "m"
    script = lambda w: "cyrillic" if "Ѐ" <= w[0] <= "ӿ" else "latin"
    named = [w for w in words[titles:] if not w[0].islower()]  # particles stay
    return [(m.start(), m.end(), "initial" if len(m[0]) == 1 else f"{'s' if k == len(named) - 1 else gender}-{script(m[0])}") for k, m in enumerate(named)]


def made_up(key: bytes, kind: str, token: str, salt: int) -> str:
    """A made-up name of a class for a token (lower-case); salt tells later draws apart."""
    gender, _, script = kind.partition("-")
    consonants, vowels, female, male = SYLLABLES[script]
    x = _number(key, "name", kind, token, salt)
    out = ""
    for _ in range(3 + x % 3):
        x, c = divmod(x, len(consonants))
        x, v = divmod(x, len(vowels))
        out += consonants[c] + vowels[v]
    return out + {"f": female, "m": male}.get(gender, "")


def _initial(key: bytes, letter: str) -> str:
    alphabet = next(a for a in ALPHABETS if letter in a)
    return alphabet[moved(key, f"initial {alphabet[0]}", alphabet.index(letter), len(alphabet))]


def _cased(like: str, text: str) -> str:
    return text.upper() if len(like) > 1 and like.isupper() else text.capitalize()


def finds(text: str) -> Iterator[re.Match]:
    """The entities of a text."""
    return _FIND.finditer(text) if _HINT.search(text) else iter(())


#: What texts need to know of name tokens: token -> (class, draw).
Choices = dict[str, tuple[str, int]]


def replaced(text: str, key: bytes, choices: Choices) -> str:
    """The text with surrogates; choices has the tokens that are not just the first draw of the one class they are found in."""
    found = list(finds(text))
    known: dict[str, str] = {}  # the name tokens of this text, each with the class of its first find
    for m in found:
        if m.lastgroup == "name":
            for lo, hi, which in name_tokens(m[0]):
                if which != "initial":
                    known.setdefault(m[0][lo:hi].lower(), which)

    def named(token: str, which: str) -> str:
        if which == "initial":
            return _initial(key, token)
        which, salt = choices.get(token.lower(), (which, 0))
        return _cased(token, made_up(key, which, token.lower(), salt))

    # tokens that are ordinary words of the text too: where one opens a sentence, it may be that word
    plain = known.keys() & set(_PLAIN.findall(text)) if known else set()

    def between(lo: int, hi: int) -> str:
        """What is outside of finds, with bare mentions of the text's names replaced."""

        def mention(m: re.Match) -> str:
            token = m[0].lower()
            ordinary = token in plain and m[0][1:].islower() and _OPENS.search(text, max(0, lo + m.start() - 8), lo + m.start())
            return named(m[0], known[token]) if token in known and not ordinary else m[0]

        return _WORD.sub(mention, text[lo:hi]) if known else text[lo:hi]

    out, at = [], 0
    for m in found:
        kind, value = m.lastgroup, m[0]
        out.append(between(at, m.start()))
        if kind == "name":
            done = 0
            for lo, hi, which in name_tokens(value):
                out += [value[done:lo], named(value[lo:hi], which)]
                done = hi
            out.append(value[done:])
        elif m["value"] is not None:  # a secret behind its name
            out += [text[m.start() : m.start("value")], surrogate(key, kind, m["value"])]
        else:
            out.append(surrogate(key, kind, value))
        at = m.end()
    return "".join([*out, between(at, len(text))]) if out else text


def _found_names(text: str | None) -> Iterator[tuple[str, str]]:
    """(class, token in lower case) of the names found in a text, but initials."""
    for m in finds(text or ""):
        if m.lastgroup == "name":
            yield from ((which, m[0][lo:hi].lower()) for lo, hi, which in name_tokens(m[0]) if which != "initial")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(x for text in batch.column(0).to_pylist() for x in _found_names(text))
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([seen[r] for r in rows], pa.int64())], ["kind", "token", "n"])


def name_choices(texts: DataFrame, key: bytes = KEY, make: Callable[[bytes, str, str, int], str] = made_up) -> DataFrame:
    """(token, kind, salt) of the names of a corpus that are found in several classes, or whose first draw by make collides with another
    name's surrogate or with a name of the corpus."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, tokens, salts = (batch.column(c).to_pylist() for c in ("kind", "token", "salt"))
            made = [make(key, k, t, s) for k, t, s in zip(kinds, tokens, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["token", "kind", "mixed", "salt", "made"])

    schema = "token string, kind string, mixed boolean, salt int, made string"
    found = texts.toDF("text").where(F.col("text").rlike(_TITLED)).mapInArrow(tidied(_names), "kind string, token string, n long").groupBy("token", "kind").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(~F.startswith("kind", F.lit("s")), "n", "kind"))["kind"]
    names = durable(found.groupBy("token").agg(best.alias("kind"), (F.count("*") > 1).alias("mixed")).withColumn("salt", F.lit(0)))
    real = names.select(F.col("token").alias("made"))
    drawn_now = durable(names.mapInArrow(drawn, schema))
    while True:
        first = drawn_now.groupBy("made").agg(F.min(F.struct("salt", "kind", "token")).alias("first"), F.count("*").alias("n")).where("n > 1").select("made", "first")
        clash = drawn_now.join(first, "made").where(F.struct("salt", "kind", "token") != F.col("first")).select("token")
        again = durable(clash.union(drawn_now.join(real, "made", "left_semi").select("token")).distinct())
        if not again.take(1):
            return drawn_now.where("mixed or salt > 0").select("token", "kind", "salt")
        moved_on = drawn_now.join(again, "token", "left_semi").select("token", "kind", "mixed", (F.col("salt") + 1).alias("salt")).mapInArrow(drawn, schema)
        drawn_now = durable(drawn_now.join(again, "token", "left_anti").unionByName(moved_on))


def _joined_choices(rows: DataFrame, text: str, choices: DataFrame) -> DataFrame:
    """rows with a column _choices: what each text needs of a table that is too large for every task."""
    held = durable(rows.withColumn("_row", F.monotonically_increasing_id()))

    def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(row, token) for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for token in sorted({x for _, x in _found_names(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], ["_row", "token"])

    needed = held.select("_row", text).where(F.col(text).rlike(_TITLED)).mapInArrow(tidied(mentioned), "_row long, token string")
    mine = needed.join(choices, "token").groupBy("_row").agg(F.collect_list(F.struct("token", "kind", "salt")).alias("_choices"))
    return held.join(mine, "_row", "left").drop("_row")


def replace_private(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs, all columns as they were, but text with surrogates (and n_chars, where it is there, as the new length)."""
    rows, at, back = renamed(docs)
    out = rows.withColumn(at["text"], F.col(at["text"]).cast("string"))
    place, kinds = out.columns.index(at["text"]), out.schema
    choices = durable(name_choices(out.select(at["text"]), key))
    size = choices.agg(F.sum(F.octet_length("token") + 100)).first()[0] or 0
    if size <= CHOICES_BYTES:
        known: Choices = {r["token"]: (r["kind"], r["salt"]) for r in choices.collect()}
    else:
        known, out = {}, _joined_choices(out, at["text"], choices)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            if batch.num_columns > len(kinds):
                mine = [{x["token"]: (x["kind"], x["salt"]) for x in c or ()} for c in batch.column(len(kinds)).to_pylist()]
                texts = [t and replaced(t, key, m) for t, m in zip(texts, mine, strict=True)]
            else:
                texts = [t and replaced(t, key, known) for t in texts]
            columns = batch.columns[: len(kinds)]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(kinds)])

    out = out.mapInArrow(tidied(done), kinds)
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.col(at["n_chars"]).isNotNull(), F.length(at["text"])).cast(out.schema[at["n_chars"]].dataType))
    return back(out)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
