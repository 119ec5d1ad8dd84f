"""Surrogates for personal data.

Detected entities get a replacement that a key decides: the same entity gets the same one everywhere (coreference), two entities of a type get
two (distinctness). Replacements keep type, format, script and case: every letter or digit stays one of its own alphabet, punctuation stays, card numbers stay
valid, addresses stay addresses, and a person keeps the gender that title or first name tell. People are found by a title or a listed first name before a capitalised one; further
mentions of a full name in the text, and of its surname alone, get the same surrogate and its surname. Surnames are replaced alike whatever the title or first name.

Letters and digits go through a keyed permutation of all strings of the same format (a Feistel network with cycle walking), so two entities of one format cannot
meet. Names also take a listed first name, so they can. The collision check therefore counts, over the whole corpus, (type, surrogate) pairs of several entities and surrogates that
equal a real entity; those entities, all but the smallest, move to the key's next round until none is left. The rounds end: a first name gets a keyed letter more in
each round, so its space grows 20 times or more; other types draw anew from the space of their format, and from round EXTEND on, which only a nearly full space
reaches, from formats one character longer each round (addresses: IPv6 ones). So each round leaves a shrinking share of the collisions, log N rounds in all.
Entities past round 0 are few; they travel to their rows in a join by row key, which Spark broadcasts only where their files are small.

Defined cases: null text stays null, with 0 entities; very long texts are read whole; overlapping detections keep the earlier, then the longer; the text between entities is untouched; repeated rows give a row each; rows
with a null or repeated doc_id get the surrogates of their own text; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import KEYS, keyed, small_batches, staged, table

KEY = b"lodestone"
EXTEND = 8
# Alphabets, by script and case.
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "ÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
# Titles and first names that tell a gender.
MALE_TITLES = {"mr", "herr", "monsieur", "sr", "señor", "sir", "г-н"}
FEMALE_TITLES = {"mrs", "ms", "miss", "frau", "mme", "madame", "sra", "señora", "г-жа"}
FIRST_NAMES = {
    "latin": {
        "m": ["Adam", "Anton", "Carlos", "Daniel", "David", "Felix", "Hugo", "James", "John", "Jules", "Karl", "Louis", "Luis", "Marco", "Martin", "Michael", "Oscar", "Paul", "Peter", "Robert", "Thomas", "William"],
        "f": ["Alice", "Anna", "Carla", "Clara", "Elena", "Emma", "Eva", "Ines", "Jane", "Julia", "Laura", "Lena", "Louise", "Lucia", "Maria", "Marie", "Mary", "Nina", "Olga", "Rosa", "Sarah", "Sofia"],
    },
    "cyrillic": {
        "m": ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Николай", "Олег", "Павел", "Сергей"],
        "f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Софья", "Татьяна"],
    },
}
_GENDER = {n.lower(): g for script in FIRST_NAMES.values() for g, names in script.items() for n in names}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)?"
# Patterns. The detection of a type needs one of its signs in the text.
PATTERNS = [
    ("email", "@", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}")),
    ("secret", None, re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])|(?:password|passwd|secret|token|api_key)\s*[=:]\s*[^\s\"']{6,})", re.I)),
    ("ip", ".", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", None, re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")),
    ("iban", None, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("phone", None, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{8,14}(?!\d)")),
    ("person", None, re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Mme|Madame|Sr|Sra|Señora?|Sir|г-н|г-жа)\.? ({_NAME}(?: {_NAME}){{0,2}})")),
]
_DIGIT = re.compile(r"\d")
_LISTED = "|".join(sorted(n for script in FIRST_NAMES.values() for names in script.values() for n in names))
#: A listed first name and one or two capitalised ones.
KNOWN = re.compile(rf"\b(?:{_LISTED})(?: {_NAME}){{1,2}}")


def _luhn(digits: list[int]) -> int:
    """The check digit that completes digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order and apart."""
    found, digits = [], bool(_DIGIT.search(text))
    for kind, sign, pattern in PATTERNS:
        if sign and sign not in text or kind in ("ip", "ssn", "card", "iban", "phone") and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "person" else m.span()
            if kind == "person":
                words = m[1].split(" ")
                n = next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))
                if not n:
                    continue
                b = a + len(" ".join(words[:n]))
            elif kind == "card":
                d = [int(c) for c in m[0] if c.isdigit()]
                if _luhn(d[:-1]) != d[-1]:
                    continue
            elif kind == "secret" and (p := re.match(r"\w+\s*[=:]\s*", m[0])):
                a += p.end()
            found.append((a, b, kind))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def _round_function(key: bytes, tag: str, i: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    stream, block = b"", 0
    while len(stream) < size:
        stream += hmac.digest(key, f"{tag}|{i}|{block}|{value}".encode(), hashlib.sha256)
        block += 1
    return int.from_bytes(stream[:size], "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, tag: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = value >> half, value & ((1 << half) - 1)
        for i in range(8):
            left, right = right, left ^ _round_function(key, tag, i, right, half)
        value = left << half | right
        if value < size:
            return value


def permuted(text: str, key: bytes, tag: str, within: list[str] = ALPHABETS) -> str:
    """Another text of the same format: characters stay in their alphabet, others stay as they are."""
    alphabets = [next((a for a in within if c in a), c) for c in text]
    number, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        number, size = number * len(a) + a.index(c), size * len(a)
    number = permute(number, size, key, f"{tag}|{len(text)}|{size}")
    out = []
    for a in reversed(alphabets):
        number, i = divmod(number, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def gender_of(name: str, title: str = "") -> str:
    t = title.lower().strip(". ")
    return "m" if t in MALE_TITLES else "f" if t in FEMALE_TITLES else _GENDER.get(name.split(" ")[0].lower(), "")


def _digits_into(shape: str, digits: list[int]) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in shape)


def _longer(text: str, n: int) -> str:
    """text with n more characters of the class of its last letter or digit, after that."""
    at = next((i for i in range(len(text) - 1, -1, -1) if text[i].isalnum()), -1)
    return text[: at + 1] + (text[at] if at >= 0 else "0") * n + text[at + 1 :]


def surrogate(kind: str, entity: str, round_: int = 0, key: bytes = KEY) -> str:
    """The replacement of an entity in a round of the collision check. kind: a type, for people with the gender: person:f."""
    tag, extra = f"{kind}|{round_}", max(0, round_ - EXTEND + 1)
    if kind == "card":
        entity = _longer(entity, extra)
        d = [int(c) for c in entity if c.isdigit()]
        middle = permuted("".join(map(str, d[1:-1])), key, tag)
        new = [d[0], *map(int, middle)]
        return _digits_into(entity, [*new, _luhn(new)])
    if kind == "ip":
        value = 0
        for x in entity.split("."):
            value = value << 8 | int(x)
        if extra:  # in the range kept for documentation
            low = _round_function(key, tag, 0, value, 80)
            return "2001:db8:0:" + ":".join(f"{low >> s & 0xFFFF:x}" for s in (64, 48, 32, 16, 0))
        while True:
            value = permute(value, 1 << 32, key, tag)
            if 1 <= value >> 24 <= 223:
                return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone" and (m := re.match(r"\+\d{1,3}(?=[ .(-])", entity)):
        return m[0] + permuted(_longer(entity[m.end() :], extra), key, tag)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return f"{permuted(f'{_longer(local, extra)}@{name}', key, tag)}{dot}{top}"
    if kind.startswith("person"):
        first, *rest = entity.split(" ")
        gender = kind.partition(":")[2]
        last = [permuted(_longer(w, extra), key, f"surname|{round_}") for w in rest]
        if gender and (rest or first.lower() in _GENDER):
            script = "cyrillic" if re.search(r"[а-яА-Я]", first) else "latin"
            names, letters = FIRST_NAMES[script][gender], ALPHABETS[5 if script == "cyrillic" else 1]
            draw = _round_function(key, tag, 0, int.from_bytes(hashlib.sha256(entity.encode()).digest()[:8], "big"), 64 + 8 * round_)
            draw, at = divmod(draw, len(names))
            more = ""
            for _ in range(round_):
                draw, i = divmod(draw, len(letters))
                more += letters[i]
            return " ".join([names[at] + more, *last])
        return " ".join([permuted(_longer(first, extra), key, f"surname|{round_}"), *last])
    entity = _longer(entity, extra)
    if kind == "iban":
        return entity[:2] + permuted(entity[2:], key, tag)
    if kind == "secret" and entity.upper().startswith("AKIA"):
        return entity[:4] + permuted(entity[4:], key, tag)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]{16,}", entity):
        return permuted(entity, key, tag, ["0123456789abcdef"])
    return permuted(entity, key, tag)


def _capitalised(words: list[str]) -> str:
    n = next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))
    return " ".join(words[:n])


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, entity): in order and apart. For a person the type has the gender, and the entity of a surname alone is the full name that it stands for in the text."""
    if not text:
        return []
    found = [(a, b, kind) for a, b, kind in detect(text)]
    taken = [(a, b) for a, b, _ in found]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    for m in KNOWN.finditer(text):
        name = _capitalised(m[0].split(" "))
        if " " in name and free(m.start(), m.start() + len(name)):
            found.append((m.start(), m.start() + len(name), "person"))
            taken.append(found[-1][:2])
    people: dict[str, str] = {}
    for a, b, kind in found:
        if kind == "person":
            name = text[a:b]
            people[name] = people.get(name) or (gender_of(name, text[:a].rstrip(" .").rpartition(" ")[2][-10:]) if " " in name else _GENDER.get(name.lower(), ""))
    full = sorted((n for n in people if " " in n), key=lambda n: (-len(n), n))
    of = {n: n for n in full}
    for a, b, kind in sorted(found):  # of people who share a surname the first
        if kind == "person" and " " in text[a:b] and len(last := text[a:b].rpartition(" ")[2]) > 2:
            of.setdefault(last, text[a:b])
    if of:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(of, key=lambda n: (-len(n), n)))) + r")(?!\w)", text):
            if free(*m.span()):
                found.append((*m.span(), "person"))
                taken.append(m.span())
    out = []
    for a, b, kind in sorted(found):
        entity = text[a:b]
        if kind == "person":
            entity = of.get(entity, entity)
            kind = f"person:{people[entity]}" if people.get(entity) else kind
        out.append((a, b, kind, entity))
    return out


def _put(mention: str, kind: str, entity: str, made: str) -> str:
    """What stands for a mention of an entity: of a surname alone the surrogate's surname."""
    return made.rpartition(" ")[2] if kind.startswith("person") and mention != entity else made


def _found(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, y, k, e, surrogate(k, e)) for x, y, t in zip(b[KEYS[0]], b[KEYS[1]], b["text"], strict=True) for k, e in sorted({(f[2], f[3]) for f in entities(t)})]
            yield pd.DataFrame(rows, columns=[*KEYS, "kind", "entity", "made"])

    rows = keyed(docs).select(*KEYS, F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"{KEYS[0]} long, {KEYS[1]} long, kind string, entity string, made string")


def moved_on(found: DataFrame) -> DataFrame:
    """kind, entity, made of the entities whose first surrogate collided."""

    @F.pandas_udf("string")
    def again(kind: pd.Series, entity: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, int(r)) for k, e, r in zip(kind, entity, turn, strict=True)], dtype=object)

    state = staged(found.select("kind", "entity", "made", F.lit(0).alias("turn")).distinct(), "surrogates")
    base = F.substring_index("kind", ":", 1)
    while True:
        typed = state.withColumn("base", base)
        first = typed.groupBy("base", "made").agg(F.min(F.struct("kind", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = typed.join(first, ["base", "made"]).where(F.struct("kind", "entity") != F.col("first")).select("kind", "entity")
        real = typed.select("base", F.col("entity").alias("made")).distinct()
        clashes = staged(shared.union(typed.join(real, ["base", "made"], "left_semi").select("kind", "entity")).distinct(), "clashes")
        if clashes.isEmpty():
            return state.where("turn > 0").select("kind", "entity", "made")
        turn = F.col("turn") + 1
        next_ = state.join(clashes, ["kind", "entity"], "left_semi").select("kind", "entity", again("kind", "entity", turn).alias("made"), turn.alias("turn"))
        state = staged(state.join(clashes, ["kind", "entity"], "left_anti").unionByName(next_), "surrogates")


def replace(docs: DataFrame) -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (sorted, apart)."""
    small_batches(docs.sparkSession)
    found = staged(_found(docs), "entities")
    moved = moved_on(found)
    per_row = staged(
        found.select(*KEYS, "kind", "entity").join(moved, ["kind", "entity"]).groupBy(*KEYS).agg(F.collect_set(F.struct("kind", "entity", "made")).alias("moved")), "moved"
    )  # bounded by the entities of one text

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, moved in zip(b["doc_id"].astype("Int64"), b["text"], b["moved"], strict=True):
                special = {(m["kind"], m["entity"]): m["made"] for m in moved} if moved is not None else {}
                spans, out, at = entities(text), [], 0
                for a, z, k, e in spans:
                    out += [text[at:a], _put(text[a:z], k, e, special.get((k, e)) or surrogate(k, e))]
                    at = z
                rows.append((doc, "".join([*out, text[at:]]) if text is not None else None, len(spans), ",".join(sorted({x[2].partition(":")[0] for x in spans}))))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_entities", "kinds"]).astype({"doc_id": "Int64"})

    rows = keyed(docs).select(*KEYS, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(per_row, list(KEYS), "left").select("doc_id", "text", "moved").mapInPandas(run, "doc_id long, text string, n_entities long, kinds string")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"))
