"""Surrogates for personal data: keyed replacements of the same type and format.

An entity's variable characters are digits of a mixed-radix number: each position ranges over the characters of its
class and script. A keyed permutation of all numbers of that shape gives the surrogate's characters, so the same entity
always gets the same surrogate. Given names change within their gender's list by a keyed permutation as well. A
surrogate has the shape of its entity, so under one attempt different entities never share one. The whole corpus's
entities are checked: a surrogate that is itself an entity of the corpus is drawn again under the next attempt, and so
is one that two entities share because their attempts differ. Such attempts are joined to their documents. A shape
whose values are nearly all in use may leave no way out; then all its entities get one common attempt.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import free_name, shared_table

ATTEMPTS = 6
COMMON = 16
TYPES = ("email", "phone", "card", "ip", "secret", "ssn", "name")

# Common given names, for replacement within a gender.
FEMALE = ("Anna", "Carla", "Clara", "Elena", "Emma", "Eva", "Julia", "Laura", "Lena", "Lucia", "Marie", "Martha", "Mary", "Nina", "Olivia", "Paula", "Rosa", "Sarah", "Sofia", "Susan")
MALE = ("Adam", "Carlos", "Daniel", "David", "Felix", "Henri", "James", "Jan", "John", "Karl", "Louis", "Lucas", "Mark", "Martin", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas")
TITLES = {
    "female": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Srta", "Doña", "Г-жа", "Госпожа"),
    "male": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Don", "Г-н", "Господин"),
    "any": ("Dr", "Prof"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
ENTITY = re.compile(
    rf"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})"
    rf"|(?<![\w.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
    r"|(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_+/=-]{8,})"
    rf"|(?<!\w)(?:{_TITLE})\.? (?P<name>[{_UPPER}][{_LOWER}]+(?:[ -][{_UPPER}][{_LOWER}]+){{0,2}})"
    r"|(?<!\w)(?P<access>A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{20,})(?!\w)"
    r"|(?<![\w])(?P<key>(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,64})(?![\w])")
HINT = re.compile(rf"[@]|\d[\d. ()-]{{5}}|[=:]\s{{0,3}}[\"']?[A-Za-z0-9_+/=-]{{8}}|(?<!\w)(?:{_TITLE})\.? [{_UPPER}]|[0-9a-f]{{32}}|A[KS]IA[0-9A-Z]|gh[pousr]_|sk-")

_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(map(chr, range(0x3B1, 0x3CA))).replace("ς", ""), "".join(map(chr, range(0x391, 0x3AA))).replace("΢", "")]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = "0123456789abcdef"
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PREFIX = re.compile(r"A[KS]IA|gh[pousr]_|sk-")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network over the next power of four, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    if size <= 1:
        return value
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            d = hashlib.blake2b(f"{tweak}|{half}|{r}|{right}".encode(), key=key, digest_size=64).digest()
            left, right = right, left ^ (int.from_bytes(d, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def _shape(text: str, alphabets: list[str | None], key: bytes, tweak: str) -> str:
    """text with the characters that have an alphabet permuted together; the shape is part of the key."""
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    form = "".join(c if not a else chr(0xE000 + len(a)) for c, a in zip(text, alphabets, strict=True))
    value, out = permute(value, size, key, f"{tweak}|{form}"), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, k = divmod(value, len(a))
            out.append(a[k])
        else:
            out.append(c)
    return "".join(reversed(out))


def _within(text: str, alphabets: list[str | None], key: bytes, tweak: str, stays: Callable[[str], bool]) -> str:
    """_shape again and again until stays holds, as it does for text: a permutation of the texts for which it holds."""
    while True:
        text = _shape(text, alphabets, key, tweak)
        if stays(text):
            return text


def _classes(text: str) -> list[str | None]:
    return [_CLASS.get(c) for c in text]


def _luhn(digits: str) -> int:
    """The check digit of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _checked(text: str) -> bool:
    """Whether the last digit of text is its check digit."""
    body = "".join(c for c in text if c.isdigit())
    return _luhn(body[:-1]) == int(body[-1])


def _card(text: str, key: bytes, tweak: str) -> str:
    """Digits change but for the first; a valid check digit is valid again."""
    digits, valid = [i for i, c in enumerate(text) if c.isdigit()], _checked(text)
    free = set(digits[1:-1] if valid else digits[1:])
    end = digits[-1] if valid else len(text)
    alphabets = ["0123456789" if i in free else None for i in range(end)]
    if not valid:
        return _within(text, alphabets, key, f"{tweak}|plain", lambda t: not _checked(t))
    out = _shape(text[:end], alphabets, key, f"{tweak}|check")
    return out + str(_luhn("".join(c for c in out if c.isdigit())))


def _name(text: str, gender: str, key: bytes, tweak: str) -> str:
    """Given names of a list change within the list; other words keep their length, case, script and last letter."""
    parts = re.split(r"([ -])", text)
    for i in range(0, len(parts), 2):
        own = next((x for x in ((FEMALE, MALE) if gender != "male" else (MALE, FEMALE)) if parts[i] in x), None)
        if own:
            parts[i] = own[permute(own.index(parts[i]), len(own), key, f"{tweak}|given")]
        else:
            parts[i] = _within(parts[i], [*_classes(parts[i])[:-1], None], key, tweak, lambda t: t not in FEMALE and t not in MALE)
    return "".join(parts)


def _is_hex(text: str) -> bool:
    return re.fullmatch("[0-9a-f]+", text) is not None


def shape(kind: str, text: str) -> str:
    """What an entity and its surrogates have in common. Under one attempt the surrogates of a shape are a permutation of it."""
    base = kind.partition(":")[0]

    def form(t: str) -> str:
        return "".join(chr(0xE000 + _ALPHABETS.index(_CLASS[c])) if c in _CLASS else c for c in t)

    if base == "ip":
        return base
    if base == "card":
        return f"{_checked(text)}|{text[0]}{form(text[1:])}"
    if base == "name":
        return "".join("\uE0F0" if w in FEMALE else "\uE0F1" if w in MALE else form(w[:-1]) + w[-1:] for w in re.split("([ -])", text))
    if base == "secret" and (m := _PREFIX.match(text)):
        rest = text[m.end():]
        return m.group() + ("".join("\uE0F2" if c in _BASE36 else c for c in rest) if rest.isupper() else form(rest))
    if base == "secret" and _is_hex(text):
        return "\uE0F3" * len(text)
    if base == "email":
        host, dot, top = text.rpartition(".")
        return form(host) + dot + top
    if base == "phone" and (code := re.match(r"\+\d{1,3}(?=\D)", text)):
        return code.group() + form(text[code.end():])
    return form(text)


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity; kind is one of TYPES, for names followed by a colon and a gender."""
    base, _, gender = kind.partition(":")
    tweak = f"{base}|{attempt}"
    if base == "email":
        local, _, host = text.rpartition("@")
        name, dot, top = host.rpartition(".")
        return f"{_shape(local, _classes(local), key, tweak)}@{_shape(name, _classes(name), key, tweak + '|host')}{dot}{top}"
    if base == "ip":
        a, b, c, d = map(int, text.split("."))
        v = permute((a << 24) | (b << 16) | (c << 8) | d, 1 << 32, key, tweak)
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if base == "card":
        return _card(text, key, tweak)
    if base == "phone":
        code = re.match(r"\+\d{1,3}(?=\D)", text)
        head = code.group(0) if code else ""
        return head + _shape(text[len(head):], _classes(text[len(head):]), key, tweak)
    if base == "name":
        return _name(text, gender, key, tweak)
    if base == "secret" and (m := _PREFIX.match(text)):  # the prefix tells the kind of key, and stays
        rest = text[m.end():]
        return m.group() + _within(rest, [_BASE36 if rest.isupper() and c in _BASE36 else a for c, a in zip(rest, _classes(rest), strict=True)], key, tweak, lambda t: t.isupper() == rest.isupper())
    if base == "secret" and _is_hex(text):
        return _shape(text, [_HEX] * len(text), key, tweak)
    if base == "secret":
        return _within(text, _classes(text), key, tweak, lambda t: not _is_hex(t) and not _PREFIX.match(t))
    return _shape(text, _classes(text), key, tweak)


def _gender(title: str) -> str:
    return next((g for g, ts in TITLES.items() if title.rstrip(". ") in ts), "any")


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and value of each entity of a text, from left to right."""
    if not HINT.search(text):
        return
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        a, z = m.span(kind)
        if kind == "name":
            kind = f"name:{_gender(text[m.start():a])}"
        yield a, z, "secret" if kind in ("key", "access") else kind, text[a:z]


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct entities of each row's id: id, kind, value and uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, values = [], [], []
            for i, t in enumerate(b.column(1)):
                for _, _, kind, value in entities(t.as_py() or ""):
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["id", "kind", "value"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema).groupBy("id", "kind", "value").agg(F.count("*").alias("uses"))


def assign(found: DataFrame, key: bytes, attempts: int = ATTEMPTS) -> DataFrame:
    """Entities whose first surrogate did not stand: kind, value and attempt.

    An entity is a value of a base type; a name after titles of different genders is one, with one surrogate. Each
    attempt is checked over all entities: of several with one surrogate only the least stays, and none may have a
    surrogate that is an entity of the corpus. After the last attempt a surrogate may name another entity (all values of a
    short shape may be in use). Where two entities of a shape still share one, or one has itself, all entities of that
    shape get one common attempt, under which they cannot share any: of COMMON ones, that with the fewest entities that
    keep their value, and then with the fewest surrogates in use.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, values, tries = (b.column(i).to_pylist() for i in range(3))
            drawn = [surrogate(k, v, key, a) for k, v, a in zip(bases, values, tries, strict=True)]
            shapes = [shape(k, v) for k, v in zip(bases, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(drawn, pa.string()), pa.array(shapes, pa.string())], ["base", "value", "attempt", "surrogate", "shape"])

    schema = "base string, value string, attempt int, surrogate string, shape string"
    kinds = found.select("kind", F.split("kind", ":")[0].alias("base"), "value").distinct()
    everyone = shared_table(kinds.select("base", "value").distinct().withColumn("attempt", F.lit(0)), "entities")
    real = everyone.select(F.col("value").alias("surrogate")).distinct()
    drawn = shared_table(everyone.mapInArrow(draw, schema), "drawn")
    for _ in range(attempts):
        first = drawn.groupBy("base", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"))
        clash = drawn.join(first, ["base", "surrogate"]).where(F.struct("attempt", "value") != F.col("first")).select("base", "value", "attempt")
        taken = drawn.join(real, "surrogate", "left_semi").select("base", "value", "attempt")
        again = shared_table(clash.union(taken).distinct(), "again")
        if again.isEmpty():
            break
        stay = drawn.join(again.select("base", "value"), ["base", "value"], "left_anti")
        drawn = shared_table(stay.unionByName(again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(draw, schema)), "drawn")
    else:
        left = drawn.groupBy("base", "shape", "surrogate").agg(F.count("*").alias("n"), F.max((F.col("value") == F.col("surrogate")).cast("int")).alias("own"))
        full = shared_table(left.where("n > 1 or own = 1").select("base", "shape").distinct(), "full")
        if not full.isEmpty():
            tries = F.explode(F.sequence(F.lit(attempts + 1), F.lit(attempts + COMMON)))
            common = drawn.join(full, ["base", "shape"], "left_semi").select("base", "value", tries.alias("attempt"))
            common = shared_table(common.mapInArrow(draw, schema), "common")
            used = real.withColumn("used", F.lit(1))
            best = common.join(used, "surrogate", "left").groupBy("base", "shape", "attempt").agg(
                F.sum((F.col("value") == F.col("surrogate")).cast("int")).alias("own"), F.count("used").alias("used"))
            best = best.groupBy("base", "shape").agg(F.min(F.struct("own", "used", "attempt"))["attempt"].alias("attempt"))
            drawn = drawn.join(full, ["base", "shape"], "left_anti").unionByName(common.join(best, ["base", "shape", "attempt"], "left_semi"))
    return kinds.join(drawn.where("attempt > 0"), ["base", "value"]).select("kind", "value", "attempt")


def _replace(key: bytes, text_at: int, more_at: int, kinds_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, seen = [], []
            more = b.column(more_at).to_pylist()
            for i, t in enumerate(b.column(text_at)):
                t = t.as_py()
                attempts = {(e["kind"], e["value"]): e["attempt"] for e in more[i] or ()}
                parts, at, kinds = [], 0, []
                for a, z, kind, value in entities(t or ""):
                    parts += [t[at:a], surrogate(kind, value, key, attempts.get((kind, value), 0))]
                    at = z
                    kinds.append(kind)
                new.append(t if t is None or not parts else "".join([*parts, t[at:]]))
                seen.append(kinds)
            cols = [c for k, c in enumerate(b.columns) if k != more_at]
            names = [n for k, n in enumerate(b.schema.names) if k != more_at]
            cols[text_at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seen, pa.list_(pa.string()))], [*names, kinds_name])

    return run


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col, and last a column with the kinds of the replaced entities, in order.

    The column is called entity_kinds, with underscores before it where docs has that name.

    Null texts stay null, texts without entities stay as they are, repeated rows get equal surrogates. Documents are
    joined only to entities that needed another attempt; Spark chooses the join by its size.
    """
    secret = hmac.new(key.encode(), b"surrogates", hashlib.sha256).digest()
    found = shared_table(mentions(docs, id_col, text_col), "mentions")
    odd = assign(found, secret)
    more = found.join(odd, ["kind", "value"]).groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("__more"))
    if odd.isEmpty():
        joined = docs.select("*", F.expr("cast(null as array<struct<kind: string, value: string, attempt: int>>)").alias("__more"))
    else:
        more = shared_table(more, "attempts")
        joined = docs.join(more, docs[id_col].eqNullSafe(more["__id"]), "left").select(*[docs[c] for c in docs.columns], more["__more"])
    name = free_name(docs, "entity_kinds")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])
    return joined.mapInArrow(_replace(secret, docs.columns.index(text_col), len(docs.columns), name), schema)
