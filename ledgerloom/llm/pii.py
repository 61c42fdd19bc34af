"""Personal data in texts, plain and disguised, with spans in the source text.

The plain patterns run on the text itself.  Where a text holds signs of a disguise, small
transducers rewrite it (look-alike characters, spelled digits, "at" and "dot"), keeping for
every character of the result where it came from; the same patterns run on the result, and
what they find is mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters that look like ASCII ones, Cyrillic, Greek, Armenian and Cherokee; and the digits' names.
LOOK_ALIKE = dict(zip("АВЕКМНОРСТХІЈЅаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυωօսհոցԛԝᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏀᎠ", "ABEKMHOPCTXIJSaeopcyxijsdhABEZHIKMNOPTYXoavikpuwouhngqwABCEHJKLMPRSTVWZGD", strict=True))
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_ODD = re.compile("[²³¹­Ͱ-ԯՠ-ևᎠ-Ᏼ٠-٩۰-۹​-‍․⁠⁰-₉①-⑳﻿﹒﹫！-～\U0001d400-\U0001d7ff]")
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT = rf"(?:{_NUMBER}|[0-9])"
_GAP = r"(?:[\x20-]|,\x20|\x20?-\x20?)"
_PART = rf"(?:{_GAP}?|\x20(?:dot|point)\x20|\.)"
#: A run of digits and their names, parted or not, with its sign before it; a run is read once, as no part of it is given back.
_SPELLED = re.compile(rf"(?<!\w)(?P<plus>plus\x20|\+\x20?)?{_UNIT}(?:{_PART}{_UNIT})*+", re.I)
_UNITS = re.compile(_UNIT, re.I)
#: A digit's name takes the gap to the next digit with it, so do digits before a name.
_ONE = re.compile(rf"(?P<name>{_NUMBER})(?:{_GAP}(?={_UNIT}))?|(?<=[0-9]){_GAP}(?=(?:{_NUMBER}))|plus\x20|\x20(?:dot|point)\x20", re.I)
#: How the corpus languages say the signs.
_AT_WORD, _DOT_WORD = "at|ät|arroba|arobase", "dot|punkt|punto|point"
_AT = rf"\x20?(?:\((?:{_AT_WORD}|@)\)|\[(?:{_AT_WORD}|@)\]|\{{(?:{_AT_WORD})\}}|<(?:{_AT_WORD})>|_(?:{_AT_WORD})_)\x20?"
_DOT = rf"\x20?(?:\((?:{_DOT_WORD}|\.)\)|\[(?:{_DOT_WORD}|\.)\]|\{{(?:{_DOT_WORD})\}}|<(?:{_DOT_WORD})>|_(?:{_DOT_WORD})_)\x20?"
_DOTS = rf"(?:\.|{_DOT}|\x20(?:{_DOT_WORD})\x20)"
_PLACE = r"[A-Za-z0-9-]+"
#: Words of prose around a bare "at": before it or as the name of a host, and as the end of one.
_PROSE = frozenset(
    "a an the this that these those my your his her its our their me you him us them it one ones is are was were be been look looked looking looks stay stayed live lives lived work works worked "
    "working available found find hosted located online website site page pages here there visit read more see seen stop stopped start starts home noon night all least most first last once only and or not "
    "now order buy sold start shop published posted listed store details info hosted people time times arrive arrived meet met down up out back over le la el un une der die das".split()
)
_NO_END = frozenset("the a an and or your my this that on is was to of for with".split())
#: What stands before a sign, read backwards from it, and after it: after a bare "at" the domain ends in letters.
_NAME_BEFORE, _DOTS_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789%+-"), re.compile(rf"{_DOTS}\Z", re.I)
_LONGEST_DOTS = 12
_MARKED = re.compile(rf"{_PLACE}(?:{_DOTS}{_PLACE})+", re.I)
_HOST = re.compile(rf"(?P<host>{_PLACE})(?:{_DOTS}{_PLACE})*?{_DOTS}(?P<end>[A-Za-z]{{2,24}})(?!{_DOTS}?[A-Za-z0-9-])", re.I)
_SIGNED_HOST = re.compile(rf"{_PLACE}(?:(?:{_DOT}|\x20(?:{_DOT_WORD})\x20){_PLACE})+", re.I)
_AT_SIGN = re.compile(rf"(?P<marked>{_AT})|(?P<bare>\x20(?:{_AT_WORD})\x20)|\x20?@\x20?", re.I)
_SIGN = re.compile(rf"{_AT}|{_DOT}|\x20(?:{_AT_WORD}|{_DOT_WORD})\x20|\x20?@\x20?", re.I)
_ANY_AT = re.compile(rf"@|[(\[{{<_](?:{_AT_WORD})[)\]}}>_]|\x20(?:{_AT_WORD})\x20", re.I)
_ANY_DOT = re.compile(rf"[(\[{{<_](?:{_DOT_WORD}|\.)[)\]}}>_]|\x20(?:{_DOT_WORD})\x20", re.I)
#: Without a disguised dot only a disguised "at" before a host can be one.
_DISGUISED_AT = re.compile(rf"\x20@|@\x20|(?:[(\[{{<_](?:{_AT_WORD}|@)[)\]}}>_]\x20?|\x20(?:{_AT_WORD})\x20){_PLACE}\.[A-Za-z0-9]", re.I)


def _maybe_address(text: str) -> bool:
    """Whether a text, however long, holds both signs of an address and one of them is disguised."""
    return bool(_DISGUISED_AT.search(text) or (_ANY_AT.search(text) and _ANY_DOT.search(text)))


def _name_start(text: str, end: int) -> int:
    """Where the name that ends there begins, with the parts that dots join to it; ``end`` if there is none."""
    begin = at = end
    while True:
        while at and text[at - 1] in _NAME_BEFORE:
            at -= 1
        if at == begin and begin != end or at == end:
            return begin
        begin = at
        dots = _DOTS_BEFORE.search(text, max(0, at - _LONGEST_DOTS), at)
        if not dots or not dots.start() or text[dots.start() - 1] not in _NAME_BEFORE:
            return begin
        at = dots.start()


def _said_address(name: str, host: re.Match) -> bool:
    """Whether a bare "at" between a name and a host is the sign of an address, and no word of prose.

    A host whose dots are disguised too was written for an address, whatever the name; with
    plain dots alone, words of prose before the host tell of a place.
    """
    first = host["host"].lower()
    return first not in _PROSE and first != "www" and (bool(_ANY_DOT.search(host[0])) or name.lower() not in _PROSE)


def _addresses(text: str):
    """Stretches of disguised addresses, each from its name to the end of its domain."""
    last = 0
    for sign in _AT_SIGN.finditer(text):
        if sign.start() < last:
            continue
        if sign["marked"]:
            host, bare = _MARKED.match(text, sign.end()), None
        elif sign["bare"]:
            host = bare = _HOST.match(text, sign.end())
        else:
            host = _HOST.match(text, sign.end()) or _SIGNED_HOST.match(text, sign.end())
            bare = None
        begin = max(last, _name_start(text, sign.start()))
        if not host or begin == sign.start():
            continue
        if bare and not _said_address(text[begin : sign.start()], bare):
            continue
        if host.re is _HOST and host["end"].lower() in _NO_END:
            continue
        yield begin, host.end()
        last = host.end()


_MAYBE_NUMBER = re.compile(rf"(?<!\w)(?:{_NUMBER})(?:{_GAP}|\x20(?:dot|point)\x20)(?:{_UNIT})(?!\w)|[0-9]{_GAP}(?:{_NUMBER})(?!\w)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[tuple[int, str, int]]:
    """Plain spans ``(start, kind, end)``: leftmost ones of each kind that do not overlap."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, "email", m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if "." in text:
        out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Rewritten:
    """A text after some transducers, with the source place of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a string for each of some stretches, given in order; it stands for the whole stretch."""
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            text.append(new)
            if b > a:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        self.text, self.start, self.end = "".join(text), start, end

    def look_alikes(self) -> None:
        edits = []
        for m in _ODD.finditer(self.text):
            c = m[0]
            new = "" if unicodedata.category(c) == "Cf" else LOOK_ALIKE.get(c)
            if new is None:
                plain = unicodedata.normalize("NFKC", c)
                number = unicodedata.digit(c, None)
                new = str(number) if number is not None else plain if plain.isascii() else c
            if new != c:
                edits.append((m.start(), m.end(), new))
        self.replace(edits)

    def addresses(self) -> None:
        edits = []
        for begin, end in _addresses(self.text):
            for s in _SIGN.finditer(self.text, begin, end):
                edits.append((s.start(), s.end(), "@" if _AT_SIGN.fullmatch(s[0]) else "."))
        self.replace(edits)

    def numbers(self) -> None:
        edits = []
        for m in _SPELLED.finditer(self.text):
            if not any(map(str.isalpha, m[0])):
                continue
            ends = [u.end() for u in _UNITS.finditer(self.text, m.end("plus") if m["plus"] else m.start(), m.end())]
            while ends and ends[-1] < len(self.text) and (self.text[ends[-1]].isalnum() or self.text[ends[-1]] == "_"):
                ends.pop()  # a number ends where a word does
            if len(ends) >= 4 and any(map(str.isalpha, self.text[m.start() : ends[-1]])):
                for s in _ONE.finditer(self.text, m.start(), ends[-1]):
                    word = s[0].lower()
                    new = DIGIT_WORDS[s["name"].lower()] if s["name"] else "+" if "plus" in word else "." if word.strip(" -,") else ""
                    edits.append((s.start(), s.end(), new))
        self.replace(edits)


def find_disguised(text: str, plain: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans that only a rewritten text shows and that are not equal to or inside a plain span of their kind."""
    odd = _ODD.search(text)
    seen = Rewritten(text)
    if odd:
        seen.look_alikes()
    address, number = _maybe_address(seen.text), _MAYBE_NUMBER.search(seen.text)
    if not (odd or address or number):
        return []
    if address:
        seen.addresses()
    if number:
        seen.numbers()
    if seen.text == text:
        return []
    out = []
    for a, kind, b in find(seen.text):
        start, end = seen.start[a], seen.end[b - 1]
        if seen.text[a:b] == text[start:end]:
            continue
        whole = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
        if whole and not any(k == kind and x <= start and end <= y for x, k, y in plain):
            out.append((start, kind, end))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def _scan(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            plain = find(text)
            more = find_disguised(text, plain)
            every = sorted([(s, False) for s in plain] + [(s, True) for s in more], key=lambda x: (x[0][0], KINDS.index(x[0][1])))
            digest = hashlib.sha256(joined(plain).encode()).hexdigest()
            rows.append((digest, joined(plain + more), [{"kind": k, "start": a, "end": b, "disguised": d} for (a, k, b), d in every]))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(span))], names=["id", "digest", "joined", "found"]
        )


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base_sha256, spans, found`` of every row, whole texts; null is empty.

    ``found`` lists ``(kind, start, end, disguised)`` in characters of the source, end
    exclusive; ``spans`` is the same as ``kind:start:end``, joined by commas; the digest
    covers the plain ones.  Repeated rows stay, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(_scan, f"id {kind}, digest string, joined string, found array<struct<kind:string,start:long,end:long,disguised:boolean>>")
    return got.select(F.col("id").alias(id_col), F.col("digest").alias("base_sha256"), F.col("joined").alias("spans"), "found")


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col``, counts of plain spans by kind, the digest, all spans, and counts of disguised ones."""
    got = detect(docs, id_col, **options)
    count = lambda k, d: F.size(F.filter("found", lambda s: (s["kind"] == k) & (s["disguised"] == d))).cast("long")
    plain = [count(k, False).alias(f"n_{k}") for k in KINDS]
    more = [count(k, True).alias(f"n_{k}_disguised") for k in KINDS]
    return got.select(id_col, *plain, "base_sha256", "spans", *more)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets.

    Of overlapping spans the first by place, then by the order of the kinds, is replaced.
    Null and empty texts stay as they are; texts are read whole, of any length, in linear
    time.  Repeated rows, ties and other columns of any name are kept; an empty table
    gives an empty one.
    """
    def masked(batches, at):
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    plain = find(text)
                    last, out = 0, []
                    for a, k, b in sorted(plain + find_disguised(text, plain), key=lambda s: (s[0], KINDS.index(s[1]))):
                        if a >= last:
                            out += [text[last:a], f"[{k}]"]
                        last = max(last, b)
                    text = "".join(out) + text[last:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), pa.array(texts, pa.string())], names=["row", "text"])

    wide = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    got = wide.mapInArrow(lambda it: masked(it, 1), wide.schema)
    return got.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
