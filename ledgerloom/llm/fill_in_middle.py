"""Fill-in-the-middle documents: each text is cut into prefix, middle and suffix at ends of units, and put in a new order.

A unit is a line by default.  One full match of the repeated unit keeps the end of every
repetition, so ``match.ends(1)`` gives the number of units and, by index, both cuts.  The
numbers that choose cuts and form are groups of the SHA-256 of seed and id: the same row is
cut alike in every run, on every executor and in any order.

Texts travel in Arrow batches and each is matched alone; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line with its end, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ADDED = "output string, form string, n long, prefix_chars long, middle_chars long"


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be told apart wherever text meets them: none may overlap itself or another."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    if len(set(sentinels)) != 3:
        raise ValueError("sentinels must differ")


def _draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of seed and id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cuts(unit: regex.Pattern, text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and where prefix and middle end."""
    ends = unit.fullmatch(text).ends(1)
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    unit: str = LINE,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """All rows and columns of ``docs`` in a struct ``row``, with ``output, form, n, prefix_chars, middle_chars``.

    ``rate`` percent of the texts are cut, ``spm`` percent of these start with the suffix.
    The form is ``plain`` and the output the text itself where a text is not chosen, is empty
    or holds a sentinel; the lengths, in code points, are null then.  Null texts count as
    empty, null ids as the empty id; repeated rows give the same row each; texts of any length
    are cut whole; an empty table gives an empty one; other columns, whatever their names,
    stay in ``row``.  ``unit`` must match every text when repeated, and must not match nothing.
    """
    _checked(sentinels)
    p, s, m = sentinels
    source = f"((?>{unit}))*+"  # what is matched stays matched, so no way back is kept for each unit
    held = regex.compile("|".join(map(regex.escape, sentinels)))

    def shaped(text: str, h: tuple[int, int, int, int], whole: regex.Pattern) -> tuple:
        n, at, to = cuts(whole, text, h[0], h[1])
        if not text or h[2] % 100 >= rate or held.search(text):
            return text, PLAIN, n, None, None
        prefix, middle, suffix = text[:at], text[at:to], text[to:]
        if h[3] % 100 < spm:
            return f"{s}{suffix}{p}{prefix}{m}{middle}", SPM, n, at, to - at
        return f"{p}{prefix}{s}{suffix}{m}{middle}", PSM, n, at, to - at

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = regex.compile(source)
        kinds = [pa.large_string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            draws = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            made = [shaped(t.as_py() or "", h, whole) for t, h in zip(batch.column(1), draws, strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema=_arrow(batch.schema.field(0)))

    def _arrow(row: pa.Field) -> pa.Schema:
        return pa.schema([row, ("output", pa.large_string()), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("int").alias("none"))
    sent = docs.select(rest.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(_draws(F.col(f"`{id_col}`"), seed))))
    out = T.StructType([T.StructField("row", sent.schema["row"].dataType), *T._parse_datatype_string(_ADDED).fields])
    return sent.mapInArrow(cut, out)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was cut, from output and form alone; null where the output is null."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    first, second, third = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == PSM, F.concat(first, third, second)).when(form == SPM, F.concat(second, third, first)).otherwise(output)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, ``n, form, prefix_chars, middle_chars`` and the digests of output and restored text."""
    got = transform(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", **options)
    sentinels = options.get("sentinels", SENTINELS)
    return got.select(
        F.col("row.id").alias(id_col),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form"), sentinels), 256).alias("restored_sha256"),
    )


def sql() -> str:
    """The default cut in DuckDB."""
    draws = ", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::bigint h{k + 1}" for k in range(4))
    return f"""
        with drawn as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) d from documents),
        lines as (select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') l, {draws} from drawn),
        chosen as (select *, len(l) n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) b,
                   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
                        when h4 % 100 < 50 then 'spm' else 'psm' end form from lines),
        cut as (select *, array_to_string(l[1:a], '') p, array_to_string(l[a + 1:b], '') m, array_to_string(l[b + 1:n], '') s from chosen)
        select doc_id, n::bigint n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars,
               case when form <> 'plain' then length(m)::bigint end middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                      else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
               sha256(t) restored_sha256
        from cut"""
