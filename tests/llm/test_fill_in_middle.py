import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.fill_in_middle import LINE, report, restore, sql, transform

TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\n\nb\n", "x<P>y\nz", "<S>", "<M>\n", "<P", "P>\n<P\n<S", "é ü\r\nß\tx\n" * 5, "日本\n語" * 9, "𝒳\n𝒴" * 4, "line\n" * 300, "one line " * 40_000, "w\n" * 60_000]


def lines(text):
    """Units by hand, character by character."""
    found, now = [], ""
    for c in text:
        now += c
        if c == "\n":
            found.append(now)
            now = ""
    return found + [now] * bool(now)


def brute(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    unit = lines(text)
    a, b = sorted((h1 % (len(unit) + 1), h2 % (len(unit) + 1)))
    p, m, s = ("".join(unit[i:j]) for i, j in ((0, a), (a, b), (b, len(unit))))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return text, "plain", len(unit), None, None
    if h4 % 100 < spm:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(unit), len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(unit), len(p), len(m)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, output string, form long, `row` int, `a.b` string").repartition(3)


def test_equals_brute_force_and_is_restored(spark):
    rows = [(k, t, "o", 1, 2, "c") for k, t in enumerate(TEXTS * 4)] + [(6, TEXTS[6], "o", 1, 2, "c")] * 2
    got = transform(frame(spark, rows)).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert sorted(((r["output"], r.form, r.n, r.prefix_chars, r.middle_chars) for r in got), key=repr) == want
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.back == text[r["row"].doc_id] for r in got)
    assert got[0]["row"].asDict().keys() == {"doc_id", "output", "form", "row", "a.b"}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_equals_sql(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS[:-1] * 5)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, report(df).collect())) == sorted(con.execute(sql()).fetchall())
    assert report(df.where("false")).count() == 0


def test_rates_seed_and_null_ids(spark):
    df = spark.createDataFrame([(k, "a\nb\nc\n") for k in range(300)] + [(None, "a\nb")], "doc_id long, text string")
    assert {r.form for r in transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in transform(df, spm=100).collect()} == {"spm"}
    got = {r["row"].doc_id: r for r in transform(df, seed=11, rate=40, spm=30).collect()}
    assert all((got[k]["output"], got[k].form) == brute(k, "a\nb\nc\n", 11, 40, 30)[:2] for k in range(300))
    assert got[None]["output"] == brute("", "a\nb", 11, 40, 30)[0]


def test_other_units_and_sentinels(spark):
    marks = ("|pre|", "|suf|", "|mid|")
    with pytest.raises(ValueError, match="overlap"):  # the end of one starts the other
        transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=marks)
    marks = ("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(k, "one two  three four") for k in range(40)], "doc_id long, text string")
    got = transform(df, unit=r"\S+\s*|\s+", sentinels=marks).withColumn("back", restore(F.col("output"), F.col("form"), marks)).collect()
    assert {(r.n, r.back) for r in got} == {(4, "one two  three four")}
    assert {r.prefix_chars for r in got} <= {0, 4, 9, 15, 19}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n\r\u0085é", max_size=40))
def test_captures_are_the_lines(text):
    import regex

    ends = regex.compile(f"((?>{LINE}))*+").fullmatch(text).ends(1)
    found = lines(text)
    assert ends == [sum(map(len, found[: k + 1])) for k in range(len(found))]
