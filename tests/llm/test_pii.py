import hashlib
import random
import re
import time

import pytest

from ledgerloom.llm import pii
from ledgerloom.llm.pii import KINDS, find, find_disguised, joined, luhn, mask, report

SCHEMA = "doc_id long, text string, spans string, n_ip int"


def brute(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(9)
    bits = ["a", "B.c", "@", ".", "-", "+", " ", "1", "25", "255", "4111 1111 1111 1111", "x@y.z", "@@", "(", ")", "é", "+1 (415) 555-2671", "1.2.3.4", "\n", "_", "%", "0001.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(find(text), key=lambda s: (s[0], KINDS.index(s[1]))) == brute(text), text
    assert find("1" * 200_000 + "a" * 200_000 + "@") == []


DISGUISED = {
    "email": ["john.doe (at) example (dot) com", "jane [at] mail.example.org", "bob at example dot com", "ann＠example．com", "jоhn@exаmple.com", "a.b at mail dot example dot org", "joe{at}site{dot}net", "x @ example dot com"],
    "ip": ["１９２.168.1.20", "192.168.⑴.20".replace("⑴", "¹"), "one nine two dot one six eight dot one dot two"],
    "card": ["four one one one one one one one one one one one one one one one", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 one one one one"],
    "phone": ["plus one four one five five five five two six seven one", "+١ 415 555 2671", "+1 four one five 555-2671"],
}
CLEAN = ["look at the dot on the map", "meet me at noon. dot com era", "one two three go", "Привет мир", "five at a time", "at at at", "the one at home dot", "κόσμος αβγ", "un deux trois nous irons au bois", "x² + y² = 1"]


def test_disguises_are_found_where_they_stand():
    for kind, said in DISGUISED.items():
        for text in said:
            whole = f"Write to: {text}, thanks"
            got = find_disguised(whole, find(whole))
            assert (10, kind, 10 + len(text)) in got, (text, got)


def test_clean_texts_stay_clean():
    for text in CLEAN:
        assert find(text) == [] and find_disguised(text, []) == [], text


def test_report_and_mask(spark):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "a@b.co and 10.0.0.1", "", 0), (3, "a@b.co and 10.0.0.1", "", 0), (None, "bob at example dot com", "", 0), (5, "w " * 40000 + "+1 (415) 555-2671", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(report(df).collect(), key=str)
    for r, row in zip(got, sorted(rows, key=lambda r: str(r[0])), strict=False):
        assert r.doc_id is None or r.base_sha256 == hashlib.sha256(joined(brute(next(t for i, t, *_ in rows if i == r.doc_id) or "")).encode()).hexdigest()
    one = next(r for r in got if r.doc_id == 3)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.spans) == (1, 1, 0, 0, "email:0:6,ip:11:19")
    hidden = next(r for r in got if r.doc_id is None)
    assert (hidden.n_email, hidden.n_email_disguised, hidden.spans) == (0, 1, "email:0:22")
    assert report(df.where("false")).collect() == []
    texts = [r.text for r in mask(df).where("doc_id = 3 or doc_id is null").collect()]
    assert sorted(texts) == ["[email]", "[email] and [ip]", "[email] and [ip]"]


REMAINDERS = {
    "email": ["pаul@example.com", "john@mail.exаmple.com", "jane@mail.example dot com", "john at example.com", "x @ example.com", "bob at mail.example dot it", "uwe (ät) example punkt de", "ana arroba example punto es", "luc arobase example point fr"]
    + [f"bob at example dot {end}" for end in "it at be dk no fi in me dev app".split()],
    "ip": ["1９2.168.1.20"],
    "phone": ["+1 415 555 26７1"],
}
PROSE = ["look at example.com", "available at www.example.com", "we met at noon.", "5 apples @ 3.50 each", "stay at the dot com hotel"]


def test_disguises_with_a_plain_remainder_are_found():
    for kind, said in REMAINDERS.items():
        for text in said:
            whole = f"Write to: {text}, thanks"
            got = find_disguised(whole, find(whole))
            assert (10, kind, 10 + len(text)) in got, (text, got)
    for text in PROSE:
        assert find(text) == [] and find_disguised(text, []) == [], text


def test_mask_leaves_no_remainder(spark):
    rows = [(1, f"to {text}, thanks", "", 0) for said in REMAINDERS.values() for text in said]
    want = sorted(f"to [{kind}], thanks" for kind, said in REMAINDERS.items() for _ in said)
    assert sorted(r.text for r in mask(spark.createDataFrame(rows, SCHEMA)).collect()) == want


@pytest.mark.parametrize("text", ["joe at " + "m" * 90 + " dot com", "joe@" + "m" * 5000 + " dot com", "joe (at) " + "a dot " * 900 + "com"])
def test_signs_may_stand_far_apart(text):
    assert find_disguised(text, find(text)) == [(0, "email", len(text))]


LONG = 200_000


@pytest.mark.parametrize(
    "text",
    ["one two " + "1" * LONG + "x", "one two " + "1 " * (LONG // 2) + "x", "a at b.com " + "q" * LONG, "x at y.com " + "a dot " * (LONG // 6), " at " * (LONG // 4) + "x.com", "j at k.com " + "a." * (LONG // 2), "@ " * (LONG // 2), "one" * (LONG // 3) + "z"],
)
def test_very_long_texts_end(text):
    start = time.perf_counter()
    find_disguised(text, find(text))
    assert time.perf_counter() - start < 10


def test_letters_of_other_scripts():
    text = "mail Ꭺnna@exaмрle.com and օsсar@site.org".replace("м", "m")
    assert [k for _, k, _ in find_disguised(text, find(text))] == ["email", "email"]


@pytest.mark.parametrize("name", ["info", "me", "shop", "online", "sales"])
def test_a_disguised_dot_decides_for_an_address(name):
    text = f"Write to {name} at example dot com today."
    assert pii.find_disguised(text, pii.find(text)) == [(9, "email", 9 + len(name) + len(" at example dot com"))]


@pytest.mark.parametrize("text", ["We are online at example.com today.", "look at the dot com boom", "visit us at www dot example dot com"])
def test_places_are_no_addresses(text):
    assert pii.find_disguised(text, pii.find(text)) == []
