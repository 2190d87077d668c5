import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"0123459aZ@.-+ ()%é\n", "4111 1111 1111 1111", "10.2.3.", "a@b.c", "+1 (555)", "255", "000"]), max_size=25).map("".join))
def test_plain_spans_match_the_patterns(text):
    assert pii.find_plain(text) == plain_spans(text)


def test_disguises_map_back_to_the_source():
    cases = {
        "write to john.doe [at] example [dot] com now": ("email", "john.doe [at] example [dot] com"),
        "write to john at example dot co dot uk now": ("email", "john at example dot co dot uk"),
        "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "call ＋１ ５５５ １２３ ４５６７ x": ("phone", "＋１ ５５５ １２３ ４５６７"),
        "call plus one five five five one two three four five six seven.": ("phone", "plus one five five five one two three four five six seven"),
        "four one one one one one one one one one one one one one one one": ("card", "four one one one one one one one one one one one one one one one"),
        "host one nine two dot one six eight dot zero dot one up": ("ip", "one nine two dot one six eight dot zero dot one"),
        "llame al más tres cuatro seis uno dos tres cuatro cinco seis siete ocho": ("phone", "más tres cuatro seis uno dos tres cuatro cinco seis siete ocho"),
        "Rechner eins neun zwei punkt eins sechs acht punkt null punkt eins.": ("ip", "eins neun zwei punkt eins sechs acht punkt null punkt eins"),
        "écrire à jean.petit arobase exemple point fr merci": ("email", "jean.petit arobase exemple point fr"),
        "escriba a ana (arroba) correo (punto) es": ("email", "ana (arroba) correo (punto) es"),
        "x 10 dot 0 dot 0 dot 1 y": ("ip", "10 dot 0 dot 0 dot 1"),
        "4111​1111​1111​1111": ("card", "4111​1111​1111​1111"),
    }
    for text, (kind, span) in cases.items():
        plain, added = pii.find_all(text)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, span)], text
    for clean in ("one two three, look at the dot on page 5", "été à 10 heures", "he sat at home", "un dos tres", "at this point in time", "le point est un", "meet at gate point blank", "Меня зовут Анна"):
        assert pii.find_all(clean) == ([], [])


def test_addresses_in_plain_words():
    cases = ["jane at example.com", "jane at firma dot se", "jane dot doe at uni dot pl", "jane at mail dot co", "jane at mail.firma dot no", "j.doe at mail.example.org", "bob42 at firma.be"]
    for span in cases:
        for text in (span, f"please mail {span}, thanks"):
            plain, added = pii.find_all(text)
            assert not plain and [text[a:b] for a, _, b in added] == [span], text
    clean = ["look at the dot on page 5", "He worked at example.com for years.", "Available at github.com", "Shop at booking.com today", "visit us at example.org"]
    clean += ["she stared at every dot that moved", "read more at www.example.se", "They met at noon. Then he left.", "prices at 10.50 each"]
    for text in clean:
        assert pii.find_all(text) == ([], []), text


def test_query_shape_and_odd_rows(spark):
    long = "9" * 50_000 + " a" * 50_000 + "x@" * 20_000
    rows = [(1, "a@b.cd +1 (017) 555-7713"), (2, None), (2, None), (None, ""), (3, long), (4, "mail bob (at) b.org")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int")
    out = {(r["doc_id"]): r for r in pii.find_personal_data(docs, redacted=True).collect()}
    assert (out[1]["n_email"], out[1]["n_phone"], out[1]["spans"], out[1]["redacted"]) == (1, 1, "email:0:6,phone:7:24", "[EMAIL] [PHONE]")
    assert out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[2]["redacted"] is None
    assert (out[4]["n_email"], out[4]["n_added"], out[4]["redacted"]) == (0, 1, "mail [EMAIL]")
    assert out[1]["base_sha256"] == hashlib.sha256(b"email:0:6,phone:7:24").hexdigest()
    assert pii.find_personal_data(docs.where("false")).collect() == []
    assert docs.count() == 6


def test_long_texts_take_time_in_proportion():
    import time

    began = time.perf_counter()
    text = "a" + " " * 200_000 + "b (at) c.org " + "[" + " " * 200_000 + "x"
    assert len(pii.find_all(text)[1]) == 1
    many = " ".join(f"a{i}@b.com c{i} (at) d.com" for i in range(20_000))
    plain, added = pii.find_all(many)
    assert len(plain) == len(added) == 20_000
    assert time.perf_counter() - began < 10


def test_many_long_texts_in_one_batch(spark):
    docs = spark.range(20).selectExpr("id as doc_id", "concat(repeat('plain words here ', 300000), 'a@b.org') as text")
    assert docs.coalesce(1).select("doc_id", "text").count() == 20
    assert pii.find_personal_data(docs.coalesce(1)).where("n_email = 1").count() == 20
