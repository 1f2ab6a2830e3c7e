import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from loomlog.llm import pii_surrogates
from loomlog.llm.pii_surrogates import entity_table, pseudonymise

TEXTS = [
    "Mail Und.34@mail7.example.com or und.34@Mail7.example.com, +1 (017) 555-7713; card 4539 1488 0343 6467, ip 97.51.17.173.",
    "Mr. John Smith met Mrs Jane Smith and Dr Smith. Госпожа Анна Иванова. Κύριος Νίκος Παππάς",
    "again +1 017 555 7713 and 4539148803436467",
    None,
    "",
    "nothing here 12 34",
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonymise(docs, "key").collect()}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_format_type_and_coreference(rows):
    new = rows[0].text
    mails = re.findall(r"\S+@[\w.]+[a-z]", new)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0][0].isupper() and mails[0].endswith(".com")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", new) and "555-7713" not in new and "97.51.17.173" not in new
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert luhn(card) and card in rows[2].text and card != "4539148803436467"
    phone = re.sub(r"\D", "", re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)[0])
    assert phone in re.sub(r"\D", "", rows[2].text)


def test_gender_script_and_names(rows):
    words = re.findall(r"[^\W\d_]+", rows[1].text)
    assert words[0] == "Mr" and words[1].endswith("n") and words[5].endswith("nna") and words[2] == words[6] == words[9]
    assert re.search("Госпожа [А-я]+нна [А-я]+рт", rows[1].text) and re.search("Κύριος [Α-ω]+ς [Α-ω]+ρτης", rows[1].text)


def test_odd_tables(rows, odd_docs, no_docs):
    assert (rows[3].text, rows[3].n_entities, rows[4].text, rows[5].text) == (None, 0, "", TEXTS[5])
    out = pseudonymise(odd_docs, "key")
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in odd_docs.collect()))) and pseudonymise(no_docs, "key").count() == 0
    for r, t in ((rows[k], TEXTS[k]) for k in (0, 1, 2)):
        assert len(r.entities) == r.n_entities and all(t[e.start : e.end] for e in r.entities)


def test_collisions_draw_again(spark, monkeypatch):
    """With octets of one or two values to draw, every entity but a few collides at first; the results are still distinct and stable."""
    monkeypatch.setattr(pii_surrogates, "MAX_DRAWS", 60)
    real = pii_surrogates.drawn
    monkeypatch.setattr(pii_surrogates, "drawn", lambda key, kind, canon, draw: F.transform(real(key, kind, canon, draw), lambda v: v % 2))
    docs = spark.createDataFrame([(k, f"from 10.0.0.{k} to 10.0.0.{(k * 7) % 10}") for k in range(10)], "doc_id long, text string")
    table = entity_table(docs, "key").collect()
    assert len({t.surrogate for t in table}) == len(table) == 10 and max(t.draw for t in table) > 0
    lookup = {t.canon: t.surrogate for t in table}
    for r in pseudonymise(docs, "key").collect():
        assert r.text == f"from {lookup[f'10.0.0.{r.doc_id}']} to {lookup[f'10.0.0.{(r.doc_id * 7) % 10}']}"


def test_what_is_written_for_numbers_with_a_country_code_is_distinct(spark, monkeypatch):
    """With two digits to draw, surrogates that differ in the country's digits alone would be written as one number."""
    real = pii_surrogates.drawn
    monkeypatch.setattr(pii_surrogates, "MAX_DRAWS", 60)
    monkeypatch.setattr(pii_surrogates, "drawn", lambda key, kind, canon, draw: F.transform(real(key, kind, canon, draw), lambda v: v % 2))
    texts = [f"+1 20 3{k}" for k in range(8)] + ["+1 10 10", "+1 01 01", "+1 11 11"]
    out = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    new = {r.text for r in out}
    assert len(new) == len(texts) and not new & set(texts) and all(re.fullmatch(r"\+1 \d\d \d\d", x) for x in new)


def test_more_entities_than_a_format_or_the_draws_can_hold(spark, monkeypatch):
    """One draw only; 400 addresses in a format of 676 leave 276 free values, 30 surnames meet 8 names of three syllables."""
    monkeypatch.setattr(pii_surrogates, "MAX_DRAWS", 1)
    real = pii_surrogates.drawn
    monkeypatch.setattr(pii_surrogates, "drawn", lambda key, kind, canon, draw: F.transform(real(key, kind, canon, draw), lambda v: v % F.when(kind == "surname", 2).otherwise(65536)))
    abc = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{abc[k // 20]}@{abc[k % 20]}.com" for k in range(400)]
    texts = mails + [f"Dr Sm{abc[k % 26]}th{abc[k // 26]}" for k in range(30)]
    new = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert len(set(new.values())) == len(texts) and not set(new.values()) & set(texts)
    short = [x for x in new.values() if re.fullmatch(r"[a-z]@[a-z]\.com", x)]
    assert len(short) == 276 and all(re.fullmatch(r"[a-z]+@[a-z]\.com", new[k]) for k in range(400))


def test_spellings_of_numbers_and_bare_names(spark):
    texts = [
        "+14155550123; +1 415 555 0123; 415-555-0123, (415) 555-0123 and 415.555.0123",
        "+44 20 79460958; +442079460958; +49 30 12345678; +33 1 23 45 67 89; +4930123456789.",
        "Mr. John Smith came. John Smith said that Smith's Smithson is John.",
        "John Smith and Smithson; 100-200-3000-4, 1.415.555.0123",
    ]
    rows = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    us = [re.sub(r"\D", "", x) for x in re.findall(r"[+(]?[\d ().-]*\d", rows[0].text)]
    assert len(us) == 5 and us[0] == us[1] and us[0][0] == "1" and len({*us[2:]}) == 1 and "5550123" not in "".join(us)
    assert re.fullmatch(r"\+1\d{10}; \+1 \d{3} \d{3} \d{4}; \d{3}-\d{3}-\d{4}, \(\d{3}\) \d{3}-\d{4} and \d{3}\.\d{3}\.\d{4}", rows[0].text)
    parts = re.fullmatch(r"\+44 (\d\d) (\d{8}); \+44(\d{10}); \+49 \d\d \d{8}; \+33 \d \d\d \d\d \d\d \d\d; \+49\d{11}\.", rows[1].text)
    assert parts and parts[1] + parts[2] == parts[3] != "2079460958" and [e.kind for e in rows[1].entities] == ["phone"] * 5
    first, last = rows[2].text.split()[1:3]
    assert rows[2].text == f"Mr. {first} {last} came. {first} {last} said that {last}'s Smithson is {first}." != texts[2]
    assert [texts[2][e.start : e.end] for e in rows[2].entities] == ["Mr. John Smith", "John", "Smith", "Smith", "John"]
    assert rows[3].text == texts[3] and rows[3].n_entities == 0


@pytest.mark.parametrize("sent", [0, 100])
def test_later_draws_reach_the_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(pii_surrogates, "SENT", sent, raising=False)
    real = pii_surrogates.drawn
    monkeypatch.setattr(pii_surrogates, "drawn", lambda key, kind, canon, draw: F.transform(real(key, kind, canon, draw), lambda v: v % 2))
    texts = [f"Dr Smith{'abcdefghij'[k]}" for k in range(10)] + ["none", None]
    new = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()]
    assert len(new) == 12 == len(set(new)) and {"none", None} == set(new) & set(texts)


def test_hostile_texts(spark):
    """A million characters that invite recursion or backtracking: no crash, whole results, in seconds."""
    texts = ["a@" + "b." * 500_000 + "com", "a." * 500_000 + " x@y.com", "1." * 500_000, "+1 2 " * 200_000, "Mr A" + "b" * 1_000_000, "a@b" * 300_000, "x@y.com " * 50_000]
    begin = time.perf_counter()
    out = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert len(out) == len(texts) and out[1].text.startswith("a." * 500_000) and not out[1].text.endswith("x@y.com")
    assert out[6].n_entities == 50_000 and "x@y.com" not in out[6].text and time.perf_counter() - begin < 240


def test_many_names_of_one_text(spark):
    """Time grows with the names of a text, not with their square."""

    def seconds(n):
        words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(4)) for k in range(n)]
        text = " ".join(f"Mr B{w} Z{w}" for w in words) + " " + " ".join(f"B{w} Q{w}" for w in reversed(words))
        begin = time.perf_counter()
        row = pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").first()
        mentions, bare = row.text.split(" ")[: 3 * n], row.text.split(" ")[3 * n :]
        assert row.n_entities == 2 * n and bare[1::2] == [f"Q{w}" for w in reversed(words)] and bare[::2] == mentions[1::3][::-1]
        assert len(set(mentions[1::3])) == n
        return time.perf_counter() - begin

    seconds(100)
    few, many = seconds(4_000), seconds(16_000)
    assert many < 8 * few + 20


def test_titles_without_gender(spark):
    texts = ["Dr Anna Smith wrote. Mrs Anna Smith agreed, Anna left.", "Dr Anna Smith alone.", "Prof Anna Jones and Mr Anna Brown."]
    new = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "key").collect()]
    dr, mrs, bare = re.fullmatch(r"Dr (\w+) \w+ wrote\. Mrs (\w+) \w+ agreed, (\w+) left\.", new[0]).groups()
    assert dr == mrs == bare and dr.endswith("nna")
    assert re.fullmatch(r"Dr \w+l \w+rt alone\.", new[1])
    prof, mr = re.fullmatch(r"Prof (\w+) \w+ and Mr (\w+) \w+\.", new[2]).groups()
    assert prof == mr and mr.endswith("n")


def plain_kind(e):
    if "@" in e:
        return "email"
    if re.fullmatch(r"\d+(?:\.\d+){3}", e):
        return "ip"
    return "card" if regex.fullmatch(pii_surrogates.CARD, e) else "phone" if e[0] in "+(0123456789" else "name"


def plain_parts(e, known):
    kind, digits = plain_kind(e), re.sub(r"\D", "", e)
    if kind == "email":
        return [(kind, e.lower())]
    if kind in ("card", "phone"):
        return [(kind, "+" + re.sub(f"^({pii_surrogates.COUNTRY}|)", r"\1 ", digits) if e[0] == "+" else digits)]
    if kind == "ip":
        return [(kind, e)]
    words = e.split(" ")
    if len(words) == 1:
        return [max(p for p in known if p[1] == e.lower())]
    title = words[0].rstrip(".")
    given = ("given:" + ("female" if title in pii_surrogates.FEMALE else "male" if title in pii_surrogates.MALE else "any"), words[1].lower())
    if title in pii_surrogates.NEUTRAL:
        given = max([p for p in known if p[0].startswith("given:") and p[1] == given[1]], default=given)
    last = ("surname", words[-1].lower())
    return [given, last] if len(words) > 2 else [last]


def plain_rewrite(text, table):
    entities = [m[0] for m in regex.finditer(pii_surrogates.ANY, text)]
    names = [e for e in entities if plain_kind(e) == "name"]
    known = {p for e in names for p in plain_parts(e, [])}
    bare = "|".join(dict.fromkeys(w for e in names for w in e.split(" ")[1:]))
    pattern = pii_surrogates.ANY + (r"|(?<![\p{L}\p{N}])(?:" + bare + r")(?![\p{L}\p{N}])" if names else "")
    spans = []

    def new(m):
        e, kind = m[0], plain_kind(m[0])
        spans.append((kind, m.start(), m.end()))
        made = [table[p] for p in plain_parts(e, known)]
        if kind == "name":
            return re.match(r"(?:\S+ )?", e)[0] + " ".join(x[0].upper() + x[1:] for x in made)
        if kind == "email":
            more = len(made[0]) - len(e)
            return made[0][:more] + "".join(b.upper() if a.isupper() else b for a, b in zip(e, made[0][more:]))
        if kind == "ip":
            return made[0]
        digits = iter(re.sub(r"\D", "", made[0]))
        return "".join(next(digits) if c.isdigit() else c for c in e) + "".join(digits)

    return regex.sub(pattern, new, text), spans


def test_random_texts_equal_a_plain_version(spark, rng):
    given, sur = ["Anna", "Jon", "Maria", "Иван", "Νίκος", "Élise"], ["Smith", "Jones", "Iron", "Петров", "Παππάς"]

    def entity():
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        name = rng.choice(["Mr", "Mrs.", "Dr", "Prof.", "Frau", "Господин", "Κυρία"])
        return rng.choice(
            [
                lambda: f"{name} {rng.choice(given)} {rng.choice(sur)}",
                lambda: f"{name} {rng.choice(sur)}",
                lambda: rng.choice(given + sur),
                lambda: f"{rng.choice(['a.b', 'Jo', 'x_1'])}{d(1)}@{rng.choice(['mail', 'Web'])}.{rng.choice(['com', 'co.uk'])}",
                lambda: f"{rng.randint(1, 300)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
                lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
                lambda: f"+{rng.choice(['1', '44', '49', '420'])} {d(3)} {d(3)} {d(4)}",
                lambda: f"({d(3)}) {d(3)}-{d(4)}",
                lambda: f"+44{d(10)}",
            ]
        )()

    texts = ["".join(rng.choice([" ", ", ", ". ", " said ", "\n", "é", "(", "12 "]) + entity() for _ in range(rng.randint(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = {(t.kind, t.canon): t.surrogate for t in entity_table(docs, "key").collect()}
    assert len({(k, s) for (k, _), s in table.items()}) == len(table) and not {(k, s) for (k, _), s in table.items()} & set(table)
    for r in pseudonymise(docs, "key").collect():
        want, spans = plain_rewrite(texts[r.doc_id], table)
        assert r.text == want and [(e.kind, e.start, e.end) for e in r.entities] == spans


def test_ten_thousand_numbers_of_one_country_code(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.format_string("+44 %07d", F.col("id") * 997).alias("text"))
    new = pseudonymise(docs, "key").select("text").distinct().collect()
    assert len(new) == 10_000 and not {r.text for r in new} & {r.text for r in docs.collect()}
