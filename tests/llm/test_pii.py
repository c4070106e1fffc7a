"""Surrogates against planted entities: what was planted, and nothing else, is replaced; whatever the text holds."""

from __future__ import annotations

import random
import re

from spotlake.llm import pii

FILL = ["rain fell", "on the hills", "at 10:30", "over 3 days", "chapter 12", "about 45%", "and so on", "the year 1999", "Am Abend", "Она шла"]


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in pii.replace_entities(docs, "key").collect()}


def luhn_total(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))


def with_check_digit(digits):
    return next(digits + c for c in "0123456789" if luhn_total(digits + c) % 10 == 0)


def planted(rng):
    """(kind, what stands in the text) by plain rules, without the operator's patterns."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    low = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    any_case = lambda n: "".join(rng.choice("abcXYZ0189") for _ in range(n))
    return [
        ("email", f"{low(6)}.{low(4)}@{low(8)}.com"),
        ("email", f"{low(3)}+{d(2)}@mail.{low(5)}.co.uk"),
        ("ip", ".".join(str(rng.randrange(1, 255)) for _ in range(4))),
        ("ssn", f"{rng.randrange(100, 900)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        ("phone", f"+1 ({rng.randrange(200, 999)}) 555-{d(4)}"),
        ("phone", f"({rng.randrange(200, 999)}) 555-{d(4)}"),
        ("card", with_check_digit("4" + d(14))),
        ("hex", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64, 200])))),
        ("key", "ghp_" + any_case(36)),
        ("key", "AKIA" + "".join(rng.choice("ABCXYZ019") for _ in range(16))),
        ("key", "sk-" + any_case(rng.choice([24, 500]))),
    ]


def test_planted_entities_and_nothing_else(spark):
    rng = random.Random(21)
    texts, held = [], []
    for _ in range(40):
        items = [rng.choice(planted(rng)) for _ in range(rng.randrange(4))]
        words, order = [rng.choice(FILL)], []
        for kind, raw in items:
            words += [raw, rng.choice(FILL)]
            order.append((kind, raw))
        texts.append(" | ".join(words))
        held.append(order)
    got, seen = replaced(spark, texts), {}
    for i, (text, order) in enumerate(zip(texts, held, strict=True)):
        assert got[i].n_entities == len(order), (text, got[i].text)
        before, after = text.split(" | "), got[i].text.split(" | ")
        assert len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            kind = dict((raw, k) for k, raw in order).get(a)
            if kind is None:
                assert a == b
            else:
                assert a != b and seen.setdefault(a, b) == b and shape(kind, a) == shape(kind, b)
    assert len(set(seen.values())) == len(seen)


def shape(kind, s):
    """What a surrogate has to share with its entity."""
    if kind == "email":
        return s.count("@")
    if kind == "ip":
        return s.count("."), all(int(x) < 256 for x in s.split("."))
    if kind == "hex":
        return len(s), s == s.lower(), re.fullmatch("[0-9a-f]+", s) is not None
    if kind == "key":
        return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    digits = re.sub(r"\D", "", s)
    return re.sub(r"\d", "0", s), kind != "card" or luhn_total(digits) % 10


def test_keys_that_differ_in_case_stay_two(spark):
    a, b = "ghp_" + "aB3" * 12, "ghp_" + "Ab3" * 12
    got = replaced(spark, [f"x {a} y", f"x {b} y {a}"])
    first, second = got[0].text.split()[1], got[1].text.split()[1]
    assert first != second and got[1].text.split()[3] == first
    assert shape("key", first) == shape("key", a) and shape("key", second) == shape("key", b)


def test_a_person_keeps_one_name(spark):
    texts = [
        "Mr. Smith met Dr. Smith. Mr. John Smith paid; John Smith left. Johnny Smith did not.",
        "Mrs. Smith and Miss Ann Smith; Ann Smith; Dr. Smith",
        "Mr. Smith and Mrs. Smith and Dr. Smith",
        "Herr SMITH rang. Dr. John Smith",
        "John Smith without a title",
        "г-н Иванов и г-жа Иванова, κ. Παππας",
    ]
    got = {i: r.text for i, r in replaced(spark, texts).items()}
    he = re.match(r"Mr\. (\w+) met Dr\. (\w+)\. Mr\. (\w+) (\w+) paid; (\w+) (\w+) left\. Johnny Smith did not\.$", got[0]).groups()
    assert len({he[0], he[1], he[3], he[5]}) == 1 and he[2] == he[4] != he[0] and "John " not in got[0]
    she = re.match(r"Mrs\. (\w+) and Miss (\w+) (\w+); (\w+) (\w+); Dr\. (\w+)$", got[1]).groups()
    assert len({she[0], she[2], she[4], she[5]}) == 1 and she[1] == she[3] and she[0] != he[0]
    both = re.match(r"Mr\. (\w+) and Mrs\. (\w+) and Dr\. (\w+)$", got[2]).groups()
    assert both[:2] == (he[0], she[0]) and len(set(both)) == 3
    loud = re.match(r"Herr (\w+) rang\. Dr\. (\w+) (\w+)$", got[3]).groups()
    assert loud == (he[0].upper(), he[2], he[0])
    assert got[4] == texts[4]
    assert re.fullmatch(r"г-н [А-я]+в и г-жа [А-я]+ва, κ\. [Ͱ-Ͽ]+ς", got[5])


def test_named_values_count_whole(spark):
    values = ["opensesame", "P@ss-w0rd!x", "Ab" * 2500 + "9", "12345678", "пароль-тайна", "a.b/c_d~e+f"]
    texts = [f'password = "{v}" end' for v in values] + [f"api_key='{v}' end" for v in values] + ["token: yesterday", "the secret: nothing more", "password=short"]
    got = replaced(spark, texts)
    for i, value in enumerate(values + values):
        before, after = texts[i].split(value)
        assert got[i].n_entities == 1 and got[i].text.startswith(before) and got[i].text.endswith(after) and value not in got[i].text
    assert [got[i].text == texts[i] for i in range(12, 15)] == [True, True, True]


def test_texts_of_a_megabyte(spark):
    hostile = {
        "a@b" + ".c" * 400_000: 1, "z" * 1_000_000: 0, "a." * 500_000 + "@": 0, "a@" * 500_000: 0, "1" * 1_000_000: 1, "1." * 500_000: 0, "+1 " * 300_000: 0, "Mr. A" + "b" * 1_000_000: 1, "Mr. " * 250_000: None,
        "password=" * 100_000: None, "password: " + "x" * 1_000_000: 0, "password: '" + "x" * 1_000_000: 1, "0a" * 500_000: 1, "4111 " * 200_000: None, "AKIA" * 250_000: 1, "sk-" * 300_000: 0, "1-" * 400_000: 0, "(" * 500_000: 0, "é@" * 400_000: 0,
    }
    got = replaced(spark, list(hostile))
    for i, (text, n) in enumerate(hostile.items()):
        assert n is None or got[i].n_entities == n, (i, got[i].n_entities)
        assert n != 0 or got[i].text == text
    assert len(got) == len(hostile)


def test_dense_numbers_find_room(spark):
    """A corpus that holds every number of a form still gets distinct surrogates that aren't its own numbers."""
    entities = [("ssn", f"{i:03d}") for i in range(1000)]
    cores = [r.core for r in pii.surrogates(spark.createDataFrame(entities, "kind string, canon string"), "key").collect()]
    assert len(set(cores)) == 1000 and not set(cores) & {c for _, c in entities}
