"""Pseudonyms against an independent Feistel network, and texts that a careless pattern would be slow on."""

import hashlib
import re
import time

from telemill.llm import pii

ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def digest(key, *parts):
    return hashlib.sha256("\u0001".join([key, *map(str, parts)]).encode()).hexdigest()


def shift(half, d):
    out = ""
    for k, c in enumerate(half):
        by = int(d[2 * (k % 32) : 2 * (k % 32) + 2], 16)
        alphabet = next((a for a in ALPHABETS if c in a), None)
        run = next(((a, b) for a, b in pii.LETTERS if a <= ord(c) <= b), None)
        if alphabet:
            c = alphabet[(alphabet.index(c) + by) % len(alphabet)]
        elif run:
            c = chr(run[0] + (ord(c) - run[0] + by) % (run[1] - run[0] + 1))
        elif c.isalpha():
            c = chr(ord(c) // 32 * 32 + (ord(c) % 32 + by) % 32)
        out += c
    return out


def feistel(value, key):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = shift(left, digest(key, k, right))
        else:
            right = shift(right, digest(key, k, left))
    return left + right


def texts(spark, values, key="k"):
    rows = pii.pseudonymise(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string"), key).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_local_parts_of_any_script(spark):
    names = ["ann.lee+7", "мария", "Ünal", "名前", "łukasz", "ΑΣ.x", "עברית"]
    got = texts(spark, [f"to {n}@mail.ru now" for n in names])
    for name, text in zip(names, got):
        assert text == f"to {feistel(name, 'k/email')}@mail.ru now" and name not in text


def test_social_security_numbers_stay_issuable(spark):
    values = [f"{100 + k % 560:03d}-{1 + k % 99:02d}-{1 + 37 * k % 9999:04d}" for k in range(1500)]
    values = [v for v in dict.fromkeys(values) if not re.search(pii.NEVER_ISSUED, v)]
    want = []
    for v in values:
        x = feistel(v, "k/ssn")
        while re.search(pii.NEVER_ISSUED, x):
            x = feistel(x, "k/ssn")
        want.append(x)
    assert texts(spark, values) == want and len(set(want)) == len(values)


def test_cards_and_phones(spark):
    got = texts(spark, ["card 4111 1111 1111 1111.", "call 415-555-2671", "+1 (415) 555-2671 or so"])
    digits = re.sub("[^0-9]", "", got[0])
    assert digits[:-1] == feistel("411111111111111", "k/card") and re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}\.", got[0])
    assert got[1] == "call " + feistel("415-555-2671", "k/number")
    assert got[2] == "+1 " + feistel("(415) 555-2671", "k/number") + " or so"


def test_an_address_right_after_another_value(spark):
    (got,) = texts(spark, ["4111 1111 1111 1111ann@mail.org"])
    assert "ann@" not in got and got.endswith(feistel("ann", "k/email") + "@mail.org")


def test_very_long_texts(spark):
    run, dots = "a" * 1_000_000, "x@" + "b." * 300_000 + "!"
    began = time.time()
    got = texts(spark, [run, f"{run} ann@mail.org", "@" * 200_000, "1." * 200_000, dots, "a@" * 200_000])
    assert time.time() - began < 60
    assert got[0] == run and got[1] == f"{run} {feistel('ann', 'k/email')}@mail.org" and got[2:4] == ["@" * 200_000, "1." * 200_000]


def test_keys_and_odd_rows(spark):
    rows = [(1, "ann@mail.org", "z"), (1, "ann@mail.org", "z"), (None, "ann@mail.org", None), (2, None, "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    one, two = ([r.text for r in pii.pseudonymise(docs, k).collect()] for k in ("a", "b"))
    assert one[0] == one[1] == one[2] != two[0] and one[3:] == [None, ""]
    drawn = [r.text for r in pii.pseudonymise(docs).collect()]
    assert drawn[0] == drawn[1] == drawn[2] and drawn[0] not in (one[0], "ann@mail.org")
