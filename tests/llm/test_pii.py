import hashlib
import re

import pytest

from bidweave.llm.pii import KINDS, pseudonymise

KEY = "secret"


def _luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def _hash(*parts, bits):
    digest = hashlib.sha256 if bits == 256 else hashlib.sha512
    return digest("|".join(map(str, (KEY, *parts))).encode()).hexdigest()


def _feistel(x, y, a, b, tweak):
    for i in range(10):
        f = int(_hash(tweak, i, y if i % 2 == 0 else x, bits=256)[:15], 16)
        if i % 2 == 0:
            x = (x + f) % a
        else:
            y = (y + f) % b
    return x, y


def _halves(digits, tweak):
    u = len(digits) // 2
    v = len(digits) - u
    x, y = _feistel(int(digits[:u]), int(digits[u:]), 10**u, 10**v, tweak)
    return f"{x:0{u}d}{y:0{v}d}"


def _run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return [r["text"] for r in pseudonymise(docs, key=KEY).orderBy("doc_id").collect()]


def test_card_and_phone_against_brute_force(spark):
    card, phone = "4785380592391139", "+1 (743) 555-3824"
    out = _run(spark, [f"pay {card} now", f"call {phone}.", "4785-3805-9239-1139", "(743) 555-3824", "17435553824"])
    body = "4" + _halves(card[1:-1], "card164")
    check = next(c for c in "0123456789" if _luhn(body + c))
    assert out[0] == f"pay {body}{check} now" and _luhn(body + check)
    digits = _halves("7435553824", "phone1")
    assert out[1] == f"call +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}."
    assert re.sub(r"\D", "", out[2]) == body + check and out[2].count("-") == 3
    assert re.sub(r"\D", "", out[3]) == digits
    assert out[4] == "17435553824"


def test_two_kinds_with_only_a_space_between(spark):
    values = [
        ("email", "12.bob@mail.example.com"), ("ipv4", "190.137.223.204"), ("iban", "DE89370400440532013000"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "219-09-9999"),
        ("date", "2020-01-05"), ("date", "17.05.1990"), ("date", "05/17/1990"), ("card", "4785 3805 9239 1139"), ("card", "4785-3805-9239-1139"), ("card", "4785380592391139"),
        *[("phone", p) for p in ("+1 (826) 555-4081", "+1 826 555 4081", "+44 20 7946 0958", "+33 1 23 45 67 89", "+442079460958", "+49 (30) 1234 5678", "(743) 555-3824", "743-555-3824")],
    ]
    texts = [f"{a} {b}" for _, a in values for _, b in values]
    alone = _run(spark, [v for _, v in values])
    assert all(new != old for new, (_, old) in zip(alone, values))
    out = _run(spark, texts)
    assert [(t, o) for t, o, w in zip(texts, out, [f"{a} {b}" for a in alone for b in alone]) if o != w] == []


def test_phone_is_bounded_by_its_digits(spark):
    out = _run(spark, ["+1 (826) 555-4081 12345", "+44 20 7946 0958 12345", "+44 20 7946 0958 743-555-3824 and 2020-01-05", "+1 190.137.223.204", "+44 743-555-3824", "+44 20 7946 0958 4785 3805 9239 1139 2020-01-05"])
    assert out[0].endswith(" 12345") and not out[0].startswith("+1 (826) 555-4081") and out[1].endswith(" 12345") and not out[1].startswith("+44 20 7946 0958")
    assert not re.search("0958|743|3824|2020-01-05", out[2]) and out[3].startswith("+1 ") and "190.137" not in out[3]
    assert out[4].startswith("+44 ") and "743-555" not in out[4]
    assert not re.search("7946 0958|4785 3805|2020-01-05", out[5])


def test_formats_are_kept_and_values_linked(spark):
    texts = [
        "mail that.92@mail2.example.com and THAT.92@mail2.example.com", "at 10.20.30.40, or 10.20.30.40", "DE89370400440532013000 and DE89 3704 0044 0532 0130 00", "born 1990-05-17 or 17.05.1990 or 05/17/1990 or 5/17/1990", "ssn 219-09-9999",
    ]
    out = _run(spark, texts)
    local = re.findall(r"(\S+)@mail2\.example\.com", out[0])
    assert local[0].upper() == local[1] and local[0] != "that.92" and re.fullmatch(r"[a-z]{4}\.\d\d", local[0])
    a, b = re.findall(r"\d+\.\d+\.\d+\.\d+", out[1])
    x, y = _feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "ipv4")
    assert a == b == f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    first, second = re.fullmatch(r"(DE\d{20}) and (DE[\d ]+)", out[2]).groups()
    assert first == second.replace(" ", "") != "DE89370400440532013000"
    assert int("".join(str(int(c, 36)) for c in first[4:] + first[:4])) % 97 == 1
    iso, dots, slashes, short = re.fullmatch(r"born (\S+) or (\S+) or (\S+) or (\S+)", out[3]).groups()
    y, m, d = iso.split("-")
    assert dots == f"{d}.{m}.{y}" and slashes == f"{m}/{d}/{y}" and [int(v) for v in short.split("/")] == [int(m), int(d), int(y)] and iso != "1990-05-17"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", out[4]) and out[4] != texts[4]


def test_what_is_not_valid_stays(spark):
    texts = ["4785380592391130", "999.1.1.1", "2023-02-30", "000-12-3456", "Version 3. and Version 2.0.", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", None, "", "a" * 30_000, "1" * 5000, "GB00XXXX00000000000000", "x@y", "31/31/2020"]
    assert _run(spark, texts) == texts


def test_dates_are_permuted_one_to_one(spark):
    import datetime

    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=k)).isoformat() for k in range(0, 73049, 37)]
    out = _run(spark, days)
    assert len(set(out)) == len(days) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in out)


def test_counts_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "4785380592391139 4785380592391139", 5)] * 2 + [(2, "nothing", 5)], "doc_id long, text string, value int")
    rows = pseudonymise(docs, key=KEY).collect()
    assert [len(r["pii"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [2, 2, 0] and rows[0]["text"] == rows[1]["text"]
    assert {p["kind"] for r in rows for p in r["pii"]} <= set(KINDS)
    assert pseudonymise(docs.limit(0), key=KEY).count() == 0
