import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import pii
from tests.llm.samples import SCHEMA, awkward, frame, with_clashing

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def card(n, joint="", group=4):
    """A number of n digits that passes Luhn, in groups."""
    head = "".join(str((7 * k + n) % 10) for k in range(n - 1))
    total = sum(2 * d - 9 * (2 * d > 9) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(head))))
    digits = head + str(-total % 10)
    return joint.join(digits[k : k + group] for k in range(0, n, group))


TRICKY = [
    "mail a.b+c@x-y.co.uk, then a@b@c.de a@b.c_x@d.e. end", "@x.y a@.b a@b. a@b.c.. b@c..d", "x@y.z" * 40, "é a@b.cd 😀 q@r.st",
    "1.2.3.4.5.6.7.8.9 300.1.1.1 0255.1.1.001 1.2.3 256.0.0.1 1.2.3.4567", "999.1.2.3 9.9.9.9.", "00000000000255.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111111 4111  1111 1111 1111", "a4785380592391139b 5-4-8-5 3 0 2 4",
    "6011000990139424 6011000990139425 3530 1113 3330 0000 0", "0000000000000000 0000-0000-0000-0000-000",
    "+1 (456) 555-2186 +49.30.1234567, +1 +12 +1234567 ++123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +44()()-", "+(123) +9((((((((((",
    "call +1 (968) 555-9369 or 17.252.227.210 or x@y.zz", "a" * 5000 + "@b.c", "9" * 5000, "1." * 3000, "x@y" + ".z" * 3000,
    "; ".join(f"card {card(n, j)} of {n}" for n in (15, 16, 17, 18, 19, 20) for j in ("", " ", "-")), f"{card(16)}\n{card(19, ' ')}\t{card(17, '-')}",
]


def valid(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}" for kind, pattern in BASE.items() for m in re.finditer(pattern, text) if valid(kind, m.group())
    ]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = awkward() + [(100 + k, t, None, None, None) for k, t in enumerate(TRICKY)] + [(100, TRICKY[0], None, None, None)]
    found = pii.personal_data(with_clashing(frame(spark, rows)).repartition(4)).collect()
    got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found)
    wanted = []
    for key, text, *_ in rows:
        base = spans(text or "")
        counts = [sum(s.startswith(k + ":") for s in base) for k in BASE]
        wanted.append((str(key), hashlib.sha256(",".join(base).encode()).hexdigest(), *counts))
    assert got == sorted(wanted)
    assert sum(w[2] for w in wanted) > 30 and sum(w[3] for w in wanted) > 4 and sum(w[4] for w in wanted) > 3 and sum(w[5] for w in wanted) > 3


def contact(k, value):
    return (k, f"Thing number one. Please write to {value} before long, thanks {'abc'[k % 3]}.", None, None, None)


def test_patterns_discover_what_no_seed_pattern_knows(spark):
    seeds = [contact(k, f"user{k}@mail.org") for k in range(8)]
    hidden = [contact(100, "jo.doe(at)host9"), contact(101, "jo.doe(at)host9")]
    elsewhere = [(200, "and jo.doe(at)host9 again; part no 12345678 is clean", None, None, None), (201, "weighs 1234567 grams", None, None, None)]
    found = {r["doc_id"]: r for r in pii.personal_data(frame(spark, seeds + hidden + elsewhere)).collect()}
    at = hidden[0][1].index("jo.doe")
    assert found[100]["spans"] == f"email:{at}:{at + len('jo.doe(at)host9')}" and found[100]["n_email"] == 0
    assert found[200]["spans"] == "email:4:19" and found[201]["spans"] == ""
    assert found[3]["spans"].count("email") == 1 and found[3]["n_email"] == 1
    assert found[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_patterns_shared_by_kinds_discover_nothing(spark):
    mixed = [contact(k, v) for k, v in enumerate([*(f"u{k}@m.org" for k in range(6)), *(f"10.0.0.{k}" for k in range(6))])]
    found = pii.personal_data(frame(spark, [*mixed, contact(50, "abc-123456")])).where("doc_id = 50").first()
    assert found["spans"] == ""


def test_too_few_seeds_discover_nothing(spark):
    rows = [contact(k, f"user{k}@mail.org") for k in range(pii.SUPPORT - 1)]
    found = pii.personal_data(frame(spark, [*rows, contact(50, "abc-123456")])).where("doc_id = 50").first()
    assert found["spans"] == ""


@pytest.mark.parametrize("digits, right", [("4111111111111111", True), ("4111111111111112", False), ("0", True), ("18", True)])
def test_luhn(spark, digits, right):
    assert spark.range(1).select(pii.passes_luhn(F.lit(digits))).first()[0] == right


def test_empty_table_and_native_plan(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).isEmpty()
    plan = pii.personal_data(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_identifiers_with_spaces_are_discovered(spark):
    phones = [(k, f"Number {k}. You may call me on +1 (456) 555-{2000 + k} or so.", None, None, None) for k in range(12)]
    cards = [(20 + k, f"Please charge my card {v} today.", None, None, None) for k, v in enumerate(CARDS)]
    hidden = ["(020) 7946 0958", "555 867 5309"]
    new = [(100 + k, f"Seen 123456 you may call me on {v} or so.", None, None, None) for k, v in enumerate(hidden)]
    new += [(110, "Please charge my card 4111 1111 1111 1112 today.", None, None, None)]
    new += [(120, "elsewhere: 555 867 5309, and 12 eggs", None, None, None), (121, "room 12 of 3456 7890 sheets", None, None, None)]
    new += [(122, "Seen 12345678 me on 555 867 5309 or so.", None, None, None)]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, phones + cards + new)).collect()}
    for k, v in enumerate(hidden):
        at = new[k][1].index(v)
        assert found[100 + k] == f"phone:{at}:{at + len(v)}"
    assert found[110] == "card:22:41" and found[120] == "phone:11:23" and found[121] == ""
    assert found[122] == "phone:20:32"


CARDS = ["4111 1111 1111 1111", "6011 0009 9013 9424", "5555 5555 5555 4444", "4012 8888 8888 1881", "5105 1051 0510 5100",
         "3530 1113 3330 0000", "4222 2222 2222 2220", "6011 1111 1111 1117"]
