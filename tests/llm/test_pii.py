import hashlib
import re
from datetime import date, timedelta

import pytest

from quillspark.llm import pii


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")
    return {r.doc_id: r for r in pii.pseudonymize(df, **kw).collect()}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_kinds_formats_and_links(spark):
    got = run(
        spark,
        [
            (1, "a.b7@mail.example.com|4111111111111111|4111-1111 1111-1111|+1 (337) 555-7349|1.2.3.4", "k"),
            (2, "4111 1111 1111 1111|GB82 WEST 1234 5698 7654 32|123-45-6789|1980-02-29|29.02.1980|29/2/1980", "k"),
            (3, "4111111111111112|999.1.1.1|1981-02-29|000-45-6789|GB00WEST12345698765432|v1.2.3.4.5|deadbeef4111111111111111", "k"),
            (4, None, None),
            (5, "", None),
            (6, "no data " * 20_000 + "a.b7@mail.example.com", None),
        ],
    )
    mail, c1, c2, phone, ip = got[1].text.split("|")
    assert re.fullmatch(r"[a-z]\.[a-z]\d@mail\.example\.com", mail) and mail[:4] != "a.b7"
    assert luhn(c1) and c1 != "4111111111111111" and re.fullmatch(r"\d{4}-\d{4} \d{4}-\d{4}", c2) and re.sub(r"\D", "", c2) == c1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and "555-7349" not in phone
    assert all(int(x) < 256 for x in ip.split("."))
    c3, iban, ssn, d1, d2, d3 = got[2].text.split("|")
    assert c3.replace(" ", "") == c1
    p = iban.replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in p[4:] + p[:4])) % 97 == 1 and iban[:2] == "GB" and re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn)
    day = date.fromisoformat(d1)
    assert 1900 <= day.year <= 2099 and d2 == day.strftime("%d.%m.%Y") and [int(x) for x in d3.split("/")] == [day.day, day.month, day.year]
    assert got[3].text == "4111111111111112|999.1.1.1|1981-02-29|000-45-6789|GB00WEST12345698765432|v1.2.3.4.5|deadbeef4111111111111111"
    assert (got[4].text, got[5].text, got[4].private_kinds) == (None, "", [])
    assert got[6].text.endswith(" " + mail) and got[1].value == "k"


def test_permutations_are_one_to_one(spark):
    df = spark.range(73049)
    out = df.selectExpr(pii.feistel_pair("id", 17, 4297, "k", "date") + " as x")
    assert out.distinct().count() == 73049 and out.where("x not between 0 and 73048").isEmpty()
    out = spark.range(1000).selectExpr(pii.feistel_text("lpad(cast(id as string), 3, '0')", "k", "card") + " as x")
    assert out.distinct().count() == 1000 and out.where("not x rlike '^[0-9]{3}$'").isEmpty()


def test_another_key_and_empty(spark):
    a, b = (run(spark, [(1, "4111111111111111", "")], key=k)[1].text for k in ("one", "two"))
    assert a != b and run(spark, []) == {}


def test_numbers_next_to_each_other(spark):
    card, ssn, phone = "4111 1111 1111 1111", "123-45-6789", "555-123-4567"
    single = {1: card, 2: "4111111111111111", 3: ssn, 4: "078-05-1120", 5: phone, 6: "2024-03-05", 7: "12/25/2023", 8: "3782 822463 10005", 9: "1.2.3.4", 10: "020 7946 0958", 11: "411 1111 1111 11111"}
    new = {i: r.text for i, r in run(spark, [(i, x, "") for i, x in single.items()]).items()}
    assert all(new[i] != x and re.sub(r"\d", "0", new[i]) == re.sub(r"\d", "0", x) for i, x in single.items() if i != 9)
    assert luhn(re.sub(" ", "", new[1])) and new[1].replace(" ", "") == new[2] == new[11].replace(" ", "")
    month, day, year = map(int, new[7].split("/"))
    assert date(year, month, day) == date.fromisoformat(run(spark, [(1, "2023-12-25", "")])[1].text)
    # templates: {i} stands for single[i], the rest stays
    cases = [
        "{3} {4}", "{3} 2024", "2024 {3}", "{5} 99887", "99887 {5}", "24 {5}", "{2} 123", "{1} 12/27", "{1} 123", "2024 {1}", "{1} 2024", "{1} {8} {2} {1}", "{1} {5}", "{5} {1} {3}",
        "{3} 2024 555 1 {1}", "{1} {9}", "99 {6} {5}", "{1} {6}", "{1} {7}", "{6}T10:20:30Z {5}", "at {7}, {6}", "{10} 99886", "{2} {2} 7 {5} {3}", "1 {1} 7", "000-45-6789 {1}", "{11} 2024 2025",
        "4111 1111 1111 1112 99", "13/25/2023", "2024-13-05T10:20", "1 2 3 4 5 6 7 8 9 10 11 12",
    ]
    fill = lambda x, by: re.sub(r"\{(\d+)\}", lambda m: by[int(m[1])], x)
    got = run(spark, [(i, fill(x, single), "") for i, x in enumerate(cases)])
    assert [got[i].text for i in range(len(cases))] == [fill(x, new) for x in cases]
    assert got[0].private_kinds == ["ssn", "ssn"] and got[11].private_kinds == ["card"] * 4
    long = run(spark, [(1, "7 " * 20_000 + card, ""), (2, "1" * 100_000, ""), (3, "12345 " * 5_000, "")])
    assert long[1].text.endswith(new[1]) and long[2].text == "1" * 100_000


def digest(key, kind, i, other):
    return hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()


def feistel(s, key, kind):
    """Halves of a string in turn shifted by the hash of the other, written independently of the SQL."""
    half = len(s) // 2
    parts = [s[:half], s[half:]]
    for i in range(1, 9):
        at = i % 2
        d, out = digest(key, kind, i, parts[1 - at]), []
        for j, c in enumerate(parts[at]):
            first, n = (("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (None, 0))
            k = int(d[j * 4 % 60 :][:4], 16)
            out.append(c if first is None else chr(ord(first) + (ord(c) - ord(first) + k) % n))
        parts[at] = "".join(out)
    return "".join(parts)


def pair(n, a, b, key, kind):
    q, r = divmod(n, b)
    for i in range(1, 9):
        if i % 2:
            q = (q + int(digest(key, kind, i, r)[:14], 16)) % a
        else:
            r = (r + int(digest(key, kind, i, q)[:14], 16)) % b
    return q * b + r


def test_feistel_against_an_independent_version(spark):
    texts = ["", "7", "41", "123", "411111111111111", "WEST12345698765432", "a.b+7_x", "ZzAa09", "5390075470"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").selectExpr("s", pii.feistel_text("s", "key's", "card") + " as x").collect()
    assert [r.x for r in rows] == [feistel(r.s, "key's", "card") for r in rows]
    rows = spark.range(0, 73049, 977).selectExpr("id", pii.feistel_pair("id", 17, 4297, "k", "date") + " as x", pii.feistel_pair("id * 50000", 65536, 65536, "k", "ip") + " as y").collect()
    assert [(r.x, r.y) for r in rows] == [(pair(r.id, 17, 4297, "k", "date"), pair(r.id * 50000, 65536, 65536, "k", "ip")) for r in rows]


def test_pseudonyms_against_an_independent_version(spark):
    def card(d):
        x = feistel(d[:-1], "k", "card")
        return x + next(c for c in "0123456789" if luhn(x + c))

    def iban(p):
        x = feistel(p[4:], "k", "iban")
        return next(f"{p[:2]}{n:02}{x}" for n in range(2, 100) if int("".join(str(int(c, 36)) for c in x + p[:2] + f"{n:02}")) % 97 == 1)

    day = lambda s: str(date(1900, 1, 1) + timedelta(pair((date.fromisoformat(s) - date(1900, 1, 1)).days, 17, 4297, "k", "date")))
    n = pair((192 << 24) + (168 << 16) + 7, 65536, 65536, "k", "ip")
    cases = {
        "4111111111111111": card("4111111111111111"),
        "378282246310005": card("378282246310005"),
        "GB82WEST12345698765432": iban("GB82WEST12345698765432"),
        "BE68539007547034": iban("BE68539007547034"),
        "1999-12-31": day("1999-12-31"),
        "2000-02-29": day("2000-02-29"),
        "192.168.0.7": ".".join(str(n >> s & 255) for s in (24, 16, 8, 0)),
        "123-45-6789": re.sub(r"^(...)(..)", r"\1-\2-", feistel("123456789", "k", "ssn")),
        "a.b@c.org": feistel("a.b", "k", "mail") + "@c.org",
    }
    got = run(spark, [(i, x, "") for i, x in enumerate(cases)], key="k")
    assert [got[i].text for i in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize("tail", ["", " BIC KREDBEBB", " KREDBEBB", " 1234", " ABCD EFGH", ", 12", "."])
def test_ibans_end_where_their_country_says(spark, tail):
    forms = ["BE68 5390 0754 7034", "BE68539007547034", "be68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "NO93 8601 1117 947", "QQ" + str(98 - int(f"{'1' * 12}262600") % 97).zfill(2) + "1" * 12]
    got = run(spark, [(i, x + tail, "") for i, x in enumerate(forms)])
    plain = [got[i].text[: len(x)].replace(" ", "") for i, x in enumerate(forms)]
    for i, x in enumerate(forms[:-1] if tail not in ("", ".", ", 12") else forms):
        new = got[i].text
        assert got[i].private_kinds == ["iban"] and new.endswith(tail) and new[:2] == x[:2] and new != x + tail
        p = plain[i].upper()
        assert int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", x + tail)))
    assert plain[0] == plain[1] == plain[2].upper() and plain[3] == plain[4].upper()


def test_the_session_names_the_key(spark):
    df = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="public key"):
        a = pii.pseudonymize(df).first().text
    spark.conf.set(pii.SETTING, "secret")
    try:
        b = pii.pseudonymize(df).first().text
        assert pii.stage(spark, df, "").first().text == b
    finally:
        spark.conf.unset(pii.SETTING)
    assert a != b == pii.pseudonymize(df, key="secret").first().text
