import random
import re

from rostrum.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and pii.luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_kinds_equal_their_patterns_on_random_texts():
    rnd, anchors = random.Random(3), pii.automaton()
    for alphabet in ("a.@-_ ", "1.25 ", "+1 ().-2a", "0123456789 -", "a1@.+ -é:/"):
        for _ in range(4000):
            t = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
            assert [s for s in pii.spans_of(t, anchors) if s[1] < 4] == brute(t), t


def test_added_kinds():
    a = pii.automaton()
    kinds = lambda t: [(pii.KINDS[k], t[x:y]) for x, k, y in pii.spans_of(t, a)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("é IBAN: GB82 WEST 1234 5698 7654 32.")
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 33.") == []
    assert kinds("https://me:pw@host.org/x")[0] == ("login", "me:pw@host.org")
    assert kinds("account number 12345678") == [("account", "12345678")]
    assert kinds('token = "abcdef0123456789abcd"') == [("secret", "abcdef0123456789abcd")]
    assert kinds("this broken = abcdef0123456789abcd") == []
    assert kinds("İ API_Key = abcdef0123456789abcd") == kinds("İ aPi-kEY: abcdef0123456789abcd") == [("secret", "abcdef0123456789abcd")]
    assert kinds("my SSN is 123-45-6789.") == [("account", "123-45-6789")] and kinds("Passport No. X1234567") == [("account", "X1234567")]
    assert kinds("the accountant 12345678") == []


def test_long_runs_are_linear():
    a = pii.automaton()
    for t in ("a" * 300_000 + "@", "1" * 300_000 + ".", "@" * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.spans_of(t, a)


def test_rows(spark):
    rows = [(1, "x", "mail a@b.co"), (1, "x", "mail a@b.co"), (None, None, None), (3, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, spans string, text string")
    out = pii.find(docs).collect()
    assert sorted((r.n_email, r.spans) for r in out) == [(0, ""), (0, ""), (1, "email:5:11"), (1, "email:5:11")]
    hidden = pii.mask(docs)
    assert hidden.schema == docs.schema and sorted(str(r.text) for r in hidden.collect()) == ["", "None", "mail [EMAIL]", "mail [EMAIL]"]
    assert pii.find(docs.limit(0)).collect() == []


def test_long_and_followed_spans_are_found():
    found = lambda t: [t[a:b] for a, k, b in pii.spans_of(t, pii.automaton()) if k >= 4]
    assert found("IBAN DE89370400440532013000 EUR 500") == ["DE89370400440532013000"]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX") == ["DE89 3704 0044 0532 0130 00"]
    assert found("IBAN DE88370400440532013000 EUR 500") == []
    assert found("token=" + "aB3_" * 500 + " end") == ["aB3_" * 500]
    assert found("see db://" + "u" * 300 + ":" + "p" * 400 + "@host.org now") == ["u" * 300 + ":" + "p" * 400 + "@host.org"]
    assert len(found("token=" * 20000)) > 19000  # linear


def test_added_kinds_are_validated():
    a = pii.automaton()
    kinds = lambda t: [(pii.KINDS[k], t[x:y]) for x, k, y in pii.spans_of(t, a) if k >= 4]
    assert kinds("password is abcdefghijklmnop1234") == [("secret", "abcdefghijklmnop1234")]
    assert kinds("the password is unbelievablylongforyou") == kinds("his token island 0123456789abcdef01") == []
    assert kinds("iban de89 3704 0044 0532 0130 00 and more") == [("iban", "de89 3704 0044 0532 0130 00")]
    assert kinds("iban de88 3704 0044 0532 0130 00") == kinds("iban xx82west12345698765432") == []
    assert kinds("passport number: C01X00T47.") == [("account", "C01X00T47")] and kinds("passport renewed") == kinds("account abcdefgh12") == []
    assert kinds("account 20241015") == kinds("account 2024-10-15, paid") == kinds("konto 15-10-2024") == []
    assert kinds("account " + "12345" * 6) == [("account", "12345" * 6)]
    assert kinds("account 12345678") == [("account", "12345678")]
