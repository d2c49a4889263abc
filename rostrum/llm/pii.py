"""Personal data: anchors found by Aho-Corasick, expanded and validated by local parsers.

One automaton pass finds at-signs, plus-signs, digits, ``://`` and identifier cues, in any case. From an at-sign the parser walks
left over local-part characters and right over a domain; a scheme is expanded to its account part; a cue to the account number,
IBAN (mod 97) or credential that follows it; from a digit start address and card number, which have no cue. Every parser is
linear in the text.

Base kinds: email, ip, card, phone, exactly the leftmost non-overlapping matches of their patterns, then validated.
Added kinds: login (scheme://user:pass@), iban (mod 97, in any case), account (six digits or more that are no date, or 7 to 12 letters and digits
with four digits), secret (16 characters or more behind an equals sign or colon; behind "is" with a digit among them).

Defined cases: a null text is empty, without spans; positions are code points, end exclusive; texts are read whole;
every input row gives one output row, repeated or null ids included; spans of different kinds may overlap; an empty table gives an
empty table; other columns, whatever their names, are ignored by ``find`` and kept by ``mask``.
"""
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from rostrum.llm._spark import Scratch, text_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security", "passport"),
    "secret": ("token", "secret", "password", "passwort", "passwd", "pwd", "api_key", "apikey", "api-key", "api key", "access_key", "access-key", "secret_key", "private_key"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = "0123456789"
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:\"'<>]++(?::[^\s/?#@\"'<>]*+)?@[A-Za-z0-9.-]++(?::[0-9]{1,5})?")
IBAN = re.compile(r"[ \t:=#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I)
IBAN_SIZE = dict(AT=20, BE=16, CH=21, CZ=24, DE=22, DK=18, ES=24, FI=18, FR=27, GB=22, IE=22, IT=27, LU=20, NL=18, NO=15, PL=28, PT=25, SE=24)
ACCOUNT = re.compile(
    r"(?:[ \t]?(?:number|no\.?|nr\.?|id))?(?:[ \t](?:is|ist|est|es))?[ \t:=#.]{1,4}"
    r"([A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,}(?![A-Z0-9])|(?=(?:[A-Z]*[0-9]){4})[A-Z0-9]{7,12}(?![A-Z0-9]))", re.I)
DATE = re.compile(r"(?:19|20)[0-9]{2}[ -]?(?:0[1-9]|1[0-2])[ -]?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[ -](?:0[1-9]|1[0-2])[ -](?:19|20)[0-9]{2}")
SECRET = re.compile(r"[ \t]{0,3}(?:[=:]|(is|ist|est|es)(?=[ \t]))[ \t]{0,3}[\"']?", re.I)
SECRET_RUN = re.compile(r"[A-Za-z0-9_+/=.-]*+")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in ("@", "+", "://"):
        a.add_word(mark, (mark, len(mark)))
    for digit in DIGITS:
        a.add_word(digit, ("digit", 1))
    for kind, words in CUES.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def lowered(text: str) -> str:
    """Lower case with every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out, done, phoned, addressed, carded, run = [], 0, 0, 0, 0, 0
    for last, (mark, size) in anchors.iter(lowered(text)):
        at, end = last + 1 - size, last + 1
        if mark == "digit":
            if at >= addressed and (not at or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                addressed = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    out.append((at, 1, addressed))
            if at >= carded and (m := CARD.match(text, at)):
                carded = m.end()
                if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out.append((at, 2, carded))
        elif mark == "@":
            left = at
            while left > done and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, end)):
                done = m.end()
                out.append((left, 0, done))
        elif mark == "+":
            if at >= phoned and (m := PHONE.match(text, at)):
                phoned = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((at, 3, phoned))
        elif mark == "://":
            if m := LOGIN.match(text, end):
                out.append((end, 4, m.end()))
        elif at and text[at - 1].isalnum():
            continue  # the tail of a longer word
        elif mark == "iban":
            if (m := IBAN.match(text, end)) and (size := _iban_size(m[1])):
                out.append((m.start(1), 5, m.start(1) + size))
        elif mark == "account":
            if (m := ACCOUNT.match(text, end)) and not DATE.fullmatch(m[1]):
                out.append((m.start(1), 6, m.end(1)))
        elif m := SECRET.match(text, end):
            if m.end() >= run:  # else within the run read last, which has the same end: each run is read once
                run = SECRET_RUN.match(text, m.end()).end()
            if run - m.end() >= 16 and (not m[1] or any(c in DIGITS for c in text[m.end() : run])):
                out.append((m.end(), 7, run))
    return sorted(set(out))


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_size(s: str) -> int:
    """How much of ``s`` is an IBAN, 0 for nothing: its country's length, else the longest; it ends where a word ends.

    Small letters count as capitals in those of known countries, as words may follow."""
    small, s = s != s.upper(), s.upper()
    if small and s[:2] not in IBAN_SIZE:
        return 0
    cuts = [i for i in range(len(s), 14, -1) if s[i - 1] != " " and s[i : i + 1] in ("", " ")]
    cuts = [i for i in cuts if len(s[:i].replace(" ", "")) >= 15]
    cuts.sort(key=lambda i: len(s[:i].replace(" ", "")) != IBAN_SIZE.get(s[:2]))
    return next((i for i in cuts if _iban(s[:i])), 0)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans) -> str:
    """The text with every stretch of overlapping spans replaced by the first one's kind, as [EMAIL]."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, of every row's text."""
    Scratch(docs.sparkSession)

    def run(batches):
        anchors = automaton()
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text"):
                found = [spans_of(t or "", anchors) for t in rows.column(1).to_pylist()]
                counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)]
                sha = [hashlib.sha256(joined(x for x in s if x[1] < 4).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(s) for s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind; null texts stay null, all columns stay."""
    Scratch(docs.sparkSession)
    names = docs.columns

    def run(batches):
        anchors = automaton()
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text"):
                texts = [None if t is None else masked(t, spans_of(t, anchors)) for t in rows.column(names.index("text")).to_pylist()]
                cols = [pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, rows.columns)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
