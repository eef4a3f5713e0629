"""Values of the guess kind: how far they reach and what they cost."""

import hashlib
import math
import random
import time

import pytest

from textweir.llm import secrets
from textweir.llm.packing import default_tokenizer


def guesses(text):
    return [text[a:b] for a, b, k in secrets.scan(text.encode()) if secrets.KINDS[k] == "guess"]


@pytest.mark.parametrize("n", [6, 256, 257, 320, 5000])
def test_values_of_any_length(n):
    rng = random.Random(n)
    value = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789-_.") for _ in range(n))
    for text in (f'passphrase: "{value}" end', f"token = '{value}'", f"pwd={value} end", f"credentials => {value}", f'"auth": "{value}"'):
        assert guesses(text) == [value]


def test_scheme_is_no_value():
    token = "q7Xw_Zr81.mV0sTtB-9k" * 20
    for text in (f"Authorization: Bearer {token}", f'"authorization": "Basic {token}"', f"curl -H 'Authorization: bearer  {token}'", f"auth_token: x\nAUTH = Bearer '{token}'"):
        assert guesses(text) == [token]
    assert guesses("Authorization: Bearer abc") == guesses('auth: "Bearer abc"') == []
    assert guesses("password: negotiate Xq9$vB7!kLz2") == ["negotiate"]


def exhaustive(value, vocabulary=None):
    """The least cost over all cuts into pieces, each piece costed on its own."""
    known = secrets.ranks(vocabulary)
    low, plain = value.lower(), value.lower().translate(secrets._LEET)
    kinds = ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), ("0123456789", 10)
    one = math.log10(max(10, sum(n for chars, n in kinds if set(value) & set(chars)) + 32 * any(not (c.isascii() and c.isalnum()) for c in value)))

    def piece(j, i):
        yield one if i - j == 1 else math.inf
        pairs = [low[k : k + 2] for k in range(j, i - 1)]
        if i - j >= 3 and all(p in secrets._WALKS for p in pairs):
            yield one + math.log10(i - j) + 0.3
        if i - j >= 3 and len(set(low[j:i])) == 1:
            yield one + math.log10(i - j)
        if plain[j:i] in known:
            yield known[plain[j:i]] + 0.3 * (value[j:i] != low[j:i]) + 0.6 * (low[j:i] != plain[j:i]) + 0.3
        if 4 <= i - j <= 10 and low[i - 1].isdigit() and secrets._DATE.fullmatch(low, j, i):
            yield math.log10(365 * 120) if i - j >= 6 else 2.1

    best = [0.0]
    for i in range(1, len(value) + 1):
        best.append(min(best[j] + c for j in range(i) for c in piece(j, i)))
    return best[-1]


def test_cost_is_the_least_over_all_segmentations():
    rng = random.Random(4)
    parts = [*secrets.WORDS, "P4ssw0rd", "dddddddd", "11111", "aaabbb", "fghjkl", "9876543", "asdsa", "qwert", "19991231", "2012", "01-02-1999", "x", "Q", "$", "7", "-"]
    values = ["passwordddddddd", "passwordfghjkl", "a" * 68, "xxxx-" * 20, "qwertyuiop" * 9]
    values += ["".join(rng.choice(parts)[rng.choice((0, 0, 1)) :] for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    values += ["".join(rng.choice("aab12we") for _ in range(rng.randrange(1, 90))) for _ in range(200)]
    path = default_tokenizer()
    assert len(secrets.ranks(path)) > 20_000 and secrets.guess_cost("correcthorsebatterystaple")[0] > 20 > secrets.guess_cost("correcthorsebatterystaple", path)[0]
    for v in values + ["correcthorsebatterystaple", "Tr0ub4dor", "sunnyday2012zzz", "Xq9$vB7!kLz2", ""]:
        assert secrets.guess_cost(v, path)[0] == pytest.approx(exhaustive(v, path))
        cost, pieces = secrets.guess_cost(v)
        assert cost == pytest.approx(exhaustive(v))
        assert [0, *(p[1] for p in pieces)] == [*(p[0] for p in pieces), len(v)]
    assert sum(len(v) > 64 for v in values) > 50


def test_long_fillers_are_no_secrets_and_cost_linear_time():
    for filler in ("a" * 68, "x" * 300, "-" * 80, "qwertyuiop" * 7, "****" * 5000):
        assert (guesses(f'password: "{filler}"') == []) == (exhaustive(filler[:300]) < secrets.LEAST_LOG10)
    assert guesses("password: " + "x" * 300) == guesses("pwd=" + "-" * 80) == []
    before = time.process_time()
    for filler in ("a" * 200_000, "as" * 100_000, "abcdefghijklmnopqrstuvwxyz" * 8000):
        secrets.guess_cost(filler)
    assert time.process_time() - before < 30


LETTERS, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def plain_base(text):
    """The base spans without a pattern: one character after another."""
    out = []

    def run(i, chars):
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    i = 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(w)].isascii() and text[i : i + len(w)].lower() == w), None)
        if word:
            j = i + len(word)
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            j = run(j, " ")
            if text[j : j + 1] and text[j] in ":=":
                j = run(j + 1, " ")
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                end = run(j, LETTERS + UPPER + DIGITS + "+/_.=-")
                if end > j:
                    out += [(i, 0, end)] * (end - j >= 6)
                    i = end
                    continue
        i += 1
    for kind, head, chars, least in ((1, "AKIA", UPPER + DIGITS, 20), (2, "", DIGITS + "abcdef", 24)):
        i = 0
        while i < len(text):
            end = run(i + len(head), chars) if text.startswith(head, i) else i
            if end > i + len(head):
                out += [(i, kind, end)] * (end - i >= least)
                i = end
            else:
                i += 1
    return [(a, b, k) for a, k, b in sorted(out)]


def test_base_spans_against_a_plain_scanner(spark):
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "api__key", "tokentoken", ":", "=", " ", "  ", "'", '"', "\n", "\t", "é", "ſecret", "toKen", "abc", "abcdef", "abc-d/e+f=", "AKIA", "AKIAAKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "x", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += [f"{w}{q}{a}{s}{b}{q}{v}{q}" for w in parts[:8] for q in ("", "'", '"') for a in ("", " ") for s in ":=" for b in ("", "  ") for v in ("abcde", "abcdef")]
    found = 0
    for t in texts:
        got = [s for s in secrets.scan(t.encode()) if s[2] < 3]
        assert got == plain_base(t), t
        found += len(got)
    assert found > 600
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts[:200], None, "", texts[0]])] + [(0, texts[0], "s"), (None, texts[1], "s")], "doc_id long, text string, spans string")
    out = secrets.scan_secrets(rows, default_tokenizer()).collect()
    assert len(out) == 205 and secrets.scan_secrets(rows.where("false")).count() == 0
    for r in out:
        t = texts[1] if r.doc_id is None else texts[r.doc_id] if r.doc_id < 200 else {200: "", 201: "", 202: texts[0]}[r.doc_id]
        base = plain_base(t)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in range(3))
        assert {*said.split(",")} - {""} <= {*r.spans.split(",")}
