"""Values without bounds on their length, and kinds by a naive second finder: nothing of them stays in clear."""

import random
import string

import pytest

pytest.importorskip("latticework.llm")

from latticework.llm.pii import Pseudonyms, pseudonymise  # noqa: E402

CASES = [
    ("password=Tr0ub4dor&3", "Tr0ub4dor&3"),
    ("password: p@ssw0rd! and", "p@ssw0rd!"),
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCY"),
    ('"api-key": "abc.def.123456" next', "abc.def.123456"),
    ("Authorization: Bearer abc123def456ghi789", "abc123def456ghi789"),
    ("by ghp_16C7e42F292c6912E7710c838347Ae178B4a.", "16C7e42F292c6912E7710c838347Ae178B4a"),
    ("see eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4 there", "hbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4"),
    ("call 020 7946 0958 now", "20 7946 0958"),
    ("on March 4, 2001 we", "4, 2001"),
    ("the 4th March 2001", "4th March 2001"),
    ("due 1/2/03 at", "1/2/03"),
    ("to alice@münchen.de now", "alice@münchen"),
    (f"to {'verylongname' * 20}@{'sub.' * 30}example.org", "verylongname" * 20),
]


@pytest.mark.parametrize("text,value", CASES)
def test_values_go_and_formats_stay(text, value):
    out, spans = pseudonymise(text, Pseudonyms(b"key"))
    assert value not in out and len(out) == len(text) and len(spans) == 1
    at = text.index(value)
    assert out[:at] == text[:at] and spans[0][1] >= at + len(value.rstrip("!"))
    same = lambda c: "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
    assert "".join(map(same, out)) == "".join(map(same, text))
    assert pseudonymise(text, Pseudonyms(b"key"))[0] == out != pseudonymise(text, Pseudonyms(b"other"))[0]


@pytest.mark.parametrize("size", [150, 300, 5000])
def test_long_secrets_are_replaced_to_their_end_one_to_one(size):
    rng = random.Random(size)
    p = Pseudonyms(b"key")
    made = set()
    for _ in range(20):
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size))
        out = pseudonymise(f"token={value} end", p)[0][6:-4]
        assert all(sum(a == b for a, b in zip(out[k : k + 50], value[k : k + 50])) < 25 for k in range(0, size, 50))
        made.add(out)
        other = value[:-1] + ("b" if value[-1] != "b" else "c")
        assert pseudonymise(f"token={other} end", p)[0][6:-4] != out
    assert len(made) == 20


def naive(text):
    """Values behind a name and a sign, by splitting at white space alone."""
    out, words = [], text.split()
    for k, w in enumerate(words):
        name, sign, value = w.partition("=")
        if sign and name.rsplit("_")[-1] in ("password", "token", "secret") and len(value) >= 8:
            out.append(value)
    return out


def test_a_second_finder_finds_nothing_left():
    rng, p = random.Random(2), Pseudonyms(b"key")
    marks = string.ascii_letters + string.digits + "+/_-.&@!%$#*~^"
    for _ in range(200):
        values = [rng.choice("abz09") * 2 + "".join(rng.choice(marks) for _ in range(rng.choice([7, 40, 230, 900]))) + "7x" for _ in range(3)]
        text = " ".join(f"word {rng.choice(['my_', 'db_', ''])}{rng.choice(['password', 'token', 'secret'])}={v}" for v in values) + " and more"
        assert naive(text) == values
        left = pseudonymise(text, p)[0]
        assert len(left) == len(text) and not any(v in left for v in values)
        for v, new in zip(values, naive(left)):
            kept = [a == b for a, b in zip(v, new) if a.isalnum()]
            assert sum(kept) < max(6, 0.5 * len(kept))


@pytest.mark.parametrize("text", ["the token: word is. password: please", "tokens: 12", "bearer of news from afar 2020", "in May 2001", "section 1/2/3", "a 3/4 cup", "version 10.1/2"])
def test_clean_texts_stay(text):
    assert pseudonymise(text, Pseudonyms(b"key")) == (text, [])
