"""The assignment lexer: syntaxes, constants, long input, and programs whose literals are known as they are made."""

from __future__ import annotations

import random
import time

import pytest

from umbra.llm import op5_secrets
from umbra.llm.assignments import Reader

KEY = "Zx81Qp-77aLm"


def literals(text):
    return [text[s:e] for s, e, _ in op5_secrets.lexed_spans(text)]


@pytest.mark.parametrize("text", [
    f"password = `{KEY}`", f'password = """{KEY}"""', f"password = '''{KEY}'''", f'password: str = "{KEY}"', f"password: >\n  {KEY}\nuser: x",
    f"db:\n  password: |-\n    {KEY}\n  user: y", f"password = k\nk = '{KEY}'", f"a = b\nb = c\nc = '{KEY}'\npassword = a", f"password := '{KEY}'", f":password => '{KEY}'",
    f'config["password"] = "{KEY}"', f'<add key="dbPassword" value="{KEY}"/>', f'{{"name": "DB_PASSWORD",\n "value": "{KEY}"}}', f'#define DB_PWD "{KEY}"',
    f'x = "{{\\"pwd\\": \\"{KEY}\\"}}"', f"conn = 'Server=db1;Pwd={KEY};User=u'"[:-8] + "'", f"```\nk = '{KEY}'\npwd = k\n```", f'# pwd = "{KEY}"', f"pwd ?= {KEY}", f"pwd ||= '{KEY}'",
    f"<Signing_Key>\n  {KEY}\n</Signing_Key>", f"don't\nsigning_key = '{KEY}'", f"k = '{KEY}'; pwd = k; k = other()",
])
def test_syntaxes(text):
    assert literals(text) == [KEY]


@pytest.mark.parametrize("text", [
    f'k = "{KEY}"; k = other(); password = k', f'k = "{KEY}"\nk = None\npassword = k', "a = b\nb = a\npassword = a", "password = request.form.password", "def f(password: SecretString): pass",
    "password:\n  required\n", "token = getToken(a)", 'password = "not a literal, it has spaces"', "pwd: Callable[[str], None]",
])
def test_no_literal(text):
    assert literals(text) == []


def test_parts_without_limit():
    for n in (65, 10_000):
        text = f'k = "{KEY}"\nk = ' + " + ".join(['"a1"'] * n) + "\npassword = k"
        assert literals(text) == ["a1"] * n  # and not the earlier literal
    chain = "k0 = 'Zx81Qp'\n" + "".join(f"k{i} = k{i - 1} + 'a{i}'\n" for i in range(1, 10_000)) + "pwd = k9999\npwd2 = k9998\n"
    assert len(literals(chain)) == 10_000
    doubled = f"k0 = '{KEY}'\n" + "".join(f"k{i} = k{i - 1} + k{i - 1}\n" for i in range(1, 3000)) + "pwd = k900"
    assert literals(doubled) == [KEY]


@pytest.mark.parametrize("n", [4096, 4097, 100_000])
def test_length_without_limit(n):
    key = (KEY * (n // 12 + 1))[:n]
    for text in (f"<password>{key}</password>", f"password = '{key}'", f"signing_key: |\n  {key}\n", f'"pwd": "{key}"'):
        assert literals(text) == [key]


@pytest.mark.parametrize("text", [
    "x=" + "\\'" * 50_000, "\\`" * 50_000 + "=", '\\"""' * 25_000 + "=", "a:b " * 25_000, "]" * 50_000 + "=" + "]" * 25_000 + "=", "<a>" * 25_000, "a[" * 25_000 + "=", "'" * 50_001 + "=",
    "pwd=pwd+" * 12_000, "k=pwd\npwd=k\n" * 8_000, "(" * 50_000 + "=" + "(" * 25_000, "pwd = ((((" * 5_000, "\n".join("k: |" for _ in range(12_000)), "=" * 50_000, "a" * 100_000 + "=", "x = a.b" + ".c" * 50_000,
])
def test_time_grows_with_the_text(text):
    start = time.perf_counter()
    op5_secrets.lexed_spans(text)
    assert time.perf_counter() - start < 10


def program(rng):
    """A text in mixed syntax with the spans its sensitive assignments lead to, known while it is written."""
    text, want, known, names = "", set(), {}, 0
    for _ in range(rng.randrange(4, 30)):
        value = "".join(rng.choices("abcdefghijkmnpqrstuvwxyz", k=5)) + "".join(rng.choices("ABCDEFGH", k=4)) + "".join(rng.choices("23456789", k=4)) + rng.choice(["", "-x", "_y"])
        kind = rng.randrange(7)
        if kind == 0:
            text += rng.choice(["Some prose without any sign. It isn't code.\n", "\n", "note: see above\n", "x == 3\n", "if a != b:\n"])
            continue
        sensitive = rng.random() < 0.5
        names += 1
        name = rng.choice(["db_pwd", "apiToken", "client-secret", "signingKey"]) if sensitive else rng.choice(["colour", "title", "zone"]) + str(names)
        if kind == 1 and known:  # through a constant
            constant = rng.choice(sorted(known))
            text += f"{name} = {constant}\n"
            if sensitive:
                want |= known[constant]
            continue
        if kind == 2:  # a constant, sometimes a name that is bound again
            name = rng.choice(["alpha", "beta", "gamma"])
            text += f"{name} = "
            if rng.random() < 0.3:
                text += "compute(7)\n"
                known[name] = set()
                continue
            q = rng.choice("\"'`")
            text += q
            known[name] = {(len(text), len(text) + len(value))}
            text += f"{value}{q}\n"
            continue
        before, after = rng.choice([("{n} = '", "'\n"), ("{n}: \"", "\"\n"), ("\"{n}\": \"", "\",\n"), ("const {n} = `", "`;\n"), ("export {n}=", "\n"), ("<{n}>", "</{n}>\n"), ("let {n}: string = \"", "\";\n"), ("{n} := \"", "\"\n"), ("{n}: |\n  ", "\n"), ("${n} = '", "';\n"), ("x['{n}'] = '", "'\n")])
        text += before.replace("{n}", name)
        if sensitive:
            want.add((len(text), len(text) + len(value)))
        text += value + after.replace("{n}", name)
    return text, want


def test_programs_known_as_they_are_made():
    rng = random.Random(5)
    for _ in range(1500):
        text, want = program(rng)
        assert {(s, e) for s, e, _ in op5_secrets.lexed_spans(text)} == want, text


def test_places_lie_in_the_text():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choices(["pwd", "k", " ", "=", ":", "\n", "'", '"', "`", "+", "(", ")", "[", "]", "<", ">", "</", "$", "{", "}", "\\", "é", "Zx81Qp77aLm", "|", "&", ".", "#define ", "str"], k=rng.randrange(40)))
        for b in Reader(text).bindings:
            assert all(0 <= p.start <= p.end <= len(text) for p in b.parts)
        op5_secrets.scan_text(text)
