from __future__ import annotations

import hashlib
import re

from alertledger.llm.secrets import ASSIGN, find_spans, guess_cost, scan_secrets, secret_digest


def spans(text):
    return [(a, k, b) for a, k, b, _ in find_spans(text, 8.0, 6)]


def test_base_patterns_and_order():
    text = "Token = abcdefghijkl PASSWD:'a/b+c_d.e=f-gh' AKIAABCDEFGHIJ1234 deadbeefdeadbeef00 api_key=short"
    found = [(k, text[a:b]) for a, k, b in spans(text) if k < 3]
    assert found == [(0, "Token = abcdefghijkl"), (0, "PASSWD:'a/b+c_d.e=f-gh"), (1, "AKIAABCDEFGHIJ1234"),
                     (2, "deadbeefdeadbeef00")]


def test_failing_match_is_consumed_and_case_is_ascii():
    assert not [x for x in spans("password:token:abcdefghijkl") if x[1] == 0]  # the first match takes "token"
    assert not [x for x in spans("paſſword=abcdefghijklm toKen=abcdefghijklm") if x[1] == 0]
    assert spans("AKIAABCDEFGHIJ123") == [] and spans("deadbeefdeadbee") == []
    assert re.compile(ASSIGN, re.I | re.A).groups == 1


def test_guess_cost_orders_passwords():
    weak = ["password1", "hunter2", "aaaaaaaaaaaa", "qwertyuiop", "2019-04-05", "P@ssw0rd"]
    strong = ["x9K!mq2Lw0", "q8Zt!p0w#r", "7hK2pX9vQd"]
    assert max(map(guess_cost, weak)) < 8 < min(map(guess_cost, strong))
    assert guess_cost("") == 0
    brute = sum(1.4149733 for _ in "zvkjxq")  # no piece is cheaper than single letters here
    assert abs(guess_cost("zvkjxq") - brute) < 1e-3


def test_context_values():
    text = "pwd=\"q8Zt!p0w#r\". the password is x9K!mq2Lw0, login = changeme1; the token is invalid"
    assert [text[a:b] for a, k, b in spans(text) if k == 3] == ["q8Zt!p0w#r", "x9K!mq2Lw0"]


def test_values_of_letters_alone():
    text = ("password: kQzvWbxRtm, pwd=hGtRvXqz passphrase => wXkjqZvbn login = 'qZxvKjwpL' credentials: rTkWqZxvb\n"
            "the password is incomprehensible; token: required, Password: Administrator, secret = changeme")
    found = [text[a:b] for a, k, b in spans(text) if k == 3]
    assert found == ["kQzvWbxRtm", "hGtRvXqz", "wXkjqZvbn", "qZxvKjwpL", "rTkWqZxvb"]


def test_odd_rows(docs, odd_rows):
    secret = "k: token = abcdefghijkl"
    out = secret_digest(scan_secrets(docs([*odd_rows, (8, secret)]))).collect()
    assert len(out) == len(odd_rows) + 1
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["base_sha256"] == by[2]["base_sha256"] == empty and by[1]["spans"] == ""
    assert by[8]["n_assign"] == 1 and by[8]["base_sha256"] == hashlib.sha256(b"assign:3:23").hexdigest()
    assert secret_digest(scan_secrets(docs([]))).count() == 0
