"""The secret lexer against snippets labelled by hand, and its time on hostile texts."""

import time

import pytest

from larkspur.llm import secrets

S = "q8Zr2LmX0a9T"
SNIPPETS = [
    ('K = "q8Zr2LmX0a9T"\nK = os.getenv("A")\ndb_pwd = K', []),
    ('# K = "q8Zr2LmX0a9T"\ndb_pwd = K', []),
    ('// K = "q8Zr2LmX0a9T"\ndb_pwd = K;', []),
    ('/* K = "q8Zr2LmX0a9T" */ db_pwd = K;', []),
    ('pwd_value =\n    "q8Zr2LmX0a9T"\n', [S]),
    ('pwd_value = \\\n    "q8Zr2LmX0a9T"\n', [S]),
    ('pwd_value = """\nq8Zr2LmX0a9T\nab12\n"""\n', ["\nq8Zr2LmX0a9T\nab12\n"]),
    ('<conf><pwd>q8Zr2LmX0a9T</pwd><title>Zx9kLm2Qp7vT</title></conf>', [S]),
    ('<add key="db_pwd" value="q8Zr2LmX0a9T"/>', [S]),
    ('db_pwd = "Zx9#kLm2-test"', ["Zx9#kLm2-test"]),
    ('db_pwd = pw9ABCdef1.Zx', []),
    ('db_pwd = settings.db.pwd', []),
    ('db_pwd = pw9ABCdef1Zx', ["pw9ABCdef1Zx"]),
    ('client_pwd            = "q8Zr2LmX0a9T"', [S]),
    ('def f():\n    K = "q8Zr2LmX0a9T"\n    return K\n\ndb_pwd = K\n', []),
    ('K = "q8Zr2LmX0a9T"\ndef f():\n    K = "other value"\n    x = K\n\ndb_pwd = K\n', [S]),
    ('{ K = "q8Zr2LmX0a9T"; }\ndb_pwd = K;', []),
    ('db_pwd: str = "q8Zr2LmX0a9T"', [S]),
    ('const dbPwd: string = \'q8Zr2LmX0a9T\';', [S]),
    ('connect(user="me", pwd="q8Zr2LmX0a9T")', [S]),
    ('connect(K="q8Zr2LmX0a9T")\npwd = K', []),
    ('conn = "Server=db;Pwd=q8Zr2LmX0a9T;User=me"', [S]),
    ('pwd = get("q8Zr2LmX0a9T")', []),
    ('pwd = ("q8Zr2L"\n       "mX0a9T77")\n', ["q8Zr2L","mX0a9T77"]),
    ('A = "q8Zr2L"\nB = A + "mX0a9T77"\nclient_pwd = B\n', ["q8Zr2L","mX0a9T77"]),
    ('pwd: "changeme"\npwd2: "<your pwd here>"\npwd: "enter the word that you were given"', []),
    ("it's a client's pwd: don't tell 'em", []),
    ('if pwd == "q8Zr2LmX0a9T" or pwd != "q8Zr2LmX0a9T":', []),
    ('export CLIENT_PWD=q8Zr2LmX0a9T\n', [S]),
    ('[db]\npwd = q8Zr2LmX0a9T\nhost = example.org\n', [S]),
    ("x => 5; 'pwd' => 'q8Zr2LmX0a9T',", [S]),
    ('$pwd = `q8Zr2LmX0a9T`', [S]),
    ('pwd="q8Zr2LmX0a9T" # pwd2="w7Kp0Qz3"', [S, "w7Kp0Qz3"]),
    ('signing_key: >-\n  q8Zr2LmX0a9T\n', [S]),
    ('a'*100000+'_pwd = "q8Zr2LmX0a9T"', [S]),
    ('db_pwd'+' '*50+'= "'+'aB3x'*1200+'"', ['aB3x'*1200]),
    ('x = K\nK = "q8Zr2LmX0a9T"\n', []),
    ('url = "http://x.y/z"\npwd = "q8Zr2LmX0a9T"', [S]),
    ('std::string pwd = "q8Zr2LmX0a9T";', [S]),
]


@pytest.mark.parametrize("text, wanted", SNIPPETS, ids=range(len(SNIPPETS)))
def test_snippets(text, wanted):
    assert [text[a:b] for a, b, _ in secrets.lexed_spans(text)] == wanted


def test_time_is_linear():
    n = 200_000
    hostile = ['"' * n, "'" * n, "`" * n, '"""' * n, "/*" * n, "a=" * n, 'pwd = "a" + ' * (n // 10), ":" * n, "<a>" * n, "a=\n" * n, "(" * n + "=", "pwd =" + " " * n, "_" * n + "=", "a =" + "\n" * n, ("x =" + "\n" * 300) * 700]
    hostile.append('k0 = "abcdef12"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(60)))
    for text in hostile:
        began = time.perf_counter()
        secrets.spans(text)
        assert time.perf_counter() - began < 5, text[:20]
