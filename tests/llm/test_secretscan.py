"""Plain spans against a second reading of the patterns; the lexer's pairs, constants and scores on hand-made sources."""

import hashlib
import random
import re
import time

import pytest

from closebook.llm import secretscan
from closebook.llm.queries import QUERIES

KEY = "Zx81kQ_92mPw-71"


def plain_spans(text):
    """The three patterns, one character at a time where that is simple, on ASCII-lowered text elsewhere."""
    out = []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            j += text[j : j + 1] in ('"', "'")  if text[j : j + 1] else 0
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or not text[j : j + 1]:
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] and text[j : j + 1] in "\"'":
                j += 1
            k = j
            while k < len(text) and text[k] in word:
                k += 1
            if k > j:
                end = (k, k - j)
                break
        if end:
            if end[1] >= 6:
                out.append((i, "assign", end[0]))
            i = end[0]
        else:
            i += 1
    for kind, head, letters, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            k = i + len(head)
            while text.startswith(head, i) and k < len(text) and text[k] in letters:
                k += 1
            if text.startswith(head, i) and k > i + len(head):
                if k - i >= least:
                    out.append((i, kind, k))
                i = k
            else:
                i += 1
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[0], order[s[1]]))


PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apiKey", '"', "'", " ", "  ", ":", "=", "abcdef", "x1", "é", "\n", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "ſecret", "toKen", ",", "-", "."]


@pytest.mark.parametrize("seed", range(30))
def test_plain_spans_equal_a_second_reading(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        got = [s[:3] for s in secretscan.scan(text) if s[1] != "literal"]
        assert got == plain_spans(text), text


def literals(text):
    return [(text[s:e], name) for s, kind, e, name, _ in secretscan.scan(text) if kind == "literal"]


@pytest.mark.parametrize("source, name", [
    (f'db_pwd = "{KEY}"', "db_pwd"), (f'{{"dbPwd": "{KEY}"}}', "dbPwd"), (f"credential: {KEY}\n", "credential"), (f"export DB_PASS={KEY}\n", "DB_PASS"), (f'jwt := "{KEY}"', "jwt"), (f'"passphrase" => "{KEY}"', "passphrase"),
    (f'config["pwd"] = "{KEY}"', "config.pwd"), (f'let passphrase: &str = "{KEY}";', "passphrase"), (f"pwd: str = '{KEY}'", "pwd"), (f'if pwd == "{KEY}":', "pwd"), (f'connect(user="a", pwd="{KEY}")', "pwd"),
    (f'props.put("db.pwd", "{KEY}");', "db.pwd"), (f'client.setPassphrase("{KEY}");', "setPassphrase"), (f"<signingKey>{KEY}</signingKey>", "signingKey"), (f"mysql --passphrase {KEY} -u me", "passphrase"),
    (f"postgres://me:{KEY}@host/db", "url password"), (f'pwd = base64.b64decode("{KEY}")', "pwd"), (f'os.environ.get("ADMIN_PWD", "{KEY}")', "ADMIN_PWD"), (f'pwd = f"{KEY}"', "pwd"), (f'pwd = """{KEY}"""', "pwd"),
])
def test_each_syntax_gives_its_pair(source, name):
    assert literals("Some prose, don't mind.\n" + source + "\nmore of it isn't here.") == [(KEY, name)]


def test_constants_are_followed():
    assert literals(f'a = "{KEY}"\nb = a\nlogin(pwd=b)') == [(KEY, "a")]
    assert literals(f'login(pwd=b)\nb = a\na = "{KEY}"') == [(KEY, "a")]  # in any order
    assert literals(f'BASE = "{KEY}"\npwd = "${{BASE}}"') == [(KEY, "BASE")]
    assert literals(f"BASE={KEY}\nDB_PWD=$BASE\n") == [(KEY, "BASE")]
    assert [x for x, _ in literals('pwd = "Zx81kQ_" + "92mPw-71"')] == ["Zx81kQ_", "92mPw-71"]
    assert literals(f'a = "{KEY}"\nb = a\ncolour = b') == []
    assert literals("a = b\nb = a\npwd = a") == []  # a ring without a literal


def test_names_about_secrets_and_placeholders_are_left_alone():
    for text in (f'token_type = "{KEY}"', f'pwd_file = "{KEY}"', 'pwd = "changeme"', 'pwd = "<your-pwd>"', 'pwd = "xxxxxxxx"', "pwd: required", 'pwd = "abc"', f'title = "{KEY}"', "The auth: something", "jwt: hello there"):
        assert literals(text) == [], text
    prose = "She said: nothing (well, almost nothing) was key: to it - don't ask. Time: 12:30, ratio = 3.5, see --verbose output."
    assert literals(prose) == []


def test_plain_spans_stay_and_hold_literals():
    text = f'token = "{KEY}xyz" pwd = "{KEY}"'
    assert [s[1] for s in secretscan.scan(text)] == ["assign", "literal"]
    assert secretscan.sensitivity("dbPassword") == 1 and secretscan.sensitivity("PASSWORD_HINT") < 0.5 and secretscan.sensitivity("") == 0


def test_long_and_broken_texts_end_in_time():
    began = time.time()
    for text in ('"' * 200_001, "'a" * 100_000, "a=" * 100_000, 'x = "' + "a" * 500_000, "\\" * 300_000 + '"', '"""' * 50_001, "a+" * 100_000, "=a+" * 50_000, "--" * 200_000, "-a " * 100_000, "<a>" * 100_000, "a://b:" * 50_000, "(" * 200_000, 'pwd = "a" + ' * 30_000, "[" * 100_000 + '"' * 3, "a" * 500_000, "a." * 200_000):
        secretscan.scan(text)
    assert time.time() - began < 60


def test_report_on_odd_rows(spark):
    texts = [None, "", "é " + f'pwd = "{KEY}"', f'ñ token="{KEY}"', "AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, texts[2], None, None), (None, texts[2], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {
        0: (0, 0, 0, sha(""), ""), 1: (0, 0, 0, sha(""), ""), 2: (0, 0, 0, sha(""), f"literal:9:{9 + len(KEY)}"), 3: (1, 0, 0, sha(f"assign:2:{9 + len(KEY)}"), f"assign:2:{9 + len(KEY)}"),
        4: (0, 1, 1, sha("access:0:20,hex:21:53"), "access:0:20,hex:21:53"),
    }
    got = secretscan.report(docs).collect()
    assert len(got) == 7 and all(tuple(r)[1:] == want[2 if r.doc_id is None else r.doc_id] for r in got)
    assert secretscan.report(docs.limit(0)).count() == 0


def test_query_equals_a_second_reading(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op12_scan_secrets"](spark, sf).collect()}
    n = 0
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = plain_spans(text or "")
        line = ",".join(f"{kind}:{a}:{b}" for a, kind, b in want)
        assert got[doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == tuple(sum(s[1] == k for s in want) for k in ("assign", "access", "hex"))
        assert re.sub(r",?literal:\d+:\d+", "", got[doc_id].spans).strip(",") == line
        n += len(want)
    assert n
