import hashlib
import re
from collections import Counter

import pytest

from flowsight.llm.secrets import base_spans, literal_score, literal_spans, name_score, redact, scan


def values(text):
    return [text[s:e] for s, e, _ in sorted(literal_spans(text))]


def test_fixed_patterns():
    text = 'PassWord : "abcdefgh" token=short api-key=12345678 apikey="q/+_.=-12" ' + "AKIA" + "A1" * 6 + " AKIASHORT " + "0af" * 11 + " 0af"
    found = Counter((k, text[s:e]) for s, e, k in base_spans(text))
    assert found == Counter({
        ("assign", 'PassWord : "abcdefgh'): 1, ("assign", 'apikey="q/+_.=-12'): 1, ("access", "AKIA" + "A1" * 6): 1,
        ("hex", "0af" * 11): 1,
    })
    # A match that is too short still takes its characters.
    assert base_spans("token=api_key:12345678") == []
    assert base_spans("paſſword=12345678 toKen=12345678") == []


def test_names_and_literals():
    assert name_score("dbPassword") == 1.0 and name_score("API_KEY") == 1.0 and name_score("color") == 0.0
    assert name_score("token_url") < 0.5 and name_score("keyboard") == 0.0
    assert literal_score("changeme") == literal_score("${SECRET}") == literal_score("two words1") == literal_score("ab1") == 0.0
    assert literal_score("hT7f-92kQz") > 0.7 > literal_score("abcdefgh")


def test_assignments_of_source_and_configuration():
    assert values('db_passphrase: str = "hT7f-92kQz"') == ["hT7f-92kQz"]
    assert values("conf['client_secret'] = 'hT7f-92kQz'") == ["hT7f-92kQz"]
    assert values('{"privateKey": "hT7f-92kQz", "color": "hT7f-92kQz"}') == ["hT7f-92kQz"]
    assert values("export DB_PWD=hT7f-92kQz\nPORT=8080123") == ["hT7f-92kQz"]
    assert values('<user credential="hT7f-92kQz"/>') == ["hT7f-92kQz"]
    assert values("the secret: information about passwords") == []
    assert values('if password == "hT7f-92kQz":') == []


def test_constants_reach_sensitive_names():
    text = 'base = "hT7f"\nrest = "92kQz8"\nother = "hT7f92kQz9"\nsecret = base + rest\n'
    assert values(text) == ["hT7f", "92kQz8"]
    doubling = 'a = "x1"\n' + "a = a + a\n" * 200 + "secret = a"
    assert literal_spans(doubling) == []


SECRET = "hT7f-92kQz"


@pytest.mark.parametrize("text", [
    'password = """hT7f-92kQz"""', "password = \'\'\'\nhT7f-92kQz\'\'\'", '"password":\n    "hT7f-92kQz"', "auth_key: |\n  hT7f-92kQz\nnext: 1",
    'let auth_key: &str = "hT7f-92kQz";', 'var auth_key string = "hT7f-92kQz"', 'final String password = "hT7f-92kQz";',
    'credential = (\n    "hT7f-92kQz"\n)', 'credential, b = "hT7f-92kQz", 1', 'b, credential = 1, "hT7f-92kQz"', 'credential = x or "hT7f-92kQz"',
    'credential = x ?? "hT7f-92kQz"', 'os.getenv("API_KEY", "hT7f-92kQz")', 'v = os.environ.get("API_KEY", "hT7f-92kQz")',
    'credential = \\\n  "hT7f-92kQz"', 'credential = r"hT7f-92kQz"', 'def f(x, password="hT7f-92kQz"):', 'passphrase = `hT7f-92kQz`',
    'client_secret: Optional[str] = "hT7f-92kQz"', 'secret = decode("hT7f-92kQz")', "secret:\n  - x\nauth_token: >-\n    hT7f-92kQz\n",
])
def test_forms_of_assignments(text):
    assert [v.strip() for v in values(text)] == [SECRET]


def test_parts_blanks_and_keys():
    assert values('credential = (\n  "hT7f"\n  "-92kQz8"\n)') == ["hT7f", "-92kQz8"]
    assert values('credential = "my horse jumps high pass"') == ["my horse jumps high pass"]
    body = "MIIEpAIBAAKCAQEA" * 8
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    assert values(f"key material:\n{key}\nend") == [key]
    assert values("-----BEGIN PRIVATE KEY-----\nnever ends") == [] == values("-----BEGIN CERTIFICATE-----\nx\n-----END CERTIFICATE-----")


def test_clean_texts_stay():
    for text in (
        "Note: the token is described below.\nIt has two parts.", "password:\nuser: name1234\n", 'title = "hT7f-92kQz"\nsecret = ""',
        "time 12:30 and a = b\n", 'label = "enter your password:"', 'password = "Please enter the password again."', "secret: |\nnot indented 123456789",
        '{"password": {"min": 8, "type": "string12345"}}', "tokens: 1234\n", "key:\n",
    ):
        assert values(text) == [], text


def test_long_texts_take_time_in_proportion():
    import time

    texts = ["a = 'x" * 40_000, "password = (" * 20_000, 'secret: """' * 20_000, "key = [\n" * 20_000, "-----BEGIN A PRIVATE KEY-----\n" * 5_000, "auth: |\n  x\n" * 20_000]
    start = time.process_time()
    for text in texts:
        literal_spans(text)
    assert time.process_time() - start < 20


def plain_base(text):
    spans = []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    )):
        spans += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return spans


def test_scan_of_a_table(docs_of, spark):
    rows = [(1, "token: 0123456789abcdef0123456789abcdef"), (2, None), (3, ""), (None, "secret = abcdefgh1"), (1, "x" * 200_000)]
    rows += [(5, "ünï " * 3 + 'pwd = "hT7f-92kQz"'), (5, "ünï " * 3 + 'pwd = "hT7f-92kQz"')]
    found = scan(docs_of(rows)).collect()
    assert len(found) == len(rows) and found[0].asDict()["label"] == "stranger"
    for r in found:
        base = sorted(plain_base(r.text or ""))
        written = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        counts = Counter(k for _, _, _, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert set(written.split(",")) - {""} <= set(r.spans.split(","))
    assert [r.spans for r in found if r.doc_id == 5] == ["literal:19:29"] * 2
    real = scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert all(r.n_assign == sum(s[3] == "assign" for s in plain_base(r.text)) for r in real)
    assert scan(docs_of([])).collect() == []


def test_redaction(docs_of):
    rows = [(1, "a token: 0123456789abcdef0123456789abcdef b"), (2, None), (3, "clean")]
    found = {r.doc_id: r for r in redact(docs_of(rows)).collect()}
    assert found[1].text == "a [SECRET] b" and found[1].n_chars == 12
    assert found[2].text is None and found[2].n_chars is None and found[3].text == "clean"
    assert found[3].label == "stranger"
    assert redact(docs_of([])).collect() == []
