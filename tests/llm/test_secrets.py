"""The lexer's syntaxes, its linear time, and the query's columns by brute force."""

import hashlib
import re
import time

import pytest

from qualitylab.llm import queries, secrets

K = "aB3$kL9zQw2x"
CASES = [
    (f'password = """{K}"""',{K}),(f"password = ('{K}')",{K}),(f"password = \\\n  '{K}'",{K}),(f'secrets = ["{K}", "zZ8!yY7@xX6#"]',{K,"zZ8!yY7@xX6#"}),
    (f"password = b'{K}'",{K}),(f"password = r'{K}'",{K}),(f'k = "{K}"\npassword = f"{{k}}"',{K}),(f"password: |\n  {K}\n  zZ8!yY7@xX6#\nother: 1",{K,"zZ8!yY7@xX6#"}),
    (f"A={K}; DB_PASSWORD=$A",{K}),(f"A='{K}'\nDB_PASSWORD=\"${{A}}\"\n",{K}),(f'#define DB_PASSWORD "{K}"',{K}),(f'password = os.getenv("PW", "{K}")',{K}),
    (f'<add key="password" value="{K}"/>',{K}),(f"dbpassword={K}",{K}),(f"DBPASSWORD={K}",{K}),(f"rootpwd: {K}",{K}),(f'password = "aB3$kL9z" "Qw2xyY7@"',{"aB3$kL9z","Qw2xyY7@"}),
    (f'password = (\n  "aB3$kL9z"\n  "Qw2xyY7@"\n)',{"aB3$kL9z","Qw2xyY7@"}),(f"password = `{K}`",{K}),('password = f"{k}"',set()),('password = os.getenv("PASSWORD_VARIABLE1")',set()),
    ('{"password": {"minimumLength8": 8}}',set()),('password = """unclosed\n'*50,set()),("monkey = 'aB3$kL9zQw2x'",set()),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_syntaxes(text, want):
    assert {text[s:e] for s, e in secrets.literal_spans(text)} == want


@pytest.mark.parametrize("part", ['x=["a",', 'x=("a" "b" "=(', 'password="""', "a: |\n  b", 'x = "a" "b" ', "p=[", 'getenv("', "token=$A", "password=("])
def test_time_follows_length(part):
    def took(n):
        start = time.process_time()
        secrets.literal_spans(part * n)
        return time.process_time() - start

    assert took(40_000) < 6 * max(took(10_000), 0.05)


def test_query_by_brute_force(spark, small):
    def base(t):
        out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
            r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_secret_scan"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base(texts[r.doc_id])
        joined = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {x for x in joined.split(",") if x} <= set(r.spans.split(","))
        literal = {(int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "literal"}
        assert literal == secrets.literal_spans(texts[r.doc_id])
