import itertools
import re
import time
from hashlib import sha256

from llm_cases import awkward_docs, docs, prose, with_clashes

from evalspark.llm import secrets

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
WEAK = [("id", re.compile(r"""(?i:client_?id|account_?id|user_?name|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}|(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}""", re.A), {"secret"}),
        ("key", re.compile("[A-Za-z0-9+/]{32,}"), {"ident"}), ("endpoint", re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"), {"ident", "secret"})]
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "id": "ident", "key": "secret", "endpoint": "endpoint"}
NAMES = list(ROLE)


def brute(text, scope=secrets.SCOPE):
    text = text or ""
    strong = [(m.start(), NAMES.index(k), k, m.end()) for k, p, ok in BASE for m in p.finditer(text) if ok(m)]
    mixed = lambda k, m: k != "key" or all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    weak = [(m.start(), NAMES.index(k), k, m.end(), need) for k, p, need in WEAK for m in p.finditer(text) if mixed(k, m)]
    parts = [(x[0], x[3], ROLE[x[2]]) for x in strong + weak]
    apart = lambda a, b: a[1] <= b[0] or b[1] <= a[0]
    met = []
    for x in weak:
        found = [[(s, e) for s, e, r in parts if r == need and abs(s - x[0]) <= scope and (e <= x[0] or s >= x[3])] for need in sorted(x[4])]
        if any(all(apart(a, b) for a, b in itertools.combinations(pick, 2)) for pick in itertools.product(*found)):
            met.append(x[:4])
    form = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(xs))
    return [sum(x[2] == k for x in strong) for k in ("assign", "access", "hex")], sha256(form(strong).encode()).hexdigest(), form(strong + met), sorted(strong + met)


HEX, AKIA, KEY = "0123456789abcdef" * 2, "AKIA" + "ABCD1234" * 2, "aB3/" * 10
TEXTS = [
    f'token = "{HEX}" and AKIA', f"é🎉 {AKIA} Password: hunter22x", "secret: token: abcdefgh", "secret=abc token=abcdefg", "api_key='x' apikey=\"abcdef\"",
    f"{AKIA}{'Z' * 9} AKIASHORT AKIAAKIA{'0' * 14}", f"client_id=alice77 {KEY}", f"client_id=alice77 {'x ' * 300} {KEY}", f"{KEY}", f"https://db.example.com:5432 client_id: bob.smith {KEY}",
    f"https://db.example.com client_id: bob.smith", f"ASIA{'Q' * 12} {'y' * 380} passwd:letmein0", "f" * 23 + " " + "f" * 24, "PASSWORD = = =======", "token:" + "a" * 5000,
    f"TOKEN ſecret paſſword:abcdefgh {HEX}\n{HEX}", f"{'z ' * 5000}{AKIA} https://h.example {HEX}", "deadbeef" * 4 + "ABCDEF", "x" * 399 + HEX + "client_id=abcd",
    "client_id=" + "Abcd1234" * 4, "AKIA" + "ABCD1234" * 2 + "xy12" * 6, "client_id=" + "Abcd1234" * 4 + f" {KEY}", f"token=AKIA{'ABCD1234' * 2} https://a.example",
    f"client_id={'Abcd1234' * 4} https://a.example", f"token=AKIA{'ABCD1234' * 2} https://a.example {HEX}", f"\ufefftoken=abcdefgh \ufeffé {AKIA}\ufeff🎉 secret=abcdef\ufeff",
]


def rows():
    return awkward_docs() + [(100 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(500, TEXTS[0], None, None, None), (500, TEXTS[1], None, None, None), (None, TEXTS[1], None, None, None)]


def test_spans_against_brute_force(spark):
    got = sorted([(r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256, r.spans) for r in secrets.scan(with_clashes(docs(spark, rows()))).collect()], key=str)
    assert got == sorted([(i, *brute(t)[:3]) for i, t, *_ in rows()], key=str)
    assert secrets.scan(docs(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = secrets.scan(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redact_masks_reported_spans_only(spark):
    out = secrets.redact(with_clashes(docs(spark, rows())))
    assert out.columns == with_clashes(docs(spark)).columns

    def masked(text):
        if text is None:
            return None
        done, at = "", 0
        for a, _, _, b in brute(text)[3]:
            if a >= at:
                done += text[at:a] + "[SECRET]"
                at = b
            at = max(at, b)
        return done + text[at:]

    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(i, masked(t)) for i, t, *_ in rows()], key=str)


def test_one_string_is_no_complement_of_itself(spark):
    alone = ["client_id=" + "Abcd1234" * 4, "AKIA" + "ABCD1234" * 2 + "xy12" * 6, f"client_id={'Abcd1234' * 4} https://a.example"]
    got = {r.doc_id: r.spans for r in secrets.scan(docs(spark, [(i, t, None, None, None) for i, t in enumerate(alone)])).collect()}
    assert got == {0: "", 1: "access:0:20", 2: ""}


def test_patterns_run_once(spark):
    """Links read the written parts: the texts are matched when they're written, and hashed once more."""
    plan = secrets.scan(docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_redact_is_linear_in_the_spans(spark):
    def seconds(n):
        df = docs(spark, [(1, "x y z token=abcdef " * n, None, None, None)])
        t = time.time()
        (r,) = secrets.redact(df).collect()
        assert r.text.count("[SECRET]") == n
        return time.time() - t

    seconds(10)
    assert seconds(16000) < 8 * max(seconds(2000), 1.0)


def test_many_parts_in_one_document(spark):
    text = " ".join(f"client_id=user{i:05d} {prose(i, 3)} " + (KEY if i % 7 == 0 else "") for i in range(1500))
    (r,) = secrets.scan(docs(spark, [(1, text, None, None, None)])).collect()
    assert r.spans == brute(text)[2]
