import hashlib
import random
import re

import pytest

from sightline.llm import personal_data, secrets
from tests.conftest import SF01
from tests.llm.cases import awkward, docs

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m.group())
    if kind == "ip":
        return all(int(x) <= 255 for x in m.group().split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "assign":
        return len(m.group(2)) >= 6
    return kind == "email" or len(m.group()) >= {"access": 20, "hex": 24}[kind]


def brute(text, kinds):
    out = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if good(name, m)]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out)), [sum(x[3] == n for x in out) for n in kinds]


def noisy(n, alphabet, seed):
    r = random.Random(seed)
    return [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(n)]


def compare(got, rows, kinds):
    want = {}
    for i, t in rows:
        s, n = brute(t, kinds)
        want[i] = (*n, hashlib.sha256(s.encode()).hexdigest(), s)
    assert len(got) == len(rows)
    names = list(kinds)
    for r in got:
        *n, sha, s = want[r.doc_id]
        assert [r[f"n_{k}"] for k in names] == n and r.base_sha256 == sha, (r, s)
        own = [x for x in r.spans.split(",") if x.split(":")[0] in kinds]
        assert ",".join(own) == s


PII_BITS = ["a", "b.c", "@", ".", "-", "1", "255", "256", "12.3.4.5", " ", "+1", "(", ")", "4111 1111 1111 1111", "555", "é", "\U0001f600", "x@y.z", "_", "%", "\n", "00", "+49 30 1234567"]
SECRET_BITS = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "x", "é", "\U0001f600", "passwd", ".", "-", "Z9+/", "\n"]


@pytest.mark.parametrize(("run", "kinds", "bits"), [(personal_data.personal_spans, PII, PII_BITS), (lambda d: secrets.secret_spans(d), SECRETS, SECRET_BITS)])
def test_base_spans(spark, run, kinds, bits):
    rows = noisy(3000, bits, 1)
    compare(run(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, kinds)
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    compare(run(df).collect(), [(r.doc_id, r.text) for r in df.collect()], kinds)


@pytest.mark.parametrize("run", [personal_data.personal_spans, lambda d: secrets.secret_spans(d)])
def test_awkward_rows(spark, run):
    got = run(docs(spark)).collect()
    assert len(got) == len(awkward())
    assert all(r.spans == "" for r in got if r.doc_id < 9)
    assert run(docs(spark, [])).count() == 0
    plan = run(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_runs_take_no_stack_and_no_quadratic_time(spark):
    rows = [(1, "1" * 120_000), (2, "a" * 120_000), (3, "1.2.3.4." * 15_000), (4, "a." * 60_000 + "@b"), (5, "1-" * 60_000), (6, "a@b.c " * 5_000), (7, "password=" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.personal_spans(df).collect()}
    assert got[6].n_email == 5000 and got[3].n_ip == 15_000 and got[1].n_card == 0
    assert len(secrets.secret_spans(df).collect()) == len(rows)


def test_models_tell_random_strings(spark):
    r = random.Random(9)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(i, f"the ordinary words of user account by identifier and international organization, name value order item, password={key()} end") for i in range(300)]
    rows += [(1000 + i, f"see {key()} there") for i in range(50)] + [(2000 + i, "useraccountidentifier internationalorganization ordinarywordsoftheuser") for i in range(50)]
    got = {x.doc_id: x for x in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i].n_markov == 1 for i in range(50)) >= 48
    assert all(got[2000 + i].n_markov == 0 for i in range(50))
    assert got[1000].spans == "markov:4:44"


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(i, f"please write to member contact: user{i}@mail.example.com today") for i in range(40)]
    rows += [(100 + i, f"ask member contact: XK-77{i}A soon") for i in range(5)] + [(200 + i, f"room number {i}12345 is free") for i in range(50)]
    got = {x.doc_id: x for x in personal_data.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].spans == "context:20:27" for i in range(5))
    assert all(got[200 + i].spans == "" for i in range(50)) and all(got[i].n_email == 1 and got[i].n_context == 0 for i in range(40))


def test_contexts_of_any_length(spark):
    """Words that only differ far from an identifier are different contexts."""
    known, unknown = "x" * 30 + "y" * 64, "z" * 30 + "y" * 64
    rows = [(i, f"write to {known} user{i}@mail.example.com today") for i in range(40)]
    rows += [(100 + i, f"ask at {known} XK-77{i}A soon") for i in range(5)] + [(200 + i, f"ask at {unknown} XK-88{i}A soon") for i in range(5)]
    got = {x.doc_id: x for x in personal_data.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].n_context == 1 for i in range(5)) and all(got[200 + i].n_context == 0 for i in range(5))


def test_recall_of_planted_identifiers(spark):
    """Account numbers planted in the documents of sf0.01 behind three phrases that stand before e-mail addresses elsewhere: at least nine tenths are found."""
    r = random.Random(4)
    phrases = ["reach the desk:", "my contact is", "Reply-To:"]
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    planted = {}
    for k, (i, text) in enumerate(rows):
        if k % 3 and k % 8 < 4:
            at = text.find(" ", r.randrange(len(text))) + 1
            thing = f"agent{k}@corp{k % 7}.example" if k % 8 < 2 else f"AC{r.randrange(10**7)}-{r.choice('QRST')}"
            before = text[:at] + r.choice(phrases) + " "
            rows[k] = (i, before + thing + " " + text[at:])
            if k % 8 >= 2:
                planted[i] = f"context:{len(before)}:{len(before) + len(thing)}"
    got = {x.doc_id: x.spans.split(",") for x in personal_data.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(s in got[i] for i, s in planted.items())
    assert len(planted) > 100 and found >= 0.9 * len(planted), (found, len(planted))
