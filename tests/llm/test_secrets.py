"""Random tokens of few digits, or none."""

import math
import random
import re
import string
from collections import Counter

import pytest

from spendlens.llm import secrets_scan

BASE64 = string.ascii_letters + string.digits + "+/"


@pytest.mark.parametrize("alphabet, length", [(BASE64, 20), (BASE64, 32), (string.ascii_uppercase + "234567", 20), (string.ascii_letters, 40), (string.ascii_lowercase, 40), (string.ascii_uppercase, 24), (string.digits, 20)])
def test_tokens_of_any_alphabet_are_found(spark, alphabet, length):
    r = random.Random(4)
    secrets = ["".join(r.choice(alphabet) for _ in range(length)) for _ in range(200)]
    got = secrets_scan.digest(spark.createDataFrame(list(enumerate(secrets)), "doc_id long, text string")).collect()
    assert sum(f"random:0:{length}" in x.spans for x in got) >= 180


def test_identifiers_are_rejected(spark):
    plain = ["getCustomerAddressFromDatabase", "monthly_summary_of_the_organisation", "internationalisation", "src/main/java/org/example/service", "=" * 40, "-" * 40, "a" * 40]
    rows = [(i, f"see {t} there") for i, t in enumerate(plain * 20)]
    got = secrets_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not [plain[x.doc_id % len(plain)] for x in got if "random" in x.spans]


def tail(z):
    return max(1e-12, 1 / (1 + math.exp(min(30.0, 1.5976 * z + 0.07056 * z**3))))


def chi_tail(chi2, df):
    spread = 2 / (9 * df)
    return tail(((max(chi2, 0) / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def plain_battery(token):
    """The combined p-value of the tests, in plain Python."""
    core = re.sub("=+$", "", token.translate(str.maketrans("-_", "+/")))
    alphabet = next((a for p, a in secrets_scan.ENCODINGS if re.fullmatch(p.strip("^$"), core)), None)
    if alphabet is None or len(core) < 18:
        return None
    x, n, k = [alphabet.index(c) for c in core], len(core), len(alphabet)
    ps = [chi_tail(sum(c * c for c in Counter(x).values()) * k / n - n, k - 1)]
    high = [2 * v >= k for v in x]
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    ps.append(min(1.0, 2 * tail(abs((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(var)))) if var > 0 else 1e-12)
    m = sum(x) / n
    var = sum(v * v for v in x) - n * m * m
    ps.append(min(1.0, 2 * tail(abs(((sum(a * b for a, b in zip(x, x[1:])) - (n - 1) * m * m) / var + 1 / n) * math.sqrt(n)))) if var > 1e-9 else 1e-12)
    kinds = (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())
    parts = [(sum(map(f, core)), sum(map(f, alphabet)) / k) for f in kinds]
    parts = [(c, s) for c, s in parts if s]
    if len(parts) > 1:
        ps.append(chi_tail(sum((c - n * s) ** 2 / (n * s) for c, s in parts), len(parts) - 1))
    half = -sum(map(math.log, ps))
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps)))


def plain_spans(texts):
    """The method's spans in texts without base spans: tested one by one, cut off in each band of lengths where a tenth is in excess of uniform."""
    found = []
    for i, t in enumerate(texts):
        for m in re.finditer(secrets_scan.CANDIDATE, t):
            if (p := plain_battery(m[0])) is not None:
                found.append((sum(len(m[0]) >= b for b in secrets_scan.BANDS[1:]), min(1600, math.ceil(-100 * math.log10(p))), i, m.start(), m.end()))
    out = {i: [] for i in range(len(texts))}
    for band in {f[0] for f in found}:
        bins = [f[1] for f in found if f[0] == band]
        sure, best = sum(b <= 70 for b in bins), -1
        for b in set(bins):
            reported = sum(x <= b for x in bins)
            if reported - sure * (1 - 10 ** (-b / 100)) / (1 - 10**-0.7) <= 0.1 * reported:
                best = max(best, b)
        for _, b, i, s, e in (f for f in found if f[0] == band and f[1] <= best):
            out[i].append(f"random:{s}:{e}")
    return {i: ",".join(sorted(x, key=lambda y: int(y.split(":")[1]))) for i, x in out.items()}


def test_method_spans_against_plain_python(spark):
    r = random.Random(12)
    alphabets = [BASE64, BASE64 + "-_", string.ascii_uppercase + "234567", string.digits, string.ascii_letters, string.digits + "ABCDEF"]
    words = ["internationalisation", "src/main/java/org/example/service", "getCustomerAddressFromDatabase", "monthly_summary_of_the_organisation", "z" * 40, "é", "see", "==", "ZZZZZZZZYYYYYYYYXXXXXXXX"]
    texts = [" ".join(r.choice(words) if r.random() < 0.7 else "".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([19, 20, 33, 50, 120]))) + r.choice(["", "="]) for _ in range(r.randint(0, 8))) for _ in range(300)]
    got = {x.doc_id: x.spans for x in secrets_scan.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == plain_spans(texts) and sum(map(bool, got.values())) > 50


def test_random_tokens_have_uniform_p():
    r = random.Random(2)
    for _, alphabet in secrets_scan.ENCODINGS:
        for n in (20, 40, 96):
            ps = [p for p in (plain_battery("".join(r.choice(alphabet) for _ in range(n))) for _ in range(400)) if p is not None]
            assert all(abs(sum(p <= q for p in ps) / len(ps) - q) < 0.1 for q in (0.1, 0.2, 0.5, 0.8))
