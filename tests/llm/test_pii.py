import hashlib
import math
import re

import pandas as pd
import pytest

from tests.conftest import SMALL
from usagelens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TEXTS = [
    "", "a@b.c.d_x@e.f and x@y@z.w, .@a-.b", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.1.1.99999999999999999999", "4111 1111 1111 1111-4111-1111-1111-1111",
    "4111111111111111, 4111 1111 1111 1112 x5", "+1 (974) 555-3436 +12 +1-2-3-4-5-6-7-8-9) +1 234 567 8901 234 567", "é ñ 日本 me@host.example.com 😀 10.0.0.1 😀+49 30 1234567",
    "a.b.c%d+e-f@g", "no data here", "1 " * 60_000, "a@" * 30_000 + "b.c", "7" * 50_000, "." * 50_000 + "@a.b", "1.1." * 20_000, "+1" * 20_000, "x@y" + ".z" * 40_000,
    "+1 (((((" * 5_000, "mail m@x.yz tel +1 202 555 0100 ip 9.9.9.9 card 4111-1111-1111-1111",
]


def test_base_findings_on_awkward_texts(spark, docs):
    got = pii.personal_data(docs(*enumerate(TEXTS), (99, None))).select("doc_id", pii._joined("spans").alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {**{i: base(t) for i, t in enumerate(TEXTS)}, 99: ""}


def test_query(spark):
    got = pii.op1_pii(spark, SMALL).toPandas().set_index("doc_id")
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    assert len(got) == len(table)
    for doc_id, text in zip(table.doc_id, table.text):
        row, want = got.loc[doc_id], base(text or "")
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s and not s.startswith("term")] == [s for s in want.split(",") if s]
        assert all(row[f"n_{k}"] == want.count(f"{k}:") for k in PATTERNS)


@pytest.fixture(scope="module")
def corpus():
    named = [f"Call Zaphod about it at zb@heart.example.com tonight please {w}" for w in ("now", "soon", "later", "again")]
    return list(enumerate([*named, "please come tonight", "about it please", "tonight at last please", "nothing", "else", "Tonight about please"]))


def test_disclosing_terms_and_sanitised_text(spark, docs, corpus):
    rows = [*corpus, (50, None), (None, "x"), (0, corpus[0][1])]
    got = {r.doc_id: r for r in pii.personal_data(docs(*rows)).collect()}
    # n documents, the entity in 5 rows; brute-force disclosure of every word of the contexts
    texts = [t or "" for _, t in rows]
    n, with_entity = len(texts), sum("@" in t for t in texts)
    reveal = {}
    for word in {w.lower() for t in texts for w in re.findall(r"\w{3,}", re.sub(r"\S+@\S+", "", t))}:
        both = sum("@" in t and word in t.lower().split() for t in texts)
        alone = sum(word in t.lower().split() for t in texts)
        if both >= pii.SUPPORT:
            reveal[word] = math.log(n * both / (alone * with_entity)) / math.log(n / with_entity)
    risky = {w for w, d in reveal.items() if d >= pii.GENERALISE}
    assert "zaphod" in risky and "please" not in risky and "tonight" not in risky
    found = {corpus[1][1][s["start"] : s["end"]].lower() for s in got[1]["all"] if s["kind"] == "term"}
    assert found == risky
    assert [s["kind"] for s in got[1]["spans"]] == ["email"] and not got[50]["all"] and not got[4]["all"]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(*rows)).collect()}
    assert clean[4] == corpus[4][1] and clean[50] == ""
    assert "Zaphod" not in clean[1] and "@" not in clean[1] and "[email]" in clean[1] and "please" in clean[1]
    assert pii.personal_data(docs(*rows).limit(0)).count() == 0
