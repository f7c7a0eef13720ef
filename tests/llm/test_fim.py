import hashlib
import re

import pandas as pd

from tests.conftest import SMALL
from usagelens.llm import fim


def slow(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    chars = (None, None) if form == "plain" else (len(p), len(m))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, *chars, sha(out), sha(text)), (doc_id, form, out)


AWKWARD = [None, "", "x", "<P>", "a<S>b", "<<", "< P >", "<P", ">S> text", "S>M>P>", "é日本 \U0001f600 word\r\n", "word " * 60_000, "letters" * 40_000, "\n" * 30_000, "[`{@ between the cases"]


def test_query_against_brute_force(spark):
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = sorted(tuple(r) for r in fim.op13_fim(spark, SMALL).collect())
    assert got == sorted(slow(int(i), t)[0] for i, t in zip(table.doc_id, table.text))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_awkward_texts_at_many_cuts(spark, docs):
    rows = [(None, "no id here"), (7, "same"), (7, "same"), *((k * 100 + i, t) for k in range(12) for i, t in enumerate(AWKWARD))]
    got = fim.transform(docs(*rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(slow(*r)[0]) for r in rows)
    texts = fim.outputs(docs(*rows)).collect()
    assert sorted(map(str, map(tuple, texts))) == sorted(str(slow(*r)[1]) for r in rows)
    assert fim.transform(docs(*rows).limit(0)).count() == 0 == fim.outputs(docs(*rows).limit(0)).count()


def test_one_exchange_for_both_orders(spark, docs):
    plan = fim.transform(docs((1, "a b c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [row") >= 2


def test_units():
    for text in ["", "ab1c", "1ab", "é2 x", "[a`b{c@"]:
        want = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S)]
        assert fim.unit_starts(text).tolist() == want
