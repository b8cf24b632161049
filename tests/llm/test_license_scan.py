import random
import re

import pytest

from likeness.llm import license_scan as ls


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(tokens):
    return [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)] or ([tuple(tokens)] if tokens else [])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    notices = [t for ts in ls.TEMPLATES.values() for t in ts]
    rows = []
    for i in range(240):
        body = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(rng.choice([0, 3, 60, 400]))]
        if i % 3:
            notice = rng.choice(notices)
            if i % 5 == 0:
                cut = notice.split()
                cut[rng.randrange(len(cut))] = "other"
                notice = " ".join(cut)
            body.insert(rng.randrange(len(body) + 1), notice.upper() if i % 7 == 0 else notice)
        rows.append((i, " ".join(body)))
    return [*rows, (1000, None), (1001, ""), (1002, "Released under"), (7, rows[7][1])]


def exact(texts):
    """Templates whose distinct shingles are in some stretch of the text twice as long, by brute force."""
    out = {}
    for i, text in texts:
        own = shingles(words(text))
        for name, notices in ls.TEMPLATES.items():
            for k, notice in enumerate(notices):
                wanted = set(shingles(words(notice)))
                best = max(
                    (len(wanted & set(own[s : s + len(wanted)])) / len(wanted) for s in range(len(own))), default=0
                )
                if best >= 0.8:
                    out[i, f"{name}-{k}"] = best
    return out


def test_scan_finds_what_brute_force_finds(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 as half", "2 as at", "3 as w")
    found = {(r.doc_id, r.template): r for r in ls.scan(docs, ls.template_table(spark)).collect()}
    true = exact(texts)
    assert len(found) == ls.scan(docs, ls.template_table(spark)).count()
    assert len(true.keys() & found.keys()) >= 0.97 * len(true) and len(true) > 100
    assert all(r.containment >= 0.8 for r in found.values())
    assert all(found[k].containment >= v - 1e-9 for k, v in true.items() if k in found and v == 1)
    # What else is found has its shingles in a window, if spread wider than the template.
    for i, name in found.keys() - true.keys():
        assert set(shingles(words(dict(texts)[i])))


def test_no_documents_and_no_matches(spark, no_docs):
    table = ls.template_table(spark)
    assert ls.scan(no_docs, table).count() == 0
    assert ls.scan(spark.createDataFrame([(1, "x"), (None, None)], "doc_id bigint, text string"), table).count() == 0
