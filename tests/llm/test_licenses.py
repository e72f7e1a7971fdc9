import math
import re

from panelspark.llm import licenses as lc


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(t):
    w = words(t)
    places = [(i, label) for p, label in lc.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found, best = set(), 0.0
    for k in range(0, max(len(w) - 32, 1), 32):
        block = set(w[k : k + 64])
        for label, ts in lc.TEMPLATES.items():
            for x in ts:
                s = set(x.split())
                n = len(s & block)
                if n >= math.ceil(0.8 * len(s) - 1e-9):
                    found.add(label)
                    best = max(best, n / len(s))
    base = {x for _, x in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


def same(rows, out):
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels, round(r.score, 9)) for r in out)
    exp = sorted((str(d), x[0], x[1], str(x[2]), str(x[3]), x[4], x[5], round(x[6], 9)) for d, t in rows for x in [brute(t)])
    assert got == exp


def test_edge_cases(spark):
    noise = "lorem ipsum dolor sit amet "
    mit = lc.TEMPLATES["mit-notice"][0]
    rows = [(1, None), (2, ""), (3, "MIT License"), (4, "the mit-license, General Public License; apache license mit license"), (5, noise * 30 + mit.upper() + noise * 50), (6, noise * 7 + mit.replace("hereby granted", "x y") + noise),
            (7, "Licensed under CC BY-NC 4.0."), (8, "license mit public license general"), (9, "ümit license µ 漢字 license"), (9, "MIT License"), (None, "MIT License"), (11, "!!!"), (12, noise * 3000 + "Apache\nLicense")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, key string")
    same(rows, lc.scan(docs).collect())
    assert lc.scan(docs.limit(0)).count() == 0


def test_query_on_whole_table_and_plan(spark):
    from panelspark.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op3_license_notices"](spark, sf)
    same(rows, df.collect())
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_long_templates_are_found_wherever_they_lie(spark):
    long, short = " ".join(f"word{k}" for k in range(100)), "licensed under some terms"
    filler = lambda n: " ".join(f"plain{k}" for k in range(n))
    rows = [(str(k), f"{filler(k)} {long} {filler(57)}".split()) for k in (0, 1, 31, 64, 99, 100, 101, 163, 250)]
    rows += [("half", f"{filler(40)} {' '.join(long.split()[:79])}".split()), ("most", f"{filler(130)} {' '.join(long.split()[20:])}".split()), ("both", f"{long} {filler(300)} {short}".split())]
    got = {r.key: (r.found, r.best) for r in lc.notices(spark.createDataFrame(rows, "key string, words array<string>"), templates={"long": [long], "short": [short]}).collect()}
    assert got == {k: (["long"], 1.0) for k, _ in rows if k.isdigit()} | {"most": (["long"], 0.8), "both": (["long", "short"], 1.0)}
