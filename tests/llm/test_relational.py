"""Line dedup, URL filters, mixing, tool calls: nulls, ties, repeats, empty and long inputs."""

from __future__ import annotations

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, queries, tool_calls, topk, url_filter

DOCS = "doc_id long, text string, source string, h string, lines string, size int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], DOCS)


# -- line dedup


def test_dedup_rules(spark):
    rows = [
        (5, "A shared long line\nown line five here\nshort", "a"),
        (3, "  a SHARED long LINE\t\nown line three", "a"),
        (9, "a shared long line\na shared long line\nshort", "a"),
        (7, None, "a"), (8, "", "a"), (11, "twice in one document\ntwice in one document", "a"), (12, "ÄÖ unicode line key\nx", "a"), (13, "äö unicode line key", "a"),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[3] == ("  a SHARED long LINE\t\nown line three", 2, 0)
    assert got[5] == ("own line five here\nshort", 3, 1)
    assert got[9] == ("short", 3, 2)
    assert got[7] == got[8] == ("", 1, 0)
    assert got[11][2] == got[12][2] == got[13][2] == 0  # only A-Z are lower-cased


def test_dedup_repeated_rows_and_null_ids(spark):
    line = "the very same line"
    rows = [(1, line, "a"), (1, line, "a"), (1, f"other text here\n{line}", "a"), (None, line, "a"), (None, line, "a")]
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert got == [("1", f"other text here\n{line}", 0), ("1", line, 0), ("1", line, 0), ("None", "", 1), ("None", "", 1)]


def test_dedup_long_and_empty(spark):
    long = "\n".join(f"a line with number {i}" for i in range(20_000))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, [(1, long, "a"), (2, long + "\nlast line stays here", "a")])).collect()}
    assert got[2].text == "last line stays here" and got[2].n_dropped == 20_000 and got[1].n_dropped == 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_dedup_carries_columns(spark):
    out = line_dedup.dedup_lines(docs(spark, [(1, "x", "s")]), carry=["source", "h", "lines", "size"]).first()
    assert (out.source, out.h, out.lines, out.size) == ("s", "x", "y", 1)


# -- URL filters


def test_rules(spark):
    urls = {
        "http://a.com/": ("a.com", "/", "com/", "allow"), "https://B.Example.COM/en/x?q#f": ("b.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://com/": ("com", "/", "com/", "allow"), "http://a.com": ("a.com", "", None, None),
        "no scheme": ("", "", None, None), "": ("", "", None, None), "http://a.com?x/": ("a.com", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(99, None, "x", "y"), (0, "http://a.com/", "x", "y")], "page_id long, url string, host string, score string")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        host, path, rule, verdict = urls.get(r.url, ("", "", None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn(spark):
    """Without a rule the trees follow the suffix and the path that the labels show."""
    rows = [f"http://s{i}.com/{'en' if i % 2 else 'fr'}/{i}" for i in range(200)] + [f"http://t{i}.net/es/{i}?a=1&b={i}" for i in range(200)]
    rows += [f"http://u{i}.net/it/{i}?a=1&b={i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    out = url_filter.judge_urls(pages)
    unruled = [r.verdict for r in out.where("rule is null").collect()]
    assert len(unruled) == 20 and set(unruled) == {"block"}
    wrong = out.where("rule is not null and (score >= 0.5) <> (verdict = 'block')").count()
    assert wrong == 0
    assert sorted(out.collect()) == sorted(url_filter.judge_urls(pages.repartition(3)).collect())


def test_parameters_end_at_the_fragment(spark):
    urls = {"http://a.org/x#y?a=1&b=2": 0, "http://a.org/x?a=1&b=2#y?c": 2, "http://a.org/x?": 0, "http://a.org/?a": 1, "a#b": 0}
    pages = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", F.lit("a.org")).withColumn("path", F.lit("/x"))
    assert {r.url: int(r.n_params) for r in url_filter.lexical(pages).collect()} == urls


def plain_rule(url):
    """host, path, rule and verdict from the contract's words."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_on_the_table(spark, small_dir):
    rows = url_filter.judge_urls(spark.read.parquet(f"{small_dir}/pages.parquet"), settings=url_filter.Settings(trees=1)).collect()
    assert len(rows) >= 50
    for r in rows:
        host, path, rule, verdict = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)


def test_trees_against_plain_boosting(spark, small_dir):
    """Every split searched over the rows themselves; the same scores come out."""
    import math

    import numpy as np

    s = url_filter.Settings(trees=4, depth=2, bins=6)
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "url")
    rng = __import__("random").Random(3)
    more = [(10_000 + i, f"http://h{rng.randrange(9)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'en', 'x1'])}/{'y' * rng.randrange(30)}?{'a=1&' * rng.randrange(4)}") for i in range(400)]
    pages = pages.unionAll(spark.createDataFrame(more, "page_id long, url string"))
    got = {r.page_id: r.score for r in url_filter.judge_urls(pages, settings=s).collect()}
    host, path = url_filter.split_url(F.col("url"))
    table = url_filter.lexical(pages.select("*", host.alias("host"), path.alias("path"))).toPandas()
    verdicts = [plain_rule(u)[3] for u in table["url"]]
    known = np.array([v is not None for v in verdicts])
    y = np.array([v == "block" for v in verdicts], float)
    prior = (y[known].sum() + 1) / (known.sum() + 2)
    for key in ("suffix", "suffix2", "segment"):
        sums = {}
        for k, v in zip(table[key][known], y[known], strict=True):
            a = sums.setdefault(k, [0, 0])
            a[0], a[1] = a[0] + v, a[1] + 1
        table[key + "_rate"] = [(sums[k][0] + s.prior_weight * prior) / (sums[k][1] + s.prior_weight) if k in sums else prior for k in table[key]]
    x = table[list(url_filter.FEATURES)].to_numpy(float)
    bins = np.zeros(x.shape, int)
    for f in range(x.shape[1]):
        edges = sorted({float(np.percentile(x[known, f], 100 * i / s.bins)) for i in range(1, s.bins)})
        bins[:, f] = (x[:, f][:, None] > np.array(edges)).sum(axis=1)
    margin = np.full(len(x), math.log(prior / (1 - prior)))
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.round((p - y) * 2**24) / 2**24, np.round(p * (1 - p) * 2**24) / 2**24

        def grow(rows, depth):
            fit = rows[known[rows]]
            G, H = g[fit].sum(), h[fit].sum()
            best = (1e-6, None)
            for f in range(x.shape[1]) if depth else ():
                for b in np.unique(bins[fit, f])[:-1]:
                    left = fit[bins[fit, f] <= b]
                    a, c = g[left].sum(), h[left].sum()
                    gain = a * a / (c + s.l2) + (G - a) ** 2 / (H - c + s.l2) - G * G / (H + s.l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
            if best[1] is None:
                margin[rows] += -s.rate * G / (H + s.l2)
                return
            low = bins[rows, best[1][0]] <= best[1][1]
            grow(rows[low], depth - 1)
            grow(rows[~low], depth - 1)

        grow(np.arange(len(x)), s.depth)
    for i, m in zip(table["page_id"], margin, strict=True):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-9)


def test_urls_empty_and_unlabelled(spark):
    schema = "page_id long, url string"
    assert url_filter.judge_urls(spark.createDataFrame([], schema)).count() == 0
    r = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.org/x")], schema)).first()
    assert (r.rule, r.verdict, r.score) == (None, "allow", 0.5)


# -- mixing


def test_mixing_hits_targets(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 4}") for i in range(800)] + [(1000 + i, "w w", None) for i in range(30)] + [(2000, None, "s1"), (2001, "", "s1"), (0, "w ", "s0")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    assert sorted(out, key=str) == sorted(mixing.mix(docs(spark, rows[::-1])).collect(), key=str)


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None)])).collect()] == [0]
    one = mixing.mix(docs(spark, [(1, "a b c", "s")])).first()
    assert one.target == 4.5 and one.taken in (3, 6)
    assert mixing.mixed_rows(docs(spark, [(None, "a b c", "s")])).columns == docs(spark, []).columns


def test_rates_balance_entropy(spark):
    """Every source's rates are min(2, exp(l * size)) for one l, and take the target's words: the
    conditions under which no other rates up to 2 have less relative entropy to one of each."""
    import math

    rows = [(i, "w " * (1 + i * i % 97 + 3000 * (i % 50 == 0)), "s2" if i % 2 else f"s{i % 5}") for i in range(1500)] + [(5000 + i, "w " * (i + 1), None) for i in range(5)] + [(6000, "", "s1"), (6001, None, "s9")]
    by = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        by.setdefault(r.source, []).append(r)
        assert r.size or (r.copies, r.taken) == (1, 0)
    tilts = {}
    for source, v in by.items():
        v = [r for r in v if r.size]
        got = sum(r.rate * r.size for r in v)
        assert got == pytest.approx(v[0].target, rel=1e-10) if v else True
        open_ = [math.log(r.rate) / r.size for r in v if r.rate < 2]
        if open_:
            tilts[source] = open_[0]
            assert open_ == pytest.approx([open_[0]] * len(open_), rel=1e-6)
            assert all(open_[0] * r.size >= math.log(2) - 1e-9 for r in v if r.rate >= 2)
    assert min(tilts.values()) < 0 < max(tilts.values())
    # no document is rounded by more than one copy
    assert all(abs(r.copies - r.rate) < 1 for v in by.values() for r in v)


def test_targets_with_many_sources(spark):
    """Running totals over ranges of sources against the definition, round by round."""
    sizes = [(f"h{i}" if i else None, 1 + i * 7919 % 1000 * (1 if i % 9 else 100)) for i in range(700)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long").repartition(5)).collect()}
    names = sorted(sizes, key=lambda x: (x[0] is None, x[0]))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, (s, _) in enumerate(names)}
    size, full = dict(sizes), set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        more = {s for s in size if s not in full and level * weight[s] >= 2 * size[s]}
        if not more:
            break
        full |= more
    assert full and got == pytest.approx({s: 2.0 * size[s] if s in full else level * weight[s] for s in size})


# -- tool calls

SCHEMA = {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {"x": ("number", True), "y": ("any", False)}}
CALLS, RESULTS = "conv_id long, call_id string, turn long, name string, arguments string, after string, depth int", "conv_id long, call_id string, content string"


def test_calls(spark):
    calls = [
        (1, "c", 3, "f", '{"b":"q", "a":1}', "b", 0), (1, "a", 1, "f", '{"a":1}', None, 0), (1, "b", 2, "g", '{"x":1.5,"y":[1]}', "a", 0),
        (1, "d", 4, "f", '{"a":"1"}', "gone", 0), (1, "e", 5, "f", "{}", None, 0), (1, "f", 6, "f", '{"a":1,"z":2}', None, 0), (1, "g", 7, "h", "{}", None, 0),
        (1, "h", 8, "f", "nope", None, 0), (1, "i", 9, "f", None, None, 0), (1, "j", 10, "f", "[1]", None, 0), (2, "p", 1, "f", '{"a":1}', "q", 0), (2, "q", 2, "f", '{"a":1}', "p", 0),
        (1, "a", 1, "f", '{"a":1}', None, 0), (None, "z", 1, "f", "{}", None, 0), (3, None, 1, "f", "{}", None, 0),
    ]
    results = [(1, "a", "two"), (1, "a", "one"), (1, "c", None), (9, "a", "x"), (2, "p", "r"), (None, "a", "q")]
    out = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA)
    got = {(r.conv_id, r.call_id): r for r in out.collect()}
    assert len(got) == 12
    assert [got[1, k].depth for k in "abcd"] == [0, 1, 2, 0]
    assert (got[1, "a"].status, got[1, "b"].status, got[1, "c"].status) == ("linked", "unanswered", "linked")
    assert got[2, "p"].status == got[2, "q"].status == "cycle"
    errors = {k: got[1, k].error for k in "defghij"}
    assert errors == {"d": "type: a", "e": "missing: a", "f": "unknown: z", "g": "unknown function", "h": "not JSON", "i": "not JSON", "j": "not an object"}
    assert got[1, "c"].message == '{"after":"b","arguments":{"a":1,"b":"q"},"content":null,"id":"c","name":"f"}'
    assert json.loads(got[1, "a"].message)["content"] == "one"


def test_canonical_json(spark):
    """Spellings of equal values give one text."""
    same = [
        (["1", "1.0", "10e-1", "1.00E0", "1e0"], "1"), (["-0", "-0.0", "0e5", "0"], "0"), (["100", "1e2", "1E+2", "100.000"], "100"),
        (["0.1", "1e-1", "0.10"], "0.1"), (["1e21"], "1e+21"), (["1e20"], "100000000000000000000"), (["0.000001", "1e-6"], "0.000001"), (["1e-7", "0.0000001"], "1e-7"),
        (["-1.5e-9"], "-1.5e-9"), (["1234567.25"], "1234567.25"), (["12345678.5", "1.23456785e7"], "12345678.5"), (["9007199254740993"], "9007199254740993"), (["1.5e300"], "1.5e+300"),
        (["0.00012"], "0.00012"), (["-123.456e3"], "-123456"),
        (['{"b":1.0,"a":[1e1,"1.0 \\" 2e3",{"d":null,"c":-0.0}]}', ' { "a" : [10, "1.0 \\" 2e3", {"c":0,"d":null}], "b":1}'], '{"a":[10,"1.0 \\" 2e3",{"c":0,"d":null}],"b":1}'),
        (['"' + "1.0 " * 50_000 + '"'], '"' + "1.0 " * 50_000 + '"'), (["[]"], "[]"), (["{}"], "{}"), (["true"], "true"), (["nope", "", None, "01"], None),
    ]
    rows = [(x, want) for texts, want in same for x in texts]
    out = spark.createDataFrame(rows, "x string, want string").select("x", "want", tool_calls.canonical(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in out if r.got != r.want] == []


def test_long_arguments(spark):
    long = json.dumps({"a": 1, "b": "é\n\"" * 200_000})
    calls = spark.createDataFrame([(1, "a", 1, "f", long, None, 0)], CALLS)
    got = tool_calls.link_calls(calls, spark.createDataFrame([(1, "a", "r" * 1_000_000)], RESULTS), SCHEMA).first()
    assert json.loads(got.message) == {"after": None, "arguments": json.loads(long), "content": "r" * 1_000_000, "id": "a", "name": "f"}


def test_long_chain(spark):
    n = 300
    calls = spark.createDataFrame([(1, str(i), i, "f", '{"a":1}', str(i - 1), 0) for i in range(n)], CALLS)
    got = tool_calls.link_calls(calls, spark.createDataFrame([], RESULTS), SCHEMA)
    assert {int(r.call_id): r.depth for r in got.collect()} == {i: i for i in range(n)}
    assert tool_calls.link_calls(calls.limit(0), spark.createDataFrame([], RESULTS), SCHEMA).count() == 0


# -- top-k


def test_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = {i: [float(np.float32(v)) for v in rng.normal(0, 0.2, 8)] for i in range(300)}
    for i in range(40, 90):
        vectors[i] = vectors[40]  # one vector in many rows: ties go to the smaller id
    rows = [(i, v, "x") for i, v in vectors.items()] + [(500, None, "x"), (501, [1.0, None] * 4, "x"), (502, [float("nan")] * 8, "x"), (550, [float("inf")] * 8, "x"), (None, [0.5] * 8, "x"), (600, [], "x"), (7, vectors[7], "x"), (50, vectors[8], "x"), (51, vectors[9], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = [(r[0], np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(int)) for r in rows if r[0] is not None and r[0] not in (500, 501, 502, 550)]
    want = []
    for a in sorted({i for i, _ in q if i % 50 == 0}):
        best = sorted((-int(v @ w), b) for i, v in q if i == a for b, w in q if b != a and len(v) == len(w))[:5]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    got = topk.top_k(df, block=64, query_block=2).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    # two rows of one id are two candidates, also for a query of two rows
    few = spark.createDataFrame([(50, [0.5]), (51, [0.25]), (51, [0.75]), (52, [0.5]), (100, []), (101, []), (100, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(few).collect()) == [(50, 1, 51, 24576), (50, 2, 52, 16384), (50, 3, 51, 8192), (100, 1, 101, 0), (100, 2, 101, 0)]


def test_reading_stops_early():
    """Fewer components are read than there are, and none of a portion that begins too low."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.125, (8192, 16))).astype(int)
    x[:5] = x[5]  # the best portion comes first
    x[6000:] = 0
    read = {}
    got = topk.nra_topk(np.arange(5, 25), x[5:25], np.arange(len(x)), x, 5, read)
    for i in range(5, 25):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:5]
        assert [(j, s) for a, j, s in got if a == i] == [(j, -s) for s, j in want]
    assert read["list"] + read["final"] < 0.6 * 20 * x.size


def test_queries_read_the_lists_together(monkeypatch):
    """The passes over a portion's lists do not grow with the queries, and every query keeps its own results."""
    import numpy as np

    calls, one = [], topk.survivors
    monkeypatch.setattr(topk, "survivors", lambda q, *args: calls.append(1) or one(q, *args))
    rng = np.random.default_rng(4)
    x = rng.integers(-128, 128, (topk.PORTION + 500, 8))
    x[100:140] = x[7]  # equal scores
    ids = np.arange(len(x)) // 2 * 2  # two rows of every id
    got = topk.nra_topk(ids[:300], x[:300], ids, x, 5)
    assert len(calls) <= 4
    scores = x[:300] @ x.T
    want = []
    for i in range(300):
        want += [(ids[i], j, -s) for s, j in sorted((-s, j) for s, j in zip(scores[i].tolist(), ids.tolist(), strict=True) if j != ids[i])[:5]]
    assert got == want


@pytest.mark.parametrize("scale", [1, 10**6, 10**13])
def test_topk_is_exact_at_any_size(scale):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (500, 16)) * scale // 10**6 if scale > 1 else rng.integers(-100, 100, (500, 16))
    ids = np.arange(500)
    got = topk.nra_topk(ids[:7], x[:7], ids, x, 5)
    for i in range(7):
        want = sorted(((-int(x[i].astype(object) @ x[j].astype(object)), j) for j in range(500) if j != i))[:5]
        assert [(s, j) for a, j, s in got if a == i] == [(-s, j) for s, j in want]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE[name]).df(), queries.QUERIES[name](spark, small_dir).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    clean = lambda f: sorted(map(tuple, f[cols].astype(object).where(f[cols].notna(), None).values.tolist()), key=str)
    assert clean(got) == clean(want)


def test_digest_of_kept_text(spark, small_dir):
    r = line_dedup.op2_line_dedup(spark, small_dir).orderBy("doc_id").first()
    text = spark.read.parquet(f"{small_dir}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.n_dropped or r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
