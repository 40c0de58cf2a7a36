"""URL templates and nearest neighbours against loops over all rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import difference
from tokenmill.llm import oracles, path_templates, permutations
from tokenmill.llm.queries import RULES


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def best(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def judge(rows, rules, depth=3, z=1.96, strength=4.0, threshold=0.5):
    """The template tree in plain Python, segment by segment as deep as paths go."""
    parsed = [(i, *host_path(u)) for i, u in rows]
    general = lambda s: "*" if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]+)?", s) or (re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s)) else s
    shapes = [(h, tuple(general(s) for s in p.split("/") if s)) for _, h, p in parsed]
    verdicts = [best(h, p, rules) for _, h, p in parsed]
    labelled, blocked = Counter(), Counter()
    for s, (_, v) in zip(shapes, verdicts):
        labelled[s] += v is not None
        blocked[s] += v == "block"
    total = lambda keys: (sum(labelled[k] for k in keys), sum(blocked[k] for k in keys))
    lab, blk = total(labelled)
    root = blk / lab if lab else 0.0
    tree = {}
    for s in labelled:
        a, b = total([k for k in labelled if k[0] == s[0]])
        tree[s] = ("", (b + strength * root) / (a + strength))
    seg = lambda s, d: s[1][d] if d < len(s[1]) else "$"
    for d in range(max([depth, *(len(s[1]) for s in tree)])):
        families = {}
        for s, (template, _) in tree.items():
            families.setdefault((s[0], template), []).append(s)
        new = dict(tree)
        for (_, template), family in families.items():
            if d >= depth and (len(family) == 1 or all(len(s[1]) <= d for s in family)):
                continue
            lab_up, blk_up = total(family)
            names = {}
            for step in {seg(s, d) for s in family}:
                a, b = total([k for k in family if seg(k, d) == step])
                share = blk_up / lab_up if lab_up else 0
                error = (share * (1 - share) / a) ** 0.5 if a else 0
                unlike = step != "*" and error > 0 and abs(b / a - share) >= z * error
                names[step] = step if unlike or step == "$" else "*"
            for s in family:
                a, b = total([k for k in family if names[seg(k, d)] == names[seg(s, d)]])
                new[s] = (template + "/" + names[seg(s, d)], (b + strength * tree[s][1]) / (a + strength))
        tree = new
    out = {}
    for (i, h, p), s, (rule, v) in zip(parsed, shapes, verdicts):
        template, purity = tree[s]
        out[i] = (h, p, rule, v or ("block" if purity >= threshold else "allow"), template, round(purity, 9))
    return out


def test_query_against_the_loop(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = entry.queries()["op8_path_templates"](spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, r.purity) for r in got} == judge(rows, RULES)


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://A.B.Example.ORG/es/x?y", "x://example.org", "http://notexample.org/es/", "a://b://c/d",
    "http://Example.org/en/1#f", "http://h.com?x/de/", "http://h.com/de/\n12", "http://h.com//de//5", "http://com/de/", "http://xcom/de/",
]


def test_odd_urls(spark):
    rows = list(enumerate(ODD_URLS * 2)) + [(None, "http://h.com/de/")]
    df = spark.createDataFrame([(i, u, "t", 0.5) for i, u in rows], "page_id long, url string, template string, n double")
    got = path_templates.judge(df, RULES).withColumn("purity", F.round("purity", 9)).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == judge(rows, RULES) and len(got) == len(rows)
    assert path_templates.judge(df.limit(0), RULES).count() == 0
    unlabelled = path_templates.judge(df, []).collect()
    assert {(r.rule, r.verdict) for r in unlabelled} == {(None, "allow")}


def test_branches_merge_and_split(spark):
    """Branches with the labels of their parent merge, an unlike one keeps its own template, crowded names become wildcards."""
    rules = [("s.com", "/shop/sale/", "block"), ("s.com", "/shop/", "allow"), ("s.com", "/blog/", "allow")]
    urls = [f"http://s.com/shop/sale/{i}" for i in range(40)] + [f"http://s.com/shop/{w}/{i}" for w in "abcdefghijklmnopqrst" for i in range(40)]
    urls += [f"http://s.com/blog/post-{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x" for i in range(100)] + ["http://s.com/new/thing"]
    rows = list(enumerate(urls))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in path_templates.judge(df, rules).collect()}
    assert {i: (r.template, r.verdict) for i, r in got.items()} == {i: (v[4], v[3]) for i, v in judge(rows, rules).items()}
    # none of 100 labels below /blog is blocked, but 40 of all 940: more than 1.96 standard errors apart
    assert (got[0].template, got[50].template, got[850].template[:6]) == ("/*/sale/*", "/*/*/*", "/blog/")


DEEP_RULES = [("d.com", "/a/b/c/d/bad/p", "block"), ("d.com", "/a/b/c/d/good/p", "allow"), ("d.com", "/a/b/c/p", "allow"), ("e.com", "/t/", "block")]
DEEP_URLS = [f"http://d.com/a/b/c/d/{w}/p{i}/x" for w in ("bad", "good") for i in range(30)] + [
    "http://d.com/a/b/c/d/bad/q/x", "http://d.com/a/b/c/d/good/q/x", "http://d.com/a/b/c/p", "http://d.com/a/b/c/d", "http://e.com/a/b/c/d/e/f",
    "http://e.com/" + "t/" * 10, "http://e.com/" + "t/" * 9 + "u", "http://e.com/t/t/u/7/8/9/1/2/3/x", "http://e.com/t/t/u/7/8/9/1/2/3/y/z",
]


def test_deep_paths_against_the_loop_and_sql(spark, tmp_path):
    """Ten segments and more: operator, loop and SQL twin agree."""
    rows = list(enumerate(DEEP_URLS))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = path_templates.judge(spark.read.parquet(f"{tmp_path}/pages.parquet"), DEEP_RULES).withColumn("purity", F.round("purity", 9))
    assert {r.page_id: tuple(r)[1:4] + (r.verdict, r.template, r.purity) for r in got.collect()} == judge(rows, DEEP_RULES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert difference(got, con, oracles.url_verdicts(DEEP_RULES)) is None


def test_deep_branches_are_told_apart(spark):
    """Below the third segment, too, an unlabelled page follows the labels of its own branch."""
    rules = [("d.com", "/a/b/c/d/bad/p", "block"), ("d.com", "/a/b/c/d/good/p", "allow"), ("d.com", "/a/b/c/p", "allow")]
    urls = [f"http://d.com/a/b/c/d/{w}/p{i}/x" for w in ("bad", "good") for i in range(30)]
    urls += ["http://d.com/a/b/c/d/bad/q/x", "http://d.com/a/b/c/d/good/q/x", "http://d.com/a/b/c/p", "http://e.com/a/b/c/d/e/f"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in path_templates.judge(df, rules).collect()}
    assert len(got) == len(urls) and [got[i].verdict for i in (60, 61)] == ["block", "allow"]
    assert got[60].template.startswith("/*/*/*/*/bad/") and got[61].template.startswith("/*/*/*/*/good/")


def test_an_unlike_branch_of_a_crowded_node_stays(spark):
    """A branch with a hundredth of a crowded node's pages, all labelled ones blocked, is not judged by the others."""
    letters = "abcdefghij"
    rules = [("c.com", "/bad/p", "block")] + [("c.com", f"/{a}", "allow") for a in letters]
    urls = [f"http://c.com/{a}{b}/p{i}" for a in letters for b in letters for i in range(19)]
    urls += [f"http://c.com/bad/p{i}" for i in range(10)] + [f"http://c.com/bad/q{i}" for i in range(9)]
    rules.remove(("c.com", "/b", "allow"))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = path_templates.judge(df, rules).where("path like '/bad/q%'").collect()
    assert {r.verdict for r in got} == {"block"} and all(r.template.startswith("/bad/") for r in got)


def brute(rows, ask, k):
    out = []
    for i, v in rows:
        if ask(i):
            near = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i)
            out += [(i, n, j, -s) for n, (s, j) in enumerate(near[:k], 1)]
    return out


def test_all_neighbours_of_a_small_table(spark):
    """With every vector compared in full the index gives the exact answer, ties and blocks included."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    bad = [(200, None), (201, [0.0] * 8), (202, [None] + [1.0] * 7), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, rows[1][1]), (205, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, ids int, block int")
    got = permutations.search(df, F.col("vec_id") % 5 == 0, k=10, share=1.0, block_rows=20, query_rows=7, pivots=16)
    want = brute(rows, lambda i: i % 5 == 0, 10)
    mine = sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect())
    assert mine == sorted(w[:3] for w in want)
    few = permutations.search(df.where("vec_id < 3"), F.col("vec_id") % 5 == 0, k=10).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert permutations.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query_recall(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = entry.queries()["op10_permutation_index"](spark, sf).collect()
    ask = {i for i, _ in rows if i % 20 == 0}
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == ask
    hits = 0
    for i, v in rows:
        if i in ask:
            s = x @ v
            s[ids == i] = -np.inf
            hits += len({r.vec_id for r in by[i]} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
            own = sorted(by[i], key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 21))
            assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
            assert all(r.score == pytest.approx(float(s[ids == r.vec_id][0]), abs=1e-12) for r in own)
    assert hits >= 0.9 * 20 * len(ask)


def test_all_neighbours_of_unequal_length(spark):
    """More than one full block of vectors of log-normal length, with the parameters of the query: the exact answer."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 64))
    x *= (rng.lognormal(sigma=0.5, size=len(x)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in permutations.search(df, F.col("vec_id") % 400 == 0).collect()}
    want = {}
    for i in range(0, len(x), 400):
        score = x @ x[i]
        score[i] = -np.inf
        want |= {(i, n): int(j) for n, j in enumerate(np.argsort(-score, kind="stable")[:20], 1)}
    assert got == want
