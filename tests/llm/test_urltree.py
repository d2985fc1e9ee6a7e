"""URL parts, rules, template tree and its verdicts; no Python in the plan."""

import math
import random
import re

from playtrail.llm import urltree

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1", "http://net/x", "http://xnet/x", "http://net", "http://a.net?x://b/c",
        "http://a.example.com/de/5.html#f", "http://a.example.com/de", "http://É.ORG/fr/?q", "x://y://z/p", "http://h/a\nb/c?d",
        "http://deep/1/2/3/4/5/6", "http://a.example.net//en/", "http://www.org/fr", "http://" + "a." * 20_000 + "net/" + "s/" * 20_000]


def slow_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def slow_rule(host, path):
    fits = []
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "t") for i, u in enumerate(urls)],
                                 "page_id bigint, url string, host string, Path string, template string")


def test_parts_and_rules_equal_brute_force(spark):
    out = urltree.judge(frame(spark, URLS), RULES)
    assert sorted(out.columns) == sorted(["page_id", "url", "host", "path", "rule", "template", "verdict"])
    for r in out.collect():
        host, path = slow_parts(r["url"])
        rule, verdict = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == (verdict or "allow")


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"h/en/{i}", None) for i in range(40)] + [(f"h/spam/{i}", True) for i in range(30)]
    rows += [(f"h/good/{i}", False) for i in range(30)] + [(f"h/rare{i}/x", True) for i in range(3)]
    rows += [(f"h/spam/{i}", None) for i in range(100, 103)]
    df = spark.createDataFrame([(f"http://{u}", bad) for u, bad in rows], "url string, bad boolean")
    out = {r["url"]: r for r in urltree.judge(df, [], label=df["bad"]).collect()}
    # All labels below /spam are alike and in one branch: nothing says that it is similar to others.
    assert out["http://h/spam/101"]["template"] == "/spam/<n>" and out["http://h/spam/101"]["verdict"] == "block"
    assert out["http://h/good/1"]["verdict"] == "allow" and out["http://h/en/1"]["verdict"] == "allow"
    assert out["http://h/en/1"]["template"] == "/en/<n>"
    assert out["http://h/rare1/x"]["template"].startswith("/*")


def slow_templates(rows, depth=urltree.DEPTH, support=urltree.SUPPORT, deviations=urltree.DEVIATIONS):
    """Templates of (host, path, label) rows, node by node from the definition."""
    def shape(s):
        return ("<n>" if re.fullmatch("[0-9]+", s) else "<n>." + s.rsplit(".", 1)[1] if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]+", s)
                else "<id>" if re.search("[0-9]", s) else s)

    def cut(path):
        parts = [s for s in path.split("/") if s]
        return [*map(shape, parts[:depth - 1]), *(["**"] if len(parts) > depth else map(shape, parts[depth - 1:depth]))]

    names = {}

    def grow(members, node, level):
        branches = {}
        for i, segs, label in members:
            if len(segs) <= level:
                names[i] = node
            else:
                branches.setdefault(segs[level], []).append((i, segs, label))
        labels = [m[2] for m in members if m[2] is not None]
        below = {}
        for name, some in branches.items():
            known = [m[2] for m in some if m[2] is not None]
            step = name
            if len(some) < support:
                step = "*" if known else "?"
            elif known and len(known) < len(labels) and 0 < sum(labels) < len(labels):
                share = sum(labels) / len(labels)
                if abs(sum(known) / len(known) - share) <= deviations * math.sqrt(share * (1 - share) / len(known)):
                    step = "+"
            below.setdefault(step, []).extend(some)
        for step, some in below.items():
            grow(some, f"{node}/{step}", level + 1)

    for host in {r[0] for r in rows}:
        grow([(i, cut(p), label) for i, (h, p, label) in enumerate(rows) if h == host], "", 0)
    return names


def test_templates_equal_a_slow_tree(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(1500):
        host = rng.choice(["a", "a", "a", "b"])
        path = "/".join(rng.choice(["", "x", "y", "z", "7", "8.html", "q9", "w"]) for _ in range(rng.randrange(9)))
        bad = {"x": 0.9, "y": 0.5, "z": 0.5}.get(path.split("/")[0], 1.0)
        rows.append((host, "/" + path, rng.choice([None, None, rng.random() < bad])))
    df = spark.createDataFrame([(i, f"http://{h}{p}", bad) for i, (h, p, bad) in enumerate(rows)], "i int, url string, bad boolean")
    out = {r["i"]: r for r in urltree.judge(df, [], label=df["bad"]).collect()}
    want = slow_templates(rows)
    assert {i: r["template"] for i, r in out.items()} == want
    assert {s for t in want.values() for s in t.split("/")} >= {"*", "?", "+", "<n>", "<n>.html", "<id>", "**"}
    by = {}
    for i, (h, _, bad) in enumerate(rows):
        by.setdefault((h, want[i]), []).append(bad)
    for i, (h, _, bad) in enumerate(rows):
        group = by[h, want[i]]
        unknown = group.count(None) * urltree.UNLABELLED
        rejected = (group.count(True) + unknown / 2 + 1) / (len(group) - group.count(None) + unknown + 2) > urltree.REJECT
        assert (out[i]["verdict"] == "block") == rejected


def test_rare_and_unlabelled_branches_beside_a_hot_bad_one(spark):
    """All labels of the host are bad and in one branch; others, rare or not, are not condemned with it."""
    rows = [(f"h/de/{i}", True) for i in range(300)] + [(f"h/fr/{i}", None) for i in range(5)] + [(f"h/es/{i}", None) for i in range(40)]
    df = spark.createDataFrame([(f"http://{u}", bad) for u, bad in rows], "url string, bad boolean")
    out = {r["url"]: r for r in urltree.judge(df, [], label=df["bad"]).collect()}
    assert out["http://h/de/1"]["verdict"] == "block" and out["http://h/de/1"]["template"] == "/de/<n>"
    assert {out[f"http://h/{x}"]["verdict"] for x in ("fr/1", "fr/4", "es/1", "es/39")} == {"allow"}


def test_few_labels_do_not_condemn_unknown_urls(spark):
    rows = [(f"http://h/a{i}x/y", True if i < 10 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert {r["verdict"] for r in urltree.judge(df, [], label=df["bad"]).collect()} == {"allow"}


def test_rows_are_kept_and_empty_table(spark):
    df = frame(spark, ["http://a.net/x"] * 7)
    assert urltree.judge(df, RULES).count() == 7
    assert urltree.judge(df.where("false"), RULES).count() == 0


def test_no_python_in_the_plan(spark):
    plan = urltree.judge(frame(spark, URLS), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
