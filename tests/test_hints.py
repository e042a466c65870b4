"""Dependencies a text names, and changes an error speaks about, against plain restatements; lists of rows per key."""

import random
import re

from flipline.operators import artifacts, diffs
from flipline.operators.scans import in_lists

CASES = "case_id string, cve string, artifact string, baseline_version string, target_version string, cause string, repo string, signal_text string"


def test_lists_hold_every_row_once(spark):
    rows = [("small", i) for i in range(5)] + [("hot", i) for i in range(5000)]
    out = in_lists(spark.createDataFrame(rows, "k string, v int"), "k", ["v"], "l", size=100, salts=8).collect()
    assert sorted((r.k, x.v) for r in out for x in r.l) == sorted(rows)
    assert sum(r.k == "small" for r in out) == 1 and 1 < sum(r.k == "hot" for r in out) <= 9


def tokens(gav):
    group, name = gav.lower().split(":", 1)[0], gav.lower().rsplit(":", 1)[-1]
    parts = group.split(".") + re.split(r"[-_.]+", name)
    return dict.fromkeys(p for p in parts if len(p) >= 3 and p not in artifacts.SKIP_TOKENS)


def plain_signal(deps, text):
    low = (text or "").lower()
    if not low.strip():
        return None
    flat, scores = re.sub(r"[^a-z0-9]", "", low), []
    for gav in deps:
        bare = re.sub(r"[^a-z0-9]", "", gav.rsplit(":", 1)[-1].lower())
        score = (6 if bare and bare in flat else 0) + sum(low.count(t) for t in tokens(gav))
        if score:
            scores.append((score, gav))
    best = [g for s, g in scores if s == max(scores)[0]]
    return best[0] if len(best) == 1 else None


def test_signal_dependency(spark):
    rng = random.Random(7)
    names = ["org.acme.web:acme-web", "org.acme:acme-json", "io.fast:fastjson", "com.zip:zip4j", "org.xml:xml-io", "net.db:db_driver", "org.acme.web:web-core"]
    words = ["acme", "web", "acme-web", "ACMEJSON", "fastjson", "zip4j", "zip", "xml", "io", "driver", "db_driver", "import", "test", "core"]
    cases, deps, want = [], [], {}
    for i in range(120):
        mine = rng.sample(names, rng.randrange(2, 6)) + [rng.choice(names)] * (i % 3 == 0)
        text = rng.choice([None, " ", ".".join(rng.choice(words) for _ in range(rng.randrange(12)))])
        cases.append((f"c{i}", None, None, "1", "2", None, None, text))
        deps += [(f"c{i}", g, "9", None) for g in mine]
        want[f"c{i}"] = plain_signal(mine, text)
    got = artifacts.artifact_hints(
        spark.createDataFrame(cases, CASES),
        spark.createDataFrame(deps, "case_id string, gav string, version string, scope string"),
        spark.createDataFrame([], "cve string, gav string, version string"),
    ).collect()
    assert {r.case_id: r.artifact for r in got} == want and sum(w is not None for w in want.values()) > 20


def test_related_changes(spark):
    rng = random.Random(8)
    classes = [f"a.b.{n}" for n in ("One", "Two$In", "Three", "Four$Deep$Er", "Five")]
    errors, changes, whole, want = [], [], [], {}
    for i in range(60):
        text = " ".join(rng.choice(["One", "a.b.Two$In", "In;", "Three.run", "Four$Deep$Er", "Er", "none", "xFivey"]) for _ in range(3))
        errors.append((f"c{i}", rng.choice([text, text, None])))
        found = []
        for c in classes:
            last, simple = c.rsplit(".", 1)[-1], c.rsplit(".", 1)[-1].rsplit("$", 1)[-1]
            t = errors[-1][1] or ""
            if rng.random() < 0.5:
                whole.append((f"c{i}", c, "removed_class", c))
                found += [(0, c, 0, c)] if simple in t else []
            else:
                for k in range(2):
                    changes.append((f"c{i}", c, "removed_methods", f"m{k}()"))
                    found += [(1, c, 2, f"m{k}()")] if c in t or last in t else []
        want[f"c{i}"] = [(c, s) for _, c, _, s in sorted(found)]
    schema = "case_id string, class_name string, change_type string, symbol string"
    out = diffs.related_changes(
        spark.createDataFrame(errors, "case_id string, error_text string"), spark.createDataFrame(changes, schema), spark.createDataFrame(whole, schema)
    )
    got = {}
    for r in out.orderBy("case_id", "rank").collect():
        got.setdefault(r.case_id, []).append((r.class_name, r.symbol))
    assert got == {k: v for k, v in want.items() if v}
